from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelens.llm import common, decontaminate, license_scan, oracle, pii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_license_base_equals_brute_force(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            words, places, labels = re.findall(WORD, lower(r.text)), [], set()
            for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
                p = phrase.split()
                found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
                places += found
                labels |= {label} if found else set()
            want[r.doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
        got = license_scan.scan_documents(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert license_scan.scan_documents(no_docs).collect() == []


def test_license_templates_accept_variants(spark):
    texts = [
        (1, "This file is Licensed under the Apache License, Version 2.0 (the thing)."),
        (2, "licensed under the apache license 2.0"),
        (3, "licensed under the apache licence version 2.0"),
        (4, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
        (5, "Licensed under CC BY-NC 4.0. Released under the MIT License."),
        (6, "licensed under the gnu general public license as published by the free software foundation version 3"),
        (7, "licensed under the new general public license version 3"),
        (8, "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
        (9, "under the terms of the GNU Lesser General Public License, version 2.1 of the License, or (at your option) any later version"),
        (10, "Licensed under the MIT license; permission is hereby granted"),
    ]
    got = {r.doc_id: r for r in license_scan.scan_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache,apache-2.0" and got[1].score == 1.0
    assert got[2].labels == "apache,apache-2.0"
    assert got[3].labels == "" and 0 < got[3].score < 1
    assert got[4].labels == "bsd-text"
    assert got[5].labels == "cc-by-nc-4.0,mit,mit-notice"
    assert got[6].labels == "gpl,gpl-3.0"
    assert got[7].labels == "gpl" and got[7].base_labels == "gpl"
    assert got[8].labels == "gpl,gpl-3.0" and got[9].labels == "gpl,lgpl" and got[10].labels == "mit,mit-licensed"
    assert [(m.label, m.start, m.end) for m in got[1].matches] == [("apache-2.0", 3, 11)]


def test_each_common_notice_has_a_template(spark):
    notices = {
        "SPDX-License-Identifier: MIT": "spdx-mit",
        "SPDX-License-Identifier: Apache-2.0": "spdx-apache-2.0",
        "// SPDX-License-Identifier: GPL-2.0-only": "spdx-gpl-2.0",
        "under the Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-named-4.0",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License": "cc-by-nc-sa-named-4.0",
        "CC0: Creative Commons Zero 1.0 Universal, the public domain dedication": "cc0-1.0-notice",
        "released under the BSD 3-Clause License": "bsd-3-clause-notice",
        "released under the BSD license": "bsd-notice",
        "distributed under the ISC License": "isc-notice",
        "this is under the GNU\nGPL v3": "gpl-3.0-short",
        "GNU GPL, version 2": "gpl-2.0-name",
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "apache-2.0-text",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.": "gpl-3.0-text",
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.": "lgpl-3.0-text",
        "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions": "mpl-2.0-text",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software": "unlicense-text",
    }
    docs = spark.createDataFrame([(i, f"Some words. {text}, and more.") for i, text in enumerate(notices)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_documents(docs).collect()}
    for i, label in enumerate(notices.values()):
        assert label in got[i].labels.split(",") and got[i].score == 1.0, (label, got[i].labels)


def test_automata_accept_what_their_patterns_match():
    """Each template as a regular expression over words; all starts and ends of random texts are tried."""
    rng = random.Random(9)
    templates = {
        "one": "a b <<beginOptional>>c<<endOptional>> d",
        "two": "<<beginOptional>>a<<endOptional>> b <<var;max=2>> a",
        "three": "a <<beginOptional>>b <<beginOptional>>c<<endOptional>> <<endOptional>> <<var;max=1>> d <<beginOptional>>a<<endOptional>>",
    }
    for label, template in templates.items():
        made = license_scan.compile_template(label, template)
        pattern = template.replace("<<beginOptional>>", " (?: ").replace("<<endOptional>>", " )? ")
        pattern = re.sub(r"<<var;max=(\d)>>", r" (?:[a-d],){0,\1} ", pattern)
        pattern = re.compile("".join(f"{p}," if p in "abcd" else p for p in pattern.split()))
        for _ in range(300):
            words = [rng.choice("abcd") for _ in range(rng.randrange(9))]
            want = []
            for end in range(1, len(words) + 1):
                starts = [s for s in range(end) if pattern.fullmatch("".join(f"{w}," for w in words[s:end]))]
                want += [(max(starts), end)] if starts else []
            assert license_scan.run_automaton(made, [w.encode() for w in words])[0] == want, (template, words)
    with pytest.raises(ValueError):
        license_scan.compile_template("none", "<<beginOptional>>a<<endOptional>>")


def brute_hits(docs, items):
    windows = {}
    for item_id, text in items:
        words = re.findall(WORD, lower(text))
        for i in range(max(1, len(words) - 9)):
            if words:
                windows.setdefault(tuple(words[i : i + 10]), set()).add(str(item_id))
    lengths = {len(w) for w in windows}
    for doc_id, text in docs:
        words, hit, found = re.findall(WORD, lower(text)), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        yield doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_equals_brute_force(spark, sf_dir, documents, odd_docs, no_docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    odd_items = spark.createDataFrame([(1, "the same text the same text the same text the same text"), (2, "word"), (3, None), (4, ""), (None, "word"), (2, "word")], "item_id long, text string")
    for docs, bench in ((documents, items), (odd_docs, odd_items), (documents, odd_items)):
        want = Counter(brute_hits([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in bench.collect() if r.item_id is not None]))
        got = decontaminate.contamination(docs, bench).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
        kept = decontaminate.drop_contaminated(docs, bench)
        assert kept.columns == docs.columns
        assert kept.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontaminate.contamination(no_docs, items).collect() == []
    assert decontaminate.contamination(documents, items.limit(0)).where("contaminated").count() == 0


def test_blocks_give_the_same_hits(spark, sf_dir, documents, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = Counter(map(str, decontaminate.contamination(documents, items).collect()))
    kept = Counter(map(str, decontaminate.drop_contaminated(documents, items).collect()))
    for few, size in ((50, 64 << 20), (50, 100)):
        monkeypatch.setattr(decontaminate, "FEW_WINDOWS", few)
        monkeypatch.setattr(decontaminate, "FEW_BYTES", size)
        assert Counter(map(str, decontaminate.contamination(documents, items).collect())) == whole
        assert Counter(map(str, decontaminate.drop_contaminated(documents, items).collect())) == kept


def test_long_texts_meet_many_windows_in_linear_space(spark, monkeypatch):
    """Beyond all limits each word is shuffled with its neighbours only, so a text of 200,000 words is no square."""
    monkeypatch.setattr(decontaminate, "FEW_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "FEW_BYTES", 0)
    words = [f"w{i * 7919 % 100_003}" for i in range(200_000)]
    cuts = [0, 5, 990, 995, 1000, 1995, 150_000, 199_990]
    items = [(i, " ".join(words[c : c + 10])) for i, c in enumerate(cuts)] + [(90, "absent words of an item that nobody has at all"), (91, "w7919")]
    docs = [(1, " ".join(words)), (2, None), (3, ""), (4, "a " * 3000 + " ".join(words[:10]))]
    rows = [spark.createDataFrame(r, "id long, text string") for r in (docs, items)]
    got = decontaminate.contamination(rows[0].withColumnRenamed("id", "doc_id"), rows[1].withColumnRenamed("id", "item_id")).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_hits(docs, items))


def test_a_window_of_many_items_is_joined_once(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    items = [(i, f"{passage} x{i}") for i in range(300)] + [(1000, "lone word"), (1001, passage)]
    docs = [(i, f"a b {passage} c d") for i in range(50)] + [(60, "a lone word"), (61, "nothing")]
    rows = [spark.createDataFrame(r, "id long, text string") for r in (docs, items)]
    got = decontaminate.contamination(rows[0].withColumnRenamed("id", "doc_id"), rows[1].withColumnRenamed("id", "item_id")).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_hits(docs, items))
    assert {r.n_items for r in got} == {301, 1, 0}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d) // 10 + (2 * d) % 10 for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


TEXT = "card 4111 1111 1111 1111 or 4785380592391139, call +1 (555) 123-4567, from 152.143.123.131, on 2024-02-29 or 31/12/1999, ssn 123-45-6789, mail Jo.12@mail5.example.com. Not: 4111111111111112, 300.1.1.1, 2023-02-29, 000-12-3456, 12345."


def test_pseudonyms_keep_the_format_and_turn_back(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "again +1 (555) 123-4567 and Jo.12@mail5.example.com"), (3, None), (4, "")], "doc_id long, text string")
    made = pii.pseudonymise(docs, "k").select("doc_id", "text", "found", "clean").cache()
    rows = {r.doc_id: r for r in made.collect()}
    found = {(x.kind, x.value): x.pseudonym for x in rows[1].found}
    assert {k for (k, _), p in found.items() if p} == {"card", "phone", "ip", "date", "ssn", "email"}
    for value in ("4111111111111112", "300.1.1.1", "2023-02-29", "000-12-3456"):
        assert value in rows[1].clean
    for (kind, value), p in found.items():
        if p:
            assert p != value and value not in rows[1].clean
            if kind != "email":
                assert re.sub(r"\d+" if kind == "ip" else r"\d", "9", p) == re.sub(r"\d+" if kind == "ip" else r"\d", "9", value)
    card = found["card", "4111 1111 1111 1111"]
    assert luhn(card.replace(" ", "")) and card[0] == "4"
    other = {(x.kind, x.value): x.pseudonym for x in rows[2].found}
    assert other["phone", "+1 (555) 123-4567"] == found["phone", "+1 (555) 123-4567"]
    assert rows[3].clean is None and rows[4].clean == ""
    back = pii.pseudonymise(made.select("doc_id", F.col("clean").alias("text")), "k", back=True).where("doc_id = 1").first().clean
    email = found["email", "Jo.12@mail5.example.com"]
    assert back.replace(email, "Jo.12@mail5.example.com") == TEXT


#: One of each format that is read, by kind, and look-alikes that fail validation.
PLANTED = {
    "phone": ["(555) 123-4567", "555-123-4567", "555.123.4567", "555 123-4567", "+44 20 7946 0958", "212 555 1234", "1-800-555-1234", "020 7946 0958"],
    "date": ["12/31/1999", "31/12/1999", "31.12.1999", "1999-12-31", "02/29/2024", "01/13/1600"],
    "card": ["3782 822463 10005", "3782-822463-10005", "378282246310005", "3056 930902 5904", "6011-1111-1111-1117"],
    "ssn": ["123 45 6789", "123-45-6789"],
    "ipv6": ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a", "2001:db8::1", "::1", "fe80::", "2001:db8::"],
    "iban": ["GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000", "MT84MALT011000012345MTLCAST001S"],
    "ip": ["152.143.123.131"],
}
LOOK_ALIKES = ["155-123-45678", "31/13/1999", "13/32/1999", "3782 822463 10006", "000 12 3456", "1 123 45 6789", "std::abc", "a::b", "12:30:45", "GB28 NWBK 6016 1331 9268 19", "2001:db8::1::2", "be::", "2125551234", "123 45 6789 1", "212 555 1234 5"]


def test_each_format_is_replaced_and_turned_back(spark):
    rows = [(kind, value) for kind, values in PLANTED.items() for value in values]
    docs = spark.createDataFrame([(i, f"see {v}, and {v}.") for i, (_, v) in enumerate(rows)], "doc_id long, text string")
    made = pii.pseudonymise(docs, "k").select("doc_id", "text", "found", "clean").cache()
    got = {r.doc_id: r for r in made.collect()}
    for i, (kind, value) in enumerate(rows):
        assert [(x.kind, x.value) for x in got[i].found] == [(kind, value)] * 2, value
        new = got[i].found[0].pseudonym
        assert new and new != value and value not in got[i].clean, value
        if kind not in ("ip", "iban"):
            assert re.sub("[0-9a-f]", "9", new) == re.sub("[0-9a-f]", "9", value)
        if kind == "iban":
            assert pii_mod(new.replace(" ", "")) == 1 and [len(x) for x in new.split()] == [len(x) for x in value.split()]
        if kind == "card":
            assert luhn(re.sub(r"\D", "", new))
    back = {r.doc_id: r.clean for r in pii.pseudonymise(made.select("doc_id", F.col("clean").alias("text")), "k", back=True).collect()}
    assert back == {r.doc_id: r.text for r in got.values()}
    others = spark.createDataFrame([(i, f"see {v}, and") for i, v in enumerate(LOOK_ALIKES)], "doc_id long, text string")
    assert [r.text for r in pii.pseudonymise_documents(others, "k").orderBy("doc_id").collect()] == [f"see {v}, and" for v in LOOK_ALIKES]


def pii_mod(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def plain_feistel(l, r, a, b, key, kind):
    prf = lambda step, half: int(hashlib.sha256(f"{key}|{kind}|{step}|{half}".encode()).hexdigest()[:15], 16)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            l = (l + prf(i, r) % a) % a  # noqa: E741
        else:
            r = (r + prf(i, l) % b) % b
    return l, r


def test_pseudonyms_agree_with_a_plain_feistel(spark):
    docs = spark.createDataFrame([(1, "4785380592391139 and 555-123-4567 and 2024-02-29 and 123-45-6789 and 10.0.255.1")], "doc_id long, text string")
    found = {x.kind: x.pseudonym for x in pii.pseudonymise(docs, "k").first().found}
    l, r = plain_feistel(int("7853805"), int("9239113"), 10**7, 10**7, "k", "card")  # noqa: E741
    card = f"4{l:07d}{r:07d}"
    assert found["card"][:-1] == card and luhn(found["card"])
    l, r = plain_feistel(55123, 4567, 10**5, 10**4, "k", "phone")  # noqa: E741
    assert found["phone"].replace("-", "") == f"5{l:05d}{r:04d}"
    late = [d for d in (date(2000, 1, 1) + timedelta(i) for i in range(146097)) if d.day > 12]  # the cycle of 400 years
    place = late.index(date(2024, 2, 29))
    l, r = plain_feistel(place // 9833, place % 9833, 9, 9833, "k", "late")  # noqa: E741
    assert found["date"] == str(late[l * 9833 + r])
    early = [d for d in (date(2000, 1, 1) + timedelta(i) for i in range(146097)) if d.day <= 12]
    place = early.index(date(2024, 2, 3))
    l, r = plain_feistel(place // 240, place % 240, 240, 240, "k", "early")  # noqa: E741
    assert spark.range(1).select(pii.pseudonym_date(F.lit("03.02.2024"), "k")).first()[0] == early[l * 240 + r].strftime("%d.%m.%Y")
    l, r = plain_feistel(10 * 256, 65281, 1 << 16, 1 << 16, "k", "ip")  # noqa: E741
    assert found["ip"] == f"{l >> 8}.{l & 255}.{r >> 8}.{r & 255}"


def test_late_days_are_permuted_among_themselves(spark):
    days = [date(1896, 1, 1) + timedelta(i) for i in range(0, 80_000, 37)]
    late = [d for d in days if d.day > 12]
    rows = spark.createDataFrame([(d.strftime("%m/%d/%Y"),) for d in late], "m string")
    got = rows.select("m", pii.pseudonym_date(F.col("m"), "k").alias("p")).withColumn("back", pii.pseudonym_date(F.col("p"), "k", back=True)).collect()
    assert all(r.back == r.m and datetime.strptime(r.p, "%m/%d/%Y").day > 12 for r in got) and len({r.p for r in got}) == len(late)


def test_a_day_has_one_pseudonym_however_it_is_written(spark):
    for ways in (["1999-12-30", "30/12/1999", "30.12.1999", "12/30/1999"], ["1999-12-03", "03/12/1999", "03.12.1999"]):
        rows = spark.createDataFrame([(w,) for w in ways], "m string").select("m", pii.pseudonym_date(F.col("m"), "k").alias("p")).withColumn("back", pii.pseudonym_date(F.col("p"), "k", back=True)).collect()
        forms = {4: "%Y-%m-%d", 2: "%d/%m/%Y"}
        days = set()
        for r in rows:
            form = "%m/%d/%Y" if r.m == "12/30/1999" else "%d.%m.%Y" if "." in r.m else forms[len(re.split("[-/]", r.m)[0])]
            days.add(datetime.strptime(r.p, form))
            assert r.back == r.m
        assert len(days) == 1


def test_addresses_in_unbroken_text_are_replaced_and_linked(spark):
    texts = {"plain": "mail anna@x.com now", "chinese": "联系anna@x.com", "after": "联系anna@x.com联系", "long": "联" * 100 + "zhang.wei@example.com", "alone": "zhang.wei@example.com", "latin": "q" * 70 + "zhang.wei@example.com", "domain": "to bob@exämple.de", "cyrillic": "иван@пример.рф!", "dots": "...anna@x.com...", "million": "x" * 1_000_000 + " anna@x.com"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    pseudonym = {k: [x.pseudonym for x in r.found] for k, r in got.items()}
    assert all(len(p) == 1 and p[0] for p in pseudonym.values())
    assert all("anna@" not in r.clean and "wei@" not in r.clean and "bob@" not in r.clean and "иван" not in r.clean for r in got.values())
    assert pseudonym["plain"] == pseudonym["chinese"] == pseudonym["after"] == pseudonym["dots"] == pseudonym["million"] and pseudonym["long"] == pseudonym["alone"]
    assert got["after"].clean == f"联系{pseudonym['plain'][0]}联系" and got["long"].clean.startswith("联" * 100)
    said = spark.createDataFrame([("a", "my ssn is 123 45 6789 on file"), ("b", "123-45-6789")], "doc_id string, text string")
    assert pii.pseudonymise(said, "k").where("size(found) = 1 and clean <> text").count() == 2


def plain_finder(text):
    """Addresses and numbers found without the operator's patterns: from the @ outwards, and by whole tokens."""
    found = set()
    for at in (i for i, c in enumerate(text) if c == "@"):
        i, j = at, at + 1
        while i > 0 and (text[i - 1].isalnum() or text[i - 1] in "._%+-"):
            i -= 1
        while j < len(text) and (text[j].isalnum() or text[j] in ".-"):
            j += 1
        domain = text[at + 1 : j].rstrip(".-")
        if i < at and "." in domain and domain.rsplit(".", 1)[1].isalpha():
            found.add(("email", f"{text[i:at].lstrip('._%+-')}@{domain}"))
    for token in re.split(r"[^\w.:-]+", text):
        token = token.strip(".:-")
        numbers = token.split(".")
        if len(numbers) == 4 and all(x.isascii() and x.isdigit() and len(x) < 4 and int(x) < 256 for x in numbers):
            found.add(("ip", token))
        groups = token.split("-")
        if [len(g) for g in groups] == [3, 2, 4] and token.replace("-", "").isdigit() and 0 < int(groups[0]) < 900 and groups[0] != "666" and int(groups[1]) and int(groups[2]):
            found.add(("ssn", token))
        if [len(g) for g in groups] == [4, 2, 2] and token.replace("-", "").isdigit():
            try:
                date(*map(int, groups))
                found.add(("date", token))
            except ValueError:
                pass
    return found


def test_found_values_equal_a_plain_finder(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.pseudonymise(documents.select("doc_id", "text"), "k").collect()
    plain = {(r.doc_id, *x) for r in rows for x in plain_finder(r.text or "")}
    shaped = {"email": "@", "ip": r"^\d+\.", "ssn": r"^\d{3}-", "date": r"^\d{4}-"}
    got = {(r.doc_id, x.kind, x.value) for r in rows for x in r.found if x.pseudonym and x.kind in shaped and re.search(shaped[x.kind], x.value)}
    assert len(plain) > 20 and got == plain


def test_the_key_is_the_sessions_own(spark):
    before = spark.conf.get(pii.KEY_SETTING, None)
    spark.conf.unset(pii.KEY_SETTING)
    first = pii.session_key(spark)
    assert len(first) == 64 and pii.session_key(spark) == first
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.session_key(spark) == "mine"
    spark.conf.set(pii.KEY_SETTING, before) if before else spark.conf.unset(pii.KEY_SETTING)


def test_long_runs_take_linear_time_and_own_columns_stay(spark):
    begun = time.time()
    texts = ["x" * 1_000_000 + "1", "7" * 1_000_000, "a." * 500_000 + "@", "1:" * 500_000, "A1B2" * 250_000, "5 " * 500_000]
    docs = spark.createDataFrame([(i, t, "mine", "v") for i, t in enumerate(texts)], "doc_id long, text string, _values string, found string")
    made = pii.pseudonymise(docs, "k")
    assert {r._values for r in made.select("_values").collect()} == {"mine"} and made.columns == [*docs.columns, "clean"]
    assert pii.pseudonymise_documents(docs, "k").where("not changed").count() == len(texts)
    assert time.time() - begun < 60


def test_feistel_is_a_permutation(spark):
    df = spark.range(189 * 7).select("id", pii.feistel(F.col("id"), F.lit(189).cast("long"), F.lit(7).cast("long"), "k", "t").alias("to"))
    df = df.withColumn("back", pii.feistel(F.col("to"), F.lit(189).cast("long"), F.lit(7).cast("long"), "k", "t", back=True))
    rows = df.collect()
    assert sorted(r["to"] for r in rows) == list(range(189 * 7))
    assert all(r.back == r.id for r in rows)


def test_pseudonyms_of_documents(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        source = docs.select("doc_id", "text").collect()
        rows = pii.pseudonymise_documents(docs, "k").collect()
        clean = {(r.doc_id, r.text) for r in source}
        assert len(rows) == len(source)
        assert all((r.doc_id, r.text) in clean for r in rows if not r.changed)
        emails = re.compile(r"[\w.+-]+@mail\d+\.example\.com")
        was = {e for r in source for e in emails.findall(r.text or "")}
        assert not was & {e for r in rows for e in emails.findall(r.text or "")}
    assert pii.pseudonymise_documents(no_docs, "k").collect() == []


def test_dropping_contaminated_documents_moves_no_text(spark, monkeypatch):
    """Few documents to drop go to the texts, whatever Spark would broadcast by itself; many are joined by a shuffle, with the same rows left."""
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"well {leak} indeed"), (2, "nothing to see here"), (None, leak.upper()), (3, None), (4, ""), (1, "another text with the same id"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = decontaminate.drop_contaminated(docs, items)
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(decontaminate, "FEW_BAD", 0)
        shuffled = decontaminate.drop_contaminated(docs, items)
        assert "Exchange hashpartitioning" in shuffled._jdf.queryExecution().executedPlan().toString()
        assert Counter(map(tuple, out.collect())) == Counter(map(tuple, shuffled.collect())) == Counter(rows[1:2] + rows[3:])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_are_those_of_the_sql(spark):
    """Every character but the surrogates by itself and between letters; the word class isn't spelled as in the SQL, as that is slow."""
    apart = [chr(c) for c in range(0x3000) if not 65 <= c < 91] + ["퟿", "", "￿", "\U00010000", "\U0010ffff"]
    text = "".join(f"{c} a{c}b " for c in apart)
    want = re.findall(oracle.ALNUM.strip("'"), text)
    got = spark.createDataFrame([(text,), (None,), ("",)], "text string").select(common.words_of(F.col("text"), common.ALNUM_WORD)).collect()
    assert got[0][0] == want and got[1][0] == got[2][0] == []
    plain = text * 3 + "plain words and other ones " * 20_000
    assert len(spark.createDataFrame([(plain,)], "text string").select(common.words_of(F.col("text"), common.ALNUM_WORD)).first()[0]) == 3 * len(want) + 100_000
