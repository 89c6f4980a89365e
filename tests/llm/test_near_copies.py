from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_ngram_join import family
from tracelens.llm import ngram_join
from tracelens.llm.spans import Room

STAGE = ngram_join.STAGE


def brute_classes(rows, width=5, percent=80):
    """For each row (number of shingles, smallest row of its class)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low)) for _, text in rows]
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("most", [5_000, 3])
def test_stage_links_five_words_at_eight_tenths(spark, documents, sf_dir, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "PART_ROOM", Room(most, 1 << 20))
    for docs in (spark.createDataFrame(family(1), "doc_id long, text string"), *([documents] if most > 3 else [])):
        rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").select("doc_id", "text").collect()]
        classes = brute_classes(rows)
        want = Counter((d, n, rows[root][0]) for (d, _), (n, root) in zip(rows, classes, strict=True))
        assert Counter(tuple(r) for r in ngram_join.ngram_components(docs, STAGE).collect()) == want
        kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()]
        assert sorted(kept) == [d for i, ((d, _), (n, root)) in enumerate(zip(rows, classes, strict=True)) if root == i or not n]


def test_parts_and_sketches_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    classes = ngram_join.size_classes(6000, STAGE)
    linked = 0
    for n in (1, 2, 4, 5, 8, 9, 10, 31, 60, 64, 66, 200, 640, 5000):
        for _ in range(40 if n < 5000 else 5):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, n // 5 + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                linked += 1
                assert np.intersect1d(ngram_join.part_hashes(a, classes, STAGE), ngram_join.part_hashes(b, classes, STAGE)).size
                rows = pd.DataFrame({"part": [1, 1], "fp": [7, 8], "n": [len(a), len(b)], "sketch": [ngram_join.sketch(s).tobytes() for s in (a, b)]})
                assert len(ngram_join.likely_links(rows, STAGE)) == 1
    assert linked > 100


def near_copy_parts(families=6, copies=30, n=400):
    """(part, fp, n, sketch): sets that are all linked to those of their family, in many parts with several of them each."""
    rng, rows = np.random.default_rng(7), []
    classes = ngram_join.size_classes(6000, STAGE)
    for _ in range(families):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for _ in range(copies):
            s = np.unique(np.concatenate([base[rng.permutation(len(base))[len(base) // 40 :]], rng.integers(0, 1 << 63, n // 80, dtype=np.uint64)]))
            rows += [(int(p), ngram_join.fingerprint(s), len(s), ngram_join.sketch(s).tobytes()) for p in ngram_join.part_hashes(s, classes, STAGE).view(np.int64)]
    rows = pd.DataFrame(rows, columns=["part", "fp", "n", "sketch"])
    return rows[rows.groupby("part")["fp"].transform("size") > 1]


def test_near_copies_make_a_link_each():
    links = ngram_join.likely_links(near_copy_parts(), STAGE)
    assert len(links) == 6 * 29 and links["a"].is_unique and links["b"].nunique() == 6
    assert (links["b"] < links["a"]).all()


def test_likely_links_connect_what_all_pairs_do():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64)) for _ in range(4)]
    for i in range(60):  # each is like the one four before, not like the first ones
        sets.append(np.unique(np.concatenate([sets[i][rng.permutation(len(sets[i]))[6:]], rng.integers(0, 1 << 63, 6, dtype=np.uint64)])))
    rows = pd.DataFrame({"fp": rng.permutation(1000)[: len(sets)], "n": [len(s) for s in sets], "sketch": [ngram_join.sketch(s).tobytes() for s in sets]})
    met = [rows.iloc[np.sort(rng.permutation(len(sets))[:k])].assign(part=p) for p, k in enumerate([2, 3, 5, 8, 12, 20, 33, *[3] * 10])]
    known, pairs = ngram_join._Sketches(rows, STAGE), set()
    for some in met:
        a, b = (some.index.to_numpy()[x] for x in np.triu_indices(len(some), 1))
        pairs |= {(x, y) for x, y, good in zip(rows["fp"][a], rows["fp"][b], known.may_link(a, b), strict=True) if good}

    def classes(links):
        root = {f: f for f in rows["fp"]}
        for _ in rows["fp"]:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    links = ngram_join.likely_links(pd.concat(met), STAGE)
    got = classes(list(zip(links["a"], links["b"], strict=True)))
    assert got == classes(pairs) and 4 < len(set(got.values())) < len(sets)
    assert len(links) == len(sets) - len(set(got.values()))


def test_parts_of_near_copies_share_a_bucket(spark, monkeypatch):
    """More buckets, as of a larger table, make few links more; a part is in one bucket, and many rows are dealt over several."""
    rows = near_copy_parts()
    met = spark.createDataFrame(rows[["part", "fp"]])
    parts = met.groupBy("part").agg(F.count("*").alias("k"), F.min("fp").alias("low"))
    low = rows.groupby("part")["fp"].min()

    def dealt(buckets):
        out = ngram_join.part_buckets(parts, buckets).toPandas()
        assert out["part"].is_unique and set(out["part"]) == set(rows["part"])
        return out.set_index("part")["bucket"]

    def made(buckets):
        return sum(len(ngram_join.likely_links(some, STAGE)) for _, some in rows.groupby(rows["part"].map(dealt(buckets))))

    assert made(1) == 6 * 29
    assert made(1000) < 2 * made(20) and made(1000) < len(rows) / 4
    assert dealt(1000).groupby(low).nunique().max() == 1
    monkeypatch.setattr(ngram_join, "LOW_ROWS", 200)
    assert dealt(1000).groupby(low).nunique().max() > 1


def test_each_row_is_judged_by_its_own_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [
        (1, a),
        (2, a + " end"),  # a copy of 1; the other text of id 2 is clean
        (2, b),
        (3, c),
        (3, c + " end"),  # shares the id of the row kept, but is a near copy of it
        (3, c),
        (None, a + " tail"),  # a copy of a row with an id
        (None, "only without ids " + c[: len(c) // 2]),
        (None, "Only without ids " + c[: len(c) // 2]),  # an equal set, without an id too
        (None, " "),
        (None, " "),
        (None, None),
        (4, ""),
        (4, ""),
    ]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), STAGE).collect()
    got = Counter((r.doc_id, (r.text or "").lower().removesuffix(" end")) for r in kept)
    assert got == Counter([(1, a), (2, b), (3, c), (None, "only without ids " + c[: len(c) // 2]), (None, " "), (None, " "), (None, ""), (4, "")])


def test_unlike_sets_of_many_parts_are_compared_once(monkeypatch):
    """200 unlike sets that meet in 30 parts: all pairs in a few steps, a pair once for all parts, also where only some are held at once."""
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 1 << 63, 80, dtype=np.uint64)) for _ in range(200)]
    sets += [np.unique(np.concatenate([s[:-2], rng.integers(0, 1 << 63, 2, dtype=np.uint64)])) for s in sets[:5]]
    fps = [ngram_join.fingerprint(s) for s in sets]
    known = pd.DataFrame({"fp": fps, "n": [len(s) for s in sets], "sketch": [ngram_join.sketch(s).tobytes() for s in sets]})
    met = pd.DataFrame({"part": np.repeat(np.arange(30), len(sets)), "fp": np.tile(fps, 30)})
    compared, may_link = [], ngram_join._may_link
    monkeypatch.setattr(ngram_join, "_may_link", lambda *a: compared.append(len(a[4])) or may_link(*a))
    links = ngram_join.likely_links(met, STAGE, known)
    assert len(compared) <= 4 and sum(compared) <= len(sets) * len(sets) // 2
    monkeypatch.setattr(ngram_join, "PAIRS", 1000)
    again = ngram_join.likely_links(met.merge(known, on="fp"), STAGE)
    assert set(map(tuple, links.to_numpy())) == set(map(tuple, again.to_numpy())) == {(max(p), min(p)) for p in zip(fps[:5], fps[200:], strict=True)}
