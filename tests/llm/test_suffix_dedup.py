from __future__ import annotations

import hashlib
import random
from collections import Counter

from tracelens.llm import suffix_dedup


def brute(rows):
    least = {}
    for key, text in rows:
        b = (text or "").encode()
        key = suffix_dedup.LAST if key is None else key
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(least.get(w, key), key)
    for doc_id, text in rows:
        b = (text or "").encode()
        key = suffix_dedup.LAST if doc_id is None else doc_id
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < key:
                gone[i : i + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        yield doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def passages(seed):
    rng, rows = random.Random(seed), []
    shared = ["".join(rng.choice("ab é") for _ in range(rng.choice((49, 50, 51, 60, 120, 300)))) for _ in range(12)] + ["a" * 70, "ab" * 60]
    for i in range(80):
        parts = [rng.choice(shared)[rng.randrange(3) :] if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(80))) for _ in range(6)]
        rows.append((i if i % 9 else 3, "".join(parts)))
    return [*rows, (None, shared[0] * 2), (None, None), (7, rows[20][1]), (7, rows[20][1])]


def same_as_brute(spark, rows, **options):
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **options).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(brute(rows))


def test_removed_bytes_equal_brute_force(spark, documents, odd_docs, no_docs):
    for rows in (passages(1), passages(2), *([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] for d in (documents.limit(120), odd_docs))):
        same_as_brute(spark, rows)
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


def words(rng, n):
    return "".join(rng.choice("abcdefghijklm nopqrst") for _ in range(n))


def test_rows_without_id_and_with_repeated_ids_keep_apart(spark):
    rng = random.Random(3)
    passage = words(rng, 70)
    for ids in (lambda i: None, lambda i: 2 + i % 7):
        rows = [(1, passage)] + [(ids(i), words(rng, rng.randrange(40)) + passage + words(rng, 30)) for i in range(2000)]
        same_as_brute(spark, rows)


def test_hot_passages_and_unbroken_runs(spark):
    """A passage and a rule of dashes in each row; small limits, so that hot buckets and anchors go window by window."""
    rng = random.Random(5)
    passage = words(rng, 60)
    rows = [(i, words(rng, 60) + passage + words(rng, 40) + "-" * rng.randrange(45, 400) + words(rng, 10) + "=-" * rng.randrange(20, 60)) for i in range(160)]
    rows += [(i, passage * 3 + "x" * 5000) for i in range(300, 310)]
    same_as_brute(spark, rows)
    same_as_brute(spark, rows, limits=suffix_dedup.Limits(10_000, 100, 20))
    same_as_brute(spark, rows, limits=suffix_dedup.Limits(10_000, 1_000_000, 20))
    same_as_brute(spark, [*rows, *[(None, t) for _, t in rows[:50]], *[(None, rows[0][1])] * 50], limits=suffix_dedup.Limits(10_000, 100, 20))


def test_long_texts_are_taken_in_pieces(spark):
    rng = random.Random(8)
    whole = words(rng, 5_000_000)
    rows = [(1, whole[1_000_000:1_000_200] + "." + whole[3_145_700:3_145_900]), (2, whole), (3, whole[7:]), (4, "-" * 3_000_000), (5, "-" * 60)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (400, 2), 3: (len(whole) - 7, 1), 4: (0, 0), 5: (60, 1)}


def test_small_buckets_give_the_same(spark, documents):
    docs = documents.limit(150)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    whole = Counter(map(str, suffix_dedup.remove_repeats(docs).collect()))
    assert Counter(map(str, suffix_dedup.remove_repeats(docs, limits=suffix_dedup.Limits(10_000, 2_000_000, 50)).collect())) == whole
