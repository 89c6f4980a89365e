from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from tracelens.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """Every document scored for every item, as the formula says."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank, d, -score] += 1
    return out


def counted(df):
    return Counter((r["item"], r["rank"], r["doc"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


def test_search_equals_scoring_every_document(documents, items):
    index = rs.build_index(documents, block_bytes=60_000)
    assert index.select("block").distinct().count() > 5
    want = brute(pairs(documents, "doc_id"), pairs(items, "item_id"))
    for leaf in (0, 64, rs.LEAF_POSTINGS):
        assert counted(rs.search(index, items, leaf=leaf)) == want
    assert counted(rs.search(index, items, query_bytes=2_000)) == want  # several passes


def test_odd_documents_and_items(spark, odd_docs, no_docs):
    asked = [(1, "the SAME text, same Text"), (1, "word id very"), (None, "längst word"), (2, None), (3, ""), (4, "not there"), (5, "a b c word " * 3000)]
    queries = spark.createDataFrame([(*a, "x", 1) for a in asked], "item_id long, text string, query string, rank int")
    assert counted(rs.search(rs.build_index(odd_docs), queries)) == brute(pairs(odd_docs, "doc_id"), asked)
    assert rs.search(rs.build_index(no_docs), queries).collect() == []
    assert rs.search(rs.build_index(odd_docs), queries.limit(0)).collect() == []


def test_ties_go_by_id_across_blocks_and_partitions(spark):
    rows = [(i, "rare word") for i in range(500, 0, -1)] + [(i, "other") for i in range(600, 3000)] + [(None, "rare word")] * 3 + [(7, "rare word")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    asked = [(1, "rare")]
    for k in (5, 600):
        got = rs.search(rs.build_index(docs, block_bytes=500), spark.createDataFrame(asked, "item_id long, text string"), k, leaf=8)
        assert counted(got) == brute(rows, asked, k)


def test_intervals_that_cannot_win_are_not_opened():
    rng = np.random.default_rng(5)
    docs = [np.sort(rng.choice(20_000, 6_000, replace=False)).astype(np.int32) for _ in range(3)]
    impacts = [rng.integers(1, 100, 6_000).astype(np.int32) for _ in range(3)]
    for i in range(10):
        for d, x in zip(docs, impacts, strict=True):
            at = np.searchsorted(d, 700 * i)
            d[at], x[at] = 700 * i if at == len(d) or d[at] != 700 * i else d[at], 1000
    docs = [np.sort(d) for d in docs]
    block, best = rs.Block(list(range(20_000)), ["a", "b", "c"], docs, impacts), rs.Best(10)
    scored = rs.search_block(block, np.arange(3), np.array([3, 2, 1]), best, leaf=16)
    whole = np.zeros(20_000, np.int64)
    for d, x, w in zip(docs, impacts, (3, 2, 1), strict=True):
        np.add.at(whole, d, w * x.astype(np.int64))
    assert sorted((-s, -d) for s, d in best.heap) == sorted((-int(s), int(d)) for d, s in enumerate(whole))[:10]
    assert scored < 200


def test_sparse_table_gives_the_greatest():
    rng = np.random.default_rng(3)
    impact = rng.integers(0, 50, 1000).astype(np.int32)
    block = rs.Block(list(range(1000)), ["t"], [np.arange(1000, dtype=np.int32)], [impact])
    lo = rng.integers(0, 999, 300)
    hi = lo + 1 + (rng.random(300) * (1000 - lo - 1)).astype(np.int64)
    assert all(impact[p] == impact[a:b].max() and a <= p < b for a, b, p in zip(lo, hi, block.greatest(lo, hi), strict=True))
