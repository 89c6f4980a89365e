from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tracelens.llm import ngram_join
from tracelens.llm.components import connected_components
from tracelens.llm.spans import Room


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for t in s:
            where.setdefault(t, []).append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for t in s for j in where[t] if j < i).items():
            if 100 * both >= 90 * (len(s) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def family(seed):
    """Edited copies of a few base texts, at all distances around the threshold, short ones too."""
    rng, rows = random.Random(seed), []
    for length in (3, 5, 9, 10, 11, 20, 40, 120):
        base = [f"w{rng.randrange(500)}" for _ in range(length)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(0, 2)] = [f"w{rng.randrange(500)}"] * rng.randrange(0, 3)
                copy = copy or ["w"]
            rows.append((len(rows) + 1, " ".join(copy)))
    return rows


@pytest.mark.parametrize("most", [512, 20])
def test_components_equal_brute_force(spark, documents, odd_docs, no_docs, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "TOKEN_ROOM", Room(most, 1 << 20))
    tables = [spark.createDataFrame(family(1), "doc_id long, text string")] + ([documents, odd_docs] if most > 20 else [])
    for docs in tables:
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect())
        assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    if most > 20:
        assert ngram_join.ngram_components(no_docs).collect() == []


def test_parts_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    classes = ngram_join.size_classes(1000)
    for n in (1, 2, 9, 10, 11, 19, 20, 21, 57, 200, 640):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, n // 10 + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, int(rng.integers(0, n // 10 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert np.intersect1d(ngram_join.part_hashes(a, classes), ngram_join.part_hashes(b, classes)).size


def test_one_of_each_stays(documents, odd_docs):
    kept = ngram_join.keep_one(documents)
    assert kept.columns == documents.columns
    want = brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, n, c in want if d == c)
    assert ngram_join.keep_one(odd_docs).columns == odd_docs.columns


def test_blocks_of_one_group_lose_no_link(spark, monkeypatch):
    """A family with outliers that are linked to it, to each other, or to nothing; in blocks of a few sets."""
    rng, base = random.Random(11), [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: rng.randrange(4)], *base])) for i in range(40)]
    chain = list(base)
    for i in range(40, 80):  # each is linked to the one before, not to the family's start
        chain[(3 * i) % 120] = f"x{i}"
        rows.append((i, " ".join(chain)))
    rows += [(i, " ".join([*base[:60], *[f"y{i}_{k}" for k in range(60)]])) for i in range(80, 100)]
    for room in (Room(6, 1 << 20), Room(512, 4000)):
        monkeypatch.setattr(ngram_join, "TOKEN_ROOM", room)
        got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
        assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_chains_take_few_rounds(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1000, 1002)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}
