from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracelens.llm import prefix_trie as pt
from tracelens.llm.common import running

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The trie by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + t[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children, leaves, saved = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for n, m in members.items():
        cost = (len(m) - 1) * len(n[-1][1]) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += cost
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha(n)) for n, m in members.items())


def counted(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def trie(spark, rows, **options):
    extra = [(*r, "x", 1, b"y") for r in rows]
    return pt.prefix_trie(spark.createDataFrame(extra, SCHEMA + ", node string, depth int, ids binary"), **options)


ODD = [(100, 0, "user", "a"), (100, 1, "bot", "b"), (100, None, "user", "first"), (101, 0, "user", "own"), (101, 0, "user", "own"), (101, 1, None, None), (None, 0, "user", "nobody's"), (-5, 0, "user", "a"), (-100, 0, "user", "a"), (205, 0, "user", "é中" * 40_000)] + [(c, 0, "user", "short") for c in (301, 302, 303, 304, 305, 306)]


@pytest.mark.parametrize("options", [{}, {"width": 2, "shard_rows": 3}])
def test_odd_conversations_equal_brute_force(spark, options):
    assert counted(trie(spark, ODD, **options)) == brute(ODD)
    assert trie(spark, [], **options).collect() == []


@pytest.mark.parametrize(("width", "shard_rows"), [(32, 50_000), (4, 10), (3, 200), (1, 7)])
def test_random_tries_equal_brute_force(spark, width, shard_rows):
    rng = random.Random(7)
    rows = []
    for c in range(0, 330):
        kind = rng.random()
        if kind < 0.4:  # a third of all conversations and more are copies of one
            texts = ["hi", "hello", "how", "fine", "bye", "x", "y"]
        else:
            texts = [rng.choice(["hi", "hello", "a", "b"]) for _ in range(rng.choice([1, 2, 3, 5, 8, 20 if kind > 0.9 else 4]))]
        rows += [(c, i, "user" if i % 2 == 0 else "bot", t) for i, t in enumerate(texts)]
    assert counted(trie(spark, rows, width=width, shard_rows=shard_rows)) == brute(rows)


def test_long_conversations_that_share_their_beginning(spark):
    rows = [(c, i, "user", f"turn {i}" if i < c else f"own {c} {i}") for c in (100, 130, 130 + 7, 151) for i in range(170)]
    rows += [(7, i % 5, "user", "again") for i in range(300)]
    assert counted(trie(spark, rows, width=8, shard_rows=20)) == brute(rows)


def test_large_groups_are_numbered_by_shards(spark):
    df = spark.range(20_000).selectExpr("case when id % 3 = 0 then id else 1 end as g", "cast(id % 50 as long) as t")
    rows = running(df.repartition(8), "g", ["t"], F.lit(1), "pos").collect()
    hot = sorted((r.pos, r.t) for r in rows if r.g == 1)
    assert [p for p, _ in hot] == list(range(len(hot))) and [t for _, t in hot] == sorted(t for _, t in hot)
    assert all(r.pos == 0 for r in rows if r.g != 1)
