from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracelens.llm import mixing, quality_rules, sharding
from tracelens.llm.quality_rules import fit_rules


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_brute_force(documents, odd_docs):
    for docs in (documents, odd_docs):
        texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = Counter((d, *brute_rules(t)) for d, t in texts)
        rows = quality_rules.judge_documents(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        for r in rows:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.base_failed and r.kept)
            assert 0 <= r.posterior <= 1


def test_rules_follow_planted_accuracies():
    patterns = [((1, 1, 1), 900), ((1, 1, -1), 60), ((-1, -1, 0), 80), ((-1, -1, 1), 20), ((0, 0, 1), 40)]
    bias, weights = fit_rules(patterns)
    assert all(w[1] > 0 > w[-1] for w in weights[:2])
    assert weights[0][1] > abs(weights[2][1])
    assert fit_rules([])[1] == []


def test_kept_documents_keep_their_columns(documents, odd_docs, no_docs):
    verdict = {r.doc_id: r.kept for r in quality_rules.judge_documents(documents).collect()}
    kept = quality_rules.keep_good(documents)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, k in verdict.items() if k}
    assert quality_rules.keep_good(odd_docs).columns == odd_docs.columns
    assert quality_rules.judge_documents(no_docs).collect() == []


def test_kept_agree_with_labels(documents, spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in quality_rules.judge_documents(documents).collect() if r.doc_id in labels]
    good = [r.kept for r in rows if labels[r.doc_id] == 1 and not r.base_failed]
    bad = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_jump_hash_moves_only_into_the_new_shard(documents, odd_docs, no_docs):
    def walk(key, n):  # the published loop, one key at a time
        b, j, key = -1, 0, key % 2**64
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    for docs in (documents, odd_docs):
        source = docs.select("doc_id", "text").collect()
        rows = sharding.shard_documents(docs, 40).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in source)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            assert r.shard == walk(-1 if r.doc_id is None else r.doc_id, 40)
            assert r.grown_shard in (r.shard, 40)
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(no_docs).collect() == []


def test_slots_of_rows_that_share_a_key(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 0.01)  # cells of five hash digits
    rows = spark.createDataFrame([(None if i % 3 else i, f"text {i % 200}", 5, "mine") for i in range(900)], "doc_id long, text string, slot int, _cell string")
    placed = sharding.with_slots(sharding.assign_shards(rows, 4), ties=("text",))
    assert placed.columns == ["doc_id", "text", "_cell", "shard", "slot"]
    slots = defaultdict(list)
    for r in placed.collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 900 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_targets_are_capped_and_shared_again():
    targets = mixing.source_targets({"a": 10, "b": 100, "c": 100}, {"a": 5, "b": 2, "c": 1}, 315, 2)
    assert targets["a"] == 20
    assert abs(sum(targets.values()) - 315) < 1e-9
    assert all(targets[s] <= 2 * n + 1e-9 for s, n in {"a": 10, "b": 100, "c": 100}.items())
    assert mixing.source_targets({}, {}, 0, 2) == {}


def test_flow_prefers_fresh_words_and_uses_overlap():
    flows = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 10}, 2)
    assert flows[("a",)]["a"] == 10 and flows[("a", "b")] == {"a": 10, "b": 0} and flows[("b",)]["b"] == 10
    flows = mixing.route({("a",): 10}, {"a": 15}, 2)
    assert flows[("a",)]["a"] == 15
    patterns, quotas = {("a",): 10, ("a", "b"): 10, ("c",): 4, (None,): 3, (): 9, ("d", "e"): 5, ("e",): 1}, {"a": 25, "b": 9, "c": 3, None: 9, "d": 2, "e": 20}
    assert mixing.route(patterns, quotas, 2) == mixing._flow(patterns, quotas, 2)
    many = {(f"s{i}",): 10 + i for i in range(20_000)}
    assert sum(f for part in mixing.route(many, {n[0]: 15 for n in many}, 2).values() for f in part.values()) == 15 * 20_000


def brute_flow(patterns, quotas, repeat):
    """(most words, least cost) over all integer flows."""
    arcs = [(p, s) for p in patterns for s in p]
    best = (0, 0)
    for flow in itertools.product(*[range(min(repeat * patterns[p], quotas[s]) + 1) for p, s in arcs]):
        used, got = Counter(), Counter()
        for (p, s), f in zip(arcs, flow, strict=True):
            used[p] += f
            got[s] += f
        if all(used[p] <= repeat * n for p, n in patterns.items()) and all(got[s] <= q for s, q in quotas.items()):
            cost = sum(max(0, used[p] - k * n) for p, n in patterns.items() for k in range(1, repeat))
            best = max(best, (sum(flow), -cost))
    return best


def test_flow_equals_trying_all(monkeypatch):
    rng = random.Random(3)
    for _ in range(40):
        patterns = {p: rng.randint(1, 4) for p in rng.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("c",)], 3)}
        quotas = {s: rng.randint(0, 6) for s in "abc" if any(s in p for p in patterns)}
        flows = mixing.route(patterns, quotas, 2)
        used = {p: sum(f.values()) for p, f in flows.items()}
        cost = sum(max(0, used[p] - n) for p, n in patterns.items())
        assert (sum(used.values()), -cost) == brute_flow(patterns, quotas, 2)
        assert all(sum(f.get(s, 0) for f in flows.values()) <= q for s, q in quotas.items())


def test_every_mix_goes_through_the_flow(documents, monkeypatch):
    def fail(*_):
        raise RuntimeError("the flow was asked for")

    monkeypatch.setattr(mixing, "_flow", fail)
    for use in (mixing.mix_documents, mixing.repeat_documents):
        with pytest.raises(RuntimeError, match="asked for"):
            use(documents)


def test_mix_of_sources_that_share_texts(spark):
    """A text that several sources hold may be taken for each of them."""
    rows = [(i, f"text {i % 60} of five words", s) for i, s in enumerate("ab" * 40 + "c" * 20)] + [(None, None, None), (200, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = defaultdict(set)
    for _, text, s in rows:
        sources[text or ""].add(s)
    members = mixing.members_by_text(docs)
    assert sorted((sorted(map(str, r.members)), len(r.members)) for r in members.collect()) == sorted((sorted(map(str, s)), len(s)) for s in sources.values())
    joined = docs.withColumn("tag", mixing.text_md5()).join(members, "tag")
    mixed, table = mixing.mix(joined, F.col("members"), F.lit(5), lambda names: dict.fromkeys(names, 1), tie=F.col("tag"))
    patterns = Counter(tuple(r.members) for r in joined.collect())
    patterns = {tuple(sorted(p, key=lambda s: (s is None, s or ""))): 5 * n for p, n in patterns.items()}
    got = Counter()
    for r in mixed.collect():
        got[tuple(r.members)] += r.copies * 5
    flows = mixing.route(patterns, {r.source: int(r.target) for r in table.collect()}, 2)
    assert all(abs(got[p] - sum(f.values())) <= 5 for p, f in flows.items())


def test_hot_rows_are_mixed_and_sharded_in_many_tasks(spark, monkeypatch):
    """A third of the rows without an id, and many of them equal."""
    rows = spark.range(30_000).selectExpr("case when id % 3 > 0 then id end as doc_id", "case when id % 3 > 0 then concat('own words ', id) when id % 2 = 0 then 'hot text of five words' else concat('null id ', id) end as text", "'s' as source").repartition(8)
    got = mixing.mix_documents(rows).collect()
    assert len(got) == 30_000 and abs(sum(r.taken for r in got) - got[0].target) <= 5
    monkeypatch.setattr(sharding, "CELL_ROWS", 1000)
    slots = defaultdict(list)
    for r in sharding.shard_documents(rows, 4).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 30_000


def test_mix_meets_targets_and_repeats(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        rows = mixing.mix_documents(docs).collect()
        again = mixing.mix_documents(docs).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
        sizes = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r["size"]) for r in rows) == sizes
        source = dict.fromkeys(r.source for r in docs.select("source").collect())
        assert len({(r.source_size, r.target) for r in rows}) <= len(source)
        assert all(r.taken <= 2 * r["size"] for r in rows)
        largest = max(r["size"] for r in rows)
        taken, target = Counter(), {}
        for r in rows:
            taken[r.source_size, r.target] += r.taken
            target[r.source_size, r.target] = r.target
        assert all(abs(taken[k] - target[k]) <= largest for k in target)
    assert mixing.mix_documents(no_docs).collect() == []


def test_repeated_documents_equal_taken(documents, odd_docs):
    out = mixing.repeat_documents(documents)
    assert out.columns == documents.columns
    copies = Counter(r.doc_id for r in out.collect())
    assert max(copies.values()) <= 2
    assert mixing.repeat_documents(odd_docs).columns == odd_docs.columns


def test_equal_rows_are_taken_each_on_their_own(spark):
    rows = [(None if i % 2 else 7, "the same five words here", "a", f"p{i % 3}") for i in range(400)] + [(i, "one two three four five", "b", "q") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    target = mixing.source_targets({"a": 2000, "b": 2000}, {"a": 5, "b": 2}, 1.5 * 4000, 2)
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    taken = Counter(r.source for r in out.collect())
    assert all(abs(5 * taken[s] - t) <= 5 for s, t in target.items())
    assert mixing.repeat_documents(docs.limit(0)).collect() == []
