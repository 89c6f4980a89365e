from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

from tracelens.llm import decontaminate, mixing, ngram_join, quality_rules
from tracelens.llm.queries import llm_oracle_sql, llm_queries


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(llm_oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = llm_queries()[name](spark, sf_dir)
    assert set(df.columns) == set(names)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cursor.fetchall())


def test_stages_follow_each_other(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by_id = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality_rules.judge_documents(docs).collect() if r.kept}
    step = spark.createDataFrame([by_id[d] for d in sorted(kept)], docs.schema)
    kept = {r.doc_id for r in ngram_join.ngram_components(step).collect() if r.doc_id == r.component_id}
    step = spark.createDataFrame([by_id[d] for d in sorted(kept)], docs.schema)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = {r.doc_id for r in decontaminate.contamination(step, items).collect() if not r.contaminated}
    step = spark.createDataFrame([by_id[d] for d in sorted(kept)], docs.schema)
    total = {}
    for r in step.collect():
        total[r.source] = total.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    weights = mixing.cycle_weights(sorted(total))
    target = mixing.source_targets(total, weights, 1.5 * sum(total.values()), 2)

    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "shard", "slot", "grown_shard"]
    rows = out.collect()
    assert {r.doc_id for r in rows} <= kept
    taken = Counter()
    for r in rows:
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    longest = max(len(by_id[d].text.split()) for d in kept)
    assert all(abs(taken[s] - t) <= longest for s, t in target.items())
    slots = Counter((r.shard, r.slot) for r in rows)
    assert max(slots.values()) == 1 and all(s < sum(1 for r in rows if r.shard == k) for k, s in slots)
    assert all(r.grown_shard in (r.shard, corpus_pipeline.SHARDS) for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near copies", "decontamination", "mixing", "sharding"]


def test_stages_on_odd_rows(spark, tmp_path, odd_docs, no_docs):
    """Null and repeated ids, odd texts and columns with clashing names: what stays is worked out by hand."""
    import corpus_pipeline

    prose = [f"On day {i} the gardener of house {i * 7} planted tree {i * 13} near gate {i * 17}.\nThen rain {i} fell, and worker {i * 3} left town {i * 5} for good reason {i * 11}." for i in range(1, 9)]
    prose = [f"{p} It was noted in book {i} that all of the plants of this kind grow well in spring, and that nobody has to water them." for i, p in enumerate(prose)]
    rows = [(i, prose[i], "en", "s", None) for i in range(3)]
    rows += [(None, prose[3], None, None, 1), (None, prose[4], "en", "s", 1), (None, prose[4], "en", "s", 1), (1, prose[5], "en", None, 2), (2, prose[2], "en", "s", 3), (9, None, "en", "s", 0), (10, "", None, None, None), (11, prose[6] + " the leaked answer of item five", "en", "s", 1)]
    extra = "shard string, slot int, _tag string, _tie string, row string, carry int, place string, key string, `of` int"
    docs = spark.createDataFrame([(*r, "x", 1, "t", "u", "r", 2, "p", "k", 3) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the leaked answer of item five"), (None, "tree"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for none in (docs.limit(0), no_docs):
            out = stage(spark, none, str(tmp_path))
            assert out.collect() == [] and (name == "sharding" or out.columns == none.columns)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot", "grown_shard"]
    got = out.collect()
    may = {(0, prose[0]), (1, prose[1]), (2, prose[2]), (None, prose[3]), (None, prose[4]), (1, prose[5])}
    assert {(r.doc_id, r.text) for r in got} <= may
    assert all((r._tag, r._tie, r.row, r.carry, r.place, r.key, r["of"]) == ("t", "u", "r", 2, "p", "k", 3) for r in got)
    step = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        step = spark.createDataFrame(stage(spark, step, str(tmp_path)).collect(), docs.schema)
        assert step.columns == docs.columns, name
    assert Counter((r.doc_id, r.text) for r in step.collect()) == Counter(may)
