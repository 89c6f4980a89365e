from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.llm import language_id, quality_classifier


def test_languages_of_held_out_documents(spark, no_docs, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify_documents(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in language_id.identify_documents(odd_docs).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[3].lang_pred == "und" and odd[1].score == 0
    assert language_id.identify_documents(no_docs).collect() == []


def test_counts_and_predictions_equal_a_plain_computation(spark, documents):
    def counts(text):
        folded = bytes(c | 32 if chr(c).isalpha() and c < 128 else c if c > 127 else 32 for c in text.encode())
        out = Counter()
        for width in (2, 3):
            for i in range(len(folded) - width + 1):
                if folded[i + width - 2] != 32:
                    x = int.from_bytes(bytes([width]) + folded[i : i + width], "big")
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                        x = ((x ^ (x >> shift)) * factor) % 2**64
                    out[x >> 52] += 1
        return out

    rows = documents.select("doc_id", "lang", "text").where("doc_id % 5 = 0").collect()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = idf, langs, centroids, _ = language_id.fit_languages(docs)
    known = [r for r in rows if r.lang and r.text]
    df = Counter(k for r in known for k in counts(r.text))
    assert all(math.isclose(idf[k], math.log((1 + len(known)) / (1 + df[k])) + 0.05, rel_tol=1e-5) for k in range(language_id.DIMENSIONS))
    got = {r.doc_id: r for r in language_id.identify(docs.withColumn("held_out", F.lit(False)), model).collect()}
    for r in rows:
        vector = np.zeros(language_id.DIMENSIONS)
        for k, n in counts(r.text or "").items():
            vector[k] = math.log(1 + n) * idf[k]
        cosine = centroids @ (vector / max(np.linalg.norm(vector), 1e-9))
        if any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].score == pytest.approx(min(max(cosine.max(), 0), 1), abs=1e-4)
            assert cosine[[i for i, k in enumerate(langs) if k == got[r.doc_id].lang_pred]].max() == pytest.approx(cosine.max(), abs=1e-4)


def test_many_short_texts_stay_small_and_too_many_languages_are_refused(spark, monkeypatch):
    short = spark.range(20_000).selectExpr("id AS doc_id", "concat('ab ', id) AS text", "CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS lang").coalesce(1)
    assert language_id.identify_documents(short).where("score > 1 or score < 0").count() == 0
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language_id.identify_documents(short)


def test_repeated_texts_are_drawn_once(spark, monkeypatch):
    """However often a text that is drawn is repeated, one vector of it goes to the task that forms its language's centroids."""
    monkeypatch.setattr(language_id, "SAMPLE", 50)
    rows = spark.range(60_000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'en' else 'de' end as lang", "case when id < 54000 then concat('text number ', id % 4) else concat('eigener text ', id) end as text").repartition(8)
    seen = []
    made = language_id.text_vectors
    monkeypatch.setattr(language_id, "text_vectors", lambda docs, idf: seen.append(docs.groupBy("lang").count().collect()) or made(docs, idf))
    langs = language_id.fit_languages(rows)[1]
    assert set(langs) == {"de", "en"} and all(r["count"] <= 100 for r in seen[0])


def test_no_letter_is_undetermined_and_unlike_text_is_rejected(spark):
    train = [(i, f"the quick brown fox jumps over the lazy dog number {i}", "en") for i in range(40)] + [(100 + i, f"der schnelle braune fuchs springt über den faulen hund {i}", "de") for i in range(40)]
    odd = [(900, "123 !!", None), (901, "жжж ююю щщщ", None), (902, "é", None), (903, "the quick brown fox jumps over the lazy dog number 77", None)]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify_documents(docs).collect()}
    assert got[900].lang_pred == "und" and got[900].rejected
    assert got[901].rejected and got[902].lang_pred in ("en", "de")
    assert got[903].lang_pred == "en" and not got[903].rejected


def test_quality_scores_rank_held_out_labels(spark, no_docs, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_classifier.score_documents(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, t in held if t == 1], [s for s, t in held if t == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.9
    assert quality_classifier.score_documents(no_docs, labels).collect() == []
    more = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd_docs.select("doc_id", "text", "lang", "source", "n_chars")).withColumns({"_w": F.lit("mine"), "features": F.lit(1), "score": F.lit(9.0)})
    odd = quality_classifier.score_documents(more, labels).collect()
    assert len(odd) == len(rows) + odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert len(quality_classifier.score_documents(odd_docs.drop("n_chars"), labels).collect()) == odd_docs.count()
    assert {r.score for r in quality_classifier.score_documents(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_scores_equal_all_pairwise_interactions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_classifier.fit_quality(docs, labels, rounds=5)
    some = quality_classifier.with_vectors(docs.where("doc_id < 20")).select("doc_id", "features")
    got = {r.doc_id: r.probability[1] for r in model.transform(some).collect()}
    factors, linear = model.factors.toArray(), model.linear.toArray()
    for r in some.collect():
        at, x = r.features.indices, r.features.values
        pairs = sum(factors[i] @ factors[j] * x[a] * x[b] for a, i in enumerate(at) for b, j in enumerate(at) if a < b)
        v = factors[at] * x[:, None]
        assert pairs == pytest.approx(0.5 * ((v.sum(0) ** 2) - (v * v).sum(0)).sum(), abs=1e-9)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(model.intercept + linear[at] @ x + pairs))), abs=1e-9)
