"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed byte n-grams, normalised to length one. Each language is described by several
centroids, found by spherical k-means over its own texts, since one centroid would average short notes with long prose.
A text gets the language of the centroid at the largest cosine; one further from it than nearly all texts that formed
the centroid is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import in_chunks, materialise
from tracelens.llm.hashing import mix

DIMENSIONS, CENTROIDS, ROUNDS = 4096, 4, 12
#: Texts per language that form its centroids; a drawn share of the language, so about as many.
SAMPLE = 1500
#: More languages are refused: the model holds CENTROIDS vectors of each.
MOST_LANGUAGES = 2000
#: Texts and bytes whose counts a task holds at once.
ROWS, BYTES = 256, 1 << 20
#: Share of a centroid's own texts below whose cosine a text is rejected, and the slack given to others.
REJECT_SHARE, REJECT_SLACK = 0.01, 0.7
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def gram_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams around letters, texts x DIMENSIONS. Other characters count as blanks."""
    n = len(bounds) - 1
    out = np.zeros(n * DIMENSIONS, np.int64)
    folded = _FOLD[data]
    row = np.repeat(np.arange(n), np.diff(bounds))
    for width in (2, 3):
        if len(folded) < width:
            continue
        last = len(folded) - width + 1
        code = np.full(last, width, np.uint64)
        for k in range(width):
            code = code << np.uint64(8) | folded[k : k + last].astype(np.uint64)
        whole = (row[:last] == row[width - 1 :]) & (folded[width - 2 : width - 2 + last] != 32)
        slot = (mix(code[whole]) >> np.uint64(52)).astype(np.int64)
        out += np.bincount(row[:last][whole] * DIMENSIONS + slot, minlength=len(out))
    return out.reshape(n, DIMENSIONS)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts).astype(np.float32) * idf
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.maximum(norm, 1e-9)


def has_letter(data: np.ndarray, bounds: np.ndarray) -> list[bool]:
    whole = data.tobytes()
    ascii_letter = np.concatenate([[0], np.cumsum((data | 32) - 97 < 26)])
    sure = ascii_letter[bounds[1:]] > ascii_letter[bounds[:-1]]
    return [s or any(c.isalpha() for c in whole[a:b].decode()) for s, a, b in zip(sure.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def document_counts(docs: DataFrame) -> DataFrame:
    """(slot, n): in how many texts each hashed n-gram stands; each task sums its own texts first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for _, data, bounds in in_chunks(batch, "text", BYTES, ROWS):
                total += (gram_counts(data, bounds) > 0).sum(axis=0)
                texts += len(bounds) - 1
        slots = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(slots, -1), pa.int64()), pa.array(np.append(total[slots], texts), pa.int64())], names=["slot", "n"])

    return docs.select("text").mapInArrow(work, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def _centroids(idf: np.ndarray, seed: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means over a language's sample; starts at texts far from each other."""
        rows = rows.sort_values(["place", "vector"])
        vectors = np.stack([np.frombuffer(v, np.float32) for v in rows["vector"]])
        vectors = vectors[np.abs(vectors).sum(axis=1) > 0]
        if not len(vectors):
            return pd.DataFrame({"lang": [], "centroid": [], "reach": []})
        chosen = [int(np.random.default_rng(seed).integers(len(vectors)))]
        while len(chosen) < min(CENTROIDS, len(vectors)):
            chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(axis=1))))
        centroids = vectors[chosen]
        for _ in range(ROUNDS):
            near = np.argmax(vectors @ centroids.T, axis=1)
            for c in range(len(centroids)):
                if (near == c).any():
                    mean = vectors[near == c].mean(axis=0)
                    centroids[c] = mean / max(float(np.linalg.norm(mean)), 1e-9)
        cosine = vectors @ centroids.T
        near = np.argmax(cosine, axis=1)
        reach = [float(np.quantile(cosine[near == c, c], REJECT_SHARE)) if (near == c).any() else 1.0 for c in range(len(centroids))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [c.astype(np.float32).tobytes() for c in centroids], "reach": reach})

    return fit


def text_vectors(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(lang, place, vector) of docs (lang, place, text): a vector has the same size however long its text is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in in_chunks(batch, "text", BYTES, ROWS):
                vectors = unit_vectors(gram_counts(data, bounds), idf)
                yield pa.record_batch([part.column(0), part.column(1), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["lang", "place", "vector"])

    return docs.select("lang", "place", "text").mapInArrow(work, "lang string, place long, vector binary")


def fit_languages(docs: DataFrame, seed: int = 7) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(idf, language of each centroid, centroids, reach of each). Document counts cover all learning texts; the centroids
    of a language are formed by about SAMPLE distinct texts (all if it has fewer), drawn by a seeded hash of the text; a
    text that is drawn counts once, however often it is repeated, so that about SAMPLE vectors at most go to the task that
    forms a language's centroids. More than MOST_LANGUAGES languages are refused."""
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["slot"]: r["n"] for r in document_counts(known).collect()}  # at most DIMENSIONS + 1 rows
    df = np.zeros(DIMENSIONS)
    for slot, n in counts.items():
        if slot >= 0:
            df[slot] = n
    idf = (np.log((1 + counts.get(-1, 0)) / (1 + df)) + 0.05).astype(np.float32)
    sizes = materialise(known.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "sizes")
    if (languages := sizes.count()) > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages; at most {MOST_LANGUAGES} can be learned")
    drawn = known.join(F.broadcast(sizes), "lang").withColumn("place", F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)))
    drawn = drawn.where(F.col("place") * F.col("size") < F.lit(float(SAMPLE << 30)))
    drawn = drawn.groupBy("lang", "place", F.md5(F.col("text").cast("binary")).alias("tag")).agg(F.first("text").alias("text"))  # one of each task, then of all
    fitted = text_vectors(drawn, idf).groupBy("lang").applyInPandas(_centroids(idf, seed), "lang string, centroid binary, reach double")
    rows = sorted(materialise(fitted, "centroids").collect(), key=lambda r: (r["lang"], r["centroid"]))
    vectors = np.array([np.frombuffer(r["centroid"], np.float32) for r in rows]).reshape(len(rows), DIMENSIONS)
    return idf, [r["lang"] for r in rows], vectors, np.array([r["reach"] for r in rows])


def identify(docs: DataFrame, model: tuple[np.ndarray, list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of docs (doc_id, held_out, text)."""
    idf, langs, centroids, reach = model

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in in_chunks(batch, "text", BYTES, ROWS):
                letters = has_letter(data, bounds)
                if langs:
                    cosine = unit_vectors(gram_counts(data, bounds), idf) @ centroids.T
                    near = np.argmax(cosine, axis=1)
                    score = np.clip(cosine[np.arange(len(near)), near], 0, 1).astype(float)
                    rejected = score < reach[near] * REJECT_SLACK
                else:
                    near, score, rejected = np.zeros(part.num_rows, int), np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                pred = [langs[c] if ok and langs else UNKNOWN for ok, c in zip(letters, near.tolist(), strict=True)]
                score, rejected = np.where(letters, score, 0.0), rejected | ~np.array(letters, bool)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(pred), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine to the nearest centroid), rejected of every document.

    Learns from text and lang of documents that aren't held out. Null text, or one without a letter: `und`, score 0,
    rejected. With nothing to learn from, all are `und`. Equal texts get equal results, repeated rows too, and of
    centroids at the same cosine the first by language; very long texts count whole. An empty table gives no rows; other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang", "text")
    return identify(rows, fit_languages(rows.where(~F.col("held_out")).select("doc_id", "lang", "text")))
