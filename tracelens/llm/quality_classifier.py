"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions in
time linear in the features of a text, by the sum-of-squares identity, which Spark's FMClassifier uses.
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import BLANK_WORD, materialise, words_of

HASHED = 1 << 13
STRUCTURE = ("s_words", "s_word_length", "s_symbols", "s_upper", "s_digits", "s_dup_lines", "s_distinct", "s_ends", "s_chars")
PREDICT_AT = 0.3


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def with_vectors(docs: DataFrame) -> DataFrame:
    """Adds `features`: distinct words hashed and normalised to length one, then structure statistics, each about 0 to 1.

    Needs text and n_chars (null: the text's own length); null text is empty and gives zeros.
    """
    one = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit(""))).withColumn("_w", words_of(F.col("_t"), BLANK_WORD))
    one = one.withColumn("_d", F.array_distinct("_w")).withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x != ""))
    n, chars = F.greatest(F.size("_w"), F.lit(1)), F.greatest(F.length("_t"), F.lit(1))
    rate = lambda pattern, of: F.least(F.regexp_count("_t", F.lit(pattern)) / of, F.lit(1.0))
    lines = F.greatest(F.size("_l"), F.lit(1))
    two = one.withColumns(
        {
            "s_words": F.least(F.log1p(F.size("_w").cast("double")) / 10, F.lit(2.0)),
            "s_word_length": F.least(chars / n / 20, F.lit(2.0)),
            "s_symbols": rate(r"[#*$%&|<>]", n),
            "s_upper": rate("[A-Z]", chars),
            "s_digits": rate("[0-9]", chars),
            "s_dup_lines": 1 - F.size(F.array_distinct("_l")) / lines,
            "s_distinct": F.size("_d") / n,
            "s_ends": rate(r"[.!?](?=\n|$)", lines),
            "s_chars": F.least(F.log1p(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.length("_t").cast("double")), F.lit(0.0))) / 15, F.lit(2.0)),
        }
    ).drop("_t", "_w", "_l")
    hashed = HashingTF(inputCol="_d", outputCol="_h", numFeatures=HASHED, binary=True).transform(two)
    normal = Normalizer(inputCol="_h", outputCol="_n").transform(hashed)
    assembled = VectorAssembler(inputCols=["_n", *STRUCTURE], outputCol="features").transform(normal)
    return assembled.drop("_d", "_h", "_n", *STRUCTURE)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 20_000, rounds: int = 80, seed: int = 7) -> FMClassificationModel | float:
    """Fits on at most `most` labelled documents, those with the smallest hashes of their ids; held-out ones are never used.

    Without both labels among them there is nothing to fit: their share of label 1 is returned (0.5 if none).
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(known), "doc_id")  # at most `most` rows
    train = materialise(with_vectors(rows).select("features", "label"), "fm")
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(counts) < 2:
        return next(iter(counts), 0.5)
    machine = FMClassifier(featuresCol="features", labelCol="label", factorSize=4, maxIter=rounds, stepSize=0.1, regParam=1e-4, initStd=0.01, seed=seed, solver="adamW")
    return machine.fit(train.coalesce(8))


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; empty and null texts are scored by their structure alone.

    Equal texts get equal scores unless their n_chars differ. Very long texts count whole. Repeated rows are scored one by
    one. Where labels of a document differ, the larger counts; labels other than 0 and 1 don't. A table without n_chars is
    scored by the texts' own lengths. An empty table gives no rows; without labels every score is 0.5. Other columns are
    not read.
    """
    if "n_chars" not in docs.columns:
        docs = docs.withColumn("n_chars", F.lit(None).cast("long"))
    model = fit_quality(docs, labels, **options)
    rows = docs.select("doc_id", "text", "n_chars")
    if isinstance(model, float):
        scored = rows.withColumn("score", F.lit(model))
    else:
        scored = model.transform(with_vectors(rows)).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
