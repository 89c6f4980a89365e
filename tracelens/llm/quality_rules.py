"""Quality rules under weak supervision, in built-in functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns estimates
how often each rule votes each way on good and on bad texts, without labels; the posterior of "good" decides, where
an all-must-pass filter would let one odd rule reject a clean text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import BLANK_WORD, materialise, words_of

REPEAT_WORDS = 5
SYMBOLS = r"[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the rules read; the text is tokenised once and no row leaves its task. Columns of the same names are replaced.

    Repeated windows: hashes of all five-word windows are compared as a set; only where that set is smaller than the
    list are they sorted with their places, and places next to an equal hash are repeated. Work is n log n at worst.
    """
    one = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", words_of(F.col("_t"), BLANK_WORD))
    one = one.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    word = lambda i, k: F.get("_w", i + k)
    hashes = F.transform(F.sequence(F.lit(0), F.size("_w") - REPEAT_WORDS), lambda i: F.xxhash64(*[word(i, k) for k in range(REPEAT_WORDS)]))
    two = one.withColumn("_h", F.when(F.size("_w") >= REPEAT_WORDS, hashes).otherwise(F.array().cast("array<bigint>")))
    two = two.withColumn("_some", F.size(F.array_distinct("_h")) < F.size("_h"))
    placed = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    three = two.withColumn("_s", F.when(F.col("_some"), placed))
    equal = lambda e, k: F.coalesce(F.get("_s", k)["h"] == e["h"], F.lit(False))
    four = three.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda e, k: equal(e, k - 1) | equal(e, k + 1)), lambda e: e["i"])))
    reach = F.transform("_p", lambda p, k: F.least(F.lit(REPEAT_WORDS), F.coalesce(F.get("_p", k + 1) - p, F.lit(REPEAT_WORDS))))
    return four.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(reach, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"),
            "n_symbol_runs": F.regexp_count("_t", F.lit(f"{SYMBOLS}+")).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_upper": F.regexp_count("_t", F.lit("[A-Z]")).cast("long"),
            "n_digits": F.regexp_count("_t", F.lit("[0-9]")).cast("long"),
            "n_ends": F.regexp_count("_t", F.lit(r"[.!?](?=\n|$)")).cast("long"),
        }
    ).drop("_t", "_w", "_l", "_h", "_some", "_s", "_p")


def _vote(bad: Column, good: Column) -> Column:
    return F.coalesce(F.when(bad, -1).when(good, 1), F.lit(0))


def rule_votes() -> dict[str, Column]:
    """The rules over the columns of `with_features`; each leaves a range in which it abstains."""
    n, per_word = F.col("n_words"), lambda c: F.try_divide(F.col(c).cast("double"), F.col("n_words"))
    length = per_word("word_chars")
    upper = F.try_divide(F.col("n_upper").cast("double"), F.col("word_chars"))
    digits = F.try_divide(F.col("n_digits").cast("double"), F.col("word_chars"))
    dups = F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines"))
    ends = F.try_divide(F.col("n_ends").cast("double"), F.col("n_lines"))
    return {
        "vote_length": _vote(n < 15, n >= 40),
        "vote_word_length": _vote((length < 2.5) | (length > 12), (length >= 3) & (length <= 9)),
        "vote_symbols": _vote(per_word("n_symbols") > 0.2, per_word("n_symbols") < 0.02),
        "vote_symbol_runs": _vote(per_word("n_symbol_runs") > 0.15, per_word("n_symbol_runs") < 0.02),
        "vote_dup_lines": _vote(dups > 0.3, (dups == 0) & (F.col("n_lines") >= 2)),
        "vote_repeats": _vote(per_word("n_repeat_words") > 0.2, per_word("n_repeat_words") < 0.02),
        "vote_upper": _vote(upper > 0.4, upper < 0.15),
        "vote_digits": _vote(digits > 0.3, digits < 0.05),
        "vote_ends": _vote((ends < 0.2) & (n >= 40), ends >= 0.5),
    }


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def fit_rules(patterns: list[tuple[tuple[int, ...], int]], rules: int = 0, rounds: int = 50, prior_good: float = 0.8) -> tuple[float, list[dict[int, float]]]:
    """(log odds of good, per rule {vote: log likelihood ratio}) by expectation-maximisation over pattern counts.

    Starts with a bad vote weighing more than a good one, as rules are set to be silent on clean texts. Pseudo-counts
    tie each rule to being right more often than wrong, so that the two classes can't swap; an abstention says nothing.
    """
    k = len(patterns[0][0]) if patterns else rules
    prior_good_odds = math.log(prior_good / (1 - prior_good))
    first = lambda votes: prior_good_odds + 0.3 * votes.count(1) - 10.0 * votes.count(-1)
    post = [_sigmoid(first(votes)) for votes, _ in patterns]
    bias, weights = prior_good_odds, [{-1: -1.0, 0: 0.0, 1: 1.0} for _ in range(k)]
    total = sum(n for _, n in patterns)
    strong = 1 + total * 0.01
    for _ in range(rounds if total else 0):
        good = sum(p * n for p, (_, n) in zip(post, patterns, strict=True))
        share = (good + prior_good * strong) / (total + strong)
        bias = math.log(share / (1 - share))
        weights = []
        for j in range(k):
            seen = {(c, v): 0.0 for c in (0, 1) for v in (-1, 1)}
            for p, (votes, n) in zip(post, patterns, strict=True):
                if votes[j]:
                    seen[1, votes[j]] += p * n
                    seen[0, votes[j]] += (1 - p) * n
            right_good = (seen[1, 1] + 0.9 * strong) / (seen[1, 1] + seen[1, -1] + strong)
            right_bad = (seen[0, -1] + 0.7 * strong) / (seen[0, 1] + seen[0, -1] + strong)
            weights.append({1: math.log(right_good / (1 - right_bad)), 0: 0.0, -1: math.log((1 - right_good) / right_bad)})
        post = [_sigmoid(bias + sum(w[v] for w, v in zip(weights, votes, strict=True))) for votes, _ in patterns]
    return bias, weights


def fit_on(featured: DataFrame, **options) -> tuple[float, list[dict[int, float]]]:
    """Fits the rules on all rows; what reaches the driver is at most 3 ** (number of rules) counts."""
    votes = rule_votes()
    counted = featured.select(*[v.alias(c) for c, v in votes.items()]).groupBy(*votes).count().collect()
    return fit_rules(sorted((tuple(r[c] for c in votes), r["count"]) for r in counted), len(votes), **options)


def posterior_good(model: tuple[float, list[dict[int, float]]]) -> Column:
    """The posterior as a Column: votes add up, as rules are taken as independent given the class."""
    bias, weights = model
    odds = F.lit(bias)
    for vote, weight in zip(rule_votes().values(), weights, strict=True):
        odds = odds + F.when(vote == 1, F.lit(weight[1])).when(vote == -1, F.lit(weight[-1])).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge_documents(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, posterior of every document.

    Null or empty text: no words, so it fails. Equal texts get equal verdicts, and repeated rows are judged one by one. Very
    long texts are judged whole. An empty table gives no rows; a null doc_id stays null; other columns are not read.
    """
    featured = materialise(with_features(docs.select("doc_id", "text")).drop("text"), "quality")
    good = posterior_good(fit_on(featured))
    scored = featured.withColumn("base_failed", base_failed()).withColumn("posterior", good)
    return scored.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= keep_at)).alias("kept"), "posterior")


def keep_good(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """The documents that `judge_documents` keeps, with all their columns.

    Null, empty and blank texts go. Very long texts are judged whole. Repeated rows stay or go together; ids may be null or
    repeated, as each row is judged by its own text. An empty table gives no rows; columns stay whatever their names.

    Rows and features are written once: a filter over unwritten features would be pushed below them, which repeats them.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    featured = materialise(with_features(rows).drop("text"), "kept")
    kept = featured.where(~base_failed() & (posterior_good(fit_on(featured)) >= keep_at))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
