"""Benchmark decontamination as a prefix-filtered set join, in built-in functions only.

Every item is cut into windows of ten consecutive words (a shorter item is one window). The words of a window are
ordered by their count in the whole corpus; as all of them must be present, the rarest one is a necessary prefix of
length one. Document words are joined with these prefix words only. A match fixes where the window would start, so it is
bounded by position (it must begin inside the text) and by length (it must end inside it), and what is left is verified
word by word. Windows that several items share are joined once; the items follow from the windows found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import ALNUM_WORD, ascii_lower, materialise, spare_names, text_tag, words_of

WINDOW = 10
#: Windows, and bytes of their words, that are broadcast. Of a larger benchmark only the distinct prefix words are, up to as
#: many bytes, and the windows meet the words that these let through in a shuffle.
FEW_WINDOWS, FEW_BYTES = 200_000, 64 << 20
#: Documents to drop, by id and hash, that are broadcast, so that no text is shuffled.
FEW_BAD = 200_000
#: Words of a stretch of text where words are shuffled.
STRETCH = 1_000


def _words(text: Column) -> Column:
    return words_of(ascii_lower(text), ALNUM_WORD)


def item_windows(benchmark: DataFrame, length: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (wid, window, n), and (wid, item_id). Items without text or words, or without an id, have none."""
    items = benchmark.where("item_id is not null").select("item_id", _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - length, F.lit(0))
    cut = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, length))).alias("window"))
    cut = materialise(cut.distinct(), "cut")
    windows = cut.select("window").distinct().select(F.monotonically_increasing_id().alias("wid"), "window", F.size("window").alias("n"))
    windows = materialise(windows, "windows")  # written, so that an id means one window from here on
    return windows, cut.join(windows, "window").select("wid", "item_id")


def size_of(windows: DataFrame) -> tuple[int, int]:
    """(number, bytes of words) of windows."""
    row = windows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("window", F.lit(0), lambda s, w: s + F.octet_length(w) + 8)).alias("b")).first()
    return row["n"], row["b"] or 0


def with_prefix(windows: DataFrame, docs: DataFrame, small: bool) -> DataFrame:
    """Adds `prefix`, the window's rarest word in the corpus, and `offset`, its place. Windows with a word that the corpus lacks go."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    tokens = docs.select(F.explode(_words(F.col("text"))).alias("word"))
    if small:
        counts = tokens.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").count()
    else:
        counts = tokens.groupBy("word").count().join(vocabulary, "word", "left_semi")
    placed = windows.select("wid", "window", "n", F.posexplode("window").alias("offset", "word"))
    counted = placed.join(F.broadcast(counts) if small else counts, "word")  # at most one row for each word of the windows
    best = counted.groupBy("wid").agg(F.count(F.lit(1)).alias("seen"), F.first("n").alias("n"), F.first("window").alias("window"), F.min(F.struct("count", "word", "offset")).alias("best"))
    return best.where("seen = n").select("wid", "window", "n", F.col("best.word").alias("prefix"), F.col("best.offset").alias("offset"))


def _with_neighbours(words: DataFrame, keep: list[str], length: int) -> DataFrame:
    """(keep..., n_words, pos, word, w): each word with those that windows through it can reach, a row of nulls for no words.

    A text is cut into stretches that overlap by as much first, so that no row holds more than a text, and none that is
    shuffled more than 2 * length - 1 words.
    """
    stretch = lambda k: F.struct((k * STRETCH).alias("base"), F.slice("w", F.greatest(k * STRETCH - length + 1, F.lit(0)) + 1, STRETCH + 2 * length).alias("s"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.col("n_words") - 1) / STRETCH).cast("int")), stretch)
    rows = words.select(*keep, "n_words", F.explode_outer(F.when(F.col("n_words") > 0, cuts)).alias("c")).select(*keep, "n_words", "c.*")
    ahead = F.least(F.col("base"), F.lit(length - 1))
    place = lambda i: F.struct((F.col("base") + i).alias("pos"), F.element_at("s", ahead + i + 1).alias("word"), F.slice("s", F.greatest(ahead + i - length + 1, F.lit(0)) + 1, 2 * length - 1).alias("w"))
    inside = F.sequence(F.lit(0), (F.least(F.lit(STRETCH), F.col("n_words") - F.col("base")) - 1).cast("int"))
    return rows.select(*keep, "n_words", F.explode_outer(F.when(F.col("base").isNotNull(), F.transform(inside, place))).alias("p")).select(*keep, "n_words", "p.*")


def window_hits(docs: DataFrame, windows: DataFrame, keep: list[str], every: bool, small: bool, length: int) -> DataFrame:
    """(keep..., n_words, start, n, wid): the verified places; with `every`, also a row of nulls for each document.

    If the windows are small enough to broadcast, words, prefix join and verification are one stage and no word is moved.
    Else only prefix words are, and what they let through moves on with the words around it; if these are too many as well,
    every word is shuffled with those around it. Docs are read once.
    """
    words = docs.select(*keep, _words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    each = words.select(*keep, "w", "n_words", F.posexplode_outer("w").alias("pos", "word"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    begin = F.greatest(F.col("pos") - length + 1, F.lit(0))  # no window that holds the word begins before
    if small:
        windows, placed = F.broadcast(windows), each.withColumn("at", F.lit(0))
    else:
        prefixes = windows.select(F.col("prefix").alias("word"), F.lit(True).alias("hit")).distinct()
        if prefixes.agg(F.coalesce(F.sum(F.octet_length("word") + 8), F.lit(0)).alias("b")).first()["b"] <= FEW_BYTES:
            found = each.join(F.broadcast(prefixes), "word", "left").where(F.col("hit") | (F.lit(every) & first))
            found = found.withColumn("w", F.when(F.col("hit"), F.slice("w", begin + 1, 2 * length - 1)))
        else:
            found = _with_neighbours(words, keep, length).join(prefixes, "word", "left").where(F.col("hit") | (F.lit(every) & first))
        placed = found.withColumn("word", F.when(F.col("hit"), F.col("word"))).withColumn("at", begin)
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    inside = F.greatest(start - F.col("at"), F.lit(0)) + 1
    same = F.when(fits, F.slice("w", inside, F.col("n")) == F.col("window")).otherwise(False)
    joined = placed.join(windows, (F.col("word") == F.col("prefix")) & same, "left")
    rows = joined.where(F.col("prefix").isNotNull() | (F.lit(every) & first))
    return rows.select(*keep, "n_words", start.alias("start"), "n", "wid")


def find_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], every: bool = True, length: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """All places where a window occurs, see `window_hits`, and the items (wid, item_id) of the windows."""
    windows, items = item_windows(benchmark, length)
    count, size = size_of(windows)
    small = count <= FEW_WINDOWS and size <= FEW_BYTES
    ready = materialise(with_prefix(windows, docs, small), "prefixes")
    return window_hits(docs, ready, keep, every, small, length), items


def hit_words(places: Column) -> Column:
    """Words under the union of (start, n) places, sorted by start."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["n"]
        fresh = F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["total"] + fresh).alias("total"))

    return F.aggregate(places, begin, step, lambda acc: acc["total"])


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Which items a set of windows belongs to is worked out once for each distinct set, not for each document. Null or empty
    text: no words, not contaminated. Repeated rows are judged one by one, null doc_ids too. Very long texts count whole.
    Items without words, or without an id, hit nothing; items that repeat count once by id. Empty tables give no rows, or no
    hits. Other columns are not read.
    """
    numbered = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    hits, items = find_hits(numbered, benchmark, ["doc_id", "_row"], length=length)
    place = F.when(F.col("wid").isNotNull(), F.struct("start", "n"))
    summed = hits.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(place)).alias("places"),
        F.sort_array(F.collect_set("wid")).alias("wids"),
    )
    summed = materialise(summed, "found")
    sets = summed.where(F.size("wids") > 0).select("wids").distinct()
    named = sets.select("wids", F.explode("wids").alias("wid")).join(items, "wid").groupBy("wids")
    named = named.agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    digests = named.select("wids", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    n_hit = F.when(F.size("places") > 0, hit_words(F.col("places"))).otherwise(F.lit(0).cast("long"))
    clean = summed.where(F.size("wids") == 0).withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
    rows = summed.where(F.size("wids") > 0).join(digests, "wids").unionByName(clean)
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        "n_items",
        "items_sha256",
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with all their columns, whatever their names.

    A document is known by doc_id and a hash of its text: equal texts share their verdict. Null and empty texts stay; so
    do all documents if the benchmark is empty. Repeated rows stay or go together; very long texts are searched whole. An
    empty table gives no rows.
    """
    tagged = docs.select("text", F.col("doc_id").alias("_id"), text_tag().alias("_tag"))
    bad = materialise(find_hits(tagged, benchmark, ["_id", "_tag"], every=False, length=length)[0].select("_id", "_tag").distinct(), "bad")
    bad = F.broadcast(bad) if bad.count() <= FEW_BAD else bad
    (own,) = spare_names(docs, "own")
    marked = docs.withColumn(own, text_tag())
    return marked.join(bad, marked["doc_id"].eqNullSafe(bad["_id"]) & (marked[own] == bad["_tag"]), "left_anti").select(*docs.columns)
