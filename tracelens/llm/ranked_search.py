"""Ranked lexical search: range-maximum sparse tables over posting lists bound intervals of documents.

The index is a table of blocks: a block is some megabytes of text, cut by documents in the task that reads them, and has a
row (block, term, docs, tfs) for each of its terms and one row for its documents with their ids and lengths. A frequent
term has a row in each block, so no list is longer than a block. Corpus statistics are sums over these rows.

A search ships each block's lists of the query's terms to one task. There every list gets the impact of each posting, and a
sparse table gives the greatest impact within any stretch of it. Intervals of documents are taken best first: the sum of
the terms' greatest weighted impacts bounds all scores in an interval. The document of the greatest single term is scored
and splits the interval in two; intervals with few postings are scored whole. What is bounded below the k-th best score
found so far, in this block or in those before it in the task, is never opened. Bounds hold for every document, so the
result is exact, but for terms, which are told apart within a block by 64 bits of hash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import ALNUM_WORD, ascii_lower, in_chunks, materialise, words_of
from tracelens.llm.hashing import prefix_hash, span_hash, word_spans

#: Bytes of text in one block.
BLOCK_BYTES = 4 << 20
#: Bytes of queries' terms that are searched in one pass over the index.
QUERY_BYTES = 4 << 20
#: Intervals with no more postings than this are scored whole.
LEAF_POSTINGS = 2_048
#: Bytes of postings of a search that one partition is dealt.
PARTITION_BYTES = 8 << 20
#: Stands for a null id; greater than all others.
NULL_ID = 1 << 63
INDEX = "block long, term string, docs binary, tfs binary, ids array<long>, lengths array<long>"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _block_rows(block: int, ids: pa.Array, data: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """The rows of one block: its documents in the order of their ids (null last), its terms with places and counts."""
    low = _LOWER[data]
    starts, ends = word_spans(_INSIDE[data], bounds)
    keys = [NULL_ID if x is None else x for x in ids.to_pylist()]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc = place[np.searchsorted(bounds, starts, side="right") - 1]
    lengths = np.bincount(doc, minlength=len(order))
    terms, first, term = np.unique(span_hash(prefix_hash(low), starts, ends), return_index=True, return_inverse=True)
    pair, tf = np.unique(term * len(order) + doc, return_counts=True)
    term, doc = np.divmod(pair, max(len(order), 1))
    cut = np.searchsorted(term, np.arange(len(terms) + 1))
    packed = low.tobytes()
    docs, tfs = doc.astype("<u4").tobytes(), tf.astype("<u4").tobytes()
    pieces = lambda x: [None, *[x[4 * a : 4 * b] for a, b in zip(cut[:-1], cut[1:], strict=True)]]
    words = [None, *[packed[starts[i] : ends[i]].decode("utf-8", "replace") for i in first]]
    rest, n = [None] * len(terms), len(words)
    columns = [pa.array([block] * n, pa.int64()), pa.array(words, pa.string()), pa.array(pieces(docs), pa.binary()), pa.array(pieces(tfs), pa.binary())]
    columns += [pa.array([ids.take(pa.array(order)).to_pylist(), *rest], pa.list_(pa.int64())), pa.array([lengths.tolist(), *rest], pa.list_(pa.int64()))]
    return pa.record_batch(columns, names=["block", "term", "docs", "tfs", "ids", "lengths"])


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes the index of all rows, a table in the shared folder: (block, term, docs, tfs), and a row with ids and lengths for each block.

    Null and empty texts are documents without terms. Rows with null or repeated ids are documents of their own. A very long
    text is a block by itself. An empty table gives an empty index. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, data, bounds in in_chunks(batch, "text", block_bytes):
                yield _block_rows(block, part.column(0), data, bounds)
                block += 1

    return materialise(docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(work, INDEX), "postings")


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all terms with repeats."""
    has = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + (n > 0).cast("long"))
    row = index.where("lengths is not null").agg(F.sum(has), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    return int(row[0] or 0), int(row[1] or 0)


class Block:
    """The lists of one block, end to end, with a sparse table of the places of their greatest impacts."""

    def __init__(self, ids: list[int], terms: list[str], docs: list[np.ndarray], impacts: list[np.ndarray]) -> None:
        sizes = np.array([len(d) for d in docs], np.int64)
        self.ids, self.slot = ids, {t: i for i, t in enumerate(terms)}
        self.cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.docs = np.concatenate([np.zeros(0, np.int32), *docs])
        self.impact = np.concatenate([np.zeros(0, np.int32), *impacts])
        self.keys = np.repeat(np.arange(len(sizes)), sizes) * len(ids) + self.docs
        levels = [np.arange(len(self.docs), dtype=np.int32)]
        for k in range(int(sizes.max(initial=1)).bit_length() - 1):
            later = levels[-1][1 << k :]
            levels.append(self._greater(levels[-1][: len(later)], later))
        self.table = np.concatenate(levels)
        self.level = np.concatenate([[0], np.cumsum([len(x) for x in levels])[:-1]])

    def _greater(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self.impact[b] > self.impact[a], b, a)

    def greatest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each stretch [lo, hi) of a list, not empty, the place of its greatest impact: two looks into the table."""
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        return self._greater(self.table[self.level[k] + lo], self.table[self.level[k] + hi - (1 << k)])


class Best:
    """The k best (score, id) of a query so far; equal scores go by id."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []

    def least(self) -> int:
        """A score below this can't enter."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, key: int) -> None:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -key))
        else:
            heapq.heappushpop(self.heap, (score, -key))


def search_block(block: Block, slots: np.ndarray, weights: np.ndarray, best: Best, leaf: int = LEAF_POSTINGS) -> int:
    """Adds the block's best documents for one query, whose terms have these lists and weights; returns how many documents were scored."""
    scored, number, heap = 0, count(), []

    def push(slots: np.ndarray, weights: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        some = hi > lo
        if some.any():
            slots, weights, lo, hi = slots[some], weights[some], lo[some], hi[some]
            at = block.greatest(lo, hi)
            most = weights * block.impact[at]
            if (bound := int(most.sum())) >= best.least():
                heapq.heappush(heap, (-bound, next(number), slots, weights, lo, hi, int(block.docs[at[most.argmax()]])))

    push(slots, weights, block.cut[slots], block.cut[slots + 1])
    while heap and -heap[0][0] >= best.least():
        _, _, slots, weights, lo, hi, doc = heapq.heappop(heap)
        sizes = hi - lo
        if int(sizes.sum()) <= leaf:
            places = np.arange(sizes.sum()) + np.repeat(lo - np.cumsum(sizes) + sizes, sizes)
            docs, of = np.unique(block.docs[places], return_inverse=True)
            scores = np.zeros(len(docs), np.int64)
            np.add.at(scores, of, np.repeat(weights, sizes) * block.impact[places])
        else:
            at = np.clip(np.searchsorted(block.keys, slots * len(block.ids) + doc), lo, hi)
            has = (at < hi) & (block.docs[np.minimum(at, len(block.docs) - 1)] == doc)
            docs, scores = np.array([doc]), np.array([(weights[has] * block.impact[at[has]]).sum()])
            push(slots, weights, lo, at)
            push(slots, weights, at + has, hi)
        scored += len(docs)
        for i in np.flatnonzero(scores >= best.least()):
            best.add(int(scores[i]), block.ids[docs[i]])
    return scored


def _search_chunk(index: DataFrame, terms: DataFrame, n: int, total: int, k: int, leaf: int) -> DataFrame:
    """(query, doc, score): of each partition of blocks the k best of each query; `terms` fit into QUERY_BYTES."""
    wanted = terms.select("term").distinct()
    dealt = index.where("term is null").unionByName(index.join(F.broadcast(wanted), "term").select(index.columns))
    dealt = materialise(dealt, "lists")
    held = {r["term"]: r["df"] for r in dealt.where("term is not null").groupBy("term").agg(F.sum(F.octet_length("docs") / 4).cast("long").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in held.items()}
    queries: dict[int, list[tuple[str, int]]] = {}
    for r in terms.collect():
        if weight.get(r["term"], 0) > 0:
            queries.setdefault(r["query"], []).append((r["term"], r["times"] * weight[r["term"]]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q: Best(k) for q in queries}
        block, ids, m, lists = None, [], None, []

        def done() -> None:
            if lists:
                made = Block(ids, *zip(*lists, strict=True))
                for q, wanted in queries.items():
                    if here := [(made.slot[t], w) for t, w in wanted if t in made.slot]:
                        search_block(made, *np.array(here, np.int64).T, best[q], leaf)
                lists.clear()

        for batch in batches:
            for of, term, docs, tfs, keys, lengths in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if of != block:
                    done()
                    block = of
                if term is None:
                    ids = [NULL_ID if x is None else x for x in keys]
                    m = np.array([100 - 75 + 75 * x * n // total for x in lengths], np.int64)
                else:
                    docs, tf = np.frombuffer(docs, "<u4").astype(np.int32), np.frombuffer(tfs, "<u4").astype(np.int64)
                    lists.append((term, docs, (1_000_000_000 * tf // (1000 * tf + 8 * m[docs])).astype(np.int32)))
        done()
        rows = [(q, None if -key == NULL_ID else -key, score) for q, b in best.items() for score, key in b.heap]
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query", "doc", "score"])

    size = dealt.agg(F.sum(2 * F.octet_length("docs"))).first()[0] or 0
    parts = max(math.ceil(size / PARTITION_BYTES), 1)
    return dealt.repartition(parts, "block").sortWithinPartitions("block", "term").mapInArrow(work, "query long, doc long, score long")


def search(index: DataFrame, items: DataFrame, k: int = 10, *, key: str = "item_id", text: str = "text", query_bytes: int = QUERY_BYTES, leaf: int = LEAF_POSTINGS) -> DataFrame:
    """(item, rank, doc, score): the k best documents with a score above 0 of each row of `items`, equal scores by ascending id, null last.

    Each row is a query of its own, even if its key is null or repeated; a row without terms, or with none that the corpus
    has, gives no rows. Queries beyond `query_bytes` are searched in several passes. An empty index or item table gives none.
    """
    n, total = corpus_size(index)
    rows = materialise(items.select(F.col(key).alias("item"), words_of(ascii_lower(F.col(text)), ALNUM_WORD).alias("words")).withColumn("query", F.monotonically_increasing_id()), "queries")
    terms = materialise(rows.select("query", F.explode("words").alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times")), "terms")
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    passes = max(1, math.ceil(2 * size / query_bytes)) if size > query_bytes else 1
    made = [_search_chunk(index, terms.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == i), n, total, k, leaf) for i in range(passes)]
    if passes > 1:
        made = [materialise(m, "best") for m in made]
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = reduce(DataFrame.unionByName, made).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(rows.select("query", "item"), "query").select("item", "rank", "doc", "score")


def rank_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best documents of each item; the cases of `build_index` and `search` hold."""
    found = search(build_index(docs), items)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
