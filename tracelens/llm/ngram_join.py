"""N-gram Jaccard join with a token-group matrix; exact up to 64-bit hashes of words, shingles and sets.

1. A text becomes the set of its shingles, of as many words as the rule says; equal sets become one.
2. Sets that may link are partitioned into groups of similar ones. Two sets at Jaccard t differ in at most
   (n + m) (1 - t) / (1 + t) shingles; if hash space is cut into one part more, at least one part is the same in both.
   Sets that agree on a part meet there, at the part's smallest set, and whatever is connected so is one group. At 0.9 a
   part holds about nine shingles, so unlike sets don't meet, however common their words, lines or passages are. At 0.8 it
   holds half as many, and parts of one or none are frequent; so some are spare: with e parts more, e + 1 parts are the
   same, and a set with at most e such weak parts leaves them out. Unlike sets that still meet are told apart by sketches:
   the parities of their shingles in up to `BITS` cells differ in no more cells than the sets do in shingles. Parts with one
   smallest set are told apart by one task, as like sets have many in common; it passes on a link from each set at most.
3. Each group is taken up by one task, a large one in blocks (`tracelens.llm.spans`). There the sets are ordered by
   likeness and cut into small groups of which a matrix holds the token unions. A query's overlap with a group's union
   bounds its overlap with each member; only qualifying groups are opened and counted. Queries look only for sets not yet
   connected to them, so a family of near copies costs no pairs.
4. Links that span each task's classes are joined into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import BLANK_WORD, in_chunks, materialise, spare_names, text_tag
from tracelens.llm.components import connected_components
from tracelens.llm.hashing import mix, prefix_hash, span_hash, word_spans
from tracelens.llm.spans import Room, spanning_links


@dataclass(frozen=True)
class Rule:
    """Sets of `width`-word shingles link at a Jaccard of `percent` / 100; one part in `spare` is spare, none if 0."""

    width: int
    percent: int
    spare: int = 0

    def differ(self, sizes: int) -> int:
        """The most shingles by which linked sets with `sizes` shingles in all differ."""
        return sizes * (100 - self.percent) // (100 + self.percent)


#: The contract of op5, and the rule of near-copy stages.
OP5, STAGE = Rule(3, 90), Rule(5, 80, 8)
#: What one task holds of a group of sets, and members of a group in the token-group matrix.
TOKEN_ROOM, MEMBERS = Room(128, 4 << 20), 32
#: Cells of a sketch, rows of meeting sets in one task, of these such as have one smallest set, sets of a part that are compared each with each at
#: once, and pairs that are held for that.
BITS, MET_ROWS, LOW_ROWS, FEW, PAIRS = 4096, 50_000, 12_500, 256, 500_000
#: What one task holds of the sets that meet in one part.
PART_ROOM = Room(5_000, 4 << 20)
#: Sets remembered by a task, parts packed or matched at once, shingles for which one bucket of parts is made, the most buckets and partitions; beyond
#: these they grow.
HELD_SETS, HELD_PARTS, BUCKET_SHINGLES, MOST_BUCKETS, MOST_PARTITIONS = 500_000, 500_000, 1_000_000, 1 << 21, 50_000
#: Bytes of text whose words are hashed at once, some fifty times as many in work arrays.
CHUNK = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
_ONE, _TWO, _THREE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = OP5.width) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than `width` words: one shingle of all; none: empty."""
    start, end = word_spans(~_BLANK[data], bounds)
    words = span_hash(prefix_hash(_TO_LOWER[data]), start, end)
    cut = np.searchsorted(start, bounds)
    whole = mix(words * _ONE)
    for k in range(1, width):
        whole = mix(whole[:-1] + words[k:] * (_TWO if k % 2 else _THREE))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(whole[a : b - width + 1])
        elif b > a:
            yield mix(mix(np.cumsum(words[a:b] * _ONE)[-1:] + words[a : a + 1] * _TWO) + np.uint64(b - a))
        else:
            yield words[:0]


def fingerprint(tokens: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(mix(mix(tokens).sum(keepdims=True) + np.uint64(len(tokens)))[0].astype(np.int64)) if len(tokens) else 0


def size_classes(most: int, rule: Rule = OP5) -> np.ndarray:
    """Where size classes begin; sizes within a factor of the rule's Jaccard are in the same class or in neighbours."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * 100 // rule.percent + 1)
    return np.array([*starts, starts[-1] * 100 // rule.percent + 1, 2 * starts[-1] * 100 // rule.percent], np.int64)


@lru_cache(4096)
def _edges(parts: int) -> np.ndarray:
    """Where hash space is cut into equal parts."""
    return np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)


def part_hashes(tokens: np.ndarray, classes: np.ndarray, rule: Rule = OP5) -> np.ndarray:
    """A hash for each part of hash space, cut as the set's own size class and the one below it ask.

    Linked sets have one part more than the spare ones in common; so parts of under two shingles go if no more are spare.
    """
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ _TWO))])
    own = int(np.searchsorted(classes, len(tokens), side="right")) - 1
    out = []
    for c in (own, own - 1):
        if c >= 0:
            apart = rule.differ(int(classes[c + 1]) - 1 + int(classes[c + 2]) - 1)
            spare = apart // rule.spare if rule.spare else 0
            parts = apart + spare + 1
            cut = np.concatenate([[0], np.searchsorted(tokens, _edges(parts)), [len(tokens)]])
            hashes = mix(mix(upto[cut[1:]] - upto[cut[:-1]] + np.array([c], np.uint64) * _THREE) + np.arange(parts, dtype=np.uint64) * _ONE)
            strong = np.diff(cut) > 1
            out.append(hashes[strong] if parts - np.count_nonzero(strong) <= spare else hashes)
    return np.concatenate(out)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The parity of the tokens in each of 2^k cells, as uint64 words: one cell a token or more, from 64 up to BITS."""
    bits = min(BITS, max(64, 1 << (len(tokens) - 1).bit_length()))
    odd = np.bincount((mix(tokens ^ _THREE) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def set_table(docs: DataFrame, rule: Rule = OP5) -> DataFrame:
    """(doc_id, tag, n, fp) of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in in_chunks(batch, "text", CHUNK):
                sets = [(len(s), fingerprint(s)) for s in shingle_sets(data, bounds, rule.width)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array([n for n, _ in sets], pa.int64()), pa.array([f for _, f in sets], pa.int64())], names=["doc_id", "tag", "n", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_tag().alias("tag"), "text").mapInArrow(work, "doc_id long, tag long, n long, fp long")


def part_packs(docs: DataFrame, rule: Rule, buckets: int) -> DataFrame:
    """(bucket, parts, sets, at): parts of sets, packed by bucket of the part; a set seen before in the same task is left out.

    `parts` has the low 40 bits of each part in order, byte plane after byte plane, `at` its set among the 64-bit `sets`.
    """

    def packed(parts: list[np.ndarray], fps: list[np.ndarray]) -> pa.RecordBatch:
        flat, owner = np.concatenate(parts), np.concatenate(fps)
        bucket = ((flat >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
        low = flat & np.uint64((1 << 40) - 1)
        order = np.lexsort((low, bucket))
        bucket, low, owner = bucket[order], low[order], owner[order]
        cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        rows = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            sets, at = np.unique(owner[a:b], return_inverse=True)
            rows.append((low[a:b].view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes(), sets.tobytes(), at.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()))
        columns = [pa.array(bucket[cut[:-1]]), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(3)]]
        return pa.record_batch(columns, names=["bucket", "parts", "sets", "at"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, classes = set(), size_classes(1 << 24, rule)
        parts, fps, held = [], [], 0
        for batch in batches:
            for _, data, bounds in in_chunks(batch, "text", CHUNK):
                for s in shingle_sets(data, bounds, rule.width):
                    if len(s) and (fp := fingerprint(s)) not in seen:
                        if len(seen) >= HELD_SETS:  # sets sent twice do no harm
                            seen.clear()
                        seen.add(fp)
                        if len(s) >= classes[-3]:
                            classes = size_classes(2 * len(s), rule)
                        parts.append(part_hashes(s, classes, rule))
                        fps.append(np.full(len(parts[-1]), fp, np.int64))
                        held += len(parts[-1])
                        if held > max(HELD_PARTS, 2 * buckets):
                            yield packed(parts, fps)
                            parts, fps, held = [], [], 0
        if held:
            yield packed(parts, fps)

    return docs.select("text").mapInArrow(work, "bucket long, parts binary, sets binary, at binary")


def _settled(bucket: int, parts: np.ndarray, fps: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """(part, fp) of parts with several sets, and one entry of each part."""
    order = np.lexsort((fps, parts))
    parts, fps = parts[order], fps[order]
    head = np.ones(len(parts), bool)
    head[1:] = parts[1:] != parts[:-1]
    fresh = head.copy()
    fresh[1:] |= fps[1:] != fps[:-1]
    group = np.cumsum(head) - 1
    shared = fresh & (np.bincount(group, weights=fresh) > 1)[group]
    named = (np.uint64(bucket) << np.uint64(40) | parts[shared]).view(np.int64)
    return pa.record_batch([pa.array(named), pa.array(fps[shared])], names=["part", "fp"]), parts[head], fps[head]


def _shared_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, whose rows follow each other, the parts that several sets have; what is held is about one entry a part."""
    bucket, parts, fps, held, most = -1, [], [], 0, HELD_PARTS
    for batch in batches:
        for of, low, sets, at in zip(batch.column(0).to_pylist(), *[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
            if of != bucket:
                if held:
                    yield _settled(bucket, np.concatenate(parts), np.concatenate(fps))[0]
                bucket, parts, fps, held, most = of, [], [], 0, HELD_PARTS
            n = len(low) // 5
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = np.frombuffer(low, np.uint8).reshape(5, n).T
            parts.append(wide.view(np.uint64).ravel())
            index = np.ascontiguousarray(np.frombuffer(at, np.uint8).reshape(4, n).T).view(np.uint32).ravel()
            fps.append(np.frombuffer(sets, np.int64)[index])
            held += n
            if held > most:
                out, kept, owner = _settled(bucket, np.concatenate(parts), np.concatenate(fps))
                yield out
                parts, fps, held, most = [kept], [owner], len(kept), max(HELD_PARTS, 2 * len(kept))
    if held:
        yield _settled(bucket, np.concatenate(parts), np.concatenate(fps))[0]


def meeting_sets(docs: DataFrame, rule: Rule, shingles: int) -> DataFrame:
    """(part, fp): the sets that have a part in common with others; `shingles`, of all sets, tells how many buckets to make.

    A part is known by its bucket and 40 bits; others that fall together with it only make sets meet for nothing.
    """
    buckets = min(1 + shingles // BUCKET_SHINGLES, MOST_BUCKETS)
    dealt = part_packs(docs, rule, buckets).repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")
    return materialise(dealt.mapInArrow(_shared_parts, "part long, fp long").distinct(), "met")


def sketch_table(docs: DataFrame, rule: Rule) -> DataFrame:
    """(fp, n, sketch) of every set with shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in in_chunks(batch, "text", CHUNK):
                sets = [s for s in shingle_sets(data, bounds, rule.width) if len(s)]
                columns = [[fingerprint(s) for s in sets], [len(s) for s in sets], [sketch(s).tobytes() for s in sets]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["fp", "n", "sketch"])

    return docs.select("text").mapInArrow(work, "fp long, n long, sketch binary").dropDuplicates(["fp"])


def _may_link(sketches: dict[int, np.ndarray], bits: np.ndarray, row: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether sets a and b (indexes of equal shape) may link by their sizes and sketches; the longer sketch is folded."""
    out = 100 * np.minimum(n[a], n[b]) >= rule.percent * np.maximum(n[a], n[b])
    for width in np.unique(np.minimum(bits[a], bits[b])):
        at = np.flatnonzero(out & (np.minimum(bits[a], bits[b]) == width))
        for cut in range(0, len(at), 1 << 16):
            some = at[cut : cut + (1 << 16)]
            ends = []
            for side in (a[some], b[some]):
                words = np.empty((len(side), width), np.uint64)
                for w in np.unique(bits[side]):
                    mine = bits[side] == w
                    words[mine] = np.bitwise_xor.reduce(sketches[int(w)][row[side[mine]]].reshape(-1, w // width, width), axis=1)
                ends.append(words)
            apart = np.bitwise_count(ends[0] ^ ends[1]).sum(axis=1, dtype=np.int64)
            out[some] = apart * (100 + rule.percent) <= (n[a[some]] + n[b[some]]) * (100 - rule.percent)
    return out


class _Sketches:
    """The sketches of some rows (fp, n, sketch), by width."""

    def __init__(self, rows: pd.DataFrame, rule: Rule) -> None:
        self.rule, self.n = rule, rows["n"].to_numpy()
        self.bits = rows["sketch"].str.len().to_numpy() // 8
        self.row, self.sketches = np.zeros(len(rows), np.int64), {}
        for w in np.unique(self.bits):
            mine = np.flatnonzero(self.bits == w)
            self.row[mine] = np.arange(len(mine))
            self.sketches[int(w)] = np.frombuffer(b"".join(rows["sketch"].iloc[mine]), np.uint64).reshape(-1, w)

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _may_link(self.sketches, self.bits, self.row, self.n, a, b, self.rule)


def likely_links(rows: pd.DataFrame, rule: Rule, sets: pd.DataFrame | None = None) -> pd.DataFrame:
    """(a, b) from each set to the smallest of its class: sets that meet in a part of `rows` (part, fp) and may link, and whatever these connect.

    `sets` has (fp, n, sketch) of each set; without it `rows` has them besides.
    """
    once = (rows if sets is None else sets).drop_duplicates("fp").sort_values("fp")
    fps, known = once["fp"].to_numpy(), _Sketches(once, rule)
    part, ids = rows["part"].to_numpy(), np.searchsorted(fps, rows["fp"].to_numpy())
    order = np.lexsort((ids, part))
    part, ids = part[order], ids[order]
    head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    size = np.diff(np.concatenate([head, [len(part)]]))
    label = _joined(known, np.arange(len(fps)), np.repeat(ids[head], size), ids)
    for a, b in _pairs(head, size):  # sets that aren't connected by way of a part's first
        label = _joined(known, label, ids[a], ids[b])
    for h, k in zip(head[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        mine = ids[h : h + k]
        label = _merged(label, mine, mine[_likely_classes(known, mine, label[mine])])
    apart = label != np.arange(len(fps))
    return pd.DataFrame({"a": fps[apart], "b": fps[label[apart]]})


def _pairs(head: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs in each run of up to FEW from `head` on, but for those with its first; PAIRS of them at once, or a run's more."""
    firsts, seconds, held = [], [], 0
    for k in np.unique(size[(size > 2) & (size <= FEW)]):
        i, j = np.triu_indices(k - 1, 1)
        begin, step = head[size == k][:, None] + 1, max(1, PAIRS // len(i))
        for cut in range(0, len(begin), step):
            firsts.append((begin[cut : cut + step] + i).ravel())
            seconds.append((begin[cut : cut + step] + j).ravel())
            held += len(firsts[-1])
            if held >= PAIRS:
                yield np.concatenate(firsts), np.concatenate(seconds)
                firsts, seconds, held = [], [], 0
    if held:
        yield np.concatenate(firsts), np.concatenate(seconds)


def _joined(known: _Sketches, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`label` with the classes of sets a and b merged where these may link; sets of one class aren't compared."""
    apart = label[a] != label[b]
    pairs = np.unique(a[apart] * len(label) + b[apart])
    a, b = pairs // len(label), pairs % len(label)
    good = known.may_link(a, b)
    return _merged(label, a[good], b[good])


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`label`, the smallest member of each one's class, with the classes of a and b merged."""
    label = label.copy()
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
    return label


def _likely_classes(known: _Sketches, ids: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """For each of `ids` the place of its class's first: sets that may link, those of equal `classes`, and whatever these connect."""
    label, free = np.full(len(ids), -1), np.arange(len(ids))
    members = _members(classes)
    while len(free):
        seed = free[0]
        todo = members[classes[seed]].tolist()
        label[todo] = seed
        free = free[label[free] < 0]
        while todo and len(free):
            good = known.may_link(np.full(len(free), ids[todo.pop()]), ids[free])
            for c in np.unique(classes[free[good]]):
                label[members[c]] = seed
                todo += members[c].tolist()
            free = free[label[free] < 0]
    return label


def _members(classes: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(classes, kind="stable")
    names, first = np.unique(classes[order], return_index=True)
    return dict(zip(names.tolist(), np.split(order, first[1:]), strict=True))


def part_buckets(parts: DataFrame, buckets: int) -> DataFrame:
    """(part, bucket) of `parts` (part, k, low), k the sets of a part and low the smallest.

    Those with one smallest set go to one bucket, so that sets which meet in many parts aren't linked anew in many buckets;
    beyond LOW_ROWS they are dealt over several. A smallest set has no more parts here than itself, however many sets meet.
    """
    large = parts.groupBy("low").agg(F.ceil(F.sum("k") / LOW_ROWS).alias("pieces")).where("pieces > 1")
    dealt = parts.join(large, "low", "left").withColumn("piece", F.pmod(F.xxhash64("part"), F.coalesce("pieces", F.lit(1))))
    return dealt.select("part", F.pmod(F.xxhash64("low", "piece"), F.lit(buckets)).alias("bucket"))


def meeting_links(docs: DataFrame, rule: Rule, shingles: int) -> DataFrame:
    """(a, b): links that connect all sets which may link.

    A part of very many sets is no bottleneck: each task holds one entry of it, its minimum is summed before the shuffle,
    and where sketches tell sets apart it is taken in blocks.
    """
    met = meeting_sets(docs, rule, shingles)
    if not rule.spare:
        ends = met.groupBy("part").agg(F.min("fp").alias("low"))
        return met.join(ends, "part").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    sketches = materialise(sketch_table(docs, rule).join(met.select("fp").distinct(), "fp", "left_semi"), "sketches")
    parts = materialise(met.groupBy("part").agg(F.count(F.lit(1)).alias("k"), F.min("fp").alias("low")), "parts")
    hot = parts.where(F.col("k") > PART_ROOM.rows).select(F.col("part").alias("grp"))  # one row for over PART_ROOM.rows of `met`
    dealt = part_buckets(parts.where(F.col("k") <= PART_ROOM.rows), 1 + met.count() // MET_ROWS)
    rows = materialise(met.join(F.broadcast(hot), met["part"] == hot["grp"], "left_anti").join(dealt, "part").select("bucket", "part", "fp"), "dealt")
    inside = rows.select(F.col("bucket").alias("of"), F.col("fp").alias("set")).distinct()
    known = inside.join(sketches, F.col("set") == F.col("fp")).drop("set")  # a sketch goes once to a bucket, not with each part
    links = rows.groupBy("bucket").cogroup(known.groupBy("of")).applyInPandas(lambda some, sets: likely_links(some, rule, sets), "a long, b long")
    if not hot.isEmpty():
        members = met.join(hot, met["part"] == hot["grp"]).select("grp", "fp", F.lit(BITS // 8).cast("long").alias("size"))
        compare = lambda some, classes: _likely_classes(_Sketches(some, rule), np.arange(len(some)), classes)
        links = links.unionByName(spanning_links(members, sketches, compare, PART_ROOM))
    return links.distinct()


def token_table(docs: DataFrame, wanted: DataFrame, rule: Rule = OP5) -> DataFrame:
    """The sets of `wanted` (doc_id, tag, fp, more columns), with `tokens` as bytes."""
    columns = [c for c in wanted.columns if c not in ("doc_id", "tag")]
    tagged = docs.select(F.col("doc_id").cast("long").alias("_id"), text_tag().alias("_tag"), "text")
    joined = tagged.join(wanted.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tag") == F.col("tag")))
    schema = ", ".join(f"{c} {t}" for c, t in wanted.dtypes if c in columns) + ", tokens binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in in_chunks(batch, "text", CHUNK):
                sets = list(shingle_sets(data, bounds, rule.width))
                same = [i for i, (s, fp) in enumerate(zip(sets, part.column("fp").to_pylist(), strict=True)) if fingerprint(s) == fp]
                kept = part.take(pa.array(same, pa.int64()))
                yield pa.record_batch([*[kept.column(c) for c in columns], pa.array([sets[i].tobytes() for i in same], pa.binary())], names=[*columns, "tokens"])

    return joined.select("text", *columns).mapInArrow(work, schema)


def classes_of(sets: list[np.ndarray], percent: int = OP5.percent, classes: np.ndarray | None = None) -> np.ndarray:
    """For each set the index of its class: sets at 100 * overlap >= percent * union, those of equal `classes`, and whatever these connect."""
    sizes = np.array([len(s) for s in sets])
    order = sorted(range(len(sets)), key=lambda i: (sets[i][0], sizes[i]))  # like sets mostly share their smallest token
    classes = np.arange(len(sets)) if classes is None else classes[order]
    members = _members(classes)
    flat = np.concatenate([sets[i] for i in order])
    words, ids = np.unique(flat, return_inverse=True)
    size = sizes[order]
    at = np.concatenate([[0], np.cumsum(size)])
    groups = np.arange(0, len(order), MEMBERS)
    union = np.zeros((len(groups), len(words)), bool)
    union[np.repeat(np.arange(len(order)) // MEMBERS, size), ids] = True
    smallest, largest = np.minimum.reduceat(size, groups), np.maximum.reduceat(size, groups)
    label, left = np.full(len(order), -1), len(order)
    query = np.zeros(len(words), bool)
    for seed in range(len(order)):
        if label[seed] >= 0:
            continue
        todo = members[classes[seed]].tolist()
        label[todo], left = seed, left - len(todo)
        while todo and left:
            q = todo.pop()
            own, n = ids[at[q] : at[q + 1]], size[q]
            bound = union[:, own].sum(axis=1)
            fits = (100 * bound >= percent * (n + smallest - np.minimum(bound, smallest))) & (100 * largest >= percent * n) & (100 * n >= percent * smallest)
            query[own] = True
            for g in np.flatnonzero(fits):
                a, b = groups[g], min(groups[g] + MEMBERS, len(order))
                if (label[a:b] < 0).any():
                    both = np.add.reduceat(query[ids[at[a] : at[b]]].astype(np.int64), at[a:b] - at[a])
                    linked = a + np.flatnonzero((100 * both >= percent * (n + size[a:b] - both)) & (label[a:b] < 0))
                    for c in np.unique(classes[linked]):
                        label[members[c]], left = seed, left - len(members[c])
                        todo += members[c].tolist()
            query[own] = False
    out = np.empty(len(order), np.int64)
    out[np.array(order)] = np.array(order)[label]
    return out


def link_sets(docs: DataFrame, sets: DataFrame, rule: Rule = OP5) -> DataFrame:
    """(a, b): links between set fingerprints that span all classes."""
    shingles = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    groups = materialise(connected_components(meeting_links(docs, rule, shingles)), "groups")
    keepers = sets.groupBy("fp").agg(F.min(F.struct("doc_id", "tag")).alias("k"), F.first("n").alias("n")).select("fp", "n", "k.doc_id", "k.tag")
    wanted = materialise(groups.join(keepers, groups["node"] == keepers["fp"]).select("doc_id", "tag", "fp", F.col("root").alias("grp"), (8 * F.col("n")).alias("size")), "wanted")
    tokens = materialise(token_table(docs, wanted.select("doc_id", "tag", "fp"), rule).dropDuplicates(["fp"]), "tokens")

    def compare(rows: pd.DataFrame, classes: np.ndarray) -> np.ndarray:
        return classes_of([np.frombuffer(t, np.uint64) for t in rows["tokens"]], rule.percent, classes)

    return spanning_links(wanted.select("grp", "fp", "size"), tokens, compare, TOKEN_ROOM)


def set_classes(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The set table, and (node, root) of sets that are linked."""
    sets = materialise(set_table(docs, rule), "sets")
    links = materialise(link_sets(docs, sets.where("n > 0"), rule), "spans")
    return sets, connected_components(links)


def ngram_components(docs: DataFrame, rule: Rule = OP5) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Null, empty or blank texts have no shingles and are their own component. Equal texts, and repeated rows, share one;
    a null doc_id stays null and joins in, but never names a component that has ids. Very long texts are one set each.
    An empty table gives no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    sets, roots = set_classes(docs, rule)
    owners = sets.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first"))
    owners = owners.join(roots, owners["fp"] == roots["node"], "left").withColumn("class", F.coalesce("root", "fp"))
    least = owners.groupBy("class").agg(F.min("first").alias("component_id"))
    named = owners.join(least, "class").select(F.col("fp").alias("of"), "component_id")
    joined = sets.join(named, (sets["fp"] == named["of"]) & (sets["n"] > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = OP5) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns; texts without words all stay.

    Rows are looked up among those that stay, so a large class is no bottleneck. Each row goes or stays by its own text: ids
    that are null come after all others, equal ids are told apart by a hash of the text, and of rows equal in both one stays.
    Rows without words are equal only if they have an id. Very long texts are compared whole. An empty table gives no rows;
    columns stay whatever their names.
    """
    sets, roots = set_classes(docs.select("doc_id", "text"), rule)
    worded = sets.where("n > 0").join(roots, F.col("fp") == F.col("node"), "left").withColumn("class", F.coalesce("root", "fp"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")
    keepers = worded.groupBy("class").agg(F.min(place).alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.tag").alias("_of"))
    (tag,) = spare_names(docs, "tag")
    marked, words = docs.withColumn(tag, text_tag()), F.coalesce("text", F.lit("")).rlike(BLANK_WORD)
    mine = marked["doc_id"].cast("long").eqNullSafe(keepers["_id"]) & (marked[tag] == keepers["_of"])
    kept, blank = marked.where(words).join(keepers, mine, "left_semi"), marked.where(~words)
    if not sets.groupBy("doc_id", "tag").count().where("count > 1").isEmpty():
        kept, blank = kept.dropDuplicates(["doc_id", tag]), blank.where("doc_id is not null").dropDuplicates(["doc_id", tag]).unionByName(blank.where("doc_id is null"))
    return kept.unionByName(blank).select(*docs.columns)
