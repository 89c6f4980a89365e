"""Prefix trie of conversations over padded matrices of turn ids.

Conversations are cut into segments of WIDTH turns, so that no row is longer, whatever a conversation's length. A segment
knows the prefix before it by a 128-bit key; segments are range-sharded by prefix, turn ids and conversation. Each shard is
a matrix, a row a segment, a column a turn, shorter ones padded: numpy's lexsort orders it, the masks of column changes,
OR-accumulated from left to right, mark where the node of each depth starts, and reduceat aggregates every depth, from the
deepest up. Only nodes on the path of a shard's first and last row can go on in another shard; these are combined by key,
and what they gather goes to their ancestors. What hangs below the last column comes from the segments after, whose sums
are added up over chains of segments by pointer jumping.

Turns are known by the MD5 of role and text, segments before a turn by 128 bits of xxhash64.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import materialise, running

#: Turns of a segment, rows of a shard, segments of a cell.
WIDTH, SHARD_ROWS, CELL_SEGMENTS = 32, 20_000, 256
#: Boundary nodes, of under 100 bytes each, that are broadcast; more are joined by a shuffle.
FEW_NODES = 100_000
ROOT = "0" * 32
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: `node`, `up` and `path` name boundary nodes; `grp` the prefix below which a first column's node hangs; `blob` members that end in a node.
PIECES = "kind int, node binary, up binary, path array<binary>, grp string, depth long, conv long, above long, n long, size long, children long, leaves long, saved long, more long, more_leaves long, more_saved long, sha string, blob string"
_TYPES = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.string(), *[pa.int64()] * 11, pa.string(), pa.string())
COMPLETE, PARTIAL, ENDS = 0, 1, 2


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, p, id, size, total) of every turn of the rebuilt conversations, and (conv, total) of every conversation.

    `turns`: conv, pos, id, size. A conversation c begins with the first crc32(c) % 6 turns of conversation c - c % 100, all if
    that has fewer, and goes on with its own turns after that many.
    """
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    shared = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).alias("h")
    convs = own.select("conv", "n", shared, (F.col("conv") - F.col("conv") % 100).alias("base"))
    bases = own.where("conv % 100 = 0").select(F.col("conv").alias("base"), F.col("n").alias("has"))
    head = F.least("h", F.coalesce("has", F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("head", head).withColumn("total", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialise(convs.select("conv", "base", "h", "head", "total"), "conversations")
    first = turns.where("conv % 100 = 0 and pos < 5").withColumnRenamed("conv", "base")
    heads = convs.where("head > 0").join(first, "base").where("pos < head").select("conv", F.col("pos").alias("p"), "id", "size", "total")
    rest = turns.join(convs, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("p"), "id", "size", "total")
    return heads.unionByName(rest), convs.select("conv", "total")


def _key(high: Column, low: Column) -> Column:
    return F.format_string("%016x%016x", high, low)


def segments(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """(conv, seg, ids, sizes, last, key, next): ids are 16 bytes a turn; key names the turns before the segment, next those through its end."""
    listed = F.array_sort(F.collect_list(F.struct("p", "id", "size")))
    cut = turns.groupBy("conv", F.floor(F.col("p") / width).cast("int").alias("seg")).agg(listed.alias("t"), F.max("total").alias("total"))
    cut = cut.select("conv", "seg", F.unhex(F.array_join("t.id", "")).alias("ids"), F.col("t.size").alias("sizes"), "total")
    bare = convs.where("total = 0").select("conv", F.lit(0).alias("seg"), F.lit(b"").alias("ids"), F.array().cast("array<long>").alias("sizes"), "total")
    cut = materialise(cut.unionByName(bare).withColumn("last", (F.col("seg") + 1) * width >= F.col("total")), "segments")
    short = cut.where(F.col("total") < width).select("conv", "seg", "ids", "sizes", "last", F.lit(ROOT).alias("key"), F.lit("").alias("next"))
    # The key is the exclusive or of the hashes of all segments before: first within cells of segments, then over cells.
    long = cut.where(F.col("total") >= width).withColumns({"a": F.xxhash64(F.lit(1), "seg", "ids"), "b": F.xxhash64(F.lit(2), "seg", "ids"), "cell": F.floor(F.col("seg") / CELL_SEGMENTS)})
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    cells = long.groupBy("conv", "cell").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    over = before.partitionBy("conv").orderBy("cell")
    cells = cells.select("conv", "cell", F.coalesce(F.bit_xor("a").over(over), F.lit(0)).alias("ca"), F.coalesce(F.bit_xor("b").over(over), F.lit(0)).alias("cb"))
    within = before.partitionBy("conv", "cell").orderBy("seg")
    long = long.withColumns({"pa": F.coalesce(F.bit_xor("a").over(within), F.lit(0)), "pb": F.coalesce(F.bit_xor("b").over(within), F.lit(0))}).join(cells, ["conv", "cell"])
    high, low = F.col("pa").bitwiseXOR(F.col("ca")), F.col("pb").bitwiseXOR(F.col("cb"))
    long = long.select("conv", "seg", "ids", "sizes", "last", _key(high, low).alias("key"), _key(high.bitwiseXOR(F.col("a")), low.bitwiseXOR(F.col("b"))).alias("next"))
    return materialise(short.unionByName(long), "keyed")


def _matrix(ids: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The lengths, and the padded matrix of turn ids' ranks, from 1; 0 is padding."""
    lengths = np.array([len(x) // 16 for x in ids], np.int64)
    halves = np.frombuffer(b"".join(ids), ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(fresh)
    row = np.repeat(np.arange(len(ids)), lengths)
    column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(ids), width), np.int32)
    out[row, column] = rank
    return lengths, out


def shard_nodes(rows: dict[str, list], width: int) -> pa.RecordBatch:
    """The nodes of one shard: complete ones, partial ones on the path of the first and the last row, and the members that end in these."""
    ids, keys, count = rows["ids"], rows["key"], len(rows["ids"])
    conv, seg, above = (np.array(rows[c], np.int64) for c in ("conv", "seg", "above"))
    last, more = np.array(rows["last"], bool), np.array([rows[c] for c in ("more", "more_leaves", "more_saved")], np.int64)
    lengths, turns = _matrix(ids, width)
    sizes = np.zeros((count, width + 1), np.int64)
    sizes[np.repeat(np.arange(count), lengths), 1 + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = [s for x in rows["sizes"] for s in x]
    groups = {g: i + 1 for i, g in enumerate(sorted(set(zip(seg.tolist(), keys, strict=True))))}
    matrix = np.column_stack([np.array([groups[g] for g in zip(seg.tolist(), keys, strict=True)], np.int32), turns])
    order = np.lexsort((conv, *matrix.T[::-1]))
    matrix, conv, seg, above, last, lengths, sizes, more = matrix[order], conv[order], seg[order], above[order], last[order], lengths[order], sizes[order], more[:, order]
    changed = np.ones((count, width + 1), bool)
    changed[1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
    bounds = [np.flatnonzero(changed[:, j]) for j in range(width + 1)]  # of node or padding
    names: dict[tuple[int, int], bytes] = {}

    def name(i: int, j: int) -> bytes:
        if (i, j) not in names:
            names[i, j] = hashlib.md5(keys[order[i]].encode() + ids[order[i]][: 16 * j]).digest()
        return names[i, j]

    def ended(i: int, e: int, j: int) -> str:
        some = slice(i, i + int(np.searchsorted(lengths[i:e] > j, True)))  # sorted first, as padding is smallest
        return ",".join(map(str, conv[some][last[some] & (lengths[some] == j)].tolist()))

    out: list[tuple] = []
    below = np.zeros((3, count), np.int64)  # children, leaves and saved of the next depth's complete nodes, at their first rows
    smallest = [np.repeat(np.minimum.reduceat(conv, b), np.diff(np.append(b, count))) for b in bounds]
    for j in range(width, -1, -1):
        starts = bounds[j]
        ends = np.append(starts[1:], count)
        n, sums = ends - starts, [np.add.reduceat(x, starts) for x in below]
        beyond = [np.maximum.reduceat(np.where(lengths == width, x, 0), starts) if j == width else np.zeros(len(starts), np.int64) for x in more]
        real = (matrix[starts, j] > 0) & ((j > 0) | (seg[starts] == 0))
        edge = (starts == 0) | (ends == count)
        own = (n - 1) * sizes[starts, j]
        children = sums[0] + beyond[0]
        leaves, saved = sums[1] + beyond[1] + (children == 0), sums[2] + beyond[2] + own
        below = np.zeros((3, count), np.int64)
        parent = np.searchsorted(bounds[j - 1], starts, side="right") - 1 if j > 1 else np.zeros(len(starts), np.int64)
        parent_edge = (parent == 0) | (parent == len(bounds[j - 1]) - 1)
        for k in np.flatnonzero(real):
            i, e = int(starts[k]), int(ends[k])
            up = None if j == 0 or (j > 1 and parent_edge[k]) else int(above[i] if j == 1 else smallest[j - 1][i])
            link = name(i, j - 1) if (j > 1 and parent_edge[k]) or (j == 1 and seg[i] == 0) else None
            common = (keys[order[i]] if j == 1 else None, int(seg[i]) * width + j, int(smallest[j][i]), up, int(n[k]), int(sizes[i, j]))
            members = ended(i, e, j)
            if edge[k]:
                path = [name(i, m) for m in range(0 if seg[i] == 0 else 1, j)]
                out.append((PARTIAL, name(i, j), link, path, *common, *[int(x[k]) for x in (*sums, *beyond)], None, None))
                if members:
                    out.append((ENDS, name(i, j), None, None, None, None, int(members.split(",", 1)[0]), *[None] * 9, None, members))
            else:
                below[:, i] = 1, leaves[k], saved[k]
                sha = hashlib.sha256(members.encode()).hexdigest() if members else NO_ENDS
                out.append((COMPLETE, None, link if j > 1 else None, None, *common, int(children[k]), int(leaves[k]), int(saved[k]), 0, 0, 0, sha, None))
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def _ends(blobs: DataFrame) -> DataFrame:
    """(node, sha) of the members that end in each boundary node; these come in order, so that what is held is one shard's share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []
        for batch in batches:
            for of, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if of != node:
                    if node is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest = of, hashlib.sha256(blob.encode())
                else:
                    digest.update(b"," + blob.encode())
        if node is not None:
            out.append((node, digest.hexdigest()))
        yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["node", "sha"])

    return blobs.select("node", "conv", "blob").repartition("node").sortWithinPartitions("node", "conv").mapInArrow(work, "node binary, sha string")


def nodes(cut: DataFrame, width: int, shard_rows: int) -> DataFrame:
    """(grp, depth, conv, above, n, children, leaves, saved, sha) of every node; `cut`: segments with above, more, more_leaves, more_saved."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield shard_nodes(pa.Table.from_batches(held).to_pydict(), width)

    shards = max(1, math.ceil(cut.count() / shard_rows))
    pieces = materialise(cut.repartitionByRange(shards, "seg", "key", "ids", "conv").mapInArrow(work, PIECES), "pieces")
    same = [F.first(c).alias(c) for c in ("up", "path", "grp", "depth", "above", "size")]
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    part = pieces.where(f"kind = {PARTIAL}").groupBy("node").agg(F.min("conv").alias("conv"), *same, *sums, *[F.max(c).alias(c) for c in ("more", "more_leaves", "more_saved")])
    part = materialise(part.join(_ends(pieces.where(f"kind = {ENDS}")), "node", "left"), "boundary")
    under = part.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("under"))
    part = part.join(under, "node", "left").withColumn("children", F.col("children") + F.col("more") + F.coalesce("under", F.lit(0)))
    part = part.withColumns({"leaves": F.col("leaves") + F.col("more_leaves") + (F.col("children") == 0).cast("long"), "saved": F.col("saved") + F.col("more_saved") + (F.col("n") - 1) * F.col("size")})
    gathered = part.select(F.explode("path").alias("node"), "leaves", "saved").groupBy("node").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    part = part.join(gathered, "node", "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0)), "sha": F.coalesce("sha", F.lit(NO_ENDS))})
    part = materialise(part, "combined")
    columns = ["grp", "depth", "conv", "above", "n", "children", "leaves", "saved", "sha"]
    open_ = pieces.where(f"kind = {COMPLETE}").select(*columns, "up").unionByName(part.select(*columns, "up"))
    parents = part.select(F.col("node").alias("up"), F.col("conv").alias("of"))
    named = open_.join(F.broadcast(parents) if part.count() <= FEW_NODES else parents, "up", "left")
    return named.withColumn("above", F.coalesce("above", "of")).select(*columns)


def chain_sums(groups: DataFrame) -> DataFrame:
    """Adds to (grp, up, more_leaves, more_saved) what all groups below hold: after k rounds those within 2^k steps."""
    groups = materialise(groups, "groups")
    while not groups.where("up is not null").isEmpty():
        below = groups.where("up is not null").groupBy(F.col("up").alias("grp")).agg(F.sum("more_leaves").alias("l"), F.sum("more_saved").alias("s"))
        jump = groups.select(F.col("grp").alias("up"), F.col("up").alias("far"))
        groups = groups.join(below, "grp", "left").join(jump, "up", "left")
        groups = materialise(groups.select("grp", F.col("far").alias("up"), "more", (F.col("more_leaves") + F.coalesce("l", F.lit(0))).alias("more_leaves"), (F.col("more_saved") + F.coalesce("s", F.lit(0))).alias("more_saved")), "groups")
    return groups


def prefix_trie(conversations: DataFrame, *, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie.

    Rows without a conv_id belong to no conversation. Null turns come first; rows equal in conv_id and turn go by a hash of
    role and text, and each counts. Null role or text is empty. A conversation may have any number of turns, a text any
    length. An empty table has no root. Other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tag = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), tag.alias("id"), F.length(text).cast("long").alias("size"))
    turns = materialise(running(turns, "conv", ["turn", "id"], F.lit(1), "pos").drop("turn"), "turns")
    made, convs = rebuilt(turns)
    cut = segments(made, convs, width)
    root = convs.agg(F.min("conv")).first()[0]
    plain = F.lit(0).cast("long")
    long = cut.where("next <> ''")
    if long.isEmpty():
        cut = cut.withColumns({"above": F.lit(root).cast("long"), "more": plain, "more_leaves": plain, "more_saved": plain})
    else:
        full = long.where(F.length("ids") == 16 * width)
        tops = full.groupBy(F.col("next").alias("key")).agg(F.min("conv").alias("top"))
        cut = materialise(cut.join(tops, "key", "left").withColumn("above", F.coalesce("top", F.lit(root).cast("long"))).drop("top"), "linked")
        deep = cut.where("seg > 0").withColumns({"more": (~F.col("last")).cast("long"), "more_leaves": plain, "more_saved": plain})
        first = nodes(deep, width, shard_rows).where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("more"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        ups = full.where("not last and seg > 0").groupBy(F.col("next").alias("grp")).agg(F.first("key").alias("up"))
        sums = chain_sums(first.join(ups, "grp", "left").select("grp", "up", "more", "more_leaves", "more_saved"))
        cut = cut.join(sums.drop("up").withColumnRenamed("grp", "next"), "next", "left").fillna(0, ["more", "more_leaves", "more_saved"])
        cut = materialise(cut, "linked")
    found = nodes(cut, width, shard_rows)
    names = {"conv": "conv_id", "depth": "depth", "above": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "sha": "ends_sha256"}
    return found.select(*[F.col(c).alias(n) for c, n in names.items()])
