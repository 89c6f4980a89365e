"""Suffix-array dedup: removes every byte under a 50-byte string that also starts in a document with a smaller doc_id.

Suffixes need ordering only through their first 50 bytes, and only where they can be equal. So

1. Every window of 50 bytes names an anchor, its smallest 16-byte gram by hash: equal windows name equal anchors. The
   windows that share an anchor are a run; a text has about one run for 17 bytes. Where a text repeats itself at once (a
   line of dashes) equal runs follow each other; these are one row with a count. Runs are packed and dealt by anchor.
2. Runs whose anchors meet those of other documents are told apart by a hash of the whole run: a run that a smaller
   document has too is repeated as a whole. Of unlike runs with one anchor (where passages begin and end) the bytes are
   fetched.
3. Their windows are radix sorted, most significant digit first, eight bytes a pass, and not beyond the 50th byte;
   windows alone in their group drop out after each pass. What is left in one group is equal.
4. Each text gets its repeated places and loses them.

Nothing hot is held by one task. Runs that a smaller document among those packed together has too need no partner and are
dealt by document. A bucket of too many runs, and an anchor of too many unlike ones, goes on window by window: windows are
dealt by their own bytes, and each task sends only those on that it hasn't seen in a smaller document.

Exact but for step 2, where runs are equal if the 96 bits of their anchor and run hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import in_chunks, materialise
from tracelens.llm.hashing import prefix_hash, span_hash

LENGTH, GRAM = 50, 16
#: Bytes of text hashed at once, some hundred times as many in work arrays, runs packed together, windows remembered by a task.
CHUNK_BYTES, HELD_RUNS, HELD_WINDOWS = 1 << 19, 400_000, 500_000
#: Bytes of text in one partition where texts are shuffled, the most partitions, and the most buckets; beyond these they grow.
PARTITION_BYTES, MOST_PARTITIONS, MOST_BUCKETS = 8 << 20, 50_000, 1 << 21
#: The key of documents whose id is null: after all others.
LAST = (1 << 63) - 1
#: What `sort` says of a place: repeated as it is, its windows are sorted one by one; else with runs of equal `sort`.
DONE, SINGLY = -1, -2
_RUN = np.dtype([("anchor", "<u4"), ("run", "<u8"), ("key", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("times", "<u4"), ("size", "<u2")])
PLACE = "key long, tag long, start long, size int, times long, sort long"


@dataclass(frozen=True)
class Limits:
    """Bytes of text for which one bucket of runs is made, its runs that are matched at once, and runs that one task sorts.

    With MOST_BUCKETS buckets and more text, four times a bucket's share of it are matched at once.
    """

    bucket_bytes: int = 4 << 20
    match_runs: int = 2_000_000
    sort_runs: int = 20_000


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each `width` neighbours, by doubling."""
    n, out, have = len(x) - width + 1, x, 1
    while have * 2 <= width:
        out, have = pick(out[:-have], out[have:]), have * 2
    return pick(out[:n], out[width - have : width - have + n])


def runs_of(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, size, times, anchor, run) of every run: windows start..start+size-length name the same anchor place.

    Of equal grams in a window the last one is its anchor, which is the same place in equal windows. Runs that follow
    each other and are equal are one, `times` over; each begins where the windows of the one before end.
    """
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return empty
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    least = sliding(grams, length - gram + 1, np.minimum)
    wide = np.concatenate([np.zeros(length - gram, np.uint64), least, np.zeros(length - gram, np.uint64)])
    chosen = np.flatnonzero(sliding(wide, length - gram + 1, np.maximum) == grams)
    window = np.arange(len(least))
    last = np.searchsorted(chosen, window + length - gram, side="right") - 1
    place = chosen[last]
    wrong = np.flatnonzero(grams[place] != least)
    while len(wrong):  # the last chosen gram in reach is another window's; step back
        last[wrong] -= 1
        place[wrong] = chosen[last[wrong]]
        wrong = wrong[grams[place[wrong]] != least[wrong]]
    text = np.searchsorted(bounds, window, side="right") - 1
    whole = window + length <= bounds[text + 1]
    window, place, text = window[whole], place[whole], text[whole]
    if not len(window):
        return empty
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(window)]]) - 1
    start, end, of, anchor = window[head], window[tail] + length, text[head], grams[place[head]]
    run = span_hash(prefix, start, end)
    new = np.ones(len(head), bool)
    new[1:] = (of[1:] != of[:-1]) | (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1]) | (start[1:] != end[:-1] - length + 1)
    first = np.flatnonzero(new)
    times = np.diff(np.concatenate([first, [len(head)]]))
    return of[first], start[first] - bounds[of[first]], (end - start)[first], times, anchor[first], run[first]


def pieces_of(part: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """`runs_of` for a chunk; a long text is taken in pieces that overlap by one byte less than a window."""
    if part.num_rows > 1 or len(data) <= 2 * CHUNK_BYTES:
        yield runs_of(data, bounds)
        return
    for cut in range(0, len(data) - LENGTH + 1, CHUNK_BYTES):
        piece = data[cut : cut + CHUNK_BYTES + LENGTH - 1]
        text, start, *more = runs_of(piece, np.array([0, len(piece)]))
        yield text, start + cut, *more


def dealt_runs(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, done, runs): packed runs by bucket of their anchor. Runs that a smaller document among those packed together has too are `done`."""

    def dealt(parts: list[np.ndarray], buckets_of: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, bucket = np.concatenate(parts), np.concatenate(buckets_of)
        order = np.lexsort((rows["start"], rows["tag"], rows["key"], rows["run"], rows["anchor"], bucket))
        rows, bucket = rows[order], bucket[order]
        same = np.zeros(len(rows), bool)
        same[1:] = (bucket[1:] == bucket[:-1]) & (rows["anchor"][1:] == rows["anchor"][:-1]) & (rows["run"][1:] == rows["run"][:-1])
        done = rows["key"] > rows["key"][np.maximum.accumulate(np.where(same, 0, np.arange(len(rows))))]
        again = same.copy()  # the same place of a row that repeats
        again[1:] &= (rows["key"][1:] == rows["key"][:-1]) & (rows["tag"][1:] == rows["tag"][:-1]) & (rows["start"][1:] == rows["start"][:-1])
        for flag in (False, True):
            some = np.flatnonzero((done == flag) & ~again)
            if flag:
                of = (int(rows["run"].sum() % np.uint64(buckets)) + rows["key"][some] % 16) % buckets
                order = np.argsort(of, kind="stable")
                some, of = some[order], of[order]
            else:
                of = bucket[some]
            if len(of):
                cut = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
                packed = [_pack(rows[some[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.record_batch([pa.array(of[cut[:-1]], pa.int64()), pa.array([flag] * len(packed), pa.bool_()), pa.array(packed, pa.binary())], names=["bucket", "done", "runs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, buckets_of, held = [], [], 0
        for batch in batches:
            for part, data, bounds in in_chunks(batch, "text", CHUNK_BYTES):
                for text, start, size, times, anchor, run in pieces_of(part, data, bounds):
                    if not len(text):
                        continue
                    rows = np.empty(len(text), _RUN)
                    rows["anchor"], rows["run"] = anchor.astype(np.uint32), run
                    rows["key"], rows["tag"] = part.column(0).to_numpy()[text], part.column(1).to_numpy()[text]
                    rows["start"], rows["size"], rows["times"] = start, size, times
                    parts.append(rows)
                    buckets_of.append(((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
                    held += len(rows)
                    if held >= max(HELD_RUNS, 2 * buckets):
                        yield from dealt(parts, buckets_of)
                        parts, buckets_of, held = [], [], 0
        if held:
            yield from dealt(parts, buckets_of)

    return docs.select("key", "tag", "text").mapInArrow(work, "bucket long, done boolean, runs binary")


def _pack(rows: np.ndarray) -> bytes:
    """Byte planes, as high bytes are alike."""
    return np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), _RUN.itemsize).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(_RUN.itemsize, -1).T).view(_RUN).ravel()


def _places(runs: np.ndarray, sort: np.ndarray | int) -> pa.RecordBatch:
    """Places as rows; a repeated run, with all its repeats, is one place."""
    size, times = runs["size"].astype(np.int64), runs["times"].astype(np.int64)
    sort = np.broadcast_to(np.asarray(sort, np.int64), len(runs))
    whole = sort == DONE
    size, times = np.where(whole, size + (times - 1) * (size - LENGTH + 1), size), np.where(whole, 1, times)
    columns = (runs["key"], runs["tag"], runs["start"].astype(np.int64), size.astype(np.int32), times, sort)
    return pa.record_batch([pa.array(c) for c in columns], names=["key", "tag", "start", "size", "times", "sort"])


def match_runs(runs: np.ndarray, bucket: int, sort_runs: int) -> pa.RecordBatch:
    """Places of one bucket's runs: repeated ones, and those whose bytes are to be sorted with others."""
    runs = runs[np.lexsort((runs["key"], runs["run"], runs["anchor"]))]
    new_anchor, new_run = np.ones(len(runs), bool), np.ones(len(runs), bool)
    new_anchor[1:] = runs["anchor"][1:] != runs["anchor"][:-1]
    new_run[1:] = new_anchor[1:] | (runs["run"][1:] != runs["run"][:-1])
    of_run = np.maximum.accumulate(np.where(new_run, np.arange(len(runs)), 0))
    repeated = runs["key"] > runs["key"][of_run]
    group, heads = np.cumsum(new_anchor) - 1, np.flatnonzero(new_anchor)
    apart = np.minimum.reduceat(runs["key"], heads) < np.maximum.reduceat(runs["key"], heads)
    mixed = ~repeated & ((np.bincount(group, weights=new_run) > 1) & apart)[group]
    many = np.bincount(group, weights=mixed) > sort_runs
    sort = np.where(repeated, DONE, np.where(many[group], SINGLY, bucket << 32 | runs["anchor"].astype(np.int64)))
    out = repeated | mixed
    return _places(runs[out], sort[out])


def _match(limits: Limits):
    """Matches the runs of each bucket; rows come sorted by bucket. Of a bucket with over `match_runs` no more are held: all its runs are sorted singly."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, n, ready = -1, [], 0, []
        for batch in batches:
            for of, done, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                runs = _unpack(packed.as_py())
                if done:
                    ready.append(runs)
                    if sum(map(len, ready)) > 100_000:
                        yield _places(np.concatenate(ready), DONE)
                        ready = []
                    continue
                if of != bucket:
                    if held:
                        yield match_runs(np.concatenate(held), bucket, limits.sort_runs)
                    bucket, held, n = of, [], 0
                n += len(runs)
                held.append(runs)
                if n > limits.match_runs:
                    yield _places(np.concatenate(held), SINGLY)
                    held = []
        if held:
            yield match_runs(np.concatenate(held), bucket, limits.sort_runs)
        if ready:
            yield _places(np.concatenate(ready), DONE)

    return work


def sort_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeated places among the windows of runs with equal `sort`: a radix sort through LENGTH bytes, eight a pass."""
    sizes = rows["bytes"].str.len().to_numpy()
    count = sizes - LENGTH + 1
    run = np.repeat(np.arange(len(rows)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    data = np.frombuffer(b"".join(rows["bytes"]) + bytes(8), np.uint8)
    at = np.repeat(np.cumsum(sizes) - sizes, count) + inside
    key = rows["key"].to_numpy()[run]
    digits = np.lib.stride_tricks.sliding_window_view(data, 8)
    group = np.unique(rows["sort"].to_numpy(), return_inverse=True)[1][run]
    live = np.arange(len(at))
    for depth in range(0, LENGTH, 8):
        width = min(8, LENGTH - depth)
        digit = np.ascontiguousarray(digits[at[live] + depth]).view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - 8 * width)
        order = np.lexsort((digit, group[live]))
        live, digit = live[order], digit[order]
        new = np.ones(len(live), bool)
        new[1:] = (group[live][1:] != group[live][:-1]) | (digit[1:] != digit[:-1])
        fresh = np.cumsum(new) - 1
        group[live] = fresh
        live = live[np.bincount(fresh)[fresh] > 1]
        if not len(live):
            break
    least = np.full(group.max() + 1 if len(live) else 0, LAST)
    np.minimum.at(least, group[live], key[live])
    hit = np.sort(live[key[live] > least[group[live]]])
    new = np.ones(len(hit), bool)
    new[1:] = (run[hit][1:] != run[hit][:-1]) | (hit[1:] != hit[:-1] + 1)
    head = np.flatnonzero(new)
    windows = np.diff(np.concatenate([head, [len(hit)]]))
    first, of = hit[head], run[hit[head]]
    start = rows["start"].to_numpy()[of] + inside[first]
    return _over_repeats(key[first], rows["tag"].to_numpy()[of], start, windows, rows["times"].to_numpy()[of], rows["step"].to_numpy()[of])


def _over_repeats(key: np.ndarray, tag: np.ndarray, start: np.ndarray, windows: np.ndarray, times: np.ndarray, step: np.ndarray) -> pd.DataFrame:
    """Places of `windows` windows, again every `step` bytes, `times` over; one place where they leave no gap."""
    whole = windows == step
    windows, times = np.where(whole, windows * times, windows), np.where(whole, 1, times)
    row = np.repeat(np.arange(len(key)), times)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    size = (windows + LENGTH - 1)[row].astype(np.int32)
    return pd.DataFrame({"key": key[row], "tag": tag[row], "start": (start[row] + nth * step[row]).astype(np.int64), "size": size})


FETCHED = "key long, tag long, start long, size int, times long, step long, sort long, part long, bytes binary"


def _fetch(parts: int):
    """The bytes of the runs in `places`, by part of the sort; of those sorted singly the windows, and `bytes` null if repeated already."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            for part, data, bounds in in_chunks(batch, "text"):
                places = part.column(part.schema.get_field_index("places"))
                of = np.repeat(np.arange(part.num_rows), np.diff(places.offsets.to_numpy()))
                flat = places.flatten()
                start, size, times, sort = (flat.field(c).to_numpy() for c in ("start", "size", "times", "sort"))
                key, tag = (part.column(i).to_numpy()[of] for i in (0, 1))
                whole = data.tobytes()
                begin = bounds[of] + start
                runs = np.flatnonzero(sort != SINGLY)
                cut = [whole[a : a + n] for a, n in zip(begin[runs].tolist(), size[runs].tolist(), strict=True)]
                ones = np.full(len(runs), LENGTH, np.int32)
                yield _fetched(key[runs], tag[runs], start[runs], ones, times[runs], (size - LENGTH + 1)[runs].astype(np.int64), sort[runs], sort[runs] % parts, cut)
                singles = np.flatnonzero(sort == SINGLY)
                count = size[singles].astype(np.int64) - LENGTH + 1
                row = np.repeat(singles, count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                cut, to = [], []
                for a, k in zip((begin[row] + nth).tolist(), key[row].tolist(), strict=True):
                    window = whole[a : a + LENGTH]
                    digest = hashlib.blake2b(window, digest_size=16).digest()
                    to.append(int.from_bytes(digest[:8], "little") % parts)
                    known = seen.get(digest, LAST)
                    cut.append(None if known < k else window)
                    if k < known:
                        seen[digest] = k
                if len(seen) > HELD_WINDOWS:
                    seen.clear()
                ones = np.full(len(row), LENGTH, np.int32)
                yield _fetched(key[row], tag[row], start[row] + nth, ones, times[row], (size[row] - LENGTH + 1).astype(np.int64), sort[row], np.array(to, np.int64), cut)

    return work


def _fetched(*columns) -> pa.RecordBatch:
    names = ["key", "tag", "start", "size", "times", "step", "sort", "part", "bytes"]
    return pa.record_batch([pa.array(c, pa.binary()) if n == "bytes" else pa.array(c) for c, n in zip(columns, names, strict=True)], names=names)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, bounds in in_chunks(batch, "text"):
            places = part.column(part.schema.get_field_index("places"))
            starts = places.offsets.to_numpy() - places.offsets[0].as_py()
            flat = places.flatten()
            start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
            removed, spans, digests, kept = [], [], [], []
            whole = data.tobytes()
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                left, right = starts[i], starts[i + 1]
                order = np.argsort(start[left:right], kind="stable")
                out, end, gone, runs = [], 0, 0, 0
                for s, n in zip(start[left:right][order].tolist(), size[left:right][order].tolist(), strict=True):
                    if s > end or not runs:
                        out.append(whole[a + end : a + s])
                        runs += 1
                        end, gone = s + n, gone + n
                    elif s + n > end:
                        end, gone = s + n, gone + s + n - end
                out.append(whole[a + end : b])
                kept.append(b"".join(out))
                removed.append(gone)
                spans.append(runs)
                digests.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.record_batch(
                [part.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests), pa.array(kept, pa.binary())],
                names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): every text and what is left of it, as bytes.

    Null text is empty. Documents with the same id are not smaller than each other; where ids repeat, rows are told apart
    by id and a 64-bit hash of the text, so equal rows get equal results. A null id sorts after all others. Texts under 50
    bytes keep all; very long ones are taken in pieces. An empty table gives no rows; other columns are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    unique = docs.groupBy(key.alias("key")).count().where("count > 1").isEmpty()
    tag: Column = F.lit(0).cast("long") if unique else F.xxhash64(whole)
    docs = docs.select(key.alias("key"), tag.alias("tag"), whole.alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    deals = min(1 + total // PARTITION_BYTES, MOST_PARTITIONS)
    buckets = min(1 + total // limits.bucket_bytes, MOST_BUCKETS)
    if buckets == MOST_BUCKETS:
        limits = replace(limits, match_runs=max(limits.match_runs, 4 * total // 17 // buckets))
    dealt = dealt_runs(docs, buckets).repartition(deals, "bucket").sortWithinPartitions("bucket")
    found = materialise(dealt.mapInArrow(_match(limits), PLACE), "runs")
    todo, singly = found.where(f"sort <> {DONE}"), not found.where(f"sort = {SINGLY}").isEmpty()
    weight = F.when(F.col("sort") == SINGLY, F.col("size") - LENGTH + 1).otherwise(F.lit(1))
    parts = 1 + (todo.agg(F.sum(weight).alias("n")).first()["n"] or 0) // limits.sort_runs

    row = ["key"] if unique else ["key", "tag"]
    texts = docs.repartition(deals, "key") if unique else docs  # rows that repeat are left to the joins, which can split them
    gather = F.collect_list if unique else F.collect_set
    gathered = lambda places, *columns: places.groupBy(*row).agg(gather(F.struct(*columns)).alias("places"))
    joined = texts.join(gathered(todo, "start", "size", "times", "sort"), row).select("key", "tag", "text", "places")
    fetched = joined.mapInArrow(_fetch(parts), FETCHED)
    fetched = materialise(fetched, "windows") if singly else fetched
    open_ = (fetched.where("bytes is not null") if singly else fetched).repartition(min(1 + parts // 4, MOST_PARTITIONS), "part")
    places = found.where(f"sort = {DONE}").select("key", "tag", "start", "size")
    places = places.unionByName(open_.groupBy("part").applyInPandas(sort_windows, "key long, tag long, start long, size int"))
    if singly:
        each = F.explode(F.expr("transform(sequence(0L, times - 1), k -> start + k * step)"))
        places = places.unionByName(fetched.where("bytes is null").select("key", "tag", each.alias("start"), "size"))
    nothing = F.array().cast("array<struct<start:bigint,size:int>>")
    rows = texts.join(gathered(places, "start", "size"), row, "left").select("key", "text", F.coalesce("places", nothing).alias("places"))
    out = rows.mapInArrow(_remove, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.when(F.col("key") < LAST, F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
