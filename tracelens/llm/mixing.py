"""Mixing sources to target weights as a min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; a pattern offers its words once for
nothing, a second time at cost 1, a third time at cost 2 (convex repetition costs), to each of its sources, and a source
takes as many as its target. The flow is solved over patterns, never over documents. Then each pattern's flow is spread
over its documents in a seeded order: whole passes over all, and one pass more over the first ones.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import BLANK_WORD, materialise, n_words_of, running


#: Rows for which one cell of a pattern is made.
CELL_ROWS = 100_000


def source_targets(sizes: dict, weights: dict, total: float, repeat: float) -> dict:
    """Shares `total` by weight; a target stops at `repeat` times its source's size, and the excess is shared again."""
    targets, open_ = {}, list(sizes)
    left = total
    while open_:
        weight = sum(weights[s] for s in open_)
        above = [s for s in open_ if left * weights[s] / weight > repeat * sizes[s]]
        if not above:
            targets |= {s: left * weights[s] / weight for s in open_}
            break
        for s in above:
            targets[s] = float(repeat * sizes[s])
            left -= targets[s]
        open_ = [s for s in open_ if s not in targets]
    return targets


@dataclass
class _Arc:
    to: int
    back: int
    room: int
    cost: int


def route(patterns: dict[tuple, int], quotas: dict, repeat: int) -> dict[tuple, dict]:
    """Words of each pattern routed to each source: the largest flow, of these the cheapest.

    Patterns that no shared source connects don't touch each other's flow, so the network is cut into its parts and each
    part is solved by itself.
    """
    above: dict = {}

    def top(x: tuple) -> tuple:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for name in patterns:
        for s in name:
            above[top(("source", s))] = top(("pattern", name))
    parts: dict[tuple, tuple[dict, dict]] = {}
    for name, size in patterns.items():
        parts.setdefault(top(("pattern", name)), ({}, {}))[0][name] = size
    for s, quota in quotas.items():
        if ("source", s) in above:
            parts[top(("source", s))][1][s] = quota
    flows: dict[tuple, dict] = {}
    for some, asked in parts.values():
        flows |= _flow(some, asked, repeat)
    return flows


def _flow(patterns: dict[tuple, int], quotas: dict, repeat: int) -> dict[tuple, dict]:
    """Successive shortest paths with potentials; arcs: patterns x memberships x repeats."""
    names, sources = sorted(patterns, key=str), sorted(quotas, key=str)
    source_at = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    start, end = 0, 1 + len(names) + len(sources)
    net: list[list[_Arc]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> _Arc:
        net[a].append(_Arc(b, len(net[b]), room, cost))
        net[b].append(_Arc(a, len(net[a]) - 1, 0, -cost))
        return net[a][-1]

    routed = []
    for i, name in enumerate(names):
        for copy in range(repeat):
            arc(start, 1 + i, patterns[name], copy)
        routed += [(name, s, arc(1 + i, source_at[s], repeat * patterns[name], 0)) for s in name]
    for s in sources:
        arc(source_at[s], end, quotas[s], 0)
    potential = [0] * len(net)
    while True:
        far, via = {start: 0}, {}
        heap = [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, x in enumerate(net[a]):
                if x.room and (to := d + x.cost + potential[a] - potential[x.to]) < far.get(x.to, to + 1):
                    far[x.to], via[x.to] = to, (a, k)
                    heapq.heappush(heap, (to, x.to))
        if end not in far:
            flows: dict[tuple, dict] = {name: {} for name in names}
            for name, s, a in routed:
                flows[name][s] = net[a.to][a.back].room
            return flows
        limit = max(far.values())
        potential = [p + far.get(i, limit) for i, p in enumerate(potential)]
        path, at = [], end
        while at != start:
            a, k = via[at]
            path.append(net[a][k])
            at = a
        room = min(x.room for x in path)
        for x in path:
            x.room -= room
            net[x.to][x.back].room += room


def mix(docs: DataFrame, members: Column, size: Column, weight_of, *, key: str = "doc_id", tie: Column | None = None, carry: Column | None = None, share: float = 1.5, repeat: int = 2, seed: int = 7, most_patterns: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(key, members, size, carry, copies) of every row; (source, source_size, target) of every source.

    `members`: array of source names (null is a name); `weight_of`: list of names -> {name: weight}. The patterns, sums
    by combination of sources, go to the driver; more than `most_patterns` of them are refused, not cut. A row without
    any source is not taken. Sizes that are null count as 0. Rows are placed in each pattern by a seeded hash of the key
    and of `tie`, a string, then by size; what is equal in all of these is interchangeable, but each row counts.
    """
    tie = F.lit("") if tie is None else F.concat(F.lit("|"), F.coalesce(tie, F.lit("")))
    carry = F.lit(None).cast("string") if carry is None else carry
    rows = docs.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(members)).alias("members"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), carry.alias("carry"), tie.alias("tie"))
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("tie")))
    rows = materialise(rows.withColumn("place", order).drop("tie"), "mix")
    digits = max(3, math.ceil(math.log(max(rows.count(), 1) / CELL_ROWS, 16)))
    rows = rows.withColumn("cell", F.substring("place", 1, digits))
    cells = rows.groupBy("members", "cell").agg(F.sum("size").alias("size"))
    sums = cells.groupBy("members").agg(F.sum("size").alias("size")).limit(most_patterns + 1).collect()
    if len(sums) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    patterns = {tuple(r.members or ()): int(r["size"]) for r in sums}
    sizes: dict = {}
    for name, n in patterns.items():
        for s in name:
            sizes[s] = sizes.get(s, 0) + n
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = source_targets({s: sizes[s] for s in ordered}, weight_of(ordered), share * sum(patterns.values()), repeat)
    targets = {s: round(t, 6) for s, t in targets.items()}
    flows = route(patterns, {s: int(t) for s, t in targets.items()}, repeat)

    spark = docs.sparkSession
    plan = [(i, list(p), *(divmod(sum(flows[p].values()), n) if n else (0, 0))) for i, (p, n) in enumerate(patterns.items())]
    plan = spark.createDataFrame(plan, "pattern long, members array<string>, passes long, rest long")
    up_to = Window.partitionBy("members").orderBy("cell")
    edges = (  # of each pattern the one cell in which the last pass ends
        cells.withColumn("upto", F.sum("size").over(up_to))
        .withColumn("before", F.col("upto") - F.col("size"))
        .join(plan.withColumnRenamed("members", "of"), F.col("members").eqNullSafe(F.col("of")))
        .where("before <= rest and upto > rest")
        .groupBy("pattern", "of", "passes", "rest")
        .agg(F.min(F.struct("cell", "before")).alias("edge"))
    )
    marks = edges.select("of", "pattern", "passes", "rest", F.col("edge.cell").alias("edge_cell"), F.col("edge.before").alias("edge_before"))
    placed = rows.join(F.broadcast(marks), F.col("members").eqNullSafe(F.col("of")), "left")  # at most most_patterns rows
    at_edge = running(placed.where("cell = edge_cell"), "pattern", ["place", "key", "size"], F.col("size"), "ahead").withColumn("ahead", F.col("edge_before") + F.col("ahead"))
    at_edge = at_edge.withColumn("extra", (2 * F.col("ahead") + F.col("size") <= 2 * F.col("rest")).cast("int"))
    others = placed.where("not coalesce(cell = edge_cell, false)").withColumn("extra", F.coalesce((F.col("cell") < F.col("edge_cell")).cast("int"), F.lit(0)))
    columns = ["key", "members", "size", "carry", (F.coalesce("passes", F.lit(0)) + F.col("extra")).alias("copies")]
    out = at_edge.select(columns).unionByName(others.select(columns))
    table = [(s, int(sizes[s]), float(targets[s])) for s in ordered]
    return out, spark.createDataFrame(table, "source string, source_size long, target double")


def text_md5() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def cycle_weights(sources: list) -> dict:
    """Weights 5, 2, 1, repeating, to sources in their order."""
    return {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: whole copies, 0, 1 or 2 of each.

    Null text: size 0. A null source is a source of its own, sorted last. Rows with one id, or none, are told apart by their
    texts; repeated rows count and are taken each on their own. Very long texts are counted whole. An empty table gives no
    rows; other columns are not read.
    """
    mixed, sources = mix(docs, F.array("source"), n_words_of(F.col("text"), BLANK_WORD), cycle_weights, tie=text_md5(), **options)
    rows = mixed.select(F.col("key").alias("doc_id"), F.element_at("members", 1).alias("of"), "size", (F.col("copies") * F.col("size")).alias("taken"))
    return rows.join(F.broadcast(sources), F.col("of").eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", "taken")


def members_by_text(docs: DataFrame) -> DataFrame:
    """(tag, members): for each text, by its MD5, all sources in which an equal one occurs, sorted, null last; null texts are empty.

    A text's sources are a set, so that a group of copies is as many names as there are sources, however large it is.
    """
    named = docs.select(text_md5().alias("tag"), "source").distinct()
    by_name = F.array_sort(F.array_agg(F.struct(F.col("source").isNull().alias("none"), "source")))
    return named.groupBy("tag").agg(F.transform(by_name, lambda s: s["source"]).alias("members"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, with all its columns. Documents taken 0 times go.

    Each row is taken by itself, whether its doc_id is null or repeated and whatever else equals it. Null and empty texts
    have no words and are taken as their place in the order says. Very long texts are counted whole. An empty table gives no
    rows; all columns stay, whatever their names.
    """
    row = F.struct(*[docs[c] for c in docs.columns])
    mixed, _ = mix(docs, F.array("source"), n_words_of(F.col("text"), BLANK_WORD), cycle_weights, tie=F.xxhash64(row).cast("string"), carry=row, **options)
    each = mixed.where("copies > 0").select("carry", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select(*[F.col("carry").getField(c).alias(c) for c in docs.columns])
