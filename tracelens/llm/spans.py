"""Classes of linked rows within groups of any size, without comparing rows that are connected already.

A group that fits into one task is compared there. A larger one is cut into blocks by a hash of the row. First each block
finds its own classes, then one representative of each class is compared with those of other blocks, again in blocks, as
long as that joins many. Mostly a family of copies is one class by then, and nothing is left to do. Otherwise links between
different classes may be left, so each pair of blocks is compared, but for pairs within the group's largest class: its rows
meet the blocks of the others only. Nothing is lost; a group whose rows aren't linked needs each pair of blocks in the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import materialise
from tracelens.llm.components import connected_components

#: (rows of a task, class of each row) -> for each row the place of a row of its joined class.
Compare = Callable[[pd.DataFrame, np.ndarray], np.ndarray]
#: Narrow rows, of under 64 bytes, that are broadcast to the payload rather than shuffled with it.
FEW_ROWS = 100_000
#: How many times the rows that a block of the first rounds holds those of the last one hold.
WIDER = 4
#: Share of representatives that a round must join for another one to follow.
WORTH = 0.3


@dataclass(frozen=True)
class Room:
    """What a block may hold, in rows and in bytes."""

    rows: int
    size: int

    def blocks(self, rows: Column, size: Column) -> Column:
        return F.greatest(F.ceil(rows / self.rows), F.ceil(size / self.size), F.lit(1)).cast("int")


def _with_payload(rows: DataFrame, payload: DataFrame) -> DataFrame:
    """Adds the payload of each fp; where the rows are few they go to it, so that it isn't shuffled once more."""
    rows = materialise(rows, "rows")
    return (F.broadcast(rows) if rows.count() <= FEW_ROWS else rows).join(payload, "fp")


def _block(count: Column) -> Column:
    return F.pmod(F.xxhash64("fp"), count).cast("int")


def _classes(members: DataFrame, payload: DataFrame, compare: Compare, room: Room) -> DataFrame:
    """(grp, fp, size, blocks, to): what each row (grp, fp, size) is linked to within its block; itself if to nothing before it."""
    sized = members.groupBy("grp").agg(room.blocks(F.count(F.lit(1)), F.sum("size")).alias("blocks"))
    rows = _with_payload(members.join(sized, "grp").withColumn("block", _block(F.col("blocks"))), payload)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("fp")
        to = compare(rows, np.arange(len(rows)))
        return pd.DataFrame({"grp": rows["grp"], "fp": rows["fp"], "size": rows["size"], "blocks": rows["blocks"], "to": rows["fp"].to_numpy()[to]})

    return materialise(rows.groupBy("grp", "block").applyInPandas(work, "grp long, fp long, size long, blocks int, to long"), "classes")


def _links(classes: DataFrame) -> DataFrame:
    return classes.where("fp <> to").select(F.col("fp").alias("a"), F.col("to").alias("b"))


def _cross_pairs(members: DataFrame, links: DataFrame, room: Room) -> DataFrame:
    """(grp, side, i, j, fp, cls): the tasks in which members (grp, fp, size) of different classes meet."""
    of = connected_components(links).select(F.col("node").alias("fp"), F.col("root").alias("cls"))
    named = materialise(members.join(of, "fp", "left").withColumn("cls", F.coalesce("cls", "fp")), "members")
    sums = named.groupBy("grp", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    groups = sums.groupBy("grp").agg(F.max(F.struct("n", "size", "cls")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > top.n")
    groups = groups.select("grp", F.col("top.cls").alias("top"), room.blocks(F.col("top.n"), F.col("top.size")).alias("ka"), room.blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("kb"))
    placed = named.join(groups, "grp").withColumn("big", F.col("cls") == F.col("top"))
    placed = placed.withColumn("block", _block(F.when(F.col("big"), F.col("ka")).otherwise(F.col("kb"))))
    tasks = lambda n, task: F.transform(F.sequence(F.lit(0), n - 1), task)
    key = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    block = F.col("block")
    others = F.filter(tasks(F.col("kb"), lambda k: key(1, F.least(block, k), F.greatest(block, k))), lambda t: (t["i"] < t["j"]) | (F.col("kb") == 1))
    mine = F.when(F.col("big"), tasks(F.col("kb"), lambda k: key(0, block, k))).otherwise(F.concat(tasks(F.col("ka"), lambda k: key(0, k, block)), others))
    return placed.select("grp", "fp", "cls", F.explode(mine).alias("task")).select("grp", "task.*", "fp", "cls")


def spanning_links(members: DataFrame, payload: DataFrame, compare: Compare, room: Room) -> DataFrame:
    """(a, b): links that span all classes of linked rows in each group of `members` (grp, fp, size); `payload` has a row for each fp."""
    first = _classes(members, payload, compare, room)
    links, opened = _links(first), first.where("blocks > 1")
    if opened.isEmpty():
        return links
    joined, last = _links(opened), opened
    while True:
        leaders = last.where("fp = to").select("grp", "fp", "size")
        before = leaders.count()
        last = _classes(leaders, payload, compare, room)
        joined = joined.unionByName(_links(last))
        if last.where("fp = to").count() > before * (1 - WORTH) or last.where("blocks > 1").isEmpty():
            break
    pairs = _cross_pairs(opened.select("grp", "fp", "size"), joined, Room(WIDER * room.rows, WIDER * room.size))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("fp")
        to, fps = compare(rows, np.unique(rows["cls"], return_inverse=True)[1]), rows["fp"].to_numpy()
        apart = rows["cls"].to_numpy()[to] != rows["cls"].to_numpy()
        return pd.DataFrame({"a": fps[apart], "b": fps[to[apart]]})

    crossed = _with_payload(pairs, payload).groupBy("grp", "side", "i", "j").applyInPandas(work, "a long, b long")
    return links.unionByName(joined).unionByName(materialise(crossed, "crossed"))
