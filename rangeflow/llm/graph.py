"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeflow.llm.common import cut, emit, rows

FEW = 1 << 16  # links that one task joins, in about 10 MB; more are contracted by all tasks first


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, root`` of the links ``a, b``."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in rows(batches):
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    yield from emit(((x, top(x)) for x in list(parent)), pa.schema([("node", pa.int64()), ("root", pa.int64())]), size=10_000)


def components(links: DataFrame, few: int | None = None) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (long); ``root`` is one node of the component.

    Each round gives the nodes a new random order by a hash, hooks every node to
    its first neighbour if that comes before itself, follows the hooks to a depth
    of four, and goes on with the links between what the nodes have become.  The
    nodes that still have links shrink by a constant factor a round, chains
    included; once there are no more than ``few`` links, one task joins them.
    The first neighbour is found before the shuffle, so a node with very many
    neighbours costs no task more than its own links.  Loops and repeated links
    do no harm; rows with nulls are left out; no links give no rows.
    """
    few = FEW if few is None else few
    left = cut(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    rounds = []
    while left.limit(few + 1).count() > few:
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("at"), F.col(c).alias("to"))
        both = left.select("a", "b").union(left.select("b", "a"))
        step = both.groupBy("a").agg(F.min(place("b")).alias("first")).select(F.col("a").alias("node"), F.least(place("a"), F.col("first"))["to"].alias("to"))
        step = cut(step)
        for _ in range(2):
            step = step.join(step.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"))
        step = cut(step)
        rounds.append(step)
        for end in ("a", "b"):
            left = left.join(step.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end)
        left = cut(left.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct())
    last = left.coalesce(1).mapInArrow(_joined, "node long, root long")
    if not rounds:
        return last
    found = rounds[0].withColumnRenamed("to", "root")
    for step in [*rounds[1:], last.withColumnRenamed("root", "to")]:
        found = found.join(step.select(F.col("node").alias("root"), F.col("to").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
