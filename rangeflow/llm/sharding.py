"""Resharding by minimum-cost flow.

Rows are gathered into blocks by a hash of the text, so equal texts share a
block; a block that weighs more than a small part of a shard is split by
another hash of the text.  Only a text whose own copies in one shard weigh more
than a large part of a shard is split by row.  From the sizes of the old shards
and the capacities of the new ones a minimum-cost flow gives how many bytes go
from where to where, with the fewest moved; whole blocks then make up each
flow.  What the driver holds is one row a block, and their number is bounded by
parameters, not by the input.

``reshard_files`` does it to a table of shards, a folder each: the shards whose
rows change are written anew beside the old ones and then take their places,
the others' files are left alone.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeflow.llm.common import checkpoint_dir, cut, fresh, remove_folder, table

BLOCKS = 4096
PARTS = 64  # a block over this part of a shard is split by text
HOT_PARTS = 8  # a text whose copies are over this part of a shard is split by row
SLOT_ROWS = 1_000_000  # rows that are numbered in one task, about
NOWHERE = -1  # the old shard of rows that are in none
LAW = "bytes"


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """How much of each supply goes to each capacity so that all of it is placed at the least cost.

    Successive shortest paths: as long as something is left over, the cheapest
    path with room in the residual network carries as much as it can.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are too small")
    flow, left, room = [[0] * m for _ in range(n)], list(supply), list(capacity)
    while any(left):
        far = [0 if x else None for x in left] + [None] * m
        came: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] is not None and (far[n + j] is None or far[i] + cost[i][j] < far[n + j]):
                        far[n + j], came[n + j], changed = far[i] + cost[i][j], i, True
                    if flow[i][j] and far[n + j] is not None and (far[i] is None or far[n + j] - cost[i][j] < far[i]):
                        far[i], came[i], changed = far[n + j] - cost[i][j], n + j, True
        end = min((n + j for j in range(m) if room[j]), key=lambda v: far[v])
        path, v = [end], end
        while came[v] is not None:
            v = came[v]
            path.append(v)
        path.reverse()
        most = min(left[path[0]], room[end - n], *(flow[b][a - n] for a, b in zip(path, path[1:]) if a >= n))
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a][b - n] += most
            else:
                flow[b][a - n] -= most
        left[path[0]] -= most
        room[end - n] -= most
    return flow


def plan_transfers(blocks: dict[tuple, tuple[int, int]], n_shards: int) -> dict[tuple, int]:
    """The new shard of each block, for blocks with their old shard and their bytes; shards end near equal.

    Old shards past the new number have no room left and are emptied; blocks
    that are ``NOWHERE`` go where there is room.
    """
    total, n_old = sum(size for _, size in blocks.values()), max([n_shards, *(old + 1 for old, _ in blocks.values())])
    supply = [0] * (n_old + 1)
    held: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    for key, (old, size) in sorted(blocks.items()):
        old = n_old if old == NOWHERE else old
        supply[old] += size
        held[old].append((size, key))
    capacity = [total * (j + 1) // n_shards - total * j // n_shards for j in range(n_shards)]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(n_shards)] for i in range(n_old + 1)])
    place, sums = {}, [0] * n_shards

    def put(size: int, key: tuple, j: int) -> None:
        place[key] = j
        sums[j] += size

    for i, own in held.items():
        own.sort()
        for j in range(n_shards):
            want = flow[i][j] if i != j else 0
            while own and want >= own[0][0]:  # the largest block that fits
                size, key = own.pop(bisect_right(own, want, key=lambda x: x[0]) - 1)
                put(size, key, j)
                want -= size
        for size, key in reversed(own):
            put(size, key, i if i < n_shards else min(range(n_shards), key=sums.__getitem__))
    return _levelled(blocks, place, n_shards)


def _levelled(blocks: dict, place: dict[tuple, int], n_shards: int) -> dict[tuple, int]:
    """Moves single blocks from the fullest to the emptiest shard while that brings the two closer."""
    own: list[list[tuple[int, tuple]]] = [[] for _ in range(n_shards)]
    for key, j in place.items():
        own[j].append((blocks[key][1], key))
    sums = [sum(x for x, _ in o) for o in own]
    for o in own:
        o.sort()
    for _ in range(10 * len(blocks)):
        hi, lo = max(range(n_shards), key=sums.__getitem__), min(range(n_shards), key=sums.__getitem__)
        gap = sums[hi] - sums[lo]
        at = bisect_right(own[hi], gap / 2, key=lambda x: x[0])
        best = min((k for k in (at - 1, at) if 0 <= k < len(own[hi]) and 0 < own[hi][k][0] < gap), key=lambda k: abs(gap - 2 * own[hi][k][0]), default=None)
        if best is None:
            break
        size, key = own[hi].pop(best)
        own[lo].insert(bisect_right(own[lo], size, key=lambda x: x[0]), (size, key))
        sums[hi] -= size
        sums[lo] += size
        place[key] = lo
    return place


KEY = ["old_shard", "alone", "cell", "piece"]


class Placement:
    """Where the rows of each block go, planned from ``old_shard, print, size, row`` of all rows."""

    def __init__(self, narrow: DataFrame, n_shards: int, blocks: int = BLOCKS, parts: int = PARTS, hot_parts: int = HOT_PARTS) -> None:
        spark, self.blocks = narrow.sparkSession, blocks
        total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        limit, most = (max(1, total // (n_shards * x)) for x in (parts, hot_parts))
        # fewer than ``n_shards * hot_parts`` texts can weigh so much
        hot = narrow.groupBy("old_shard", "print").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("bytes") > most)).collect()
        self.hot = spark.createDataFrame([(r.old_shard, r.print, -(-r.bytes // limit)) for r in hot], "old_shard int, print long, row_pieces long")
        self.cuts = spark.createDataFrame([], "old_shard int, cell long, text_pieces long")
        whole = self.cells(narrow).where("not alone").groupBy("old_shard", "cell").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > limit).collect()  # at most a row a block and old shard
        self.cuts = spark.createDataFrame([(r.old_shard, r.cell, -(-r.bytes // limit)) for r in whole], "old_shard int, cell long, text_pieces long")
        sizes = {tuple(r[:4]): r.bytes for r in self.cells(narrow).groupBy(*KEY).agg(F.sum("size").alias("bytes")).collect()}
        self.place = plan_transfers({k: (k[0], size) for k, size in sizes.items()}, n_shards)
        self.to = spark.createDataFrame([(*k, j) for k, j in self.place.items()], "old_shard int, alone boolean, cell long, piece long, shard int")

    def cells(self, rows: DataFrame) -> DataFrame:
        """The rows with the block that each is in."""
        block = F.pmod("print", F.lit(self.blocks)).cast("long")
        found = rows.join(F.broadcast(self.hot), ["old_shard", "print"], "left").withColumn("alone", F.col("row_pieces").isNotNull())
        found = found.withColumn("cell", F.when(F.col("alone"), F.col("print")).otherwise(block)).join(F.broadcast(self.cuts), ["old_shard", "cell"], "left")
        piece = F.when(F.col("alone"), F.pmod(F.xxhash64("row"), F.col("row_pieces"))).otherwise(F.pmod(F.xxhash64("print", F.lit("piece")), F.coalesce("text_pieces", F.lit(1))))
        return found.withColumn("piece", piece.cast("long")).drop("row_pieces", "text_pieces")

    def apply(self, rows: DataFrame) -> DataFrame:
        """The rows with their ``shard``."""
        return self.cells(rows).join(F.broadcast(self.to), KEY).drop("alone", "cell", "piece")

    def affected(self) -> list[int]:
        """Shards that rows leave or come to."""
        return sorted({x for k, j in self.place.items() if k[0] != j for x in (k[0], j) if x != NOWHERE})


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, which counts each ``shard``'s rows from 0 without gaps; ``row`` tells rows apart."""
    rows = cut(rows)
    n = max(1, -(-rows.count() // SLOT_ROWS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n)))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "part", offset.alias("offset"))  # a row for each million of rows and shard
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row"))
    found = dealt.withColumn("nth", nth).join(offsets, ["shard", "part"])
    return found.withColumn("slot", F.col("offset") + F.col("nth") - 1).drop("part", "nth", "offset", "row")


def _narrow(rows: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), _size(text).alias("size"), crc.alias("text_crc32"), "old_shard", F.xxhash64(text).alias("print"), "row")


def reshard(docs: DataFrame, n_shards: int = 8, old: Column | None = None, n_old: int = 6, blocks: int = BLOCKS, parts: int = PARTS) -> DataFrame:
    """``doc_id, size, text_crc32, old_shard, shard, slot`` of every document, without writing anything.

    ``size`` is the bytes of the text plus one, of a null text one.  ``old`` is
    the column with the shard that a document is in, null for none; without it
    the layout is the hash of the text over ``n_old`` shards.  ``slot`` counts a
    shard's rows from 0 without gaps.  Equal texts in one old shard stay together
    unless all of them weigh more than ``1 / HOT_PARTS`` of a shard.  A very long
    text is a block of its own weight.  Rows that share an id are rows of their
    own; null ids are placed by their text; no rows give none.
    """
    row = docs.withColumns(dict(zip(fresh(docs, "row"), [F.monotonically_increasing_id()])))
    name = row.columns[-1]
    old = F.pmod(F.xxhash64(F.lit("old"), F.col("text").cast("string")), F.lit(n_old)) if old is None else F.coalesce(old, F.lit(NOWHERE))
    plain = row.select(F.col("doc_id"), F.col("text"), old.cast("int").alias("old_shard"), F.col(name).alias("row"))
    narrow = cut(_narrow(plain))
    return with_slots(Placement(narrow, n_shards, blocks, parts).apply(narrow).drop("print"))


def write_shards(docs: DataFrame, shard: Column, path: str) -> None:
    """Writes the documents with all columns as a folder for each shard, and a column that tells rows apart (``row``, or a name that does not clash)."""
    number, row = fresh(docs, "shard", "row")
    named = docs.withColumns({row: F.monotonically_increasing_id(), number: shard.cast("int")})
    named.write.partitionBy(number).parquet(path)


def reshard_files(spark: SparkSession, path: str, n_shards: int, row: str = "row", shard: str = "shard") -> Placement:
    """Reshards a table that ``write_shards`` wrote: plans the transfers, then rewrites the shards whose rows change.

    Rows are placed by what they hold, so null ids and rows that share an id
    stay what they are.  The new folders are complete before the first old one
    goes; the folder of a shard that is emptied goes too.
    """
    schema = spark.read.parquet(path).schema
    rows = lambda: spark.read.schema(schema).parquet(path).withColumnsRenamed({shard: "old_shard"} | ({row: "row"} if row != "row" else {}))
    placement = Placement(cut(_narrow(rows()).select("old_shard", "print", "size", "row")), n_shards)
    changed = placement.affected()
    if not changed:
        return placement
    own = fresh(rows(), "print", "alone", "cell", "piece")
    if own != ["print", "alone", "cell", "piece"]:
        raise ValueError("the table has columns named as those that resharding adds")
    mine = rows().where(F.col("old_shard").isin(changed)).withColumn("print", F.xxhash64(F.col("text").cast("string")))
    staged = f"{path}-staged-{uuid.uuid4().hex}"
    names = {"row": row, "shard": shard}
    placement.apply(mine).drop("print", "old_shard").withColumnsRenamed({a: b for a, b in names.items() if a != b}).write.partitionBy(shard).parquet(staged)
    jvm = spark.sparkContext._jvm
    folder = lambda base, k: jvm.org.apache.hadoop.fs.Path(f"{base}/{shard}={k}")
    store = folder(path, 0).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in changed:
        store.delete(folder(path, k), True)
        if store.exists(folder(staged, k)) and not store.rename(folder(staged, k), folder(path, k)):
            raise OSError(f"shard {k} of {staged} could not be moved")
    remove_folder(spark, staged)
    return placement


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lays the documents out in six shards, reshards the files to eight, and reads the rows from them."""
    docs, path = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    was = F.pmod(F.xxhash64(F.lit("old"), "text"), F.lit(6)).cast("int")
    write_shards(docs.select("doc_id", "text"), was, path)
    reshard_files(spark, path, 8)
    text = F.col("text")
    rows = spark.read.parquet(path).select("doc_id", _size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), "shard", "row", was.alias("old_shard"))
    found = with_slots(rows)  # what it reads is written out by then
    remove_folder(spark, path)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
