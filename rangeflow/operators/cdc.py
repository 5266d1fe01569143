"""Change logs: planning what each change does, and applying plans to a snapshot.

A log row has ``op``, the key columns, the data columns (null for absent
cells), ``deleted`` with the names of deleted cells, a ``time`` in microseconds
and a ``seq`` that tells rows of one time apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeflow.operators.merge import merge_cells
from rangeflow.sources.schema import TableSchema
from rangeflow.sources.storage import written

PRE_IMAGE, POST_IMAGE = "pre_image", "post_image"
INSERT, UPDATE = "row_insert", "row_update"
DELETE_ROW, DELETE_PARTITION = "row_delete", "partition_delete"
LEFT_INCLUSIVE, LEFT_EXCLUSIVE = "range_start_inclusive", "range_start_exclusive"
RIGHT_INCLUSIVE, RIGHT_EXCLUSIVE = "range_end_inclusive", "range_end_exclusive"
UPSERTS = (INSERT, UPDATE, POST_IMAGE)
BOUNDS = (LEFT_INCLUSIVE, LEFT_EXCLUSIVE, RIGHT_INCLUSIVE, RIGHT_EXCLUSIVE)
SALTS = 16  # tasks that the rows of one partition are spread over where deletions are matched
OPERATIONS = (PRE_IMAGE, *UPSERTS, DELETE_ROW, DELETE_PARTITION, *BOUNDS)


def _required(schema: TableSchema) -> Column:
    """Fails the batch on a missing key; such a change is never skipped."""
    partition = [F.col(c.name).isNull() for c in schema.partition_key]
    clustering = [F.col(c.name).isNull() for c in schema.clustering]
    some = lambda parts: F.lit(False) if not parts else parts[0] if len(parts) == 1 else parts[0] | some(parts[1:])
    bad = (F.col("op") != PRE_IMAGE) & (some(partition) | (F.col("op").isin(*UPSERTS, DELETE_ROW) & some(clustering)))
    unknown = ~F.col("op").isin(*OPERATIONS) | F.col("op").isNull()
    return F.when(bad, F.raise_error(F.lit("a change lacks a key column"))).when(unknown, F.raise_error(F.lit("unknown kind of change"))).otherwise(F.lit(True))


def plan(log: DataFrame, schema: TableSchema) -> DataFrame:
    """``action, keys, cells, columns, time, seq``: what each change asks for, in one or two rows.

    Inserts, updates and post-images upsert their cells that are there and that
    the table knows; deleted cells ask for ``delete_columns`` besides, and alone
    if nothing else is there.  Pre-images ask for nothing (``ignore``), and so
    does a range bound without any clustering value.
    """
    if not schema.clustering:
        log = log.withColumn("op", F.when(F.col("op").isin(*BOUNDS), F.raise_error(F.lit("range deletes need clustering columns"))).otherwise(F.col("op")))
    keys = [c.name for c in schema.primary_key]
    data = [c.name for c in schema.data if c.name in log.columns]
    cell = lambda n: F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value"))
    cells = F.filter(F.array(*map(cell, data)), lambda c: c["value"].isNotNull())
    gone = F.array_sort(F.array_intersect(F.coalesce("deleted", F.array().cast("array<string>")), F.array(*map(F.lit, data))))
    no_cells, no_names = F.array().cast("array<struct<name:string,value:string>>"), F.array().cast("array<string>")
    act = lambda name, c=no_cells, d=no_names: F.struct(F.lit(name).alias("action"), c.alias("cells"), d.alias("columns"))
    upsert, drop = act("upsert", F.col("_cells")), act("delete_columns", no_cells, F.col("_gone"))
    bounded = F.coalesce(*(F.col(c.name).cast("string") for c in schema.clustering)).isNotNull() if schema.clustering else F.lit(False)
    actions = (
        F.when(F.col("op").isin(*UPSERTS), F.when(F.size("_gone") == 0, F.array(upsert)).when(F.size("_cells") == 0, F.array(drop)).otherwise(F.array(upsert, drop)))
        .when(F.col("op") == DELETE_ROW, F.array(act("delete_row")))
        .when(F.col("op") == DELETE_PARTITION, F.array(act("delete_partition")))
        .when(F.col("op").isin(*BOUNDS) & bounded, F.array(act("delete_range")))
        .otherwise(F.array(act("ignore")))
    )
    checked = log.where(_required(schema)).withColumns({"_cells": cells, "_gone": gone})
    return checked.withColumn("_act", F.explode(actions)).select("_act.action", "op", *keys, "_act.cells", "_act.columns", "time", "seq")


def counters(planned: DataFrame) -> DataFrame:
    """One row: actions applied and ignored, and of the applied ones upserts and deletes."""
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    action = F.col("action")
    return planned.agg(n(action != "ignore", "applied"), n(action == "ignore", "ignored"), n(action == "upsert", "upserts"), n(action.startswith("delete"), "deletes"))


def _position(values: list[Column], end: Column) -> Column:
    """A place in the order of a partition's rows: a row's, or before (0) or after (2) all rows that begin with a bound's values."""
    parts, there = [], F.lit(True)
    for k, v in enumerate(values):
        there = there & v.isNotNull()
        parts += [F.when(there, 1).otherwise(end).alias(f"r{k}"), F.when(there, v).alias(f"v{k}")]
    return F.struct(*parts, end.cast("int").alias("tail"))


def _paired(planned: DataFrame, schema: TableSchema) -> DataFrame:
    """The range bounds with the one that follows and the kind of the one before, in their partition by time."""
    partition, clustering = [c.name for c in schema.partition_key], [c.name for c in schema.clustering]
    order = Window.partitionBy(*partition).orderBy("time", "seq")
    after = {f"_next_{c}": F.lead(c).over(order) for c in ("op", "time", *clustering)}
    return planned.where("action = 'delete_range'").withColumns(after | {"_last_op": F.lag("op").over(order)})


_LEFT, _RIGHT = (LEFT_INCLUSIVE, LEFT_EXCLUSIVE), (RIGHT_INCLUSIVE, RIGHT_EXCLUSIVE)


def pair_bounds(planned: DataFrame, schema: TableSchema) -> DataFrame:
    """Intervals ``partition key, low, high, time`` from range bounds: a left bound and the right bound that follows it in its partition.

    ``low`` and ``high`` are places among the partition's rows.  A bound has
    values for some leading clustering columns: rows are compared with those, in
    order, so columns in which both bounds agree must be equal and the first in
    which they part decides.  A bound without partner gives no interval, for
    alone it would delete what the writer never named; ``unpaired`` counts them.
    """
    partition, clustering = [c.name for c in schema.partition_key], [c.name for c in schema.clustering]
    low = _position([F.col(c) for c in clustering], F.when(F.col("op") == LEFT_EXCLUSIVE, 2).otherwise(0))
    high = _position([F.col(f"_next_{c}") for c in clustering], F.when(F.col("_next_op") == RIGHT_INCLUSIVE, 2).otherwise(0))
    pairs = _paired(planned, schema).where(F.col("op").isin(*_LEFT) & F.col("_next_op").isin(*_RIGHT))
    return pairs.select(*partition, low.alias("low"), high.alias("high"), F.col("_next_time").alias("time")).where("low < high")


def unpaired(planned: DataFrame, schema: TableSchema) -> DataFrame:
    """One row: the range bounds, and those of them without partner, which delete nothing."""
    op, paired = F.col("op"), (F.col("op").isin(*_LEFT) & F.col("_next_op").isin(*_RIGHT)) | (F.col("op").isin(*_RIGHT) & F.col("_last_op").isin(*_LEFT))
    return _paired(planned, schema).agg(F.count(op).alias("bounds"), F.count(F.when(~F.coalesce(paired, F.lit(False)), 1)).alias("unpaired"))


def _swept(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows ``partition key, place, starts, time, id`` in order of the first two; from each place on the latest time that is in force."""
    held, active, ended = None, [], set()
    schema, out = None, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def close() -> None:
        while active and active[0][1] in ended:
            ended.discard(heappop(active)[1])
        out.append((*held[0], held[1], -active[0][0] if active else None))

    for part in batches:
        schema = pa.schema([*(part.schema.field(i) for i in range(keys + 1)), pa.field("gone_at", pa.int64())])
        for *key, place, starts, time, number in zip(*(c.to_pylist() for c in part.columns)):
            if held is not None and held != (key, place):
                close()
                if held[0] != key:
                    active, ended = [], set()
                if len(out) >= 10_000:
                    yield batch()
                    out = []
            held = (key, place)
            if starts:
                heappush(active, (-time, number))
            else:
                ended.add(number)
    if held is not None:
        close()
        yield batch()


def _in_force(planned: DataFrame, schema: TableSchema) -> DataFrame:
    """``partition key, place, gone_at``: from each place on, up to the next of the partition, the latest deletion of a range or partition."""
    partition = [c.name for c in schema.partition_key]
    whole = [F.lit(None).cast(c.type.spark()) for c in schema.clustering]
    gone = planned.where("action = 'delete_partition'").groupBy(*partition).agg(F.max("time").alias("time"))
    spans = gone.select(*partition, _position(whole, F.lit(0)).alias("low"), _position(whole, F.lit(2)).alias("high"), "time")
    if schema.clustering:
        spans = pair_bounds(planned, schema).unionByName(spans)
    ends = F.array(F.struct(F.col("low").alias("place"), F.lit(True).alias("starts")), F.struct(F.col("high").alias("place"), F.lit(False).alias("starts")))
    each = spans.withColumn("id", F.monotonically_increasing_id()).select(*partition, F.explode(ends).alias("e"), "time", "id").select(*partition, "e.place", "e.starts", "time", "id")
    # by a struct: Spark takes the union as dealt out by the key, would drop a repartition by it, and then reads the two parts in different cuts
    sorted_ = each.repartition(F.struct(*partition)).sortWithinPartitions(*partition, "place")
    out = T.StructType([*(each.schema[c] for c in (*partition, "place")), T.StructField("gone_at", T.LongType())])
    n = len(partition)
    return sorted_.mapInArrow(lambda batches: _swept(batches, n), out)


MARKER, ROW = "", " row"  # names of a cell that says that the row was written, and of one that says that it was deleted


def _cells(planned: DataFrame, schema: TableSchema) -> DataFrame:
    """``keys, name, value, deleted, writetime`` of all that the plans say of single rows."""
    keys = [c.name for c in schema.primary_key]
    cell = "struct<name:string,value:string,deleted:boolean>"
    one = lambda name, value, deleted: F.struct(name.alias("name"), value.alias("value"), F.lit(deleted).alias("deleted"))
    of_upsert = F.transform("cells", lambda c: one(c["name"], c["value"], False))
    of_drop = F.transform("columns", lambda n: one(n, F.lit(None).cast("string"), True))
    said = lambda name: F.array(one(F.lit(name), F.lit(""), False))
    every = F.when(F.col("action") == "upsert", F.concat(of_upsert, said(MARKER))).when(F.col("action") == "delete_columns", of_drop).when(F.col("action") == "delete_row", said(ROW))
    named = planned.where(F.col("action").isin("upsert", "delete_columns", "delete_row"))
    return named.select(*keys, F.explode(every.cast(f"array<{cell}>")).alias("_c"), F.col("time").alias("writetime")).select(*keys, "_c.*", "writetime")


def apply(planned: DataFrame, schema: TableSchema, snapshot: DataFrame | None = None) -> DataFrame:
    """The rows that exist after all plans: ``keys`` and data columns as text.

    ``snapshot`` has keys, data columns and ``_writetime``; it counts as upserts
    of that time.  A cell's winner is the latest, a tombstone before a value,
    then the larger text.  It survives if no deletion that covers it is as late.
    A row exists if a cell or a row marker survives.  Applying the same plans
    twice changes nothing.

    The plans are written out once and read for each of their parts.  Deletions
    of ranges and partitions become places from which a time is in force; rows
    and places meet in one sort of each partition, so a row costs the same
    however many intervals cover it, and a hot partition's rows are salted.
    """
    keys, partition = [c.name for c in schema.primary_key], [c.name for c in schema.partition_key]
    names = [c.name for c in schema.data]
    planned = written(planned, "plans")
    cells = _cells(planned, schema)
    if snapshot is not None:
        one = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(False).alias("deleted"))
        had = F.array(*(one(n, F.col(n).cast("string")) for n in names), one(MARKER, F.lit("")))
        old = snapshot.select(*keys, F.explode(F.filter(had, lambda c: c["value"].isNotNull())).alias("_c"), F.col("_writetime").alias("writetime"))
        cells = cells.unionByName(old.select(*keys, "_c.*", "writetime"))
    found = merge_cells(cells, keys, [MARKER, ROW, *names]).withColumnsRenamed({MARKER: "_marker", f"_wt_{MARKER}": "_wt_marker", f"_wt_{ROW}": "_row_gone"}).drop(ROW)
    gone = F.col("_row_gone")
    if not planned.where(F.col("action").isin("delete_partition", "delete_range")).isEmpty():
        salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")
        marks = _in_force(planned, schema).select(*partition, "place", F.struct("gone_at").alias("_mark"), F.explode(F.lit(list(range(SALTS)))).alias("_salt"))
        rows = found.withColumns({"place": _position([F.col(c.name) for c in schema.clustering], F.lit(1)), "_salt": salt})
        both = rows.unionByName(marks, allowMissingColumns=True)
        order = Window.partitionBy(*partition, "_salt").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = both.withColumn("_range_gone", F.last("_mark", ignorenulls=True).over(order)["gone_at"]).where(F.col("_mark").isNull())
        gone = F.greatest("_row_gone", "_range_gone")
    alive = lambda wt: F.col(wt).isNotNull() & (gone.isNull() | (F.col(wt) > gone))
    cells_now = {n: F.when(alive(f"_wt_{n}"), F.col(n)) for n in names}
    exists = alive("_wt_marker")
    for n in names:
        exists = exists | cells_now[n].isNotNull()
    return found.where(exists).select(*keys, *(c.alias(n) for n, c in cells_now.items()))


def compact(planned: DataFrame, schema: TableSchema) -> DataFrame:
    """Plans that say the same with fewer rows: of each cell, row and partition only what is latest, and all range bounds.

    Applying them with any later or late plans gives what applying all would.
    """
    keys, partition = [c.name for c in schema.primary_key], [c.name for c in schema.partition_key]
    best = _cells(planned, schema).groupBy(*keys, "name").agg(F.max(F.struct("writetime", "deleted", "value")).alias("_best")).select(*keys, "name", "_best.*")
    no_cells, no_names = F.array().cast("array<struct<name:string,value:string>>"), F.array().cast("array<string>")
    seen = F.col("name") != MARKER
    upserts = best.where(~F.col("deleted") & (F.col("name") != ROW)).groupBy(*keys, "writetime").agg(F.collect_list(F.when(seen, F.struct("name", "value"))).alias("cells"))
    drops = best.where("deleted").groupBy(*keys, "writetime").agg(F.collect_list("name").alias("columns"))
    gone = best.where(F.col("name") == ROW)
    parts = planned.where("action = 'delete_partition'").groupBy(*partition).agg(F.max("time").alias("writetime"))
    for c in schema.clustering:
        parts = parts.withColumn(c.name, F.lit(None).cast(planned.schema[c.name].dataType))

    def rows(df: DataFrame, action: str, op: str) -> DataFrame:
        cell, column = (F.col(c) if c in df.columns else none for c, none in (("cells", no_cells), ("columns", no_names)))
        return df.select(F.lit(action).alias("action"), F.lit(op).alias("op"), *keys, cell.alias("cells"), column.alias("columns"), F.col("writetime").alias("time"), F.lit(0).cast("bigint").alias("seq"))

    out = planned.where("action = 'delete_range'").dropDuplicates(["op", *keys, "time", "seq"]).select("action", "op", *keys, "cells", "columns", "time", F.col("seq").cast("bigint").alias("seq"))
    for df, action, op in ((upserts, "upsert", UPDATE), (drops, "delete_columns", UPDATE), (gone, "delete_row", DELETE_ROW), (parts, "delete_partition", DELETE_PARTITION)):
        out = out.unionByName(rows(df, action, op))
    return out


def no_plans(spark: SparkSession, schema: TableSchema) -> DataFrame:
    """Plans of an empty log."""
    keys = ", ".join(f"`{c.name}` {c.type.spark().simpleString()}" for c in schema.primary_key)
    return spark.createDataFrame([], f"action string, op string, {keys}, cells array<struct<name:string,value:string>>, columns array<string>, time bigint, seq bigint")


def windows(log: DataFrame, window_s: int = 60, safety_s: int = 30, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """``window_start, n_changes`` of the fixed windows of a bounded catch-up.

    The log is read from ``start_us`` up to ``end_us``, or up to ``safety_s``
    before its last change, so rows that are still on their way are left to the
    next run.
    """
    width = window_s * 1_000_000
    last = log.agg((F.max("time") - F.lit(safety_s * 1_000_000)).alias("_last"))  # one row
    bounded = log.join(F.broadcast(last)).where(F.col("time") <= (F.lit(end_us) if end_us is not None else F.col("_last")))
    if start_us is not None:
        bounded = bounded.where(F.col("time") >= start_us)
    return bounded.groupBy((F.col("time") - F.pmod("time", F.lit(width))).alias("window_start")).agg(F.count(F.lit(1)).alias("n_changes"))


def start_of_catch_up(now_us: int, overlap_s: int = 60, start_at_us: int | None = None) -> int:
    """Where a catch-up begins: as told, else an overlap before ``now_us``, which is taken before the bulk copy begins; not below zero."""
    return max(0, start_at_us if start_at_us is not None else now_us - overlap_s * 1_000_000)
