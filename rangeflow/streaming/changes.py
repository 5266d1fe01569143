"""Change capture with Structured Streaming.

Every micro-batch of the log is planned and stored under its number, so a batch
that is delivered again replaces itself.  Plans can be compacted, so that what is
read grows with the table and not with its history.  The table is what applying
all stored plans gives: nothing is lost between batches, and a range delete whose bounds
fall into two batches is still one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rangeflow.operators import cdc
from rangeflow.sources.schema import TableSchema
from rangeflow.sources.storage import folders, move, remove


def capture(log: DataFrame, schema: TableSchema, folder: str, seen: Callable[[int, dict], None] | None = None, start_us: int | None = None) -> StreamingQuery:
    """Plans all of a log stream that is there, then ends; run again, it goes on where it ended.

    Changes before ``start_us`` are passed over.  ``seen`` is told of each
    batch: its number, what it asks for, and how many of its range bounds have no
    partner in it.
    """

    def store(batch: DataFrame, number: int) -> None:
        planned = cdc.plan(batch if start_us is None else batch.where(F.col("time") >= start_us), schema)
        planned.write.mode("overwrite").parquet(f"{folder}/plans/batch={number}")
        if seen:
            kept = batch.sparkSession.read.parquet(f"{folder}/plans/batch={number}")
            seen(number, cdc.counters(kept).first().asDict() | (cdc.unpaired(kept, schema).first().asDict() if schema.clustering else {}))

    return log.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()


def plans(spark: SparkSession, schema: TableSchema, folder: str) -> DataFrame:
    """All captured plans: the newest compacted ones and the batches after them; none of an empty log."""
    bases = [int(n.removeprefix("upto=")) for n in folders(spark, f"{folder}/base")]
    numbers = [int(n.removeprefix("batch=")) for n in folders(spark, f"{folder}/plans")]
    upto = max(bases, default=-1)
    paths = [f"{folder}/base/upto={upto}"] * bool(bases) + [f"{folder}/plans/batch={n}" for n in sorted(numbers) if n > upto]
    out = cdc.no_plans(spark, schema)
    return spark.read.schema(out.schema).parquet(*paths) if paths else out


def compact(spark: SparkSession, schema: TableSchema, folder: str) -> int | None:
    """Writes the plans so far with fewer rows, so that reading the table no longer takes the whole history; gives the last batch in them.

    The old batches stay until ``drop_compacted``: a reader may be at them.
    """
    numbers = [int(n.removeprefix("batch=")) for n in folders(spark, f"{folder}/plans")]
    if not numbers:
        return None
    upto = max(numbers)
    cdc.compact(plans(spark, schema, folder), schema).write.mode("overwrite").parquet(f"{folder}/base-next")
    move(spark, f"{folder}/base-next", f"{folder}/base/upto={upto}")
    return upto


def drop_compacted(spark: SparkSession, folder: str) -> int:
    """Removes batches and older compactions that the newest compaction holds; gives how many."""
    bases = sorted(int(n.removeprefix("upto=")) for n in folders(spark, f"{folder}/base"))
    old = [f"{folder}/base/upto={n}" for n in bases[:-1]]
    old += [f"{folder}/plans/{n}" for n in folders(spark, f"{folder}/plans") if bases and int(n.removeprefix("batch=")) <= bases[-1]]
    for path in old:
        remove(spark, path)
    return len(old)


def table(spark: SparkSession, schema: TableSchema, folder: str, snapshot: DataFrame | None = None) -> DataFrame:
    """The captured table: the snapshot, if any, with all stored plans applied."""
    return cdc.apply(plans(spark, schema, folder), schema, snapshot)


def cut_over(make_log: Callable[[], DataFrame], schema: TableSchema, folder: str, confirm: Callable[[], bool], start_us: int | None = None) -> bool:
    """Catches up, asks, and catches up once more with what came meanwhile; false if the answer was no."""
    capture(make_log(), schema, folder, start_us=start_us).awaitTermination()
    if not confirm():
        return False
    capture(make_log(), schema, folder, start_us=start_us).awaitTermination()
    return True


def windowed_counts(stream: DataFrame, time: str = "ts", window_s: int = 60, safety_s: int = 30) -> DataFrame:
    """Changes by fixed window of a stream; rows later than the safety interval are left out, as state must end."""
    typed = stream.withColumn("_time", F.col(time).cast("timestamp"))
    counted = typed.withWatermark("_time", f"{safety_s} seconds").groupBy(F.window("_time", f"{window_s} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n_changes"))
    return counted.select(F.col("w.start").alias("window_start"), "n_changes")


def mutations(stream: DataFrame, schema: TableSchema, source: Callable[[DataFrame], None], target: Callable[[DataFrame], None], offsets: str, require_both: bool = True) -> StreamingQuery:
    """Writes planned JSON mutations to two sinks in order, batch by batch."""
    from rangeflow.operators import dualwrite

    def both(batch: DataFrame, _: int) -> None:
        dualwrite.write_both(dualwrite.plan(batch, schema), source, target, require_both)

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", offsets).trigger(availableNow=True).start()
