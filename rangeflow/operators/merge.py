"""Merging versions of rows and cells: the last write wins, counters add up, elements are put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeflow.sources.schema import TableSchema


def last_write_wins(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the version that is last by ``order``, which must tell all versions of a key apart.

    The last is found as a maximum, so partial results meet before the shuffle and
    a key with very many versions costs no task more than any other.
    """
    rest = [c for c in versions.columns if c not in keys]
    last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(*order)).alias("_last")  # what is carried need have no order
    found = versions.groupBy(*keys).agg(last)
    return found.select(*(c if c in keys else F.col(f"_last.{c}").alias(c) for c in versions.columns))


def to_cells(rows: DataFrame, keys: list[str], columns: dict[str, Column], writetime: Column, deleted: dict[str, Column] | None = None) -> DataFrame:
    """``keys, name, value, writetime, deleted``: a row for each present cell or tombstone; values as canonical text."""
    cell = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"), writetime.alias("writetime"), (deleted or {}).get(n, F.lit(False)).alias("deleted"))
    every = F.array(*(cell(n, v.cast("string")) for n, v in columns.items()))
    there = F.filter(every, lambda c: c["value"].isNotNull() | c["deleted"])
    return rows.select(*keys, F.explode(there).alias("_cell")).select(*keys, "_cell.*")


def merge_cells(cells: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row a key with the winner of each cell: latest write time, then tombstone before value, then larger text."""
    def best(name: str) -> Column:
        won = F.max(F.when(F.col("name") == name, F.struct("writetime", "deleted", F.when(~F.col("deleted"), F.col("value")).alias("value"))))
        return won.alias(f"_{name}")

    found = cells.groupBy(*keys).agg(*map(best, names))
    return found.select(*keys, *(c for n in names for c in (F.col(f"`_{n}`")["value"].alias(n), F.col(f"`_{n}`")["writetime"].alias(f"_wt_{n}"))))


def merge_counters(deltas: DataFrame, schema: TableSchema) -> DataFrame:
    """Totals of the counter columns by primary key, to be written over what is there: replays change nothing."""
    keys = [c.name for c in schema.primary_key]
    return deltas.groupBy(*keys).agg(*(F.coalesce(F.sum(c.name), F.lit(0)).alias(c.name) for c in schema.counters))


def row_writetime(columns: list[Column]) -> Column:
    """The latest of the columns' write times; null where all are."""
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def row_ttl(columns: list[Column]) -> Column:
    """The longest of the columns' lifetimes in seconds; 0, which is no expiry, where there is none."""
    return F.coalesce(row_writetime(columns), F.lit(0))


def expires_at(writetime: Column, ttl: Column) -> Column:
    """Microseconds at which a row ends; null for never."""
    return F.when(ttl > 0, writetime + ttl.cast("bigint") * 1_000_000)


def preserve(rows: DataFrame, schema: TableSchema, frozen: bool = False, job_time: Column | None = None) -> DataFrame:
    """Canonical columns with ``_writetime`` and ``_ttl`` of the row, from companions ``_wt_<column>`` and ``_ttl_<column>``.

    A row without any write time gets the time of the job, if given.
    """
    names = [c.name for c in schema.preservable(frozen)]
    own = lambda prefix: [F.col(f"{prefix}{n}") for n in names if f"{prefix}{n}" in rows.columns]
    wt, ttl = own("_wt_"), own("_ttl_")
    written = row_writetime(wt) if wt else F.lit(None).cast("bigint")
    if job_time is not None:
        written = F.coalesce(written, job_time)
    return rows.select(*(F.col(f"`{c.name}`") for c in schema.ordered), written.alias("_writetime"), (row_ttl(ttl) if ttl else F.lit(0)).cast("int").alias("_ttl"))


def explode_elements(rows: DataFrame, schema: TableSchema) -> DataFrame:
    """``keys, column, kind, element, value`` of all open maps and sets, with the row's write time and lifetime.

    A null collection has no elements; lists have none that could be addressed.
    """
    keys = [c.name for c in schema.primary_key]
    parts = []
    for c in schema.element_columns("map", "set"):
        base = rows.where(F.col(c.name).isNotNull())
        if c.type.head == "map":
            parts.append(base.select(*keys, "_writetime", "_ttl", F.lit(c.name).alias("column"), F.lit("map").alias("kind"), F.explode(F.map_entries(c.name)).alias("_e")).select(*keys, "column", "kind", F.col("_e.key").cast("string").alias("element"), F.col("_e.value").cast("string").alias("value"), "_writetime", "_ttl"))
        else:
            parts.append(base.select(*keys, "_writetime", "_ttl", F.explode(c.name).alias("_e"), F.lit(c.name).alias("column"), F.lit("set").alias("kind")).select(*keys, "column", "kind", F.col("_e").cast("string").alias("element"), F.lit(None).cast("string").alias("value"), "_writetime", "_ttl"))
    return reduce(DataFrame.unionByName, parts)


def with_element_times(elements: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """Elements with their own ``writetime`` and ``ttl`` where ``times`` has them, else the row's."""
    on = [*keys, "column", "element"]
    own = times.select(*on, F.col("writetime").alias("_own_wt"), F.col("ttl").alias("_own_ttl"))
    found = elements.join(own, on, "left")
    return found.select(*on, "kind", "value", F.coalesce("_own_wt", "_writetime").alias("writetime"), F.coalesce("_own_ttl", "_ttl").alias("ttl"))


def rebuild_maps(elements: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, column, entries``: the winner of each element by write time, entries sorted; a row's collection is one cell."""
    won = elements.groupBy(*keys, "column", "element").agg(F.max_by("value", F.struct("writetime", F.coalesce("value", F.lit("")))).alias("value"))
    return won.groupBy(*keys, "column").agg(F.array_sort(F.collect_list(F.struct("element", "value"))).alias("entries"))


def rebuild_sets(elements: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, column, entries``: the elements of each set, sorted; one that a later write removed (``deleted``) is left out."""
    gone = F.col("deleted") if "deleted" in elements.columns else F.lit(False)
    won = elements.groupBy(*keys, "column", "element").agg(F.max(F.struct("writetime", gone.alias("gone"))).alias("_last"))
    return won.groupBy(*keys, "column").agg(F.array_sort(F.collect_list(F.when(~F.col("_last.gone"), F.col("element")))).alias("entries"))
