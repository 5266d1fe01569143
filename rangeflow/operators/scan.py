"""Range scans, units of rows and their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeflow.functions.tokens import unit_of
from rangeflow.plans.planner import TokenRange
from rangeflow.sources.schema import TableSchema

#: Ranges of an uneven plan that may be broadcast; a plan has few, but the number is checked.
MAX_BROADCAST_RANGES = 10_000

#: Bytes that a cell of a type counts for in estimates.
CELL_BYTES = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8}


def ordered(df: DataFrame, schema: TableSchema, *more: str) -> DataFrame:
    """The table's columns in canonical order, then others that are asked for."""
    return df.select(*(F.col(f"`{c.name}`") for c in schema.ordered), *more)


def with_token(df: DataFrame, token: Column, name: str = "_tok") -> DataFrame:
    return df.withColumn(name, token)


def range_scan(df: DataFrame, schema: TableSchema, over: TokenRange, token: str = "_tok") -> DataFrame:
    """Rows whose token is in (start, end], columns in canonical order and the token last.

    Where the token is a stored column the bounds reach the scan.
    """
    inside = (F.col(token) > F.lit(over.start)) & (F.col(token) <= F.lit(over.end))
    return ordered(df.where(inside), schema, token)


def assign_even(df: DataFrame, parent: TokenRange, units: int, token: str = "_tok", name: str = "unit") -> DataFrame:
    """Adds the number of the unit of an even plan, by arithmetic alone."""
    return df.withColumn(name, unit_of(token, (parent.start, parent.end), units))


def _unit_among(spans: list, token: Column) -> Column:
    """The unit of the span that holds the token, found in two steps of about the square root of their number; null outside."""
    if not spans:
        return F.lit(None).cast("int")
    width = max(1, round(len(spans) ** 0.5))
    parts = [spans[i : i + width] for i in range(0, len(spans), width)]
    coarse = F.size(F.filter(F.lit([p[0].token_start for p in parts]), lambda x: x < token))
    entry = F.array(*(F.array(*(F.struct(F.lit(r.token_start).cast("bigint").alias("lo"), F.lit(r.token_end).cast("bigint").alias("hi"), F.lit(r.unit).cast("int").alias("unit")) for r in p)) for p in parts))
    own = F.filter(F.element_at(entry, F.greatest(coarse, F.lit(1))), lambda x: (x["lo"] < token) & (token <= x["hi"]))
    return F.when(F.size(own) > 0, own[0]["unit"])


def assign_ranges(df: DataFrame, ranges: DataFrame, token: str = "_tok") -> DataFrame:
    """Adds ``unit`` of the range that holds the token, for plans of any shape.

    Ranges do not overlap; tokens outside all of them get null.  The plan is one
    row a unit and becomes a sorted array in the expression; past the size for
    that, ranges and rows meet in coarse cells of the token's upper bits.
    """
    spans = ranges.select("unit", "token_start", "token_end")
    inside = (F.col(token) > F.col("token_start")) & (F.col(token) <= F.col("token_end"))
    few = spans.orderBy("token_start").limit(MAX_BROADCAST_RANGES + 1).collect()  # a plan's rows, up to the limit
    if len(few) <= MAX_BROADCAST_RANGES:
        return df.withColumn("unit", _unit_among(few, F.col(token)))
    bits = 44  # cells of 2^44 tokens: about a million over the full ring
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.shiftright("token_start", bits), F.shiftright("token_end", bits))))
    near = df.withColumn("_cell", F.shiftright(token, bits)).join(cells, "_cell")
    found = near.where(inside).drop("_cell", "token_start", "token_end")
    held = spans.agg(F.min("token_start").alias("lo"), F.max("token_end").alias("hi"))  # one row
    outside = df.join(F.broadcast(held), (F.col(token) <= F.col("lo")) | (F.col(token) > F.col("hi")) | F.col(token).isNull()).drop("lo", "hi")
    return found.unionByName(outside.withColumn("unit", F.lit(None).cast("int")))


def cell_bytes(cell: Column, kind: T.DataType) -> Column:
    """Estimated bytes of one cell; null counts one."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size: Column = F.octet_length(cell)
    elif isinstance(kind, T.ArrayType):
        size = F.lit(4) + (F.size(cell) * CELL_BYTES[type(kind.elementType)] if type(kind.elementType) in CELL_BYTES else F.aggregate(cell, F.lit(0), lambda acc, x: acc + cell_bytes(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        entries = F.map_entries(cell)
        size = F.lit(4) + F.aggregate(entries, F.lit(0), lambda acc, e: acc + cell_bytes(e["key"], kind.keyType) + cell_bytes(e["value"], kind.valueType))
    elif isinstance(kind, T.StructType):
        size = F.lit(4)
        for f in kind.fields:
            size = size + cell_bytes(cell[f.name], f.dataType)
    elif isinstance(kind, T.DecimalType):
        size = F.lit(4) + F.ceil(F.length(F.regexp_replace(cell.cast("string"), "[^0-9]", "")) / F.lit(2.4)).cast("int")
    else:
        size = F.lit(CELL_BYTES.get(type(kind), 16))
    return F.when(cell.isNull(), F.lit(1)).otherwise(size)


def row_bytes(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Estimated bytes of a row."""
    total: Column = F.lit(0)
    for f in df.schema.fields:
        if columns is None or f.name in columns:
            total = total + cell_bytes(F.col(f"`{f.name}`"), f.dataType)
    return total.cast("bigint")


def unit_counts(df: DataFrame, units: DataFrame, token: str = "_tok") -> DataFrame:
    """For every unit of the plan its rows and the last token seen; units without rows are there with zero."""
    found = df.groupBy("unit").agg(F.count(F.lit(1)).alias("n_rows"), F.max(token).alias("last_token"))
    return units.join(F.broadcast(found), "unit", "left").select("unit", "token_start", "token_end", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "last_token")


def unit_sizes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumn("_bytes", row_bytes(df, columns)).groupBy("unit").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_bytes").alias("n_bytes"))


CELL_BITS = 44  # a unit is numbered in cells of so many lower bits of the token: about a million over the ring


def _numbered(df: DataFrame, group: str, order: list[str], weight: Column) -> DataFrame:
    """Adds ``_before``: the weight of all rows of the group that come before, by ``order``, which begins with the token.

    Cells of the token's upper bits are numbered each by itself, and the sums of
    the cells before are added; no task needs a whole group.  Only the rows of
    one token are in one place by need.
    """
    cell = df.withColumn("_cell", F.shiftright(F.col(order[0]).cast("bigint"), CELL_BITS)).withColumn("_weight", weight.cast("bigint"))
    sums = cell.groupBy(group, "_cell").agg(F.sum("_weight").alias("_sum"))
    before = lambda w: F.coalesce(F.sum(w[0]).over(Window.partitionBy(*w[1]).orderBy(*w[2]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col(group).alias("_group"), F.col("_cell").alias("_at"), before(("_sum", [group], ["_cell"])).alias("_offset"))
    inner = cell.withColumn("_inner", before(("_weight", [group, "_cell"], order)))
    found = inner.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_cell") == F.col("_at")))
    return found.withColumn("_before", F.col("_inner") + F.col("_offset")).drop("_cell", "_weight", "_group", "_at", "_offset", "_inner")


def in_chunks(df: DataFrame, group: str, order: list[str], rows: int) -> DataFrame:
    """Adds ``chunk``: write batches of ``rows`` rows within each unit, in order; ``order`` begins with the token."""
    return _numbered(df, group, order, F.lit(1)).withColumn("chunk", F.floor(F.col("_before") / F.lit(rows)).cast("int")).drop("_before")


def in_sized_chunks(df: DataFrame, group: str, order: list[str], most: int, size: str = "_bytes") -> DataFrame:
    """Adds ``chunk``: batches that start whenever the running bytes of a unit pass a multiple of ``most``.

    A batch so holds at most ``most`` bytes and one row more; no batch needs to
    be split when it is written.
    """
    return _numbered(df, group, order, F.col(size)).withColumn("chunk", F.floor(F.col("_before") / F.lit(most)).cast("int")).drop("_before")


def schema_frame(spark: SparkSession, schema: TableSchema) -> DataFrame:
    """Columns of a table as rows, in canonical order."""
    found = [(k, c.name, c.cql_type, c.kind.value, c.position) for k, c in enumerate(schema.ordered)]
    return spark.createDataFrame(found, "ordinal int, name string, cql_type string, kind string, position int")
