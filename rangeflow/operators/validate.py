"""Validation: digests by range, samples, tolerances and column-level differences.

A unit's digest covers every row with its key, whatever the order in which
rows are read: the halves of the rows' digests are summed.  Sums meet before
the shuffle, so neither a large unit nor a hot key needs its rows in one place.
Since keys are unique and part of each row, two sides have equal digests just
where their rows sorted by key would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIFFS_PER_UNIT = 20
SAMPLE_ROWS = 1000
TOLERANCE_US = 1_000_000


class ValidationError(RuntimeError):
    pass


def _number_text(x: Column) -> Column:
    """A floating number by its exact significand and power of two, so that every engine says the same of the same bits; one NaN, one zero."""
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("int")
    part = size / F.pow(F.lit(2.0), guess)  # exact, for the divisor is a power of two
    power = guess + F.when(part >= 2, 1).when(part < 1, -1).otherwise(0)
    whole = size / F.pow(F.lit(2.0), power) * F.lit(float(2**52))
    text = F.concat(F.when(x < 0, "-").otherwise(""), whole.cast("bigint").cast("string"), F.lit("p"), power.cast("string"))
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(x == 0, "0").otherwise(text)


def cell_text(cell: Column, kind: T.DataType) -> Column:
    """A cell as text that is the same in every engine and differs where the values do; null for null.

    What a collection holds is framed like a cell, with the number of elements
    before it; a map's entries come in order of their keys' text.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(cell.isNotNull(), _number_text(cell.cast("double")))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(cell.cast("timestamp")).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(cell))
    if isinstance(kind, T.ArrayType):
        parts = F.transform(cell, lambda x: framed(cell_text(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.struct(framed(cell_text(e["key"], kind.keyType)).alias("k"), framed(cell_text(e["value"], kind.valueType)).alias("v"))
        parts = F.transform(F.array_sort(F.transform(F.map_entries(cell), entry)), lambda e: F.concat(e["k"], e["v"]))
    elif isinstance(kind, T.StructType):
        return F.when(cell.isNotNull(), F.concat(F.lit(f"{len(kind.fields)};"), *(framed(cell_text(cell[f.name], f.dataType)) for f in kind.fields)))
    else:
        return cell.cast("string")
    return F.when(cell.isNotNull(), F.concat(F.size(cell).cast("string"), F.lit(";"), F.array_join(parts, "")))


def framed(text: Column) -> Column:
    """Null apart from every value, and values framed by their length, so cells cannot run into each other."""
    return F.when(text.isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), F.length(text).cast("string"), F.lit(":"), text))


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.md5(F.concat(*(framed(cell_text(F.col(f"`{c}`"), kinds[c])) for c in columns)))


def _half(h: Column, at: int) -> Column:
    return F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")


def digests(rows: DataFrame, units: DataFrame, columns: list[str]) -> DataFrame:
    """``unit, n_rows, digest`` for every unit of the plan; one without rows has the digest of no rows."""
    hashed = rows.select("unit", row_hash(rows, columns).alias("_h"))
    sums = hashed.groupBy("unit").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(_half(F.col("_h"), 1)).alias("_a"), F.sum(_half(F.col("_h"), 17)).alias("_b"))
    every = units.select("unit").join(F.broadcast(sums), "unit", "left")
    n = F.coalesce("n_rows", F.lit(0))
    text = F.concat_ws("|", n.cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("_a", "_b")))
    return every.select("unit", n.alias("n_rows"), F.md5(text).alias("digest"))


def compare(source: DataFrame, target: DataFrame) -> DataFrame:
    """``unit, source_rows, target_rows, source_digest, target_digest, matches`` of two digest tables; both have a row a unit."""
    named = lambda df, side: df.select("unit", F.col("n_rows").alias(f"{side}_rows"), F.col("digest").alias(f"{side}_digest"))
    both = named(source, "source").join(named(target, "target"), "unit")
    same = (F.col("source_digest") == F.col("target_digest")) & (F.col("source_rows") == F.col("target_rows"))
    return both.withColumn("matches", same)


def report(compared: DataFrame) -> DataFrame:
    """One row: how many units there are and match, the sides' rows, and whether all match; no units match."""
    return compared.agg(
        F.count(F.lit(1)).alias("units"),
        F.count(F.when(F.col("matches"), 1)).alias("matching"),
        F.coalesce(F.sum("source_rows"), F.lit(0)).cast("bigint").alias("source_rows"),
        F.coalesce(F.sum("target_rows"), F.lit(0)).cast("bigint").alias("target_rows"),
        F.coalesce(F.bool_and("matches"), F.lit(True)).alias("all_match"),
    )


def require_match(compared: DataFrame) -> None:
    found = report(compared).first()
    if not found.all_match:
        raise ValidationError(f"{found.units - found.matching} of {found.units} units differ")


def sample(rows: DataFrame, order: list[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows of each unit in token order.

    Spark keeps only the first ``n`` of a unit in each task before the shuffle.
    """
    if n < 1:
        raise ValidationError("a sample needs at least one row")
    nth = F.row_number().over(Window.partitionBy("unit").orderBy(*order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n)


def within_tolerance(source: DataFrame, target: DataFrame, keys: list[str], writetime: str = "_writetime", ttl: str = "_ttl", most_us: int = TOLERANCE_US, most_s: int = 60) -> DataFrame:
    """The rows of both sides by key, and whether their write times and lifetimes are near enough.

    A row that one side lacks is there and not within.  A missing write time or
    lifetime counts as 0, as it does where it is read; keys are compared null-safe.
    """
    side = lambda df, name: df.select(*(F.col(k).alias(f"_{name}_{k}") for k in keys), F.col(writetime).alias(f"{name}_wt"), F.col(ttl).alias(f"{name}_ttl"), F.lit(True).alias(f"_in_{name}"))
    on = [F.col(f"_source_{k}").eqNullSafe(F.col(f"_target_{k}")) for k in keys]
    both = side(source, "source").join(side(target, "target"), on, "full_outer")
    near = lambda what, most: F.abs(F.coalesce(f"source_{what}", F.lit(0)) - F.coalesce(f"target_{what}", F.lit(0))) <= most
    two = F.col("_in_source").isNotNull() & F.col("_in_target").isNotNull()
    key = lambda k: F.when(F.col("_in_source").isNotNull(), F.col(f"_source_{k}")).otherwise(F.col(f"_target_{k}")).alias(k)
    return both.select(*map(key, keys), "source_wt", "source_ttl", "target_wt", "target_ttl", (two & near("wt", most_us) & near("ttl", most_s)).alias("within"))


def _both_texts(c: str, kind: T.DataType) -> Column:
    return F.struct(cell_text(F.col(f"`{c}`"), kind).alias("exact"), F.col(f"`{c}`").cast("string").alias("shown"))


def full_diff(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], also: list[str] | None = None) -> DataFrame:
    """``keys, kind, changed`` of all rows that are on one side only or differ in some column.

    ``changed`` lists name and both values of each differing column, by name, as
    Spark shows them; they differ where their exact texts do.  It is empty for
    one-sided rows.  ``also`` names columns of metadata that
    are compared the same way.  Keys are compared null-safe.
    """
    columns = [*columns, *(also or [])]
    kinds = {f.name: f.dataType for f in source.schema.fields}
    a = source.select(*(F.col(k).alias(f"_s_{k}") for k in keys), *(_both_texts(c, kinds[c]).alias(f"_sv_{c}") for c in columns), F.lit(True).alias("_in_s"))
    b = target.select(*(F.col(k).alias(f"_t_{k}") for k in keys), *(_both_texts(c, kinds[c]).alias(f"_tv_{c}") for c in columns), F.lit(True).alias("_in_t"))
    on = [F.col(f"_s_{k}").eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    both = a.join(b, on, "full_outer")
    cell = lambda c: F.struct(F.lit(c).alias("name"), F.col(f"_sv_{c}").alias("source"), F.col(f"_tv_{c}").alias("target"))
    two = F.col("_in_s").isNotNull() & F.col("_in_t").isNotNull()
    found = F.filter(F.array(*map(cell, sorted(columns))), lambda x: ~x["source"]["exact"].eqNullSafe(x["target"]["exact"]))
    changed = F.transform(found, lambda x: F.struct(x["name"].alias("name"), x["source"]["shown"].alias("source"), x["target"]["shown"].alias("target")))
    kind = F.when(F.col("_in_t").isNull(), "only_source").when(F.col("_in_s").isNull(), "only_target").when(F.size(changed) > 0, "value_mismatch")
    empty = F.array().cast("array<struct<name:string,source:string,target:string>>")
    found = both.select(*(F.when(F.col("_in_s").isNotNull(), F.col(f"_s_{k}")).otherwise(F.col(f"_t_{k}")).alias(k) for k in keys), kind.alias("kind"), F.when(two, changed).otherwise(empty).alias("changed"))
    return found.where(F.col("kind").isNotNull())


def diff_sample(diffs: DataFrame, keys: list[str], most: int = DIFFS_PER_UNIT) -> DataFrame:
    """At most ``most`` differences of each unit: changed and source-only rows in key order, then target-only ones."""
    last = (F.col("kind") == "only_target").cast("int")
    nth = F.row_number().over(Window.partitionBy("unit").orderBy(last, *keys))
    return diffs.withColumn("nth", nth).where(F.col("nth") <= most)
