"""Mutations given as JSON, turned into typed inserts, updates and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeflow.functions.cqltypes import INTEGER_BOUNDS, CqlType
from rangeflow.sources.schema import ColumnInfo, TableSchema

INSERT, UPDATE, DELETE_ROW, DELETE_PARTITION = "insert", "update", "delete_row", "delete_partition"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: The envelope of a mutation.
MUTATION = T.StructType([T.StructField("table", T.StringType()), T.StructField("op", T.StringType()), T.StructField("columns", T.StringType()), T.StructField("timestamp_us", T.LongType()), T.StructField("ttl_secs", T.IntegerType())])


def json_text(columns: Column | str, name: str) -> Column:
    """A member of a JSON object as text; null if it is absent or null."""
    return F.get_json_object(columns, "$['" + name.replace("'", "\\'") + "']")


def typed(text: Column, kind: CqlType) -> tuple[Column, Column]:
    """The value of a type, and why it has none; both null for null.

    Integers must be whole and in the type's range, booleans ``true`` or
    ``false``, uuids in canonical form; blobs are hexadecimal digits or else the
    text's bytes.  Collections come as JSON arrays and objects; null elements of
    lists and sets are dropped, null values of maps refused.
    """
    head = kind.inner.head
    bad = lambda value: F.when(text.isNotNull() & value.isNull(), F.lit(f"not a {head}"))
    if head in ("ascii", "text", "varchar"):
        return text, F.lit(None).cast("string")
    if head in INTEGER_BOUNDS:
        wide = text.try_cast("decimal(38,10)")
        whole = F.when(wide == F.floor(wide), wide)
        top = 2 ** INTEGER_BOUNDS[head]
        value = F.when((whole >= F.lit(str(-top)).cast("decimal(38,0)")) & (whole < F.lit(str(top)).cast("decimal(38,0)")), whole.try_cast(kind.inner.spark()))
        return value, F.when(text.isNotNull() & whole.isNull(), F.lit(f"not a {head}")).when(whole.isNotNull() & value.isNull(), F.lit(f"out of range for {head}"))
    if head in ("float", "double"):
        value = text.try_cast(kind.inner.spark())
    elif head == "boolean":
        value = F.when(text.isin("true", "false"), text == "true")
    elif head in ("uuid", "timeuuid"):
        value = F.when(text.rlike(UUID), F.lower(text))
    elif head == "blob":
        digits = F.regexp_replace(text, "^0x", "")
        value = F.when(digits.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(digits)).otherwise(text.cast("binary"))
    elif head in ("list", "set"):
        found = F.filter(F.from_json(text, T.ArrayType(kind.inner.args[0].spark())), lambda x: x.isNotNull())
        value = F.array_sort(F.array_distinct(found)) if head == "set" else found
    elif head == "map":
        found = F.from_json(text, kind.inner.spark())
        empty = F.exists(F.map_values(found), lambda x: x.isNull())  # an entry needs a value
        return F.when(~empty, found), F.when(text.isNotNull() & found.isNull(), F.lit(f"not a {head}")).when(empty, F.lit("null value in a map"))
    else:
        return F.lit(None).cast(kind.inner.spark()), F.when(text.isNotNull(), F.lit(f"no JSON form for {head}"))
    return value, bad(value)


def plan(mutations: DataFrame, schema: TableSchema, columns: str = "columns") -> DataFrame:
    """The mutations with a typed column for each of the table's, and ``action`` and ``error``.

    ``op`` is insert, update, delete_row or delete_partition.  Inserts and
    updates need the whole key, and updates some other column; row deletes need
    the whole key, partition deletes its partition part.  Members that the table
    does not know are ignored; deletes ignore time and lifetime.  A mutation
    that cannot be carried out has the action ``error``, never none.
    """
    op, errors, cells, named = F.col("op"), [], [], {}
    for c in schema.ordered:
        text = json_text(columns, c.name)
        value, why = typed(text, c.type)
        named[c.name] = text.isNotNull()
        cells.append(value.alias(c.name))
        errors.append(F.when(why.isNotNull(), F.concat(F.lit(f"{c.name}: "), why)))

    def lacks(key: list[ColumnInfo]) -> Column:
        return F.coalesce(*(F.when(~named[c.name], F.lit(f"missing key column {c.name}")) for c in key), F.lit(None))

    some = F.lit(False)
    for c in schema.data:
        some = some | named[c.name]
    whole = F.when(op == DELETE_PARTITION, lacks(schema.partition_key)).otherwise(lacks(schema.primary_key))
    empty = F.when((op == UPDATE) & ~some, F.lit("update without columns"))
    unknown = F.when(op.isNull() | ~op.isin(INSERT, UPDATE, DELETE_ROW, DELETE_PARTITION), F.lit("unknown operation"))
    error = F.coalesce(unknown, whole, empty, *errors)
    deletes = op.isin(DELETE_ROW, DELETE_PARTITION)
    keep = [c for c in mutations.columns if c not in (columns, "timestamp_us", "ttl_secs") and c not in named]
    writetime = F.when(~deletes, F.col("timestamp_us")) if "timestamp_us" in mutations.columns else F.lit(None).cast("bigint")
    ttl = F.when(~deletes, F.col("ttl_secs")) if "ttl_secs" in mutations.columns else F.lit(None).cast("int")
    found = mutations.select(*keep, *cells, writetime.alias("writetime"), ttl.alias("ttl"), error.alias("error"))
    return found.withColumn("action", F.when(F.col("error").isNotNull(), F.lit("error")).otherwise(op))


def write_both(batch: DataFrame, source, target, require_both: bool = True) -> None:
    """Hands a planned batch to the source's writer, then to the target's; a failing target is passed over only where that is allowed."""
    batch = batch.persist()
    try:
        source(batch)
        try:
            target(batch)
        except Exception:
            if require_both:
                raise
    finally:
        batch.unpersist()
