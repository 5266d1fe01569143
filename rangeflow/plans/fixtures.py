"""The inputs of the query catalogue: roles that the given tables play, and derived targets, logs and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.functions.tokens import PORTABLE_RANGE, portable_token
from rangeflow.operators import cdc
from rangeflow.operators.scan import assign_even
from rangeflow.plans.planner import TokenRange, frame, split_range
from rangeflow.sources.schema import ColumnInfo, ColumnKind, TableSchema

PARENT = TokenRange(*PORTABLE_RANGE)
UNITS = 16
PK, CK = ColumnKind.PARTITION_KEY, ColumnKind.CLUSTERING

ORDERS = TableSchema("shop", "orders", (
    ColumnInfo("o_orderdate", "timestamp"), ColumnInfo("o_custkey", "bigint", PK, 0), ColumnInfo("o_totalprice", "double"),
    ColumnInfo("o_orderkey", "bigint", CK, 0), ColumnInfo("o_orderstatus", "text"), ColumnInfo("o_orderpriority", "text"),
))
EVENTS = TableSchema("shop", "events_by_user", (
    ColumnInfo("user_id", "bigint", PK, 0), ColumnInfo("k", "int", CK, 0), ColumnInfo("value", "double"), ColumnInfo("kind", "text"),
))
DOCUMENTS = TableSchema("shop", "documents", (
    ColumnInfo("doc_id", "bigint", PK, 0), ColumnInfo("text", "text"), ColumnInfo("lang", "text"), ColumnInfo("source", "text"), ColumnInfo("n_chars", "bigint"),
))
ATTRIBUTES = TableSchema("shop", "attributes", (
    ColumnInfo("event_id", "bigint", PK, 0), ColumnInfo("attrs", "map<text, int>"), ColumnInfo("tags", "set<text>"), ColumnInfo("value", "double"),
))
HITS = TableSchema("shop", "hits", (ColumnInfo("user_id", "bigint", PK, 0), ColumnInfo("event_type", "text", CK, 0), ColumnInfo("hits", "counter"), ColumnInfo("cents", "counter")))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def units(spark: SparkSession, n: int = UNITS) -> DataFrame:
    return frame(spark, split_range(PARENT, n))


def in_units(df: DataFrame, *keys: str, n: int = UNITS) -> DataFrame:
    return assign_even(df.withColumn("_tok", portable_token(*map(F.col, keys))), PARENT, n)


def target_orders(orders: DataFrame) -> DataFrame:
    """A target that lacks some rows, has others changed, and has some of its own."""
    key = F.col("o_orderkey")
    price = F.col("o_totalprice")
    changed = F.when(F.pmod(key, F.lit(53)) == 0, price + 1).when(F.pmod(key, F.lit(59)) == 0, price + 2.0**-20)  # some by far less than a cent
    kept = orders.where(F.pmod(key, F.lit(97)) != 0).withColumn("o_totalprice", F.coalesce(changed, price))
    return kept.unionByName(orders.where(F.pmod(key, F.lit(89)) == 0).withColumn("o_orderkey", key + 1_000_000_000))


TARGET_SQL = """
target AS (
  SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus,
         CASE WHEN o_orderkey % 53 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 59 = 0 THEN o_totalprice + pow(2.0::DOUBLE, -20) ELSE o_totalprice END AS o_totalprice
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT o_custkey, o_orderkey + 1000000000, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 89 = 0
)"""

_STEP = (PARENT.end - PARENT.start) // UNITS


def token_sql(key: str) -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 15))::BIGINT"


def unit_sql(key: str) -> str:
    return f"CAST(least(({token_sql(key)} - ({PARENT.start}) - 1) // {_STEP}, {UNITS - 1}) AS INT)"


def order_meta(orders: DataFrame) -> DataFrame:
    """Write times and lifetimes of the orders' columns: some columns lack one in some rows."""
    t, key = micros("o_orderdate"), F.col("o_orderkey")
    return orders.withColumns({
        "_wt_o_orderdate": t, "_wt_o_orderpriority": F.when(F.pmod(key, F.lit(3)) != 0, t + 5), "_wt_o_orderstatus": t + F.pmod(key, F.lit(7)), "_wt_o_totalprice": F.when(F.pmod(key, F.lit(5)) == 0, t + 9),
        "_ttl_o_totalprice": F.when(F.pmod(key, F.lit(10)) == 0, F.lit(86400)), "_ttl_o_orderstatus": F.when(F.pmod(key, F.lit(20)) == 0, F.lit(3600)),
    })


ORDER_META_SQL = """
meta AS (
  SELECT *, epoch_us(o_orderdate) AS t0,
         greatest(epoch_us(o_orderdate), CASE WHEN o_orderkey % 3 <> 0 THEN epoch_us(o_orderdate) + 5 END,
                  epoch_us(o_orderdate) + o_orderkey % 7, CASE WHEN o_orderkey % 5 = 0 THEN epoch_us(o_orderdate) + 9 END) AS _writetime,
         CAST(coalesce(greatest(CASE WHEN o_orderkey % 10 = 0 THEN 86400 END, CASE WHEN o_orderkey % 20 = 0 THEN 3600 END), 0) AS INT) AS _ttl
  FROM orders
)"""


def change_log(events: DataFrame, partitions: bool = False, ranges: bool = False) -> DataFrame:
    """The events as changes of rows (user, k): some updates delete a cell, and on request k of 0 deletes a partition and 1 and 2 bound ranges."""
    k = F.get_json_object("props", "$.k").cast("int")
    op = F.when(F.col("event_type").isin("signup", "purchase"), cdc.INSERT).when(F.col("event_type") == "click", cdc.UPDATE).when(F.col("event_type") == "view", cdc.PRE_IMAGE).otherwise(cdc.DELETE_ROW)
    bound = F.pmod("event_id", F.lit(100)).cast("int")
    ck = k
    if ranges:
        op = F.when(k == 1, cdc.LEFT_INCLUSIVE).when(k == 2, cdc.RIGHT_EXCLUSIVE).otherwise(op)
        ck = F.when(k.isin(1, 2), bound).otherwise(k)
    if partitions:
        op = F.when(k == 0, cdc.DELETE_PARTITION).otherwise(op)
    drops = (op == cdc.UPDATE) & (F.pmod("event_id", F.lit(10)) == 0)
    return events.select(
        op.alias("op"), F.col("user_id"), ck.alias("k"), F.when(~drops, F.col("value")).alias("value"), F.col("event_type").alias("kind"),
        F.when(drops, F.array(F.lit("value"))).otherwise(F.array().cast("array<string>")).alias("deleted"), micros("ts").alias("time"), F.col("event_id").alias("seq"),
    )


def log_sql(partitions: bool = False, ranges: bool = False) -> str:
    k = "CAST(json_extract_string(props, '$.k') AS INT)"
    whens = (f"WHEN {k} = 0 THEN 'partition_delete' " if partitions else "") + (f"WHEN {k} = 1 THEN 'left' WHEN {k} = 2 THEN 'right' " if ranges else "")
    ck = f"CASE WHEN {k} IN (1, 2) THEN CAST(event_id % 100 AS INT) ELSE {k} END" if ranges else k
    return f"""
log0 AS (
  SELECT CASE {whens} WHEN event_type IN ('signup', 'purchase') THEN 'row_insert' WHEN event_type = 'click' THEN 'row_update'
              WHEN event_type = 'view' THEN 'pre_image' ELSE 'row_delete' END AS op,
         user_id, {ck} AS k, value AS v0, event_type AS kind, epoch_us(ts) AS time, event_id AS seq
  FROM events
), log AS (
  SELECT *, (op = 'row_update' AND seq % 10 = 0) AS drops, CASE WHEN NOT (op = 'row_update' AND seq % 10 = 0) THEN v0 END AS value FROM log0
)"""


def double_sql(x: str) -> str:
    """A double as digests see it: sign, significand of 53 bits, power of two."""
    guess = f"CAST(floor(log2(abs({x}))) AS INT)"
    part = f"abs({x}) / pow(2.0::DOUBLE, {guess})"
    power = f"({guess} + CASE WHEN {part} >= 2 THEN 1 WHEN {part} < 1 THEN -1 ELSE 0 END)"
    whole = f"CAST(CAST(abs({x}) / pow(2.0::DOUBLE, {power}) * 4503599627370496.0::DOUBLE AS BIGINT) AS VARCHAR)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END WHEN {x} = 0 THEN '0' ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || {whole} || 'p' || {power} END"


SLOTS = TableSchema("shop", "slots_by_user", (
    ColumnInfo("user_id", "bigint", PK, 0), ColumnInfo("a", "int", CK, 0), ColumnInfo("b", "int", CK, 1), ColumnInfo("kind", "text"),
))


def slot_log(events: DataFrame) -> DataFrame:
    """The events as changes of rows (user, a, b); some bound ranges by a alone, some by a and b."""
    k, n = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    op = F.when(k % 10 == 1, cdc.LEFT_INCLUSIVE).when(k % 10 == 2, cdc.RIGHT_EXCLUSIVE).when(k == 3, cdc.DELETE_PARTITION).otherwise(cdc.INSERT)
    b = F.when(~op.isin(cdc.LEFT_INCLUSIVE, cdc.RIGHT_EXCLUSIVE) | (F.pmod(n, F.lit(3)) != 0), F.pmod(n, F.lit(10)).cast("int"))
    return events.select(
        op.alias("op"), "user_id", (k % 5).alias("a"), b.alias("b"), F.col("event_type").alias("kind"),
        F.array().cast("array<string>").alias("deleted"), micros("ts").alias("time"), n.alias("seq"),
    )


SLOT_SQL = """
slots0 AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
), slots AS (
  SELECT CASE WHEN k % 10 = 1 THEN 'left' WHEN k % 10 = 2 THEN 'right' WHEN k = 3 THEN 'partition' ELSE 'row' END AS op, user_id, k % 5 AS a,
         CASE WHEN k % 10 NOT IN (1, 2) OR event_id % 3 <> 0 THEN CAST(event_id % 10 AS INT) END AS b, event_type AS kind, epoch_us(ts) AS time, event_id AS seq
  FROM slots0
), bounds AS (
  SELECT *, lead(op) OVER w AS next_op, lag(op) OVER w AS last_op, lead(a) OVER w AS ha, lead(b) OVER w AS hb, lead(time) OVER w AS until
  FROM slots WHERE op IN ('left', 'right') WINDOW w AS (PARTITION BY user_id ORDER BY time, seq)
)"""


def run_units(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Sixteen planned units with states by their number, counters from the orders, and times of their last change."""
    u = F.col("unit")
    counts = df.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.max("_tok").alias("last"))
    state = F.element_at(F.array(*map(F.lit, ("pending", "running", "completed", "failed"))), F.pmod(u, F.lit(4)) + 1)
    seen = F.pmod(u, F.lit(4)) != 0
    joined = units(spark).join(F.broadcast(counts), "unit", "left")
    n = F.when(seen, F.coalesce("n", F.lit(0))).otherwise(F.lit(0))
    return joined.select(
        "unit", "token_start", "token_end", state.alias("state"), n.cast("bigint").alias("rows_read"), F.when(state == "failed", n - 1).otherwise(n).cast("bigint").alias("rows_written"),
        (n * 40).cast("bigint").alias("bytes_written"), F.when(state == "running", F.col("token_start") + F.floor((F.col("last") - F.col("token_start")) / F.lit(2))).when(seen, F.col("last")).alias("last_token"),
        F.when(F.pmod(u, F.lit(8)) == 1, F.lit(None).cast("double")).otherwise(1000.0 + u * 10).alias("heartbeat_at"), (F.lit(1000.0) + u).alias("updated_at"),
    )


UNITS_SQL = f"""
plan AS (
  SELECT CAST(i AS INT) AS unit, {PARENT.start} + i * {_STEP} AS token_start, CASE WHEN i = {UNITS - 1} THEN {PARENT.end} ELSE {PARENT.start} + (i + 1) * {_STEP} END AS token_end
  FROM range({UNITS}) r(i)
), per_unit AS (
  SELECT {unit_sql('o_custkey')} AS unit, count(*) AS n, max({token_sql('o_custkey')}) AS last FROM orders GROUP BY 1
), units0 AS (
  SELECT plan.*, ['pending', 'running', 'completed', 'failed'][unit % 4 + 1] AS state, CASE WHEN unit % 4 <> 0 THEN coalesce(n, 0) ELSE 0 END AS n, last FROM plan LEFT JOIN per_unit USING (unit)
), units AS (
  SELECT unit, token_start, token_end, state, CAST(n AS BIGINT) AS rows_read, CAST(CASE WHEN state = 'failed' THEN n - 1 ELSE n END AS BIGINT) AS rows_written, CAST(n * 40 AS BIGINT) AS bytes_written,
         CASE WHEN state = 'running' THEN token_start + CAST(floor((last - token_start) / 2.0::DOUBLE) AS BIGINT) WHEN state <> 'pending' THEN last END AS last_token,
         CASE WHEN unit % 8 = 1 THEN NULL ELSE 1000.0::DOUBLE + unit * 10 END AS heartbeat_at, 1000.0::DOUBLE + unit AS updated_at
  FROM units0
)"""
