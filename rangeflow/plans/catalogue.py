"""Registered queries over the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.functions.tokens import MAX_TOKEN, MIN_TOKEN
from rangeflow.operators import cdc, dualwrite, merge, scan, validate
from rangeflow.plans import checkpoint, fixtures as fx, planner, progress
from rangeflow.sources.schema import ColumnInfo, TableSchema, differences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple], names: str) -> str:
    """SQL for literal rows."""
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


# ---- planning

EVEN_SQL = f"""
SELECT CAST(i AS INT) AS unit, {{start}} + i * {{step}} AS token_start, CASE WHEN i = {{n}} - 1 THEN {{end}} ELSE {{start}} + (i + 1) * {{step}} END AS token_end
FROM range({{n}}) r(i)"""
_RING_STEP = (MAX_TOKEN - MIN_TOKEN) // 512


@query(EVEN_SQL.format(start=fx.PARENT.start, end=fx.PARENT.end, n=16, step=(fx.PARENT.end - fx.PARENT.start) // 16))
def plan_even(spark, sf_dir):
    return planner.frame(spark, planner.split_range(fx.PARENT, 16))


@query(f"""
SELECT CAST(i AS INT) AS unit, CAST({MIN_TOKEN}::HUGEINT + i * {_RING_STEP}::HUGEINT AS BIGINT) AS token_start,
       CAST(CASE WHEN i = 511 THEN {MAX_TOKEN}::HUGEINT ELSE {MIN_TOKEN}::HUGEINT + (i + 1) * {_RING_STEP}::HUGEINT END AS BIGINT) AS token_end
FROM range(512) r(i)""")
def plan_full_ring(spark, sf_dir):
    return planner.frame(spark, planner.split_ring(512))


@query(f"SELECT * FROM ({EVEN_SQL.format(start=fx.PARENT.start, end=fx.PARENT.end, n=64, step=(fx.PARENT.end - fx.PARENT.start) // 64)}) WHERE unit < 10")
def plan_max_units(spark, sf_dir):
    return planner.frame(spark, planner.plan("even", 64, fx.PARENT, max_units=10))


@query(f"""
WITH ring AS (SELECT DISTINCT {fx.token_sql('n_nationkey')} AS token FROM nation)
SELECT coalesce(lag(token) OVER (ORDER BY token), {MIN_TOKEN}) AS token_start, token AS token_end FROM ring
UNION ALL SELECT max(token), {MAX_TOKEN} FROM ring""")
def plan_vnode(spark, sf_dir):
    """Ranges between the tokens of a topology; the nations stand for its nodes."""
    return planner.owned_frame(fx.read(spark, sf_dir, "nation").select(fx.portable_token(F.col("n_nationkey")).alias("token")))


@query(f"""
WITH ring AS (SELECT DISTINCT {fx.token_sql('n_nationkey')} AS token FROM nation),
spans AS (SELECT lag(token) OVER (ORDER BY token) AS lo, token AS hi FROM ring)
SELECT coalesce(lo, {MIN_TOKEN}) AS token_start, hi AS token_end, count(o_custkey) AS n_rows
FROM (SELECT lo, hi FROM spans UNION ALL SELECT max(token), {MAX_TOKEN} FROM ring) s
LEFT JOIN (SELECT o_custkey, {fx.token_sql('o_custkey')} AS tok FROM orders) o ON tok > coalesce(lo, {MIN_TOKEN}) AND tok <= hi GROUP BY ALL""")
def vnode_unit_counts(spark, sf_dir):
    """Rows of each range of an uneven plan."""
    spans = plan_vnode(spark, sf_dir).withColumn("unit", F.hash("token_start", "token_end"))
    rows = fx.read(spark, sf_dir, "orders").select(fx.portable_token(F.col("o_custkey")).alias("_tok"))
    counts = scan.assign_ranges(rows, spans).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    return spans.join(counts, "unit", "left").select("token_start", "token_end", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query(f"""
WITH ring AS (SELECT DISTINCT {fx.token_sql('n_nationkey')} AS token FROM nation),
spans AS (SELECT coalesce(lag(token) OVER (ORDER BY token), {MIN_TOKEN}) AS lo, token AS hi, row_number() OVER (ORDER BY token) AS k FROM ring UNION ALL SELECT max(token), {MAX_TOKEN}, 0 FROM ring),
parts AS (SELECT *, greatest(60 // count(*) OVER (), 1) + CASE WHEN 60 >= count(*) OVER () AND k < 60 % count(*) OVER () THEN 1 ELSE 0 END AS m, hi::HUGEINT - lo::HUGEINT AS width FROM spans)
SELECT CAST(row_number() OVER (ORDER BY k, j) - 1 AS INT) AS unit, CAST(lo + j * (width // m) AS BIGINT) AS token_start, CAST(CASE WHEN j = m - 1 THEN hi ELSE lo + (j + 1) * (width // m) END AS BIGINT) AS token_end
FROM parts, LATERAL (SELECT unnest(range(0, m::BIGINT)) AS j)""")
def plan_topology(spark, sf_dir):
    """Sixty units over the ranges between the tokens of a topology; the nations stand for its nodes."""
    tokens = fx.read(spark, sf_dir, "nation").select(fx.portable_token(F.col("n_nationkey")).alias("token")).collect()  # a row a node
    return planner.frame(spark, planner.plan("vnode", 60, tokens=[r.token for r in tokens]))


def _ring_sql(key: str) -> str:
    """Murmur3 of keys of eight bytes below 2^15, whose bytes have no sign to extend but for the last one, where it is shifted out."""
    turn = lambda x, r: f"(({x} * {2**r}::UHUGEINT) % {2**64}::UHUGEINT + {x} // {2 ** (64 - r)}::UHUGEINT)"
    times = lambda x, by: f"(({x} * {by}::UHUGEINT) % {2**64}::UHUGEINT)"
    mixed = lambda x: f"xor({x}::UBIGINT, ({x} // {2**33}::UHUGEINT)::UBIGINT)::UHUGEINT"
    steps = [
        f"SELECT {key} AS key, (({key} % 256)::UHUGEINT * {2**56}::UHUGEINT + ({key} // 256)::UHUGEINT * {2**48}::UHUGEINT) AS x FROM customer",
        f"SELECT key, {times('x', 0x87C37B91114253D5)} AS x FROM s0", f"SELECT key, {turn('x', 31)} AS x FROM s1", f"SELECT key, xor({times('x', 0x4CF5AD432745937F)}::UBIGINT, 8::UBIGINT)::UHUGEINT AS x FROM s2",
        f"SELECT key, (x + 8) % {2**64}::UHUGEINT AS a, (x + 16) % {2**64}::UHUGEINT AS b FROM s3",
        f"SELECT key, {mixed('a')} AS a, {mixed('b')} AS b FROM s4", f"SELECT key, {times('a', 0xFF51AFD7ED558CCD)} AS a, {times('b', 0xFF51AFD7ED558CCD)} AS b FROM s5",
        f"SELECT key, {mixed('a')} AS a, {mixed('b')} AS b FROM s6", f"SELECT key, {times('a', 0xC4CEB9FE1A85EC53)} AS a, {times('b', 0xC4CEB9FE1A85EC53)} AS b FROM s7",
        f"SELECT key, ({mixed('a')} + {mixed('b')}) % {2**64}::UHUGEINT AS t FROM s8",
    ]
    named = ", ".join(f"s{k} AS ({x})" for k, x in enumerate(steps))
    return f"WITH {named} SELECT key AS {key}, CAST(CASE WHEN t = {2**63}::UHUGEINT THEN {MAX_TOKEN} WHEN t > {2**63}::UHUGEINT THEN t::HUGEINT - {2**64}::HUGEINT ELSE t::HUGEINT END AS BIGINT) AS token FROM s9"


@query(_ring_sql("c_custkey"))
def ring_tokens(spark, sf_dir):
    """Ring tokens of all customers' keys, as eight bytes each."""
    from rangeflow.functions.tokens import key_bytes, ring_token

    key = F.unhex(F.lpad(F.hex("c_custkey"), 16, "0"))
    return fx.read(spark, sf_dir, "customer").select("c_custkey", ring_token(key_bytes(key)).alias("token"))


# ---- scans

_SCAN = planner.split_range(fx.PARENT, 16)[3]


@query(f"""
SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice, {fx.token_sql('o_custkey')} AS _tok
FROM orders WHERE {fx.token_sql('o_custkey')} > {_SCAN.start} AND {fx.token_sql('o_custkey')} <= {_SCAN.end}""")
def range_scan(spark, sf_dir):
    rows = scan.with_token(fx.read(spark, sf_dir, "orders"), fx.portable_token(F.col("o_custkey")))
    return scan.range_scan(rows, fx.ORDERS, _SCAN)


@query(f"""WITH {fx.UNITS_SQL} SELECT p.unit, token_start, token_end, coalesce(n, 0) AS n_rows, last AS last_token FROM plan p LEFT JOIN per_unit USING (unit)""")
def unit_row_counts(spark, sf_dir):
    return scan.unit_counts(fx.in_units(fx.read(spark, sf_dir, "orders").select("o_custkey"), "o_custkey"), fx.units(spark))


@query(f"""
SELECT {fx.unit_sql('doc_id')} AS unit, count(*) AS n_rows,
       CAST(sum(8 + coalesce(octet_length(encode(text)), 1) + coalesce(octet_length(encode(lang)), 1) + coalesce(octet_length(encode(source)), 1) + CASE WHEN n_chars IS NULL THEN 1 ELSE 8 END) AS BIGINT) AS n_bytes
FROM documents GROUP BY 1""")
def unit_bytes(spark, sf_dir):
    rows = fx.in_units(fx.read(spark, sf_dir, "documents"), "doc_id")
    return scan.unit_sizes(rows, [c.name for c in fx.DOCUMENTS.columns])


@query(f"""SELECT {fx.unit_sql('vec_id')} AS unit, count(*) AS n_rows, CAST(sum(8 + 4 + 4 * len(embedding) + 4) AS BIGINT) AS n_bytes FROM embeddings GROUP BY 1""")
def unit_bytes_vectors(spark, sf_dir):
    return scan.unit_sizes(fx.in_units(fx.read(spark, sf_dir, "embeddings"), "vec_id"), ["vec_id", "embedding", "label"])


# ---- schemas


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice FROM orders")
def ordered_projection(spark, sf_dir):
    return scan.ordered(fx.read(spark, sf_dir, "orders"), fx.ORDERS)


@query(_values([(0, "o_custkey", "bigint", "partition_key", 0), (1, "o_orderkey", "bigint", "clustering", 0), (2, "o_orderdate", "timestamp", "regular", 0), (3, "o_orderpriority", "text", "regular", 0), (4, "o_orderstatus", "text", "regular", 0), (5, "o_totalprice", "double", "regular", 0)], "ordinal, name, cql_type, kind, position"))
def schema_columns(spark, sf_dir):
    return scan.schema_frame(spark, fx.ORDERS)


@query(_values([("same", True, 0), ("retyped", False, 1), ("shorter", False, 4)], "target, compatible, n_differences"))
def schema_compat(spark, sf_dir):
    columns = fx.ORDERS.columns
    retyped = TableSchema("b", "t", tuple(ColumnInfo(c.name, "float", c.kind, c.position) if c.cql_type == "double" else c for c in columns))
    shorter = TableSchema("b", "t", tuple(c for c in columns if c.name != "o_orderpriority"))
    found = [(name, not (d := differences(fx.ORDERS, t)), len(d)) for name, t in (("same", fx.ORDERS), ("retyped", retyped), ("shorter", shorter))]
    return spark.createDataFrame(found, "target string, compatible boolean, n_differences int")


@query(_values([
    ("table", 'CREATE TABLE IF NOT EXISTS "shop"."orders" ("o_custkey" bigint, "o_orderkey" bigint, "o_orderdate" timestamp, "o_orderpriority" text, "o_orderstatus" text, "o_totalprice" double, PRIMARY KEY ("o_custkey", "o_orderkey"))'),
    ("keyspace", "CREATE KEYSPACE IF NOT EXISTS \"shop\" WITH replication = {'class': 'NetworkTopologyStrategy', 'dc1': 3}"),
    ("select", 'SELECT "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice", token("o_custkey") FROM "shop"."orders" WHERE token("o_custkey") > ? AND token("o_custkey") <= ?'),
], "what, text"))
def ddl_render(spark, sf_dir):
    from rangeflow.sources.schema import create_keyspace

    return spark.createDataFrame([("table", fx.ORDERS.create_table()), ("keyspace", create_keyspace("shop", 3, "dc1")), ("select", fx.ORDERS.range_select())], "what string, text string")


@query("""
SELECT sha256(string_agg(len(p) || ':' || p, '' ORDER BY i)) AS fingerprint, CAST(6 AS INT) AS n_columns FROM (
  SELECT row_number() OVER () AS i, p FROM (SELECT unnest(['o_custkey', 'bigint', 'partition_key', '0', 'o_orderkey', 'bigint', 'clustering', '0', 'o_orderdate', 'timestamp', 'regular', '0',
    'o_orderpriority', 'text', 'regular', '0', 'o_orderstatus', 'text', 'regular', '0', 'o_totalprice', 'double', 'regular', '0']) AS p))""")
def schema_fingerprint(spark, sf_dir):
    return spark.createDataFrame([(fx.ORDERS.fingerprint(), len(fx.ORDERS.columns))], "fingerprint string, n_columns int")


# ---- merges


@query(f"WITH {fx.ORDER_META_SQL} SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice, _writetime, _ttl, CASE WHEN _ttl > 0 THEN _writetime + _ttl::BIGINT * 1000000 END AS _expires_at FROM meta")
def preserve_level_a(spark, sf_dir):
    rows = merge.preserve(fx.order_meta(fx.read(spark, sf_dir, "orders")), fx.ORDERS)
    return rows.withColumn("_expires_at", merge.expires_at(F.col("_writetime"), F.col("_ttl")))


@query("""
WITH base AS (
  SELECT event_id, epoch_us(ts) AS wt, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type, value FROM events
), elements AS (
  SELECT event_id, 'attrs' AS "column", 'map' AS kind, 'k' AS element, CAST(k AS VARCHAR) AS value, wt FROM base WHERE k IS NOT NULL
  UNION ALL SELECT event_id, 'tags', 'set', event_type, NULL, wt FROM base WHERE event_type IS NOT NULL
)
SELECT event_id, "column", element, kind, value, CASE WHEN event_id % 4 = 0 AND kind = 'map' THEN wt + 7 ELSE wt END AS writetime,
       CAST(CASE WHEN event_id % 4 = 0 AND kind = 'map' THEN 3600 WHEN event_id % 10 = 0 THEN 86400 ELSE 0 END AS INT) AS ttl
FROM elements""")
def preserve_elements(spark, sf_dir):
    events = fx.read(spark, sf_dir, "events")
    key = F.col("event_id")
    rows = events.select("event_id", F.from_json("props", "map<string,int>").alias("attrs"), F.array("event_type").alias("tags"), "value", fx.micros("ts").alias("_writetime"), F.when(F.pmod(key, F.lit(10)) == 0, 86400).otherwise(0).alias("_ttl"))
    elements = merge.explode_elements(rows, fx.ATTRIBUTES)
    times = elements.where((F.pmod(key, F.lit(4)) == 0) & (F.col("kind") == "map")).select("event_id", "column", "element", (F.col("_writetime") + 7).alias("writetime"), F.lit(3600).alias("ttl"))
    return merge.with_element_times(elements, times, ["event_id"])


@query("""
SELECT user_id, map_key AS element, CAST(arg_max(v, (t, v)) AS VARCHAR) AS value
FROM (SELECT user_id, event_type AS map_key, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS v, epoch_us(ts) AS t FROM events) GROUP BY ALL""")
def merge_elements(spark, sf_dir):
    """The last value of each entry of a map that many events write to, and the map put together again."""
    events = fx.read(spark, sf_dir, "events")
    elements = events.select("user_id", F.lit("last_k").alias("column"), F.col("event_type").alias("element"), F.get_json_object("props", "$.k").alias("value"), fx.micros("ts").alias("writetime"))
    return merge.rebuild_maps(elements, ["user_id"]).select("user_id", F.explode("entries").alias("e")).select("user_id", "e.element", "e.value")


@query("""
SELECT * EXCLUDE (nth) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS nth
  FROM lineitem) WHERE nth = 1""")
def lww_upsert(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "lineitem")
    return merge.last_write_wins(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(CAST(json_extract_string(props, '$.k') AS INT), (ts, event_id)) AS k FROM events GROUP BY user_id""")
def lww_maps(spark, sf_dir):
    """The last version of each user's row, which has a map."""
    rows = fx.read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("kind"), F.from_json("props", "map<string,int>").alias("attrs"))
    return merge.last_write_wins(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "kind", F.col("attrs")["k"].alias("k"))


@query(f"""
WITH {fx.log_sql()}, cells AS (
  SELECT user_id, k, 'value' AS name, CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS v, time, drops AS deleted FROM log WHERE op IN ('row_insert', 'row_update') AND (value IS NOT NULL OR drops)
  UNION ALL SELECT user_id, k, 'kind', kind, time, false FROM log WHERE op IN ('row_insert', 'row_update')
), won AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, k, name ORDER BY time DESC, deleted DESC, v DESC) AS nth FROM cells
)
SELECT user_id, k, max(CASE WHEN name = 'value' AND NOT deleted THEN v END) AS value, max(CASE WHEN name = 'value' THEN time END) AS _wt_value,
       max(CASE WHEN name = 'kind' THEN v END) AS kind, max(CASE WHEN name = 'kind' THEN time END) AS _wt_kind
FROM won WHERE nth = 1 GROUP BY user_id, k""")
def cell_lww(spark, sf_dir):
    log = fx.change_log(fx.read(spark, sf_dir, "events")).where(F.col("op").isin(*cdc.UPSERTS))
    columns = {"value": F.col("value").cast("decimal(18,2)"), "kind": F.col("kind")}
    cells = merge.to_cells(log, ["user_id", "k"], columns, F.col("time"), {"value": F.array_contains("deleted", "value")})
    return merge.merge_cells(cells, ["user_id", "k"], ["value", "kind"])


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS hits, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)), 0) AS BIGINT) AS cents FROM events GROUP BY ALL")
def counter_merge(spark, sf_dir):
    deltas = fx.read(spark, sf_dir, "events").select("user_id", "event_type", F.lit(1).cast("bigint").alias("hits"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    found = merge.merge_counters(deltas, fx.HITS)
    return found.select("user_id", "event_type", "hits", "cents")


@query(f"""
SELECT o_orderkey, unit, CAST((row_number() OVER (PARTITION BY unit ORDER BY tok, o_custkey, o_orderkey) - 1) // 50 AS INT) AS chunk
FROM (SELECT o_orderkey, o_custkey, {fx.token_sql('o_custkey')} AS tok, {fx.unit_sql('o_custkey')} AS unit FROM orders)""")
def batch_chunks(spark, sf_dir):
    rows = fx.in_units(fx.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey")
    return scan.in_chunks(rows, "unit", ["_tok", "o_custkey", "o_orderkey"], 50).select("o_orderkey", "unit", "chunk")


@query(f"""
WITH sized AS (
  SELECT doc_id, {fx.token_sql('doc_id')} AS tok, {fx.unit_sql('doc_id')} AS unit,
         8 + coalesce(octet_length(encode(text)), 1) + coalesce(octet_length(encode(lang)), 1) + coalesce(octet_length(encode(source)), 1) + CASE WHEN n_chars IS NULL THEN 1 ELSE 8 END AS b FROM documents
)
SELECT doc_id, unit, CAST(coalesce(sum(b) OVER (PARTITION BY unit ORDER BY tok, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536 AS INT) AS chunk FROM sized""")
def batch_chunks_bytes(spark, sf_dir):
    rows = fx.in_units(fx.read(spark, sf_dir, "documents"), "doc_id")
    sized = rows.select("doc_id", "unit", "_tok", scan.row_bytes(rows, [c.name for c in fx.DOCUMENTS.columns]).alias("_bytes"))
    return scan.in_sized_chunks(sized, "unit", ["_tok", "doc_id"], 65536).select("doc_id", "unit", "chunk")


# ---- validation

_COLUMNS = [c.name for c in fx.ORDERS.ordered]


def _framed_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'N' ELSE 'V' || length({x}) || ':' || {x} END"


_ORDER_TEXT = ["CAST(o_custkey AS VARCHAR)", "CAST(o_orderkey AS VARCHAR)", "CAST(epoch_us(o_orderdate) AS VARCHAR)", "o_orderpriority", "o_orderstatus", fx.double_sql("o_totalprice")]
_HASH_SQL = f"md5({' || '.join(map(_framed_sql, _ORDER_TEXT))})"


def _digest_sql(name: str, rows: str, hashed: str = _HASH_SQL) -> str:
    half = lambda at: f"sum(('0x' || substr(h, {at}, 15))::BIGINT::HUGEINT)"
    return f"""
{name} AS (
  SELECT p.unit, coalesce(n, 0) AS n_rows, md5(coalesce(n, 0) || '|' || coalesce(a, 0) || '|' || coalesce(b, 0)) AS digest
  FROM (SELECT CAST(i AS INT) AS unit FROM range({fx.UNITS}) r(i)) p
  LEFT JOIN (SELECT unit, count(*) AS n, {half(1)} AS a, {half(17)} AS b FROM (SELECT {fx.unit_sql('o_custkey')} AS unit, {hashed} AS h FROM {rows}) GROUP BY unit) s USING (unit)
)"""


_COMPARED = """
compared AS (
  SELECT s.unit, s.n_rows AS source_rows, t.n_rows AS target_rows, s.digest AS source_digest, t.digest AS target_digest, s.digest = t.digest AND s.n_rows = t.n_rows AS matches
  FROM source_d s JOIN target_d t USING (unit)
)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = fx.read(spark, sf_dir, "orders")
    return fx.in_units(orders, "o_custkey"), fx.in_units(fx.target_orders(orders), "o_custkey")


@query(f"SELECT o_orderkey, {_HASH_SQL} AS row_hash FROM orders")
def row_hash(spark, sf_dir):
    orders = fx.read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", validate.row_hash(orders, _COLUMNS).alias("row_hash"))


@query(f"WITH {fx.TARGET_SQL}, {_digest_sql('source_d', 'orders')}, {_digest_sql('target_d', 'target')}, {_COMPARED} SELECT * FROM compared")
def validate_digest(spark, sf_dir):
    source, target = _sides(spark, sf_dir)
    plan = fx.units(spark)
    return validate.compare(validate.digests(source, plan, _COLUMNS), validate.digests(target, plan, _COLUMNS))


_META_HASH = _HASH_SQL[:-1] + f" || {_framed_sql('CAST(_writetime AS VARCHAR)')} || {_framed_sql('CAST(_ttl AS VARCHAR)')})"


@query(f"WITH {fx.ORDER_META_SQL}, {_digest_sql('d', 'meta', _META_HASH)} SELECT * FROM d")
def validate_digest_meta(spark, sf_dir):
    """Digests that cover write times and lifetimes."""
    rows = fx.in_units(merge.preserve(fx.order_meta(fx.read(spark, sf_dir, "orders")), fx.ORDERS), "o_custkey")
    return validate.digests(rows, fx.units(spark), [*_COLUMNS, "_writetime", "_ttl"])


@query(f"""
WITH {fx.TARGET_SQL}, s AS (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY tok, o_custkey, o_orderkey) AS nth FROM (SELECT *, {fx.unit_sql('o_custkey')} AS unit, {fx.token_sql('o_custkey')} AS tok FROM orders)
), t AS (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY tok, o_custkey, o_orderkey) AS nth FROM (SELECT *, {fx.unit_sql('o_custkey')} AS unit, {fx.token_sql('o_custkey')} AS tok FROM target)
), {_digest_sql('source_d', '(SELECT * FROM s WHERE nth <= 100)')}, {_digest_sql('target_d', '(SELECT * FROM t WHERE nth <= 100)')}, {_COMPARED} SELECT * FROM compared""")
def validate_sample(spark, sf_dir):
    """Digests of the first hundred rows of each unit."""
    plan = fx.units(spark)
    first = [validate.digests(validate.sample(side, ["_tok", "o_custkey", "o_orderkey"], 100), plan, _COLUMNS) for side in _sides(spark, sf_dir)]
    return validate.compare(*first)


@query(f"""
WITH {fx.ORDER_META_SQL}, other AS (
  SELECT o_custkey, o_orderkey + CASE WHEN o_orderkey % 19 = 0 THEN 1000000000 ELSE 0 END AS o_orderkey,
         CASE WHEN o_orderkey % 11 = 0 THEN _writetime + 2000000 WHEN o_orderkey % 13 = 0 THEN NULL ELSE _writetime + 500000 END AS w, _ttl + CASE WHEN o_orderkey % 17 = 0 THEN 61 ELSE 0 END AS l FROM meta
)
SELECT coalesce(m.o_custkey, o.o_custkey) AS o_custkey, coalesce(m.o_orderkey, o.o_orderkey) AS o_orderkey, m._writetime AS source_wt, m._ttl AS source_ttl, o.w AS target_wt, CAST(o.l AS INT) AS target_ttl,
       m.o_orderkey IS NOT NULL AND o.o_orderkey IS NOT NULL AND abs(coalesce(m._writetime, 0) - coalesce(o.w, 0)) <= 1000000 AND abs(coalesce(m._ttl, 0) - coalesce(o.l, 0)) <= 60 AS within
FROM meta m FULL JOIN other o ON m.o_custkey = o.o_custkey AND m.o_orderkey = o.o_orderkey""")
def validate_tolerance(spark, sf_dir):
    """Write times and lifetimes of two sides, each of which has rows that the other lacks."""
    rows = merge.preserve(fx.order_meta(fx.read(spark, sf_dir, "orders")), fx.ORDERS).select("o_custkey", "o_orderkey", "_writetime", "_ttl")
    key = F.col("o_orderkey")
    moved = F.when(F.pmod(key, F.lit(11)) == 0, F.col("_writetime") + 2_000_000).when(F.pmod(key, F.lit(13)) == 0, F.lit(None)).otherwise(F.col("_writetime") + 500_000)
    own = key + F.when(F.pmod(key, F.lit(19)) == 0, 1_000_000_000).otherwise(0)
    other = rows.select("o_custkey", own.alias("o_orderkey"), moved.alias("_writetime"), (F.col("_ttl") + F.when(F.pmod(key, F.lit(17)) == 0, 61).otherwise(0)).alias("_ttl"))
    return validate.within_tolerance(rows, other, ["o_custkey", "o_orderkey"])


_DIFF_SQL = f"""
diffs AS (
  SELECT coalesce(s.o_custkey, t.o_custkey) AS o_custkey, coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
         CASE WHEN t.o_orderkey IS NULL THEN 'only_source' WHEN s.o_orderkey IS NULL THEN 'only_target' ELSE 'value_mismatch' END AS kind,
         CASE WHEN s.o_orderkey IS NOT NULL AND t.o_orderkey IS NOT NULL THEN 'o_totalprice: ' || CAST(CAST(s.o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) || ' / ' || CAST(CAST(t.o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) ELSE '' END AS changed
  FROM orders s FULL JOIN target t ON s.o_custkey = t.o_custkey AND s.o_orderkey = t.o_orderkey
  WHERE t.o_orderkey IS NULL OR s.o_orderkey IS NULL OR s.o_totalprice IS DISTINCT FROM t.o_totalprice
)"""
_KEYS = ["o_custkey", "o_orderkey"]
_REGULAR = ["o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice"]


def _diffs(spark, sf_dir) -> DataFrame:
    source, target = _sides(spark, sf_dir)
    found = validate.full_diff(source, target, _KEYS, _REGULAR)
    cents = lambda x: F.coalesce(x.try_cast("decimal(18,2)").cast("string"), F.lit("N"))
    text = F.array_join(F.transform("changed", lambda x: F.concat(x["name"], F.lit(": "), cents(x["source"]), F.lit(" / "), cents(x["target"]))), "; ")
    return found.withColumn("changed", text)


@query(f"WITH {fx.TARGET_SQL}, {_DIFF_SQL} SELECT * FROM diffs")
def validate_full_diff(spark, sf_dir):
    return _diffs(spark, sf_dir)


@query(f"""
WITH {fx.TARGET_SQL}, {_DIFF_SQL}, numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY unit ORDER BY CAST(kind = 'only_target' AS INT), o_custkey, o_orderkey) AS INT) AS nth FROM (SELECT *, {fx.unit_sql('o_custkey')} AS unit FROM diffs)
) SELECT * FROM numbered WHERE nth <= 20""")
def validate_diff_sample(spark, sf_dir):
    found = fx.in_units(_diffs(spark, sf_dir), "o_custkey").drop("_tok")
    return validate.diff_sample(found, _KEYS).withColumn("nth", F.col("nth").cast("int"))


@query(f"""
WITH {fx.TARGET_SQL}, {_digest_sql('source_d', 'orders')}, {_digest_sql('target_d', 'target')}, {_COMPARED}
SELECT count(*) AS units, count(*) FILTER (matches) AS matching, CAST(coalesce(sum(source_rows), 0) AS BIGINT) AS source_rows, CAST(coalesce(sum(target_rows), 0) AS BIGINT) AS target_rows, coalesce(bool_and(matches), true) AS all_match FROM compared""")
def validate_report(spark, sf_dir):
    return validate.report(validate_digest(spark, sf_dir))


# ---- change capture


@query(f"""
WITH {fx.log_sql(True, True)}
SELECT seq, op2 AS op, action, user_id, k, cells, cols FROM (
  SELECT *, CASE op WHEN 'left' THEN 'range_start_inclusive' WHEN 'right' THEN 'range_end_exclusive' ELSE op END AS op2, unnest(
    CASE WHEN op IN ('row_insert', 'row_update') THEN CASE WHEN drops THEN ['upsert', 'delete_columns'] ELSE ['upsert'] END
         WHEN op = 'row_delete' THEN ['delete_row'] WHEN op = 'partition_delete' THEN ['delete_partition'] WHEN op IN ('left', 'right') THEN ['delete_range'] ELSE ['ignore'] END) AS action
  FROM log), LATERAL (SELECT CASE WHEN action = 'upsert' AND drops THEN 'kind' WHEN action = 'upsert' AND value IS NOT NULL THEN 'kind,value' WHEN action = 'upsert' THEN 'kind' ELSE '' END AS cells,
  CASE WHEN action = 'delete_columns' THEN 'value' ELSE '' END AS cols)""")
def cdc_plan(spark, sf_dir):
    planned = cdc.plan(fx.change_log(fx.read(spark, sf_dir, "events"), True, True), fx.EVENTS)
    return planned.select("seq", "op", "action", "user_id", "k", F.array_join(F.transform("cells", lambda c: c["name"]), ",").alias("cells"), F.array_join("columns", ",").alias("cols"))


@query(f"""
WITH {fx.log_sql(True, True)}, acts AS (
  SELECT unnest(CASE WHEN op IN ('row_insert', 'row_update') THEN CASE WHEN drops THEN ['upsert', 'delete'] ELSE ['upsert'] END WHEN op = 'pre_image' THEN ['ignore'] ELSE ['delete'] END) AS a FROM log
) SELECT count(*) FILTER (a <> 'ignore') AS applied, count(*) FILTER (a = 'ignore') AS ignored, count(*) FILTER (a = 'upsert') AS upserts, count(*) FILTER (a = 'delete') AS deletes FROM acts""")
def cdc_report(spark, sf_dir):
    return cdc.counters(cdc.plan(fx.change_log(fx.read(spark, sf_dir, "events"), True, True), fx.EVENTS))


def _apply_sql(partitions: bool, ranges: bool) -> str:
    gone = ["SELECT user_id, k, time FROM log WHERE op = 'row_delete'"]
    if partitions:
        gone.append("SELECT c.user_id, c.k, l.time FROM (SELECT DISTINCT user_id, k FROM cells) c JOIN log l ON l.user_id = c.user_id AND l.op = 'partition_delete'")
    if ranges:
        gone.append("SELECT c.user_id, c.k, i.time FROM (SELECT DISTINCT user_id, k FROM cells) c JOIN intervals i ON i.user_id = c.user_id AND c.k >= lo AND c.k < hi")
    return f"""
WITH {fx.log_sql(partitions, ranges)}, bounds AS (
  SELECT user_id, op, k AS lo, lead(op) OVER w AS next_op, lead(k) OVER w AS hi, lead(time) OVER w AS time FROM log WHERE op IN ('left', 'right') WINDOW w AS (PARTITION BY user_id ORDER BY time, seq)
), intervals AS (
  SELECT * FROM bounds WHERE op = 'left' AND next_op = 'right'
), cells AS (
  SELECT user_id, k, 'value' AS name, CAST(value AS VARCHAR) AS v, time, drops AS deleted FROM log WHERE op IN ('row_insert', 'row_update') AND (value IS NOT NULL OR drops)
  UNION ALL SELECT user_id, k, 'kind', kind, time, false FROM log WHERE op IN ('row_insert', 'row_update')
  UNION ALL SELECT user_id, k, 'marker', '', time, false FROM log WHERE op IN ('row_insert', 'row_update')
), won AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k, name ORDER BY time DESC, deleted DESC, v DESC) AS nth FROM cells) WHERE nth = 1
), gone AS (
  SELECT user_id, k, max(time) AS gone_at FROM ({' UNION ALL '.join(gone)}) GROUP BY ALL
), alive AS (
  SELECT won.* FROM won LEFT JOIN gone USING (user_id, k) WHERE gone_at IS NULL OR won.time > gone_at
)
SELECT user_id, k, max(CASE WHEN name = 'value' AND NOT deleted THEN v END) AS value, max(CASE WHEN name = 'kind' THEN v END) AS kind
FROM alive GROUP BY user_id, k HAVING count(*) FILTER (name = 'marker' OR NOT deleted) > 0"""


def _applied(spark, sf_dir, partitions: bool, ranges: bool) -> DataFrame:
    return cdc.apply(cdc.plan(fx.change_log(fx.read(spark, sf_dir, "events"), partitions, ranges), fx.EVENTS), fx.EVENTS)


@query(_apply_sql(False, False))
def cdc_apply_snapshot(spark, sf_dir):
    return _applied(spark, sf_dir, False, False)


@query(_apply_sql(True, False))
def cdc_partition_delete(spark, sf_dir):
    return _applied(spark, sf_dir, True, False)


@query(_apply_sql(True, True))
def cdc_range_delete(spark, sf_dir):
    return _applied(spark, sf_dir, True, True)


@query(f"""
WITH {fx.SLOT_SQL}, gone AS (
  SELECT s.user_id, s.a, s.b, max(i.until) AS t FROM (SELECT DISTINCT user_id, a, b FROM slots WHERE op = 'row') s JOIN bounds i ON i.user_id = s.user_id AND i.op = 'left' AND i.next_op = 'right'
    AND (s.a > i.a OR s.a = i.a AND (i.b IS NULL OR s.b >= i.b)) AND (s.a < i.ha OR s.a = i.ha AND s.b < i.hb) GROUP BY ALL
), parts AS (SELECT user_id, max(time) AS t FROM slots WHERE op = 'partition' GROUP BY 1),
cells AS (SELECT user_id, a, b, max((time, kind)) AS k FROM slots WHERE op = 'row' GROUP BY ALL)
SELECT c.user_id, c.a, c.b, k[2] AS kind FROM cells c LEFT JOIN gone g ON g.user_id = c.user_id AND g.a = c.a AND g.b = c.b LEFT JOIN parts p ON p.user_id = c.user_id
WHERE coalesce(k[1] > g.t, true) AND coalesce(k[1] > p.t, true)""")
def cdc_composite_range_delete(spark, sf_dir):
    """Ranges over two clustering columns: bounds by the first alone, or by an equal or differing first and the second."""
    return cdc.apply(cdc.plan(fx.slot_log(fx.read(spark, sf_dir, "events")), fx.SLOTS), fx.SLOTS)


@query(f"""
WITH {fx.SLOT_SQL} SELECT count(*) AS bounds, count(*) FILTER (NOT (op = 'left' AND coalesce(next_op, '') = 'right' OR op = 'right' AND coalesce(last_op, '') = 'left')) AS unpaired FROM bounds""")
def cdc_unpaired_bounds(spark, sf_dir):
    return cdc.unpaired(cdc.plan(fx.slot_log(fx.read(spark, sf_dir, "events")), fx.SLOTS), fx.SLOTS)


@query("""
WITH log AS (SELECT epoch_us(ts) AS time FROM events)
SELECT time - time % 60000000 AS window_start, count(*) AS n_changes FROM log WHERE time <= (SELECT max(time) - 30000000 FROM log) GROUP BY 1""")
def cdc_window(spark, sf_dir):
    return cdc.windows(fx.change_log(fx.read(spark, sf_dir, "events")))


# ---- JSON mutations

_MUTATION_TABLE = TableSchema("shop", "kv", (ColumnInfo("user_id", "bigint", fx.PK, 0), ColumnInfo("k", "int", fx.CK, 0), ColumnInfo("v", "double"), ColumnInfo("kind", "text")))
_K = "json_extract_string(props, '$.k')"


def _mutations(events: DataFrame) -> DataFrame:
    key = F.col("event_id")
    op = F.when(F.col("event_type").isin("signup", "purchase"), "insert").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "view", "delete_partition").otherwise("delete_row")
    k = F.when(F.pmod(key, F.lit(50)) == 0, F.lit("")).otherwise(F.concat(F.lit(', "k": '), F.get_json_object("props", "$.k")))
    rest = F.when(F.pmod(key, F.lit(20)) == 1, F.lit("")).otherwise(F.concat(F.lit(', "v": '), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(', "kind": "'), F.col("event_type"), F.lit('", "other": true')))
    text = F.concat(F.lit('{"user_id": '), F.col("user_id").cast("string"), k, rest, F.lit("}"))
    return events.select("event_id", op.alias("op"), text.alias("columns"), fx.micros("ts").alias("timestamp_us"), F.when(F.pmod(key, F.lit(10)) == 0, 86400).alias("ttl_secs"))


@query(f"""
WITH m AS (
  SELECT event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'insert' WHEN event_type = 'click' THEN 'update' WHEN event_type = 'view' THEN 'delete_partition' ELSE 'delete_row' END AS op,
         user_id, CASE WHEN event_id % 50 <> 0 THEN CAST({_K} AS INT) END AS k, CASE WHEN event_id % 20 <> 1 THEN CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) END AS v, CASE WHEN event_id % 20 <> 1 THEN event_type END AS kind,
         epoch_us(ts) AS t, CASE WHEN event_id % 10 = 0 THEN 86400 END AS l FROM events
), e AS (
  SELECT *, CASE WHEN op <> 'delete_partition' AND k IS NULL THEN 'missing key column k' WHEN op = 'update' AND v IS NULL AND kind IS NULL THEN 'update without columns' END AS error FROM m
)
SELECT event_id, op, user_id, k, v, kind, CASE WHEN op LIKE 'delete%' THEN NULL ELSE t END AS writetime, CASE WHEN op LIKE 'delete%' THEN NULL ELSE l END AS ttl, error, CASE WHEN error IS NULL THEN op ELSE 'error' END AS action FROM e""")
def dual_write_plan(spark, sf_dir):
    return dualwrite.plan(_mutations(fx.read(spark, sf_dir, "events")), _MUTATION_TABLE)


@query(f"""
SELECT event_id, CASE WHEN 3 * k <= 127 THEN 3 * k END AS tiny, CASE WHEN 3 * k > 127 THEN 'out of range for tinyint' END AS tiny_error, CAST(k AS VARCHAR) AS word, k % 2 = 0 AS flag,
       CAST(k AS DOUBLE) / 4 AS real, CAST(NULL AS INT) AS absent FROM (SELECT event_id, CAST({_K} AS INT) AS k FROM events)""")
def json_typed(spark, sf_dir):
    from rangeflow.functions.cqltypes import parse

    k = F.get_json_object("props", "$.k").cast("int")
    text = F.concat(F.lit('{"tiny": '), (k * 3).cast("string"), F.lit(', "word": "'), k.cast("string"), F.lit('", "flag": '), F.when(k % 2 == 0, "true").otherwise("false"), F.lit(', "real": '), (k.cast("double") / 4).cast("string"), F.lit(', "absent": null}'))
    rows = fx.read(spark, sf_dir, "events").select("event_id", text.alias("columns"))
    get = lambda name, kind: dualwrite.typed(dualwrite.json_text("columns", name), parse(kind))
    tiny, why = get("tiny", "tinyint")
    return rows.select("event_id", tiny.cast("int").alias("tiny"), why.alias("tiny_error"), get("word", "text")[0].alias("word"), get("flag", "boolean")[0].alias("flag"), get("real", "double")[0].alias("real"), get("absent", "int")[0].alias("absent"))


# ---- checkpoints and progress


def _run_units(spark, sf_dir) -> DataFrame:
    return fx.run_units(fx.in_units(fx.read(spark, sf_dir, "orders").select("o_custkey"), "o_custkey"), spark)


@query(f"""
WITH {fx.UNITS_SQL}
SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) AS total,
       CAST(coalesce(sum(rows_read), 0) AS BIGINT) AS rows_read, CAST(coalesce(sum(rows_written), 0) AS BIGINT) AS rows_written, CAST(coalesce(sum(bytes_written), 0) AS BIGINT) AS bytes_written,
       count(*) > 0 AND count(*) FILTER (state <> 'completed') = 0 AS done FROM units""")
def checkpoint_summary(spark, sf_dir):
    return checkpoint.summarise(_run_units(spark, sf_dir))


@query(f"WITH {fx.UNITS_SQL} SELECT unit, token_start, token_end, state FROM units WHERE state = 'pending' ORDER BY token_start LIMIT 1")
def claim_next(spark, sf_dir):
    return checkpoint.next_pending(_run_units(spark, sf_dir)).select("unit", "token_start", "token_end", "state")


@query(f"WITH {fx.UNITS_SQL} SELECT unit, token_start, state FROM units WHERE state IN ('pending', 'running', 'failed')")
def units_resumable(spark, sf_dir):
    return checkpoint.resumable(_run_units(spark, sf_dir)).select("unit", "token_start", "state")


@query(f"WITH {fx.UNITS_SQL} SELECT unit, CASE WHEN state = 'running' AND coalesce(heartbeat_at, updated_at) < 1080.0 THEN 'pending' ELSE state END AS state FROM units")
def lease_reclaim(spark, sf_dir):
    return checkpoint.reclaimed(_run_units(spark, sf_dir), 1200.0).select("unit", "state")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 12")
def recent_migrations(spark, sf_dir):
    """The twelve newest entries of a history, which the orders stand for."""
    return fx.read(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(12).select("o_orderkey", "o_orderdate")


_PROGRESS_SQL = f"""
WITH {fx.UNITS_SQL}, f AS (
  SELECT *, CAST(greatest(token_end - token_start, 1) AS DOUBLE) AS w,
         CASE WHEN state IN ('completed', 'failed') THEN 1.0::DOUBLE WHEN state = 'running' THEN coalesce(least(greatest(CAST(last_token - token_start AS DOUBLE) / CAST(greatest(token_end - token_start, 1) AS DOUBLE), 0), 0.999::DOUBLE), 0) ELSE 0.0::DOUBLE END AS part FROM units
), p AS (
  SELECT 100.0::DOUBLE * count(*) FILTER (state IN ('completed', 'failed')) / count(*) AS percent_units, 100.0::DOUBLE * sum(w * part) / sum(w) AS percent_done, 100.0::DOUBLE * count(*) FILTER (state = 'failed') / count(*) AS percent_failed FROM f
)"""


@query(_PROGRESS_SQL + " SELECT round(percent_units, 6) AS percent_units, round(percent_done, 6) AS percent_done, round(percent_failed, 6) AS percent_failed FROM p")
def progress_estimate(spark, sf_dir):
    found = progress.progress(_run_units(spark, sf_dir))
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query(_PROGRESS_SQL + " SELECT round((100.0::DOUBLE - percent_done) / percent_done * 100.0::DOUBLE, 4) AS eta_seconds, (SELECT sum(rows_written) FROM units) / 100.0::DOUBLE AS rows_per_second FROM p")
def eta(spark, sf_dir):
    """What is left of a run after a hundred seconds, and its pace."""
    units = _run_units(spark, sf_dir)
    both = progress.progress(units).join(F.broadcast(checkpoint.summarise(units)))
    return both.select(F.round(progress.eta_seconds(F.col("percent_done"), F.lit(100.0)), 4).alias("eta_seconds"), progress.rate(F.col("rows_written"), F.lit(100.0)).alias("rows_per_second"))


@query(f"""WITH {fx.UNITS_SQL} SELECT unit, state FROM units WHERE state <> 'completed'
UNION ALL SELECT unit, state FROM (SELECT unit, state FROM units WHERE state = 'completed' ORDER BY updated_at DESC, unit LIMIT 2)""")
def ui_units(spark, sf_dir):
    return checkpoint.shown(_run_units(spark, sf_dir), 14).select("unit", "state")


_P99_SQL = """
SELECT event_id, list_sort(list(value) OVER w)[CAST(ceil(0.99::DOUBLE * len(list(value) OVER w)) AS INT)] AS p99 FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)"""


@query(_P99_SQL)
def p99_window(spark, sf_dir):
    """The moving 99th percentile of each user's last 32 values."""
    return progress.moving_p99(fx.read(spark, sf_dir, "events"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "p99")


@query("""
WITH bounds AS (SELECT pow(2.0::DOUBLE, i) AS le FROM range(15) r(i) UNION ALL SELECT 'inf'::DOUBLE)
SELECT le, count(value) AS n FROM bounds LEFT JOIN events ON value <= le GROUP BY le""")
def latency_histogram(spark, sf_dir):
    return progress.latency_histogram(fx.read(spark, sf_dir, "events"), "value")


@query(f"""
WITH {fx.UNITS_SQL}, s AS (SELECT CAST(sum(rows_read) AS BIGINT) AS rows_read, CAST(sum(rows_written) AS BIGINT) AS rows_written, CAST(sum(bytes_written) AS BIGINT) AS bytes_written,
  CAST(count(*) FILTER (state = 'pending') AS BIGINT) AS ranges_pending, CAST(count(*) FILTER (state = 'running') AS BIGINT) AS ranges_running, CAST(count(*) FILTER (state = 'completed') AS BIGINT) AS ranges_completed FROM units)
UNPIVOT s ON rows_read, rows_written, bytes_written, ranges_pending, ranges_running, ranges_completed INTO NAME metric VALUE value""")
def metrics_snapshot(spark, sf_dir):
    s = checkpoint.summarise(_run_units(spark, sf_dir))
    names = {"rows_read": "rows_read", "rows_written": "rows_written", "bytes_written": "bytes_written", "ranges_pending": "pending", "ranges_running": "running", "ranges_completed": "completed"}
    cell = lambda n, c: F.struct(F.lit(n).alias("metric"), F.col(c).cast("bigint").alias("value"))
    return s.select(F.explode(F.array(*(cell(n, c) for n, c in names.items()))).alias("m")).select("m.*")


@query("SELECT CAST(a AS INT) AS attempt, CASE WHEN a <= 1 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE * pow(2.0::DOUBLE, a - 2), 1000.0::DOUBLE) END AS wait_ms FROM range(1, 9) r(a)")
def backoff(spark, sf_dir):
    return spark.range(1, 9).select(F.col("id").cast("int").alias("attempt"), progress.backoff_column(F.col("id"), 100, 1000).alias("wait_ms"))


@query("""
WITH RECURSIVE waves AS (
  SELECT CAST(event_id % 128 AS INT) AS wave, CAST(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) // count(*) AS DOUBLE) AS latency_ms FROM events GROUP BY 1
), seen AS (
  SELECT *, max(latency_ms) OVER (ORDER BY wave ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS worst, row_number() OVER (ORDER BY wave) AS n, (SELECT sum(latency_ms) / count(*) FROM waves) AS target FROM waves
), trace AS (
  SELECT 0::BIGINT AS n, 64 AS concurrency
  UNION ALL
  SELECT s.n, CASE WHEN worst > target * 2.5 THEN greatest(8, CAST(floor(concurrency * 0.8::DOUBLE) AS INT)) WHEN worst < 0.7::DOUBLE * (target * 2.5) THEN least(512, concurrency + 4) ELSE concurrency END
  FROM trace t JOIN seen s ON s.n = t.n + 1
) SELECT wave, latency_ms, concurrency FROM trace JOIN seen USING (n)""")
def aimd_trace(spark, sf_dir):
    """Concurrency after each of a run's wave latencies; the controller is sequential by nature and sees one value a wave, not rows."""
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    waves = fx.read(spark, sf_dir, "events").groupBy(F.pmod("event_id", F.lit(128)).cast("int").alias("wave")).agg(cents.alias("s"), F.count(F.lit(1)).alias("n")).orderBy("wave").collect()  # 128 rows
    latencies = [(w.wave, float(w.s // w.n)) for w in waves]
    throttle = progress.Throttle(target_ms=sum(x for _, x in latencies) / max(1, len(latencies)) * 2.5)
    return spark.createDataFrame([(w, x, throttle.observe(x)) for w, x in latencies], "wave int, latency_ms double, concurrency int")


@query(f"""
WITH {fx.UNITS_SQL}, s AS (
  SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) AS total,
         CAST(sum(rows_read) AS BIGINT) AS r, CAST(sum(rows_written) AS BIGINT) AS w, CAST(sum(bytes_written) AS BIGINT) AS b FROM units
)
SELECT kind, '{{"bytes_written": ' || b || ', "completed": ' || completed || ', "elapsed_seconds": 12.5' || CASE WHEN kind = 'failed' THEN ', "error": "unit 3"' ELSE '' END || ', "failed": ' || failed || ', "pending": ' || pending
  || ', "rows_read": ' || r || ', "rows_written": ' || w || ', "run": "orders", "running": ' || running || ', "status": "' || kind || '", "total": ' || total || '}}' AS body FROM s, (VALUES ('complete'), ('failed')) k(kind)""")
def notify_payload(spark, sf_dir):
    found = checkpoint.summarise(_run_units(spark, sf_dir)).drop("done").first().asDict()
    return spark.createDataFrame([("complete", progress.notification("orders", "complete", found, 12.5)), ("failed", progress.notification("orders", "failed", found, 12.5, "unit 3"))], "kind string, body string")


# ---- streams and whole runs


@query(_apply_sql(True, True))
def cdc_stream_apply(spark, sf_dir):
    """The log as a stream: planned in micro-batches, stored, and applied."""
    from rangeflow.sources.storage import table_stream, work_dir
    from rangeflow.streaming import changes

    folder, stream = work_dir(spark, "changes"), table_stream(spark, sf_dir, "events")
    changes.capture(fx.change_log(stream, True, True), fx.EVENTS, folder).awaitTermination()
    return changes.table(spark, fx.EVENTS, folder)


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice FROM orders")
def copy_table(spark, sf_dir):
    """A whole copy by committed units, read back."""
    import os
    import tempfile

    from rangeflow.engine import Copy
    from rangeflow.sources.storage import work_dir

    with tempfile.TemporaryDirectory() as d:  # the driver's own checkpoint file
        copy = Copy(spark, fx.read(spark, sf_dir, "orders"), fx.ORDERS, work_dir(spark, "copy"), checkpoint.Checkpoint(os.path.join(d, "run.db")), fx.portable_token(F.col("o_custkey")), fx.PARENT)
        key = copy.start("orders", fx.UNITS)
        copy.run(key)
        return copy.result(key).drop("_tok")


@query(f"WITH {fx.ORDER_META_SQL} SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice, _writetime, _ttl FROM meta")
def copy_preserving(spark, sf_dir):
    """A copy with write times and lifetimes, by units between the tokens of a topology, in two waves."""
    import os
    import tempfile

    from rangeflow.engine import Copy
    from rangeflow.sources.storage import work_dir

    with tempfile.TemporaryDirectory() as d:  # the driver's own checkpoint file
        orders, tokens = fx.order_meta(fx.read(spark, sf_dir, "orders")), tuple(k * 2**57 for k in range(1, 8))
        copy = Copy(spark, orders, fx.ORDERS, work_dir(spark, "copy"), checkpoint.Checkpoint(os.path.join(d, "run.db")), fx.portable_token(F.col("o_custkey")), mode="vnode", tokens=tokens, preserve_writetime=True, preserve_ttl=True)
        key = copy.start("orders", 16)
        copy.run(key, wave=8)
        return copy.result(key).drop("_tok")


@query(_apply_sql(True, True))
def cdc_compacted(spark, sf_dir):
    """The plans of the log, compacted in two parts, and applied."""
    log = fx.change_log(fx.read(spark, sf_dir, "events"), True, True)
    first, rest = (cdc.plan(log.where(F.pmod("seq", F.lit(2)) == k), fx.EVENTS) for k in (0, 1))
    both = cdc.compact(first, fx.EVENTS).unionByName(rest.select("action", "op", "user_id", "k", "cells", "columns", "time", "seq"))
    return cdc.apply(cdc.compact(both, fx.EVENTS), fx.EVENTS)
