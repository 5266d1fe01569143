import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeflow.operators import cdc, dualwrite, merge, scan, validate
from rangeflow.plans import planner
from rangeflow.sources.schema import ColumnInfo, ColumnKind, TableSchema

PK, CK = ColumnKind.PARTITION_KEY, ColumnKind.CLUSTERING
TABLE = TableSchema("ks", "t", (ColumnInfo("pk", "text", PK), ColumnInfo("ck", "int", CK), ColumnInfo("v", "text")))
LOG = "op string, pk string, ck int, v string, deleted array<string>, time bigint, seq bigint"


def test_byte_estimate(spark):
    df = spark.createDataFrame([("abc", 1, None, None), (None, None, None, bytearray(b"1234"))], "a string, b int, c array<int>, d binary").select("a", "b", "d")
    sizes = [r[0] for r in df.select(scan.row_bytes(df)).collect()]
    assert sizes == [3 + 4 + 1, 1 + 1 + 4]
    nested = spark.createDataFrame([({"a": [1, 2]},)], "m map<string,array<int>>")
    assert nested.select(scan.row_bytes(nested)).first()[0] == 4 + 1 + 4 + 8


def test_chunks(spark):
    df = spark.range(120).withColumn("unit", F.lit(0))
    sizes = [r["count"] for r in scan.in_chunks(df, "unit", ["id"], 50).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [50, 50, 20]


def test_chunks_of_many_cells(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("tok"), (F.col("id") % 3).alias("unit"), F.col("id"))
    df = df.unionByName(spark.range(200).select(F.lit(5).cast("long").alias("tok"), F.lit(None).cast("long").alias("unit"), "id"))
    found = scan.in_chunks(df, "unit", ["tok", "id"], 70).collect()
    for unit in (0, 1, 2, None):
        own = sorted((r.tok, r.id, r.chunk) for r in found if r.unit == unit)
        assert [c for *_, c in own] == [i // 70 for i in range(len(own))]


def test_units_of_uneven_plans(spark, monkeypatch):
    ranges = [planner.TokenRange(a, b) for a, b in ((-(2**63), -5), (-5, 7), (10, 2**40), (2**40, 2**62))]
    df = spark.createDataFrame([(t,) for t in (-(2**63), -(2**63) + 1, -5, -4, 7, 8, 10, 11, 2**40, 2**40 + 1, 2**62, 2**62 + 1, None)], "_tok bigint")
    want = [None, 0, 0, 1, 1, None, None, 2, 2, 3, 3, None, None]
    found = {r._tok: r.unit for r in scan.assign_ranges(df, planner.frame(spark, ranges)).collect()}
    assert [found[t] for t in (-(2**63), -(2**63) + 1, -5, -4, 7, 8, 10, 11, 2**40, 2**40 + 1, 2**62, 2**62 + 1, None)] == want
    assert "NestedLoop" not in scan.assign_ranges(df, planner.frame(spark, ranges))._jdf.queryExecution().executedPlan().toString()


def test_row_hash_tells_null_from_empty(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a"), ("a", ""), ("", "a")], "x string, y string")
    h = [r[0] for r in df.select(validate.row_hash(df, ["x", "y"])).collect()]
    assert h[1] == h[3] and len(set(h)) == 3


def hashes(spark, schema, *values):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(validate.row_hash(df, ["x"])).collect()]


def test_row_hash_is_exact(spark):
    nan = float("nan")
    values = [1.001, 1.004, 0.1, 0.1 + 2**-56, 0.30000000000000004, 0.3, 1e17, 1e300, -1e300, 5e-324, 2.0**-1022, float("inf"), -float("inf"), nan, None, 0.0, 3.0, 2.0**53, 2.0**53 + 2]
    assert len(set(hashes(spark, "x double", *values))) == len(values)
    assert len(set(hashes(spark, "x double", 0.0, -0.0))) == 1 and len(set(hashes(spark, "x double", nan, -nan))) == 1
    assert len(set(hashes(spark, "x float", 1.5, 1.25, 3.4e38, None))) == 4


def test_numbers_by_their_bits(spark):
    import math
    import random

    rng = random.Random(2)
    values = [rng.choice((-1, 1)) * rng.random() * 2.0 ** rng.randrange(-1060, 1020) for _ in range(3000)] + [2.0**k for k in range(-1074, 1024)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 7)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for v, text in zip(values, (r[0] for r in df.select(validate.cell_text(F.col("x"), T.DoubleType())).collect())):
        if v:
            whole, power = text.lstrip("-").split("p")
            assert math.ldexp(int(whole), int(power) - 52) == abs(v) and text.startswith("-") == (v < 0) and 2**52 <= int(whole) < 2**53


def test_row_hash_frames_what_is_nested(spark):
    for kind, values in (
        ("array<string>", [["a,b"], ["a", "b"], ["N"], [None], [], None, [""], ["", ""]]),
        ("map<string,string>", [{"a": "b,c=d"}, {"a": "b", "c": "d"}, {"a": None}, {"a": "N"}, {}, None, {"a=N": ""}]),
        ("struct<p:string,q:string>", [("a,b", None), ("a", "b"), (None, None), ("N", None), None, ("", "")]),
        ("array<array<double>>", [[[1.001]], [[1.004]], [[], [1.001]], [[1.001], []], [None], [[None]]]),
    ):
        assert len(set(hashes(spark, f"x {kind}", *values))) == len(values), kind


def test_full_diff_of_close_numbers(spark):
    a, b = (spark.createDataFrame([(1, v, ["x,y"] if v == 1.001 else ["x", "y"])], "k int, v double, l array<string>") for v in (1.001, 1.004))
    (found,) = validate.full_diff(a, b, ["k"], ["v", "l"]).collect()
    assert [c.name for c in found.changed] == ["l", "v"]
    assert validate.full_diff(a, a, ["k"], ["v", "l"]).count() == 0


def test_tolerance_of_one_sided_rows(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "k int, _writetime bigint, _ttl int")
    found = validate.within_tolerance(side((1, 5, 0), (2, 5, None), (None, 1, 1)), side((1, 9, 0), (3, 5, 0), (None, 1, 1)), ["k"]).collect()
    assert sorted(((r.k, r.within) for r in found), key=str) == [(1, True), (2, False), (3, False), (None, True)]


def test_no_units_match(spark):
    plan = planner.frame(spark, planner.split_range(planner.TokenRange(0, 10), 2))
    rows = spark.createDataFrame([], "unit int, k bigint")
    d = validate.digests(rows, plan, ["k"])
    assert d.count() == 2 and validate.report(validate.compare(d, d)).first().all_match
    assert validate.report(validate.compare(d, d).limit(0)).first().all_match
    one = validate.digests(spark.createDataFrame([(0, 1)], "unit int, k bigint"), plan, ["k"])
    with pytest.raises(validate.ValidationError):
        validate.require_match(validate.compare(d, one))


def test_full_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (4, "w"), (None, "n")], "k int, v string")
    found = {(r.k, r.kind, tuple((c.name, c.source, c.target) for c in r.changed)) for r in validate.full_diff(a, b, ["k"], ["v"]).collect()}
    assert found == {(1, "value_mismatch", (("v", "x", "y"),)), (3, "only_source", ()), (4, "only_target", ())}


def test_last_write_wins_is_idempotent(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c"), (1, 7, "a")], "k int, t int, v string")
    once = merge.last_write_wins(df, ["k"], ["t", "v"])
    assert sorted(map(tuple, once.collect())) == [(1, 7, "b"), (2, 1, "c")]
    assert sorted(map(tuple, merge.last_write_wins(once.union(df), ["k"], ["t", "v"]).collect())) == [(1, 7, "b"), (2, 1, "c")]


def test_last_write_wins_on_maps(spark):
    df = spark.createDataFrame([(1, 5, {"a": 1}), (1, 7, {"b": 2}), (2, 1, None)], "k int, t int, m map<string,int>")
    assert sorted(map(tuple, merge.last_write_wins(df, ["k"], ["t"]).collect())) == [(1, 7, {"b": 2}), (2, 1, None)]


def test_sets_are_rebuilt(spark):
    rows = [(1, "tags", "a", 1, False), (1, "tags", "b", 1, False), (1, "tags", "a", 2, True), (1, "tags", "c", 3, True), (1, "tags", "c", 4, False)]
    df = spark.createDataFrame(rows, "k int, column string, element string, writetime bigint, deleted boolean")
    assert merge.rebuild_sets(df, ["k"]).first().entries == ["b", "c"]


def log(spark, *rows):
    return spark.createDataFrame([(op, pk, ck, v, d, t, i) for i, (op, pk, ck, v, d, t) in enumerate(rows)], LOG)


def test_cdc_plan(spark):
    rows = log(spark, (cdc.PRE_IMAGE, "a", 1, "x", None, 1), (cdc.INSERT, "a", 1, None, None, 2), (cdc.UPDATE, "a", 1, "x", ["v"], 3), (cdc.UPDATE, "a", 1, None, ["v", "gone"], 4), (cdc.DELETE_ROW, "a", 1, None, None, 5), (cdc.DELETE_PARTITION, "a", None, None, None, 6), (cdc.LEFT_INCLUSIVE, "a", None, None, None, 7), (cdc.LEFT_EXCLUSIVE, "a", 3, None, None, 8))
    found = [(r.seq, r.action) for r in cdc.plan(rows, TABLE).orderBy("seq", "action").collect()]
    assert found == [(0, "ignore"), (1, "upsert"), (2, "delete_columns"), (2, "upsert"), (3, "delete_columns"), (4, "delete_row"), (5, "delete_partition"), (6, "ignore"), (7, "delete_range")]
    counts = cdc.counters(cdc.plan(rows, TABLE)).first()
    assert (counts.applied, counts.ignored, counts.upserts, counts.deletes) == (7, 2, 2, 5)


@pytest.mark.parametrize("row", [(cdc.INSERT, "a", None, "x", None, 1), (cdc.DELETE_ROW, None, 1, None, None, 1), ("other", "a", 1, None, None, 1)])
def test_cdc_never_skips(spark, row):
    with pytest.raises(Exception, match="lacks a key|unknown kind"):
        cdc.plan(log(spark, row), TABLE).collect()


def applied(spark, *rows, snapshot=None):
    return sorted(map(tuple, cdc.apply(cdc.plan(log(spark, *rows), TABLE), TABLE, snapshot).collect()), key=str)


def test_cdc_apply(spark):
    assert applied(spark, (cdc.INSERT, "a", 1, "x", None, 1), (cdc.UPDATE, "a", 1, "y", None, 3), (cdc.UPDATE, "a", 1, "z", None, 2)) == [("a", 1, "y")]
    assert applied(spark, (cdc.INSERT, "a", 1, "x", None, 1), (cdc.DELETE_ROW, "a", 1, None, None, 1)) == []
    assert applied(spark, (cdc.INSERT, "a", 1, "x", None, 1), (cdc.UPDATE, "a", 1, None, ["v"], 1)) == [("a", 1, None)]
    assert applied(spark, (cdc.INSERT, "a", 1, "x", None, 1), (cdc.DELETE_PARTITION, "a", None, None, None, 2), (cdc.INSERT, "a", 2, "n", None, 3)) == [("a", 2, "n")]
    old = spark.createDataFrame([("a", 1, "old", 5), ("b", 1, "old", 5)], "pk string, ck int, v string, _writetime bigint")
    assert applied(spark, (cdc.UPDATE, "a", 1, "late", None, 4), (cdc.UPDATE, "b", 1, "new", None, 6), snapshot=old) == [("a", 1, "old"), ("b", 1, "new")]


def test_range_deletes_are_intervals(spark):
    rows = [(cdc.INSERT, "a", k, "x", None, 1) for k in range(6)]
    both = [(cdc.LEFT_INCLUSIVE, "a", 2, None, None, 5), (cdc.RIGHT_EXCLUSIVE, "a", 4, None, None, 5)]
    assert [r[1] for r in applied(spark, *rows, *both)] == [0, 1, 4, 5]
    assert [r[1] for r in applied(spark, *rows, both[0])] == list(range(6))  # no partner, no interval


def test_composite_range_deletes(spark):
    schema = TableSchema("ks", "t", (ColumnInfo("pk", "text", PK), ColumnInfo("a", "int", CK, 0), ColumnInfo("b", "int", CK, 1), ColumnInfo("c", "int", CK, 2), ColumnInfo("v", "text")))
    every = [(a, b, c) for a in (4, 5, 8, 9) for b in (1, 2, 3) for c in (0, 7)]

    def left(*bounds):
        rows = [(cdc.INSERT, "p", *k, "x", None, 1) for k in every] + [(op, "p", *(*k, None, None, None)[:3], None, None, 5) for op, *k in bounds]
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "op string, pk string, a int, b int, c int, v string, deleted array<string>, time bigint, seq bigint")
        planned = cdc.plan(df, schema)
        return {(r.a, r.b, r.c) for r in cdc.apply(planned, schema).collect()}, tuple(cdc.unpaired(planned, schema).first())

    gone = lambda keep: {k for k in every if not keep(*k)}
    assert left((cdc.LEFT_INCLUSIVE, 5), (cdc.RIGHT_EXCLUSIVE, 9)) == (gone(lambda a, b, c: 5 <= a < 9), (2, 0))
    assert left((cdc.LEFT_EXCLUSIVE, 5, 1), (cdc.RIGHT_INCLUSIVE, 5, 3)) == (gone(lambda a, b, c: a == 5 and 1 < b <= 3), (2, 0))
    assert left((cdc.LEFT_INCLUSIVE, 5, 2, 7), (cdc.RIGHT_INCLUSIVE, 5, 2)) == (gone(lambda a, b, c: (a, b) == (5, 2) and c >= 7), (2, 0))
    assert left((cdc.LEFT_EXCLUSIVE, 4), (cdc.RIGHT_INCLUSIVE, 8), (cdc.LEFT_INCLUSIVE, 9)) == (gone(lambda a, b, c: 4 < a <= 8), (3, 1))
    assert left((cdc.LEFT_INCLUSIVE, 5), (cdc.RIGHT_INCLUSIVE, 8), (cdc.LEFT_INCLUSIVE, 8, 2), (cdc.RIGHT_INCLUSIVE, 9, 1)) == (gone(lambda a, b, c: 5 <= a <= 8 or (a, b) == (9, 1)), (4, 0))


def test_the_latest_interval_counts(spark):
    rows = [(cdc.INSERT, "a", k, "x", None, t) for k, t in ((1, 4), (2, 6), (3, 9), (4, 4), (5, 12))]
    spans = [(cdc.LEFT_INCLUSIVE, "a", 0, None, None, 8), (cdc.RIGHT_INCLUSIVE, "a", 3, None, None, 8), (cdc.LEFT_INCLUSIVE, "a", 1, None, None, 5), (cdc.RIGHT_INCLUSIVE, "a", 9, None, None, 5), (cdc.LEFT_INCLUSIVE, "a", 4, None, None, 11), (cdc.RIGHT_EXCLUSIVE, "a", 4, None, None, 11)]
    assert [r[1] for r in applied(spark, *rows, *spans)] == [3, 5]
    assert [r[1] for r in applied(spark, *rows, *spans, (cdc.DELETE_PARTITION, "a", None, None, None, 10))] == [5]


def test_ranges_and_partitions_meet_however_their_shuffles_are_read(spark):
    users = [f"u{i}" for i in range(400)]
    rows = [(cdc.INSERT, u, k, "x", None, 1) for u in users for k in (1, 4)]
    spans = [(op, u, k, None, None, 3) for u in users for op, k in ((cdc.LEFT_INCLUSIVE, 2), (cdc.RIGHT_EXCLUSIVE, 3))]
    gone = [(cdc.DELETE_PARTITION, u, None, None, None, 5) for u in users]
    # sizes at which the parts' shuffles are put together differently, as those of large tables are
    conf = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert applied(spark, *rows, *spans, *gone) == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_compacted_plans_say_the_same(spark):
    rows = [(cdc.INSERT, "a", k % 4, f"v{k}", None, k) for k in range(12)] + [(cdc.UPDATE, "a", 1, None, ["v"], 20), (cdc.DELETE_ROW, "a", 2, None, None, 9), (cdc.DELETE_PARTITION, "b", None, None, None, 5), (cdc.INSERT, "b", 1, "old", None, 4), (cdc.LEFT_INCLUSIVE, "a", 3, None, None, 15), (cdc.RIGHT_INCLUSIVE, "a", 3, None, None, 15)]
    planned = cdc.plan(log(spark, *rows), TABLE)
    small = cdc.compact(planned, TABLE)
    late = cdc.plan(log(spark, (cdc.INSERT, "a", 3, "late", None, 14), (cdc.INSERT, "b", 2, "late", None, 5), (cdc.INSERT, "a", 2, "new", None, 10)), TABLE)
    for extra in (late, late.limit(0)):
        both = [sorted(map(str, cdc.apply(p.unionByName(extra.select(p.columns)), TABLE).collect())) for p in (planned, small)]
        assert both[0] == both[1]
    assert small.count() < planned.count()


def test_json_typing(spark):
    t = TableSchema("k", "t", (ColumnInfo("pk", "text", PK), ColumnInfo("n", "tinyint"), ColumnInfo("u", "uuid"), ColumnInfo("b", "blob"), ColumnInfo("l", "list<int>"), ColumnInfo("m", "map<text, int>"), ColumnInfo("f", "boolean"), ColumnInfo("d", "date")))
    rows = [("insert", '{"pk": "a", "n": 127, "u": "6F9619FF-8B86-D011-B42D-00CF4FC964FF", "b": "0aff", "l": [1, null, 2], "m": {"x": 1}, "f": true, "zz": 1}'),
            ("insert", '{"pk": "a", "n": 128}'), ("insert", '{"pk": "a", "n": 1.5}'), ("insert", '{"n": 1}'), ("update", '{"pk": "a"}'), ("delete_partition", '{"pk": "a"}'), ("drop", '{"pk": "a"}'), ("insert", '{"pk": "a", "n": null}'), ("insert", '{"pk": "a", "d": "x"}'), ("insert", '{"pk": "a", "b": "ééz"}'), ("insert", '{"pk": "a", "m": {"x": null}}')]
    found = dualwrite.plan(spark.createDataFrame(rows, "op string, columns string"), t).collect()
    assert [r.action for r in found] == ["insert", "error", "error", "error", "error", "delete_partition", "error", "insert", "error", "insert", "error"]
    assert found[10].error == "m: null value in a map"
    assert (found[0].n, found[0].u, bytes(found[0].b), found[0].l, found[0].m, found[0].f) == (127, "6f9619ff-8b86-d011-b42d-00cf4fc964ff", b"\x0a\xff", [1, 2], {"x": 1}, True)
    assert found[1].error == "n: out of range for tinyint" and found[3].error == "missing key column pk" and bytes(found[9].b) == "ééz".encode()


def test_dual_write_order(spark):
    seen, batch = [], spark.createDataFrame([(1,)], "a int")

    def broken(df):
        raise OSError("down")

    dualwrite.write_both(batch, lambda df: seen.append("source"), lambda df: seen.append("target"))
    assert seen == ["source", "target"]
    with pytest.raises(OSError):
        dualwrite.write_both(batch, lambda df: None, broken)
    dualwrite.write_both(batch, lambda df: None, broken, require_both=False)
    with pytest.raises(OSError):
        dualwrite.write_both(batch, broken, lambda df: None, require_both=False)


def test_preserve_and_elements(spark):
    schema = TableSchema("ks", "t", (ColumnInfo("pk", "text", PK), ColumnInfo("v", "text"), ColumnInfo("attrs", "map<text, int>"), ColumnInfo("tags", "set<text>")))
    rows = spark.createDataFrame([("a", "x", {"p": 1, "q": 2}, ["t"], 5, 60), ("b", None, None, None, None, None)], "pk string, v string, attrs map<string,int>, tags array<string>, _wt_v bigint, _ttl_v int")
    kept = merge.preserve(rows, schema, job_time=F.lit(9))
    assert [(r._writetime, r._ttl) for r in kept.orderBy("pk").collect()] == [(5, 60), (9, 0)]
    elements = merge.explode_elements(kept, schema)
    assert sorted((r.column, r.element, r.value) for r in elements.collect()) == sorted([("attrs", "p", "1"), ("attrs", "q", "2"), ("tags", "t", None)], key=str)


def test_scan_pushes_the_token_down(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("_tok"), F.col("id").cast("string").alias("pk"), F.lit("x").alias("v"), F.lit(1).alias("unused"))
    df.write.parquet(str(tmp_path / "t"))
    schema = TableSchema("ks", "t", (ColumnInfo("pk", "text", PK), ColumnInfo("v", "text")))
    found = scan.range_scan(spark.read.parquet(str(tmp_path / "t")), schema, planner.TokenRange(10, 20))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(_tok,10), LessThanOrEqual(_tok,20)" in plan and "unused" not in plan
    assert found.count() == 10 and isinstance(found.schema["_tok"].dataType, T.LongType)
