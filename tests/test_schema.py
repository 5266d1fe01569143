import pytest

from rangeflow.functions.cqltypes import parse
from rangeflow.sources.schema import ColumnInfo, ColumnKind, Ensured, SchemaError, TableSchema, create_keyspace, differences, discover, ensure_table

PK, CK, ST = ColumnKind.PARTITION_KEY, ColumnKind.CLUSTERING, ColumnKind.STATIC
EVENTS = TableSchema("harbour", "berths", (ColumnInfo("vessel", "text"), ColumnInfo("docked", "date", CK, 0), ColumnInfo("pier", "int", PK, 1), ColumnInfo("port", "text", PK, 0)))


def test_canonical_order():
    assert [c.name for c in EVENTS.ordered] == ["port", "pier", "docked", "vessel"]
    assert [c.name for c in EVENTS.primary_key] == ["port", "pier", "docked"]


def test_statements():
    assert EVENTS.range_select() == 'SELECT "port", "pier", "docked", "vessel", token("port", "pier") FROM "harbour"."berths" WHERE token("port", "pier") > ? AND token("port", "pier") <= ?'
    assert 'writetime("vessel"), ttl("vessel"), token' in EVENTS.range_select(True, True)
    assert EVENTS.insert(True).endswith("VALUES (?, ?, ?, ?) USING TIMESTAMP ? AND TTL ?")
    assert EVENTS.create_table().endswith('PRIMARY KEY (("port", "pier"), "docked"))')
    hits = TableSchema("ks", "hits", (ColumnInfo("pk", "text", PK), ColumnInfo("c", "counter")))
    assert hits.counter_update() == 'UPDATE "ks"."hits" SET "c" = "c" + ? WHERE "pk" = ?'
    bags = TableSchema("ks", "t", (ColumnInfo("pk", "text", PK), ColumnInfo("attrs", "map<text, int>"), ColumnInfo("tags", "set<text>"), ColumnInfo("f", "frozen<list<int>>"), ColumnInfo('o"dd', "text", ST)))
    assert 'SET "attrs"[?] = ? WHERE "pk" = ?' in bags.element_update("attrs") and '"tags" = "tags" + {?}' in bags.element_update("tags")
    assert bags.element_select("attrs") == 'SELECT writetime("attrs"[?]), ttl("attrs"[?]) FROM "ks"."t" WHERE "pk" = ?'
    assert [c.name for c in bags.preservable()] == ['o"dd'] and [c.name for c in bags.preservable(True)] == ['o"dd', "f"]
    assert '"o""dd" text static' in bags.create_table()
    assert "SimpleStrategy" in create_keyspace("k") and "'dc1': 3" in create_keyspace("k", 3, "dc1")


def test_rejections():
    for bad in (lambda: TableSchema("k", "t", ()), lambda: TableSchema("k", "t", (ColumnInfo("a", "int"),)), lambda: create_keyspace("k", 0)):
        with pytest.raises(SchemaError):
            bad()


def test_types():
    assert str(parse("map<text, frozen<list<int>>>")) == "map<text, frozen<list<int>>>"
    assert parse("map<frozen<tuple<int, text>>, set<uuid>>").spark().simpleString() == "map<struct<_1:int,_2:string>,array<string>>"
    assert parse("vector<float, 3>").spark().simpleString() == "array<float>"
    for bad in ("map<text", "", "list<int>>", "a,b"):
        with pytest.raises(ValueError):
            parse(bad)


def test_compatibility_and_fingerprint():
    other = TableSchema("x", "y", tuple(reversed(EVENTS.columns)))
    assert not differences(EVENTS, other) and EVENTS.fingerprint() == other.fingerprint()
    changed = TableSchema("x", "y", (*EVENTS.columns[:3], ColumnInfo("port", "ascii", PK, 0)))
    assert differences(EVENTS, changed) and EVENTS.fingerprint() != changed.fingerprint()
    assert differences(EVENTS, TableSchema("x", "y", EVENTS.columns[1:]))


def test_discover_and_ensure(spark):
    df = spark.createDataFrame([("a", 1, [1.0], {"x": 1})], "pk string, ck int, v array<double>, m map<string,int>")
    schema = discover(df, "made_here", "t", ["pk"], ["ck"])
    assert [(c.name, c.cql_type) for c in schema.ordered] == [("pk", "text"), ("ck", "int"), ("m", "map<text, int>"), ("v", "list<double>")]
    assert ensure_table(spark, schema) is Ensured.CREATED_KEYSPACE_AND_TABLE
    assert ensure_table(spark, schema) is Ensured.ALREADY_EXISTS
    assert ensure_table(spark, TableSchema("made_here", "u", schema.columns)) is Ensured.CREATED_TABLE
    spark.sql("DROP DATABASE made_here CASCADE")
