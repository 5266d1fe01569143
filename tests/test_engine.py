import pytest
from pyspark.sql import functions as F

from rangeflow.engine import Copy, CopyError
from rangeflow.operators import validate
from rangeflow.plans import fixtures as fx
from rangeflow.plans.checkpoint import Checkpoint
from rangeflow.sources import storage
from rangeflow.sources.schema import SchemaError, TableSchema
from rangeflow.streaming import changes
from tests.conftest import DATA


@pytest.fixture
def copy(spark, tmp_path):
    orders = fx.read(spark, DATA, "orders")
    return Copy(spark, orders, fx.ORDERS, str(tmp_path / "out"), Checkpoint(str(tmp_path / "run.db")), fx.portable_token(F.col("o_custkey")), fx.PARENT)


def test_copy_resume_and_validate(spark, copy, monkeypatch):
    key, real, calls = copy.start("orders", 8), storage.write_units, []

    def flaky(rows, path):
        calls.append(path)
        if len(calls) == 2:
            real(rows, path)  # written, but the attempt dies before it is committed
            raise OSError("disk gone")
        return real(rows, path)

    monkeypatch.setattr(storage, "write_units", flaky)
    with pytest.raises(CopyError):
        copy.run(key, wave=3)
    assert copy.store.summary(key)["failed"] == 3 and copy.store.summary(key)["completed"] == 3
    copied = copy.resume(key, wave=5)
    assert copy.store.run(key)["status"] == "completed"
    assert copied["rows_written"] == 1500 - sum(u["rows_written"] for u in copy.store.units(key) if u["attempts"] == 1 and u["unit"] < 3)
    assert copy.result(key).count() == 1500
    assert validate.report(copy.validate(key)).first().all_match
    other = fx.target_orders(copy.source)
    assert not validate.report(copy.validate(key, other)).first().all_match
    assert copy.validate(key, other, "full").count() == validate.full_diff(copy.source, other, ["o_custkey", "o_orderkey"], ["o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice"]).count()


def test_waves_are_tried_again(spark, copy, monkeypatch):
    real, calls = storage.write_units, []

    def flaky(rows, path):
        calls.append(path)
        if len(calls) == 1:
            raise OSError("busy")
        return real(rows, path)

    monkeypatch.setattr(storage, "write_units", flaky)
    copy.attempts = 2
    key = copy.start("orders", 4)
    assert copy.run(key)["rows_written"] == 1500 and copy.metrics.retries == 1 and len(calls) == 2
    assert "retries_total 1" in copy.metrics.exposition() and len(copy.metrics.target_latency_ms) == 1


def test_two_workers_with_a_slow_wave(spark, copy, monkeypatch, tmp_path):
    key, real, taken = copy.start("orders", 4), storage.write_units, []
    copy.lease_s = 0.4

    def slow(rows, path):
        import time

        time.sleep(1)
        other = Checkpoint(copy.store.path)
        taken.append(other.reclaim_stale(key, 0.4))
        return real(rows, path)

    monkeypatch.setattr(storage, "write_units", slow)
    assert copy.run(key, "one", wave=2)["rows_written"] == 1500
    assert taken == [0, 0]


def test_preserved_times_and_their_tolerance(spark, tmp_path):
    orders = fx.order_meta(fx.read(spark, DATA, "orders"))
    make = lambda name, source: Copy(spark, source, fx.ORDERS, str(tmp_path / name), Checkpoint(str(tmp_path / f"{name}.db")), fx.portable_token(F.col("o_custkey")), mode="vnode", tokens=(2**58, 2**59), preserve_writetime=True, preserve_ttl=True)
    copy = make("a", orders)
    key = copy.start("orders", 6)
    assert copy.run(key)["rows_written"] == 1500 and {"_writetime", "_ttl"} <= set(copy.result(key).columns)
    assert validate.report(copy.validate(key)).first().all_match
    late = copy.result(key).withColumn("_writetime", F.col("_writetime") + 400_000)
    assert not validate.report(copy.validate(key, late, "sample", 50)).first().all_match
    assert validate.report(copy.validate(key, late, "sample", 50, (1_000_000, 60))).first().all_match
    assert not validate.report(copy.validate(key, late, "sample", 50, (100_000, 60))).first().all_match
    assert not validate.report(copy.validate(key, late.where("o_orderkey > 100"), "sample", 5000, (1_000_000, 60))).first().all_match


def test_copy_of_nothing(spark, copy):
    copy.source = copy.source.limit(0)
    key = copy.start("none", 4)
    assert copy.run(key) == {"rows_read": 0, "rows_written": 0} and copy.result(key).count() == 0


def test_refusals(copy):
    key = copy.start("orders", 4)
    copy.schema = TableSchema("shop", "orders", fx.ORDERS.columns[:-1])
    with pytest.raises(SchemaError):
        copy.run(key)
    copy.target_schema = fx.ORDERS
    with pytest.raises(SchemaError):
        copy.start("orders", 4)


def test_stream_in_parts_gives_the_same_table(spark, tmp_path):
    from rangeflow.operators import cdc

    events = fx.read(spark, DATA, "events")
    log = fx.change_log(events, True, True)
    want = sorted(map(str, cdc.apply(cdc.plan(log, fx.EVENTS), fx.EVENTS).collect()))
    feed, folder = str(tmp_path / "feed"), str(tmp_path / "state")
    stream = lambda: spark.readStream.schema(log.schema).parquet(feed)
    log.where(F.pmod("seq", F.lit(3)) == 0).write.mode("append").parquet(feed)

    def confirm():
        log.where(F.pmod("seq", F.lit(3)) != 0).write.mode("append").parquet(feed)
        return True

    assert changes.cut_over(stream, fx.EVENTS, folder, confirm)
    assert sorted(map(str, changes.table(spark, fx.EVENTS, folder).collect())) == want
    assert not changes.cut_over(stream, fx.EVENTS, folder, lambda: False)
    assert changes.compact(spark, fx.EVENTS, folder) is not None and changes.drop_compacted(spark, folder) > 0
    assert sorted(map(str, changes.table(spark, fx.EVENTS, folder).collect())) == want
    assert changes.table(spark, fx.EVENTS, str(tmp_path / "nothing")).count() == 0 and changes.compact(spark, fx.EVENTS, str(tmp_path / "nothing")) is None


def test_windowed_stream(spark, tmp_path):
    events = fx.read(spark, DATA, "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = changes.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), window_s=3600)
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n_changes")).first()[0] == events.count()


def test_change_log_must_exist(spark, tmp_path):
    with pytest.raises(storage.ChangeLogMissing):
        storage.change_log(spark, str(tmp_path / "none"))


def test_command_line(spark, tmp_path, capsys):
    from rangeflow.cli import main

    at = tmp_path / "c.toml"
    at.write_text(f"""
[migration]
name = "m"
[source]
path = "{DATA}"
[target]
path = "{tmp_path}/t"
[engine]
workers = 1
[checkpoint]
path = "{tmp_path}/run.db"
[[tables]]
source = "shop.customer"
target = "shop.customer"
partition_key = ["c_custkey"]
""")
    assert main(["plan", "--config", str(at)]) == 0 and len(capsys.readouterr().out.splitlines()) == 16
    assert main(["migrate", "--config", str(at)], spark) == 0
    assert main(["status", "--config", str(at)]) == 0 and '"completed": 16' in capsys.readouterr().out
    assert main(["validate", "--config", str(at)], spark) == 0


def test_live_cutover_and_dual_write_commands(spark, tmp_path, capsys):
    import json
    import logging

    from rangeflow.cli import main
    from rangeflow.operators import cdc

    kept = logging.getLogger().handlers[:]
    shop, at = tmp_path / "shop", tmp_path / "c.toml"
    spark.createDataFrame([(1, 1, "x")], "pk int, ck int, v string").write.parquet(str(shop / "t.parquet"))
    change = lambda *rows: spark.createDataFrame(list(rows), "op string, pk int, ck int, v string, deleted array<string>, time bigint, seq bigint").write.mode("append").parquet(str(shop / "t_changes"))
    at.write_text(f"""
[migration]
name = "m"
[source]
path = "{shop}"
[target]
path = "{tmp_path}/out"
create_schema = true
[engine]
workers = 1
[live]
start_at = "1970-01-01T00:00:00.000005Z"
[logging]
format = "json"
[checkpoint]
path = "{tmp_path}/run.db"
[[tables]]
source = "shop.t"
target = "made_by_cli.t"
partition_key = ["pk"]
clustering = ["ck"]
""")
    try:
        change((cdc.INSERT, 1, 1, "early", None, 4, 0), (cdc.INSERT, 1, 2, "a", None, 5, 1), (cdc.INSERT, 1, 3, "b", None, 6, 2))
        assert main(["live", "--config", str(at), "--rounds", "1"], spark) == 0
        change((cdc.DELETE_ROW, 1, 2, None, None, 9, 3))
        assert main(["cutover", "--config", str(at), "--yes"], spark) == 0
        assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/t_live/table").collect()] == [(1, 3, "b")]
        assert all("message" in json.loads(x) for x in capsys.readouterr().err.splitlines() if x.startswith("{"))
        (tmp_path / "m").mkdir()
        (tmp_path / "m" / "a.json").write_text('{"table": "shop.t", "op": "insert", "columns": "{\\"pk\\": 7, \\"ck\\": 8, \\"v\\": \\"w\\"}"}\n')
        assert main(["dual-write", "--config", str(at), "--mutations", str(tmp_path / "m")], spark) == 0
        for folder in (shop, tmp_path / "out"):
            assert [(r.pk, r.ck, r.v, r.action) for r in spark.read.parquet(str(folder / "t_mutations")).collect()] == [(7, 8, "w", "insert")]
        (tmp_path / "m" / "b.json").write_text('{"table": "shop.t", "op": "insert", "columns": "{}"}\n')
        assert main(["dual-write", "--config", str(at), "--mutations", str(tmp_path / "m")], spark) == 1
        assert main(["migrate", "--config", str(at)], spark) == 0 and '"status": "complete"' in capsys.readouterr().out
        assert spark.catalog.tableExists("made_by_cli.t")
        at.write_text(at.read_text().replace('partition_key = ["pk"]', 'partition_key = ["pk"]') + "\n[notify]\n")
        changed = spark.read.parquet(str(shop / "t.parquet")).withColumn("extra", F.lit(1)).collect()
        spark.createDataFrame(changed, "pk int, ck int, v string, extra int").write.mode("overwrite").parquet(str(shop / "t.parquet"))
        with pytest.raises(SchemaError):
            main(["resume", "--config", str(at)], spark)
        assert '"status": "failed"' in capsys.readouterr().out
    finally:
        logging.getLogger().handlers[:] = kept
        spark.sql("DROP DATABASE IF EXISTS made_by_cli CASCADE")
