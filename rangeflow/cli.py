"""Command line over one configuration file: plan, migrate, resume, status, validate, live, cutover, dual-write and notify-test."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.engine import Copy
from rangeflow.functions.tokens import PORTABLE_RANGE, portable_token
from rangeflow.operators import cdc, dualwrite
from rangeflow.operators.validate import require_match
from rangeflow.plans import checkpoint as cp
from rangeflow.plans import config, planner, progress
from rangeflow.sources import storage
from rangeflow.sources.schema import TableSchema, discover, ensure_table
from rangeflow.streaming import changes

COMMANDS = ("plan", "migrate", "resume", "status", "validate", "live", "cutover", "dual-write", "notify-test")
PARENT = planner.TokenRange(*PORTABLE_RANGE)
log = logging.getLogger("rangeflow")


class JsonLines(logging.Formatter):
    """A log record as one line of JSON."""

    def format(self, record: logging.LogRecord) -> str:
        body = {"time": round(record.created, 3), "level": record.levelname.lower(), "logger": record.name, "message": record.getMessage()}
        return json.dumps(body | ({"error": self.formatException(record.exc_info)} if record.exc_info else {}))


def _logging(conf: config.Logging) -> None:
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines() if conf.format == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    logging.basicConfig(level={"warn": "WARNING"}.get(conf.level, conf.level.upper()), handlers=[handler], force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)


def _schema(spark: SparkSession, conf: config.Config, mapping: config.TableMapping) -> tuple[DataFrame, TableSchema]:
    """The source table and its schema; companions with write times and lifetimes are no columns of it."""
    keyspace, name = config.split_name(mapping.source)
    source = spark.read.parquet(f"{conf.source_path}/{name}.parquet")
    own = [c for c in source.columns if not c.startswith(("_wt_", "_ttl_"))]
    return source, discover(source.select(*own), keyspace, name, list(mapping.partition_key), list(mapping.clustering))


def _copy(spark: SparkSession, conf: config.Config, mapping: config.TableMapping, store: cp.Checkpoint) -> Copy:
    source, schema = _schema(spark, conf, mapping)
    target = f"{conf.target_path}/{config.split_name(mapping.target)[1]}"
    limits, engine = conf.concurrency, conf.engine
    throttle = progress.Throttle(limits.initial, limits.min, limits.max, limits.target_p99_ms) if limits.adaptive else None
    if conf.create_schema:
        keyspace, name = config.split_name(mapping.target)
        log.info("target %s: %s", mapping.target, ensure_table(spark, TableSchema(keyspace, name, schema.columns)).value)
    return Copy(
        spark, source, schema, target, store, portable_token(*(F.col(k) for k in mapping.partition_key)), PARENT, allow_counters=engine.allow_counters, mode=conf.planner.mode, tokens=conf.planner.tokens,
        preserve_writetime=engine.preserve_writetime, preserve_ttl=engine.preserve_ttl, preserve_frozen=engine.preserve_frozen, attempts=engine.attempts, batch_rows=engine.write_batch_size, lease_s=conf.checkpoint.lease_secs, throttle=throttle,
    )


def _tell(conf: config.Config, status: str, summary: dict, began: float, error: str | None = None) -> None:
    body = progress.notification(conf.name, status, summary, time.monotonic() - began, error)
    print(body)
    if conf.webhook:
        progress.notify(conf.webhook, body)


def _migrate(conf: config.Config, copy: Copy, store: cp.Checkpoint, resumed: str | None) -> None:
    """Copies, and sends how it ended, a failure too."""
    began = time.monotonic()
    key = resumed or copy.start(conf.name, conf.units, conf.engine.max_units)
    try:
        copied = copy.resume(key, wave=conf.engine.units_per_wave) if resumed else copy.run(key, wave=conf.engine.units_per_wave)
        if conf.engine.preserve_elements and copy.schema.element_columns("map", "set"):
            copy.elements().write.mode("overwrite").parquet(f"{copy.target}/run={key}/elements")
    except Exception as e:
        _tell(conf, "failed", store.summary(key), began, str(e)[:500])
        raise
    log.info("copied %s; %s", copied, copy.metrics.exposition().replace("\n", " ") if log.isEnabledFor(logging.DEBUG) else "")
    _tell(conf, "complete", store.summary(key), began)


def _validate(conf: config.Config, copy: Copy, key: str) -> int:
    v = conf.validation
    tolerance = (v.timestamp_tolerance_us, v.ttl_tolerance_secs) if v.compare_timestamps else None
    if tolerance and not {"_writetime", "_ttl"} <= set(copy.extra):
        raise config.ConfigError("compare_timestamps needs preserve_writetime and preserve_ttl")
    found = copy.validate(key, mode=v.mode, sample=v.sample_size, tolerance=tolerance)
    if v.mode == "full":
        return found.limit(1).count()
    try:
        require_match(found)
    except RuntimeError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _log_of(spark: SparkSession, conf: config.Config, mapping: config.TableMapping) -> DataFrame:
    """The table's change log as a stream: a folder beside the table, ``<table>_changes``."""
    at = f"{conf.source_path}/{config.split_name(mapping.source)[1]}_changes"
    schema = storage.change_log(spark, at).schema
    return spark.readStream.schema(schema).parquet(at)


def _state(conf: config.Config, mapping: config.TableMapping) -> str:
    return f"{conf.target_path}/{config.split_name(mapping.target)[1]}_live"


def _live(spark: SparkSession, conf: config.Config, rounds: int | None, confirm=None) -> int:
    """Catches up with the change logs of all tables, again and again or for some rounds; with ``confirm``, up to the switch.

    A catch-up begins an overlap before the run was first started, or where the
    configuration says; what was captured is compacted after each round.
    """
    told = config.parse_time(conf.live.start_at) if conf.live.start_at else None
    done = 0
    while rounds is None or done < rounds:
        for mapping in conf.tables:
            _, schema = _schema(spark, conf, mapping)
            folder = _state(conf, mapping)
            start = None if storage.exists(spark, f"{folder}/offsets") and told is None else cdc.start_of_catch_up(int(time.time() * 1e6), conf.live.overlap_secs, told)
            seen = lambda number, counts, name=mapping.source: log.info("%s, batch %d: %s", name, number, counts)
            if confirm is None:
                changes.capture(_log_of(spark, conf, mapping), schema, folder, seen, start).awaitTermination()
            elif not changes.cut_over(lambda m=mapping: _log_of(spark, conf, m), schema, folder, confirm, start):
                return 1
            changes.compact(spark, schema, folder)
            changes.drop_compacted(spark, folder)
        done += 1
        if rounds is None or done < rounds:
            time.sleep(conf.live.sleep_secs)
    return 0


def _cut_over(spark: SparkSession, conf: config.Config, confirm) -> int:
    if _live(spark, conf, 1, confirm):
        return 1
    for mapping in conf.tables:
        _, schema = _schema(spark, conf, mapping)
        changes.table(spark, schema, _state(conf, mapping)).write.mode("overwrite").parquet(f"{_state(conf, mapping)}/table")
    return 0


def _dual_write(spark: SparkSession, conf: config.Config, path: str) -> int:
    """Plans the JSON mutations of a folder and appends them to the source's and then the target's, table by table; a mutation that cannot be carried out stops all before anything is written."""
    given, planned = spark.read.schema(dualwrite.MUTATION).json(path), []
    for mapping in conf.tables:
        _, schema = _schema(spark, conf, mapping)
        found = dualwrite.plan(given.where(F.col("table") == mapping.source), schema)
        if bad := found.where("action = 'error'").select("error").first():
            print(f"{mapping.source}: {bad.error}", file=sys.stderr)
            return 1
        planned.append((mapping, found))
    for mapping, found in planned:
        at = lambda folder, name: f"{folder}/{config.split_name(name)[1]}_mutations"
        append = lambda where: lambda batch: batch.write.mode("append").parquet(where)
        dualwrite.write_both(found, append(at(conf.source_path, mapping.source)), append(at(conf.target_path, mapping.target)), conf.require_both)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rangeflow", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--config", required=True)
    parser.add_argument("--run", help="the run to resume, show or validate; the newest if it is not given")
    parser.add_argument("--rounds", type=int, help="live: catch-ups before it ends; without it there is no end")
    parser.add_argument("--yes", action="store_true", help="cutover: do not ask")
    parser.add_argument("--mutations", help="dual-write: a folder of JSON lines")
    args = parser.parse_args(argv)
    conf = config.load(args.config)
    _logging(conf.logging)
    if args.command == "notify-test":
        return int(not (conf.webhook and progress.notify(conf.webhook, progress.notification(conf.name, "test", {}, 0))))
    if args.command == "plan":
        for k, r in enumerate(planner.plan(conf.planner.mode, conf.units, PARENT, list(conf.planner.tokens), conf.engine.max_units)):
            print(k, r.start, r.end)
        return 0
    store = cp.Checkpoint(conf.checkpoint.path)
    keys = [args.run] if args.run else [r["id"] for r in store.runs()]
    if args.command == "status":
        for key in keys:
            print(json.dumps(store.run(key) | store.summary(key), sort_keys=True))
        return 0
    spark = spark or SparkSession.builder.appName("rangeflow").getOrCreate()
    if args.command == "live":
        return _live(spark, conf, args.rounds)
    if args.command == "cutover":
        return _cut_over(spark, conf, lambda: args.yes or input("switch over? [y/N] ").strip().lower() == "y")
    if args.command == "dual-write":
        if not args.mutations:
            parser.error("dual-write needs --mutations")
        return _dual_write(spark, conf, args.mutations)
    failed = 0
    for mapping in conf.tables:
        copy = _copy(spark, conf, mapping, store)
        own = [k for k in keys if store.run(k)["source"] == mapping.source]
        if args.command in ("migrate", "resume"):
            _migrate(conf, copy, store, own[0] if args.command == "resume" else None)
        else:
            failed += _validate(conf, copy, own[0])
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
