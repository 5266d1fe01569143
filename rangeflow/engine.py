"""Copying a table by units that commit one by one, resuming, and validating.

Units are claimed in waves; a wave is one Spark job that reads the source once
for all its units, so by default there is one.  A unit is completed only after
its rows are written and counted, by the attempt that claimed it, and readers
see committed units only, so an attempt that fails leaves nothing behind that
counts.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.operators import merge, scan, validate
from rangeflow.plans import checkpoint as cp
from rangeflow.plans import planner
from rangeflow.plans.progress import Metrics, Throttle, with_retries
from rangeflow.sources import storage
from rangeflow.sources.schema import SchemaError, TableSchema, differences

PASSING = (OSError, Py4JError, PySparkException)  # failures after which a wave is tried again


class CopyError(RuntimeError):
    pass


@dataclass
class Copy:
    """A copy of ``source``, a DataFrame with the columns of ``schema``, into ``target`` under the token expression.

    To preserve write times or lifetimes the source has companions
    ``_wt_<column>`` and ``_ttl_<column>``; the row's are then copied and
    validated as ``_writetime`` and ``_ttl``.
    """

    spark: SparkSession
    source: DataFrame
    schema: TableSchema
    target: str
    store: cp.Checkpoint
    token: Column
    parent: planner.TokenRange = planner.FULL_RING
    target_schema: TableSchema | None = None
    allow_counters: bool = False
    extra: tuple[str, ...] = ()  # columns of metadata that are copied too
    mode: str = "even"
    tokens: tuple[int, ...] = ()  # of the topology, for mode ``vnode``
    preserve_writetime: bool = False
    preserve_ttl: bool = False
    preserve_frozen: bool = False
    attempts: int = 1
    batch_rows: int = 10
    lease_s: float = cp.LEASE_S
    metrics: Metrics = field(default_factory=Metrics)
    throttle: Throttle | None = None

    def __post_init__(self) -> None:
        kept = [c for c, wanted in (("_writetime", self.preserve_writetime), ("_ttl", self.preserve_ttl)) if wanted]
        if kept:
            if self.extra:
                raise CopyError("other metadata cannot be copied beside preserved times")
            now = F.lit(int(time.time() * 1_000_000)).cast("bigint")
            found = merge.preserve(self.source, self.schema, self.preserve_frozen, now)
            self.source = found
            self.extra = tuple(kept)

    def _ordered(self, df: DataFrame) -> DataFrame:
        return scan.ordered(scan.with_token(df, self.token), self.schema, "_tok", *self.extra)

    def _assigned(self, rows: DataFrame, key: str | None) -> DataFrame:
        """The rows with their unit of the run; without a run only the column."""
        if key is None:
            return rows.withColumn("unit", F.lit(0))
        if self.mode == "even":
            return scan.assign_even(rows, self.parent, self._checked(key))
        return scan.assign_ranges(rows, self.store.units_frame(self.spark, key))

    def _rows(self, key: str | None) -> DataFrame:
        return self._assigned(self._ordered(self.source), key)

    def start(self, name: str, units: int, max_units: int | None = None) -> str:
        """Plans a run and stores it; tables that do not fit together are refused."""
        if found := differences(self.schema, self.target_schema or self.schema):
            raise SchemaError("; ".join(found))
        if self.schema.counters and not self.allow_counters:
            raise SchemaError("counter tables are copied only where that is allowed")
        ranges = planner.plan(self.mode, units, self.parent, list(self.tokens), max_units)
        self.metrics.ranges_pending = len(ranges)
        return self.store.create_run(name, f"{self.schema.keyspace}.{self.schema.table}", self.target, f"{self.schema.fingerprint()}:{units}", ranges)

    def run(self, key: str, worker: str = "driver", wave: int | None = None) -> dict[str, int]:
        """Copies pending units, ``wave`` at a time, or as many as the throttle says, or all; the first wave that fails stops the run and its units are marked.

        While a wave runs its units are kept alive by heartbeats, however long it takes.
        """
        self._checked(key)
        rows = self._rows(key)
        copied = {"rows_read": 0, "rows_written": 0}
        with self.store.beating(key, worker, self.lease_s / 4):
            while claimed := self._claim(key, worker, wave or (self.throttle.current if self.throttle else None)):
                began, numbers, before = time.monotonic(), [u["unit"] for u in claimed], copied["rows_written"]
                tries = iter(range(self.attempts))
                out = f"{self.target}/run={key}/attempt={claimed[0]['unit']}-{claimed[0]['attempts']}-{worker}"
                self.metrics.ranges_running = len(claimed)
                try:
                    found = with_retries(lambda: self._write(rows, numbers, f"{out}-{next(tries)}"), self.attempts, retryable=PASSING, seen=self._retried)
                    self._commit(key, claimed, worker, found, copied)
                except Exception as e:
                    self.metrics.errors += 1
                    for u in claimed:
                        try:
                            self.store.fail(key, u["unit"], str(e)[:500], (worker, u["attempts"]))
                        except cp.CheckpointError:
                            pass  # completed, or another attempt's by now
                    raise CopyError(f"units {numbers[0]} to {numbers[-1]}: {e}") from e
                finally:
                    self.metrics.ranges_running = 0
                elapsed = (time.monotonic() - began) * 1000
                self.metrics.target_latency_ms.append(elapsed / len(claimed))
                if self.throttle:
                    batches = max(1, (copied["rows_written"] - before) // self.batch_rows)
                    self.metrics.worker_concurrency = self.throttle.observe(elapsed * self.spark.sparkContext.defaultParallelism / batches)
        self.store.finish_if_done(key)
        return copied

    def _retried(self, _: Exception) -> None:
        self.metrics.retries += 1

    def _checked(self, key: str) -> int:
        """The number of units that the run was planned with; a changed schema is refused."""
        printed, _, n = self.store.run(key)["schema_print"].partition(":")
        if printed != self.schema.fingerprint():
            raise SchemaError("the schema has changed since the run was planned")
        return int(n)

    def _claim(self, key: str, worker: str, n: int | None) -> list[dict]:
        found = []
        while (n is None or len(found) < n) and (u := self.store.claim(key, worker)):
            found.append(u)
        return found

    def _write(self, rows: DataFrame, numbers: list[int], out: str) -> tuple[str, dict, dict]:
        mine, began = rows.where(F.col("unit").isin(numbers)), time.monotonic()
        sizes = {r.unit: r for r in scan.unit_sizes(mine, [c.name for c in self.schema.columns]).collect()}  # one row a unit
        self.metrics.source_latency_ms.append((time.monotonic() - began) * 1000 / len(numbers))
        return out, sizes, storage.write_units(mine, out)

    def _commit(self, key: str, claimed: list[dict], worker: str, found: tuple[str, dict, dict], copied: dict[str, int]) -> None:
        out, sizes, written = found
        for unit in claimed:
            u, attempt = unit["unit"], (worker, unit["attempts"])
            n_read = sizes[u].n_rows if u in sizes else 0
            n, last = written.get(u, (0, None))
            if n != n_read:
                raise CopyError(f"unit {u}: {n_read} rows read, {n} written")
            n_bytes = sizes[u].n_bytes if u in sizes else 0
            self.store.save_progress(key, u, n_read, n, n_bytes, last, attempt)
            self.store.complete(key, u, f"{out}/unit={u}" if n else None, attempt)
            copied["rows_read"] += n_read
            copied["rows_written"] += n
            self.metrics.rows_read += n_read
            self.metrics.rows_written += n
            self.metrics.bytes_read += n_bytes
            self.metrics.bytes_written += n_bytes
            self.metrics.ranges_completed += 1
            self.metrics.ranges_pending = max(0, self.metrics.ranges_pending - 1)

    def resume(self, key: str, lease_s: float | None = None, **kw) -> dict[str, int]:
        """Goes on with what failed and what workers left behind; units of live workers stay theirs."""
        self.store.reclaim_stale(key, self.lease_s if lease_s is None else lease_s)
        self.store.requeue_failed(key)
        return self.run(key, **kw)

    def result(self, key: str) -> DataFrame:
        """Rows of the committed units."""
        outputs = [u["output"] for u in self.store.units(key, cp.COMPLETED) if u["output"]]
        schema = self._rows(None).drop("unit").schema
        return storage.read_units(self.spark, outputs, schema)

    def elements(self, times: DataFrame | None = None) -> DataFrame:
        """The elements of all open maps and sets with the row's write time and lifetime, or their own where ``times`` has them; collections are rebuilt from these."""
        rows = merge.preserve(self.source, self.schema, self.preserve_frozen) if "_writetime" not in self.source.columns else self.source
        found = merge.explode_elements(rows, self.schema)
        keys = [c.name for c in self.schema.primary_key]
        if times is None:
            return found.withColumnsRenamed({"_writetime": "writetime", "_ttl": "ttl"})
        return merge.with_element_times(found, times, keys)

    def _sides(self, key: str, target: DataFrame | None) -> list[DataFrame]:
        other = self.result(key) if target is None else self._ordered(target)
        planned = self.store.units_frame(self.spark, key).select("unit")
        return [s.join(F.broadcast(planned), "unit", "left_semi") for s in (self._rows(key), self._assigned(other, key))]

    def validate(self, key: str, target: DataFrame | None = None, mode: str = "digest", sample: int = validate.SAMPLE_ROWS, tolerance: tuple[int, int] | None = None) -> DataFrame:
        """Compares source and target by the run's units; ``full`` gives the differing columns of units that do not match.

        With a ``tolerance`` in microseconds and seconds, write times and
        lifetimes are left out of the digests of a sample and compared with it
        instead: a unit then matches if all its sampled rows are within it.
        """
        self._checked(key)
        near = mode == "sample" and tolerance is not None and {"_writetime", "_ttl"} <= set(self.extra)
        columns = [c.name for c in self.schema.ordered] + [c for c in self.extra if not (near and c in ("_writetime", "_ttl"))]
        plan = self.store.units_frame(self.spark, key).select("unit", "token_start", "token_end")
        sides = self._sides(key, target)
        keys = [c.name for c in self.schema.primary_key]
        if mode == "sample":
            sides = [validate.sample(s, ["_tok", *keys], sample) for s in sides]
        compared = validate.compare(*(validate.digests(s, plan, columns) for s in sides))
        if near:
            apart = validate.within_tolerance(*sides, ["unit", *keys], most_us=tolerance[0], most_s=tolerance[1]).where("not within")
            apart = apart.groupBy("unit").agg(F.count(F.lit(1)).alias("_apart"))
            compared = compared.join(F.broadcast(apart), "unit", "left").withColumn("matches", F.col("matches") & F.col("_apart").isNull()).drop("_apart")
        if mode != "full":
            return compared
        wrong = compared.where("not matches").select("unit")
        left = [s.join(F.broadcast(wrong), "unit", "left_semi") for s in sides]
        return validate.full_diff(*left, keys, [c.name for c in self.schema.data], list(self.extra))
