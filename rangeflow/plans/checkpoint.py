"""Checkpoints of a run: its units and their states, in a transactional file on the driver.

The states are PENDING, RUNNING, COMPLETED and FAILED.  A unit counts as
completed only after its progress was saved in the same attempt.  The store
holds a row a unit, not a row of data; ``units_frame`` and ``runs_frame`` show
it to queries.
"""

from __future__ import annotations

import sqlite3
import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.plans.planner import TokenRange

PENDING, RUNNING, COMPLETED, FAILED = "pending", "running", "completed", "failed"
STATES = (PENDING, RUNNING, COMPLETED, FAILED)
RESUMABLE = (PENDING, RUNNING, FAILED)
BUSY_MS = 5000
LEASE_S = 120.0

TABLES = """
CREATE TABLE IF NOT EXISTS runs (
  id TEXT PRIMARY KEY, name TEXT NOT NULL, source TEXT NOT NULL, target TEXT NOT NULL,
  schema_print TEXT NOT NULL, status TEXT NOT NULL, created_at REAL NOT NULL, completed_at REAL);
CREATE TABLE IF NOT EXISTS units (
  run TEXT NOT NULL REFERENCES runs (id), unit INTEGER NOT NULL, token_start INTEGER NOT NULL, token_end INTEGER NOT NULL,
  state TEXT NOT NULL DEFAULT 'pending', attempts INTEGER NOT NULL DEFAULT 0, worker TEXT, progress_saved INTEGER NOT NULL DEFAULT 0,
  rows_read INTEGER NOT NULL DEFAULT 0, rows_written INTEGER NOT NULL DEFAULT 0, bytes_written INTEGER NOT NULL DEFAULT 0,
  last_token INTEGER, output TEXT, error TEXT, started_at REAL, heartbeat_at REAL, updated_at REAL NOT NULL,
  PRIMARY KEY (run, unit));
CREATE INDEX IF NOT EXISTS by_state ON units (run, state, token_start);
"""


class CheckpointError(RuntimeError):
    pass


class Checkpoint:
    def __init__(self, path: str, clock=time.time) -> None:
        self.db = sqlite3.connect(path, isolation_level=None, timeout=BUSY_MS / 1000)
        self.db.row_factory = sqlite3.Row
        self.path, self.clock = path, clock
        self.db.execute("PRAGMA journal_mode = WAL")
        self.db.executescript(TABLES)

    @contextmanager
    def _changing(self) -> Iterator[sqlite3.Connection]:
        self.db.execute("BEGIN IMMEDIATE")
        try:
            yield self.db
        except BaseException:
            self.db.execute("ROLLBACK")
            raise
        self.db.execute("COMMIT")

    def create_run(self, name: str, source: str, target: str, schema_print: str, ranges: Iterable[TokenRange]) -> str:
        if not name.strip():
            raise CheckpointError("a run needs a name")
        key, now = uuid.uuid4().hex, self.clock()
        with self._changing() as db:
            db.execute("INSERT INTO runs VALUES (?, ?, ?, ?, ?, 'running', ?, NULL)", (key, name, source, target, schema_print, now))
            db.executemany("INSERT INTO units (run, unit, token_start, token_end, updated_at) VALUES (?, ?, ?, ?, ?)", [(key, k, r.start, r.end, now) for k, r in enumerate(ranges)])
        return key

    def run(self, key: str) -> dict:
        found = self.db.execute("SELECT * FROM runs WHERE id = ?", (key,)).fetchone()
        if found is None:
            raise CheckpointError(f"no run {key}")
        return dict(found)

    def runs(self) -> list[dict]:
        """Newest first."""
        return [dict(r) for r in self.db.execute("SELECT * FROM runs ORDER BY created_at DESC, id")]

    def units(self, run: str, *states: str) -> list[dict]:
        """In the order of their tokens."""
        every = [dict(r) for r in self.db.execute("SELECT * FROM units WHERE run = ? ORDER BY token_start", (run,))]
        return [u for u in every if not states or u["state"] in states]

    def claim(self, run: str, worker: str) -> dict | None:
        """The first pending unit, now running; two claimers never get the same one."""
        now = self.clock()
        with self._changing() as db:
            first = db.execute("SELECT unit FROM units WHERE run = ? AND state = ? ORDER BY token_start LIMIT 1", (run, PENDING)).fetchone()
            if first is None:
                return None
            db.execute(
                "UPDATE units SET state = ?, attempts = attempts + 1, worker = ?, progress_saved = 0, started_at = coalesce(started_at, ?), heartbeat_at = ?, updated_at = ? WHERE run = ? AND unit = ?",
                (RUNNING, worker, now, now, now, run, first["unit"]),
            )
            return dict(db.execute("SELECT * FROM units WHERE run = ? AND unit = ?", (run, first["unit"])).fetchone())

    def _update(self, run: str, unit: int, allowed: tuple[str, ...], sets: str, values: tuple, also: str = "1", attempt: tuple[str, int] | None = None) -> None:
        """``attempt`` names worker and attempt: who lost a unit to another attempt can no longer change it."""
        fence = "1" if attempt is None else "worker = ? AND attempts = ?"
        with self._changing() as db:
            marks = ", ".join("?" * len(allowed))
            done = db.execute(f"UPDATE units SET {sets}, updated_at = ? WHERE run = ? AND unit = ? AND state IN ({marks}) AND {also} AND {fence}", (*values, self.clock(), run, unit, *allowed, *(attempt or ())))
            if done.rowcount != 1:
                raise CheckpointError(f"unit {unit} of run {run} is not in a state that allows this")

    def heartbeat(self, run: str, worker: str) -> int:
        """Says that the worker's units are alive; gives how many it has."""
        with self._changing() as db:
            return db.execute("UPDATE units SET heartbeat_at = ? WHERE run = ? AND worker = ? AND state = ?", (self.clock(), run, worker, RUNNING)).rowcount

    @contextmanager
    def beating(self, run: str, worker: str, every_s: float) -> Iterator[None]:
        """Sends heartbeats from a thread of its own, with its own connection, as long as the block runs."""
        done = threading.Event()

        def beat() -> None:
            store = Checkpoint(self.path, self.clock)
            while not done.wait(every_s):
                store.heartbeat(run, worker)
            store.db.close()

        thread = threading.Thread(target=beat, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()

    def save_progress(self, run: str, unit: int, rows_read: int, rows_written: int, bytes_written: int, last_token: int | None = None, attempt: tuple[str, int] | None = None) -> None:
        self._update(run, unit, (RUNNING,), "rows_read = ?, rows_written = ?, bytes_written = ?, last_token = ?, progress_saved = 1, heartbeat_at = ?", (rows_read, rows_written, bytes_written, last_token, self.clock()), attempt=attempt)

    def complete(self, run: str, unit: int, output: str | None = None, attempt: tuple[str, int] | None = None) -> None:
        self._update(run, unit, (RUNNING,), "state = ?, output = ?, error = NULL", (COMPLETED, output), "progress_saved = 1", attempt)

    def fail(self, run: str, unit: int, error: str, attempt: tuple[str, int] | None = None) -> None:
        self._update(run, unit, RESUMABLE, "state = ?, error = ?", (FAILED, error), attempt=attempt)

    def requeue_failed(self, run: str) -> int:
        with self._changing() as db:
            return db.execute("UPDATE units SET state = ?, error = NULL, updated_at = ? WHERE run = ? AND state = ?", (PENDING, self.clock(), run, FAILED)).rowcount

    def reclaim_stale(self, run: str, lease_s: float = LEASE_S) -> int:
        """Units whose worker was not heard of for the lease go back to pending; those of live workers stay."""
        now = self.clock()
        with self._changing() as db:
            return db.execute("UPDATE units SET state = ?, worker = NULL, updated_at = ? WHERE run = ? AND state = ? AND coalesce(heartbeat_at, updated_at) < ?", (PENDING, now, run, RUNNING, now - lease_s)).rowcount

    def summary(self, run: str) -> dict[str, int]:
        counts = dict.fromkeys(STATES, 0) | {r[0]: r[1] for r in self.db.execute("SELECT state, count(*) FROM units WHERE run = ? GROUP BY state", (run,))}
        sums = self.db.execute("SELECT coalesce(sum(rows_read), 0), coalesce(sum(rows_written), 0), coalesce(sum(bytes_written), 0) FROM units WHERE run = ?", (run,)).fetchone()
        return counts | {"total": sum(counts[s] for s in STATES)} | dict(zip(("rows_read", "rows_written", "bytes_written"), sums))

    def finish_if_done(self, run: str) -> bool:
        """Marks the run completed if it has units and all of them are."""
        s = self.summary(run)
        if not s["total"] or s[COMPLETED] != s["total"]:
            return False
        with self._changing() as db:
            db.execute("UPDATE runs SET status = ?, completed_at = ? WHERE id = ?", (COMPLETED, self.clock(), run))
        return True

    def units_frame(self, spark: SparkSession, run: str) -> DataFrame:
        fields = "unit int, token_start bigint, token_end bigint, state string, attempts int, rows_read bigint, rows_written bigint, bytes_written bigint, last_token bigint, heartbeat_at double, updated_at double, started_at double, error string"
        names = [f.split()[0] for f in fields.split(", ")]
        return spark.createDataFrame([tuple(u[n] for n in names) for u in self.units(run)], fields)

    def runs_frame(self, spark: SparkSession) -> DataFrame:
        fields = "id string, name string, source string, target string, schema_print string, status string, created_at double, completed_at double"
        names = [f.split()[0] for f in fields.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in self.runs()], fields)


# ---- the same questions over a DataFrame of units


def summarise(units: DataFrame) -> DataFrame:
    """One row: units by state, sums of their counters, and whether there are units and all are completed."""
    count = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    done = (F.count(F.lit(1)) > 0) & (F.count(F.when(F.col("state") != COMPLETED, 1)) == 0)
    return units.agg(*map(count, STATES), F.count(F.lit(1)).alias("total"), *map(total, ("rows_read", "rows_written", "bytes_written")), done.alias("done"))


def next_pending(units: DataFrame) -> DataFrame:
    return units.where(F.col("state") == PENDING).orderBy("token_start").limit(1)


def resumable(units: DataFrame) -> DataFrame:
    return units.where(F.col("state").isin(*RESUMABLE)).orderBy("token_start")


def reclaimed(units: DataFrame, now: float, lease_s: float = LEASE_S) -> DataFrame:
    stale = (F.col("state") == RUNNING) & (F.coalesce("heartbeat_at", "updated_at") < F.lit(now - lease_s))
    return units.withColumn("state", F.when(stale, PENDING).otherwise(F.col("state")))


def shown(units: DataFrame, completed: int = 80) -> DataFrame:
    """All units that are not completed, and the newest completed ones up to the number that is left of ``completed``."""
    rest = units.where(F.col("state") != COMPLETED)
    taken = rest.count()
    newest = units.where(F.col("state") == COMPLETED).orderBy(F.desc("updated_at"), "unit").limit(max(0, completed - taken))
    return rest.unionByName(newest)
