"""Progress, rates, latencies and the values that steer a run."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeflow.plans.checkpoint import COMPLETED, FAILED, RUNNING

#: Bounds in milliseconds of the latency histogram: 15, each twice the one before.
LATENCY_BOUNDS_MS = [2.0**k for k in range(15)]
P99_SAMPLES = 32


def fraction_done() -> Column:
    """Of a unit: all if it is completed or failed, by its last token if it runs, else none."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    span = F.greatest(wide("token_end") - wide("token_start"), F.lit(1)).cast("double")
    part = ((wide("last_token") - wide("token_start")).cast("double") / span)
    running = F.least(F.greatest(part, F.lit(0.0)), F.lit(0.999))
    return F.when(F.col("state").isin(COMPLETED, FAILED), F.lit(1.0)).when(F.col("state") == RUNNING, F.coalesce(running, F.lit(0.0))).otherwise(F.lit(0.0))


def progress(units: DataFrame) -> DataFrame:
    """One row: per cent by finished units and by token span, and the share of failed units."""
    weight = F.greatest(F.col("token_end").cast("decimal(38,0)") - F.col("token_start").cast("decimal(38,0)"), F.lit(1)).cast("double")
    done = F.col("state").isin(COMPLETED, FAILED)
    n = F.count(F.lit(1))
    percent = F.when(n == 0, F.lit(0.0))
    return units.agg(
        percent.otherwise(100.0 * F.count(F.when(done, 1)) / n).alias("percent_units"),
        percent.otherwise(100.0 * F.sum(weight * fraction_done()) / F.sum(weight)).alias("percent_done"),
        percent.otherwise(100.0 * F.count(F.when(F.col("state") == FAILED, 1)) / n).alias("percent_failed"),
    )


def eta_seconds(percent: Column, elapsed_s: Column) -> Column:
    """What is left at the pace so far; null before one second, up to half a per cent, and at the end."""
    known = (percent > 0.5) & (percent < 100) & (elapsed_s >= 1)
    return F.when(known, (F.lit(100.0) - percent) / percent * elapsed_s)


def rate(rows: Column, elapsed_s: Column) -> Column:
    return F.when(elapsed_s > 0, rows / elapsed_s).otherwise(F.lit(0.0))


def moving_p99(samples: DataFrame, value: str, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Adds ``p99``: of the last 32 samples the one at the nearest rank."""
    frame = Window.partitionBy(*(group or [])).orderBy(*order).rowsBetween(1 - P99_SAMPLES, 0)
    near = F.sort_array(F.collect_list(value).over(frame))
    return samples.withColumn("p99", F.element_at(near, F.ceil(F.size(near) * F.lit(0.99)).cast("int")))


def latency_histogram(samples: DataFrame, value: str) -> DataFrame:
    """``le, n``: samples up to each bound, and all of them under an infinite one."""
    sums = samples.agg(*(F.count(F.when(F.col(value) <= b, 1)).alias(f"b{k}") for k, b in enumerate(LATENCY_BOUNDS_MS)), F.count(value).alias("b_all"))
    bounds = [*(F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(LATENCY_BOUNDS_MS)), F.struct(F.lit(float("inf")).alias("le"), F.col("b_all").alias("n"))]
    return sums.select(F.explode(F.array(*bounds)).alias("_b")).select("_b.*")


def backoff_ms(attempt: int, initial: float = 50, most: float = 30_000, factor: float = 2) -> float:
    """The wait before an attempt: none before the first, then growing up to a limit."""
    return 0 if attempt <= 1 else min(initial * factor ** (attempt - 2), most)


def backoff_column(attempt: Column, initial: float = 50, most: float = 30_000) -> Column:
    return F.when(attempt <= 1, F.lit(0.0)).otherwise(F.least(F.lit(float(initial)) * F.pow(F.lit(2.0), attempt - 2), F.lit(float(most))))


def with_retries(work: Callable[[], object], attempts: int = 8, initial_ms: float = 50, sleep: Callable[[float], None] | None = None, retryable: tuple[type[Exception], ...] = (OSError,), seen: Callable[[Exception], None] | None = None) -> object:
    """Runs the work again after failures that may pass, which ``seen`` is told of; others are raised at once."""
    import time

    for k in range(1, attempts + 1):
        (sleep or time.sleep)(backoff_ms(k, initial_ms) / 1000)
        try:
            return work()
        except retryable as e:
            if k == attempts:
                raise
            if seen:
                seen(e)
    raise AssertionError


@dataclass
class Throttle:
    """Concurrency that falls by a fifth when latency is over the target and rises by four when it is well below.

    A latency is that of one write batch: the time of a wave on all its tasks over the batches it wrote.
    """

    current: int = 64
    least: int = 8
    most: int = 512
    target_ms: float = 15.0
    samples: deque = field(default_factory=lambda: deque(maxlen=P99_SAMPLES))

    def __post_init__(self) -> None:
        if not self.least <= self.current <= self.most:
            raise ValueError("least <= current <= most must hold")

    @property
    def p99(self) -> float:
        near = sorted(self.samples)
        return near[ceil(0.99 * len(near)) - 1] if near else 0.0

    def observe(self, latency_ms: float) -> int:
        self.samples.append(latency_ms)
        seen = max(self.p99, latency_ms)
        if seen > self.target_ms:
            self.current = max(self.least, int(self.current * 0.8))
        elif seen < 0.7 * self.target_ms:
            self.current = min(self.most, self.current + 4)
        return self.current


@dataclass
class Metrics:
    """Counters and gauges of a run."""

    rows_read: int = 0
    rows_written: int = 0
    bytes_read: int = 0
    bytes_written: int = 0
    retries: int = 0
    errors: int = 0
    ranges_pending: int = 0
    ranges_running: int = 0
    ranges_completed: int = 0
    worker_concurrency: int = 0
    source_latency_ms: list[float] = field(default_factory=list)
    target_latency_ms: list[float] = field(default_factory=list)

    COUNTERS = ("rows_read", "rows_written", "bytes_read", "bytes_written", "retries", "errors")
    GAUGES = ("ranges_pending", "ranges_running", "ranges_completed", "worker_concurrency")

    def exposition(self, prefix: str = "rangeflow") -> str:
        """The text form that metrics collectors read."""
        lines = []
        for kind, names in (("counter", self.COUNTERS), ("gauge", self.GAUGES)):
            for n in names:
                lines += [f"# TYPE {prefix}_{n} {kind}", f"{prefix}_{n}{'_total' * (kind == 'counter')} {getattr(self, n)}"]
        for n in ("source_latency_ms", "target_latency_ms"):
            values = getattr(self, n)
            lines.append(f"# TYPE {prefix}_{n} histogram")
            lines += [f'{prefix}_{n}_bucket{{le="{b:g}"}} {sum(v <= b for v in values)}' for b in LATENCY_BOUNDS_MS]
            lines += [f'{prefix}_{n}_bucket{{le="+Inf"}} {len(values)}', f"{prefix}_{n}_sum {sum(values):g}", f"{prefix}_{n}_count {len(values)}"]
        return "\n".join([*lines, "# EOF", ""])


def notification(run: str, status: str, summary: dict[str, int], elapsed_s: float, error: str | None = None) -> str:
    """The JSON that a finished or failed run sends."""
    body = {"run": run, "status": status, "elapsed_seconds": round(elapsed_s, 3), **summary}
    return json.dumps(body | ({"error": error} if error else {}), sort_keys=True)


def notify(url: str, body: str, timeout_s: float = 10) -> bool:
    """Posts a notification; a failure is reported, never raised."""
    import logging
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"}), timeout=timeout_s):
            return True
    except OSError as e:
        logging.getLogger(__name__).warning("notification failed: %s", e)
        return False

