"""Splitting token ranges into units of work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeflow.functions.tokens import MAX_TOKEN, MIN_TOKEN

UNITS_PER_WORKER = 16


class PlanError(ValueError):
    pass


@dataclass(frozen=True, order=True)
class TokenRange:
    """The half-open range (start, end]."""

    start: int
    end: int

    def __post_init__(self) -> None:
        if not self.start < self.end:
            raise PlanError(f"empty range ({self.start}, {self.end}]")

    @property
    def width(self) -> int:
        return self.end - self.start

    def __contains__(self, token: int) -> bool:
        return self.start < token <= self.end


FULL_RING = TokenRange(MIN_TOKEN, MAX_TOKEN)


def split_range(parent: TokenRange, n: int) -> list[TokenRange]:
    """``n`` ranges without gaps, of equal width but for the last, which takes the rest; fewer if the parent is narrower."""
    if n < 1:
        raise PlanError("the number of units must be at least 1")
    n = min(n, parent.width)
    step = parent.width // n
    bounds = [parent.start + k * step for k in range(n)] + [parent.end]
    return [TokenRange(a, b) for a, b in zip(bounds, bounds[1:])]


def split_ring(n: int) -> list[TokenRange]:
    return split_range(FULL_RING, n)


def owned_ranges(tokens: list[int]) -> list[TokenRange]:
    """Ranges between the tokens of a topology: past the last, up to the first, then between neighbours."""
    own = sorted(set(tokens))
    if not own:
        raise PlanError("the topology has no tokens")
    edges = [(own[-1], MAX_TOKEN), (MIN_TOKEN, own[0]), *zip(own, own[1:])]
    return [TokenRange(a, b) for a, b in edges if a < b]


def split_topology(parents: list[TokenRange], n: int) -> list[TokenRange]:
    """Every parent split alike, the first ones once more where ``n`` leaves a rest; each gives one unit at least."""
    if n < 1:
        raise PlanError("the number of units must be at least 1")
    base, more = max(n // len(parents), 1), n % len(parents) if n >= len(parents) else 0
    return [r for k, p in enumerate(parents) for r in split_range(p, base + (k < more))]


def desired_units(workers: int) -> int:
    return workers * UNITS_PER_WORKER


def plan(mode: str = "even", units: int = 512, parent: TokenRange = FULL_RING, tokens: list[int] | None = None, max_units: int | None = None) -> list[TokenRange]:
    """The units of a run, by an even split of the parent or by the topology's tokens; ``max_units`` keeps the first."""
    if max_units is not None and max_units < 1:
        raise PlanError("max_units must be at least 1")
    if mode == "even":
        found = split_range(parent, units)
    elif mode == "vnode":
        found = split_topology(owned_ranges(tokens or []), units)
    else:
        raise PlanError(f"unknown mode {mode!r}")
    return found[:max_units]


def frame(spark: SparkSession, ranges: list[TokenRange]) -> DataFrame:
    """``unit, token_start, token_end`` of the ranges; a plan has few rows, whatever the table has."""
    return spark.createDataFrame([(k, r.start, r.end) for k, r in enumerate(ranges)], "unit int, token_start bigint, token_end bigint")


def owned_frame(tokens: DataFrame) -> DataFrame:
    """``token_start, token_end`` between the distinct values of ``token``, which come from a topology's few nodes."""
    ring = tokens.select(F.col("token").cast("bigint").alias("token")).distinct()
    order = Window.orderBy("token")
    after = ring.select(F.lag("token").over(order).alias("token_start"), F.col("token").alias("token_end"))
    inner = after.select(F.coalesce("token_start", F.lit(MIN_TOKEN)).alias("token_start"), "token_end")
    last = ring.agg(F.max("token").alias("token_start")).select("token_start", F.lit(MAX_TOKEN).alias("token_end"))
    return inner.union(last).where("token_start < token_end")
