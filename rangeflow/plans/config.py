"""Configuration: one TOML file, defaults, and rules that fail at once."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone


class ConfigError(ValueError):
    pass


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ConfigError(why)


@dataclass(frozen=True)
class TableMapping:
    """Source and target as ``keyspace.table``, and the keys of the table."""

    source: str
    target: str
    partition_key: tuple[str, ...] = ()
    clustering: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name in (self.source, self.target):
            split_name(name)


def split_name(name: str) -> tuple[str, str]:
    """Keyspace and table, parted at the first dot."""
    keyspace, _, table = name.partition(".")
    _need(bool(keyspace and table), f"{name!r} is not keyspace.table")
    return keyspace, table


@dataclass(frozen=True)
class Engine:
    workers: int = 32
    page_size: int = 5000  # the only value that is taken: Spark reads by splits of files, not by pages
    write_batch_size: int = 10
    preserve_writetime: bool = False
    preserve_ttl: bool = False
    preserve_elements: bool = False
    preserve_frozen: bool = False
    allow_counters: bool = False
    max_units: int | None = None
    units_per_wave: int | None = None  # all that are pending at once, or as many as the throttle says
    attempts: int = 3

    def __post_init__(self) -> None:
        _need(self.workers >= 1, "workers must be at least 1")
        _need(self.page_size == 5000, "page_size cannot be set: tables are read by splits of files")
        _need(1 <= self.write_batch_size <= 256, "write_batch_size must be from 1 to 256")
        _need(self.attempts >= 1, "attempts must be at least 1")
        _need(self.units_per_wave is None or self.units_per_wave >= 1, "units_per_wave must be at least 1")
        _need(self.max_units is None or self.max_units >= 1, "max_units must be at least 1")
        _need(not self.preserve_elements or self.preserve_writetime or self.preserve_ttl, "preserve_elements needs write times or lifetimes")


@dataclass(frozen=True)
class Concurrency:
    initial: int = 64
    min: int = 8
    max: int = 512
    adaptive: bool = False
    target_p99_ms: float = 15.0

    def __post_init__(self) -> None:
        _need(1 <= self.min <= self.initial <= self.max, "min <= initial <= max must hold")


@dataclass(frozen=True)
class CheckpointFile:
    path: str = "rangeflow.db"
    interval_secs: int = 5
    lease_secs: int = 120

    def __post_init__(self) -> None:
        _need(bool(self.path.strip()), "checkpoint path must not be blank")
        _need(self.interval_secs >= 1, "interval_secs must be at least 1")


@dataclass(frozen=True)
class Validation:
    mode: str = "digest"
    sample_size: int = 1000
    compare_timestamps: bool = False
    timestamp_tolerance_us: int = 1_000_000
    ttl_tolerance_secs: int = 60

    def __post_init__(self) -> None:
        _need(self.mode in ("digest", "sample", "full"), f"unknown validation mode {self.mode!r}")
        _need(self.sample_size >= 1, "sample_size must be at least 1")


@dataclass(frozen=True)
class Live:
    enabled: bool = False
    window_secs: int = 60
    safety_secs: int = 30
    sleep_secs: int = 10
    overlap_secs: int = 60
    start_at: str | None = None

    def __post_init__(self) -> None:
        _need(self.window_secs >= 1, "window_secs must be at least 1")
        if self.start_at:
            parse_time(self.start_at)


def parse_time(text: str) -> int:
    """Microseconds since 1970 of an RFC 3339 time, not below zero; a time without a zone is UTC."""
    try:
        at = datetime.fromisoformat(text)
    except ValueError as e:
        raise ConfigError(f"{text!r} is not a time") from e
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return max(0, round(at.timestamp() * 1_000_000))


@dataclass(frozen=True)
class Integrity:
    """Guards that may be stated but not switched off."""

    delivery: str = "at_least_once"
    checkpoint_after_write: bool = True
    fail_closed: bool = True

    def __post_init__(self) -> None:
        _need(self.delivery == "at_least_once", "delivery must be at_least_once")
        _need(self.checkpoint_after_write and self.fail_closed, "integrity guards cannot be switched off")


@dataclass(frozen=True)
class Planner:
    """``tokens`` are those of the topology's nodes, which ``vnode`` plans by."""

    mode: str = "even"
    tokens: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        _need(self.mode in ("even", "vnode"), f"unknown planner mode {self.mode!r}")
        _need(self.mode == "even" or bool(self.tokens), "planner mode 'vnode' needs the tokens of a topology")


@dataclass(frozen=True)
class Logging:
    level: str = "info"
    format: str = "text"

    def __post_init__(self) -> None:
        _need(self.level in ("debug", "info", "warn", "error"), f"unknown log level {self.level!r}")
        _need(self.format in ("text", "json"), f"unknown log format {self.format!r}")


@dataclass(frozen=True)
class Config:
    name: str
    source_path: str
    target_path: str
    tables: tuple[TableMapping, ...]
    create_schema: bool = False
    engine: Engine = field(default_factory=Engine)
    concurrency: Concurrency = field(default_factory=Concurrency)
    checkpoint: CheckpointFile = field(default_factory=CheckpointFile)
    validation: Validation = field(default_factory=Validation)
    live: Live = field(default_factory=Live)
    planner: Planner = field(default_factory=Planner)
    integrity: Integrity = field(default_factory=Integrity)
    logging: Logging = field(default_factory=Logging)
    webhook: str | None = None
    require_both: bool = True

    def __post_init__(self) -> None:
        _need(bool(self.name.strip()), "migration.name must not be blank")
        _need(bool(self.tables), "at least one table is needed")
        _need(bool(self.source_path and self.target_path), "source.path and target.path are needed")

    @property
    def units(self) -> int:
        return self.engine.workers * 16

    def mapping(self, source: str) -> TableMapping:
        """The mapping of a source table; a table that is not listed keeps its name."""
        return next((t for t in self.tables if t.source == source), TableMapping(source, source))


_SECTIONS = {"engine": Engine, "concurrency": Concurrency, "checkpoint": CheckpointFile, "validation": Validation, "live": Live, "planner": Planner, "integrity": Integrity, "logging": Logging}


def parse(text: str) -> Config:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e

    def made(kind, values: dict):
        extra = set(values) - {f.name for f in fields(kind)}
        _need(not extra, f"unknown keys: {', '.join(sorted(extra))}")
        return kind(**values)

    known = {"migration", "source", "target", "tables", "notify", "dual_write", *_SECTIONS}
    _need(set(raw) <= known, f"unknown sections: {', '.join(sorted(set(raw) - known))}")
    listed = lambda values: {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    tables = tuple(made(TableMapping, listed(t)) for t in raw.get("tables", []))
    target = raw.get("target", {})
    _need(target.get("kind", "parquet") == "parquet" and raw.get("source", {}).get("kind", "parquet") == "parquet", "only parquet tables are supported")
    parts = {name: made(kind, listed(raw.get(name, {}))) for name, kind in _SECTIONS.items()}
    return Config(raw.get("migration", {}).get("name", ""), raw.get("source", {}).get("path", ""), target.get("path", ""), tables, target.get("create_schema", False), webhook=raw.get("notify", {}).get("webhook"), require_both=raw.get("dual_write", {}).get("require_both", True), **parts)


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
