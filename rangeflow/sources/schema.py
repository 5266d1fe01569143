"""Table schemas: column kinds, canonical order, statement text and compatibility."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rangeflow.functions.cqltypes import CqlType, parse


class SchemaError(ValueError):
    pass


class ColumnKind(Enum):
    """In the order that columns of the kinds have."""

    PARTITION_KEY = "partition_key"
    CLUSTERING = "clustering"
    STATIC = "static"
    REGULAR = "regular"

    @property
    def rank(self) -> int:
        return list(ColumnKind).index(self)


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    cql_type: str
    kind: ColumnKind = ColumnKind.REGULAR
    position: int = 0

    @property
    def type(self) -> CqlType:
        return parse(self.cql_type)

    @property
    def is_counter(self) -> bool:
        return self.type.head == "counter"

    def is_open(self, *heads: str) -> bool:
        """Whether it is an unfrozen collection of one of the kinds."""
        return self.type.head in heads

    @property
    def is_frozen_collection(self) -> bool:
        return self.type.frozen and self.type.inner.head in ("list", "set", "map")


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class TableSchema:
    keyspace: str
    table: str
    columns: tuple[ColumnInfo, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if not self.columns:
            raise SchemaError(f"table not found: {self.keyspace}.{self.table}")
        if not self.partition_key:
            raise SchemaError(f"{self.keyspace}.{self.table} has no partition key")

    @property
    def ordered(self) -> list[ColumnInfo]:
        """Kind, then position, then name: the order that readers, writers and digests share."""
        return sorted(self.columns, key=lambda c: (c.kind.rank, c.position, c.name))

    def of_kind(self, *kinds: ColumnKind) -> list[ColumnInfo]:
        return [c for c in self.ordered if c.kind in kinds]

    @property
    def partition_key(self) -> list[ColumnInfo]:
        return self.of_kind(ColumnKind.PARTITION_KEY)

    @property
    def clustering(self) -> list[ColumnInfo]:
        return self.of_kind(ColumnKind.CLUSTERING)

    @property
    def primary_key(self) -> list[ColumnInfo]:
        return self.partition_key + self.clustering

    @property
    def data(self) -> list[ColumnInfo]:
        return self.of_kind(ColumnKind.STATIC, ColumnKind.REGULAR)

    @property
    def counters(self) -> list[ColumnInfo]:
        return [c for c in self.columns if c.is_counter]

    def preservable(self, frozen: bool = False) -> list[ColumnInfo]:
        """Data columns that have one write time: no counters, no open collections, frozen ones only on request."""
        return [c for c in self.data if not c.is_counter and not c.is_open("list", "set", "map") and (frozen or not c.is_frozen_collection)]

    def element_columns(self, *heads: str) -> list[ColumnInfo]:
        return [c for c in self.data if c.is_open(*(heads or ("map", "set")))]

    def struct(self) -> T.StructType:
        """The Spark schema in canonical order; what Spark has no word for goes to the fields' metadata."""
        return T.StructType([T.StructField(c.name, c.type.spark(), True, {"cql_type": c.cql_type, "kind": c.kind.value, "position": c.position}) for c in self.ordered])

    def fingerprint(self) -> str:
        """A digest of names, types, kinds and positions, each framed by its length."""
        h = hashlib.sha256()
        for c in self.ordered:
            for part in (c.name, c.cql_type, c.kind.value, str(c.position)):
                h.update(f"{len(part)}:{part}".encode())
        return h.hexdigest()

    # ---- statement text, for connectors that speak it

    @property
    def name(self) -> str:
        return f"{quote(self.keyspace)}.{quote(self.table)}"

    def token_call(self) -> str:
        return f"token({', '.join(quote(c.name) for c in self.partition_key)})"

    def range_select(self, writetimes: bool = False, ttls: bool = False, frozen: bool = False) -> str:
        """All columns, then the write times and lifetimes asked for, then the token, over one half-open range."""
        parts = [quote(c.name) for c in self.ordered]
        for call, wanted in (("writetime", writetimes), ("ttl", ttls)):
            parts += [f"{call}({quote(c.name)})" for c in self.preservable(frozen)] if wanted else []
        return f"SELECT {', '.join([*parts, self.token_call()])} FROM {self.name} WHERE {self.token_call()} > ? AND {self.token_call()} <= ?"

    def element_select(self, column: str) -> str:
        keys = " AND ".join(f"{quote(c.name)} = ?" for c in self.primary_key)
        return f"SELECT writetime({quote(column)}[?]), ttl({quote(column)}[?]) FROM {self.name} WHERE {keys}"

    def insert(self, using: bool = False) -> str:
        names = [quote(c.name) for c in self.ordered]
        return f"INSERT INTO {self.name} ({', '.join(names)}) VALUES ({', '.join('?' * len(names))})" + " USING TIMESTAMP ? AND TTL ?" * using

    def counter_update(self) -> str:
        if not self.counters:
            raise SchemaError("no counter column")
        sets = ", ".join(f"{quote(c.name)} = {quote(c.name)} + ?" for c in self.ordered if c.is_counter)
        return f"UPDATE {self.name} SET {sets} WHERE {' AND '.join(f'{quote(c.name)} = ?' for c in self.primary_key)}"

    def element_update(self, column: str) -> str:
        """Sets one entry of a map, or adds one element to a set."""
        kind = next(c for c in self.columns if c.name == column).type.head
        change = f"{quote(column)}[?] = ?" if kind == "map" else f"{quote(column)} = {quote(column)} + {{?}}"
        return f"UPDATE {self.name} USING TIMESTAMP ? AND TTL ? SET {change} WHERE {' AND '.join(f'{quote(c.name)} = ?' for c in self.primary_key)}"

    def create_table(self) -> str:
        cells = [f"{quote(c.name)} {c.cql_type}" + " static" * (c.kind is ColumnKind.STATIC) for c in self.ordered]
        partition, clustering = ([quote(c.name) for c in cs] for cs in (self.partition_key, self.clustering))
        first = partition[0] if len(partition) == 1 else f"({', '.join(partition)})"
        return f"CREATE TABLE IF NOT EXISTS {self.name} ({', '.join(cells)}, PRIMARY KEY ({', '.join([first, *clustering])}))"


def create_keyspace(keyspace: str, replication: int = 1, datacenter: str | None = None) -> str:
    if replication < 1:
        raise SchemaError("the replication factor must be at least 1")
    kind, key = ("NetworkTopologyStrategy", datacenter) if datacenter else ("SimpleStrategy", "replication_factor")
    return f"CREATE KEYSPACE IF NOT EXISTS {quote(keyspace)} WITH replication = {{'class': '{kind}', '{key}': {replication}}}"


def discover(df: DataFrame, keyspace: str, table: str, partition_key: list[str], clustering: tuple[str, ...] | list[str] = (), static: tuple[str, ...] | list[str] = ()) -> TableSchema:
    """The schema of a DataFrame's columns, from field metadata or else from their Spark types."""
    names = {T.StringType: "text", T.BinaryType: "blob", T.LongType: "bigint", T.IntegerType: "int", T.ShortType: "smallint", T.ByteType: "tinyint", T.DoubleType: "double", T.FloatType: "float", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp"}

    def told(kind: T.DataType) -> str:
        if isinstance(kind, T.ArrayType):
            return f"list<{told(kind.elementType)}>"
        if isinstance(kind, T.MapType):
            return f"map<{told(kind.keyType)}, {told(kind.valueType)}>"
        return "decimal" if isinstance(kind, T.DecimalType) else names[type(kind)]

    found = []
    for f in df.schema.fields:
        kind = next((k for k, own in ((ColumnKind.PARTITION_KEY, partition_key), (ColumnKind.CLUSTERING, clustering), (ColumnKind.STATIC, static)) if f.name in own), ColumnKind.REGULAR)
        at = list({ColumnKind.PARTITION_KEY: partition_key, ColumnKind.CLUSTERING: clustering}.get(kind, [])).index(f.name) if kind.rank < 2 else 0
        found.append(ColumnInfo(f.name, f.metadata.get("cql_type") or told(f.dataType), kind, at))
    return TableSchema(keyspace, table, tuple(found))


def differences(source: TableSchema, target: TableSchema) -> list[str]:
    """Why the two cannot be copied column by column: number, names, types and kinds must agree in canonical order."""
    a, b, out = source.ordered, target.ordered, []
    if len(a) != len(b):
        out.append(f"column count {len(a)} and {len(b)}")
    for x, y in zip(a, b):
        for what, p, q in (("name", x.name, y.name), ("type", x.cql_type, y.cql_type), ("kind", x.kind.value, y.kind.value)):
            if p != q:
                out.append(f"{x.name}: {what} {p} and {q}")
    return out


class Ensured(Enum):
    ALREADY_EXISTS = "already_exists"
    CREATED_TABLE = "created_table"
    CREATED_KEYSPACE_AND_TABLE = "created_keyspace_and_table"


def ensure_table(spark: SparkSession, schema: TableSchema) -> Ensured:
    """Creates the target's database and table where they are missing; never alters one that is there."""
    database = f"`{schema.keyspace}`"
    if had := spark.catalog.databaseExists(schema.keyspace):
        if spark.catalog.tableExists(f"{database}.`{schema.table}`"):
            return Ensured.ALREADY_EXISTS
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.createDataFrame([], schema.struct()).write.format("parquet").saveAsTable(f"{database}.`{schema.table}`")
    return Ensured.CREATED_TABLE if had else Ensured.CREATED_KEYSPACE_AND_TABLE
