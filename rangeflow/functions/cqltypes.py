"""Column types of wide-column tables: a recursive parser, and the Spark types that stand for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Simple type names and their Spark types.
SIMPLE = {
    "ascii": T.StringType(), "text": T.StringType(), "varchar": T.StringType(), "blob": T.BinaryType(),
    "boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(),
    "bigint": T.LongType(), "counter": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "time": T.LongType(), "uuid": T.StringType(),
    "timeuuid": T.StringType(), "inet": T.StringType(), "decimal": T.DecimalType(38, 10), "varint": T.DecimalType(38, 0),
    "duration": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("nanos", T.LongType())]),
}
#: Bounds of the integer types that JSON numbers are held against.
INTEGER_BOUNDS = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63, "counter": 63}
COLLECTIONS = ("list", "set", "map", "vector")


@dataclass(frozen=True)
class CqlType:
    head: str
    args: tuple[CqlType, ...] = ()

    @property
    def frozen(self) -> bool:
        return self.head == "frozen"

    @property
    def inner(self) -> CqlType:
        """The type without ``frozen``."""
        return self.args[0].inner if self.frozen else self

    def spark(self) -> T.DataType:
        head, args = self.inner.head, self.inner.args
        if head in SIMPLE:
            return SIMPLE[head]
        if head in ("list", "set", "vector"):
            return T.ArrayType(args[0].spark())
        if head == "map":
            return T.MapType(args[0].spark(), args[1].spark())
        if head == "tuple":
            return T.StructType([T.StructField(f"_{i + 1}", a.spark()) for i, a in enumerate(args)])
        raise ValueError(f"no Spark type for {head!r}")

    def __str__(self) -> str:
        return f"{self.head}<{', '.join(map(str, self.args))}>" if self.args else self.head


def parse(text: str) -> CqlType:
    """Parses a type with any nesting; arguments are split at top-level commas only."""
    text = text.strip()
    if "<" not in text:
        if not text or ">" in text or "," in text:
            raise ValueError(f"malformed type {text!r}")
        return CqlType(text)
    head, _, rest = text.partition("<")
    if not rest.endswith(">"):
        raise ValueError(f"malformed type {text!r}")
    depth, start, parts, body = 0, 0, [], rest[:-1]
    for i, c in enumerate(body):
        depth += (c == "<") - (c == ">")
        if depth < 0:
            raise ValueError(f"malformed type {text!r}")
        if c == "," and not depth:
            parts.append(body[start:i])
            start = i + 1
    if depth:
        raise ValueError(f"malformed type {text!r}")
    if head.strip() == "vector":
        return CqlType("vector", (parse(body[:start - 1] if parts else body),))
    return CqlType(head.strip(), tuple(parse(p) for p in [*parts, body[start:]]))
