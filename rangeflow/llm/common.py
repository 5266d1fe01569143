"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and the ASCII controls 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
ARROW_BYTES = 4 << 20  # of one Arrow batch; one row may be longer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends Arrow batches of at most ``ARROW_BYTES`` from now on, since a number of rows does not bound texts."""
    held = df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if held > ARROW_BYTES:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df


def id_text(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long, ``text`` and the columns named, for small batches; whatever else ``df`` has stays behind."""
    return small_batches(df).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


#: What tasks of an operator leave in their worker for its next tasks: how to empty it, by owner.
left_behind: dict[str, Callable[[], None]] = {}


def rows(batches: Iterator[pa.RecordBatch], owner: str = "") -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, converted a few at a time so that long texts do not pile up.

    What others than ``owner`` left behind in this worker is emptied first.
    """
    for name in [x for x in left_behind if x != owner]:
        left_behind.pop(name)()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(c.to_pylist() for c in part.columns))


def emit(found: Iterator[tuple], schema: pa.Schema, size: int = 1000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of the tuples, closed at ``size`` rows or about ``most_bytes`` of text."""
    held, weight = [], 0
    for row in found:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
        if len(held) >= size or weight >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[np.frombuffer(data, dtype=np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 19  # bytes whose words are hashed at once
LONG_WORD = 1 << 12  # words of more bytes are hashed one by one


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@cache
def _powers(base: int) -> np.ndarray:
    """As many powers as a slice has bytes, modulo 2 to the 64th."""
    return np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(SLICE, base, dtype=np.uint64))])


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, whatever its place; a slice of the data at a time, so that a long text takes little more than itself."""
    up, down = _powers(int(BASE)), _powers(pow(int(BASE), -1, 1 << 64))
    out, every, at = np.zeros(len(starts), dtype=np.uint64), np.frombuffer(data, dtype=np.uint8), 0
    while at < len(starts):
        lo = starts[at]
        to = int(np.searchsorted(ends, lo + SLICE, side="right"))
        if to > at:
            sums = np.zeros(ends[to - 1] - lo + 1, dtype=np.uint64)
            np.cumsum((every[lo : ends[to - 1]].astype(np.uint64) + np.uint64(1)) * up[: len(sums) - 1], out=sums[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = mixed((sums[e] - sums[s]) * down[s])
        at = max(to, at + 1)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` words in a row; of all of them if there are fewer, of none if there are none."""
    k = min(k, len(words))
    if not k:
        return words
    n, factor = len(words) - k + 1, 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h += words[j : j + n] * np.uint64(factor)
        factor = factor * int(BASE) % (1 << 64)
    return mixed(h)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder from whatever store Spark wrote it to; one that is not there is passed over."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only for a local master without the setting."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="rangeflow-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
