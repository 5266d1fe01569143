"""Document fingerprints: content-defined chunking and containment of chunk digest sets.

A rolling gear hash over the UTF-8 bytes proposes boundaries.  Chunking is
normalised: before the normal size a boundary must clear a strict mask, after
it a loose one, so chunk lengths gather round the normal size and an insertion
moves boundaries only near itself.  A fingerprint is the set of chunk digests,
each with its chunk's length as weight; containment is the weight of the common
chunks over the weight of the first set.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.llm.common import emit, id_text, rows, shuffle_partitions, table

MIN, NORMAL, MAX = 24, 64, 192
STRICT, LOOSE = 7, 5  # bits that must be zero before and after the normal size
WINDOW = 32


def _gear() -> np.ndarray:
    """A 32-bit value for each byte, by the splitmix rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def _candidates(data: bytes, start: int) -> tuple[list[int], list[int]]:
    """Boundaries after ``start`` that clear the loose mask, and those that clear the strict one too."""
    at = max(0, start - WINDOW + 1)
    h = GEAR[np.frombuffer(data, dtype=np.uint8)[at:]]
    step = 1
    while step < WINDOW:  # after each pass h sums twice as many bytes, the oldest shifted furthest
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE)))
    strict = loose[h[loose] < np.uint32(1 << (32 - STRICT))]
    return (loose + (at + 1)).tolist(), (strict + (at + 1)).tolist()


def _cuts(data: bytes, start: int = 0) -> list[int]:
    """Chunk ends after ``start``, which is itself a chunk's beginning; the last is the end of the data."""
    size, out = len(data), []
    if size - start > MIN:
        loose, strict = _candidates(data, start)
        while size - start > MIN:
            middle, i = start + NORMAL, bisect_left(strict, start + MIN)
            if i < len(strict) and strict[i] < middle:
                end = strict[i]
            else:
                j = bisect_left(loose, middle)
                end = loose[j] if j < len(loose) and loose[j] < start + MAX else start + MAX
            if end >= size:
                break
            out.append(end)
            start = end
    if size > start:
        out.append(size)
    return out


def _entries(data: bytes, start: int, ends: list[int]) -> list[int]:
    """For each chunk 48 bits of digest over 16 bits of length."""
    view, digest, out = memoryview(data), xxhash.xxh3_64_intdigest, []
    for end in ends:
        out.append((digest(view[start:end]) >> 16 << 16) | (end - start))
        start = end
    return out


def _set(entries: list[int]) -> np.ndarray:
    return np.unique(np.array(entries, dtype=np.uint64))


def chunk_set(text: str | None) -> np.ndarray:
    """The fingerprint of a text as sorted integers: 48 bits of digest over 16 bits of length."""
    data = (text or "").encode()
    return _set(_entries(data, 0, _cuts(data)))


def render(chunks: np.ndarray) -> str:
    return base64.b64encode(chunks.astype(">u8").tobytes()).decode()


def parse(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint or ""), dtype=">u8").astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the weight of ``a`` whose chunks ``b`` has too; two empty sets count as 1, one empty set as 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    weight = a & np.uint64(0xFFFF)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return float(weight[b[at] == a].sum() / weight.sum())


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every whole text, without a shuffle.

    A null text counts as empty, whose fingerprint is the empty string; a very
    long one is hashed whole, in a few arrays of its length.  Repeated rows and
    null ids pass through, no rows give none, other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])
        yield from emit(((i, len(t or ""), render(chunk_set(t))) for i, t in rows(batches)), schema)

    return id_text(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows ``bucket, later, doc_id, text`` in order; a bucket's row with ``later`` is only the successor of its last."""
    held = None  # bucket, doc_id, text, its bytes, its chunk ends, its entries, its set

    def edited(doc: tuple, other: str) -> tuple[str, np.ndarray]:
        _, _, text, data, ends, entries, _ = doc
        k = len(text) // 4
        kept = text[: len(text) - k]
        new = kept + other[:k]
        to = new.encode()
        same = bisect_right(ends, min(len(data if not k else kept.encode()), len(to) - 1))
        start = ends[same - 1] if same else 0
        return new, _set(entries[:same] + _entries(to, start, _cuts(to, start)))

    for bucket, later, doc_id, text in rows(batches):
        if later and (held is None or held[0] != bucket):
            continue
        data = (text or "").encode()
        ends = _cuts(data)
        entries = _entries(data, 0, ends)
        now = (bucket, doc_id, text or "", data, ends, entries, _set(entries))
        if held is not None and held[0] == bucket:
            new, chunks = edited(held, now[2])
            yield held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), render(held[6]), render(chunks), containment(held[6], chunks), containment(held[6], now[6])
        held = None if later else now


LOW = -(2**63)
PLACE = ("key", "print", "salt")  # rows are in this order; the salt tells apart what is alike


def _quantiles(rows_: DataFrame, column: str, n: int, by: str | None = None) -> dict:
    """About ``n - 1`` values that split the rows, of each ``by``, into equal ranges; a hot value comes several times."""
    found = F.percentile_approx(column, F.array(*(F.lit(i / n) for i in range(1, n))), F.lit(8 * n)).alias("points")
    got = rows_.groupBy(by).agg(found).collect() if by else rows_.agg(F.lit(None).alias("all"), found).collect()  # one row a hot value
    return {r[0]: [min(max(int(x), LOW), -LOW - 1) for x in r.points or ()] for r in got}


def _cut_points(keyed: DataFrame, n: int) -> list[tuple[int, int, int]]:
    """At most about ``n`` places that split the rows into about equal ranges, by key; a hot key is split by print, a hot print by salt."""
    if n < 2:
        return []
    points = Counter(_quantiles(keyed.select("key"), "key", n)[None])
    out = {(key, LOW, LOW) for key in points}
    hot = {key: times for key, times in points.items() if times > 1}
    if hot:
        of_key = _quantiles(keyed.where(F.col("key").isin(list(hot))), "print", 1 + max(hot.values()), "key")
        for key, prints in of_key.items():
            for text_print, times in Counter(prints).items():
                out.add((key, text_print, LOW))
                step = 2**64 // (times + 1)
                out.update((key, text_print, LOW + k * step) for k in range(1, times + 1) if times > 1)
    return sorted(out)


def _range_of(points: list[tuple[int, int, int]]) -> Column:
    """Number of cut points up to a row's place, found in two steps of about the square root of their number."""
    if not points:
        return F.lit(0)
    place = F.struct(*PLACE)
    lit = lambda p: F.struct(*(F.lit(x).cast("long").alias(c) for c, x in zip(PLACE, p)))
    width = max(1, round(len(points) ** 0.5))
    parts = [points[i : i + width] for i in range(0, len(points), width)]
    coarse = F.size(F.filter(F.array(*(lit(p[0]) for p in parts)), lambda x: x <= place))
    fine = F.element_at(F.array(*(F.array(*map(lit, p)) for p in parts)), F.greatest(coarse, F.lit(1)))
    return F.greatest(coarse - 1, F.lit(0)) * width + F.size(F.filter(fine, lambda x: x <= place))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints every document, its edited text and how like it the next document is.

    The edited text has the last quarter of the code points replaced by the
    first as many (or all) of the next document by ``doc_id``; the first follows
    the last.  Rows are dealt by ranges of ``doc_id`` and each range also gets
    the first row of the following one, so no task needs another's rows and the
    text is shuffled once.  What reaches the driver is a few values a range.

    Null texts count as empty, null ids sort first, rows that share an id sort by
    a hash of the text; a hot id is split by that, and repeated rows in any
    order.  A very long text is held by one task, with some ten times its
    bytes.  An empty table gives an empty result; other columns are left out.
    """
    spark, n = docs.sparkSession, 4 * shuffle_partitions(docs.sparkSession)
    keyed = id_text(docs).withColumns({"key": F.coalesce("doc_id", F.lit(LOW)), "print": F.xxhash64("text")})
    points = _cut_points(keyed, n)
    # repeated rows are told apart, by their place in the input, only where they are so many that they must be split
    salted = any(p[2] != LOW for p in points)
    keyed = keyed.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()) if salted else F.lit(LOW))
    dealt = keyed.withColumn("bucket", _range_of(points))
    firsts = {r.bucket: tuple(r.first) for r in dealt.groupBy("bucket").agg(F.min(F.struct(*PLACE)).alias("first")).collect()}  # one row a range
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    place = F.struct(*PLACE)
    first = F.array(*(F.struct(*(F.lit(x).cast("long").alias(c) for c, x in zip(PLACE, firsts.get(b, (0, 0, 0))))) for b in range(len(points) + 1)))
    previous = F.array(*(F.lit(before.get(b, 0)) for b in range(len(points) + 1)))
    at = F.col("bucket") + 1
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("later"))
    also = F.struct(F.element_at(previous, at).alias("bucket"), F.lit(True).alias("later"))
    to = F.when(place == F.element_at(first, at), F.array(own, also)).otherwise(F.array(own))
    ordered = (
        dealt.withColumn("to", F.explode(to))
        .select("to.bucket", "to.later", "doc_id", "text", *PLACE)
        .repartition(shuffle_partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "later", *PLACE)
        .select("bucket", "later", "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64())] + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")] + [("near_edited", pa.float64()), ("near_next", pa.float64())])
        yield from emit(_compared(batches), schema)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
