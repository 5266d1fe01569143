"""Media columns: PNG files in binary columns, with checksum tests and a cosine-transform hash.

The writer stores 8-bit samples without loss, choosing for each row the filter
of least absolute sum among none, left and up.  The reader walks the chunks,
tests every checksum, inflates the data and undoes all five filter types.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rangeflow.llm.common import emit, id_text, rows, table

SIGNATURE = bytes([137, 80, 78, 71, 13, 10, 26, 10])
ROW = 192  # bytes of a row: 64 pixels of three samples
LEVEL = 4
TALL = 1024  # rows that are shrunk at once
#: Samples of a pixel by the format's colour type, at 8 bits.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


class MediaError(ValueError):
    """The stored bytes are not the whole and undamaged file of the supported kind."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: np.ndarray, level: int = LEVEL) -> bytes:
    """A PNG of ``samples``, uint8 of shape (height, width, 1 to 4)."""
    height, width, depth = samples.shape
    colour = {n: c for c, n in SAMPLES.items()}[depth]
    raw = np.ascontiguousarray(samples).reshape(height, width * depth)
    left = raw.copy()
    left[:, depth:] -= raw[:, :-depth]
    up = raw.copy()
    up[1:] -= raw[:-1]
    cost = np.stack([np.minimum(x, 0 - x).sum(axis=1, dtype=np.int64) for x in (raw, left, up)])
    kind = cost.argmin(axis=0).astype(np.uint8)
    lines = np.empty((height, width * depth + 1), dtype=np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = np.where((kind == 0)[:, None], raw, np.where((kind == 1)[:, None], left, up))
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise MediaError("a chunk's head is cut off")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size:
            raise MediaError("a chunk is cut off")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise MediaError(f"checksum of {kind!r}")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise MediaError("no end chunk")


def _unfilter(kind: np.ndarray, lines: np.ndarray, depth: int) -> np.ndarray:
    """Undoes the filters; runs of rows that share one are undone together where the filter allows."""
    height, width = lines.shape
    out = np.empty_like(lines)
    above = np.zeros(width, dtype=np.uint8)
    edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), height]
    for lo, hi in zip(edges, edges[1:]):
        if lo == hi:
            continue
        k, rows_ = kind[lo], lines[lo:hi]
        if k == 0:
            out[lo:hi] = rows_
        elif k == 1:
            out[lo:hi] = rows_.reshape(hi - lo, -1, depth).cumsum(axis=1, dtype=np.uint8).reshape(hi - lo, width)
        elif k == 2:
            out[lo:hi] = rows_.cumsum(axis=0, dtype=np.uint8) + above
        elif k in (3, 4):
            for y in range(lo, hi):
                up = out[y - 1] if y else above
                now = _sequential(k, lines[y].tolist(), up.tolist(), depth)
                out[y] = np.array(now, dtype=np.uint8)
        else:
            raise MediaError(f"filter type {k}")
        above = out[hi - 1]
    return out


def _sequential(kind: int, line: list[int], up: list[int], depth: int) -> list[int]:
    """Average and Paeth rows, where every sample needs the one before it."""
    out: list[int] = []
    for i, x in enumerate(line):
        a, b, c = (out[i - depth], up[i], up[i - depth]) if i >= depth else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            near = a + b - c
            guess = min((abs(near - a), 0, a), (abs(near - b), 1, b), (abs(near - c), 2, c))[2]
        out.append((x + guess) & 255)
    return out


def read_png(data: bytes) -> np.ndarray:
    """Samples of a PNG, uint8 of shape (height, width, samples); damage raises MediaError."""
    head, body = None, []
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
    if head is None or head[2] != 8 or head[3] not in SAMPLES or any(head[4:]):
        raise MediaError("not a plain 8-bit file without interlacing")
    width, height, depth = head[0], head[1], SAMPLES[head[3]]
    size, inflate = height * (width * depth + 1), zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(body), size + 1)  # never more than the head says
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != size or not inflate.eof:
        raise MediaError("wrong number of samples")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(height, width * depth + 1)
    return _unfilter(lines[:, 0], lines[:, 1:], depth).reshape(height, width, depth)


def _share(size: int, to: int, lo: int, hi: int) -> np.ndarray:
    """What the samples from ``lo`` to ``hi`` of ``size`` add to each of ``to`` cells, parts of samples included."""
    edges = np.linspace(0, size, to + 1)
    at = np.arange(lo, hi)
    share = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
    return (np.clip(share, 0, None) / (size / to)).astype(np.float32)


_kept_share = lru_cache(maxsize=256)(_share)  # of at most TALL samples: 128 KB each


def _shrink(grey: np.ndarray, to: int) -> np.ndarray:
    """The rows averaged into ``to``, some at a time."""
    height, out = len(grey), np.zeros((to, grey.shape[1]), dtype=np.float32)
    for lo in range(0, height, TALL):
        hi = min(height, lo + TALL)
        out += (_kept_share if height <= TALL else _share)(height, to, lo, hi) @ grey[lo:hi]
    return out


@lru_cache(maxsize=4)
def _cosines(n: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)).astype(np.float32)


def cosine_hash(samples: np.ndarray, grid: int = 32, keep: int = 8) -> str:
    """16 hexadecimal digits: which of the lowest 8 x 8 cosine coefficients of the shrunk grey image exceed their median."""
    small = _shrink(_shrink(samples.mean(axis=2, dtype=np.float32), grid).T, grid).T
    low = (_cosines(grid, keep) @ small @ _cosines(grid, keep).T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def to_samples(text: str | None) -> tuple[int, np.ndarray]:
    """Number of bytes of the text, and its bytes padded with spaces as rows of 64 pixels of three samples."""
    data = (text or "").encode()
    padded = data.ljust(max(1, -(-len(data) // ROW)) * ROW)
    return len(data), np.frombuffer(padded, dtype=np.uint8).reshape(-1, ROW // 3, 3)


def media_columns(docs: DataFrame) -> DataFrame:
    """``doc_id``, the text's PNG in the binary column ``media`` and ``n_bytes`` of every document.

    A null text counts as empty and gives one row of spaces; equal texts give
    equal files; a very long text is one tall picture, made in a few arrays of
    its length.  Repeated rows and null ids pass through, no rows give none,
    other columns are left out.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        found = ((i, *to_samples(t)) for i, t in rows(batches))
        yield from emit(((i, n, write_png(x)) for i, n, x in found), schema)

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Reads the column ``media`` back: digests of the samples and of the file, and the hash of its low frequencies.

    A null file is no document's and raises; damage raises rather than passing
    on; equal files give equal answers, no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

        def read() -> Iterator[tuple]:
            for doc_id, n, file in rows(batches):
                if file is None:
                    raise MediaError(f"no file for document {doc_id}")
                samples = read_png(file)
                payload = samples.tobytes()
                yield doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), cosine_hash(samples)

        yield from emit(read(), schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(media_columns(table(spark, sf_dir, "documents")))
