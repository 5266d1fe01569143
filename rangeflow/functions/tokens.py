"""Tokens of partition keys, and the unit of an even plan that a token falls in."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_TOKEN, MAX_TOKEN = -(2**63), 2**63 - 1
#: The portable token has 60 bits; the range that holds all of them excludes its lower end.
PORTABLE_RANGE = (-1, 2**60 - 1)
_MASK = 2**64 - 1


def portable_token(*keys: Column) -> Column:
    """The first 60 bits of the md5 of the keys as text, joined by bars: the same in any SQL engine."""
    text = F.concat_ws("|", *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _rotated(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _MASK


def _finished(x: int) -> int:
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * by) & _MASK
    return x ^ (x >> 33)


def murmur3_token(data: bytes) -> int:
    """The ring token of key bytes: upper half of the 128-bit Murmur3 with sign-extended tail bytes.

    The smallest value belongs to no range, so it becomes the largest.
    """
    c1, c2, h1, h2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0, 0
    whole = len(data) // 16
    for k1, k2 in struct.iter_unpack("<QQ", data[: 16 * whole]):
        h1 ^= _rotated((k1 * c1) & _MASK, 31) * c2 & _MASK
        h1 = ((_rotated(h1, 27) + h2) * 5 + 0x52DCE729) & _MASK
        h2 ^= _rotated((k2 * c2) & _MASK, 33) * c1 & _MASK
        h2 = ((_rotated(h2, 31) + h1) * 5 + 0x38495AB5) & _MASK
    tail = [b - 256 if b > 127 else b for b in data[16 * whole :]]
    k1 = k2 = 0
    for i, b in enumerate(tail):
        if i < 8:
            k1 ^= (b << (8 * i)) & _MASK
        else:
            k2 ^= (b << (8 * (i - 8))) & _MASK
    if len(tail) > 8:
        h2 ^= _rotated((k2 * c2) & _MASK, 33) * c1 & _MASK
    if tail:
        h1 ^= _rotated((k1 * c1) & _MASK, 31) * c2 & _MASK
    h1 ^= len(data)
    h2 ^= len(data)
    h1 = (h1 + h2) & _MASK
    h2 = (h2 + h1) & _MASK
    h1, h2 = _finished(h1), _finished(h2)
    token = (h1 + h2) & _MASK
    token = token - 2**64 if token >= 2**63 else token
    return MAX_TOKEN if token == MIN_TOKEN else token


def _turned(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def murmur3_tokens(keys: list[bytes]) -> np.ndarray:
    """The ring tokens of many keys; those of one length are computed together, a block of 16 bytes at a time."""
    sizes, out = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys)), np.zeros(len(keys), dtype=np.int64)
    c1, c2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        data = np.frombuffer(b"".join(keys[i] for i in own.tolist()), dtype=np.uint8).reshape(len(own), size)
        whole, rest = size // 16, size % 16
        blocks = np.ascontiguousarray(data[:, : 16 * whole]).view("<u8") if whole else np.zeros((len(own), 0), dtype=np.uint64)
        h1, h2 = np.zeros(len(own), dtype=np.uint64), np.zeros(len(own), dtype=np.uint64)
        for i in range(whole):
            h1 ^= _turned(blocks[:, 2 * i] * c1, 31) * c2
            h1 = (_turned(h1, 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
            h2 ^= _turned(blocks[:, 2 * i + 1] * c2, 33) * c1
            h2 = (_turned(h2, 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
        tail = data[:, 16 * whole :].view(np.int8).astype(np.int64).view(np.uint64)  # sign-extended
        ks = [np.zeros(len(own), dtype=np.uint64), np.zeros(len(own), dtype=np.uint64)]
        for i in range(rest):
            ks[i // 8] ^= tail[:, i] << np.uint64(8 * (i % 8))
        if rest > 8:
            h2 ^= _turned(ks[1] * c2, 33) * c1
        if rest:
            h1 ^= _turned(ks[0] * c1, 31) * c2
        h1, h2 = h1 ^ np.uint64(size), h2 ^ np.uint64(size)
        h1 = h1 + h2
        h2 = h2 + h1
        for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h1, h2 = ((x ^ (x >> np.uint64(33))) * np.uint64(by) for x in (h1, h2))
        h1, h2 = (x ^ (x >> np.uint64(33)) for x in (h1, h2))
        out[own] = (h1 + h2).view(np.int64)
    out[out == MIN_TOKEN] = MAX_TOKEN
    return out


@F.pandas_udf(T.LongType())
def ring_token(key: pd.Series) -> pd.Series:
    """The ring token of a binary column; null for null."""
    out, known = pd.Series(pd.NA, index=key.index, dtype="Int64"), key.notna()
    if known.any():
        out[known] = murmur3_tokens([bytes(x) for x in key[known]])
    return out


def key_bytes(*parts: Column) -> Column:
    """Serialised partition key of binary columns: one as it is, several each with its length before and a zero after."""
    if len(parts) == 1:
        return parts[0]
    framed = [F.concat(F.unhex(F.lpad(F.hex(F.length(p)), 4, "0")), p, F.unhex(F.lit("00"))) for p in parts]
    return F.concat(*framed)


def unit_of(token: str, parent: tuple[int, int], units: int) -> Column:
    """Number of the unit of an even plan over (start, end] that the column ``token`` falls in; null outside.

    By integer division, for rounding would put boundary tokens into the wrong
    unit; in decimals where the parent is wider than a long.
    """
    start, end = parent
    units = min(units, end - start)
    step = (end - start) // units
    if end - start > MAX_TOKEN:
        unit = F.expr(f"(cast(`{token}` as decimal(38,0)) - {start}BD - 1BD) div {step}BD")
    else:
        unit = F.expr(f"(`{token}` - ({start}L) - 1L) div {step}L")
    inside = (F.col(token) > F.lit(start)) & (F.col(token) <= F.lit(end))
    return F.when(inside, F.least(unit, F.lit(units - 1)).cast("int"))
