"""SimHash near-duplicates: fingerprints, a self-join of their binary tries, and the classes it links.

Two fingerprints of 64 bits that differ in at most ``budget`` bits agree wholly
in some of more than ``budget`` blocks of bits.  Every distinct fingerprint goes
once to each choice of blocks, with the chosen blocks first; all that share
them form a binary trie.  The join walks pairs of trie nodes from the root, adds
one for each level where the two sides part, and drops a pair when it exceeds
the budget, or when all below it is linked already.  More blocks are chosen from
where there are more fingerprints, so that tries stay small.

``keep_dissimilar`` takes texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more.  Such texts differ in about 39 of 256 bits, where no
block of bits selects anything, so the tries are those of texts that share one
of ``BANDS`` keys of ``ROWS`` minima of their hashed shingles each; two texts at
0.8 share no key with a chance of about 3e-5, and pass the budget of ``NEAR``
bits but for a chance of about 1e-8.  The classes that the tries link are then
checked by exact counts of common shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.llm.common import cut, emit, fresh, id_text, mixed, rows, shingle_hashes, table, word_hashes, word_spans
from rangeflow.llm.graph import components

SEED = 42
BITS = 64
PAIRS = 1 << 18  # node pairs that are expanded at once
GATHERED = 1 << 17  # fingerprints whose tries are walked together
TRIE = 1 << 16  # fingerprints that a trie may have on average before more blocks are taken
WIDE = 4  # words of 64 bits in the fingerprints of ``keep_dissimilar``
NEAR = 72  # bits of them in which two texts may differ
GATHERED_WIDE = 1 << 14
BANDS, ROWS = 20, 4  # keys of a text, and minima in each
PIECE = 1024  # fingerprints of one key that are joined in one task
PIECE_TEXTS, PIECE_BYTES = 128, 4 << 20  # texts of one class that are checked in one task, and their bytes
_RNG = np.random.default_rng(SEED)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
TURNS = _RNG.integers(0, 1 << 63, WIDE, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
WIDE_NAMES = [f"w{k}" for k in range(WIDE)]


def simhash(text: str | None, words: int = 4) -> int:
    """The unsigned fingerprint of a text's shingles of ``words`` words; zero without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, sizes = b" ".join(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(words, len(parts))
    digest, n = xxhash.xxh64_intdigest, len(parts) - k + 1
    counts, lo = np.zeros(BITS, dtype=np.int64), starts.tolist()
    hi = ends[k - 1 :].tolist()
    for at in range(0, n, 1 << 14):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(lo[at : at + (1 << 14)], hi[at : at + (1 << 14)])], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes())


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, print, bits`` of every whole text; ``bits`` holds the fingerprint's 64 bits as a signed long, ``print`` a hash of the text.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("bits", pa.int64())])
        signed = ((i, p, simhash(t, words)) for i, t, p in rows(batches))
        yield from emit(((i, p, h - (h >> 63 << 64)) for i, p, h in signed), schema)

    return id_text(docs, F.xxhash64(F.col("text").cast("string")).alias("print")).mapInArrow(run, "doc_id long, print long, bits long")


def _labels(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def trie_join(keys: np.ndarray, groups: np.ndarray, budget: int, level: int = 0, parent: np.ndarray | None = None) -> np.ndarray:
    """For each key the index of its class within its group; ``keys`` are distinct and sorted within each group.

    A key is one word of 64 bits, or a row of several.  ``groups`` has the
    bounds of the groups, whose keys agree above ``level``; ``parent`` may name
    classes that are known.  Pairs of nodes, each a range of keys with the bits
    above the level in common, are expanded level by level; a full stack is
    worked off from its end, so memory stays bounded.
    """
    words = keys.reshape(len(keys), -1)
    n = len(words)
    parent = np.arange(n) if parent is None else _labels(parent)
    ones: dict[int, np.ndarray] = {}

    def split(bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if bit not in ones:
            on = (words[:, bit // BITS] >> np.uint64(BITS - 1 - bit % BITS)) & np.uint64(1)
            ones[bit] = np.concatenate([[0], np.cumsum(on, dtype=np.int32)])
        return hi - (ones[bit][hi] - ones[bit][lo])

    def linked(a: np.ndarray, b: np.ndarray) -> None:
        """Joins the classes of the keys a and b, pair by pair."""
        nonlocal parent, changes
        apart = parent[a] != parent[b]
        if not apart.any():
            return
        for x, y in np.unique(np.stack([parent[a[apart]], parent[b[apart]]], axis=1), axis=0).tolist():
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
        parent = _labels(parent)
        changes = np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])])

    changes = np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])])
    starts, stops = groups[:-1], groups[1:]
    stack = [(level, starts, stops, starts, stops, np.zeros(len(starts), dtype=np.int16))]
    while stack:
        level, alo, ahi, blo, bhi, off = stack.pop()
        if len(alo) > PAIRS:
            half = len(alo) // 2
            stack.append((level, alo[:half], ahi[:half], blo[:half], bhi[:half], off[:half]))
            alo, ahi, blo, bhi, off = alo[half:], ahi[half:], blo[half:], bhi[half:], off[half:]
            stack.append((level, alo, ahi, blo, bhi, off))
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) <= budget
            linked(a[near], b[near])
        # done: pairs of single keys, and pairs whose keys are all in one class
        one = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (parent[alo] == parent[blo])
        go = ~single & ~one
        if not go.any():
            continue
        alo, ahi, blo, bhi, off = alo[go], ahi[go], blo[go], bhi[go], off[go]
        amid, bmid, same = split(level, alo, ahi), split(level, blo, bhi), alo == blo
        other = ~same
        found = [
            (alo, amid, blo, bmid, off),
            (amid, ahi, bmid, bhi, off),
            (alo, amid, bmid, bhi, off + 1),
            (amid[other], ahi[other], blo[other], bmid[other], off[other] + 1),
        ]
        parts = [np.concatenate(x) for x in zip(*found)]
        keep = (parts[0] < parts[1]) & (parts[2] < parts[3]) & (parts[4] <= budget)
        if keep.any():
            stack.append((level + 1, *(x[keep].astype(x.dtype) for x in parts)))
    return parent


def _grouped(batches: Iterator[pa.RecordBatch], names: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns of long values as an array with a row each, and the bounds of groups, in batches of whole groups.

    Rows come sorted by group, which the first ``names`` columns tell apart.
    """

    def bounds(found: np.ndarray) -> np.ndarray:
        new = np.flatnonzero((found[:names, 1:] != found[:names, :-1]).any(axis=0)) + 1
        return np.concatenate([[0], new, [found.shape[1]]])

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        if sum(x.shape[1] for x in held) >= most:
            found = np.concatenate(held, axis=1)
            edges = bounds(found)
            held = [found[:, edges[-2] :]]  # the last group may go on in the next batch
            if len(edges) > 2:
                yield found[:, : edges[-2]], edges[:-1]
    if held and (found := np.concatenate(held, axis=1)).shape[1]:
        yield found, bounds(found)


def _links(batches: Iterator[pa.RecordBatch], budget: int, shared: int) -> Iterator[pa.RecordBatch]:
    """Rows ``choice, head, turned, bits`` sorted by the first three; a link from each fingerprint to the first of its class."""
    for (_, _, turned, bits), groups in _grouped(batches, 2, GATHERED):
        parent = trie_join(turned.view(np.uint64), groups, budget, shared)
        at = np.flatnonzero(parent != np.arange(len(parent)))
        yield pa.RecordBatch.from_arrays([pa.array(bits[at]), pa.array(bits[parent[at]])], names=["a", "b"])


def block_choices(budget: int, distinct: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]], int]:
    """Blocks of bits as start and end, the choices of blocks to be shared, and how many bits a choice has at least.

    With one block more than the budget two near fingerprints share a block, with
    ``k`` blocks more they share ``k``; ``k`` grows with the number of fingerprints, as long as a
    trie would have more than ``TRIE`` of them on average.
    """
    for k in range(1, 4):
        n = budget + k
        blocks = [(i * BITS // n, (i + 1) * BITS // n) for i in range(n)]
        choices = list(combinations(range(n), k))
        shared = min(sum(blocks[i][1] - blocks[i][0] for i in c) for c in choices)
        if distinct >> shared <= TRIE or k == 3:
            return blocks, choices, shared
    raise AssertionError


def _turned(blocks: list[tuple[int, int]], first: tuple[int, ...]) -> Column:
    """The fingerprint with the chosen blocks moved to the front."""
    out, at = F.lit(0).cast("long"), BITS
    for i in [*first, *(i for i in range(len(blocks)) if i not in first)]:
        lo, hi = blocks[i]
        part = F.col("bits") if hi - lo == BITS else F.shiftrightunsigned("bits", BITS - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        at -= hi - lo
        out = out.bitwiseOR(F.shiftleft(part, at))
    return out


def link_fingerprints(distinct: DataFrame, budget: int = 4) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``bits`` that join all that differ in at most ``budget`` bits.

    Not every pair is given, only as many as connect each class of a trie.
    """
    blocks, choices, shared = block_choices(budget, distinct.count())
    turned = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), _turned(blocks, c).alias("turned")) for i, c in enumerate(choices))))
    dealt = distinct.select("bits", turned.alias("at")).select("at.choice", F.shiftrightunsigned("at.turned", BITS - shared).alias("head"), "at.turned", "bits")
    # within one head all keys have one sign, so their order as signed numbers is that of their bits
    dealt = dealt.repartition("choice", "head").sortWithinPartitions("choice", "head", "turned")
    return dealt.mapInArrow(lambda batches: _links(batches, budget, shared), "a long, b long")


def classes(prints: DataFrame, budget: int = 4) -> DataFrame:
    """The fingerprints ``doc_id, bits`` with all columns, and ``root``, a fingerprint that names the class, and ``component_id``, the smallest id in it.

    Copies count once: only distinct fingerprints are joined.  Null ids keep
    their rows and pass links on, but name a class only where it has no other
    member (then null).  An empty table gives an empty result.
    """
    prints = cut(prints)
    distinct = cut(prints.groupBy("bits").agg(F.min("doc_id").alias("first")))
    rooted = components(link_fingerprints(distinct, budget))
    member = distinct.join(rooted.withColumnRenamed("node", "bits"), "bits")
    named = member.groupBy("root").agg(F.min("first").alias("component"))
    renamed = member.join(named, "root").select("bits", "root", "component")
    # written out, so that both sides of the last join are dealt out for it alone and a hot fingerprint can be split
    firsts = cut(distinct.join(renamed, "bits", "left").select("bits", F.coalesce("root", "bits").alias("root"), F.coalesce("component", "first").alias("component_id")))
    return prints.join(firsts, "bits").select(*prints.columns, "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    Texts lose the case of A-Z and are cut into words at ASCII white space; a
    text with fewer words than a shingle is one shingle, a null text or one
    without words has fingerprint zero and is linked like any other.  A very long
    text is hashed a slice of its shingles at a time.  Repeated rows each get a
    row; other columns are left out.
    """
    return classes(fingerprints(docs, words), budget).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4, budget: int = 4) -> DataFrame:
    """The documents with one of each class of near-duplicates left, the one with the smallest id; all columns stay.

    Of several texts with that id in one class the one with the smallest hash
    stays, and of repeated rows one.  Rows without id are kept, for nothing
    tells them apart.
    """
    found = classes(fingerprints(docs, words), budget).where("doc_id = component_id")
    each = found.groupBy("root", "doc_id", "print").agg(F.count(F.lit(1)).alias("copies"))
    return _firsts(docs, each)


def _firsts(docs: DataFrame, each: DataFrame) -> DataFrame:
    """The documents that come first in their class, by id and text, and those without id; ``each`` has ``root, doc_id, print, copies``.

    Of repeated rows any one is taken, by an aggregate that meets before the shuffle.
    """
    own, text_print, row = fresh(docs, "own_id", "own_print", "row")
    first = each.groupBy("root").agg(F.min(F.struct("doc_id", "print", "copies")).alias("k"))
    first = cut(first.select(F.col("k.doc_id").alias(own), F.col("k.print").alias(text_print), "k.copies"))
    doc_id, doc_print = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))

    def those(which: str) -> DataFrame:
        wanted = first.where(which).select(own, text_print)
        return docs.join(wanted, (doc_id == F.col(own)) & (doc_print == F.col(text_print)), "left_semi")

    out = those("copies = 1")
    if not first.where("copies > 1").isEmpty():
        every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        out = out.unionByName(those("copies > 1").groupBy(doc_id.alias(own), doc_print.alias(text_print)).agg(F.first(every).alias(row)).select(f"{row}.*"))
    return out.unionByName(docs.where("doc_id is null"))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted, A-Z in lower case; a text without words has one, zero."""
    data = (text or "").encode().lower()
    own = np.unique(shingle_hashes(word_hashes(data, *word_spans(data)), words))
    return own if len(own) else np.zeros(1, dtype=np.uint64)


def wide_simhash(own: np.ndarray) -> np.ndarray:
    """The fingerprint of a shingle set: a bit is one if it is set in over half of the hashes."""
    out = np.zeros(WIDE, dtype=np.uint64)
    for k in range(WIDE):
        counts = np.zeros(BITS, dtype=np.int64)
        for at in range(0, len(own), 1 << 14):
            hashes = mixed(own[at : at + (1 << 14)] * TURNS[k] + np.uint64(k)).astype(">u8")
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out[k] = int.from_bytes(np.packbits(2 * counts > len(own)).tobytes())
    return out


def band_keys(own: np.ndarray) -> list[int]:
    """The keys of a shingle set, as signed longs; sets share many where they are similar."""
    least = np.full(len(FACTORS), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(own), 1 << 10):
        least = np.minimum(least, (own[at : at + (1 << 10), None] * FACTORS).min(axis=0))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64).tolist()


def similar(sets: list[np.ndarray], least: float, known: list | None = None) -> Iterator[tuple[int, int]]:
    """Links between the sets that join all with a Jaccard similarity of ``least`` or more, by exact counts.

    A set that has been reached is compared only with those that have not, so a
    class of similar sets takes far fewer comparisons than it has pairs.
    ``known`` may name classes of sets that are linked already.
    """
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(ids, np.cumsum(sizes)[:-1])
    has = np.zeros(ids.max() + 1, dtype=np.int32)
    named = np.arange(len(sets)) if known is None else np.unique(np.array(known), return_inverse=True)[1]
    left, rest, queue = np.arange(len(sets)), ids, []
    while len(left):
        x = queue.pop() if queue else int(left[0])
        has[own[x]] = 1
        n = sizes[left]
        both = np.add.reduceat(has[rest], np.cumsum(n) - n)
        has[own[x]] = 0
        near = both >= least * (n + sizes[x] - both) - 1e-9
        met = left[near & (named[left] != named[x])]
        yield from ((x, int(y)) for y in met)
        reached = near | np.isin(named[left], np.append(named[met], named[x]))
        queue += left[reached & (left != x)].tolist()
        left, rest = left[~reached], rest[np.repeat(~reached, n)]


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, print, keys`` of every whole text, and its wide fingerprint in four columns.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("keys", pa.list_(pa.int64())), *((w, pa.int64()) for w in WIDE_NAMES)])
        made = ((i, p, shingles(t, words)) for i, t, p in rows(batches))
        yield from emit(((i, p, band_keys(own), *wide_simhash(own).view(np.int64).tolist()) for i, p, own in made), schema)

    return id_text(docs, F.xxhash64(F.col("text").cast("string")).alias("print")).mapInArrow(run, "doc_id long, print long, keys array<long>, " + ", ".join(f"{w} long" for w in WIDE_NAMES))


def _wide_links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows ``four of a group, known, print, wide fingerprint`` sorted by group: links ``a, b`` of prints.

    Rows with one ``known`` are linked already.
    """
    for found, groups in _grouped(batches, 4, GATHERED_WIDE):
        sizes = np.diff(groups)
        group = np.repeat(np.arange(len(sizes)), sizes)
        some = (sizes > 1)[group]
        group, known, prints, words = group[some], found[4, some], found[5, some], found[6:, some].T.view(np.uint64)
        if not len(group):
            continue
        order = np.lexsort((prints, *words.T[::-1], group))
        group, known, prints, words = group[order], known[order], prints[order], words[order]
        again = np.concatenate([[False], (group[1:] == group[:-1]) & (words[1:] == words[:-1]).all(axis=1)])
        stands = np.flatnonzero(~again)[np.cumsum(~again) - 1]
        links = [(prints[again], prints[stands[again]])]
        keep = ~again
        bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], group[keep][1:] != group[keep][:-1]])), [int(keep.sum())]])
        classes_, firsts = np.unique(np.stack([group[keep], known[keep]]), axis=1, return_index=True, return_inverse=True)[1:]
        parent = trie_join(words[keep], bounds, budget, 0, classes_[firsts.ravel()])
        own = prints[keep]
        at = np.flatnonzero(parent != np.arange(len(parent)))
        links.append((own[at], own[parent[at]]))
        a, b = (np.concatenate(x) for x in zip(*links))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _pieced(rows_: DataFrame, key: str, pieces: Column, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``a, b`` between rows with one ``key``, found by ``join`` in cells of bounded size.

    ``rows_`` have the ``print`` of a text, which is once under a key, and
    ``join`` gets them with the cell in ``key, kind, low, high`` and with
    ``known``, a class that a row is in already.  A first round joins the pieces
    that a hash deals the rows of a key out to, each by itself, which links most
    of a dense group.  Where a key has several pieces and its rows are then in
    several classes, a second round brings together every two pieces, but for
    those of the largest class among themselves: so no link is lost, and nothing
    is compared that is linked already.  ``pieces`` gives for ``n`` rows and
    ``bytes`` bytes how many pieces they take.
    """
    rows_ = cut(rows_)
    sums = rows_.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    sums = cut(sums.select(key, pieces.alias("pieces")))
    rows_ = rows_.join(sums, key)  # both sides written out, so that AQE can split a hot key
    own = F.pmod(F.xxhash64("print", key), F.col("pieces")).cast("long")
    zero = F.lit(0).cast("long")
    links = join(rows_.select("*", zero.alias("kind"), own.alias("low"), own.alias("high"), F.col("print").alias("known")))
    if sums.where("pieces > 1").isEmpty():
        return links
    links = cut(links)
    named = cut(rows_.where("pieces > 1").drop("pieces").join(components(links).withColumnRenamed("node", "print"), "print", "left").withColumn("known", F.coalesce("root", "print")).drop("root"))
    by_class = named.groupBy(key, "known").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    top = F.max(F.struct("n", "bytes", "known"))
    split = by_class.groupBy(key).agg(top.alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("found")).where("found > 1")
    split = split.select(key, F.col("top.known").alias("giant"), F.struct(F.col("top.n").alias("n"), F.col("top.bytes").alias("bytes")).alias("g"), F.struct((F.col("n") - F.col("top.n")).alias("n"), (F.col("bytes") - F.col("top.bytes")).alias("bytes")).alias("o"))
    counted = lambda side: split.select(key, F.col(f"{side}.n").alias("n"), F.col(f"{side}.bytes").alias("bytes")).select(key, pieces.alias(f"{side}_pieces"))
    split = cut(split.select(key, "giant").join(counted("g"), key).join(counted("o"), key))
    if split.isEmpty():
        return links
    met = named.join(split, key)
    place = lambda side: F.pmod(F.xxhash64("print", key), F.col(f"{side}_pieces")).cast("long")
    range_of = lambda side: F.sequence(zero, F.col(f"{side}_pieces").cast("long") - 1)
    cell = lambda kind, low, high: F.struct(F.lit(kind).cast("long").alias("kind"), low.alias("low"), high.alias("high"))
    of_giant = F.transform(range_of("o"), lambda j: cell(1, place("g"), j))
    of_other = F.concat(F.transform(range_of("g"), lambda i: cell(1, i, place("o"))), F.transform(range_of("o"), lambda j: cell(2, F.least(place("o"), j), F.greatest(place("o"), j))))
    cells = met.withColumn("cell", F.explode(F.when(F.col("known") == F.col("giant"), of_giant).otherwise(of_other)))
    return links.unionByName(cut(join(cells.select(*rows_.drop("pieces").columns, "known", "cell.*"))))


def keep_dissimilar(docs: DataFrame, words: int = 5, least: float = 0.8, budget: int = NEAR) -> DataFrame:
    """As ``keep_one``, but two texts are near-duplicates where their sets of shingles have a Jaccard similarity of ``least`` or more.

    Of each class of texts that such links connect one document stays, the one
    with the smallest id.  Texts without words are alike, null ones among them;
    a very long text is shingled a slice at a time.  Only texts of classes that
    the tries link are shuffled.
    """

    def tries(cells: DataFrame) -> DataFrame:
        held = cells.select("key", "kind", "low", "high", "known", "print", *WIDE_NAMES)
        dealt = held.repartition("key", "kind", "low", "high").sortWithinPartitions("key", "kind", "low", "high")
        return dealt.mapInArrow(lambda batches: _wide_links(batches, budget), "a long, b long")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int]]:
            for _, group in groupby(rows(batches), key=itemgetter(0, 1, 2, 3)):
                known, prints, sets = zip(*((k, p, shingles(t, words)) for *_, k, p, t in group))
                yield from ((prints[i], prints[j]) for i, j in similar(list(sets), least, list(known)))

        yield from emit(found(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    def check(cells: DataFrame) -> DataFrame:
        at = ["class", "kind", "low", "high"]
        dealt = cells.select(*at, "known", "print", "text").repartition(*at).sortWithinPartitions(*at)
        return dealt.mapInArrow(checked, "a long, b long")

    some_id = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    rest = [F.first(c).alias(c) for c in ("keys", *WIDE_NAMES)]
    # one row for each id and text, then for each text: partial results meet, however many copies it has
    per_id = sketches(docs, words).groupBy("print", "doc_id").agg(F.count(F.lit(1)).alias("copies"), *rest)
    texts = per_id.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copies")).alias("k"), *rest)
    texts = cut(texts.select("print", "k.doc_id", "k.copies", "keys", *WIDE_NAMES))
    keyed = texts.select(F.explode("keys").alias("key"), "print")
    shared = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    members = keyed.join(shared, "key").join(texts.select("print", *WIDE_NAMES), "print").withColumn("size", F.lit(0).cast("long"))
    candidates = components(_pieced(members, "key", F.ceil(F.col("n") / PIECE), tries)).select(F.col("node").alias("print"), F.col("root").alias("class"))
    wanted = texts.join(candidates, "print").select(some_id("doc_id").alias("doc_id"), "print", "class")
    given = id_text(docs, F.xxhash64(F.col("text").cast("string")).alias("print")).withColumn("doc_id", some_id("doc_id"))
    held = given.join(cut(wanted), ["doc_id", "print"]).groupBy("print", "class").agg(F.first("text").alias("text"))
    held = held.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    pieces = F.greatest(F.ceil(F.col("n") / PIECE_TEXTS), F.least(F.col("n"), F.ceil(F.col("bytes") / PIECE_BYTES)))
    rooted = components(_pieced(held, "class", pieces, check)).withColumnRenamed("node", "print")
    each = texts.where("doc_id is not null").join(rooted, "print", "left").select(F.coalesce("root", "print").alias("root"), "doc_id", "print", "copies")
    return _firsts(docs, each)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
