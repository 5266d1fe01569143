"""Substring dedup by relative Lempel-Ziv parsing against reference blocks.

A reference block holds all passages round one anchor: the smallest hash of the
eight-word shingles in a window of 50 words.  Equal windows have equal anchors,
so a document needs factoring only against the blocks of its own anchors; no
other block can hold a factor that is long enough.  In a block, passages come
in order of document id, and each is factored greedily against those before it:
the longest match at a position is one factor, and at the boundary where it
ends every window that begins inside it is tried afresh, for it may go on in
another passage.  Factors of 50 words and more are duplicate spans.

An anchor of too many rows for one block is parsed through finer blocks.  Equal
passages are one reference, of the smallest document id, and any later copy is
one factor, the whole of it.  Where more different passages are left than a
block may hold, they are cut by longer shingles, whose smallest hashes are the
anchors of blocks in their turn, up to shingles as long as the window, of which
a block has one.  What factors cover in a reference holds for all its copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.llm.common import BASE, cut, emit, mixed, rows, small_batches, table, word_hashes, word_spans

WINDOW = 50
SHINGLES = (8, 16, 32, WINDOW)  # words of the shingles that cut the texts, and ever finer the passages of full blocks
SALTS = 16  # tasks that the copies of one passage are spread over
BLOCK = 1024  # passages that a block may hold
RUN = 1024  # windows of a passage; more have one anchor only where words repeat at once
HOT = 200_000  # anchors of full blocks that every task may get, so that their passages are cut where the texts are read; with more, the texts are shuffled for it

PASSAGE = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("o1", pa.int64()), ("o2", pa.int64()), ("start", pa.int32()), ("words", pa.string())])
COPY = pa.schema([*PASSAGE, ("size", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])
PASSAGE_SQL = "key long, doc_id long, o1 long, o2 long, start int, words string"
COPY_SQL = f"{PASSAGE_SQL}, size int, w1 long, w2 long"
SPAN_SQL = "doc_id long, o1 long, o2 long, lo int, hi int"


def _joined(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` words in a row, from those of the words, by doubling."""
    found, done, shift, step, factor = None, 0, 1, 1, int(BASE)
    while True:
        if width & step:
            found = h if found is None else found[: len(h) - done] + h[done:] * np.uint64(shift)
            done, shift = done + step, shift * factor % (1 << 64)
        if done == width:
            return found
        h = h[:-step] + h[step:] * np.uint64(factor)
        step, factor = step * 2, factor * factor % (1 << 64)


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, shingle: int = SHINGLES[0]) -> np.ndarray:
    """For each window of 50 words the smallest hash of its shingles."""
    if len(starts) < WINDOW:
        return np.zeros(0, dtype=np.uint64)
    h, width, reach = mixed(_joined(word_hashes(data, starts, ends), shingle)), WINDOW - shingle + 1, 1
    while 2 * reach <= width:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(h[: len(h) - rest], h[rest:])


def _anchor_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("anchors", pa.list_(pa.int64()))])

    def found() -> Iterator[tuple]:
        for doc_id, text_print, text in rows(batches):
            data = (text or "").encode()
            own = anchors(data, *word_spans(data))
            if len(own):
                yield doc_id, text_print, np.unique(own).view(np.int64)

    yield from emit(found(), schema)


def _cuts(own: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of windows with one anchor, in pieces of at most ``RUN``."""
    edges = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]]).tolist()
    for lo, hi in zip(edges, edges[1:]):
        for at in range(lo, hi, RUN):
            yield at, min(at + RUN, hi)


def _runs(batches: Iterator[pa.RecordBatch], hot: np.ndarray | None = None) -> Iterator[tuple]:
    """Passages of rows ``doc_id, print, text, anchors``: the words of every run of windows that has one of the anchors.

    With the sorted anchors ``hot`` the rows need none of their own.
    """
    for doc_id, text_print, text, *given in rows(batches):
        data = (text or "").encode()
        own = anchors(data, *word_spans(data)).view(np.int64)
        wanted = set(given[0] if hot is None else own[hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own].tolist())
        if not wanted:
            continue
        words = data.split()
        for lo, hi in _cuts(own):
            if (anchor := int(own[lo])) in wanted:
                yield anchor, doc_id, text_print, 0, lo, b" ".join(words[lo : hi - 1 + WINDOW]).decode()


def _as_copy(found: tuple) -> tuple:
    """A passage with the number of its words and 128 bits of digest of them."""
    words = found[-1]
    return *found, words.count(" ") + 1, *np.frombuffer(xxhash.xxh3_128_digest(words.encode()), dtype=np.int64).tolist()


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from emit(_runs(batches), PASSAGE, size=4000)


def _copies(batches: Iterator[pa.RecordBatch], hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    yield from emit(map(_as_copy, _runs(batches, hot)), COPY, size=4000)


def _finer(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Rows ``key, doc_id, w1, w2, words`` cut by the anchors of longer shingles; a passage's digest is the owner of its parts."""

    def found() -> Iterator[tuple]:
        for key, doc_id, w1, w2, text in rows(batches):
            data = text.encode()
            own = anchors(data, *word_spans(data), shingle).view(np.int64) ^ key
            words = text.split(" ")
            for lo, hi in _cuts(own):
                yield _as_copy((int(own[lo]), doc_id, w1, w2, lo, " ".join(words[lo : hi - 1 + WINDOW])))

    yield from emit(found(), COPY, size=4000)


class ReferenceBlock:
    """Passages that later ones are factored against, with an index of their windows."""

    def __init__(self) -> None:
        self.passages: list[list[str]] = []
        self.index: dict[str, tuple[int, int, int]] = {}  # a window to its first passage, place and document

    def factor(self, words: list[str], doc_id: int) -> list[tuple[int, int]]:
        """Spans of ``words`` that factors of at least 50 words against earlier documents cover; what is new joins the block."""
        spans, new, at, last = [], [], 0, len(words) - WINDOW
        while at <= last:
            window = " ".join(words[at : at + WINDOW])
            hit = self.index.get(window)
            if hit is None:
                new.append((window, at))
                at += 1
                continue
            passage, place, first = hit
            if first == doc_id:  # only in this document so far: no duplicate, and known
                at += 1
                continue
            reference = self.passages[passage]
            size, most = WINDOW, min(len(words) - at, len(reference) - place)
            while size < most and words[at + size] == reference[place + size]:
                size += 1
            spans.append((at, at + size))
            at += size - WINDOW + 1  # the windows that begin before are covered; the rest are tried at the boundary
        if new:
            self.passages.append(words)
            for window, place in new:
                self.index.setdefault(window, (len(self.passages) - 1, place, doc_id))
        return spans


def _factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, doc_id, o1, o2, start, words`` in order of the first two."""
    schema = pa.schema([("doc_id", pa.int64()), ("o1", pa.int64()), ("o2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def found() -> Iterator[tuple]:
        held, block = None, ReferenceBlock()
        for key, doc_id, o1, o2, start, words in rows(batches):
            if key != held:
                held, block = key, ReferenceBlock()
            for lo, hi in block.factor(words.split(" "), doc_id):
                yield doc_id, o1, o2, start + lo, start + hi

    yield from emit(found(), schema, size=4000)


def _by_blocks(passages: DataFrame) -> DataFrame:
    """``doc_id, o1, o2, lo, hi``: what factors cover in passages whose blocks are of bounded size."""
    return passages.repartition("key").sortWithinPartitions("key", "doc_id", "o1", "o2", "start").mapInArrow(_factored, SPAN_SQL)


def _by_finer_blocks(copies: DataFrame, block: int, level: int = 0) -> DataFrame:
    """The same for passages of any number: each different one is factored once, in a block that may be cut finer.

    Written tables are on both sides of each join, so that a hot key can be split.
    """
    copies, digest = cut(copies), ["w1", "w2"]
    merged = copies.groupBy(*digest).agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.first("key").alias("key"), F.first("words").alias("words"))
    references = cut(merged)
    as_passage = ("key", "doc_id", F.col("w1").alias("o1"), F.col("w2").alias("o2"), F.lit(0).alias("start"), "words")
    full = cut(references.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key"))
    if level + 1 == len(SHINGLES) or full.isEmpty():
        spans = _by_blocks(references.select(*as_passage))
    else:
        spans = _by_blocks(references.join(full, "key", "left_anti").select(*as_passage))
        cutter = partial(_finer, shingle=SHINGLES[level + 1])
        finer = references.join(full, "key", "left_semi").select("key", "doc_id", "w1", "w2", "words").mapInArrow(cutter, COPY_SQL)
        spans = spans.union(_by_finer_blocks(finer, block, level + 1))
    inside = spans.groupBy(F.col("o1").alias("w1"), F.col("o2").alias("w2")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    known = references.select(*digest, F.col("doc_id").alias("first"), "last").join(inside, digest, "left").where("last > first or spans is not null")
    # one row a passage, repeated for each salt, so that one of very many copies is spread
    salted = cut(known.drop("last")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    met = copies.drop("key", "words").withColumn("salt", F.pmod(F.xxhash64("doc_id", "o1", "o2"), F.lit(SALTS)).cast("int")).join(salted, [*digest, "salt"])
    whole = F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi")))
    parts = F.transform("spans", lambda x: F.struct((x["lo"] + F.col("start")).alias("lo"), (x["hi"] + F.col("start")).alias("hi")))
    return met.select("doc_id", "o1", "o2", F.inline(F.when(F.col("doc_id") > F.col("first"), whole).otherwise(parts)))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def found() -> Iterator[tuple]:
        for doc_id, text, spans in rows(batches):
            words = (text or "").encode().split()
            depth = np.zeros(len(words) + 1, dtype=np.int64)
            for span in spans or ():
                depth[span["lo"]] += 1
                depth[span["hi"]] -= 1
            gone = np.cumsum(depth[:-1]) > 0
            kept = [w for w, x in zip(words, gone.tolist()) if not x] if gone.any() else words
            yield doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()

    yield from emit(found(), schema)


def remove_repeats(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every document; ``kept`` has the words that stay, joined by spaces.

    Words are runs of anything but space and the controls 9 to 13.  A word goes
    if some window of 50 words over it also starts in a document with a smaller
    id; windows are judged on the input.  A null text has no words.  Rows with
    a null id are never duplicates nor references; rows that share an id are no
    duplicates of each other, so ties and repeated rows keep each other's words.
    A very long text is hashed a slice at a time and its words are held once by
    the task that cuts it; no rows give none; other columns are left out.
    """
    every = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), F.col("text").cast("string").alias("text"))
    named, nameless = every.where("doc_id is not null"), every.where("doc_id is null")
    lists = cut(named.mapInArrow(_anchor_lists, "doc_id long, print long, anchors array<long>"))
    each = lists.select("doc_id", "print", F.explode("anchors").alias("anchor"))
    # the smallest and largest id and the count are taken before the shuffle
    # written out, so that both sides of the join are dealt out for it alone and a hot anchor can be split
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("anchor", (F.col("n") > block).alias("hot"))
    shared = cut(shared)
    hot = shared.where("hot").select("anchor")
    n_hot = hot.limit(HOT + 1).count()
    told = 0 < n_hot <= HOT
    of_doc = each.join(shared.where("not hot") if told else shared, "anchor").groupBy("doc_id", "print").agg(*(F.collect_list(F.when(F.col("hot") == x, F.col("anchor"))).alias(n) for n, x in (("cold", False), ("hot", True))))
    of_doc = cut(of_doc)

    # the joins below all deal out the texts by the same key, which Spark does once and reads again
    def texts_with(kind: str) -> DataFrame:
        return named.join(of_doc.select("doc_id", "print", kind).where(F.size(kind) > 0), ["doc_id", "print"]).select("doc_id", "print", "text", kind)

    spans = _by_blocks(texts_with("cold").mapInArrow(_passages, PASSAGE_SQL))
    if told:
        cutter = partial(_copies, hot=np.sort(hot.toArrow()["anchor"].to_numpy()))
        spans = spans.union(_by_finer_blocks(named.mapInArrow(cutter, COPY_SQL), block))
    elif n_hot:
        spans = spans.union(_by_finer_blocks(texts_with("hot").mapInArrow(_copies, COPY_SQL), block))
    of_doc_spans = spans.groupBy("doc_id", F.col("o1").alias("print")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    marked = named.join(of_doc_spans, ["doc_id", "print"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept string"
    alone = nameless.select("doc_id", "text", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans"))
    return marked.mapInArrow(_kept, schema).union(alone.mapInArrow(_kept, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), firsts AS (
  SELECT h, min(doc_id) AS first FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k
  FROM windows JOIN firsts USING (h) WHERE first < doc_id
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n
  FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
