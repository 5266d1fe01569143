"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are taken from the whole text alone.  Trees are grown level by
level on binned statistics; all have the same depth, so they flatten into
arrays, and a batch of documents walks all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.llm.common import SPACE, emit, id_text, rows, table
from rangeflow.llm.languages import fold

TREES, DEPTH, RATE = 80, 4, 0.15
BINS = 64
PENALTY = 1.0
SAMPLE = 20_000  # labelled documents that training may see
THRESHOLD = 0.3
SYMBOLS = b".,;:!?|#$%&*<>=+@/\\-_'\"()[]{}"
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)


def statistics(text: str | None) -> np.ndarray:
    """Numbers that describe a text; an empty text gives zeros."""
    data = (text or "").encode()
    words, lines = data.split(), data.split(b"\n")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size, n = max(1, len(data)), max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    share = counts / size
    used = share[share > 0]
    ends = sum(w[-1:] in b".,;:!?" for w in words)
    plain = [w for w in words if w.isalpha() or w[:-1].isalpha()]
    out = [
        np.log1p(len(data)), np.log1p(len(words)), sizes.mean(), sizes.std(), float(sizes.max()),
        share[_UPPER].sum(), share[_LOWER].sum(), share[_DIGIT].sum(), share[128:].sum(), share[:32].sum(), share[SPACE].sum(),
        -(used * np.log2(used)).sum() if len(used) else 0.0,
        len(set(words)) / n, len(set(lines)) / len(lines), np.log1p(len(lines)), len(words) / len(lines),
        ends / n, len(plain) / n, sum(map(bytes.isupper, words)) / n,
    ]
    return np.concatenate([out, share[list(SYMBOLS)]]).astype(np.float32)


WIDTH = len(statistics(""))


class BoostedTrees:
    """Trees of one depth, flattened: node k of a tree has the children 2k + 1 and 2k + 2."""

    def __init__(self) -> None:
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        self.base = 0.0
        self.feature = np.zeros((0, inner), dtype=np.int64)
        self.threshold = np.zeros((0, inner), dtype=np.float32)
        self.value = np.zeros((0, leaves), dtype=np.float64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Log loss with second-order steps; labels all alike leave only the base rate, and no rows leave one half."""
        if not len(y):
            return self
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        if y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        raw, grown = np.full(len(y), self.base), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree, leaf = self._grow(binned, edges, p - y, p * (1 - p))
            raw += tree[2][leaf]
            grown.append(tree)
        self.feature, self.threshold, self.value = (np.stack(x) for x in zip(*grown))
        return self

    def _grow(self, binned: np.ndarray, edges: list, g: np.ndarray, h: np.ndarray) -> tuple:
        n, width = binned.shape
        feature, threshold = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf, dtype=np.float32)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            many = 2**level
            best, pick = np.full(many, 1e-6), [(0, -1)] * many
            for f in range(width):
                cell = node * BINS + binned[:, f]
                gs = np.bincount(cell, g, many * BINS).reshape(many, BINS).cumsum(axis=1)
                hs = np.bincount(cell, h, many * BINS).reshape(many, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + PENALTY) + (gt - gs) ** 2 / (ht - hs + PENALTY) - gt**2 / (ht + PENALTY)
                gain[:, len(edges[f]) :] = 0
                gain[(hs < 1) | (ht - hs < 1)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(many), at]
                for k in np.flatnonzero(top > best).tolist():
                    best[k], pick[k] = top[k], (f, int(at[k]))
            right = np.zeros(n, dtype=np.int64)
            for k, (f, cut) in enumerate(pick):
                if cut >= 0:
                    feature[many - 1 + k], threshold[many - 1 + k] = f, edges[f][cut]
                    own = node == k
                    right[own] = binned[own, f] > cut
            node = 2 * node + right
        gs, hs = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
        return (feature, threshold, -RATE * gs / (hs + PENALTY)), node

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        trees, raw = np.arange(len(self.feature)), np.full(len(x), self.base)
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            node = np.zeros((len(part), len(trees)), dtype=np.int64)
            for _ in range(DEPTH):
                f = self.feature[trees, node]
                node = 2 * node + 1 + (np.take_along_axis(part, f, axis=1) > self.threshold[trees, node])
            raw[at : at + 512] += self.value[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BoostedTrees:
    """Trees from at most about ``sample`` labelled documents, picked by a hash of the id.

    Null labels teach nothing; of several labels of a document the mean counts,
    and one half is label 1.  Of splits with equal gains the first statistic and
    then the lowest bound is taken.  No labels give a score of one half.  Only
    the statistics of the sampled texts reach the driver.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20))
    few = known.where(place < min(1.0, sample / max(1, n)) * float(1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32())), ("y", pa.float64())])
        yield from emit(((i, statistics(t), y) for i, t, y in rows(batches)), schema)

    rows_ = id_text(docs).join(F.broadcast(few), "doc_id").mapInArrow(run, "doc_id long, x array<float>, y double").toPandas()
    rows_ = rows_.sort_values("doc_id", kind="stable")
    x = np.stack(rows_["x"].to_list()).astype(np.float32) if len(rows_) else np.zeros((0, WIDTH), dtype=np.float32)
    return BoostedTrees().fit(x, (rows_["y"].to_numpy() >= 0.5).astype(np.float64))


def score(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """``doc_id, score`` of every whole text, from 0 to 1; a null text counts as empty.

    Only the text counts, so equal texts have equal scores; a very long text is
    counted whole, in a few lists of its words.  Repeated rows and null ids pass
    through, no rows give none, other columns are left out.  No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

        def found() -> Iterator[tuple]:
            ids, held = [], []
            for doc_id, text in rows(batches):
                ids.append(doc_id)
                held.append(statistics(text))
                if len(held) == 512:
                    yield from zip(ids, sent.value.score(np.stack(held)).tolist())
                    ids, held = [], []
            if held:
                yield from zip(ids, sent.value.score(np.stack(held)).tolist())

        yield from emit(found(), schema)

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold(5) != 0))
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
