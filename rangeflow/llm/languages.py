"""Language ID with a convolutional network over bytes, trained here in numpy.

A text's UTF-8 bytes are cut into windows of fixed length that cover all of it.
Filters of several widths slide over embedded bytes, each keeps its largest
answer in the window, and a softmax layer turns those into languages; a
document's answer is the average of its windows, weighted by their bytes.

For application the embedding and the filters are multiplied out into tables
by byte and by pair of bytes, so a filter's answer is a sum of table rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.llm.common import emit, id_text, rows, small_batches, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
EMBEDDED = 8
PER_LANGUAGE = 1500  # documents of each language that training may see
PER_DOCUMENT = 3  # windows of each
EPOCHS, STEPS, BATCH, RATE = 6, 500, 64, 0.004  # at least so many passes and so many steps
TOGETHER = 96  # windows that are answered at once
UNKNOWN = "und"
MOST_LANGUAGES = 256  # languages that a model may know: those with the most documents
WORD = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether some character of the text is a letter; numbers such as one half or a Roman eight are none."""
    return any(any(map(str.isalpha, m.group())) for m in WORD.finditer(text))


def _windows(data: bytes) -> np.ndarray:
    """All windows of the data, the last filled up with zero bytes."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


class ByteConvolution:
    """The network: ``fit`` trains it, ``tables`` makes it ready to be applied."""

    def __init__(self, languages: list[str], seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = {"embed": rng.standard_normal((256, EMBEDDED)).astype(np.float32) * np.float32(0.5)}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = draw(w * EMBEDDED, FILTERS)
            self.weights[f"bias{w}"] = np.zeros(FILTERS, dtype=np.float32)
        self.weights["dense"] = draw(FILTERS * len(WIDTHS), len(languages))
        self.weights["offset"] = np.zeros(len(languages), dtype=np.float32)

    def _step(self, batch: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss of one batch."""
        p, n = self.weights, len(batch)
        x = p["embed"][batch]
        seen, best = [], []
        for w in WIDTHS:
            columns = np.concatenate([x[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            answer = columns @ p[f"filter{w}"] + p[f"bias{w}"]
            at = answer.argmax(axis=1)
            best.append(np.take_along_axis(answer, at[:, None, :], axis=1)[:, 0])
            seen.append((columns, at))
        pooled = np.concatenate(best, axis=1)
        hidden = np.maximum(pooled, 0)
        logits = hidden @ p["dense"] + p["offset"]
        share = np.exp(logits - logits.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        share[np.arange(n), target] -= 1
        share /= n
        grad = {"dense": hidden.T @ share, "offset": share.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        back = (share @ p["dense"].T) * (pooled > 0)
        for k, w in enumerate(WIDTHS):
            columns, at = seen[k]
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            patch = columns[np.arange(n)[:, None], at]  # window, filter, width * embedded
            grad[f"filter{w}"] = np.einsum("nfk,nf->kf", patch, own)
            grad[f"bias{w}"] = own.sum(axis=0)
            into = (own[:, :, None] * p[f"filter{w}"].T[None]).reshape(n, FILTERS, w, EMBEDDED)
            where = batch[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
            np.add.at(grad["embed"], where.ravel(), into.reshape(-1, EMBEDDED))
        return grad

    def fit(self, windows: np.ndarray, targets: np.ndarray, seed: int = 12) -> ByteConvolution:
        """Adam over the windows; each pass also sees every window cut short, for short texts."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(windows))))):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                batch = windows[pick].copy()
                size = np.where(rng.random(len(pick)) < 0.3, rng.integers(8, WINDOW, len(pick)), WINDOW)
                batch[np.arange(WINDOW)[None] >= size[:, None]] = 0
                step += 1
                for k, g in self._step(batch, targets[pick]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.weights[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def tables(self) -> dict:
        """Answers of the filters' parts for every byte and every pair of bytes."""
        p, out = self.weights, {"languages": self.languages, "dense": self.weights["dense"], "offset": self.weights["offset"], "parts": []}
        for w in WIDTHS:
            single = [p["embed"] @ p[f"filter{w}"][j * EMBEDDED : (j + 1) * EMBEDDED] for j in range(w)]
            single[0] = single[0] + p[f"bias{w}"]
            parts = []
            for j in range(0, w - 1, 2):
                parts.append((j, True, (single[j][:, None] + single[j + 1][None]).reshape(65536, FILTERS).astype(np.float32)))
            if w % 2:
                parts.append((w - 1, False, single[w - 1].astype(np.float32)))
            out["parts"].append((w, parts))
        return out


def answers(model: dict, windows: np.ndarray) -> np.ndarray:
    """Logits of each window."""
    out = np.empty((len(windows), len(model["languages"])), dtype=np.float32)
    for at in range(0, len(windows), TOGETHER):
        batch = windows[at : at + TOGETHER].astype(np.intp)
        pairs = (batch[:, :-1] << 8) | batch[:, 1:]
        best = []
        for w, parts in model["parts"]:
            last = WINDOW - w + 1
            total = None
            for j, paired, answer in parts:
                got = answer.take((pairs if paired else batch)[:, j : j + last].ravel(), axis=0)
                total = got if total is None else np.add(total, got, out=total)
            best.append(total.reshape(len(batch), last, FILTERS).max(axis=1))
        out[at : at + len(batch)] = np.maximum(np.concatenate(best, axis=1), 0) @ model["dense"] + model["offset"]
    return out


def _predicted(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[tuple]:
    """``doc_id, lang_pred, score`` of rows ``doc_id, text``; a few documents' windows are answered together."""
    held: list[tuple] = []

    def flush() -> Iterator[tuple]:
        known = [(i, _windows(d), len(d)) for i, d in held if d is not None]
        logits = answers(model, np.concatenate([w for _, w, _ in known])) if known else None
        at, found = 0, iter(known)
        for doc_id, data in held:
            if data is None:
                yield doc_id, UNKNOWN, 0.0
                continue
            _, windows, size = next(found)
            weight = np.full(len(windows), WINDOW, dtype=np.float64)
            weight[-1] = size - WINDOW * (len(windows) - 1)
            mean = weight @ logits[at : at + len(windows)] / weight.sum()
            at += len(windows)
            share = np.exp(mean - mean.max())
            share /= share.sum()
            best = int(share.argmax())
            yield doc_id, model["languages"][best], float(share[best])

    weight = 0
    for doc_id, text in rows(batches):
        data = text.encode() if text is not None and model["languages"] and has_letter(text) else None
        held.append((doc_id, data))
        weight += len(data or b"")
        if weight > 1 << 18 or len(held) >= 512:
            yield from flush()
            held, weight = [], 0
    yield from flush()


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """A model from ``doc_id, text, lang``; rows without text or language teach nothing.

    All rows are counted by language, and the ``MOST_LANGUAGES`` with the most
    (of equal ones the first by name) are learned.  At most about
    ``per_language`` documents of each, picked by a hash of the id, and three
    windows of each of those, however long the texts, reach the driver, where
    training takes place.  Repeated rows are picked alike; without rows the
    model knows no language and answers ``und``.
    """
    usable = id_text(labelled, F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and text <> ''")
    most = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r.lang: r.n for r in most.collect()}
    languages = sorted(counts)
    if not languages:
        return {"languages": []}
    shares = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang]))))
    share = F.coalesce(F.element_at(shares, F.col("lang")), F.lit(0.0))
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("part", pa.binary())])

        def found() -> Iterator[tuple]:
            for doc_id, text, lang in rows(batches):
                every = _windows(text.encode())
                rng = np.random.default_rng((doc_id or 0) & 0xFFFFFFFF)
                for k in rng.permutation(len(every))[:PER_DOCUMENT].tolist():
                    yield doc_id, lang, every[k].tobytes()

        yield from emit(found(), schema)

    sample = usable.where(place < share * float(1 << 20)).mapInArrow(pick, "doc_id long, lang string, part binary").toPandas()
    sample = sample.sort_values(["doc_id", "part"], kind="stable")
    windows = np.frombuffer(b"".join(sample["part"]), dtype=np.uint8).reshape(-1, WINDOW)
    targets = sample["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy()
    return ByteConvolution(languages).fit(windows, targets).tables()


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; ``und`` with score 0 if it is null or has no letter.

    Only the text counts, so equal texts get equal answers; of languages that
    are as likely the first by name is taken.  A very long text is answered
    whole, ``TOGETHER`` windows at a time.  Repeated rows and null ids pass
    through, no rows give none, other columns are left out.  No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        yield from emit(_predicted(batches, sent.value), schema)

    return id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(parts: int):
    """The checksum of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def reject_unknown(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """The rows, with all columns, whose text has a language of the model at a score of ``least`` or more.

    Texts without letters and null texts go; repeated rows and ties are treated
    alike, null ids pass through, no rows give none, very long texts are
    answered whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.slice(0)
            at = batch.schema.get_field_index("text")
            only = pa.RecordBatch.from_arrays([pa.array(range(part.num_rows), pa.int64()), part.column(at)], names=["doc_id", "text"])
            keep = [lang != UNKNOWN and score >= least for _, lang, score in _predicted(iter([only]), sent.value)]
            if any(keep):
                yield part.filter(pa.array(keep, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold(4) != 2))
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
