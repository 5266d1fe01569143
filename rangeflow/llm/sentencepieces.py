"""SentencePiece encoding and decoding with a prefix table.

A merge-type model turns every text into one unique token sequence, and so
every prefix of the text has one unique last token.  The encoder stores that
token for each prefix: an automaton finds the tokens that end at a position,
and the one is taken whose neighbour, the last token of the shorter prefix,
stays apart from it (a test on the pair alone).  The ids are then read off the
table backwards.

Texts are cut first where no token can reach across: before a space that
follows something else, at characters that the model has not, and between two
characters that no token has side by side.  Segments recur, so their ids are
kept in a table of bounded size; that is exact, for nothing crosses a cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rangeflow.llm.common import emit, id_text, left_behind, rows, table

SPACE = "▁"
KEPT = 300_000  # segments that a worker keeps, and again as many of the generation before


class PrefixTable:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm, trained = spec.normalizer_spec, spec.trainer_spec
        kinds = {p.type for p in spec.pieces}
        if trained.model_type != 2 or not kinds <= {1, 2, 3, 6} or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or trained.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with plain normalisation and a leading space are supported")
        self.library = spm.SentencePieceProcessor(model_proto=model)
        self.end = self.library.eos_id()
        self.unknown = self.library.unk_id()
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.text = [p.piece for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        #: When a merge takes place: later for a lower score. Characters are there from the start.
        self.time = {i: -spec.pieces[i].score if len(p) > 1 else -1.0 for p, i in self.ids.items()}
        self.right_edge: dict[int, list[int]] = {}
        self.left_edge: dict[int, list[int]] = {}
        reachable = []
        for piece, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if (halves := self._last_merge(piece)) is None:
                continue  # merging never yields it
            left, right = halves
            if left is not None and max(self.time[left], self.time[right]) > self.time[i]:
                raise ValueError(f"piece {piece!r} is merged before its parts")
            self.right_edge[i] = [*(self.right_edge[right] if left is not None else ()), i]
            self.left_edge[i] = [*(self.left_edge[left] if left is not None else ()), i]
            reachable.append(piece)
        self._build(reachable)
        if any(SPACE in p.lstrip(SPACE) for p in reachable):
            raise ValueError("a piece has a space after something else")
        self.side_by_side = {p[k : k + 2] for p in reachable for k in range(len(p) - 1)}
        self.apart: dict[int, bool] = {}
        self.kept: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}
        self.most: int | None = None  # segments to keep, if not ``KEPT``

    def _build(self, pieces: list[str]) -> None:
        """The automaton: for each state its moves, where it falls back to, and the tokens that end there, longest first."""
        self.moves: list[dict[str, int]] = [{}]
        own = [0]
        for piece in pieces:
            state = 0
            for char in piece:
                if char not in self.moves[state]:
                    self.moves[state][char] = len(self.moves)
                    self.moves.append({})
                    own.append(0)
                state = self.moves[state][char]
            own[state] = self.ids[piece]
        self.back, self.ends = [0] * len(own), [()] * len(own)
        level = [0]
        while level:
            deeper = []
            for state in level:
                for char, to in self.moves[state].items():
                    if state:
                        self.back[to] = self._move(self.back[state], char)
                    found = self.ends[self.back[to]]
                    self.ends[to] = ((own[to], len(self.text[own[to]])), *found) if own[to] else found
                    deeper.append(to)
            level = deeper

    def _move(self, state: int, char: str) -> int:
        """Where a character leads; moves by way of a shorter match are kept."""
        seen = []
        while char not in self.moves[state]:
            seen.append(state)
            if not state:
                return 0
            state = self.back[state]
        return self.moves[state][char]

    def _last_merge(self, piece: str) -> tuple[int | None, int | None] | None:
        """The two tokens that the last merge of ``piece`` joins; (None, None) for one character; None if merging ends in several tokens."""
        parts = list(piece)
        if len(parts) == 1:
            return None, None
        halves = None
        while len(parts) > 1:
            times = [(self.time[self.ids[p]], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.ids]
            if not times:
                return None
            k = min(times)[1]
            halves = parts[k], parts[k + 1]
            parts[k : k + 2] = ["".join(halves)]
        return tuple(self.ids.get(h) for h in halves)

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' text gives the two tokens.

        Along the edge where they meet, both grow token by token; at each moment
        the two that touch must not merge before one of them grows.  On a tie
        the merge further left goes first.
        """
        a, b, text = self.right_edge[left], self.left_edge[right], self.text
        i = j = 0
        while True:
            grows_a = self.time[a[i + 1]] if i + 1 < len(a) else float("inf")
            grows_b = self.time[b[j + 1]] if j + 1 < len(b) else float("inf")
            both = self.ids.get(text[a[i]] + text[b[j]])
            if both is not None and self.time[both] < grows_a and self.time[both] <= grows_b:
                return False
            if i + 1 == len(a) and j + 1 == len(b):
                return True
            if grows_a <= grows_b:
                i += 1
            else:
                j += 1

    def _segment(self, text: str) -> list[int]:
        """Ids of a text all of whose characters the model has."""
        moves, ends, apart = self.moves, self.ends, self.apart
        last, state, at = [0], 0, 0
        steps = [0]
        for char in text:
            at += 1
            to = moves[state].get(char)
            if to is None:
                to = moves[state][char] = self._move(self.back[state], char)
            state = to
            for token, size in ends[state]:
                if size == at:
                    break
                pair = last[at - size] << 20 | token
                good = apart.get(pair)
                if good is None:
                    if len(apart) > 1_000_000:
                        apart.clear()
                    good = apart[pair] = self._stay_apart(last[at - size], token)
                if good:
                    break
            last.append(token)
            steps.append(size)
        out = []
        while at:
            out.append(last[at])
            at -= steps[at]
        out.reverse()
        return out

    def _missing(self, char: str) -> list[int]:
        """Ids of a character that the model has not."""
        data = char.encode()
        return [self.bytes[b] for b in data] if self.bytes else [self.unknown]

    def _stretch(self, word: str) -> tuple[tuple[int, ...], str]:
        """Ids of a stretch that no token reaches out of, and the ids as text."""
        known, pairs = self.ids, self.side_by_side
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in pairs]
        ids: list[int] = []
        for lo, hi in zip([0, *cuts], [*cuts, len(word)]):
            part = word[lo:hi]
            if hi - lo == 1:
                ids += [known[part]] if part in known else self._missing(part)
            else:
                ids += self._segment(part)
        return tuple(ids), " ".join(map(str, ids))

    def _keep(self, word: str, found: tuple[tuple[int, ...], str]) -> tuple[tuple[int, ...], str]:
        if len(word) <= 64:
            if len(self.kept) >= (self.most or KEPT):
                self.older, self.kept = self.kept, {}
            self.kept[word] = found
        return found

    def _word(self, word: str) -> tuple[tuple[int, ...], str]:
        """Ids of a word with the space before it, of which ``word`` is only the rest.

        A last character that no token joins to the one before, such as a full
        stop, is cut off first, so the word is found with and without it.
        """
        found = self.older.get(word)
        if found is None:
            if len(word) > 2 and word[-2:] not in self.side_by_side:
                short = word[:-1]
                a, b = self.kept.get(short) or self._word(short), self._stretch(word[-1])
                found = a[0] + b[0], f"{a[1]} {b[1]}"
            else:
                found = self._stretch(SPACE + word)
        return self._keep(word, found)

    def parts(self, text: str | None) -> list[tuple[tuple[int, ...], str]]:
        """Ids and their text for each stretch of ``text``, in order."""
        if not text:
            return []
        words = (text.replace(SPACE, " ") if SPACE in text else text).split(" ")
        out = list(map(self.kept.get, words))
        if "" in words:
            return self._spaced(words)
        if None in out:
            out = [x or self.kept.get(w) or self._word(w) for w, x in zip(words, out)]
        return out

    def _spaced(self, words: list[str]) -> list[tuple[tuple[int, ...], str]]:
        """The same where spaces follow each other: all but the last belong to the stretch of the word after them."""
        out, more = [], ""
        for word in words:
            if not word:
                more += SPACE
            elif more:
                out.append(self._stretch(f"{more}{SPACE}{word}"))
                more = ""
            else:
                out.append(self.kept.get(word) or self._word(word))
        return [*out, self._stretch(more)] if more else out

    def encode(self, text: str | None) -> list[int]:
        """What the library's encode gives for the text, with an end id."""
        return [*chain.from_iterable(x for x, _ in self.parts(text)), self.end]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def forget(self) -> None:
        """Empties what encoding has kept for later texts; the automaton stays."""
        self.kept, self.older, self.apart = {}, {}, {}


_ready: dict[str, PrefixTable] = {}


def _forget() -> None:
    for table_ in _ready.values():
        table_.forget()


def _table(model: bytes) -> PrefixTable:
    """One table for each model and worker; a worker takes many tasks, and those of other operators make it forget."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _ready:
        _ready[key] = PrefixTable(model)
    left_behind[__name__] = _forget
    return _ready[key]


def encode(docs: DataFrame, model_path: str, with_ids: bool = True, kept: int | None = None) -> DataFrame:
    """Ids of every whole text with an end id, their digest, and the digest of the text decoded from them.

    The model is read on the driver and sent along, so executors need no file.
    A null or empty text has only the end id; a very long one is encoded stretch
    by stretch and its ids are held whole.  Rows are independent: repeated rows
    and ids stay, null ids pass through, no rows give none, other columns are
    left out.  No shuffle.  ``kept`` bounds the segments that a worker keeps.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    more = [("ids", pa.list_(pa.int32()))] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _table(model.value)
        own.most = kept
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *more])

        def found() -> Iterator[tuple]:
            for doc_id, text in rows(batches, __name__):
                parts = own.parts(text)
                ids = [*chain.from_iterable(x for x, _ in parts), own.end]
                said = " ".join([*(x for _, x in parts), str(own.end)])
                out = doc_id, len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()
                yield (*out, ids) if with_ids else out

        yield from emit(found(), schema)

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of the column ``ids``; null ids give a null text."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _table(model.value)
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        yield from emit(((i, None if ids is None else own.decode(ids)) for i, ids in rows(batches, __name__)), schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
