"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into two transducers with explicit states and arcs:

* the normaliser reads the characters of a text and writes marks for spaces, a
  mark before the text and, where the model asks for it, one for a run;
* the lexicon reads normalised characters along a trie of all pieces, from
  their ends, and leaves the trie where a piece begins for its first state
  again, writing the piece's id; a character without a piece goes round its
  first state by byte fallback.

Encoding composes them with the input: the normaliser's output is composed
with the lexicon into a lattice whose states are a position, a state of the
lexicon and the last piece written, and the lattice's shortest path in the
tropical semiring (weights add along a path, the least path wins) is taken.
Decoding is the inverse, from pieces to bytes.

Arc weights follow the model type:

* unigram: the piece's negative log probability.
* BPE: adding up scores doesn't give what merging gives, so a piece's arc
  weighs nothing if the last piece and this one survive merging side by side,
  and infinity if a merge would cross their border.  A sequence in which all
  neighbours survive is what merging the whole text gives, and there is one
  only, so one state at a position has a finite weight.

Where no piece has two neighbouring characters side by side, no arc crosses
their border, and the shortest paths of the stretches on both sides join.
Those of short stretches are memoised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import by_bytes, frugal, small_batches

MARK = "▁"
#: Paths of stretches up to so many characters are memoised, and so many of them and of borders in a worker.
MEMO_CHARS, MEMO_STRETCHES, MEMO_BORDERS = 48, 50_000, 150_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_UNIGRAM, _BPE = 1, 2
_INFINITY = float("inf")


class Normaliser:
    """A transducer with an output for each arc: ``arcs[state][char]`` is (next state, output); other characters go by ``other[state]``.

    An output of None stands for the character itself.
    """

    def __init__(self, prefix: bool, trim: bool) -> None:
        first = MARK if prefix else ""
        if not trim:  # nothing read yet; within the text
            self.arcs = [{" ": (1, first + MARK)}, {" ": (1, MARK)}]
            self.other = [(1, first), (1, "")]
        else:  # nothing but spaces so far; after another character; after a space that may be the last
            self.arcs = [{" ": (0, "")}, {" ": (2, "")}, {" ": (2, "")}]
            self.other = [(1, first), (1, ""), (1, MARK)]
        #: Without trimming there is one state within a text, and its arcs can be followed by replacing.
        self.single = None if trim else [(c, out) for c, (_, out) in self.arcs[1].items()]
        self.first = first

    def apply(self, text: str) -> str:
        """Compose with one text; it is a function, so there is one output."""
        if self.single is not None:
            for c, written in self.single:
                text = text.replace(c, written)
            return self.first + text if text else ""
        state, out = 0, []
        for c in text:
            arc = self.arcs[state].get(c)
            if arc is None:
                state, before = self.other[state]
                out.append(before + c)
            else:
                state, written = arc
                out.append(written)
        return "".join(out)


class Lexicon:
    """A trie of pieces read from their ends: ``arcs[state][char]`` is the next state, ``ends[state]`` the id that is written on the way back to state 0, or -1.

    Reading backwards gives the arcs that lead into a position, which is what
    shortest paths of prefixes need.
    """

    def __init__(self, pieces: dict[str, int]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.ends = [-1]
        none: dict[str, int] = {}
        for piece, own in pieces.items():
            state = 0
            for c in reversed(piece):
                following = self.arcs[state].get(c)
                if following is None:
                    if self.arcs[state] is none:
                        self.arcs[state] = {}
                    following = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append(none)  # shared until it has an arc
                    self.ends.append(-1)
                state = following
            self.ends[state] = own

    def into(self, text: str, end: int) -> list[tuple[int, int]]:
        """(begin, id) of the arcs that lead into a position, shortest first."""
        arcs, ends, found, state, at = self.arcs, self.ends, [], 0, end
        while at and (state := arcs[state].get(text[at - 1])) is not None:
            at -= 1
            if ends[state] >= 0:
                found.append((at, ends[state]))
        return found


class Transducer:
    """A compiled model. ``encode`` and ``decode`` are exact for whole texts."""

    _loaded: dict[str, "Transducer"] = {}

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        normal = proto.normalizer_spec
        if normal.precompiled_charsmap or not normal.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser and leading marks are supported")
        if proto.trainer_spec.model_type not in (_UNIGRAM, _BPE) or any(p.type not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for p in proto.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.bpe = proto.trainer_spec.model_type == _BPE
        self.prefix = normal.add_dummy_prefix
        self.normaliser = Normaliser(self.prefix, normal.remove_extra_whitespaces)
        self.scores = [p.score for p in proto.pieces]
        self.pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.lexicon = Lexicon(self.pieces)
        self.surface = [p.piece.replace(MARK, " ").encode() if p.type == _NORMAL else bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else proto.trainer_spec.unk_surface.encode() if p.type == _UNKNOWN else b"" for p in proto.pieces]
        self.piece_of = {i: p for p, i in self.pieces.items()}
        self.size = len(self.scores)
        self.leading = {i for p, i in self.pieces.items() if p.startswith(MARK)}
        self.unknown_cost = -(min(self.scores) - 10)
        cuts = all(MARK not in p.lstrip(MARK) for p in self.pieces)
        alone = "\n" if not any("\n" in p for p in self.pieces) else ""
        self.stretch = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else "")) if cuts else re.compile(r"(?s).+")
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.borders: dict[int, bool] = {}
        self.histories: dict[str, tuple[bool, list[tuple[float, str, str]]]] = {}
        self.score_of = {p: self.scores[i] for p, i in self.pieces.items()}
        self.inside = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}

    @classmethod
    def of(cls, path: str) -> "Transducer":
        """The model in a local file, compiled once in a worker."""
        if path not in cls._loaded:
            with open(path, "rb") as f:
                cls._loaded[path] = cls(f.read())
        return cls._loaded[path]

    def _history(self, piece: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """Merging a piece alone, best-scored neighbours first, leftmost if equal.

        Whether the piece itself comes out, and for each merge its score and
        the symbols at the left and right ends after it.
        """
        known = self.histories.get(piece)
        if known is None:
            parts, steps = list(piece), []
            while len(parts) > 1:
                best, at = -_INFINITY, -1
                for i in range(len(parts) - 1):
                    score = self.score_of.get(parts[i] + parts[i + 1])
                    if score is not None and score > best:
                        best, at = score, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                steps.append((best, parts[0], parts[-1]))
            known = self.histories[piece] = len(parts) == 1, steps
        return known

    def survives(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two pieces, given by id; with no piece on the left (-1), whether ``right`` comes out alone.

        Until one does, merges on either side are those of the piece alone, in
        the order of their scores; so it is enough to look, between any two of
        them, at what stands at the border.
        """
        pair = left * self.size + right
        known = self.borders.get(pair)
        if known is None:
            if len(self.borders) >= MEMO_BORDERS:
                self.borders.clear()
            known = self.borders[pair] = self._survives(self.piece_of.get(left, ""), self.piece_of[right])
        return known

    def _survives(self, left: str, right: str) -> bool:
        whole, after = self._history(right)
        if not left or not whole:
            return whole
        whole, before = self._history(left)
        if not whole:
            return False
        i = j = 0
        x, y = left[-1], right[0]
        while True:
            next_left = before[i][0] if i < len(before) else -_INFINITY
            next_right = after[j][0] if j < len(after) else -_INFINITY
            across = self.score_of.get(x + y)
            if across is not None and across > next_left and across >= next_right:
                return False
            if i < len(before) and next_left >= next_right:
                x = before[i][2]
                i += 1
            elif j < len(after):
                y = after[j][1]
                j += 1
            else:
                return True

    def _path(self, text: str) -> tuple[int, ...]:
        """Shortest path through the composition of a normalised stretch with the lexicon, as piece ids.

        Positions in order are a topological order of the lattice: the least
        weight of each comes from those before.  For BPE, all finite weights
        are 0, and the first arc that is finite is on the only finite path.
        """
        n = len(text)
        cost, last, back = [0.0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)  # the last piece; -1 also after a character by fallback, since nothing merges with it
        for end in range(1, n + 1):
            arcs = self.lexicon.into(text, end)
            if self.bpe:
                back[end] = end - 1
                while arcs:
                    at, own = arcs.pop()
                    if self.survives(last[at], own):
                        last[end], back[end] = own, at
                        break
            else:
                if not arcs or arcs[0][0] < end - 1:
                    arcs.append((end - 1, -1))
                cost[end], back[end], last[end] = min((cost[at] - (self.scores[own] if own >= 0 else -self.unknown_cost), at, own) for at, own in arcs)
        ids: list[int] = []
        end = n
        while end:
            ids += [last[end]] if last[end] >= 0 else self._fallback(text[end - 1])[::-1]
            end = back[end]
        return tuple(ids[::-1])

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def _prefix_path(self, text: str) -> tuple[int, ...]:
        """:meth:`_path` of a short BPE stretch, for those prefixes only that its own path asks for.

        Paths of prefixes are memoised: stretches share many.
        """
        found = self.memo.get(text) or self.older.get(text)
        if found is not None:
            return found
        arcs = self.lexicon.into(text, len(text))
        size, borders = self.size, self.borders
        while arcs:
            at, own = arcs.pop()
            before = self._prefix_path(text[:at]) if at else ()
            last = before[-1] if before else -1
            finite = borders.get(last * size + own)
            if self.survives(last, own) if finite is None else finite:
                return self._kept(text, (*before, own))
        return self._kept(text, (*(self._prefix_path(text[:-1]) if len(text) > 1 else ()), *self._fallback(text[-1])))

    def _stretch(self, text: str) -> tuple[int, ...]:
        """The path of a stretch, from those of its parts between neighbours that no piece has side by side."""
        inside = self.inside
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in inside]
        ids: tuple[int, ...] = ()
        for low, high in zip([0, *cuts], [*cuts, len(text)]):
            ids += self._prefix_path(text[low:high]) if self.bpe and high - low <= MEMO_CHARS else self._path(text[low:high])
        return self._kept(text, ids)

    def _kept(self, text: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_STRETCHES:  # the older half goes; what is met again moves to the newer
                self.older, self.memo = self.memo, {}
            self.memo[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without begin, end or other special pieces."""
        ids: list[int] = []
        for stretch in self.stretch.findall(self.normaliser.apply(text)):
            found = self.memo.get(stretch)
            if found is None:
                found = self.older.get(stretch)
                if found is None:
                    found = self._stretch(stretch)
                else:
                    self.memo[stretch] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        first = next((i for i in ids if self.surface[i]), self.unknown)
        return text[1:] if self.prefix and first in self.leading else text


def _kept_fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(names)]


def encode(df: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "token_ids", check: str | None = None) -> DataFrame:
    """The columns in ``keep`` and the piece ids of each whole text.

    A null text gives null, an empty one an empty list.  With ``check``, a
    column of that name tells whether decoding the ids gives the text again
    (null for null).  Repeated rows each get their row; an empty table gives
    an empty result; ``out`` and ``check`` replace columns of these names.
    ``model_path`` has to exist on every executor.
    """
    small_batches(df.sparkSession)
    names = [c for c in keep if c not in (out, check)]
    inner = [f"c{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Transducer.of(model_path)
        for batch in batches:
            for part in by_bytes(batch, len(names)):
                texts = part.column(len(names)).to_pylist()
                ids, same = [], []
                for text in texts:
                    own = None if text is None else model.encode(text)
                    ids.append(None if own is None else np.array(own, np.int32))
                    same.append(None if own is None or check is None else model.decode(own) == text)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=[*inner, "ids", "same"])

    schema = T.StructType([*_kept_fields(df, names), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())])
    rows = df.select(*(F.col(c).alias(i) for i, c in zip(inner, names)), F.col(text_col).alias("t")).mapInArrow(frugal(run), schema)
    checked = [F.col("same").alias(check)] if check else []
    return rows.select(*(F.col(i).alias(c) for i, c in zip(inner, names)), F.col("ids").alias(out), *checked)


def decode(df: DataFrame, model_path: str, ids_col: str = "token_ids", keep: tuple[str, ...] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """The columns in ``keep`` and the text of each list of piece ids; null for null, empty for an empty list."""
    small_batches(df.sparkSession)
    names = [c for c in keep if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Transducer.of(model_path)
        for batch in batches:
            for part in by_bytes(batch, len(names)):
                texts = [None if x is None else model.decode(x) for x in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string())], names=[*(f"c{i}" for i in range(len(names))), "text"])

    schema = T.StructType([*_kept_fields(df, names), T.StructField("text", T.StringType())])
    rows = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.col(ids_col).alias("x"))
    return rows.mapInArrow(frugal(run), schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("text").alias(out))
