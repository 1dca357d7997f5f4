"""Token counts: batch encoding in Arrow functions that return lengths only.

Within a task, texts are cut into pieces of at most ``piece_chars`` characters
at safe boundaries and encoded in batches of about ``batch_bytes`` bytes, so a
very long text neither makes an uneven batch nor holds a large id list.

A cut is safe at a single space between two characters that are no spaces when
no vocabulary piece has a space after another character: no merge can then
cross it.  The space is dropped there, since the encoder puts one before each
text.  Where a text has no such space for long, as in scripts without spaces,
a cut is safe between two characters that no piece has side by side, if none
has the second after a space mark either: the encoder's mark is then a piece
of its own, which isn't counted.  The conditions are checked against the
vocabulary; where they don't hold, texts are encoded uncut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import by_bytes, small_batches

SPACE_MARK = "▁"
_SPACES = (" ", SPACE_MARK)


def safe_pieces(text: str, limit: int) -> Iterator[str]:
    """Cut ``text`` at safe spaces into pieces of about ``limit`` characters; longer where none is near."""
    start, n = 0, len(text)
    while n - start > limit:
        low, at = start, start + limit
        cut = -1
        while (p := text.rfind(" ", low + 1, at)) > low:
            if text[p - 1] not in _SPACES and text[p + 1 : p + 2] not in ("", *_SPACES):
                cut = p
                break
            at = p
        p = start + limit - 1
        while cut < 0 and (p := text.find(" ", p + 1)) >= 0:
            if text[p - 1] not in _SPACES and text[p + 1 : p + 2] not in ("", *_SPACES):
                cut = p
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def joint_pieces(text: str, limit: int, inside: set[str]) -> Iterator[str]:
    """Cut ``text`` into pieces of ``limit`` characters or more, between characters that are no neighbours in ``inside``, nor the second of them after a mark."""
    start = 0
    for p in range(limit, len(text)):
        if p - start >= limit and text[p] not in _SPACES and text[p - 1 : p + 1] not in inside and SPACE_MARK + text[p] not in inside:
            yield text[start:p]
            start = p
    yield text[start:]


def can_cut(processor) -> bool:
    """Whether the vocabulary and the model's settings make the cuts above safe."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return all(SPACE_MARK not in p.lstrip(SPACE_MARK) for p in pieces) and processor.encode("a b") == processor.encode("a") + processor.encode("b")


class _Counter:
    """One encoder of a Python worker."""

    loaded: dict[str, "_Counter"] = {}

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.cuts = can_cut(self.processor)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.inside = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)} if self.cuts and SPACE_MARK in pieces else None

    @classmethod
    def of(cls, model_path: str) -> "_Counter":
        if model_path not in cls.loaded:
            cls.loaded[model_path] = cls(model_path)
        return cls.loaded[model_path]

    def pieces(self, text: str, limit: int) -> Iterator[tuple[str, int]]:
        """A text's pieces, and the tokens of each that aren't the text's."""
        for piece in safe_pieces(text, limit) if self.cuts else [text]:
            if self.inside is None or len(piece) <= 2 * limit:
                yield piece, 0
            else:
                for k, part in enumerate(joint_pieces(piece, limit, self.inside)):
                    yield part, min(k, 1)

    def lengths(self, texts: list[str | None], n_bytes: list[int], piece_chars: int, batch_bytes: int) -> list[int]:
        """Tokens of each text; ``n_bytes`` of each balance the batches."""
        counts = [0] * len(texts)
        pieces: list[str] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            for owner, ids in zip(owners, self.processor.encode(pieces, num_threads=1)):
                counts[owner] += len(ids)
            pieces.clear()
            owners.clear()
            held = 0

        for i, text in enumerate(texts):
            for piece, extra in self.pieces(text or "", piece_chars):
                pieces.append(piece)
                owners.append(i)
                counts[i] -= extra
                held += len(piece) * n_bytes[i] // max(1, len(text or ""))
                if held >= batch_bytes:
                    flush()
        if pieces:
            flush()
        return counts


def count_tokens(
    df: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    piece_chars: int = 16_384,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """Tokens of each whole text, as the library gives them for the model at ``model_path``.

    Returns ``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` for every
    row, repeated rows included.  A null text counts as empty: 0 bytes, 0
    tokens.  An empty table gives an empty result; other columns aren't read.
    ``model_path`` has to exist on every executor.
    """
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter.of(model_path)
        for batch in batches:
            for part in by_bytes(batch, 1, 8 << 20):
                n = counter.lengths(part.column(1).to_pylist(), part.column(2).to_pylist(), piece_chars, batch_bytes)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(counted, schema).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
