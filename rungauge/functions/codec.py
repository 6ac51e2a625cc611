"""Token ids and text by a vocabulary of byte pieces, and what continues a text when ids do not.

The same text can be two id sequences: a response is sampled piece by piece, while the
next prompt is encoded in one pass.  ``continuation`` compares the bytes, starting where
the ids first differ, and gives the ids of what the prompt says beyond the context.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class PieceCodec:
    """Encodes by the longest piece that fits at each place, or by ``encode`` where one is given.

    ``pieces[id]`` are an id's bytes.  A vocabulary with all single bytes encodes
    every text; another one raises for bytes it has no piece for.
    """

    def __init__(self, pieces: Sequence[bytes], encode: Callable[[str], Sequence[int]] | None = None) -> None:
        self.pieces = list(pieces)
        self.ids = {piece: i for i, piece in reversed(list(enumerate(self.pieces))) if piece}
        self.given = encode
        self.lengths: dict[int, list[int]] = {}
        for first, n in sorted({(p[0], len(p)) for p in self.ids}, key=lambda x: -x[1]):
            self.lengths.setdefault(first, []).append(n)

    @classmethod
    def from_ranks(cls, path: str, encode: Callable[[str], Sequence[int]] | None = None) -> "PieceCodec":
        """A vocabulary file with a base64 piece and its id per line."""
        with open(path, "rb") as lines:
            ranks = dict((int(n), base64.b64decode(piece)) for piece, n in map(bytes.split, lines))
        return cls([ranks.get(i, b"") for i in range(max(ranks) + 1)], encode)

    def data(self, ids: Sequence[int]) -> bytes:
        """The bytes of some ids; an id outside the vocabulary is an IndexError."""
        if any(i < 0 for i in ids):
            raise IndexError("negative id")
        return b"".join([self.pieces[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return list(self.given(text)) if self.given else self.encode_bytes(text.encode())

    def encode_bytes(self, data: bytes) -> list[int]:
        out, at = [], 0
        while at < len(data):
            for n in self.lengths.get(data[at], ()):
                found = self.ids.get(data[at : at + n])
                if found is not None:
                    out.append(found)
                    at += n
                    break
            else:
                raise ValueError(f"no piece begins with byte {data[at]}")
        return out

    def continuation(self, prompt: Sequence[int], context: Sequence[int]) -> list[int] | None:
        """Ids of the text that ``prompt`` has after the text of ``context``; null when it does not begin with it.

        What is left is encoded anew, as its first byte need not begin a piece of the prompt.
        """
        shared = next((i for i, (a, b) in enumerate(zip(prompt, context)) if a != b), min(len(prompt), len(context)))
        try:
            there, expected = self.data(prompt[shared:]), self.data(context[shared:])
        except IndexError:
            return None
        if not there.startswith(expected):
            return None
        rest = there[len(expected) :]
        if not rest:
            return []
        try:
            return self.encode(rest.decode()) if self.given else self.encode_bytes(rest)
        except ValueError:
            return None


@lru_cache(maxsize=4)
def _loaded(load: Callable[[], PieceCodec]) -> PieceCodec:
    """One codec per Python worker, for loaders that are functions of a module."""
    return load()


ROWS = 64  # rows whose ids are Python objects at a time


def _values(column: pa.Array) -> list:
    """The values of a column; ids as lists."""
    if not pa.types.is_list(column.type) or column.values.null_count:
        return column.to_pylist()
    ids, ends = column.values.to_numpy(), column.offsets.to_pylist()
    return [ids[a:b].tolist() if there else None for a, b, there in zip(ends, ends[1:], column.is_valid().to_pylist())]


def _by_rows(apply: Callable, columns: Sequence[pa.Array], kind: pa.DataType) -> pa.Array:
    """``apply`` row by row, null where an argument is null; a few rows at a time leave Arrow's compact form."""
    parts = [pa.array([], kind)]
    for at in range(0, len(columns[0]), ROWS):
        rows = zip(*[_values(c.slice(at, ROWS)) for c in columns])
        parts.append(pa.array([None if any(v is None for v in row) else apply(*row) for row in rows], kind))
    return pa.concat_arrays(parts)


def continuation_of(load: Callable[[], PieceCodec]) -> Callable[[Column, Column], Column]:
    """``continuation`` as a column function of (prompt ids, context ids); null where either is null."""

    @F.arrow_udf("array<int>")
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        codec = _loaded(load)
        for columns in batches:
            yield _by_rows(codec.continuation, columns, pa.list_(pa.int32()))

    return apply


def ids_of(load: Callable[[], PieceCodec]) -> Callable[[Column], Column]:
    """Text to ids as a column function."""

    @F.arrow_udf("array<int>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _loaded(load)
        for texts in batches:
            yield _by_rows(codec.encode, [texts], pa.list_(pa.int32()))

    return apply


def text_of(load: Callable[[], PieceCodec]) -> Callable[[Column], Column]:
    """Ids to text as a column function; bytes that are no text become replacement signs."""

    @F.arrow_udf("string")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _loaded(load)
        for rows in batches:
            yield _by_rows(lambda ids: codec.data(ids).decode(errors="replace"), [rows], pa.string())

    return apply
