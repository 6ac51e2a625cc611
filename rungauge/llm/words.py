"""Words of whole texts, found and hashed batch by batch on the bytes of an Arrow column.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became
a-z: ASCII digits, ASCII letters and everything beyond ASCII.  In UTF-8 that is a
property of single bytes, so one table look-up finds the words of many documents
at once, without decoding them.  ``TOKEN`` is the other kind: runs of bytes above
the space, letters as they are.

Memory is bounded by the caller's piece of documents, not by the table; scratch
arrays hold one piece of ``PIECE`` bytes, or the longest single word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
ROWS = 1 << 15
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
PLAIN = np.arange(256, dtype=np.uint8)
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
TOKEN = np.arange(256) > 32


def mix(x: np.ndarray) -> np.ndarray:
    """Splits 64 bits well (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, PIECE + 1), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind]


class Words:
    """Words of some documents: ``hashes`` in order; document i has those from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD, fold: np.ndarray = FOLD):
        """``data``: bytes of all documents; ``offsets``: where each begins, and the end of the last."""
        n = len(data)
        inside = table[fold[data]]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[offsets < n]
        begins[cuts] = inside[cuts]
        ends = inside.copy()
        if n:
            ends[:-1] &= ~inside[1:] | begins[1:]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hashed(data, fold)

    def _hashed(self, data: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            low = self.starts[at]
            upto = max(at + 1, int(np.searchsorted(self.ends, low + PIECE, side="right")))
            piece = _BYTES[fold[data[low : self.ends[upto - 1]]]]
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * _power("up", len(piece))[: len(piece)], out=total[1:])
            a, b = self.starts[at:upto] - low, self.ends[at:upto] - low
            sums = (total[b] - total[a]) * _power("down", len(piece) + 1)[a]
            out[at:upto] = mix(sums + (b - a).astype(np.uint64) * GOLDEN)
            at = upto
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive words (fewer runs than words)."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = mix(out + hashes[j : j + n] * np.uint64(2 * j + 3) + GOLDEN)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_string())
    if wide.null_count:
        wide = wide.fill_null("")
    buffers = wide.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(wide) + 1, wide.offset * 8) if len(wide) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches, size: int = 2 * PIECE, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts have about ``size`` bytes (a longer text stands alone), with bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            upto = min(upto, at + ROWS)
            low = offsets[at]
            yield batch.slice(at, upto - at), data[low : offsets[upto]], offsets[at : upto + 1] - low
            at = upto
