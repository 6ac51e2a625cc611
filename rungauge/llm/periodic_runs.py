"""Periodic runs of words, found as maximal pairs of each text.

A run is a stretch of words with smallest period q and at least ``max(shortest,
2 * q)`` words that no neighbouring word extends with that period.  Two places i < j
whose words agree for exactly ``depth`` words, and whose left words differ, are a
maximal pair; with q = j - i the stretch from i has period q, depth + q words, and
can not be extended.  So the maximal pairs with ``q <= depth`` and ``depth + q >=
shortest`` are the runs; multiples of a run's period give the same stretch, of which
the smallest period stays.  Nothing is extended afterwards.

The suffixes of all texts of a piece are ordered by doubling, their common prefixes
follow from the ranks of each doubling, and the intervals of common prefixes are
walked from the deepest up.  Each interval keeps its places in order; their
left-word classes decide which pairs of different children are maximal, and distance
decides which are runs.  Occurrences of one interval within ``depth`` words to the
right of a place all have the same left word (their distances are periods of the
common words), so one look at the nearest place to the right, and one at the farthest
to the left, tells for a whole window; what is walked is reported.  The larger list
takes the smaller one in, as places are looked up in it by bisection.

Results by case: a null or empty text has no words, no runs, and an empty collapsed
text; repeated rows give the same result each; a text of one word repeated n times is
one run of period 1.  Texts are worked on in pieces of about ``PIECE`` bytes, a longer
text alone: memory follows the longest text, about 4 bytes a word and doubling of its
longest repeat.  Words are compared by 64 bits of their hashes.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from rungauge.llm.words import GOLDEN, PIECE, PLAIN, Words, mix, pieces

SHORTEST = 12
SPACE = [0x20, *range(0x09, 0x0E)]
WORD = np.ones(256, bool)
WORD[SPACE] = False
FIELDS = ("start", "length", "period")


def _suffixes(keys: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in suffix order, and at index j the rank of the 2**j words from each place.

    ``keys`` tell words apart, also equal words of different texts; ``last`` is the
    end of each place's text.  Only tied places are ordered again.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    head = np.ones(n, bool)
    head[1:] = keys[order[1:]] != keys[order[:-1]]
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = group
    levels, width = [rank.copy()], 1
    while True:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            return order, levels
        places = order[tied]
        after = places + width
        second = np.where(after < last[places], rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        key = group[tied].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order[tied], key = places[by], key[by]
        first = np.ones(len(tied), bool)
        first[1:] = key[1:] != key[:-1]
        head[tied] = first
        group[tied] = np.maximum.accumulate(np.where(first, tied, 0))
        rank[order[tied]] = group[tied]
        levels.append(rank.copy())
        width *= 2


def _common(a: np.ndarray, b: np.ndarray, last: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Number of common words from the places a and b of one text."""
    out = np.zeros(len(a), np.int64)
    top = len(last) - 1
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        same = (x < last[a]) & (y < last[b]) & (levels[j][np.minimum(x, top)] == levels[j][np.minimum(y, top)])
        out[same] += 1 << j
    return out


def _joined(more: list[int], few: list[int], depth: int, left: dict[int, int], shortest: int, found: list) -> list[int]:
    """The places of two children of an interval in one list; runs between them are added to ``found``."""
    if len(more) < len(few):
        more, few = few, more
    least, n = max(1, shortest - depth), len(more)
    for place in few:
        k = bisect_left(more, place)
        mark = left[place]
        if k < n and left[more[k]] != mark:
            for j in range(k, n):
                q = more[j] - place
                if q > depth:
                    break
                if q >= least:
                    found.append((place, depth + q, q))
        far = bisect_left(more, place - depth, 0, k)
        if far < k and left[more[far]] != mark and place - more[far] >= least:
            q = place - more[far]
            found.append((more[far], depth + q, q))
    if len(few) < 16:
        for place in few:
            insort(more, place)
    else:
        more += few
        more.sort()
    return more


def _maximal_pairs(places: list[int], common: list[int], left: dict[int, int], shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all pairs; ``common[k]``: words that places k - 1 and k share, 0 where an interval ends."""
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []
    child: list[int] = []
    for k, place in enumerate(places):
        depth = common[k]
        while stack and stack[-1][0] > depth:
            above, held = stack.pop()
            child = _joined(held, child, above, left, shortest, found)
        if depth and stack and stack[-1][0] == depth:
            stack[-1] = (depth, _joined(stack[-1][1], child, depth, left, shortest, found))
        elif depth:
            stack.append((depth, child))
        child = [place]
    while stack:
        above, held = stack.pop()
        child = _joined(held, child, above, left, shortest, found)
    return found


def runs_of(words: Words, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; starts count through all texts."""
    none = np.zeros((0, 3), np.int64)
    n = len(words.hashes)
    if n < shortest:
        return none
    owner = words.owner()
    last = words.first[1:][owner]
    order, levels = _suffixes(mix(words.hashes + mix(owner.astype(np.uint64) * GOLDEN)), last)
    least = -(-shortest // 2)  # a pair with q <= depth and depth + q >= shortest shares as many words
    step = min(least.bit_length() - 1, len(levels) - 1)
    near = np.flatnonzero(levels[step][order[1:]] == levels[step][order[:-1]])
    shared = np.zeros(n, np.int64)
    shared[near + 1] = _common(order[near], order[near + 1], last, levels)
    shared[shared < least] = 0
    inside = shared > 0
    inside[:-1] |= shared[1:] > 0
    order, shared = order[inside], shared[inside]
    if not len(order):
        return none
    # An interval whose nearest places are farther apart than its deepest common words has no run.
    part = np.cumsum(shared == 0) - 1
    by = np.lexsort((order, part))
    gap = np.diff(order[by])
    same = part[by][1:] == part[by][:-1]
    nearest = np.full(part[-1] + 1, n, np.int64)
    np.minimum.at(nearest, part[by][1:][same], gap[same])
    deepest = np.zeros(part[-1] + 1, np.int64)
    np.maximum.at(deepest, part, shared)
    keep = (nearest <= deepest)[part]
    order, shared = order[keep], shared[keep]
    before = np.where(order > words.first[:-1][owner[order]], levels[0][np.maximum(order - 1, 0)], -1)
    places = order.tolist()
    found = _maximal_pairs(places, shared.tolist(), dict(zip(places, before.tolist(), strict=True)), shortest)
    if not found:
        return none
    runs = np.array(found, np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _kept_text(words: Words, data: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Each text's words without those that a run contains after its first period, joined by one space."""
    n = len(words.starts)
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turns, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(turns[:n]) == 0)
    owner = words.owner()[kept]
    more = np.zeros(len(kept), np.int64)  # one byte for the space after every kept word but a text's last
    more[:-1] = owner[1:] == owner[:-1]
    starts, ends = words.starts[kept], words.ends[kept] + more
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    out = data.copy()
    out[words.ends[kept][more > 0]] = 0x20
    out = out[np.cumsum(inside[:-1]) > 0]
    sizes = np.bincount(owner, weights=ends - starts, minlength=len(words.first) - 1).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def without_runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period by start and period; words count from 0) and ``collapsed``.

    ``collapsed`` is the text's words joined by one space, without the words that a
    run contains after its first period.  Both are never null.  Columns of these two
    names are replaced, all others stay as they are.
    """
    docs = docs.drop("runs", "collapsed")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, PIECE, text):
            words = Words(data, offsets, WORD, PLAIN)
            runs = runs_of(words, shortest)
            owner = np.searchsorted(words.first, runs[:, 0], side="right") - 1
            upto = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            columns = [runs[:, 0] - words.first[owner], runs[:, 1], runs[:, 2]]
            spans = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(FIELDS))
            lists = pa.ListArray.from_arrays(pa.array(upto), spans)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, _kept_text(words, data, runs)], names=[*batch.schema.names, "runs", "collapsed"])

    run = StructType([StructField(name, LongType()) for name in FIELDS])
    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField("runs", ArrayType(run)), StructField("collapsed", StringType())]))
