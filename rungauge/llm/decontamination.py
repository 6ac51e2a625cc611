"""Benchmark decontamination with a distributed positional inverted index.

Documents are cut into segments of bounded bytes.  The index is a table with a
row per (segment, term): the term's positions among the segment's words, with a
gap between documents, so that no phrase can cross from one into the next.  Rows
without a term hold the documents: key, first position, number of words.

A phrase is searched from its rarest term (by postings in the whole corpus): that
term's list, moved by the term's place in the phrase, gives the candidate starts,
and the lists of the next rarest terms are intersected with them one by one.  With
``slop`` a term may stand that many words before or after its place (proximity).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungauge.llm.words import Words, pieces
from rungauge.shared import cut_lineage

INDEX = "segment long, term long, positions array<int>, key long, first int, n_words int"
HITS = "segment long, key long, first int, n_words long, runs array<struct<start: int, end: int>>, items array<long>"
NO_ID = np.iinfo(np.int64).min  # stands for the null id of an item inside the arrays
SEGMENT = 2 << 20  # bytes of text in a segment; a longer document is one of its own
BLOCK_WINDOWS = 200_000  # windows searched at once: 16 MB of terms sent to the tasks
CANDIDATES = 1 << 17  # candidate starts held at once in a task


class Phrases:
    """Windows of test items: ``terms`` (their ranks in ``vocabulary``), -1 beyond a short window's ``lengths``."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        rows, owners, lengths = [], [], []
        for item, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            hashes = Words(data, np.array([0, len(data)])).hashes
            if not len(hashes):
                continue
            n = min(width, len(hashes))
            windows = np.lib.stride_tricks.sliding_window_view(hashes, n)
            rows.append(np.pad(windows, ((0, 0), (0, width - n))))
            owners.append(np.full(len(windows), NO_ID if item is None else item, np.int64))
            lengths.append(np.full(len(windows), n, np.int32))
        self.hashes = np.concatenate(rows) if rows else np.zeros((0, width), np.uint64)
        self.owners = np.concatenate(owners) if rows else np.zeros(0, np.int64)
        self.lengths = np.concatenate(lengths) if rows else np.zeros(0, np.int32)
        self.beyond = np.arange(width) >= self.lengths[:, None]
        self.vocabulary = np.unique(self.hashes[~self.beyond])
        self.terms = np.searchsorted(self.vocabulary, self.hashes).astype(np.int32)
        self.terms[self.beyond] = -1
        self.order = np.zeros_like(self.terms)
        del self.hashes

    def rank(self, postings: dict[int, int]) -> None:
        """Puts the places of each window in the order of their terms' number of postings."""
        n = np.array([postings.get(int(t), 0) for t in self.vocabulary.view(np.int64)], np.int64)
        weight = np.where(self.beyond, np.iinfo(np.int64).max, n[self.terms] if len(n) else 0)
        self.order = np.argsort(weight, axis=1, kind="stable").astype(np.int32)


def build_index(docs: DataFrame, key: str, vocabulary: np.ndarray | None = None, text: str = "text", gap: int = 1) -> DataFrame:
    """Postings of the whole texts, written once; only of the terms in ``vocabulary`` (sorted) when one is given.

    ``gap``: positions between two documents, more than twice the slop of a search.
    """

    def index(batches) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for rows, data, offsets in pieces(batches, SEGMENT):
            words = Words(data, offsets)
            at = (np.arange(len(words.hashes)) + gap * words.owner()).astype(np.int32)
            terms = words.hashes
            if vocabulary is not None:
                known = np.searchsorted(vocabulary, terms)
                wanted = np.zeros(len(terms), bool) if not len(vocabulary) else vocabulary[np.minimum(known, len(vocabulary) - 1)] == terms
                at, terms = at[wanted], terms[wanted]
            by = np.argsort(terms, kind="stable")
            terms, at = terms[by], at[by]
            begins = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(terms)), pa.int32()), pa.array(at, pa.int32()))
            n, d = len(begins), rows.num_rows
            nothing = pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, segment)), pa.array(terms[begins].view(np.int64)), lists, pa.nulls(n, pa.int64()), nothing, nothing],
                names=["segment", "term", "positions", "key", "first", "n_words"],
            )
            first = (words.first[:-1] + gap * np.arange(d)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, segment)), pa.nulls(d, pa.int64()), pa.nulls(d, pa.list_(pa.int32())), rows.column(0), pa.array(first), pa.array(words.counts().astype(np.int32))],
                names=["segment", "term", "positions", "key", "first", "n_words"],
            )
            segment += 1

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return cut_lineage(rows.mapInArrow(index, INDEX), "postings")


def matches(phrases: Phrases, lists: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and starts at which they occur; ``lists``: sorted numbers term << 32 | position."""
    bounds = np.searchsorted(lists, np.arange(len(phrases.vocabulary) + 1, dtype=np.int64) << 32)
    if not len(phrases.terms):
        return
    every = np.arange(len(phrases.terms))
    lead = phrases.order[:, 0]
    rarest = phrases.terms[every, lead]
    n = (bounds[1:] - bounds[:-1])[rarest]
    windows = np.flatnonzero(n)
    upto = np.cumsum(n[windows])
    at = 0
    while at < len(windows):
        base = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, base + CANDIDATES, side="right")))
        some = windows[at:stop]
        at = stop
        own = np.repeat(some, n[some])
        inside = np.arange(len(own)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
        start = (lists[bounds[rarest[own]] + inside] & 0xFFFFFFFF) - lead[own]
        if slop:  # the first term may itself stand off its place
            own, start = np.repeat(own, 2 * slop + 1), (start[:, None] + np.arange(-slop, slop + 1)).ravel()
        keep = start >= -slop
        own, start = own[keep], start[keep]
        for j in range(1, phrases.terms.shape[1]):
            place = phrases.order[own, j]
            term = phrases.terms[own, place].astype(np.int64)
            ended = j >= phrases.lengths[own]
            wanted = np.where(ended, 0, term) * (1 << 32) + start + place
            low = np.searchsorted(lists, wanted - slop)
            keep = ended | ((low < len(lists)) & (lists[np.minimum(low, len(lists) - 1)] <= wanted + slop))
            own, start = own[keep], start[keep]
            if not len(own):
                break
        if len(own):
            yield own, start


def _search(index: DataFrame, phrases: Phrases, slop: int) -> DataFrame:
    def evaluate(segment: pa.Table) -> pa.Table:
        term = segment.column("term").combine_chunks()
        is_doc = term.is_null().to_numpy(zero_copy_only=False)
        docs = segment.filter(pa.array(is_doc)).sort_by("first")
        lists = segment.filter(pa.array(~is_doc))
        hashes = lists.column("term").to_numpy().view(np.uint64)
        rank = np.searchsorted(phrases.vocabulary, hashes)
        known = np.zeros(len(hashes), bool) if not len(phrases.vocabulary) else phrases.vocabulary[np.minimum(rank, len(phrases.vocabulary) - 1)] == hashes
        positions = lists.column("positions").combine_chunks()
        flat = positions.flatten().to_numpy().astype(np.int64)
        sizes = np.diff(positions.offsets.to_numpy())
        postings = np.sort((np.repeat(rank, sizes).astype(np.int64) << 32 | flat)[np.repeat(known, sizes)])
        first = docs.column("first").to_numpy().astype(np.int64)
        n_words = docs.column("n_words").to_numpy().astype(np.int64)
        change = np.zeros(int(first[-1] + n_words[-1]) + 2, np.int32)
        pairs = [np.zeros((0, 2), np.int64)]
        for own, start in matches(phrases, postings, slop):
            # A window that the slop lets hang over its document's ends hits the words inside.
            doc = np.searchsorted(first - slop, start, side="right") - 1
            end = np.minimum(start + phrases.lengths[own], first[doc] + n_words[doc])
            np.add.at(change, np.minimum(np.maximum(start, first[doc]), end), 1)
            np.add.at(change, end, -1)
            pairs.append(np.unique(np.stack([doc, phrases.owners[own]], 1), axis=0))
        hit = np.flatnonzero(np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        run_of = np.searchsorted(first, hit[:, 0], side="right") - 1
        # A run may reach over a gap only where two documents' runs touch, and they can't: a gap is never hit.
        runs = pa.StructArray.from_arrays([pa.array(hit[:, 0], pa.int32()), pa.array(hit[:, 1], pa.int32())], ["start", "end"])
        found = np.unique(np.concatenate(pairs), axis=0)
        edges = np.arange(docs.num_rows + 1)
        return pa.Table.from_arrays(
            [
                docs.column("segment"),
                docs.column("key"),
                docs.column("first"),
                pa.array(n_words),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(run_of, edges), pa.int32()), runs),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(found[:, 0], edges), pa.int32()), pa.array(found[:, 1], pa.int64(), mask=found[:, 1] == NO_ID)),
            ],
            names=["segment", "key", "first", "n_words", "runs", "items"],
        )

    return index.groupBy("segment").applyInArrow(evaluate, HITS)


def covered(runs: Column) -> Column:
    """Words in a union of runs."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))
    total = F.aggregate(
        F.array_sort(runs),
        start,
        lambda a, r: F.struct((a.total + F.greatest(F.lit(0), r.end - F.greatest(r.start, a.upto))).alias("total"), F.greatest(a.upto, r.end).alias("upto")),
    )
    return total.total.cast("long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", width: int = 10, slop: int = 0) -> DataFrame:
    """``key``, ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``contaminated`` of each document.

    A window is ``width`` consecutive words of a benchmark item; an item with
    fewer words is one window, an item without words is none; items without id
    are one item with a null id.  A document word inside an occurrence is hit.  A null or empty text has no words
    and is clean; repeated rows are judged each for itself; empty tables give no
    hits or no rows.

    The benchmark is read in blocks of ``BLOCK_WINDOWS`` windows, which is what
    the tasks are sent at once; each block searches the same index.
    """
    blocks = _blocks(benchmark, width)
    vocabulary = np.unique(np.concatenate([b.vocabulary for b in blocks]))
    index = build_index(docs, key, vocabulary, gap=2 * slop + 1)
    counts = index.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum(F.size("positions")).alias("n"))
    postings = {r.term: r.n for r in counts.collect()}  # terms of the benchmark: bounded by its size
    found = None
    for block in blocks:
        block.rank(postings)
        part = _search(index, block, slop)
        found = part if found is None else found.unionByName(part)
    if len(blocks) > 1:
        found = found.groupBy("segment", "key", "first", "n_words").agg(
            F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        )
    return found.select(
        F.col("key").alias(key), "n_words", covered(F.col("runs")).alias("n_hit"), F.array_sort("items").alias("items"), (F.size("runs") > 0).alias("contaminated")
    )


def _blocks(benchmark: DataFrame, width: int) -> list[Phrases]:
    """The benchmark's windows, a block of items at a time."""
    blocks, items, words = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        items.append((row.item_id, row.text))
        words += len(row.text or "") // 2 + 1
        if words >= BLOCK_WINDOWS:
            blocks.append(Phrases(items, width))
            items, words = [], 0
    return [*blocks, Phrases(items, width)] if items or not blocks else blocks
