"""Cross-entropy difference of two word bigram models that share one vocabulary.

The target model counts texts labelled as wanted, the background model all others,
labelled or not; only labelled rows that are held out for testing are in neither.
Both have the same vocabulary (every token of the corpus), order and smoothing, and
the larger one's counts are scaled to the other's total, so that neither is sharper
for having seen more.  A document's score is the mean difference of its tokens'
losses: lower is more like the target.

A token is a run of bytes above the space, case kept.  The most frequent tokens and
classes by shape for all others are V symbols; their V^2 pairs are sent to the tasks.
They settle pairs of two frequent tokens, and are what the counts of all other pairs,
which stay in Spark and grow with the corpus, are smoothed with:

- a rare token w after a frequent u: P(class of w | u) P(w | class, u)
- any token w after a rare u: from count(u, w), pulled to P(symbol of w | class of u) P(w | class)

Each place of a rare token is one row with its two neighbours.  Rows of a token meet in
one shuffle, which gives its count, its pairs with what stands before it, and with the
frequent tokens after it; the losses are summed by document.  A rare token stands at
most in one of V - SHAPES places, so no key has many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rungauge.llm.folds import held_out
from rungauge.llm.words import PLAIN, TOKEN, Words, mix, pieces
from rungauge.shared import cut_lineage, sent_if_small

VOCABULARY = 1024  # symbols: frequent tokens, classes and the begin of a text
SHAPES = 32
PULL = 5.0  # weight of the unigram estimate in a pair's

_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_SIGN = np.zeros(256, np.int32)
_SIGN[[*range(33, 44), 45, *range(47, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


def shapes(data: np.ndarray, words: Words) -> np.ndarray:
    """A class of each token by length, capitals, digits and signs."""

    def inside(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(table[data], dtype=np.int32)])
        return total[words.ends] - total[words.starts]

    length = np.minimum((words.ends - words.starts) // 4, 3)
    return length + 4 * (inside(_UPPER) > 1) + 8 * (inside(_DIGIT) > 0) + 16 * (inside(_SIGN) > 0)


def symbols(data: np.ndarray, words: Words, vocabulary: np.ndarray) -> np.ndarray:
    """Each token's number: its shape, or SHAPES plus its rank in the sorted vocabulary."""
    out = shapes(data, words)
    if len(vocabulary):
        rank = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
        known = vocabulary[rank] == words.hashes
        out[known] = SHAPES + rank[known]
    return out


def training(docs: DataFrame, wanted: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text`` and ``role`` of all rows: 1 target, 0 background, 2 held out.

    ``wanted``: doc_id of the target texts; ``labelled``: of all rows with a label
    (else those of ``wanted``).  Only labelled rows are held out; all others count.
    """
    ids = wanted.select(F.col("doc_id").alias("of"), F.lit(1).alias("good"))
    if labelled is not None:
        ids = ids.unionByName(labelled.select(F.col("doc_id").alias("of"), F.lit(0).alias("good")))
    ids = ids.filter("of is not null").groupBy("of").agg(F.max("good").alias("good"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    role = F.when(F.col("of").isNotNull() & held_out(F.col("key")), 2).otherwise(F.coalesce("good", F.lit(0)))
    return rows.join(sent_if_small(ids), F.col("key") == F.col("of"), "left").select("key", "text", role.cast("int").alias("role"))


def _frequent(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent tokens (sorted hashes), and how many others each shape has."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches):
            words = Words(data, offsets, TOKEN, PLAIN)
            values, first, place = np.unique(words.hashes, return_index=True, return_inverse=True)
            n = np.bincount(place[batch.column(2).to_numpy()[words.owner()] < 2], minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(shapes(data, words)[first].astype(np.int32)), pa.array(n)], names=["code", "shape", "n"])

    def best(batches) -> Iterator[pa.RecordBatch]:
        """A part's ``most`` first tokens, and rows without a token with the number of its tokens by shape."""
        types, top = np.zeros(SHAPES, np.int64), [np.zeros((0, 3), np.int64)]
        for batch in batches:
            part = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            types += np.bincount(part[:, 1], minlength=SHAPES)
            top = np.concatenate([*top, part])
            top = [top[np.lexsort((top[:, 0], -top[:, 2]))[:most]]]
        code, shape, n = top[0].T
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(shape.astype(np.int32)), pa.array(n)], names=["code", "shape", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(SHAPES, pa.int64()), pa.array(np.arange(SHAPES, dtype=np.int32)), pa.array(types)], names=["code", "shape", "n"])

    names = "code long, shape int, n long"
    every = rows.mapInArrow(count, names).groupBy("code").agg(F.first("shape").alias("shape"), F.sum("n").alias("n"))
    parts = cut_lineage(every.mapInArrow(best, names), "tokens")
    known = parts.filter("code is not null").orderBy(F.col("n").desc(), "code").limit(most).select("code", "shape").collect()
    types = -np.bincount([r["shape"] for r in known], minlength=SHAPES).astype(np.float64)
    for r in parts.filter("code is null").groupBy("shape").agg(F.sum("n").alias("n")).collect():
        types[r["shape"]] += r["n"]
    return np.sort(np.array([r["code"] for r in known], np.int64).view(np.uint64)), types


def _counted(rows: DataFrame, vocabulary: np.ndarray, size: int) -> DataFrame:
    """``code``, ``wanted`` and ``other``: how often each pair of symbols stands in target and background rows."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches):
            words = Words(data, offsets, TOKEN, PLAIN)
            role = batch.column(2).to_numpy()[words.owner()]
            values, place = np.unique(pairs(data, words, vocabulary, size), return_inverse=True)
            wanted, other = (np.bincount(place[role == r], minlength=len(values)).astype(np.int64) for r in (1, 0))
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(wanted), pa.array(other)], names=["code", "wanted", "other"])

    counted = rows.mapInArrow(count, "code long, wanted long, other long")
    return counted.groupBy("code").agg(F.sum("wanted").alias("wanted"), F.sum("other").alias("other"))


def pairs(data: np.ndarray, words: Words, vocabulary: np.ndarray, size: int) -> np.ndarray:
    """previous * size + own symbol; the number ``size - 1`` stands before a text's first token."""
    own = symbols(data, words, vocabulary)
    before = np.concatenate([[size - 1], own[:-1]]) if len(own) else own
    before[words.first[:-1][words.counts() > 0]] = size - 1
    return before.astype(np.int64) * size + own


def losses(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Negative log probability of every pair, interpolated with the unigram estimate."""
    table = np.zeros(size * size)
    table[codes] = counts
    table = table.reshape(size, size)
    single = table.sum(0) + 0.5
    single /= single.sum()
    return -np.log((table + PULL * single) / (table.sum(1, keepdims=True) + PULL)).astype(np.float32).ravel()


class Side:
    """One model's V^2 pairs: ``loss``, ``known`` (what of a token's loss they settle) and the counts of classes."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, scale: float, types: np.ndarray, size: int):
        self.scale = scale
        self.loss = losses(codes, counts * scale, size)
        table = np.zeros(size * size)
        table[codes] = counts * scale
        before, own = np.divmod(np.arange(size * size), size)
        self.known = np.where(before < SHAPES, 0, self.loss + np.where(own < SHAPES, np.log(table + PULL), 0)).astype(np.float32)
        self.classes = table.reshape(size, size).sum(0)[:SHAPES] + 0.5 * types

    def rest(self, code, after, n, n_led, n_pair, n_next, size: int) -> np.ndarray:
        """The loss that places of rare tokens add: their own, and that of a frequent token after them."""
        before, own = np.divmod(code, size)
        pull = PULL * (n * self.scale + 0.5) / self.classes[own] * np.where(before < SHAPES, np.exp(-self.loss[code].astype(np.float64)), 1)
        ahead = np.exp(-self.loss[own * size + np.maximum(after, 0)].astype(np.float64))
        out = -np.log(n_pair * self.scale + pull)
        out += np.where(after >= 0, np.log(n_led * self.scale + PULL), 0)
        return out - np.where(after >= SHAPES, np.log(n_next * self.scale + PULL * ahead), 0)


def models(rows: DataFrame, size: int = VOCABULARY) -> tuple[np.ndarray, Side, Side]:
    """The frequent tokens (sorted hashes) and the sides of target and background."""

    vocabulary, types = _frequent(rows, size - SHAPES - 1)
    seen = _counted(rows, vocabulary, size).toPandas()  # at most size^2 rows
    codes = seen["code"].to_numpy(np.int64)
    wanted, other = seen["wanted"].to_numpy(np.float64), seen["other"].to_numpy(np.float64)
    least = min(wanted.sum(), other.sum())
    sides = [Side(codes, n, least / n.sum() if least else 1.0, types, size) for n in (wanted, other)]
    return vocabulary, *sides


PLACES = "row long, token long, before long, after int, document binary"
DOCUMENT = np.dtype([("has_key", np.int64), ("key", np.int64), ("n_tokens", np.int64), ("a", np.float64), ("b", np.float64)])
COUNTS = ("n", "led", "pair", "next")  # of a place's token, of those with a token after, and of its two pairs


def scored(
    docs: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text", size: int = VOCABULARY, labelled: DataFrame | None = None
) -> DataFrame:
    """``key``, ``n_tokens``, ``target_loss``, ``background_loss`` (nats per token) and ``difference`` of each document.

    A null or empty text has no tokens and null losses; repeated rows are scored
    each for itself; with no target rows, or no others, that model is uniform
    over its symbols; an empty table gives no rows.  Whole texts are read.
    Held-out rows of ``labelled`` (else of ``wanted``) are in neither model.
    """
    rows = training(docs, wanted, labelled, key, text)
    vocabulary, *sides = models(rows, size)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, sides))

    def places(batches) -> Iterator[pa.RecordBatch]:
        """A row for each document with the losses known here, and one for each place of a rare token.

        ``token``: 56 bits of its hash, and its shape; ``before``: 48 bits of a rare
        token's hash, and the symbol; ``after``: the next symbol plus one, and the role.
        """
        vocabulary, sides = sent.value
        names = [c.split()[0] for c in PLACES.split(", ")]
        at = TaskContext.get().partitionId() << 36
        for batch, data, offsets in pieces(batches):
            words = Words(data, offsets, TOKEN, PLAIN)
            codes = pairs(data, words, vocabulary, size)
            number = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            documents = np.zeros(batch.num_rows, DOCUMENT)
            documents["has_key"] = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            documents["key"] = batch.column(0).fill_null(0).to_numpy()
            documents["n_tokens"] = words.counts()
            for name, side in zip("ab", sides):
                documents[name] = np.diff(np.concatenate([[0.0], np.cumsum(side.known[codes], dtype=np.float64)])[words.first])
            n, nothing = batch.num_rows, pa.nulls(batch.num_rows, pa.int64())
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DOCUMENT.itemsize), n, [None, pa.py_buffer(documents.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(mix(number.astype(np.uint64)).view(np.int64)), nothing, pa.nulls(n, pa.int32()), packed], names=names)
            before, own = np.divmod(codes, size)
            token = (words.hashes >> np.uint64(8) << np.uint64(8)).view(np.int64) | np.minimum(own, SHAPES)
            left = np.where(before < SHAPES, np.roll(words.hashes >> np.uint64(16) << np.uint64(16), 1).view(np.int64), 0) | before
            after = np.roll(own, -1)
            after[words.first[1:][words.counts() > 0] - 1] = -1
            owner = words.owner()
            after = (after + 1) * 4 + batch.column(2).to_numpy()[owner]
            rare = np.flatnonzero(own < SHAPES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[owner[rare]]), pa.array(token[rare]), pa.array(left[rare]), pa.array(after[rare].astype(np.int32)), pa.nulls(len(rare), pa.binary())], names=names
            )

    def add(batches) -> Iterator[pa.RecordBatch]:
        _, sides = sent.value
        names = ["row", "key", "n_tokens", "a", "b"]
        for batch in batches:
            is_place = batch.column("document").is_null()
            part, whole = batch.filter(is_place), batch.filter(pc.invert(is_place))
            code = (part.column("before").to_numpy() & 0xFFFF) * size + (part.column("token").to_numpy() & 0xFF)
            after = (part.column("after").to_numpy().astype(np.int64) >> 2) - 1
            counts = [part.column(c).to_numpy() for c in COUNTS]  # target's above 32 bits of background's
            counts = [[c >> 32 for c in counts], [c & 0xFFFFFFFF for c in counts]]
            rest = [pa.array(s.rest(code, after, *c, size)) for s, c in zip(sides, counts)]
            nothing = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("row"), nothing, nothing, *rest], names=names)
            documents = np.frombuffer(b"".join(whole.column("document").to_pylist()), DOCUMENT)
            fields = [pa.array(documents[c].copy()) for c in ("n_tokens", "a", "b")]
            yield pa.RecordBatch.from_arrays([whole.column("row"), pa.array(documents["key"].copy(), mask=documents["has_key"] == 0), *fields], names=names)

    # One shuffle by token, before any column is added; the order serves two of the three windows.
    found = rows.mapInArrow(places, PLACES).repartition("token").sortWithinPartitions("token", "before")
    role = F.col("after").bitwiseAND(3)
    one = F.when(role == 1, F.lit(1 << 32)).when(role == 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    token, pair = Window.partitionBy("token"), Window.partitionBy("token", "before")
    found = found.withColumns({"n": F.sum(one).over(token), "led": F.sum(F.when(F.col("after") > 3, one).otherwise(0)).over(token)})
    found = found.withColumn("pair", F.sum(one).over(pair)).withColumn("next", F.sum(one).over(Window.partitionBy("token", F.shiftright("after", 2))))
    parts = found.select("row", "token", "before", "after", "document", *COUNTS).mapInArrow(add, "row long, key long, n_tokens long, a double, b double")
    own = parts.groupBy("row").agg(F.max("key").alias("key"), F.sum("n_tokens").alias("n_tokens"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    mean = lambda total: F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    out = own.select("key", "n_tokens", mean(F.col("a")).alias("target_loss"), mean(F.col("b")).alias("background_loss"))
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss")).withColumnRenamed("key", key)
