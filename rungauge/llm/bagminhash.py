"""Near-duplicates by weighted MinHash (BagMinHash), banding and verified multiset overlap.

A document is the multiset of its five-word shingles.  Weights are cut at the
integers; every shingle owns a Poisson process for each dyadic interval of weight
(0,1], (1,2], (2,4], (4,8] ..., whose rate is the interval's length.  A point has
a time, one of the signature's components and a level in the interval; it counts
for a document whose weight reaches the level.  A component's value is the time of
its first point, so two documents agree in it with the probability of their
weighted Jaccard similarity, and a shingle with weight w costs log w processes.
Processes run in rounds until the next point can't lower any component.

Equal multisets are one node.  Nodes that agree in a band of components share a
bucket; buckets that share a node form a cluster.  A cluster of bounded size is
resolved in one task, a larger one bucket by bucket, and a bucket that is itself
too large by pairs of blocks.  A task counts the shingles that one node, its hub,
shares with all others, links those that overlap enough, and goes on with the next
hub outside the largest class, until no two classes have uncompared members.  It
emits the links that merge classes, fewer than it has members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungauge.llm.components import components
from rungauge.llm.words import GOLDEN, Words, combined, mix, pieces
from rungauge.shared import cut_lineage, sent_if_small

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
LOAD, MEMBERS = 2_000_000, 4096  # shingles and nodes that one task resolves
POSTINGS = 1 << 20  # counted at once
BITS = np.uint64(48)  # of a shingle's hash; the piece's document number stands above them


class Bags:
    """Shingle multisets of a piece's documents: ``values`` with ``weights``, document i from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE):
        words = Words(data, offsets)
        owner, n = words.owner(), words.counts()
        whole = combined(words.hashes, width)
        keep = np.flatnonzero(owner[: len(whole)] == owner[width - 1 :]) if len(whole) else np.zeros(0, np.int64)
        hashes, owners = [whole[keep]], [owner[keep]]
        for short in range(1, width):  # a text of fewer words is one shingle
            docs = np.flatnonzero(n == short)
            if len(docs):
                hashes.append(combined(words.hashes, short)[words.first[docs]])
                owners.append(docs)
        keys = np.concatenate(owners).astype(np.uint64) << BITS | np.concatenate(hashes) >> (np.uint64(64) - BITS)
        keys.sort()
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.weights = np.diff(np.append(begins, len(keys)))
        self.owner = (keys[begins] >> BITS).astype(np.int64)
        self.values = keys[begins] & np.uint64((1 << 48) - 1)
        self.first = np.searchsorted(self.owner, np.arange(len(offsets)))
        self.sizes = np.bincount(self.owner, self.weights, len(offsets) - 1).astype(np.int64)

    def nodes(self) -> np.ndarray:
        """64 bits that equal multisets share."""
        own = mix(mix(self.values + GOLDEN) + self.weights.astype(np.uint64) * GOLDEN)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
        return mix(total[self.first[1:]] - total[self.first[:-1]] + self.sizes.astype(np.uint64))

    def signatures(self, m: int = BANDS * ROWS) -> np.ndarray:
        """One row of ``m`` times per document; infinite for a document without shingles."""
        docs = len(self.first) - 1
        best = np.full(docs * m, np.inf)
        owner, seed, weight = self.owner, mix(self.values * GOLDEN + np.uint64(1)), self.weights
        streams = [(owner, seed, np.ones(len(owner)), np.zeros(len(owner), np.int64), weight)]
        low = 1
        while (heavy := weight > low).any():  # the next dyadic interval (low, 2 low] of those that reach into it
            owner, seed, weight = owner[heavy], seed[heavy], weight[heavy]
            seeds = mix(seed ^ np.uint64(low))  # of its own: a stream's later draws must not be another's first
            streams.append((owner, seeds, np.full(len(owner), float(low)), np.full(len(owner), low), weight))
            low *= 2
        owner, seed, rate, base, weight = (np.concatenate(x) for x in zip(*streams))
        time = np.zeros(len(owner))
        while len(owner):
            seed = mix(seed + GOLDEN)
            time = time - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            draw = mix(seed ^ GOLDEN)
            level = base + 1 + ((draw >> np.uint64(32)).astype(np.float64) * 2.0**-32 * np.maximum(base, 1)).astype(np.int64)
            counts = level <= weight
            np.minimum.at(best, owner[counts] * m + (draw[counts] % np.uint64(m)).astype(np.int64), time[counts])
            alive = time < best.reshape(docs, m).max(axis=1)[owner]
            owner, seed, rate, base, weight, time = owner[alive], seed[alive], rate[alive], base[alive], weight[alive], time[alive]
        return best.reshape(docs, m)


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of a signature, different from band to band."""
    parts = signatures.view(np.uint64).reshape(len(signatures), -1, rows)
    out = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * GOLDEN
    for j in range(rows):
        out = mix(out + parts[:, :, j])
    return out


def _signed(docs: DataFrame) -> DataFrame:
    def sign(batches) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            bags = Bags(data, offsets)
            node = bags.nodes()
            for i in np.flatnonzero(bags.sizes == 0):  # no words: equal bytes are equal texts
                node[i] = int.from_bytes(hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest(), "little")
            signature = bands(bags.signatures())
            full = np.where(bags.sizes > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(full)), pa.int32()), pa.array(signature[bags.sizes > 0].ravel().view(np.int64)))
            null = rows.column(1).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(node.view(np.int64), mask=null), pa.array(bags.sizes), lists], names=["key", "node", "size", "bands"]
            )

    return docs.mapInArrow(sign, "key long, node long, size long, bands array<long>")


def _multisets(docs: DataFrame) -> DataFrame:
    """``node`` and its shingles in order, six bytes each, repeated by weight."""

    def read(batches) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in pieces(batches):
            bags = Bags(data, offsets)
            packed = np.repeat(bags.values, bags.weights).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            ends = np.append(0, np.cumsum(bags.sizes)) * 6
            rows = [packed[a:b] for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bags.nodes().view(np.int64)), pa.array(rows, pa.binary())], names=["node", "shingles"])

    return docs.mapInArrow(read, "node long, shingles binary")


def _unpacked(shingles: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(shingles.as_buffer(), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (0, 2))).view(np.uint64).ravel()


class Overlaps:
    """Overlaps of some multisets, counted by postings of the shingles that several of them hold."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        values = np.concatenate(sets)
        fresh = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])
        begins = np.flatnonzero(fresh)
        nth = np.arange(len(values)) - np.repeat(begins, np.diff(np.append(begins, len(values))))
        # The second occurrence of a shingle in a set is an element of its own, and so on.
        _, codes, held = np.unique(mix(values + nth.astype(np.uint64) * GOLDEN), return_inverse=True, return_counts=True)
        shared = held[codes] > 1
        self.codes, owner = codes[shared], owner[shared]
        self.first = np.searchsorted(owner, np.arange(len(sets) + 1))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=len(held)))])
        self.postings = owner[np.argsort(self.codes, kind="stable")]

    def similarities(self, hub: int) -> np.ndarray:
        """Weighted Jaccard similarity of one set to all."""
        codes = self.codes[self.first[hub] : self.first[hub + 1]]
        common = np.zeros(len(self.sizes), np.int64)
        lengths = self.starts[codes + 1] - self.starts[codes]
        upto, at = np.cumsum(lengths), 0
        while at < len(codes):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + POSTINGS, side="right")))
            n = lengths[at:stop]
            places = np.repeat(self.starts[codes[at:stop]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common += np.bincount(self.postings[places], minlength=len(common))
            at = stop
        return common / (self.sizes + self.sizes[hub] - common)


def resolved(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that join the sets into the classes of their similarity graph."""
    overlaps = Overlaps(sets)
    label = np.arange(len(sets))
    waiting = np.ones(len(sets), bool)
    links = []
    while True:
        open_labels = np.bincount(label[waiting], minlength=len(sets))
        if (open_labels > 0).sum() < 2:
            return links
        hub = int(np.flatnonzero(waiting & (label != open_labels.argmax()))[0])
        waiting[hub] = False
        near = np.flatnonzero((overlaps.similarities(hub) >= threshold) & (label != label[hub]))
        _, one = np.unique(label[near], return_index=True)
        links += [(hub, int(i)) for i in near[one]]
        label[np.isin(label, label[near])] = label[hub]


def _linked(rows: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Links a, b inside each group of rows (node, shingles)."""

    def link(group: pa.Table) -> pa.Table:
        nodes, place = np.unique(group.column("node").to_numpy(), return_index=True)
        shingles = group.column("shingles").combine_chunks()
        links = resolved([_unpacked(shingles[i]) for i in place], threshold) if len(nodes) > 1 else []
        return pa.table({"a": pa.array([nodes[i] for i, _ in links], pa.int64()), "b": pa.array([nodes[j] for _, j in links], pa.int64())})

    return rows.groupBy(*by).applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``class_id`` (the least key of the class) and ``n_shingles`` of each document.

    Classes are the connected components of verified links.  Texts with the same
    shingles are one class at once; a text of fewer words than a shingle is one
    shingle; texts without words are one class when their bytes are equal; a null
    text is a class of its own.  Repeated rows come back as often as they came;
    ``key`` must be an integer, a null key gives a null class only where no other
    key is in it.  An empty table gives no rows.

    Recall: two documents at the threshold share none of the 16 bands of four
    components with probability (1 - 0.8^4)^16 = 0.0002.  A cluster of at most ``LOAD``
    shingles and ``MEMBERS`` nodes is compared whole, so such a pair is still linked
    there when others join it to one cluster; a larger cluster misses it at that rate.
    """
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    signed = cut_lineage(_signed(source), "signatures")
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    spread = cut_lineage(nodes.select("node", "key", "size", F.explode("bands").alias("bucket")), "bands")
    buckets = spread.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter(F.col("n") > 1)
    members = cut_lineage(spread.join(buckets, "bucket").select("bucket", "least", "node", "key", "size"), "buckets")
    clusters = components(members.select(F.col("node").alias("a"), F.col("least").alias("b")))
    keys = members.select(F.col("key").alias("wanted_key")).distinct()
    keys = sent_if_small(cut_lineage(keys, "wanted"))
    texts = source.join(keys, F.col("key").eqNullSafe(F.col("wanted_key")), "left_semi").select("text")
    sets = cut_lineage(_multisets(texts).dropDuplicates(["node"]).join(clusters, "node").withColumn("size", F.length("shingles") / 6), "multisets")

    loads = cut_lineage(sets.groupBy("label").agg(F.sum("size").alias("load"), F.count("*").alias("n")), "loads")
    small = (F.col("load") <= LOAD) & (F.col("n") <= MEMBERS)
    links = _linked(sets.join(loads.filter(small).select("label"), "label", "left_semi").select("label", "node", "shingles"), ["label"], threshold)
    if not loads.filter(~small).isEmpty():
        large = sets.join(loads.filter(~small).select("label"), "label", "left_semi").select("node", "size", "shingles")
        rows = members.select("bucket", "node").join(large, "node")
        loads = rows.groupBy("bucket").agg(F.sum("size").alias("load"), F.count("*").alias("n"))
        blocks = F.ceil(F.greatest(F.col("load") / LOAD, F.col("n") / MEMBERS) * 2).cast("int")
        rows = rows.join(loads.select("bucket", F.when(small, 1).otherwise(blocks).alias("blocks")), "bucket")
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles")
        links = links.unionByName(_linked(rows, ["bucket", "i", "j"], threshold))
    labels = components(links)
    own = signed.select("key", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = own.filter(F.col("node").isNotNull()).groupBy(F.col("label").alias("of")).agg(F.min("key").alias("least"))
    return own.join(least, F.col("label") == F.col("of"), "left").select(
        F.col("key").alias(key), F.coalesce("least", "key").alias("class_id"), F.col("size").alias("n_shingles")
    )
