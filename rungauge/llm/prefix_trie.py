"""Prefix trie of conversations, its subtree totals by time-forward processing.

Every distinct sequence of first turns is a node.  A node is named by its smallest
member and its depth, found by grouping turns by a hash of all turns up to them: two
64-bit sums of hashes of (place, role, text), running along the conversation, so that
no list of turns is ever built.

Nodes of one path with the same members form a stretch; only its last node can have
several children.  Subtree totals are passed over stretches.  Stretches are put into
shards of at most ``members`` conversations: below a stretch of more members, each
child that has at most so many is a shard root with all below it; larger ones
make shards of the next level, with ``members`` times as many, and so on.  In a task the
stretches of its shards are sorted (by Spark, which spills) in reverse level order;
each takes the totals that its children sent out of a priority queue and sends its own
to its parent.  The queue writes sorted runs to an unnamed file beyond
``QUEUE`` entries.  What shard roots send is summed per receiver before the shuffle and
taken in by the shards of the next level, so each level is run once, and there are
as many as powers of ``members`` in the number of conversations.  Inside a stretch a
node's total is the stretch's, less the running sum of what stands above it.

Results by case: null role or text count as empty; turns that agree in the order
columns are ordered by the digest of role and text, repeated turns stay; a conversation without
turns belongs to the root alone; turns without conversation id belong to none and
are left out; no conversations give no nodes.  Names of other columns play no part.

One conversation may hold most turns: its running values are cut into slices
(``functions.ordered``).  Many conversations may be equal or share their first turns:
nodes come from partial counts, joins on nodes have one row per node on one side.  The
ids that end at a node are hashed in order as they stream by, as SHA-256 asks.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungauge.functions.ordered import Scan
from rungauge.shared import cut_lineage

MEMBERS = 1000
QUEUE = 1_000_000
SPACED = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "a", "b"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """One turn's identity: equal for equal role and text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def words_of(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


class SpillingQueue:
    """Smallest entries first; beyond ``limit`` entries they go to an unnamed file as a sorted run."""

    def __init__(self, limit: int = QUEUE) -> None:
        self.limit, self.heap, self.file, self.runs = limit, [], None, []

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            start = self.file.tell()
            while self.heap:
                pickle.dump([heapq.heappop(self.heap) for _ in range(min(1000, len(self.heap)))], self.file)
            run = self._run(start, self.file.tell())
            heapq.heappush(self.runs, (next(run), len(self.runs), run))

    def _run(self, at: int, end: int) -> Iterator[tuple]:
        while at < end:
            self.file.seek(at)
            entries = pickle.load(self.file)
            at = self.file.tell()
            yield from entries

    def least(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            entry, number, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, run))
            return entry
        return heapq.heappop(self.heap)


def _passed(queue: int):
    """Totals of stretches that come in reverse level order; a shard's root sends nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = SpillingQueue(queue)
        for batch in batches:
            names = ("conv_id", "top", "saved", "leaves", "parent_id", "parent_top", "is_root")
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            saved_out, leaves_out = [], []
            for conv, top, saved, leaves, parent, parent_top, is_root in zip(*columns, strict=True):
                while (entry := waiting.least()) is not None and entry[:2] == (-top, conv):
                    _, _, _, more, under = waiting.pop()
                    saved, leaves = saved + more, leaves + under
                leaves = leaves or 1
                if not is_root:
                    waiting.push((-parent_top, parent, conv, saved, leaves))
                saved_out.append(saved)
                leaves_out.append(leaves)
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column(batch.schema.get_field_index("conv_id")), "top": batch.column(batch.schema.get_field_index("top")), "saved": pa.array(saved_out, pa.int64()), "leaves": pa.array(leaves_out, pa.int64())})

    return work


def _totals(stretches: DataFrame, levels: int, queue: int) -> DataFrame:
    """``saved`` and ``leaves`` of the subtree of each stretch (conv_id, top), shard level by shard level."""
    done, sent = [], []
    for level in range(levels + 1):
        rows = stretches.filter(F.col("level") == level)
        if sent:
            received = sent[0]
            for more in sent[1:]:
                received = received.unionByName(more)
            received = received.groupBy("conv_id", "top").agg(F.sum("saved").alias("more"), F.sum("leaves").alias("under"))
            rows = rows.join(received, ["conv_id", "top"], "left").withColumns(
                {"saved": F.col("saved") + F.coalesce("more", F.lit(0)), "leaves": F.coalesce("under", F.lit(0))}
            )
        else:
            rows = rows.withColumn("leaves", F.lit(0).cast("long"))
        rows = rows.select("conv_id", "top", "saved", "leaves", "parent_id", "parent_top", "is_root", "shard_id", "shard_top", (-F.col("top")).alias("order"))
        sorted_rows = rows.repartition("shard_id", "shard_top").sortWithinPartitions("order", "conv_id").drop("shard_id", "shard_top", "order")
        totals = cut_lineage(sorted_rows.mapInArrow(_passed(queue), "conv_id long, top int, saved long, leaves long"), "trie-totals")
        done.append(totals)
        if level < levels:
            roots = stretches.filter((F.col("level") == level) & F.col("is_root") & F.col("parent_id").isNotNull()).select("conv_id", "top", "parent_id", "parent_top")
            sent.append(cut_lineage(totals.join(roots, ["conv_id", "top"]).groupBy(F.col("parent_id").alias("conv_id"), F.col("parent_top").alias("top")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")), "trie-sent"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _end_digests(ends: DataFrame) -> DataFrame:
    """``ends_sha256`` of each node (conv_id, depth): its ``member`` ids ascending, joined by commas."""
    rows = ends.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([o[0] for o in out], pa.int64()), "depth": pa.array([o[1] for o in out], pa.int32()), "ends_sha256": pa.array([o[2] for o in out], pa.string())})

        for batch in batches:
            for conv, depth, member in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "depth", "member")), strict=True):
                if (conv, depth) == node:
                    digest.update(b",%d" % member)
                    continue
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256(b"%d" % member)
            yield flushed()
            out.clear()
        if node is not None:
            out.append((*node, digest.hexdigest()))
            yield flushed()

    return rows.mapInArrow(work, "conv_id long, depth int, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame, order: list[str], members: int = MEMBERS, queue: int = QUEUE, target_rows: int | None = None) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id (long), the ``order`` columns, digest (of ``turn_digest``) and
    tokens; ``conversations``: conv_id of all conversations, once each, also of
    those without turns.  ``saved_tokens`` sums (n_convs - 1) * tokens over a subtree.
    """
    halves = lambda c: (F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(0xFFFFFFFF)))
    joined = lambda high, low: F.shiftleft(F.col(high) % (1 << 32), 32).bitwiseOR(F.col(low) % (1 << 32))
    scan = Scan(turns.filter("conv_id is not null").select("conv_id", *order, "digest", "tokens"), ["conv_id"], [*order, "digest"], target_rows)
    scan.add(depth=("sum", F.lit(1)), following=("next", F.lit(1)))
    first, second = F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth", F.lit(1))
    for name, value in zip("wxyz", (*halves(first), *halves(second)), strict=True):
        scan.column(name, value)
    scan.add(**{f"sum_{c}": ("sum", F.col(c)) for c in "wxyz"})
    rows = scan.rows()
    before = rows.withColumns({f"before_{c}": F.col(f"sum_{c}") - F.col(c) for c in "wxyz"})
    rows = before.select(
        "conv_id", F.col("depth").cast("int").alias("depth"), joined("sum_w", "sum_x").alias("a"), joined("sum_y", "sum_z").alias("b"),
        joined("before_w", "before_x").alias("parent_a"), joined("before_y", "before_z").alias("parent_b"), "tokens", F.col("following").isNull().alias("last"),
    )
    rows = cut_lineage(rows, "trie-rows")
    started = rows.filter("depth = 1").select("conv_id", F.lit(False).alias("last"))
    zero = F.lit(0).cast("long")
    roots = conversations.select("conv_id").filter("conv_id is not null").join(started, "conv_id", "left").select(
        "conv_id", F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("parent_a"), F.lit(None).cast("long").alias("parent_b"), zero.alias("tokens"), F.coalesce("last", F.lit(True)).alias("last")
    )
    rows = cut_lineage(rows.unionByName(roots), "trie-paths")
    nodes = cut_lineage(rows.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("parent_a").alias("parent_a"), F.min("parent_b").alias("parent_b")), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count("*").alias("n_children"))
    counted = cut_lineage(nodes.drop("parent_a", "parent_b").join(children, NODE, "left"), "trie-counted")
    paths = cut_lineage(rows.drop("parent_a", "parent_b").join(counted, NODE).drop("a", "b"), "trie-named")

    if members < 2:
        raise ValueError("a shard holds at least two conversations")
    total = counted.filter("depth = 0").select(F.max("n_convs")).first()[0] or 0
    levels = 0
    while members ** (levels + 1) < total:
        levels += 1
    level = sum((F.col("n_convs") > members ** (k + 1)).cast("int") for k in range(levels)) if levels else F.lit(0)
    scan = Scan(paths, ["conv_id"], ["depth"], target_rows)
    scan.column("level", level).column("saved", (F.col("n_convs") - 1) * F.col("tokens"))
    scan.add(up_convs=("prev", F.col("n_convs")), up_level=("prev", F.col("level")), up_owner=("prev", F.col("owner")))
    starts = F.col("up_convs").isNull() | (F.col("up_convs") != F.col("n_convs"))
    begins = F.col("up_level").isNull() | (F.col("up_level") != F.col("level"))
    scan.column("starts", starts)
    scan.add(top=("last", F.when(F.col("starts"), F.col("depth"))), upto=("sum", F.col("saved")), shard=("last", F.when(begins, F.struct("owner", "depth"))))
    scan.add(up_top=("prev", F.col("top")), above=("last", F.when(F.col("starts"), F.col("upto") - F.col("saved"))))
    own = scan.rows().filter("conv_id = owner")
    own = cut_lineage(own.select("conv_id", "depth", "n_convs", "n_children", "level", "saved", "up_owner", "up_top", "top", "starts", (F.col("upto") - F.col("saved") - F.col("above")).alias("passed"), F.col("shard.owner").alias("shard_id"), F.col("shard.depth").alias("shard_top")), "trie-own")
    at_top = lambda c: F.max(F.when(F.col("starts"), F.col(c)))
    stretches = own.groupBy("conv_id", "top").agg(
        F.sum("saved").alias("saved"), F.max("level").alias("level"), F.max("shard_id").alias("shard_id"), F.max("shard_top").alias("shard_top"), at_top("up_owner").alias("parent_id"), at_top("up_top").alias("parent_top")
    )
    stretches = stretches.withColumn("is_root", (F.col("conv_id") == F.col("shard_id")) & (F.col("top") == F.col("shard_top")))
    totals = _totals(cut_lineage(stretches, "trie-stretches"), levels, queue).withColumnRenamed("saved", "whole")
    ends = _end_digests(paths.filter("last").select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("member")))
    return own.join(totals, ["conv_id", "top"]).join(ends, ["conv_id", "depth"], "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("up_owner").alias("parent_conv_id"), F.col("n_convs").cast("long").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("whole") - F.col("passed")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
