"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of their keys; a keyed Feistel network over
the smallest power of two that holds n, walked along its cycle until it lands
below n, permutes the numbers.  Permuted number p sits in shard ``p mod shards``
at slot ``p div shards``: counts differ by one at most, slots have no gaps, and
either direction is computed without a look-up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungauge.llm.words import GOLDEN, mix
from rungauge.shared import cut_lineage

ROUNDS = 6


def permuted(values: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The image (or pre-image) of numbers below ``n`` under the seeded permutation of 0..n-1."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    right = np.uint64((bits + 1) // 2)
    low_mask = np.uint64((1 << int(right)) - 1)
    high_mask = np.uint64((1 << (bits - int(right))) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed % (1 << 64)))

    def network(x: np.ndarray) -> np.ndarray:
        high, low = x >> right, x & low_mask
        for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if i % 2:
                low = low ^ (mix(high + keys[i]) & low_mask)
            else:
                high = high ^ (mix(low + keys[i]) & high_mask)
        return (high << right) | low

    out = network(np.asarray(values).astype(np.uint64))
    while (outside := out >= np.uint64(max(n, 1))).any():
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def place(position: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permuted(np.array([position]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number in a shard's slot."""
    return int(permuted(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def _order(keys: list[str]) -> list[Column]:
    return [F.col(f"row.{k}").asc_nulls_first() for k in keys]


def numbered(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Rows as ``row`` (a struct) with their ``position`` in the order of ``keys``, and how many there are.

    One range shuffle, no global sort: the ranges are sorted apart, written once,
    counted, and offset by the rows of earlier ranges.  Equal keys are told apart
    by a hash of where they were read, so that a key with a third of the rows is
    cut over many ranges; rows with equal keys may trade places.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    ranged = rows.repartitionByRange(*_order(keys), "salt").sortWithinPartitions(*_order(keys), "salt")
    placed = cut_lineage(ranged.select("row", F.monotonically_increasing_id().alias("at")), "numbered")
    part = F.shiftright("at", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # One row per range: no more rows than shuffle partitions, whatever the table's size.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    parts = parts.select("part", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    total = placed.count()
    inside = F.col("at") - F.shiftleft(part, 33)
    out = placed.join(F.broadcast(parts), part == F.col("part")).select("row", (F.col("before") + inside).alias("position"))
    return out, total


def sharded(df: DataFrame, keys: list[str], shards: int, seed: int = 0) -> DataFrame:
    """All rows and columns with ``position``, ``shard`` and ``slot``.

    Columns of these names in the input are replaced.  Nulls come first in the
    order; rows whose keys are all equal get neighbouring positions in any order;
    an empty table gives no rows.
    """
    rows, total = numbered(df, keys)

    @F.pandas_udf("long")
    def permute(position: pd.Series) -> pd.Series:
        return pd.Series(permuted(position.to_numpy(), total, seed))

    kept = [c for c in df.columns if c not in ("position", "shard", "slot")]
    return rows.withColumn("p", permute("position")).select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept],
        "position",
        (F.col("p") % shards).cast("int").alias("shard"),
        F.expr(f"p div {shards}").cast("long").alias("slot"),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``size`` (UTF-8 bytes plus 8; a null text has none) and ``text_crc32`` (unsigned; 0 for null and empty texts) of each row."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("size", F.octet_length(content).cast("long") + 8).withColumn("text_crc32", F.crc32(F.encode(content, "utf-8")))
