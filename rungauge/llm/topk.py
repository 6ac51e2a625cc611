"""Exact top-k by inner product over a pivot-distance index.

Vectors of integers get one more coordinate that lifts them all to the same norm;
the largest inner products then are the least distances.  Each vector is keyed by
its nearest pivot and its distance to it.  The index is sorted by both and cut
into blocks: each is an annulus around one pivot.  A query first reads the block
where it lies itself; its k-th score bounds the distance of everything better, and
by the triangle inequality only annuli that come within this bound can hold it.
Scores are exact integers; the bound has a margin for its floating-point error.

All rows are in the index; pivots come from a bounded sample (``SAMPLE`` vectors).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rungauge.shared import cut_lineage

SAMPLE = 4096  # vectors from which pivots are made
PIVOTS = 32
BLOCK = 2048  # vectors in a block
SHARE = 8192  # queries that meet a block in one task, about
RESULT = "query_id long, rank int, vec_id long, score long"


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``id`` and ``v``: floor(scale * x) of every component, without the vectors that take no part."""
    x = F.col(vector).cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), F.when(finite, whole).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that makes their squared norms ``top``."""
    x = v.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))[:, None]], 1)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squared = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    return np.sqrt(np.maximum(squared, 0.0))


def pivots_of(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Centres of a sample by Lloyd's iteration from spread starts."""
    centres = sample[:1]
    nearest = distances(sample, centres)[:, 0]
    while len(centres) < min(n, len(sample)) and nearest.max() > 0:
        centres = np.concatenate([centres, sample[[int(nearest.argmax())]]])
        nearest = np.minimum(nearest, distances(sample, centres[-1:])[:, 0])
    for _ in range(rounds):
        own = distances(sample, centres).argmin(1)
        for p in range(len(centres)):
            if (own == p).any():
                centres[p] = sample[own == p].mean(0)
    return centres


def scores(queries: np.ndarray, vectors: np.ndarray, exact_float: bool) -> np.ndarray:
    """Integer inner products; by float matrices where no sum can leave 53 bits."""
    if exact_float:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def best(score: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, without the query's own id."""
    places = np.flatnonzero(ids != own)
    if len(places) > k:
        floor = np.partition(score[places], -k)[-k]
        places = places[score[places] >= floor]
    return places[np.lexsort((ids[places], -score[places]))][:k]


def _index(rows: DataFrame, centres: np.ndarray, top: float, dim: int) -> DataFrame:
    def keyed(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(lifted(matrix(batch.column(1), dim), top), centres)
            own = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], names=["id", "v", "pivot", "distance"]
            )

    schema = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary())])

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            pivot, far = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cuts = np.union1d(np.flatnonzero(np.diff(pivot)) + 1, np.arange(0, len(pivot), BLOCK))
            for a, b in zip(cuts, np.append(cuts[1:], len(pivot))):
                vectors = matrix(batch.column(1).slice(a, b - a), dim).astype(np.int64)
                one = {"block": number, "pivot": int(pivot[a]), "low": float(far[a]), "high": float(far[b - 1]), "ids": batch.column(0).slice(a, b - a).to_pylist(), "vectors": vectors.tobytes()}
                yield pa.RecordBatch.from_pylist([one], schema=schema)
                number += 1

    ranged = rows.mapInArrow(keyed, "id long, v array<long>, pivot int, distance double").repartitionByRange("pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
    return cut_lineage(ranged.mapInArrow(blocks, "block long, pivot int, low double, high double, ids array<long>, vectors binary"), "annuli")


def _visits(queries: DataFrame, centres: np.ndarray, top: float, dim: int, annuli: np.ndarray, shares: int, first: bool) -> DataFrame:
    """Which query reads which block: the one around its own place, or all others that its bound allows."""
    numbers, pivot = annuli["block"], annuli["pivot"]

    def visit(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), dim)
            x = np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], 1)
            far = distances(x, centres)[:, pivot]
            gap = np.maximum(np.maximum(far - annuli["high"], annuli["low"] - far), 0.0)
            home = np.lexsort((np.broadcast_to(numbers, gap.shape), far, gap), axis=1)[:, 0]
            if first:
                q, b = np.arange(len(v)), home
            else:
                kth = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)  # nan: fewer than k yet
                reach = np.sqrt(np.maximum(0.0, (x * x).sum(1) + top - 2 * kth))
                reach = np.where(np.isnan(reach), np.inf, reach)
                near = gap <= reach[:, None] + 1e-6 * (1 + far)
                near[np.arange(len(v)), home] = False
                q, b = np.nonzero(near)
            for at in range(0, len(q), 4096):
                some = pa.array(q[at : at + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[b[at : at + 4096]]), batch.column(0).take(some), batch.column(1).take(some)], names=["block", "query_id", "q"]
                )

    return queries.mapInArrow(visit, "block long, query_id long, q array<long>").withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))


def _read(visits: DataFrame, index: DataFrame, dim: int, k: int, shares: int, exact_float: bool) -> DataFrame:
    """The k best of each visited block for each query that reads it."""

    def answer(asked: pa.Table, block: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if asked.num_rows and block.num_rows:
            ids = np.array(block.column("ids")[0].as_py(), np.int64)
            vectors = np.frombuffer(block.column("vectors")[0].as_buffer(), np.int64).reshape(-1, dim)
            names, queries = asked.column("query_id").to_pylist(), matrix(asked.column("q").combine_chunks(), dim)
            for at in range(0, len(names), 256):
                for name, row in zip(names[at : at + 256], scores(queries[at : at + 256], vectors, exact_float)):
                    places = best(row, ids, name, k)
                    out["query_id"] += [name] * len(places)
                    out["vec_id"] += ids[places].tolist()
                    out["score"] += row[places].tolist()
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    copies = index.select("block", "ids", "vectors", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    return visits.groupBy("block", "share").cogroup(copies.groupBy("block", "share")).applyInArrow(answer, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: str = "id % 100 = 0", k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best of each query; ties go to the smaller id.

    ``vectors``: id and v, as from :func:`quantised`; ``is_query`` tells which of
    them are queries.  All but a query's own id are candidates (all, if fewer than
    k).  Rows equal in id and vector count once; an id with several vectors
    stands for each of them, and as a query asks with the least.  Shorter vectors
    count as filled up with zeros.  Of equal vectors the k + 1 smallest ids are
    kept, which is all that any answer can name.  An empty table gives no rows.
    """
    spark: SparkSession = vectors.sparkSession
    shape = vectors.agg(F.max(F.size("v")).alias("dim"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most")).first()
    dim = shape["dim"] or 0
    if not dim:
        return spark.createDataFrame([], RESULT)
    most = shape["most"] or 0
    if most * most * dim >= 1 << 63:
        raise ValueError("inner products of these components don't fit in 64 bits")
    exact_float = most * most * dim < 1 << 53
    padded = vectors.select("id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v"))
    rows = cut_lineage(padded.dropDuplicates(["id", "v"]), "vectors")
    queries = cut_lineage(rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v")), "queries")
    among = Window.partitionBy("v").orderBy("id")
    rows = rows.withColumn("at", F.row_number().over(among)).filter(F.col("at") <= k + 1).drop("at")
    top = float(rows.agg(F.max(F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x * x))).first()[0])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    centres = pivots_of(lifted(np.stack(sample.to_numpy()), top), PIVOTS)
    index = _index(rows, centres, top, dim)
    # One row per block of up to BLOCK vectors: 32 bytes of every 2048 vectors are sent to the tasks.
    listed = index.select("block", "pivot", "low", "high").toPandas()
    annuli = {c: listed[c].to_numpy() for c in listed.columns}
    shares = max(1, -(-queries.count() // SHARE))
    home = _read(_visits(queries, centres, top, dim, annuli, shares, first=True), index, dim, k, shares, exact_float)
    home = cut_lineage(home, "home")
    bound = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    bounded = queries.join(bound, queries["id"] == bound["query_id"], "left").select("id", "v", F.col("kth").cast("double"))
    rest = _read(_visits(bounded, centres, top, dim, annuli, shares, first=False), index, dim, k, shares, exact_float)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = home.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
