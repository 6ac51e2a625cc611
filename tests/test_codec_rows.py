"""Ids and texts pass Python a few rows at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from rungauge.functions import codec


def letters():
    return codec.PieceCodec([bytes([i]) for i in range(256)] + [b"th"])


def test_few_rows_are_python_objects_at_a_time(monkeypatch):
    most = 0

    def values(column):
        nonlocal most
        most = max(most, len(column))
        return column.to_pylist()

    monkeypatch.setattr(codec, "_values", values)
    texts = pa.array(["the", None, ""] * 1000)
    out = codec._by_rows(letters().encode, [texts], pa.list_(pa.int32()))
    assert out.to_pylist() == [[256, 101], None, []] * 1000
    assert most <= codec.ROWS


def test_slices_and_nulls():
    ids = pa.array([[1, 2], None, [], [3]], pa.list_(pa.int32()))
    assert codec._values(ids.slice(1, 3)) == [None, [], [3]]
    assert codec._values(pa.array([[1, None]], pa.list_(pa.int32()))) == [[1, None]]


def test_columns(spark):
    df = spark.createDataFrame([(1, "the"), (2, None), (3, ""), (4, "ü")], "i int, t string").repartition(1)
    load = lambda: codec.PieceCodec([bytes([i]) for i in range(256)] + [b"th"])
    encode, decode, more = codec.ids_of(load), codec.text_of(load), codec.continuation_of(load)
    rows = df.select("i", "t", encode(F.col("t")).alias("ids"))
    got = rows.select("i", "ids", decode(F.col("ids")).alias("back"), more(F.concat("ids", F.array(F.lit(33))), F.col("ids")).alias("more")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, [256, 101], "the", [33]), (2, None, None, None), (3, [], "", [33]), (4, [195, 188], "ü", [33])]
    assert rows.limit(0).select(decode(F.col("ids"))).collect() == []
