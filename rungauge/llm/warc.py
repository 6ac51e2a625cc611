"""WARC archives with an index first: one row of (file, offset, length, url, digest) per record.

Each task writes archives of its own (one gzip member per record, so that a record
can be read alone) and returns the index rows; the index is a table that Spark
commits, so only records of tasks that ended are in it, and files of lost attempts
are in no index.  A selection of records is read by ranges of the index: its rows
are ordered by file and offset, neighbours with small gaps become one read, and each
record is cut out of what was read.

Equal payloads are stored once.  Of records whose payloads agree and have at least
``shortest`` bytes, the one with the largest key is a response, and the others are
revisits that name its key and digest and hold no payload.  Digests are counted by
(digest, key) before anything of a digest meets, so a payload that a third of all
pages share is a few counted rows; pages themselves are not shuffled unless the
repeated digests are too many to send.

Results by case: a null payload is an empty one; empty or short payloads are always
responses; a null key is the smallest; of rows that agree in payload and largest key,
one (with the smallest url) is the response; a null url has no WARC-Target-URI; line
ends in a url are written percent-encoded in the header and kept in the index; an empty
table gives an empty index.  Only key, url and payload are read, under any names.

Archives go below ``folder``, which every executor must reach: a path or an address of
a store that Arrow opens (file, hdfs, s3, gs).  A record is held whole in memory.
"""

from __future__ import annotations

import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from rungauge.shared import cut_lineage, sent_if_small

SHORTEST = 1000
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 1 << 21
GAP_BYTES = 1 << 16
BATCH_BYTES = 1 << 23
CHUNK = 100_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
INDEX = StructType(
    [StructField(name, StringType()) for name in ("key", "url", "record_type", "refers_to", "payload_digest", "file")]
    + [StructField(name, LongType()) for name in ("offset", "length")]
)
RECORD = StructType(
    [StructField(name, StringType()) for name in ("key", "url", "record_type", "refers_to", "payload_digest")]
    + [StructField("payload", BinaryType()), StructField("intact", BooleanType())]
)

_TYPES = {StringType(): pa.string(), LongType(): pa.int64(), BinaryType(): pa.binary(), BooleanType(): pa.bool_()}
_INDEX = pa.schema([(f.name, _TYPES[f.dataType]) for f in INDEX.fields])
_RECORD = pa.schema([(f.name, _TYPES[f.dataType]) for f in RECORD.fields])


def planned(pages: DataFrame, key: str, url: str, payload: str, shortest: int = SHORTEST) -> DataFrame:
    """Records to write: key, url, payload (null for revisits), payload_digest, record_type, refers_to.

    The key keeps its type and order.  ``refers_to`` is the key of a revisit's response.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload")).withColumns(
        {"payload_digest": F.sha1("payload"), "size": F.octet_length("payload")}
    )
    counted = rows.filter(F.col("size") >= shortest).groupBy("payload_digest", "key").agg(F.count("*").alias("n"))
    groups = counted.groupBy("payload_digest").agg(F.sum("n").alias("total"), F.max(F.struct("key", "n")).alias("top")).filter("total > 1")
    groups = cut_lineage(groups.select("payload_digest", F.col("top.key").alias("top"), F.col("top.n").alias("tied")), "payload-groups")
    marked = rows.join(sent_if_small(groups), "payload_digest", "left")
    ours = F.col("tied").isNull() | F.col("key").eqNullSafe(F.col("top"))
    plain = _records(marked.filter(~ours | (F.coalesce("tied", F.lit(1)) == 1)), ours)
    if groups.filter("tied > 1").isEmpty():
        return plain
    # Rows that agree in payload and largest key: one stays, the others are counted and written as revisits.
    same = marked.filter(ours & (F.col("tied") > 1))
    one = same.groupBy("payload_digest").agg(F.min(F.struct("url")).alias("least"), F.first("payload").alias("payload"), F.first("top").alias("key"))
    one = one.withColumns({"url": F.col("least.url"), "top": F.col("key")})
    repeats = same.groupBy("payload_digest", "url", F.col("top")).agg(F.count("*").alias("n"))
    least = one.select("payload_digest", F.struct("url").alias("least"))
    repeats = repeats.join(least, "payload_digest").withColumn("n", F.col("n") - F.col("least").eqNullSafe(F.struct("url")).cast("long")).filter("n > 0")
    chunks = repeats.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {CHUNK} as int)"))))
    chunks = chunks.withColumn("part", F.least(F.lit(CHUNK), F.col("n") - F.col("chunk") * CHUNK).cast("int")).repartition("payload_digest", "url", "chunk")
    rest = chunks.withColumns({"copy": F.explode(F.sequence(F.lit(1), F.col("part"))), "key": F.col("top"), "payload": F.lit(None).cast("binary")})
    return plain.unionByName(_records(one, F.lit(True))).unionByName(_records(rest, F.lit(False)))


def _records(rows: DataFrame, ours: Column) -> DataFrame:
    """``ours``: whether the row is a response of its own; else it revisits ``top``."""
    return rows.select(
        "key",
        "url",
        F.when(ours, F.col("payload")).alias("payload"),
        "payload_digest",
        F.when(ours, "response").otherwise("revisit").alias("record_type"),
        F.when(~ours, F.col("top")).alias("refers_to"),
    )


def _store(address: str) -> tuple[fs.FileSystem, str]:
    if address.startswith("file:/") and not address.startswith("file://"):
        address = "file://" + address.removeprefix("file:")
    return fs.FileSystem.from_uri("s3://" + address.removeprefix("s3a://") if address.startswith("s3a://") else address)


def _named(key: str | None) -> str:
    return "<urn:null>" if key is None else f"<urn:record:{urllib.parse.quote(key, safe='')}>"


def _unnamed(name: str | None) -> str | None:
    return urllib.parse.unquote(name.removeprefix("<urn:record:")[:-1]) if name and name.startswith("<urn:record:") else None


def _block(kind: str, fields: list[tuple[str, str | None]], body: bytes) -> bytes:
    """One record, not compressed."""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{name}: {value}" for name, value in fields if value is not None), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _record(row: dict, date: str) -> bytes:
    url = None if row["url"] is None else row["url"].replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Record-ID", _named(row["key"])), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}")]
    payload = row["payload"] or b""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _named(row["refers_to"]))]
    else:
        head += f"Content-Length: {len(payload)}\r\n"
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return _block(row["record_type"], fields, head.encode() + b"\r\n" + payload)


def _packed(block: bytes, level: int) -> bytes:
    maker = zlib.compressobj(level, zlib.DEFLATED, 31)
    return maker.compress(block) + maker.flush()


class _Archive:
    """An archive that one task is writing."""

    def __init__(self, folder: str, level: int, date: str) -> None:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.level, self.at = level, 0
        self.add(_block("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n"))

    def add(self, block: bytes) -> tuple[int, int]:
        packed = _packed(block, self.level)
        self.out.write(packed)
        self.at += len(packed)
        return self.at - len(packed), len(packed)


def write_archives(records: DataFrame, folder: str, level: int = 3, date: str = DATE) -> DataFrame:
    """Writes ``records`` (of ``planned``) to archives below ``folder``; returns the written index.

    Index columns: key and refers_to (as text), url, record_type, payload_digest,
    file, offset, length (bytes of the compressed record in its file).
    """
    texts = {c: F.col(c).cast("string") for c in ("key", "refers_to")}
    rows = records.withColumns(texts).select("key", "url", "payload", "payload_digest", "record_type", "refers_to")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        try:
            for batch in batches:
                index = []
                for row in (r for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist()):
                    if archive is None or archive.at >= ARCHIVE_BYTES:
                        if archive:
                            archive.out.close()
                        archive = _Archive(folder, level, date)
                    offset, length = archive.add(_record(row, date))
                    del row["payload"]
                    index.append({**row, "file": archive.name, "offset": offset, "length": length})
                yield pa.RecordBatch.from_pylist(index, schema=_INDEX)
        finally:
            if archive:
                archive.out.close()

    return cut_lineage(rows.mapInArrow(work, INDEX), "warc-index")


def _parsed(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one compressed record."""
    head, _, rest = zlib.decompress(packed, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of index rows (in order) that one read covers."""
    run: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if run and (row["file"] != run[-1]["file"] or row["offset"] - run[-1]["offset"] - run[-1]["length"] > GAP_BYTES or row["offset"] + row["length"] - run[0]["offset"] > READ_BYTES):
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` (all of it or some of its rows) lists, read back from the archives.

    ``record_type``, ``refers_to``, ``payload_digest`` and ``key`` are what the
    record's header says; ``payload`` is null for revisits; ``intact`` tells whether
    header and index agree.  ``payload_digest`` is the digest of the payload that was
    stored, so a caller can hold the bytes against it.
    """
    rows = index.select(*INDEX.names).repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for run in _ranges(batches):
            low = run[0]["offset"]
            with store.open_input_file(f"{path}/{run[0]['file']}") as source:
                read = source.read_at(run[-1]["offset"] + run[-1]["length"] - low, low)
            out, held = [], 0
            for row in run:
                at = row["offset"] - low
                fields, payload = _parsed(read[at : at + row["length"]])
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                key, refers_to = _unnamed(fields["WARC-Record-ID"]), _unnamed(fields.get("WARC-Refers-To"))
                intact = (key, kind, refers_to, digest) == (row["key"], row["record_type"], row["refers_to"], row["payload_digest"])
                out.append({"key": key, "url": row["url"], "record_type": kind, "refers_to": refers_to, "payload_digest": digest, "payload": payload if kind == "response" else None, "intact": intact})
                held += len(payload)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=_RECORD)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=_RECORD)

    return rows.mapInArrow(work, RECORD)


def resolved(index: DataFrame, folder: str) -> DataFrame:
    """Per record of a whole index what its payload measures, read from its own record or from the one it revisits.

    Columns key, url, record_type, refers_to, payload_bytes, payload_digest (of the
    bytes read back; null if a record is not intact or a revisit's response is missing).
    """
    read = read_records(index, folder)
    digest = F.when(F.col("intact") & (F.sha1("payload") == F.col("payload_digest")), F.col("payload_digest"))
    read = read.select("key", "url", "record_type", "refers_to", F.col("payload_digest").alias("named"), digest.alias("found"), F.octet_length("payload").cast("long").alias("bytes"), "intact")
    read = cut_lineage(read, "warc-read")
    out = ["key", "url", "record_type", "refers_to", F.col("bytes").alias("payload_bytes"), F.col("found").alias("payload_digest")]
    revisits = read.filter("record_type = 'revisit'")
    sources = read.filter("record_type = 'response' and found is not null").join(revisits.select("named").distinct(), "named", "left_semi")
    sources = sources.groupBy("named").agg(F.first("found").alias("source"), F.first("bytes").alias("size"))
    revisits = revisits.join(sent_if_small(sources), "named", "left").withColumns({"found": F.when(F.col("intact"), F.col("source")), "bytes": F.when(F.col("intact"), F.col("size"))})
    return read.filter("record_type <> 'revisit'").select(*out).unionByName(revisits.select(*out))
