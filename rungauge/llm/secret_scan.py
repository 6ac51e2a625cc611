"""Secrets: known shapes, and random strings that a tokenizer's vocabulary can't compress.

Words of any language, identifiers and markup come in long tokens; a key drawn at
random falls apart into tokens of one or two characters.  Strings of key-like
characters whose characters per token stay at or below ``ratio`` are reported,
unless they are a digest of a known length, a UUID, or digits only.  A string that
words lift over the ratio is searched again by its parts between ``/ = _ -``: those
that fail alone, or neighbours that are random together, as a key that has such
signs of its own.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# How the vocabulary's tokenizer cuts a text before it merges, the
# shapes of known secrets, lengths of hex digests, and the shape of a UUID.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
DIGESTS = (32, 40, 56, 64, 96, 128)
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"

PARTS = rf"(?<![A-Za-z0-9+]){UUID}(?![A-Za-z0-9+])|[A-Za-z0-9+]+"
KINDS = ("assign", "access", "hex", "random")
PART = 256  # characters encoded at once; a longer string is counted in parts


def base_spans(text: str, assign: re.Pattern, access: re.Pattern, digits: re.Pattern) -> list[tuple[int, int, int]]:
    """start, kind and end of the known shapes, each kind's matches from left to right."""
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in access.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in digits.finditer(text)]
    return sorted(found)


def explained(word: str) -> bool:
    """Whether a string is a digest of a known length, a UUID, or has no letter."""
    if len(word) in DIGESTS and (re.fullmatch("[0-9a-f]+", word) or re.fullmatch("[0-9A-F]+", word)):
        return True
    if re.fullmatch(UUID, word):
        return True
    return not any(c.isalpha() for c in word)


def random_parts(word: str, random, secret) -> list[tuple[int, int]]:
    """Start and end of random parts of a string; ``random`` judges a part of any length, ``secret`` what is reported."""
    groups = [[]]
    for m in re.finditer(PARTS, word):
        if not re.fullmatch(UUID, m.group()) and random(m.group()):
            groups[-1].append(m.span())
        else:
            groups.append([])
    out = []
    for group in filter(None, groups):
        alone = [(a, b) for a, b in group if secret(a, b)]
        a, b = group[0][0], group[-1][1]
        out += alone or ([(a, b)] if len(group) > 1 and secret(a, b) else [])
    return out


def scanned(docs: DataFrame, vocabulary: str = VOCABULARY, least: int = 20, ratio: float = 2.0, known: frozenset[str] = frozenset(), text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: array of (kind, start, end, part of the text), in code points, the end exclusive.

    Sorted by start, then by kind as in ``KINDS``.  A string that touches a known
    shape is not reported again.  Strings in ``known`` (digests, fingerprints)
    are left out of the random ones.  A null or empty text has none; a column
    ``secrets`` in the input is replaced.  ``vocabulary`` is a rank file, read by
    the driver and sent to the tasks (its size is the file's).
    """
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def scan(batches) -> Iterator[pa.RecordBatch]:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encoder = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})
        assign, access, digits = re.compile(ASSIGN, re.A), re.compile(ACCESS), re.compile(HEX)
        keys = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % least)

        def random(word: str) -> bool:
            return len(word) <= ratio * sum(len(encoder.encode_ordinary(word[i : i + PART])) for i in range(0, len(word), PART))

        for batch in batches:
            found = []
            for value in batch.column(batch.num_columns - 1):
                content = value.as_py() or ""
                spans = base_spans(content, assign, access, digits)
                taken = [(start, end) for start, _, end in spans]
                at = 0
                for m in keys.finditer(content):
                    while at < len(taken) and taken[at][1] <= m.start():
                        at += 1
                    near = list(itertools.takewhile(lambda t: t[0] < m.end(), itertools.islice(taken, at, None)))

                    def secret(start: int, end: int, m=m, near=near) -> bool:
                        word = m.group()[start:end].strip("=-_/+")
                        start, end = start + m.start(), end + m.start()
                        if any(a < end and start < b for a, b in near):
                            return False
                        return len(word) >= least and word not in known and not explained(word) and random(word)

                    if secret(0, len(m.group())):
                        spans.append((m.start(), 3, m.end()))
                    elif m.group().strip("=-_/+") not in known:
                        spans += [(m.start() + a, 3, m.start() + b) for a, b in random_parts(m.group(), random, secret)]
                spans.sort()
                found.append([{"kind": KINDS[kind], "start": start, "end": end, "part": content[start:end]} for start, kind, end in spans])
            column = pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("part", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["row", "secrets"])

    others = [c for c in docs.columns if c != "secrets"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(text).cast("string").alias("text"))
    spans = T.StructType.fromDDL("secrets array<struct<kind: string, start: bigint, end: bigint, part: string>>")
    out = packed.mapInArrow(scan, T.StructType([packed.schema["row"], *spans]))
    return out.select("row.*", "secrets")


def written(spans: Column) -> Column:
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The digest of (kind, start, end) in order, as in the query."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
