"""Hash order, exact digest arithmetic and order-independent table digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_order(salt: str, key: Column) -> Column:
    """Hex digest of salt and key: a reproducible random order."""
    return F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)


def text_key(text: Column) -> Column:
    """The SHA-256 of a text as 32 bytes: what long texts are grouped and joined by.  A null has none."""
    return F.unhex(F.sha2(text.cast("string"), 256))


def digest_mod_10(digest: Column) -> Column:
    """The 256-bit number written in a hex digest, modulo 10.

    16 leaves 6 modulo 10 and so does every higher power of 16, so all digits
    but the last weigh 6.
    """
    digits = F.transform(
        F.split(digest, ""), lambda d: F.coalesce(F.conv(d, 16, 10).cast("int"), F.lit(0))
    )
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + d)
    last = F.conv(F.substring(digest, -1, 1), 16, 10).cast("int")
    return ((total - last) * 6 + last) % 10


def row_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of a row: values joined by U+001F, null written as U+0000."""
    texts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *texts), 256)


def table_digest(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows and an order-independent digest per group.

    Row digests are cut into eight 32-bit words and summed word by word, so the
    digest is built by partial sums and no group's rows are ever gathered.
    """
    hashed = df.withColumn("_d", row_digest([F.col(c) for c in columns]))
    words = [
        F.sum(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"_w{i}")
        for i in range(8)
    ]
    out = hashed.groupBy(*keys).agg(F.count("*").alias("n_rows"), *words)
    joined = F.concat_ws("-", *[F.col(f"_w{i}").cast("string") for i in range(8)])
    return out.withColumn("digest", F.sha2(joined, 256)).drop(*[f"_w{i}" for i in range(8)])
