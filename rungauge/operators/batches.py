"""Fitting, padding and ordering training batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungauge.functions import arrays
from rungauge.functions.hashing import hash_order
from rungauge.functions.ranks import with_position
from rungauge.operators.groups import join_groups


def fit_target(n: Column, size: int, cap: int | None = None) -> Column:
    """Rows wanted: the next multiple of the mini-batch size, at most ``cap`` mini-batches."""
    target = F.ceil(n / F.lit(size)) * size
    return target if cap is None else F.least(target, F.lit(size * cap))


def mini_batch_fit(counts: DataFrame, n: str, size: int, cap: int | None = None) -> DataFrame:
    """Adds rows to drop and rows to pad; an empty batch needs neither."""
    target = fit_target(F.col(n), size, cap)
    return counts.withColumn("n_drop", F.greatest(F.lit(0), F.col(n) - target).cast("long")).withColumn(
        "n_pad", F.greatest(F.lit(0), target - F.col(n)).cast("long")
    )


def shuffled(rows: DataFrame, seed: str, key: str, batch: Sequence[str] = (), name: str = "position", **options) -> DataFrame:
    """Adds the row's place in a seeded random order of its batch; all columns stay aligned."""
    hashed = rows.withColumn("_h", hash_order(seed, F.col(key)))
    out = with_position(hashed, list(batch), ["_h", key], name, **options)
    return out.drop("_h")


def drop_to_fit(
    rows: DataFrame, batch: Sequence[str], key: str, zero_adv: str, size: int, cap: int | None, seed: str = "drop", **options
) -> DataFrame:
    """Marks the rows that leave an oversized batch: same-reward rows first, then at random."""
    counts = mini_batch_fit(rows.groupBy(*batch).agg(F.count("*").alias("_n")), "_n", size, cap)
    ordered = rows.withColumn("_o", F.when(F.col(zero_adv), 0).otherwise(1)).withColumn(
        "_h", hash_order(seed, F.col(key))
    )
    placed = with_position(ordered, list(batch), ["_o", "_h", key], "_at", **options)
    out = join_groups(placed, counts.select(*batch, "n_drop"), batch)
    return out.withColumn(
        "drop_reason",
        F.when(F.col("_at") <= F.col("n_drop"), F.when(F.col(zero_adv), "same_reward").otherwise("random")),
    ).drop("_o", "_h", "_at", "n_drop")


def neutral_padding(
    rows: DataFrame, batch: Sequence[str], key: str, uid: str, score: str, size: int, seed: str = "pad", **options
) -> DataFrame:
    """The batch plus neutral copies up to the next multiple of ``size``.

    A copy has score 0 and a uid and key of its own, so its group is itself and
    no other group's mean moves.  Sources are the first rows of a seeded random
    order, taken again from the start when there are fewer rows than copies.
    """
    counts = mini_batch_fit(rows.groupBy(*batch).agg(F.count("*").alias("_n")), "_n", size)
    wanted = (
        counts.where("n_pad > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_pad"))))
        .withColumn("_source", (F.col("_copy") - 1) % F.col("_n") + 1)
        .select(*[F.col(b).alias(f"_b_{i}") for i, b in enumerate(batch)], "_copy", "_source")
    )
    placed = shuffled(rows, seed, key, batch, "_at", **options).where(F.col("_at") < size + 1)
    on = F.col("_at") == F.col("_source")
    for i, b in enumerate(batch):
        on = on & F.col(b).eqNullSafe(F.col(f"_b_{i}"))
    label = F.concat_ws("-", F.lit("pad"), *[F.col(b).cast("string") for b in batch], F.col("_copy").cast("string"))
    copies = placed.join(wanted, on).select(
        *[
            F.lit(0.0).alias(c) if c == score else label.alias(c) if c in (uid, key) else F.col(c)
            for c in rows.columns
        ],
        F.lit(True).alias("is_pad"),
    )
    originals = rows.select(
        *[F.col(c).cast("string").alias(c) if c in (uid, key) else F.col(c) for c in rows.columns],
        F.lit(False).alias("is_pad"),
    )
    return originals.unionByName(copies)


def pad_to_batch(
    rows: DataFrame, batch: Sequence[str], prompt: str, response: str, pad: int, extras: dict[str, Column] | None = None
) -> DataFrame:
    """Prompts padded left and responses right, to the longest real row of the batch.

    ``extras`` are arrays as long as the response with the value they are filled up with.
    """
    widths = rows.groupBy(*batch).agg(
        F.max(F.size(prompt)).alias("prompt_width"), F.max(F.size(response)).alias("response_width")
    )
    out = join_groups(rows, widths, batch)
    p, r = F.col(prompt), F.col(response)
    ones_p, ones_r = F.transform(p, lambda _: F.lit(1)), F.transform(r, lambda _: F.lit(1))
    out = out.withColumn("prompt_mask", arrays.pad_left(ones_p, F.col("prompt_width"), F.lit(0)))
    out = out.withColumn("response_pad_mask", arrays.pad_right(ones_r, F.col("response_width"), F.lit(0)))
    out = out.withColumn(prompt, arrays.pad_left(p, F.col("prompt_width"), F.lit(pad)))
    for name, value in (extras or {}).items():
        out = out.withColumn(name, arrays.pad_right(F.col(name), F.col("response_width"), value))
    return out.withColumn(response, arrays.pad_right(r, F.col("response_width"), F.lit(pad)))


def display_sample(rows: DataFrame, step: str, key: str, text: str, seed: str, every: int, limit: int) -> DataFrame:
    """One row per shown step, chosen by a seeded hash; the text is clipped for display only.

    Steps 1 and every ``every``-th are shown.  The choice is an aggregate, so a
    step with most of the rows is merged before the shuffle.
    """
    shown = rows.where((F.col(step) == 1) | (F.col(step) % every == 0))
    picked = shown.groupBy(step).agg(
        F.max_by(F.struct(key, text), F.struct(hash_order(seed, F.col(key)), F.col(key))).alias("_r")
    )
    t = F.col(f"_r.{text}")
    omitted = F.length(t) - limit
    clipped = F.concat(F.substring(t, 1, limit), F.lit("\n...[truncated "), omitted.cast("string"), F.lit(" chars]"))
    return picked.select(
        step, F.col(f"_r.{key}").alias(key), F.when(omitted > 0, clipped).otherwise(t).alias(text), F.length(t).alias("n_chars")
    )
