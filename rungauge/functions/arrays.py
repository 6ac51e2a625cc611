"""Token array expressions: prefixes, divergence, padding, rewards and advantages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def starts_with(ids: Column, prefix: Column) -> Column:
    """True when ``ids`` begins with ``prefix``."""
    return (F.size(ids) >= F.size(prefix)) & (
        F.slice(ids, F.lit(1), F.size(prefix)) == prefix
    )


def rest_after(ids: Column, n: Column) -> Column:
    """Elements after the first n."""
    return F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0)))


def first_difference(a: Column, b: Column) -> Column:
    """0-based index of the first difference; the shorter length when one runs out."""
    shared = F.least(F.size(a), F.size(b))
    equal = F.zip_with(F.slice(a, F.lit(1), shared), F.slice(b, F.lit(1), shared), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(equal, False)
    return F.when(at > 0, at - 1).otherwise(shared.cast("long"))


def window_around(ids: Column, index: Column, width: int) -> Column:
    """Elements from index - width up to index + width."""
    lo = F.greatest(index - width, F.lit(0))
    return F.slice(ids, (lo + 1).cast("int"), (index + width - lo).cast("int"))


def pad_left(ids: Column, width: Column, pad: Column) -> Column:
    return F.concat(F.array_repeat(pad, F.greatest(width - F.size(ids), F.lit(0)).cast("int")), ids)


def pad_right(ids: Column, width: Column, pad: Column) -> Column:
    return F.concat(ids, F.array_repeat(pad, F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def last_index_of(mask: Column, value: int = 1) -> Column:
    """0-based index of the last ``value``, -1 when absent."""
    at = F.array_position(F.reverse(mask), F.lit(value).cast("int"))
    return F.when(at > 0, F.size(mask) - at).otherwise(F.lit(-1)).cast("int")


def place_reward(size: Column, index: Column, reward: Column) -> Column:
    """Array of zeros with the reward at one index; an index of -1 falls on the first place."""
    at = F.greatest(index, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: F.when(i == at, reward).otherwise(F.lit(0.0))
    )


def advantages(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """array<struct<advantage, return>>: exponentially weighted advantages of one row.

    Recursion from the end over masked positions only: an observation neither
    decays the running values nor adds to them.  The value after the end is 0.
    """
    empty = F.array().cast("array<struct<advantage:double,return:double>>")
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("run"), empty.alias("out"))

    def back(acc: Column, s: Column) -> Column:
        live = s["m"] == 1
        delta = s["r"] + gamma * acc["next"] - s["v"]
        run = F.when(live, delta + gamma * lam * acc["run"]).otherwise(acc["run"])
        item = F.struct(run.alias("advantage"), (run + s["v"]).alias("return"))
        return F.struct(
            F.when(live, s["v"]).otherwise(acc["next"]).alias("next"),
            run.alias("run"),
            F.concat(acc["out"], F.array(item)).alias("out"),
        )

    zipped = F.zip_with(
        F.zip_with(rewards, values, lambda r, v: F.struct(r.alias("r"), v.alias("v"))),
        mask,
        lambda rv, m: F.struct(rv["r"].alias("r"), rv["v"].alias("v"), m.alias("m")),
    )
    return F.reverse(F.aggregate(F.reverse(zipped), start, back, lambda acc: acc["out"]))
