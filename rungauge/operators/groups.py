"""Group signal: zero-variance groups, relative advantages, shaped rewards and their audits.

A group statistic is an aggregate with map-side partial sums that is joined
back on the group key: a group with most of the rows is merged before the
shuffle, and the adaptive planner splits its side of the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungauge.functions import ranks
from rungauge.functions.guards import ratio, truthy


def join_groups(rows: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their group's statistics, keys matched null-safe."""
    renamed = stats
    on = None
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_gk_{i}")
        same = F.col(k).eqNullSafe(F.col(f"_gk_{i}"))
        on = same if on is None else on & same
    return rows.join(renamed, on, "left").drop(*[f"_gk_{i}" for i in range(len(keys))])


def varies(value: str, places: int | None = None) -> Column:
    """Aggregate: more than one distinct value, exactly or after rounding."""
    v = F.col(value) if places is None else F.round(F.col(value), places)
    return F.max(v) > F.min(v)


def mark_zero_variance(rows: DataFrame, uid: Sequence[str], reward: str) -> DataFrame:
    """Adds ``zero_adv``: every reward of the row's group is the same."""
    stats = rows.groupBy(*uid).agg((~truthy(varies(reward))).alias("zero_adv"))
    return join_groups(rows, stats, uid)


def zero_variance_counts(rows: DataFrame, uid: Sequence[str], reward: str, keys: Sequence[str] = ()) -> DataFrame:
    """Groups seen, groups without variance, rows kept and discarded."""
    per = rows.groupBy(*keys, *uid).agg(
        (~truthy(varies(reward))).cast("int").alias("_zero"), F.count("*").alias("_n")
    )
    return per.groupBy(*keys).agg(
        F.count("*").alias("n_groups"),
        F.sum("_zero").cast("long").alias("n_zero"),
        F.sum("_n").cast("long").alias("n_rows"),
        F.sum(F.when(F.col("_zero") == 0, F.col("_n")).otherwise(0)).cast("long").alias("n_rows_kept"),
    )


def group_advantage(
    rows: DataFrame, uid: Sequence[str], reward: str, tokens: str | None = None, by_spread: bool = True
) -> DataFrame:
    """(reward - group mean) / (sample sd + 1e-6), or the plain difference; a single row has 0.

    With ``tokens`` also the weight of one token, advantage / tokens.
    """
    stats = rows.groupBy(*uid).agg(
        F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_sd"), F.count("*").alias("_n")
    )
    out = join_groups(rows, stats, uid)
    centred = F.col(reward) - F.col("_mean")
    value = centred / (F.col("_sd") + 1e-6) if by_spread else centred
    out = out.withColumn("advantage", F.when(F.col("_n") > 1, value).otherwise(F.lit(0.0)))
    if tokens:
        out = out.withColumn("token_weight", ratio(F.col("advantage"), F.col(tokens)))
    return out.drop("_mean", "_sd", "_n")


def median_length_reward(
    rows: DataFrame, uid: Sequence[str], reward: str, length: str, floor: float = 0.1, **options
) -> DataFrame:
    """Correct rows score clip(median length of the group's correct rows / length, floor, 1).

    Wrong rows score 0, so a group without a correct row stays all zero.
    """
    size = F.greatest(F.col(length).cast("long"), F.lit(1))
    correct = rows.where(F.col(reward) > 0).withColumn("_size", size)
    budget = ranks.medians(correct, list(uid), "_size", "_budget", **options)
    out = join_groups(rows, budget, uid)
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(floor), F.col("_budget") / size))
    return out.withColumn("shaped", F.when(F.col(reward) > 0, scaled).otherwise(F.lit(0.0))).drop("_budget")


def turn_penalty(
    reward: Column, turns: Column, max_turns: int, start: int, weight: float, training: Column
) -> Column:
    """A solved training rollout loses up to ``weight`` between ``start`` and ``max_turns``."""
    share = F.least((turns - start) / float(max(1, max_turns - start)), F.lit(1.0))
    applies = truthy(training) & truthy(reward >= 1.0) & truthy(turns > start)
    return F.when(applies, 1.0 - weight * share).otherwise(reward)


def prompt_penalty(
    reward: Column, prompt_tokens: Column, soft: int, hard: int, weight: float, training: Column, solved: Column
) -> Column:
    """A solved training rollout loses up to ``weight`` between the soft and the hard prompt length."""
    share = F.least((prompt_tokens - soft) / float(max(1, hard - soft)), F.lit(1.0))
    applies = truthy(training) & truthy(solved) & truthy(prompt_tokens > soft)
    return (
        F.when(~applies, reward).when(prompt_tokens >= hard, reward - weight).otherwise(reward - weight * share)
    )


def within_group_slope(
    rows: DataFrame, groups: Sequence[str], x: str, y: str, keep: Column | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Least squares slope of y on x after taking out group means, with se, t and n.

    Centred sums per group are added up, so rows are read once and never joined
    back to their means.  Groups with fewer than two kept rows do not count;
    degrees of freedom are n - 2; null when n < 3 or x does not vary inside groups.
    """
    kept = rows if keep is None else rows.where(truthy(keep))
    kept = kept.select(
        *keys, *[g for g in groups if g not in keys], F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    per = kept.groupBy(*keys, *[g for g in groups if g not in keys]).agg(
        F.count("*").alias("_n"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"),
    ).where("_n >= 2")
    sums = per.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n"),
        F.sum("_sxx").alias("_sxx"),
        F.sum("_syy").alias("_syy"),
        F.sum("_sxy").alias("_sxy"),
    )
    usable = (F.col("n") >= 3) & (F.col("_sxx") > 0)
    slope = F.when(usable, F.try_divide("_sxy", "_sxx"))
    rest = F.greatest(F.col("_syy") - slope * F.col("_sxy"), F.lit(0.0))
    se = F.sqrt(F.try_divide(F.try_divide(rest, (F.col("n") - 2).cast("double")), F.col("_sxx")))
    return sums.select(*keys, "n", slope.alias("slope"), F.when(usable, se).alias("se"), F.when(usable, F.try_divide(slope, se)).alias("t"))


def within_group_contrast(rows: DataFrame, groups: Sequence[str], flag: Column, y: str) -> DataFrame:
    """Mean over groups of (mean y with the flag - mean y without); only groups with both."""
    per = rows.groupBy(*groups).agg(
        F.avg(F.when(truthy(flag), F.col(y))).alias("_with"), F.avg(F.when(~truthy(flag), F.col(y))).alias("_without")
    )
    diff = per.select((F.col("_with") - F.col("_without")).alias("_d")).where("_d is not null")
    sums = diff.agg(F.count("*").alias("n"), F.avg("_d").alias("_m"), F.stddev_samp("_d").alias("_sd"))
    enough = F.col("n") >= 3
    se = F.col("_sd") / F.sqrt("n")
    return sums.select(
        "n",
        F.when(enough, F.col("_m")).alias("diff"),
        F.when(enough, se).alias("se"),
        F.when(enough, F.try_divide(F.col("_m"), se)).alias("t"),
    )


def variance_sources(rows: DataFrame, groups: Sequence[str], shaped: str, raw: str, min_size: int = 2) -> DataFrame:
    """Groups by where their variance comes from: none, shaping alone, or the task."""
    per = rows.groupBy(*groups).agg(
        F.count("*").alias("_n"), truthy(varies(shaped)).alias("_s"), truthy(varies(raw)).alias("_r")
    ).where(F.col("_n") >= min_size)
    name = F.when(~F.col("_s"), "zero").when(~F.col("_r"), "shaping_only").otherwise("task")
    return per.groupBy(name.alias("source")).agg(F.count("*").alias("n_groups"))


def shaping_audit(rows: DataFrame, shaped: str, raw: str, correct: str, guard_broken: str, partial: str) -> DataFrame:
    """How often and how much shaping moved a reward, and whether a broken guard test ever paid."""
    lost = F.col(raw) - F.col(shaped)
    moved = F.abs(lost) > 1e-9
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(moved).alias("n_shaped"),
        F.avg(F.when(moved, lost)).alias("mean_lost"),
        F.max(F.when(moved, lost)).alias("max_lost"),
        F.count_if(moved & F.col(correct)).alias("n_shaped_correct"),
        F.count_if(truthy(F.col(guard_broken))).alias("n_guard_broken"),
        F.count_if(truthy(F.col(guard_broken)) & (F.col(partial) > 0)).alias("n_guard_leaks"),
    )


def reward_what_if(rows: DataFrame, groups: Sequence[str], old: str, new: str, min_size: int = 2) -> DataFrame:
    """Two reward forms on the same rollouts: groups with signal, lost, recovered, partial credit."""
    per = rows.groupBy(*groups).agg(
        F.count("*").alias("_n"),
        truthy(varies(old, 6)).alias("_old"),
        truthy(varies(new, 6)).alias("_new"),
        ((F.max(old) == 0) & (F.min(old) == 0)).alias("_fail"),
    ).where(F.col("_n") >= min_size)
    of_groups = per.agg(
        F.count("*").alias("n_groups"),
        F.count_if(~F.col("_old")).alias("n_zero_old"),
        F.count_if(~F.col("_new")).alias("n_zero_new"),
        F.count_if(F.col("_old") & ~F.col("_new")).alias("n_lost"),
        F.count_if("_fail").alias("n_all_fail"),
        F.count_if(F.col("_fail") & F.col("_new")).alias("n_recovered"),
    )
    part = (F.col(old) == 0) & (F.col(new) > 0)
    of_rows = rows.agg(
        F.count_if(F.col(old) == 0).alias("n_fail_rows"),
        F.count_if(part).alias("n_partial_rows"),
        F.avg(F.when(part, F.col(new))).alias("mean_partial"),
        F.avg(old).alias("mean_old"),
        F.avg(new).alias("mean_new"),
    )
    one = of_rows.withColumn("_one", F.lit(1))
    return of_groups.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")  # one row each


def length_shortcut(rows: DataFrame, groups: Sequence[str], reward: str, tokens: str, min_size: int = 2) -> DataFrame:
    """Mean tokens of rows above their group's mean reward minus the rest; groups that vary only."""
    stats = rows.groupBy(*groups).agg(
        F.count("*").alias("_n"), truthy(varies(reward, 6)).alias("_varies"), F.avg(reward).alias("_mean")
    ).where(F.col("_varies") & (F.col("_n") >= min_size))
    joined = join_groups(rows, stats, groups).where("_varies")
    # A mean of equal fractions may be off by rounding; that is not "above".
    above = F.col(reward) > F.col("_mean") + 1e-9
    return joined.agg(
        F.count_if(above).alias("n_above"),
        F.count_if(~above).alias("n_rest"),
        F.avg(F.when(above, F.col(tokens))).alias("tokens_above"),
        F.avg(F.when(~above, F.col(tokens))).alias("tokens_rest"),
    ).withColumn("gap", F.col("tokens_above") - F.col("tokens_rest"))


def quota_rounds(
    rounds: DataFrame, run: Sequence[str], round_no: str, n_valid: str, min_valid: int, max_rounds: int
) -> DataFrame:
    """Rounds drawn until enough valid groups are in hand or the rounds run out.

    One row per round comes in: the series is short, so a window per run is enough.
    """
    order = Window.partitionBy(*run).orderBy(round_no)
    before = F.sum(n_valid).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = rounds.withColumn("n_valid_before", F.coalesce(before, F.lit(0)).cast("long")).withColumn(
        "nth_round", F.row_number().over(order)
    )
    return out.where((F.col("n_valid_before") < min_valid) & (F.col("nth_round") <= max_rounds))
