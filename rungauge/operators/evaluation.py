"""Evaluation analytics: summaries, paired tests, trends, panels, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungauge.functions import ranks, stats
from rungauge.functions.guards import first_reason, ratio, truthy
from rungauge.functions.ordered import running


def whole(column: Column) -> Column:
    return column.cast("long")


def evaluation_summary(results: DataFrame, planned: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Done, resolved, test totals, timeouts and overflows; rates over done and over planned.

    Every rate stands next to its numerator and denominator, and is null when
    there is nothing to divide by.
    """
    out = results.groupBy(*keys).agg(
        F.count("*").alias("n_done"),
        F.count_if(F.col("resolved")).alias("n_resolved"),
        F.count_if(F.col("n_f2p_pass") > 0).alias("n_any_f2p"),
        whole(F.sum("n_f2p_pass")).alias("f2p_pass"),
        whole(F.sum("n_f2p")).alias("f2p_total"),
        whole(F.sum("n_p2p_ok")).alias("p2p_ok"),
        whole(F.sum("n_p2p")).alias("p2p_total"),
        F.count_if(truthy(F.col("timed_out")) | truthy(F.col("rc") == 124)).alias("n_timeout"),
        F.count_if(truthy(F.col("overflowed"))).alias("n_overflow"),
    )
    out = out.select(
        "*",
        ratio(F.col("n_resolved"), F.col("n_done")).alias("resolved_rate"),
        ratio(F.col("n_any_f2p"), F.col("n_done")).alias("any_f2p_rate"),
        ratio(F.col("f2p_pass"), F.col("f2p_total")).alias("f2p_rate"),
        ratio(F.col("p2p_ok"), F.col("p2p_total")).alias("p2p_rate"),
    )
    if planned is None:
        return out
    plan = planned.groupBy(*keys).agg(F.count("*").alias("n_planned"))
    joined = out.join(plan, list(keys), "full") if keys else out.select("*", plan.scalar().alias("n_planned"))
    return joined.withColumn("resolved_of_planned", ratio(F.col("n_resolved"), F.col("n_planned")))


def reason_histogram(rows: DataFrame, reason: str, top: int = 8, width: int = 60) -> DataFrame:
    """Most frequent reasons, cut to a width; a missing reason is ``ok``."""
    text = F.when(F.length(F.col(reason)) > 0, F.col(reason))
    cut = F.substring(F.coalesce(text, F.lit("ok")), 1, width)
    return (
        rows.groupBy(cut.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(top)
    )


def paired(a: DataFrame, b: DataFrame, key: str = "id", columns: Sequence[str] = ("resolved",)) -> DataFrame:
    """Two runs on their common ids: each column once as ``a_`` and once as ``b_``."""
    left = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select(F.col(key).alias("_id"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return left.join(right, F.col(key) == F.col("_id")).drop("_id")


def run_pairs(results: DataFrame, run: str = "run", key: str = "id", resolved: str = "resolved") -> DataFrame:
    """Outcome counts of every pair of runs over their common ids.

    Ids are first counted by their pattern (which runs hold the id, with what
    outcome).  Runs are few, so patterns are few, and only patterns are expanded
    into pairs of runs; no id is.
    """
    outcome = F.struct(F.col(run).alias("run"), F.col(resolved).alias("ok"))
    patterns = (
        results.groupBy(key)
        .agg(F.array_sort(F.collect_set(outcome)).alias("_p"))
        .groupBy("_p")
        .agg(F.count("*").alias("_n"))
    )
    first = patterns.select("_p", "_n", F.explode("_p").alias("_a"))
    pairs = first.select("_n", "_a", F.explode("_p").alias("_b")).where(F.col("_a.run") < F.col("_b.run"))
    a, b = F.col("_a.ok"), F.col("_b.ok")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(0)).cast("long")

    return pairs.groupBy(F.col("_a.run").alias("run_a"), F.col("_b.run").alias("run_b")).agg(
        F.sum("_n").cast("long").alias("n_common"),
        total(a & b).alias("n_both"),
        total(a & ~b).alias("only_a"),
        total(~a & b).alias("only_b"),
        total(~a & ~b).alias("n_neither"),
    ).withColumn("n_discordant", F.col("only_a") + F.col("only_b"))


def pair_counts(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """both, only A, only B, neither and discordant counts."""
    a, b = F.col("a_resolved"), F.col("b_resolved")
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n_common"),
        F.count_if(a & b).alias("n_both"),
        F.count_if(a & ~b).alias("only_a"),
        F.count_if(~a & b).alias("only_b"),
        F.count_if(~a & ~b).alias("n_neither"),
    ).withColumn("n_discordant", F.col("only_a") + F.col("only_b"))


def with_mcnemar(counts: DataFrame) -> DataFrame:
    return counts.withColumn("p_value", stats.mcnemar_p(F.col("only_a"), F.col("only_b")))


def with_detectable(counts: DataFrame) -> DataFrame:
    return counts.withColumn("mde", stats.smallest_detectable(F.col("n_discordant")))


def verdict(counts: DataFrame, min_pairs: int = 400, alpha: float = 0.05) -> DataFrame:
    """Run A is the baseline, run B the probe; the same test for rises and falls."""
    out = with_detectable(with_mcnemar(counts)).select(
        "*",
        (F.col("n_both") + F.col("only_a")).alias("a_resolved"),
        (F.col("n_both") + F.col("only_b")).alias("b_resolved"),
    )
    lower, higher = F.col("b_resolved") < F.col("a_resolved"), F.col("b_resolved") > F.col("a_resolved")
    clear = F.col("p_value") < alpha
    rule = (
        F.when(F.col("n_common") < min_pairs, "INCOMPLETE")
        .when(lower & clear, "STOP")
        .when(lower, "CONTINUE_WARN")
        .when(higher & clear, "GAIN")
        .otherwise("CONTINUE_FLAT")
    )
    return out.withColumn("verdict", rule)


def proportion_curve(series: DataFrame, step: str, share: str, n: str, pooled: bool = False) -> DataFrame:
    """Each step's share against the first step: difference, z and verdict at two sigma."""
    base = series.agg(
        F.min_by(share, step).alias("_p0"), F.min_by(n, step).alias("_n0"), F.min(step).alias("_s0")
    )
    joined = series.withColumn("_one", F.lit(1)).join(
        F.broadcast(base.withColumn("_one", F.lit(1))), "_one"  # one row
    )
    z = stats.two_proportion_z(F.col(share), F.col(n), F.col("_p0"), F.col("_n0"), pooled)
    first = F.col(step) == F.col("_s0")
    return joined.select(
        step,
        share,
        n,
        stats.proportion_se(F.col(share), F.col(n)).alias("se"),
        F.when(~first, F.col(share) - F.col("_p0")).alias("delta"),
        F.when(~first, z).alias("z"),
        F.when(first, "base")
        .when(z >= 2, "up")
        .when(z <= -2, "down")
        .otherwise("within_noise")
        .alias("verdict"),
    )


def trend(series: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least squares of y on x: slope, its standard error, t, two-sided p and residual sd.

    With fewer than three points there is a slope but no error; with no spread
    in x there is no slope either.
    """
    sums = series.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("k"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_sxx(F.col(y), F.col(x)).alias("_sxx"),
        F.regr_syy(F.col(y), F.col(x)).alias("_syy"),
    )
    out = sums.withColumn("df", F.col("k") - 2)
    rss = F.greatest(F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx"), F.lit(0.0))
    out = out.withColumn("_s2", F.when(F.col("df") >= 1, rss / F.col("df")))
    out = out.withColumn("se", F.sqrt(F.try_divide(F.col("_s2"), F.col("_sxx"))))
    out = out.withColumn("t", F.try_divide(F.col("slope"), F.col("se")))
    return out.select(
        *keys,
        "k",
        "df",
        "slope",
        "intercept",
        "se",
        "t",
        stats.t_two_sided_p(F.col("t"), F.col("df")).alias("p"),
        F.sqrt("_s2").alias("residual_sd"),
        first_reason(
            [
                ("too_few_points", F.col("k") < 3),
                ("rising", (F.col("t") >= 2) & (stats.t_two_sided_p(F.col("t"), F.col("df")) < 0.05)),
                ("falling", (F.col("t") <= -2) & (stats.t_two_sided_p(F.col("t"), F.col("df")) < 0.05)),
                ("not_refuted", F.lit(True)),
            ]
        ).alias("verdict"),
    )


def paired_panel(pairs: DataFrame, metrics: Sequence[str], population: bool = False) -> DataFrame:
    """Mean of each metric in both runs, paired difference and its t.

    All metrics are aggregated in one pass over the pairs and turned into rows
    afterwards.  t is null below three pairs or without spread.
    """
    spread = F.stddev_pop if population else F.stddev_samp
    columns = []
    for m in metrics:
        a, b = F.col(f"a_{m}").cast("double"), F.col(f"b_{m}").cast("double")
        both = a.isNotNull() & b.isNotNull()
        d = b - a
        columns.append(
            F.struct(
                F.lit(m).alias("metric"),
                F.count_if(both).alias("n"),
                F.avg(F.when(both, a)).alias("mean_a"),
                F.avg(F.when(both, b)).alias("mean_b"),
                F.avg(d).alias("diff"),
                spread(d).alias("sd"),
                (F.max(d) > F.min(d)).alias("_varies"),
            ).alias(m)
        )
    one = pairs.agg(*columns)
    rows = one.select(F.explode(F.array(*metrics)).alias("r")).select("r.*")
    t = F.col("diff") / (F.col("sd") / F.sqrt("n"))
    return rows.withColumn("t", F.when((F.col("n") >= 3) & F.col("_varies"), t)).drop("_varies")


def dense_ratio(n_pass: Column, n_f2p: Column, n_ok: Column, n_p2p: Column, timed_out: Column) -> Column:
    """Share of wanted tests that pass; 0 after a timeout, a broken guard test or with no wanted test."""
    zero = (
        truthy(timed_out)
        | F.coalesce(n_f2p == 0, F.lit(True))
        | truthy(n_p2p.isNotNull() & ~n_ok.eqNullSafe(n_p2p))
    )
    return F.when(zero, F.lit(0.0)).otherwise(F.coalesce(n_pass, F.lit(0)) / n_f2p.cast("double"))


def step_metrics(
    rollouts: DataFrame, step: str, reward: str, turns: str, tokens: str, duration: str, **options
) -> DataFrame:
    """Per step: counts, means, maxima and the index percentiles of the duration."""
    sums = rollouts.groupBy(step).agg(
        F.count("*").alias("n"),
        F.avg(F.col(reward)).alias("reward_mean"),
        F.count_if(F.col(reward) >= 1.0).alias("n_resolved"),
        F.count_if(F.col(reward) < 0.0).alias("n_timeout"),
        F.avg(turns).alias("turns_mean"),
        F.max(turns).alias("turns_max"),
        F.avg(tokens).alias("tokens_mean"),
        F.max(tokens).alias("tokens_max"),
        F.avg(duration).alias("duration_mean"),
        F.max(duration).alias("duration_max"),
    )
    quantiles = ranks.value_at(
        rollouts, [step], duration,
        {"duration_p50": ranks.index_round(0.5), "duration_p90": ranks.index_round(0.9)}, **options,
    )
    return sums.join(quantiles, step, "left").withColumn("resolve_rate", ratio(F.col("n_resolved"), F.col("n")))


def capture_tally(calls: DataFrame, outcome: str = "outcome", keys: Sequence[str] = (), threshold: float = 0.0) -> DataFrame:
    """Calls, kept and dropped by cause, rate and its verdict; no calls at all is an error row."""
    out = calls.groupBy(*keys).agg(
        F.count("*").alias("n_calls"),
        F.count_if(F.col(outcome) == "kept").alias("n_kept"),
        F.count_if(F.col(outcome) == "error").alias("n_error"),
        F.count_if(F.col(outcome) == "no_ids").alias("n_no_ids"),
    ).withColumn("rate", ratio(F.col("n_kept"), F.col("n_calls")))
    return out.withColumn(
        "state",
        F.when(F.col("n_calls") == 0, "no_calls")
        .when(F.lit(threshold > 0) & (F.col("rate") < threshold), "fail")
        .when(F.col("rate") < max(threshold, 0.9), "warn")
        .otherwise("ok"),
    )


def capture_outcome(status: Column, http_status: Column, has_ids: Column) -> Column:
    """What became of one model call: kept, error or no_ids."""
    return (
        F.when(truthy(status == "error") | truthy(http_status >= 400), "error")
        .when(~truthy(has_ids), "no_ids")
        .otherwise("kept")
    )


def coverage(plan: DataFrame, scored: DataFrame, key: str, outcome: str) -> DataFrame:
    """Planned ids by outcome; an id without a scored row is ``not_attempted``, never a failure."""
    got = scored.select(F.col(key).alias("_id"), F.col(outcome).alias("_outcome"))
    joined = plan.select(key).join(got, F.col(key) == F.col("_id"), "left")
    name = F.when(F.col("_id").isNull(), "not_attempted").otherwise(F.coalesce("_outcome", F.lit("unscored")))
    return joined.groupBy(name.alias("outcome")).agg(F.count("*").alias("n"))


def selection_bias(pairs: DataFrame) -> DataFrame:
    """resolved = submitted x resolved/submitted in both runs, and on ids submitted in both."""
    sides = []
    for side in ("a", "b"):
        submitted, resolved = F.col(f"{side}_submitted"), F.col(f"{side}_resolved")
        both = F.col("a_submitted") & F.col("b_submitted")
        sides.append(
            F.struct(
                F.lit(side).alias("run"),
                F.count("*").alias("n"),
                F.count_if(submitted).alias("n_submitted"),
                F.count_if(resolved).alias("n_resolved"),
                F.count_if(resolved & submitted).alias("n_resolved_submitted"),
                F.count_if(both).alias("n_both_submitted"),
                F.count_if(both & resolved).alias("n_resolved_both_submitted"),
            ).alias(side)
        )
    rows = pairs.agg(*sides).select(F.explode(F.array("a", "b")).alias("r")).select("r.*")
    return rows.select(
        "*",
        ratio(F.col("n_resolved"), F.col("n")).alias("resolved_rate"),
        ratio(F.col("n_submitted"), F.col("n")).alias("submitted_rate"),
        ratio(F.col("n_resolved_submitted"), F.col("n_submitted")).alias("resolved_per_submitted"),
        ratio(F.col("n_resolved_both_submitted"), F.col("n_both_submitted")).alias("resolved_per_both"),
    )


def condition_table(rows: DataFrame, condition: str, cap: int = 40, **options) -> DataFrame:
    """Per condition: n, resolved, submitted, resolved of submitted, at the turn cap, median turns, timeouts, empty hints."""
    counts = rows.groupBy(condition).agg(
        F.count("*").alias("n"),
        F.count_if("resolved").alias("n_resolved"),
        F.count_if("submitted").alias("n_submitted"),
        F.count_if(F.col("submitted") & F.col("resolved")).alias("n_resolved_submitted"),
        F.count_if(F.col("n_turns") >= cap).alias("n_at_cap"),
        F.count_if(truthy(F.col("timed_out"))).alias("n_timeout"),
        F.count_if((F.col("hint_mode") != "none") & (F.coalesce("hint_chars", F.lit(0)) == 0)).alias("n_hint_empty"),
    )
    middle = ranks.medians(rows, [condition], "n_turns", "median_turns", **options)
    return counts.join(middle, condition, "left")


def throughput(
    results: DataFrame, at: str, wall: str, planned: int | Column, minutes: Sequence[int] = (10, 20, 30),
    near_timeout: float = 590.0,
) -> DataFrame:
    """Done, remaining, span, rates overall and over the last minutes, wall percentiles.

    ``at`` is in seconds; "now" is the newest result, so a replay gives the same
    answer.
    """
    now = results.agg(F.max(at)).scalar()
    recent = [
        F.count_if(F.col(at) >= now - m * 60).alias(f"last_{m}m") for m in minutes
    ]
    sums = results.agg(
        F.count("*").alias("n"),
        ((F.max(at) - F.min(at)) / 3600.0).alias("span_hours"),
        *recent,
        F.avg(wall).alias("wall_mean"),
        F.count_if(F.col(wall) >= near_timeout).alias("n_near_timeout"),
    )
    quantiles = ranks.value_at(
        results, [], wall, {"wall_p50": ranks.index_half(), "wall_p90": ranks.index_tail(0.9)}
    )
    out = sums.select("*", (F.lit(planned) - F.col("n")).alias("remaining"))
    for m in minutes:
        out = out.withColumn(f"per_hour_{m}m", F.col(f"last_{m}m") * 60.0 / m)
    out = out.withColumn("per_hour", F.try_divide(F.col("n").cast("double"), F.col("span_hours")))
    one = quantiles.withColumn("_one", F.lit(1))
    return out.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")  # one row each


def judge_agreement(rows: DataFrame, group: str, score: str, truth: str, threshold: float) -> DataFrame:
    """Confusion counts, accuracy, AUC and the share of within-group pairs ordered right.

    Both AUC and the pair share come from cumulative counts over the distinct
    scores, so no pair is ever formed: a wrong row scores half a win against its
    equals and a full one against every right row above it.
    """
    call = F.col(score) >= threshold
    right = F.col(truth)
    counts = rows.agg(
        F.count("*").alias("n"),
        F.count_if(call & right).alias("tp"),
        F.count_if(call & ~right).alias("fp"),
        F.count_if(~call & right).alias("fn"),
        F.count_if(~call & ~right).alias("tn"),
    ).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("n")))

    overall = _pair_wins(rows, [], score, truth).select(
        F.try_divide(F.col("wins"), F.col("pairs")).alias("auc"), F.lit(1).alias("_one")
    )
    inside = (
        _pair_wins(rows, [group], score, truth)
        .agg(F.sum("strict").cast("long").alias("pairs_right"), F.sum("pairs").cast("long").alias("pairs_total"))
        .withColumn("_one", F.lit(1))
    )
    one = counts.withColumn("_one", F.lit(1))
    return one.join(F.broadcast(overall), "_one").join(F.broadcast(inside), "_one").drop("_one")  # one row each


def _pair_wins(rows: DataFrame, keys: Sequence[str], score: str, truth: str) -> DataFrame:
    tallied = rows.groupBy(*keys, score).agg(
        F.count_if(F.col(truth)).alias("_pos"), F.count_if(~F.col(truth)).alias("_neg")
    )
    upto = running(tallied, keys, [score], {"_neg_upto": ("sum", F.col("_neg"))})
    below = F.col("_neg_upto") - F.col("_neg")
    return upto.groupBy(*keys).agg(
        F.sum(F.col("_pos") * (below + F.col("_neg") / 2.0)).alias("wins"),
        F.sum(F.col("_pos") * below).alias("strict"),
        (F.sum("_pos") * F.sum("_neg")).alias("pairs"),
    )


# Fixed value: every way an episode can end.
TERMINATION_REASONS = [
    "submit", "turn_limit", "context_limit", "generation_limit", "loop_detected", "wall_timeout", "infra_error",
    "format_limit",
]


def termination_breakdown(rows: DataFrame, reason: str, scored: str) -> DataFrame:
    """Episodes by reason, apart by scored or not; a reason outside the list fails the job."""
    known = F.col(reason).isin(TERMINATION_REASONS)
    checked = F.when(F.assert_true(truthy(known), F.lit("unknown termination reason")).isNull(), F.col(reason))
    return rows.groupBy(checked.alias("reason"), F.col(scored).alias("scored")).agg(F.count("*").alias("n"))


def format_share_gate(rows: DataFrame, text: str, min_rows: int = 50, limit: float = 0.45, word: str = "format") -> DataFrame:
    """Share of rows whose reason mentions the format; passes below the limit with enough rows."""
    out = rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.lower(F.coalesce(F.col(text), F.lit(""))).contains(word)).alias("n_format"),
    ).withColumn("share", ratio(F.col("n_format"), F.col("n")))
    return out.withColumn("passes", (F.col("n") >= min_rows) & (F.coalesce("share", F.lit(1.0)) < limit))


def probe_gate(results: DataFrame, min_rows: int, min_resolved: int, keys: Sequence[str] = ()) -> DataFrame:
    """Too few results is incomplete, too few resolved a collapse, else ok."""
    out = results.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(truthy(F.col("resolved"))).alias("n_resolved")
    )
    return out.withColumn(
        "state",
        F.when(F.col("n") < min_rows, "incomplete").when(F.col("n_resolved") < min_resolved, "collapse").otherwise("ok"),
    )


def value_quality(rows: DataFrame, trajectory: str, reward: str, value: str, bins: int = 10) -> DataFrame:
    """Token MSE, mean MSE per trajectory and explained variance of value predictions.

    Shards are joined as raw rows first: explained variances of shards are never
    averaged.  The variance ratio is null when the rewards do not vary.
    """
    error = F.col(reward) - F.col(value)
    tokens = rows.agg(
        F.count("*").alias("n"),
        F.avg(error * error).alias("token_mse"),
        F.var_pop(error).alias("_ve"),
        F.var_pop(reward).alias("_vr"),
    )
    each = rows.groupBy(trajectory).agg(F.avg(error * error).alias("_mse"))
    per = each.agg(F.count("*").alias("n_trajectories"), F.avg("_mse").alias("trajectory_mse"))
    one = tokens.withColumn("_one", F.lit(1)).join(F.broadcast(per.withColumn("_one", F.lit(1))), "_one")
    return one.select(
        "n", "n_trajectories", "token_mse", "trajectory_mse",
        F.when(F.col("_vr") > 0, 1.0 - F.col("_ve") / F.col("_vr")).alias("explained_variance"),
    )


def calibration(rows: DataFrame, reward: str, value: str, bins: int = 10) -> DataFrame:
    """Mean prediction and mean reward per value bin of [0, 1]; outside values keep their own bins."""
    bin_no = F.width_bucket(F.col(value), F.lit(0.0), F.lit(1.0), F.lit(bins))
    return rows.groupBy(bin_no.cast("long").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.avg(reward).alias("mean_reward")
    )


def token_conservation(steps: DataFrame, step: str, counts: Sequence[str]) -> DataFrame:
    """Per step the token counts of every stage and whether all agree."""
    out = steps.groupBy(step).agg(*[F.sum(c).cast("long").alias(c) for c in counts])
    same = F.lit(True)
    for c in counts[1:]:
        same = same & (F.col(c) == F.col(counts[0]))
    return out.withColumn("conserved", same)
