"""Evaluation queries: summaries, paired tests, trends and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungauge.functions import times
from rungauge.functions.hashing import hash_order
from rungauge.operators import evaluation as ev
from rungauge.plans import bindings as b
from rungauge.plans.registry import query
from rungauge.session import table

PAIRED = f"select a.id, a.resolved as ra, b.resolved as rb from ({b.RUN_A}) a join ({b.RUN_B}) b on a.id = b.id"
COUNTS = f"""
select count(*) as n_common, count_if(ra and rb) as n_both, count_if(ra and not rb) as only_a,
       count_if(rb and not ra) as only_b, count_if(not ra and not rb) as n_neither,
       count_if(ra <> rb) as n_discordant
from ({PAIRED})
"""
# Exact two-sided binomial tail with every term, as log-gamma sums.
P_VALUE = """
case when {n} = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c})::bigint + 1),
  lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))))) end
"""


def p_value(b_: str, c_: str) -> str:
    return P_VALUE.format(b=b_, c=c_, n=f"({b_} + {c_})")


def results(spark, root):
    """Rollouts as evaluation results."""
    return b.rollouts(spark, root).select(
        F.col("rollout_id").alias("id"),
        "mode",
        "n_turns",
        "tokens",
        "n_f2p",
        "n_f2p_pass",
        "n_p2p",
        "n_p2p_ok",
        "price",
        "reward",
        ((F.col("n_f2p") == F.col("n_f2p_pass")) & (F.col("n_p2p") == F.col("n_p2p_ok"))).alias("resolved"),
        (F.col("price") > 480000).alias("timed_out"),
        F.when(F.col("price") > 470000, 124).otherwise(0).alias("rc"),
        (F.col("tokens") > 200).alias("overflowed"),
        (F.col("n_turns") > 1).alias("submitted"),
    )


RESULTS = f"""
select rollout_id as id, mode, n_turns, tokens, n_f2p, n_f2p_pass, n_p2p, n_p2p_ok, price, reward,
       n_f2p = n_f2p_pass and n_p2p = n_p2p_ok as resolved, price > 480000 as timed_out,
       case when price > 470000 then 124 else 0 end as rc, tokens > 200 as overflowed, n_turns > 1 as submitted
from ({b.ROLLOUTS})
"""


@query("a01_evaluation_summary", f"""
select n_done, n_resolved, n_any_f2p, f2p_pass, f2p_total, p2p_ok, p2p_total, n_timeout, n_overflow,
       round(n_resolved / n_done, 6) as resolved_rate, round(n_any_f2p / n_done, 6) as any_f2p_rate,
       round(f2p_pass / f2p_total, 6) as f2p_rate, round(p2p_ok / p2p_total, 6) as p2p_rate, n_planned,
       round(n_resolved / n_planned, 6) as resolved_of_planned
from (select count(*) as n_done, count_if(resolved) as n_resolved, count_if(n_f2p_pass > 0) as n_any_f2p,
             cast(sum(n_f2p_pass) as bigint) as f2p_pass, cast(sum(n_f2p) as bigint) as f2p_total,
             cast(sum(n_p2p_ok) as bigint) as p2p_ok, cast(sum(n_p2p) as bigint) as p2p_total,
             count_if(timed_out or rc = 124) as n_timeout, count_if(overflowed) as n_overflow,
             (select count(*) from orders) as n_planned
      from ({RESULTS}) where n_turns > 0)
""")
def _(spark, root):
    out = ev.evaluation_summary(
        results(spark, root).where("n_turns > 0"), table(spark, root, "orders").select("o_orderkey")
    )
    for c in ("resolved_rate", "any_f2p_rate", "f2p_rate", "p2p_rate", "resolved_of_planned"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("a02_reason_histogram", """
select reason, count(*) as n from (
  select case event_type when 'view' then 'ok' else substr(event_type || ': ' || props, 1, 60) end as reason
  from events) group by 1 order by n desc, reason limit 8
""")
def _(spark, root):
    reason = F.when(F.col("event_type") != "view", F.concat("event_type", F.lit(": "), "props"))
    return ev.reason_histogram(table(spark, root, "events").select(reason.alias("reason")), "reason")


@query("a03_paired_counts", COUNTS)
def _(spark, root):
    return ev.pair_counts(ev.paired(b.run_a(spark, root), b.run_b(spark, root)))


@query("a04_mcnemar_exact", f"select *, round({p_value('only_a', 'only_b')}, 6) as p_value from ({COUNTS})")
def _(spark, root):
    out = ev.with_mcnemar(ev.pair_counts(ev.paired(b.run_a(spark, root), b.run_b(spark, root))))
    return out.withColumn("p_value", F.round("p_value", 6))


MODE_COUNTS = f"""
select mode, count_if(ra and not rb) as only_a, count_if(rb and not ra) as only_b, count_if(ra <> rb) as n_discordant
from (select o_orderdate::date as mode, o_orderstatus = 'F' as ra, o_orderpriority in ('1-URGENT', '2-HIGH') as rb
      from orders) group by 1
"""


@query("a05_detectable_effect", f"""
with c as (select date_trunc('month', mode) as m, sum(n_discordant)::bigint as n from ({MODE_COUNTS}) group by 1),
     e as (select m, n, unnest(range(1, n + 1)) as net from c)
select strftime(c.m, '%Y-%m') as month, c.n as n_discordant,
       min(net) filter (where (c.n - net) % 2 = 0 and {p_value('(c.n - net) // 2', '(c.n + net) // 2')} < 0.05) as mde
from c left join e on e.m = c.m group by 1, 2
""")
def _(spark, root):
    month = F.date_format("o_orderdate", "yyyy-MM")
    pairs = table(spark, root, "orders").select(
        month.alias("month"),
        (F.col("o_orderstatus") == "F").alias("a_resolved"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("b_resolved"),
    )
    return ev.with_detectable(ev.pair_counts(pairs, ["month"])).select("month", "n_discordant", "mde")


@query("a06_verdict", f"""
with c as ({COUNTS}), p as (select *, n_both + only_a as a_resolved, n_both + only_b as b_resolved,
       {p_value('only_a', 'only_b')} as pv from c),
     nets as (select unnest(range(1, n_discordant::bigint + 1)) as net, n_discordant as n from c
              ),
     near as (select net, n from nets where (n - net) % 2 = 0 and net between floor(1.9 * sqrt(n)) and ceil(2.1 * sqrt(n)) + 4),
     m as (select min(net) as mde from near where {p_value('(n - net) // 2', '(n + net) // 2')} < 0.05)
select n_common, n_both, only_a, only_b, n_neither, n_discordant, a_resolved, b_resolved, round(pv, 6) as p_value,
       (select mde from m) as mde,
       case when n_common < 400 then 'INCOMPLETE' when b_resolved < a_resolved and pv < 0.05 then 'STOP'
            when b_resolved < a_resolved then 'CONTINUE_WARN' when b_resolved > a_resolved and pv < 0.05 then 'GAIN'
            else 'CONTINUE_FLAT' end as verdict
from p
""")
def _(spark, root):
    out = ev.verdict(ev.pair_counts(ev.paired(b.run_a(spark, root), b.run_b(spark, root))))
    return out.withColumn("p_value", F.round("p_value", 6))


SHARES = """
select strftime(l_shipdate, '%Y-%m') as step, avg(case when l_returnflag = 'R' then 1.0 else 0.0 end) as share,
       count(*) as n from lineitem group by 1
"""


@query("a07_proportion_curve", f"""
with s as ({SHARES}), z as (select s.*, b.step as s0, b.share as p0, sqrt(s.share * (1 - s.share) / s.n) as se,
   sqrt(s.share * (1 - s.share) / s.n + b.share * (1 - b.share) / b.n) as se2
   from s, (select * from s order by step limit 1) b)
select step, round(share, 6) as share, n, round(se, 6) as se, case when step <> s0 then round(share - p0, 6) end as delta,
       case when step <> s0 then round(case when se2 > 0 then (share - p0) / se2 else 0 end, 6) end as z,
       case when step = s0 then 'base' when se2 > 0 and (share - p0) / se2 >= 2 then 'up'
            when se2 > 0 and (share - p0) / se2 <= -2 then 'down' else 'within_noise' end as verdict
from z
""")
def _(spark, root):
    series = table(spark, root, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("step")).agg(
        F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("share"), F.count("*").alias("n")
    )
    out = ev.proportion_curve(series, "step", "share", "n")
    for c in ("share", "se", "delta", "z"):
        out = out.withColumn(c, F.round(c, 6))
    return out


T_TAIL = """
2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * list_sum(list_transform(range(0, 20000),
  lambda i: pow(1 + pow(tan(atan(abs(t)) + (pi() / 2 - atan(abs(t))) * (i + 0.5) / 20000), 2) / df, -(df + 1) / 2.0)
  * (pi() / 2 - atan(abs(t))) / 20000 / pow(cos(atan(abs(t)) + (pi() / 2 - atan(abs(t))) * (i + 0.5) / 20000), 2)))
"""


@query("a08_trend", f"""
with s as (select (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 as step, o_orderpriority as run,
                  count_if(o_orderstatus = 'F') as y from orders group by 1, 2),
     g as (select run, step, y, 'with_anchor' as form from s union all
           select run, step, y, 'probes_only' from s where step > 0),
     m as (select run, form, count(*) as k, avg(step) as mx, avg(y) as my from g group by 1, 2),
     d as (select g.run, g.form, any_value(k) as k, any_value(mx) as mx, any_value(my) as my,
                  sum((step - mx) * (step - mx)) as sxx, sum((step - mx) * (y - my)) as sxy
           from g join m using (run, form) group by 1, 2),
     e as (select *, sxy / sxx as slope, my - sxy / sxx * mx as intercept from d),
     r as (select g.run, g.form, any_value(k) as k, any_value(slope) as slope, any_value(intercept) as intercept,
                  any_value(sxx) as sxx, sum(pow(y - (intercept + slope * step), 2)) / (any_value(k) - 2) as s2
           from g join e using (run, form) group by 1, 2),
     f as (select *, k - 2 as df, sqrt(s2 / sxx) as se, slope / sqrt(s2 / sxx) as t from r),
     p as (select *, {T_TAIL} as p from f)
select run, form, k, df, round(slope, 6) as slope, round(intercept, 6) as intercept, round(se, 6) as se,
       round(t, 6) as t, round(p, 4) as p, round(sqrt(s2), 6) as residual_sd,
       case when k < 3 then 'too_few_points' when t >= 2 and p < 0.05 then 'rising'
            when t <= -2 and p < 0.05 then 'falling' else 'not_refuted' end as verdict
from p
""")
def _(spark, root):
    orders = table(spark, root, "orders")
    series = orders.groupBy(
        F.col("o_orderpriority").alias("run"), times.month_index(F.col("o_orderdate"), 1995).alias("step")
    ).agg(F.count_if(F.col("o_orderstatus") == "F").alias("y"))
    forms = F.when(F.col("step") > 0, F.array(F.lit("with_anchor"), F.lit("probes_only"))).otherwise(
        F.array(F.lit("with_anchor"))
    )
    out = ev.trend(series.withColumn("form", F.explode(forms)), "step", "y", ["run", "form"])
    for c in ("slope", "intercept", "se", "t", "residual_sd"):
        out = out.withColumn(c, F.round(c, 6))
    return out.withColumn("p", F.round("p", 4))


def two_runs(spark, root):
    """Rollouts as run A, the same ids with other outcomes as run B."""
    base = results(spark, root)
    shifted = base.select(
        "id",
        (F.col("n_p2p_ok") >= F.col("n_f2p_pass")).alias("resolved"),
        (F.col("n_turns") > 2).alias("submitted"),
        (F.col("price") > 460000).alias("timed_out"),
        (F.col("tokens") > 180).alias("overflowed"),
        (F.col("n_turns") + F.pmod(F.col("id"), F.lit(3)) - 1).alias("n_turns"),
        (F.col("tokens") + F.pmod(F.col("id"), F.lit(7))).alias("tokens"),
        "n_f2p",
        F.least(F.col("n_f2p_pass") + 1, F.col("n_f2p")).alias("n_f2p_pass"),
        "n_p2p",
        "n_p2p_ok",
    )
    return base, shifted


TWO_RUNS = f"""
select id, resolved as a_resolved, submitted as a_submitted, timed_out as a_timed_out, overflowed as a_overflowed,
       n_turns as a_n_turns, tokens as a_tokens, n_f2p_pass as a_pass,
       n_p2p_ok >= n_f2p_pass as b_resolved, n_turns > 2 as b_submitted, price > 460000 as b_timed_out,
       tokens > 180 as b_overflowed, n_turns + id % 3 - 1 as b_n_turns, tokens + id % 7 as b_tokens,
       least(n_f2p_pass + 1, n_f2p) as b_pass, n_f2p, n_p2p, n_p2p_ok
from ({RESULTS})
"""


@query("a09_paired_difference", f"""
with d as (select case when a_timed_out or n_f2p = 0 or n_p2p_ok <> n_p2p then 0.0 else a_pass / n_f2p end as a,
                  case when b_timed_out or n_f2p = 0 or n_p2p_ok <> n_p2p then 0.0 else b_pass / n_f2p end as b
           from ({TWO_RUNS}))
select 'dense' as metric, count(*) as n, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b,
       round(avg(b - a), 6) as diff, round(stddev_pop(b - a), 6) as sd,
       round(avg(b - a) / (stddev_pop(b - a) / sqrt(count(*))), 4) as t from d
""")
def _(spark, root):
    dense = ev.dense_ratio(
        F.col("n_f2p_pass"), F.col("n_f2p"), F.col("n_p2p_ok"), F.col("n_p2p"), F.col("timed_out")
    )
    a, c = (r.select("id", dense.alias("dense")) for r in two_runs(spark, root))
    out = ev.paired_panel(ev.paired(a, c, columns=["dense"]), ["dense"], population=True)
    for name in ("mean_a", "mean_b", "diff", "sd"):
        out = out.withColumn(name, F.round(name, 6))
    return out.withColumn("t", F.round("t", 4))


PANEL = {
    "submitted": ("a_submitted::int", "b_submitted::int"),
    "timed_out": ("a_timed_out::int", "b_timed_out::int"),
    "overflowed": ("a_overflowed::int", "b_overflowed::int"),
    "at_cap": ("(a_n_turns >= 6)::int", "(b_n_turns >= 6)::int"),
    "n_turns": ("a_n_turns", "b_n_turns"),
    "tokens": ("a_tokens", "b_tokens"),
    "resolved": ("a_resolved::int", "b_resolved::int"),
}
PANEL_SQL = " union all ".join(
    f"""select '{m}' as metric, count(*) as n, round(avg({x}), 6) as mean_a, round(avg({y}), 6) as mean_b,
        round(avg({y} - {x}), 6) as diff, round(stddev_samp({y} - {x}), 6) as sd,
        case when count(*) >= 3 and max({y} - {x}) > min({y} - {x})
             then round(avg({y} - {x}) / (stddev_samp({y} - {x}) / sqrt(count(*))), 4) end as t
        from ({TWO_RUNS}) where a_n_turns > 0"""
    for m, (x, y) in PANEL.items()
)


@query("a10_process_panel", PANEL_SQL)
def _(spark, root):
    a, c = two_runs(spark, root)
    # Rows that never ran a turn in the base run carry no process metrics.
    a = a.where("n_turns > 0")
    runs = [
        r.select(
            "id",
            *[F.col(m).cast("int").alias(m) for m in ("submitted", "timed_out", "overflowed", "resolved")],
            (F.col("n_turns") >= 6).cast("int").alias("at_cap"),
            "n_turns",
            "tokens",
        )
        for r in (a, c)
    ]
    out = ev.paired_panel(ev.paired(*runs, columns=list(PANEL)), list(PANEL))
    for name in ("mean_a", "mean_b", "diff", "sd"):
        out = out.withColumn(name, F.round(name, 6))
    return out.withColumn("t", F.round("t", 4))


CALLS = """
select strftime(ts, '%Y-%m-%d') as batch, case when event_type = 'error' or value > 300 then 'error'
       when cast(json_extract_string(props, '$.k') as int) < 5 then 'no_ids' else 'kept' end as outcome from events
"""


def calls(spark, root):
    """Events as model calls with their outcome."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, root, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("batch"),
        ev.capture_outcome(
            F.col("event_type"), F.when(F.col("value") > 300, 500).otherwise(200), k >= 5
        ).alias("outcome"),
    )


@query("a11_capture_tally", f"""
select batch, count(*) as n_calls, count_if(outcome = 'kept') as n_kept, count_if(outcome = 'error') as n_error,
       count_if(outcome = 'no_ids') as n_no_ids, round(count_if(outcome = 'kept') / count(*), 6) as rate,
       case when count_if(outcome = 'kept') / count(*) < 0.7 then 'fail'
            when count_if(outcome = 'kept') / count(*) < 0.9 then 'warn' else 'ok' end as state
from ({CALLS}) group by 1
""")
def _(spark, root):
    return ev.capture_tally(calls(spark, root), keys=["batch"], threshold=0.7).withColumn("rate", F.round("rate", 6))


@query("f11_capture_filter", f"select outcome, count(*) as n from ({CALLS}) group by 1")
def _(spark, root):
    return calls(spark, root).groupBy("outcome").agg(F.count("*").alias("n"))


@query("a12_pass_rate", """
select p_partkey as task, count(*) as n, round(avg(case when l_returnflag = 'R' then 1.0 else 0.0 end), 6) as pass_rate
from part join lineitem on l_partkey = p_partkey group by 1
""")
def _(spark, root):
    from rungauge.operators.curation import pass_rates

    attempts = table(spark, root, "lineitem").select(
        F.col("l_partkey").alias("task"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward")
    )
    return pass_rates(attempts, "task", "reward").withColumn("pass_rate", F.round("pass_rate", 6))


@query("a16_dense_reward", f"""
select id, case when timed_out or n_f2p = 0 or n_p2p_ok <> n_p2p then 0.0
           else round(n_f2p_pass / n_f2p, 6) end as dense from ({RESULTS})
""")
def _(spark, root):
    dense = ev.dense_ratio(
        F.col("n_f2p_pass"), F.col("n_f2p"), F.col("n_p2p_ok"), F.col("n_p2p"), F.col("timed_out")
    )
    return results(spark, root).select("id", F.round(dense, 6).alias("dense"))


@query("a17_step_metrics", f"""
with r as (select strftime(ts, '%Y-%m') as step, reward - case when price > 490000 then 2 else 0 end as reward,
                  n_turns, tokens, price from ({b.ROLLOUTS})),
     o as (select *, row_number() over (partition by step order by price) - 1 as i,
                  count(*) over (partition by step) as c from r)
select step, count(*) as n, round(avg(reward), 6) as reward_mean, count_if(reward >= 1) as n_resolved,
       count_if(reward < 0) as n_timeout, round(avg(n_turns), 6) as turns_mean, max(n_turns) as turns_max,
       round(avg(tokens), 6) as tokens_mean, max(tokens) as tokens_max, round(avg(price), 6) as duration_mean,
       max(price) as duration_max, max(case when i = round_even((c - 1) * 0.5, 0) then price end) as duration_p50,
       max(case when i = round_even((c - 1) * 0.9, 0) then price end) as duration_p90,
       round(count_if(reward >= 1) / count(*), 6) as resolve_rate
from o group by 1
""")
def _(spark, root):
    rows = b.rollouts(spark, root).select(
        F.date_format("ts", "yyyy-MM").alias("step"),
        (F.col("reward") - F.when(F.col("price") > 490000, 2.0).otherwise(0.0)).alias("reward"),
        "n_turns",
        "tokens",
        "price",
    )
    out = ev.step_metrics(rows, "step", "reward", "n_turns", "tokens", "price")
    for c in ("reward_mean", "turns_mean", "tokens_mean", "resolve_rate"):
        out = out.withColumn(c, F.round(c, 6))
    return out.withColumn("duration_mean", F.round("duration_mean", 6))


@query("a29_value_quality", """
with v as (select l_orderkey as o, case when l_returnflag = 'R' then 1.0 else 0.0 end as r, l_discount * 10 as v
           from lineitem), t as (select avg((r - v) * (r - v)) as m from v group by o)
select count(*) as n, (select count(*) from t) as n_trajectories, round(avg((r - v) * (r - v)), 9) as token_mse,
       (select round(avg(m), 9) from t) as trajectory_mse,
       round(1 - var_pop(r - v) / var_pop(r), 9) as explained_variance from v
""")
def _(spark, root):
    out = ev.value_quality(predictions(spark, root), "trajectory", "reward", "value")
    for c in ("token_mse", "trajectory_mse", "explained_variance"):
        out = out.withColumn(c, F.round(c, 9))
    return out


def predictions(spark, root):
    """Line items as value predictions per token."""
    return table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("trajectory"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"),
        (F.col("l_discount") * 10).alias("value"),
        "l_linestatus",
    )


@query("a29_calibration", """
select case when v >= 1 then 11 else cast(floor(v * 10) as bigint) + 1 end as bin, count(*) as n,
       round(avg(v), 6) as mean_value, round(avg(r), 6) as mean_reward
from (select case when l_returnflag = 'R' then 1.0 else 0.0 end as r, round(l_discount * 9.5 + 0.02, 4) as v from lineitem)
group by 1
""")
def _(spark, root):
    rows = table(spark, root, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"),
        F.round(F.col("l_discount") * 9.5 + 0.02, 4).alias("value"),
    )
    out = ev.calibration(rows, "reward", "value")
    return out.withColumn("mean_value", F.round("mean_value", 6)).withColumn("mean_reward", F.round("mean_reward", 6))


@query("a31_coverage", """
select case when l.doc_id is null then 'not_attempted' when toxic = 1 then 'unscored' when quality = 1 then 'resolved'
       else 'failed' end as outcome, count(*) as n
from documents d left join labels l on l.doc_id = d.doc_id group by 1
""")
def _(spark, root):
    scored = table(spark, root, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, F.lit(None).cast("string"))
        .when(F.col("quality") == 1, F.lit("resolved"))
        .otherwise(F.lit("failed"))
        .alias("outcome"),
    )
    return ev.coverage(table(spark, root, "documents"), scored, "doc_id", "outcome")


@query("a34_selection_bias", " union all ".join(f"""
select '{s}' as run, count(*) as n, count_if({s}_submitted) as n_submitted, count_if({s}_resolved) as n_resolved,
       count_if({s}_resolved and {s}_submitted) as n_resolved_submitted,
       count_if(a_submitted and b_submitted) as n_both_submitted,
       count_if(a_submitted and b_submitted and {s}_resolved) as n_resolved_both_submitted,
       round(count_if({s}_resolved) / count(*), 6) as resolved_rate,
       round(count_if({s}_submitted) / count(*), 6) as submitted_rate,
       round(count_if({s}_resolved and {s}_submitted) / count_if({s}_submitted), 6) as resolved_per_submitted,
       round(count_if(a_submitted and b_submitted and {s}_resolved) / count_if(a_submitted and b_submitted), 6)
         as resolved_per_both
from ({TWO_RUNS})""" for s in ("a", "b")))
def _(spark, root):
    out = ev.selection_bias(ev.paired(*two_runs(spark, root), columns=["submitted", "resolved"]))
    for c in ("resolved_rate", "submitted_rate", "resolved_per_submitted", "resolved_per_both"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("a35_condition_table", f"""
select mode, count(*) as n, count_if(resolved) as n_resolved, count_if(submitted) as n_submitted,
       count_if(submitted and resolved) as n_resolved_submitted, count_if(n_turns >= 6) as n_at_cap,
       count_if(timed_out) as n_timeout, count_if(mode <> '5-LOW' and tokens = 0) as n_hint_empty,
       quantile_cont(n_turns, 0.5) as median_turns
from ({RESULTS}) group by 1
""")
def _(spark, root):
    rows = results(spark, root).select(
        "*",
        F.when(F.col("mode") == "5-LOW", "none").otherwise(F.col("mode")).alias("hint_mode"),
        F.col("tokens").alias("hint_chars"),
    )
    return ev.condition_table(rows, "mode", cap=6)


@query("a36_throughput", """
with e as (select epoch_us(ts) // 1000000 as tt, value as wall from events), n as (select max(tt) as newest, count(*) as c from e),
     o as (select wall, row_number() over (order by wall) - 1 as i from e)
select count(*) as n, round((max(tt) - min(tt)) / 3600.0, 6) as span_hours,
       count_if(tt >= newest - 600) as last_10m, count_if(tt >= newest - 1200) as last_20m, count_if(tt >= newest - 1800) as last_30m,
       round(avg(wall), 6) as wall_mean, count_if(wall >= 250) as n_near_timeout, 1000000 - count(*) as remaining,
       count_if(tt >= newest - 600) * 6.0 as per_hour_10m, count_if(tt >= newest - 1200) * 3.0 as per_hour_20m,
       count_if(tt >= newest - 1800) * 2.0 as per_hour_30m, round(count(*) / ((max(tt) - min(tt)) / 3600.0), 4) as per_hour,
       (select wall from o, n where i = c // 2) as wall_p50, (select wall from o, n where i = floor(c * 0.9)) as wall_p90
from e, n
""")
def _(spark, root):
    rows = table(spark, root, "events").select(
        times.epoch_seconds(F.col("ts")).alias("at"), F.col("value").alias("wall")
    )
    out = ev.throughput(rows, "at", "wall", 1000000, near_timeout=250)
    return (
        out.withColumn("span_hours", F.round("span_hours", 6))
        .withColumn("wall_mean", F.round("wall_mean", 6))
        .withColumn("per_hour", F.round("per_hour", 4))
    )


@query("a39_judge_agreement", """
with j as (select d.source as g, d.n_chars as s, l.quality = 1 as y from documents d join labels l on l.doc_id = d.doc_id),
     c as (select s, count_if(y) as p, count_if(not y) as q from j group by 1),
     w as (select p, q, coalesce(sum(q) over (order by s rows between unbounded preceding and 1 preceding), 0) as b from c),
     cg as (select g, s, count_if(y) as p, count_if(not y) as q from j group by 1, 2),
     wg as (select g, p, q, coalesce(sum(q) over (partition by g order by s rows between unbounded preceding and 1 preceding), 0) as b from cg)
select (select count(*) from j) as n, (select count_if(s >= 2000 and y) from j) as tp,
       (select count_if(s >= 2000 and not y) from j) as fp, (select count_if(s < 2000 and y) from j) as fn,
       (select count_if(s < 2000 and not y) from j) as tn,
       (select round(count_if((s >= 2000) = y) / count(*), 6) from j) as accuracy,
       (select round(sum(p * (b + q / 2.0)) / (sum(p) * sum(q)), 6) from w) as auc,
       (select cast(sum(p * b) as bigint) from wg) as pairs_right,
       (select cast(sum(x) as bigint) from (select sum(p) * sum(q) as x from wg group by g)) as pairs_total
""")
def _(spark, root):
    rows = (
        table(spark, root, "documents")
        .join(table(spark, root, "labels"), "doc_id")
        .select("source", "n_chars", (F.col("quality") == 1).alias("truth"))
    )
    out = ev.judge_agreement(rows, "source", "n_chars", "truth", 2000)
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("auc", F.round("auc", 6))


@query("a40_termination", """
select case event_type when 'purchase' then 'submit' when 'error' then 'infra_error' when 'signup' then 'turn_limit'
       when 'view' then 'wall_timeout' else 'loop_detected' end as reason, value > 10 as scored, count(*) as n
from events group by 1, 2
""")
def _(spark, root):
    names = {"purchase": "submit", "error": "infra_error", "signup": "turn_limit", "view": "wall_timeout"}
    reason = F.lit("loop_detected")
    for event, name in names.items():
        reason = F.when(F.col("event_type") == event, name).otherwise(reason)
    rows = table(spark, root, "events").select(reason.alias("reason"), (F.col("value") > 10).alias("scored"))
    return ev.termination_breakdown(rows, "reason", "scored")


@query("a41_format_share", """
select count(*) as n, count_if(contains(lower(text), 'the')) as n_format,
       round(count_if(contains(lower(text), 'the')) / count(*), 6) as share,
       count(*) >= 50 and count_if(contains(lower(text), 'the')) / count(*) < 0.45 as passes from documents
""")
def _(spark, root):
    out = ev.format_share_gate(table(spark, root, "documents"), "text", word="the")
    return out.withColumn("share", F.round("share", 6))


@query("a42_probe_gate", """
with s as (select o_orderpriority as run, o_orderstatus = 'F' as resolved from orders
           where substr(sha256('probe' || o_orderkey::varchar), 1, 1) = '0')
select run, count(*) as n, count_if(resolved) as n_resolved,
       case when count(*) < 190 then 'incomplete' when count_if(resolved) < 62 then 'collapse' else 'ok' end as state
from s group by 1
""")
def _(spark, root):
    # The fixed subset is the feature here: a probe runs a hash-chosen share of the tasks.
    fixed = table(spark, root, "orders").where(
        F.substring(hash_order("probe", F.col("o_orderkey")), 1, 1) == "0"
    )
    rows = fixed.select(F.col("o_orderpriority").alias("run"), (F.col("o_orderstatus") == "F").alias("resolved"))
    return ev.probe_gate(rows, 190, 62, ["run"])


@query("j05_run_pairs", """
with r as (select o_orderkey as id, 'a' as run, o_orderstatus = 'F' as resolved from orders union all
           select o_orderkey, 'b', o_orderpriority in ('1-URGENT', '2-HIGH') from orders union all
           select o_orderkey, 'c', o_totalprice > 250000 from orders where o_orderstatus <> 'O')
select x.run as run_a, y.run as run_b, count(*) as n_common, count_if(x.resolved and y.resolved) as n_both,
       count_if(x.resolved and not y.resolved) as only_a, count_if(y.resolved and not x.resolved) as only_b,
       count_if(not x.resolved and not y.resolved) as n_neither, count_if(x.resolved <> y.resolved) as n_discordant
from r x join r y on x.id = y.id and x.run < y.run group by 1, 2
""")
def _(spark, root):
    third = (
        table(spark, root, "orders")
        .where("o_orderstatus <> 'O'")
        .select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 250000).alias("resolved"))
    )
    runs = [b.run_a(spark, root), b.run_b(spark, root), third]
    union = None
    for name, run in zip("abc", runs):
        named = run.withColumn("run", F.lit(name))
        union = named if union is None else union.unionByName(named)
    return ev.run_pairs(union)
