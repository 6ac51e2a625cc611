"""Monitor queries over the step series."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungauge.operators import monitor as mo
from rungauge.plans import bindings as b
from rungauge.plans.registry import query

BY = "partition by run order by step"
BASE = """
select *, row_number() over (partition by run order by step) as rn,
  count({v}) over (partition by run order by step) as seen,
  avg(case when k <= 2 then v end) over (partition by run) as base
from (select *, {v} as v, case when {v} is not null then count({v}) over (partition by run order by step) end as k from ({s}))
"""


def base(v: str, s: str = b.STEPS) -> str:
    return BASE.format(v=v, s=s)


@query("w02_consecutive_hits", f"""
with h as (select run, step, coalesce(reward < 0.3, false) as hit from ({b.STEPS}))
select run, step, hit and coalesce(lag(hit, 1) over ({BY}), false) and coalesce(lag(hit, 2) over ({BY}), false) as fired from h
""")
def _(spark, root):
    order = mo._order(["run"], "step")
    return b.steps(spark, root).select("run", "step", mo.consecutive(F.col("reward") < 0.3, 3, order).alias("fired"))


def collapse_sql(v: str, share: float) -> str:
    return f"""
select run, step, low and coalesce(lag(low) over ({BY}), false) and seen >= 3 and rn >= 3 as fired
from (select *, coalesce(v < {share} * base, false) as low from ({base(v)}))
"""


@query("w03_collapse", collapse_sql("reward", 0.40))
def _(spark, root):
    return mo.collapse(b.steps(spark, root), ["run"], "step", "reward", 0.40, "fired").select("run", "step", "fired")


DRIFT = f"""
select run, step, low and coalesce(lag(low) over ({BY}), false) and rn >= 3 as fired from (select *, row_number() over ({BY}) as rn,
  coalesce(response_length / avg(response_length) over ({BY} rows between 5 preceding and 1 preceding) < 0.55, false) as low from ({b.STEPS}))
"""


@query("w04_drift", DRIFT)
def _(spark, root):
    return mo.drift(b.steps(spark, root), ["run"], "step", "response_length", 0.55, "fired").select("run", "step", "fired")


SPIKE = f"""
with s as (select *, row_number() over ({BY}) as rn, count(grad_norm) over ({BY}) as seen, grad_norm is null or isnan(grad_norm) as bad from ({b.STEPS})),
 t as (select *, bad or coalesce(lag(bad) over ({BY}), false) as broken from s),
 p as (select run, seen, least(grad_norm, lag(grad_norm) over ({BY})) as lo, quantile_cont(grad_norm, 0.5) over ({BY} rows between 11 preceding and 2 preceding) as med
       from s where grad_norm is not null)
select t.run, step, rn >= 3 and case when broken then t.seen >= 2 else coalesce(t.seen >= 12 and med > 0 and lo > 10 * med, false) end as fired
from t left join p on p.run = t.run and p.seen = t.seen
"""


@query("w05_spike", SPIKE)
def _(spark, root):
    return mo.spike(b.steps(spark, root), ["run"], "step", "grad_norm", "fired").select("run", "step", "fired")


@query("w28_block_average", f"""
select run, (rn - 1) // 20 as block, min(step) as first_step, max(step) as last_step, count(*) as n_steps, round(avg(reward), 6) as reward,
  round(avg(response_length), 2) as response_length, bool_and(n_traced = n_rollouts) as complete
from (select *, row_number() over ({BY}) as rn from ({b.STEPS})) group by 1, 2
""")
def _(spark, root):
    out = mo.block_average(
        b.steps(spark, root), ["run"], "step", ["reward", "response_length"], F.col("n_traced") == F.col("n_rollouts")
    )
    return out.withColumn("reward", F.round("reward", 6)).withColumn("response_length", F.round("response_length", 2))


SHARES = f"""
select *, rn >= 3 and h3 and coalesce(lag(h3, 1) over ({BY}), false) and coalesce(lag(h3, 2) over ({BY}), false) as rule_3,
  rn >= 3 and h4 and coalesce(lag(h4) over ({BY}), false) as rule_4, rn >= 3 and h5 and coalesce(lag(h5) over ({BY}), false) as rule_5,
  merge_mismatch_rows >= 4 as rule_9, merge_mismatch_rows > 0 and merge_mismatch_rows < 4 as rule_91
from (select *, row_number() over ({BY}) as rn, groups_zero_adv / groups_seen > 0.6 as h3, n_traced / n_rollouts < 0.9 as h4,
        is_mean < 0.85 or is_mean > 1.15 as h5 from ({b.STEPS}))
"""


@query("w29_share_rules", f"select run, step, groups_seen, round(groups_zero_adv / groups_seen, 6) as zero_share, rule_3, rule_4, rule_5, rule_9, rule_91 from ({SHARES})")
def _(spark, root):
    out = mo.share_rules(b.steps(spark, root), ["run"], "step")
    return out.select(
        "run", "step", "groups_seen", F.round("zero_share", 6).alias("zero_share"), "rule_3", "rule_4", "rule_5", "rule_9", "rule_91"
    )


REPLAY = f"""
with f as (select run, step, 1 as rule from ({collapse_sql('response_length', 0.50)}) where fired
  union all select run, step, 2 from ({DRIFT}) where fired
  union all select run, step, 3 from ({SHARES}) where rule_3 union all select run, step, 4 from ({SHARES}) where rule_4
  union all select run, step, 5 from ({SHARES}) where rule_5 union all select run, step, 6 from ({SPIKE}) where fired
  union all select run, step, 7 from (select c.*, b.base, b.seen, b.rn from ({collapse_sql('reward', 0.40)}) c join ({base('reward')}) b on b.run = c.run and b.step = c.step)
            where fired or (base <= 0 and seen >= 3 and rn >= 3)
  union all select run, step, 9 from ({SHARES}) where rule_9 union all select run, step, 91 from ({SHARES}) where rule_91)
select run, rule, case when rule = 91 then 'warn' else 'stop' end as severity, min(step) as first_step, count(*) as n_steps from f group by 1, 2
"""


@query("w30_rule_replay", REPLAY)
def _(spark, root):
    return mo.first_firing(mo.alarms(mo.judge(b.steps(spark, root))))


@query("w31_pair_margin", f"""
with p as (select *, case when lead(reward) over ({BY}) is not null then greatest(reward, lead(reward) over ({BY})) end as pair from ({base('reward')}))
select run, round(min(pair), 6) as lowest_pair, round(max(base), 6) as baseline, round(min(pair) / nullif(max(base) * 0.4, 0), 6) as margin from p group by 1
""")
def _(spark, root):
    out = mo.pair_margin(b.steps(spark, root), ["run"], "step", "reward", 0.4)
    for c in ("lowest_pair", "baseline", "margin"):
        out = out.withColumn(c, F.round(c, 6))
    return out
