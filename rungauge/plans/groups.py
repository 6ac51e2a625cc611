"""Group signal and batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungauge.functions import times
from rungauge.operators import batches as bt
from rungauge.operators import groups as gr
from rungauge.plans import bindings as b
from rungauge.plans.registry import query
from rungauge.session import table

GROUPED = f"select rollout_id, uid, reward, tokens, n_turns, price from ({b.ROLLOUTS})"


@query("a13_zero_variance", f"""
with g as (select uid, min(reward) = max(reward) as zero from ({GROUPED}) group by 1)
select rollout_id, r.uid, zero as zero_adv from ({GROUPED}) r join g on g.uid = r.uid
""")
def _(spark, root):
    rows = b.rollouts(spark, root)
    return gr.mark_zero_variance(rows, ["uid"], "reward").select("rollout_id", "uid", "zero_adv")


@query("a13_zero_variance_counts", """
with g as (select strftime(o_orderdate, '%Y') as batch, o_custkey, min(o_orderstatus = 'F') = max(o_orderstatus = 'F') as zero,
                  count(*) as n from orders group by 1, 2)
select batch, count(*) as n_groups, count_if(zero) as n_zero, cast(sum(n) as bigint) as n_rows,
       cast(sum(case when zero then 0 else n end) as bigint) as n_rows_kept from g group by 1
""")
def _(spark, root):
    rows = table(spark, root, "orders").select(
        F.date_format("o_orderdate", "yyyy").alias("batch"),
        F.col("o_custkey").alias("uid"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("reward"),
    )
    return gr.zero_variance_counts(rows, ["uid"], "reward", ["batch"])


@query("a14_group_advantage", f"""
with g as (select uid, avg(reward) as m, stddev_samp(reward) as s, count(*) as n from ({GROUPED}) group by 1)
select rollout_id, round(case when n > 1 then (reward - m) / (s + 1e-6) else 0 end, 6) as advantage,
       case when tokens > 0 then round((case when n > 1 then (reward - m) / (s + 1e-6) else 0 end) / tokens, 8) end as token_weight,
       round(case when n > 1 then reward - m else 0 end, 6) as plain
from ({GROUPED}) r join g on g.uid = r.uid
""")
def _(spark, root):
    rows = b.rollouts(spark, root).select("rollout_id", "uid", "reward", "tokens")
    out = gr.group_advantage(rows, ["uid"], "reward", by_spread=False).withColumnRenamed("advantage", "plain")
    out = gr.group_advantage(out, ["uid"], "reward", "tokens")
    return out.select(
        "rollout_id",
        F.round("advantage", 6).alias("advantage"),
        F.round("token_weight", 8).alias("token_weight"),
        F.round("plain", 6).alias("plain"),
    )


@query("a15_median_length_reward", f"""
with m as (select uid, quantile_cont(greatest(tokens, 1), 0.5) as budget from ({GROUPED}) where reward > 0 group by 1)
select rollout_id, round(case when reward > 0 then least(1.0, greatest(0.1, budget / greatest(tokens, 1))) else 0 end, 6) as shaped
from ({GROUPED}) r left join m on m.uid = r.uid
""")
def _(spark, root):
    # One row per order, whatever the join makes of the size estimate.
    orders = table(spark, root, "orders")
    out = gr.median_length_reward(b.rollouts(spark, root), ["uid"], "reward", "tokens")
    return out.select("rollout_id", F.round("shaped", 6).alias("shaped"))


SHAPED = f"""
select rollout_id, uid, tokens, n_turns, price, reward as raw, reward > 0 as correct, price > 250000 as submitted,
       n_turns % 2 = 0 as guard_broken, case when n_f2p > 0 then n_f2p_pass / n_f2p else 0.0 end as partial,
       case when price < 480000 and reward >= 1 and n_turns > 3
            then 1.0 - 0.2 * least((n_turns - 3) / 5.0, 1.0) else reward end as turned
from ({b.ROLLOUTS})
"""
# The prompt penalty stacks on the turn penalty and is gated by the raw outcome.
STACKED = f"""
select *, case when not (price < 480000 and raw >= 1 and tokens > 100) then turned
               when tokens >= 180 then turned - 0.1 else turned - 0.1 * least((tokens - 100) / 80.0, 1.0) end as shaped
from ({SHAPED})
"""


def shaped(spark, root):
    rows = b.rollouts(spark, root)
    training = F.col("price") < 480000
    return rows.select(
        "rollout_id",
        "uid",
        "tokens",
        "n_turns",
        "price",
        F.col("reward").alias("raw"),
        (F.col("reward") > 0).alias("correct"),
        (F.col("price") > 250000).alias("submitted"),
        (F.col("n_turns") % 2 == 0).alias("guard_broken"),
        F.when(F.col("n_f2p") > 0, F.col("n_f2p_pass") / F.col("n_f2p")).otherwise(0.0).alias("partial"),
        gr.turn_penalty(F.col("reward"), F.col("n_turns"), 8, 3, 0.2, training).alias("turned"),
    ).withColumn(
        "shaped",
        gr.prompt_penalty(F.col("turned"), F.col("tokens"), 100, 180, 0.1, training, F.col("raw") >= 1),
    )


@query("t15_turn_penalty", f"""
select rollout_id, round(turned, 6) as shaped, turned <> raw as was_shaped from ({SHAPED})
""")
def _(spark, root):
    return shaped(spark, root).select(
        "rollout_id", F.round("turned", 6).alias("shaped"), (F.col("turned") != F.col("raw")).alias("was_shaped")
    )


@query("t16_prompt_penalty", f"""
select rollout_id, round(shaped, 6) as shaped, shaped <> turned as was_shaped from ({STACKED})
""")
def _(spark, root):
    return shaped(spark, root).select(
        "rollout_id", F.round("shaped", 6).alias("shaped"), (F.col("shaped") != F.col("turned")).alias("was_shaped")
    )


SLOPE = """
with r as ({rows}), g as (select uid, avg({x}) as mx, avg({y}) as my from r where {keep} group by 1 having count(*) >= 2),
     d as (select {x} - mx as dx, {y} - my as dy from r join g on g.uid = r.uid where {keep}),
     s as (select count(*) as n, sum(dx * dy) / sum(dx * dx) as b, sum(dx * dx) as sxx from d),
     e as (select any_value(n) as n, any_value(b) as b, any_value(sxx) as sxx, sum(pow(dy - b * dx, 2)) as rss from d, s)
select '{name}' as part, n, round(b, 8) as slope, round(sqrt(rss / (n - 2) / sxx), 8) as se,
       round(b / sqrt(rss / (n - 2) / sxx), 4) as t from e
"""


def slope_sql(name: str, keep: str, y: str = "shaped") -> str:
    return "select * from (" + SLOPE.format(rows=STACKED, x="n_turns", y=y, keep=keep, name=name) + ")"


@query("a22_within_group_slope", " union all ".join([
    slope_sql("all", "true"), slope_sql("submitted", "submitted"), slope_sql("not_submitted", "not submitted"),
]))
def _(spark, root):
    rows = shaped(spark, root)
    out = None
    for name, keep in (("all", None), ("submitted", F.col("submitted")), ("not_submitted", ~F.col("submitted"))):
        part = gr.within_group_slope(rows, ["uid"], "n_turns", "shaped", keep).withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select(
        "part", "n", F.round("slope", 8).alias("slope"), F.round("se", 8).alias("se"), F.round("t", 4).alias("t")
    )


@query("a23_within_group_contrast", f"""
with d as (select avg(shaped) filter (where submitted) - avg(shaped) filter (where not submitted) as d
           from ({STACKED}) group by uid)
select count(d) as n, round(avg(d), 6) as diff, round(stddev_samp(d) / sqrt(count(d)), 6) as se,
       round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 4) as t from d
""")
def _(spark, root):
    out = gr.within_group_contrast(shaped(spark, root), ["uid"], F.col("submitted"), "shaped")
    return out.select("n", F.round("diff", 6).alias("diff"), F.round("se", 6).alias("se"), F.round("t", 4).alias("t"))


@query("a24_variance_sources", f"""
with g as (select uid, min(shaped) = max(shaped) as z, min(raw) = max(raw) as zr from ({STACKED}) group by 1 having count(*) >= 2)
select case when z then 'zero' when zr then 'shaping_only' else 'task' end as source, count(*) as n_groups from g group by 1
""")
def _(spark, root):
    return gr.variance_sources(shaped(spark, root), ["uid"], "shaped", "raw")


@query("a25_shaping_audit", f"""
select count(*) as n, count_if(abs(raw - shaped) > 1e-9) as n_shaped,
       round(avg(raw - shaped) filter (where abs(raw - shaped) > 1e-9), 6) as mean_lost,
       round(max(raw - shaped) filter (where abs(raw - shaped) > 1e-9), 6) as max_lost,
       count_if(abs(raw - shaped) > 1e-9 and correct) as n_shaped_correct, count_if(guard_broken) as n_guard_broken,
       count_if(guard_broken and partial > 0) as n_guard_leaks from ({STACKED})
""")
def _(spark, root):
    out = gr.shaping_audit(shaped(spark, root), "shaped", "raw", "correct", "guard_broken", "partial")
    return out.withColumn("mean_lost", F.round("mean_lost", 6)).withColumn("max_lost", F.round("max_lost", 6))


@query("a26_reward_what_if", f"""
with r as ({STACKED}),
     g as (select uid, max(round(raw, 6)) > min(round(raw, 6)) as vo, max(round(partial, 6)) > min(round(partial, 6)) as vn,
                  max(raw) = 0 and min(raw) = 0 as f from r group by 1 having count(*) >= 2)
select count(*) as n_groups, count_if(not vo) as n_zero_old, count_if(not vn) as n_zero_new,
       count_if(vo and not vn) as n_lost, count_if(f) as n_all_fail, count_if(f and vn) as n_recovered,
       (select count_if(raw = 0) from r) as n_fail_rows, (select count_if(raw = 0 and partial > 0) from r) as n_partial_rows,
       (select round(avg(partial), 6) from r where raw = 0 and partial > 0) as mean_partial,
       (select round(avg(raw), 6) from r) as mean_old, (select round(avg(partial), 6) from r) as mean_new from g
""")
def _(spark, root):
    out = gr.reward_what_if(shaped(spark, root), ["uid"], "raw", "partial")
    for c in ("mean_partial", "mean_old", "mean_new"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("a27_length_shortcut", f"""
with r as ({STACKED}),
     g as (select uid, avg(partial) as m from r group by 1
           having count(*) >= 2 and max(round(partial, 6)) > min(round(partial, 6))),
     j as (select tokens, partial > m + 1e-9 as above from r join g on g.uid = r.uid)
select count_if(above) as n_above, count_if(not above) as n_rest,
       round(avg(tokens) filter (where above), 6) as tokens_above,
       round(avg(tokens) filter (where not above), 6) as tokens_rest,
       round(avg(tokens) filter (where above) - avg(tokens) filter (where not above), 6) as gap,
       (select round(corr(partial, tokens), 6) from r where raw = 0) as ratio_token_corr from j
""")
def _(spark, root):
    rows = shaped(spark, root)
    out = gr.length_shortcut(rows, ["uid"], "partial", "tokens")
    failed = rows.where("raw = 0").agg(F.corr("partial", "tokens")).scalar()
    for c in ("tokens_above", "tokens_rest", "gap"):
        out = out.withColumn(c, F.round(c, 6))
    return out.withColumn("ratio_token_corr", F.round(failed, 6))


ROUNDS = """
select strftime(o_orderdate, '%Y') as run, month(o_orderdate) as round, count(*) as n_groups, count_if(v) as n_valid
from (select date_trunc('month', o_orderdate) as o_orderdate, o_custkey, min(o_orderstatus) <> max(o_orderstatus) as v
      from orders group by 1, 2) group by 1, 2
"""


@query("w27_quota_rounds", f"""
select * from (select run, round, n_groups, n_valid,
   cast(coalesce(sum(n_valid) over (partition by run order by round rows between unbounded preceding and 1 preceding), 0) as bigint)
     as n_valid_before, row_number() over (partition by run order by round) as nth_round from ({ROUNDS}))
where n_valid_before < 25 and nth_round <= 10
""")
def _(spark, root):
    groups = table(spark, root, "orders").groupBy(
        F.date_format("o_orderdate", "yyyy").alias("run"), F.month("o_orderdate").alias("round"), "o_custkey"
    ).agg((F.min("o_orderstatus") != F.max("o_orderstatus")).alias("v"))
    rounds = groups.groupBy("run", "round").agg(
        F.count("*").alias("n_groups"), F.count_if("v").alias("n_valid")
    )
    return gr.quota_rounds(rounds, ["run"], "round", "n_valid", 25, 10)


def batches(spark, root):
    """Orders in monthly batches, with the group and the reward."""
    return table(spark, root, "orders").select(
        times.month_index(F.col("o_orderdate"), 1995).alias("batch"),
        F.col("o_orderkey").alias("rid"),
        F.col("o_custkey").alias("uid"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("score"),
        F.col("o_totalprice").alias("price"),
    )


BATCHES = """
select (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 as batch, o_orderkey as rid, o_custkey as uid,
       case when o_orderstatus = 'F' then 1.0 else 0.0 end as score, o_totalprice as price from orders
"""


@query("l06_mini_batch_fit", f"""
select batch, count(*) as n, greatest(0, count(*) - least(ceil(count(*) / 64) * 64, 192))::bigint as n_drop,
       greatest(0, least(ceil(count(*) / 64) * 64, 192) - count(*))::bigint as n_pad from ({BATCHES}) group by 1
""")
def _(spark, root):
    counts = batches(spark, root).groupBy("batch").agg(F.count("*").alias("n"))
    return bt.mini_batch_fit(counts, "n", 64, 3)


MARKED = f"""
select r.*, z from ({BATCHES}) r join (select batch, uid, min(score) = max(score) as z from ({BATCHES}) group by 1, 2) g
  on g.batch = r.batch and g.uid = r.uid
"""


@query("l07_drop_to_fit", f"""
with m as ({MARKED}), o as (select *, row_number() over (partition by batch
   order by case when z then 0 else 1 end, sha256('drop' || rid::varchar), rid) as at from m),
   c as (select batch, greatest(0, count(*) - least(ceil(count(*) / 64) * 64, 128)) as n_drop from m group by 1)
select o.batch, rid, case when "at" <= n_drop then case when z then 'same_reward' else 'random' end end as drop_reason
from o join c on c.batch = o.batch
""")
def _(spark, root):
    base = batches(spark, root)
    rows = gr.mark_zero_variance(base, ["batch", "uid"], "score")
    out = bt.drop_to_fit(rows, ["batch"], "rid", "zero_adv", 64, 2)
    return out.select("batch", "rid", "drop_reason")


@query("l08_neutral_padding", f"""
with r as ({BATCHES}), o as (select *, row_number() over (partition by batch order by sha256('pad' || rid::varchar), rid) as at,
   count(*) over (partition by batch) as n from r),
   c as (select batch, count(*) as n, (ceil(count(*) / 64) * 64 - count(*))::bigint as n_pad from r group by 1),
   k as (select batch, n, unnest(range(1, n_pad + 1)) as k from c)
select batch, rid::varchar as rid, uid::varchar as uid, score, price, false as is_pad from r union all
select o.batch, 'pad-' || o.batch || '-' || k, 'pad-' || o.batch || '-' || k, 0.0, price, true
from k join o on o.batch = k.batch and o.at = (k.k - 1) % k.n + 1
""")
def _(spark, root):
    return bt.neutral_padding(batches(spark, root), ["batch"], "rid", "uid", "score", 64)


@query("l09_row_shuffle", f"""
select batch, rid, uid, score, row_number() over (partition by batch order by sha256('s1' || rid::varchar), rid) as position
from ({BATCHES})
""")
def _(spark, root):
    return bt.shuffled(batches(spark, root).drop("price"), "s1", "rid", ["batch"])


@query("l11_step_sample_order", f"""
select batch, rid, row_number() over (order by batch, rid) as position from ({BATCHES})
""")
def _(spark, root):
    from rungauge.functions.rows import global_position

    rows = batches(spark, root).select("batch", "rid")
    return global_position(
        rows, ["batch"], ["rid"], "position"
    )


@query("l12_display_sample", """
with s as (select (conv_id % 12)::int as step, conv_id * 100 + turn as key, text from conversations),
     p as (select step, arg_max(key, sha256('show' || key::varchar)) as key, arg_max(text, sha256('show' || key::varchar)) as t
           from s where step = 1 or step % 5 = 0 group by 1)
select step, key, case when length(t) > 80 then substr(t, 1, 80) || chr(10) || '...[truncated ' || (length(t) - 80) || ' chars]'
       else t end as text, length(t) as n_chars from p
""")
def _(spark, root):
    rows = table(spark, root, "conversations").select(
        (F.col("conv_id") % 12).cast("int").alias("step"), (F.col("conv_id") * 100 + F.col("turn")).alias("key"), "text"
    )
    return bt.display_sample(rows, "step", "key", "text", "show", 5, 80)
