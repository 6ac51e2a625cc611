"""The driver tables in the roles the operators expect, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungauge.functions import times
from rungauge.session import table

# Two evaluated runs over the same ids.
RUN_A = "select o_orderkey as id, o_orderstatus = 'F' as resolved from orders"
RUN_B = "select o_orderkey as id, o_orderpriority in ('1-URGENT', '2-HIGH') as resolved from orders"


def run_a(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("resolved")
    )


def run_b(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("resolved"),
    )


# One row per rollout: an order with its line items as turns.
ROLLOUTS = """
select o_orderkey as rollout_id, o_custkey as uid, o_orderdate as ts, o_orderpriority as mode,
       case when o_orderstatus = 'F' then 1.0 else 0.0 end as reward,
       coalesce(n_turns, 0) as n_turns, coalesce(tokens, 0) as tokens, coalesce(n_f2p, 0) as n_f2p,
       coalesce(n_f2p_pass, 0) as n_f2p_pass, coalesce(n_p2p, 0) as n_p2p, coalesce(n_p2p_ok, 0) as n_p2p_ok,
       o_totalprice as price
from orders left join (
  select l_orderkey, count(*) as n_turns, cast(sum(l_quantity) as bigint) as tokens,
         count_if(l_returnflag <> 'N') as n_f2p, count_if(l_returnflag = 'R') as n_f2p_pass,
         count_if(l_returnflag = 'N') as n_p2p,
         count_if(l_returnflag = 'N' and l_linestatus = 'F') as n_p2p_ok
  from lineitem group by 1) on l_orderkey = o_orderkey
"""


def turns_per_rollout(spark: SparkSession, root: str) -> DataFrame:
    """Line items summed per order, merged map-side before the shuffle."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, root, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_turns"),
        F.sum("l_quantity").cast("long").alias("tokens"),
        F.count_if(flag != "N").alias("n_f2p"),
        F.count_if(flag == "R").alias("n_f2p_pass"),
        F.count_if(flag == "N").alias("n_p2p"),
        F.count_if((flag == "N") & (status == "F")).alias("n_p2p_ok"),
    )


def rollouts(spark: SparkSession, root: str) -> DataFrame:
    turns = turns_per_rollout(spark, root)
    counts = [c for c in turns.columns if c != "l_orderkey"]
    orders = table(spark, root, "orders")
    return orders.join(turns, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("o_orderkey").alias("rollout_id"),
        F.col("o_custkey").alias("uid"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("mode"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("reward"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.col("o_totalprice").alias("price"),
    )


# Trainer metric series: five runs (order priorities), one step per day.
STEPS = """
select run, step, avg(price) as response_length, avg(f) as reward, stddev_samp(price) as grad_norm,
       count(distinct cust) as groups_seen, count(distinct case when f = 0 then cust end) as groups_zero_adv,
       count(*) as n_rollouts, count(*) - sum(p) as n_traced, avg(price) / 250000.0 as is_mean,
       cast(sum(p * urgent) as bigint) as merge_mismatch_rows
from (select o_orderpriority as run, datediff('day', date '1995-01-01', cast(o_orderdate as date)) as step,
             o_totalprice as price, o_custkey as cust,
             case when o_orderstatus = 'F' then 1.0 else 0.0 end as f,
             case when o_orderstatus = 'P' and o_totalprice > 400000 then 1 else 0 end as p,
             case when o_orderpriority = '1-URGENT' then 4 else 1 end as urgent
      from orders)
group by 1, 2
"""


def steps(spark: SparkSession, root: str) -> DataFrame:
    """One row per run and day; the step series is small whatever the size of the runs."""
    f = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    lost = ((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)).cast("int")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 4).otherwise(1)
    price = F.col("o_totalprice")
    return (
        table(spark, root, "orders")
        .withColumn("step", times.day_index(F.col("o_orderdate"), "1995-01-01"))
        .groupBy(F.col("o_orderpriority").alias("run"), "step")
        .agg(
            F.avg(price).alias("response_length"),
            F.avg(f).alias("reward"),
            F.stddev_samp(price).alias("grad_norm"),
            F.count_distinct("o_custkey").alias("groups_seen"),
            F.count_distinct(F.when(f == 0.0, F.col("o_custkey"))).alias("groups_zero_adv"),
            F.count("*").alias("n_rollouts"),
            (F.count("*") - F.sum(lost)).alias("n_traced"),
            (F.avg(price) / 250000.0).alias("is_mean"),
            F.sum(lost * urgent).cast("long").alias("merge_mismatch_rows"),
        )
    )
