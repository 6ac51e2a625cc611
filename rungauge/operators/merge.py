"""Turning captured turns into training rows.

A turn continues its predecessor when its prompt begins with the predecessor's
prompt and response, so a break is a property of two neighbours.  It is found from
hashes of a prompt's beginning, taken at the predecessor's lengths; rows are found
with running lengths over (rollout, turn).  What a turn adds to a row is only its
observation and its response, never the whole prompt.  A row's tokens are gathered
last, and only up to the row's length limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungauge.functions import arrays
from rungauge.functions.guards import first_reason, truthy
from rungauge.functions.ordered import Scan, hot_groups
from rungauge.shared import cut_lineage

# --- guards ---------------------------------------------------------------------------


def reward_reason(require_approval: bool = False) -> Column:
    """Why a rollout's reward must not be trained on, null when it may.

    Needs reward (nullable double), error_message and events:
    array<struct<event_type, data: struct<reward_eligible, evaluation_state, value>>>.
    A missing reward is a reason, never a zero.
    """
    reward = F.col("reward")
    events = F.coalesce(F.col("events"), F.array().cast(
        "array<struct<event_type:string,data:struct<reward_eligible:boolean,evaluation_state:string,value:double>>>"
    ))
    given = F.filter(events, lambda e: truthy(e["event_type"] == "reward"))
    bad_value = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    approved = lambda d: truthy(d["reward_eligible"]) & truthy(d["evaluation_state"] == "complete")
    rules = [
        ("missing_or_non_finite", bad_value(reward)),
        ("runner_error", F.length(F.coalesce("error_message", F.lit(""))) > 0),
        ("malformed_event", F.exists(events, lambda e: e.isNull())),
        ("malformed_reward_event", F.exists(given, lambda e: e["data"].isNull())),
        ("evaluator_rejected", F.exists(given, lambda e: e["data"]["reward_eligible"] == F.lit(False))),
    ]
    if require_approval:
        rules += [
            ("missing_approval", (F.size(given) == 0) | F.exists(given, lambda e: ~approved(e["data"]))),
            (
                "approved_value_disagrees",
                F.exists(given, lambda e: bad_value(e["data"]["value"]) | (e["data"]["value"] != reward)),
            ),
        ]
    return first_reason(rules)


def alignment_reason(turns: Column) -> Column:
    """Why a rollout's turns do not line up with their log-probs, null when they do."""
    return first_reason(
        [
            ("missing_ids", F.exists(turns, lambda t: ~truthy(F.size(t["response"]) > 0))),
            ("missing_logprobs", F.exists(turns, lambda t: t["logp"].isNull())),
            ("length_mismatch", F.exists(turns, lambda t: F.size(t["logp"]) != F.size(t["response"]))),
        ]
    )


# --- continuity -------------------------------------------------------------------------


NO_IDS = "array<int>"


def _same(key: Sequence[str], left: str, right: str) -> Column:
    """Equal keys of two sides (null equals null), the columns of each under a prefix."""
    return reduce(and_, [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) for k in key])


def _joined(rows: DataFrame, more: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``more``, which has one row per key."""
    named = more.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[c for c in more.columns if c not in key])
    return rows.join(named, _same(key, "", "_k_"), how).drop(*[f"_k_{k}" for k in key])


# Turns of one rollout up to which a rollout's ids may meet in one task.
DEALT_TURNS = 20_000


IN_PLACE = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _in_place(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside leave rows where they are when both sides are dealt by a part of the join's keys."""
    before = spark.conf.get(IN_PLACE, None)
    spark.conf.set(IN_PLACE, "false")
    try:
        yield
    finally:
        spark.conf.unset(IN_PLACE) if before is None else spark.conf.set(IN_PLACE, before)


def _dealt_by_key(rows: DataFrame, key: Sequence[str]) -> bool:
    """True when no rollout is so long that its rows must be spread: all steps can then share one shuffle by rollout."""
    return not hot_groups(rows.select(*key), key, DEALT_TURNS)[1]


def _dealt(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` shuffled by ``_key``, the key columns as one value, in which null equals null.

    Joins on the key and more, and groups by the key and more, find their rows in place.
    """
    return rows.select(F.struct(*key).alias("_key"), *[c for c in rows.columns if c not in key]).repartition("_key")


def _beside(rows: DataFrame, more: DataFrame, key: Sequence[str], by: str, how: str = "inner") -> DataFrame:
    """``_joined`` by key and ``by`` for ``rows`` that are dealt by ``_key``; the other side is dealt likewise, nothing else moves."""
    named = _dealt(more, key).withColumnsRenamed({"_key": "_other", by: "_by"})
    return rows.join(named, (F.col("_key") == F.col("_other")) & F.col(by).eqNullSafe(F.col("_by")), how).drop("_other", "_by")


def _sizes(turns: DataFrame, key: Sequence[str], turn: str) -> DataFrame:
    """Lengths and hashes of each turn's ids, without the ids."""
    prompt, response = F.coalesce("prompt", F.array().cast(NO_IDS)), F.coalesce("response", F.array().cast(NO_IDS))
    return turns.select(
        *key, turn, F.size(prompt).alias("n_prompt"), F.size(response).alias("n_resp"), F.xxhash64(prompt).alias("_hp"), F.xxhash64(response).alias("_hr")
    )


def _based(scan: Scan, turn: str) -> Scan:
    """Adds ``_base``, the turn whose prompt an empty one builds on, and the length its prompt then has."""
    scan.add(_upto=("sum", F.col("n_resp")), _place=("sum", F.lit(1)))
    scan.column("_empty", (F.col("n_prompt") == 0) & (F.col("_place") > 1))
    before = F.col("_upto") - F.col("n_resp")
    scan.add(_base=("last", F.when(~F.col("_empty"), F.col(turn))), _shift=("last", F.when(~F.col("_empty"), F.col("n_prompt") - before)))
    scan.column("_fills", F.col("_empty"))
    return scan.column("n_prompt", F.when(F.col("_fills"), (F.col("_shift") + before).cast("int")).otherwise(F.col("n_prompt")))


def fill_prompts(turns: DataFrame, key: Sequence[str], turn: str, wanted: DataFrame | None = None, **options) -> DataFrame:
    """An empty later prompt becomes the predecessor's prompt plus response.

    Several empty prompts in a row build on the last prompt that is there.  Where
    each ends follows from running lengths; the responses of a run are put behind
    its one prompt once, and every prompt is cut from that.  The result is as long as
    the prompts it writes out.  With ``wanted`` (key, turn) only those turns come back;
    ``continuity(..., fill=True)`` needs none of them.
    """
    scan = _based(Scan(_sizes(turns, key, turn), key, [turn], **options), turn)
    rows = scan.add(_follows=("next", F.col("_fills"))).rows()
    fills = rows.where("_fills").select(*key, turn, "_base", F.col("n_prompt").alias("_n"))
    needed = fills if wanted is None else _joined(fills, wanted.select(*key, turn).distinct(), [*key, turn])
    runs = [*key, "_base"]
    asked = needed.groupBy(*runs).agg(F.max("_n").alias("_most"), F.array_sort(F.collect_list(F.struct(turn, "_n"))).alias("_ends"))
    members = rows.where(F.col("_fills") | truthy(F.col("_follows"))).select(*key, turn, "_base")
    parts = _joined(turns.select(*key, turn, "response"), members, [*key, turn])
    behind = parts.groupBy(*runs).agg(F.array_sort(F.collect_list(F.struct(turn, "response"))).alias("_parts"))
    bases = turns.select(*key, F.col(turn).alias("_base"), F.col("prompt").alias("_first"))
    whole = _joined(_joined(asked, behind, runs), bases, runs)
    none = F.array().cast(NO_IDS)
    ids = F.concat("_first", F.flatten(F.transform("_parts", lambda x: F.coalesce(x["response"], none))))
    whole = whole.select(*key, F.slice(ids, F.lit(1), F.col("_most")).alias("_ids"), "_ends")  # put together once per run, before its turns are listed
    whole = whole.select(*key, "_ids", F.explode("_ends").alias("_end"))
    filled = whole.select(*key, F.col(f"_end.{turn}").alias(turn), F.slice("_ids", F.lit(1), F.col("_end._n")).alias("_filled"))
    if wanted is None:
        out = _joined(turns, filled, [*key, turn], "left")
    else:
        out = _joined(_joined(turns, wanted.select(*key, turn).distinct(), [*key, turn]), filled, [*key, turn], "left")
    return out.withColumn("prompt", F.coalesce("_filled", "prompt")).drop("_filled")


def continuity(turns: DataFrame, key: Sequence[str], turn: str, codec=None, fill: bool = False, **options) -> DataFrame:
    """How each turn follows the one before it: first, ids, text or broken.

    Returns key, turn, n_prompt, n_resp, n_obs (ids that the prompt adds),
    ``continuity``, ``continues`` and ``observation``, which holds ids only where the
    text continues and the ids do not.  (key, turn) is unique in ``turns``.

    Ids never pass through a window: the predecessor's lengths and hashes do, and a
    prompt's beginning is hashed at those lengths where the prompt is read.  ``codec``
    is a column function (prompt ids, context ids) -> observation ids or null, asked
    only where the ids do not match.  ``fill`` takes empty later prompts for the
    predecessor's prompt plus response, without writing them out.
    """
    at = [*key, turn]
    by_key = not fill and _dealt_by_key(turns, key)
    parts = ["_key"] if by_key else list(key)
    sizes = _sizes(turns, key, turn)
    if not fill:
        sizes = sizes.withColumn("_h", F.xxhash64("_hp", "_hr")).drop("_hp", "_hr")  # both are only ever asked for together
    hashes = ["_hp", "_hr"] if fill else ["_h"]
    scan = Scan(sizes.select(F.struct(*key).alias("_key"), *sizes.columns[len(key):]) if by_key else sizes, parts, [turn], **options)
    if fill:
        _based(scan, turn)
    else:
        scan.column("_fills", F.lit(False)).column("_base", F.lit(None).cast(turns.schema[turn].dataType))
    scan.add(_before=("prev", F.struct(F.col(turn).alias("turn"), "n_prompt", "n_resp", *hashes, "_fills", F.col("_base").alias("base"))))
    rows = scan.rows()
    sizes = rows.select(*parts, turn, "n_prompt", "n_resp", "_fills", "_before")
    if fill:
        # What stood before a prompt that ends a run of filled ones: its base and the responses since, as lengths and hashes.
        ends = rows.where(~F.col("_fills") & truthy(F.col("_before._fills"))).select(*key, F.col("_before.base").alias("_base"))
        part = F.struct(F.col(turn).alias("t"), F.col("n_resp").alias("n"), F.col("_hr").alias("h"))
        runs = _joined(rows, ends.distinct(), [*key, "_base"]).groupBy(*key, "_base").agg(
            F.array_sort(F.collect_list(part)).alias("_parts"), F.max(F.when(~F.col("_fills"), F.struct(F.col("n_prompt").alias("n"), F.col("_hp").alias("h")))).alias("_root")
        )
        sizes = _joined(sizes.withColumn("_base", F.when(~F.col("_fills") & truthy(F.col("_before._fills")), F.col("_before.base"))), runs, [*key, "_base"], "left").drop("_base")
    prompts = turns.select(*at, "prompt")
    read = _beside(sizes, prompts, key, turn).select("_key.*", "*").drop("_key") if by_key else _joined(prompts, sizes, at)
    prompt, before = F.col("prompt"), F.col("_before")
    hashed = lambda start, n: F.xxhash64(F.slice(prompt, start + 1, n))
    piece = lambda start, n, h: hashed(start, n) == h
    known = before["n_prompt"] + before["n_resp"]
    if not fill:
        same = F.xxhash64(hashed(F.lit(0), before["n_prompt"]), hashed(before["n_prompt"], before["n_resp"])) == before["_h"]
    else:
        same = piece(F.lit(0), before["n_prompt"], before["_hp"]) & piece(before["n_prompt"], before["n_resp"], before["_hr"])
        start = F.struct(F.col("_root.n").alias("at"), piece(F.lit(0), F.col("_root.n"), F.col("_root.h")).alias("ok"))
        step = lambda acc, x: F.struct((acc["at"] + x["n"]).alias("at"), (acc["ok"] & piece(acc["at"], x["n"], x["h"])).alias("ok"))
        same = F.when(F.col("_parts").isNotNull(), F.aggregate("_parts", start, step, lambda acc: acc["ok"])).otherwise(same)
    by_ids = F.col("_fills") | truthy((F.size(F.coalesce(prompt, F.array().cast(NO_IDS))) >= known) & same)
    how = F.when(before.isNull(), "first").when(by_ids, "ids").otherwise("broken")
    out = read.withColumns({"continuity": how, "n_obs": F.when(how == "ids", F.col("n_prompt") - known).otherwise(0)})
    with _in_place(turns.sparkSession):
        links = cut_lineage(out.select(*at, "n_prompt", "n_resp", "n_obs", "continuity", before["turn"].alias("_earlier")), "links")
    if codec is None:
        links = links.withColumn("observation", F.lit(None).cast(NO_IDS))
    else:
        asked = links.where("continuity = 'broken'").select(*at, "_earlier")
        earlier = asked.select(*key, F.col("_earlier").alias(turn))
        source = fill_prompts(turns, key, turn, earlier, **options) if fill else turns
        context = source.select(*key, F.col(turn).alias("_earlier"), F.concat("prompt", "response").alias("_context"))
        asked = _joined(_joined(asked, context, [*key, "_earlier"]), turns.select(*at, "prompt"), at)
        found = asked.select(*at, codec(F.col("prompt"), F.col("_context")).alias("observation")).where("observation is not null")
        links = _joined(links, cut_lineage(found, "text-links"), at, "left")
        links = links.withColumns({"continuity": F.when(F.col("observation").isNotNull(), "text").otherwise(F.col("continuity")), "n_obs": F.when(F.col("observation").isNotNull(), F.size("observation")).otherwise(F.col("n_obs"))})
    return links.drop("_earlier").withColumn("continues", F.col("continuity").isin("ids", "text"))


def divergence(pairs: DataFrame, expected: str, actual: str, width: int = 60) -> DataFrame:
    """First difference of two id sequences, its kind, and a window of each around it."""
    a, b = F.col(expected), F.col(actual)
    index = arrays.first_difference(a, b)
    out = pairs.withColumn("diverge_index", index)
    shared = F.least(F.size(a), F.size(b))
    return (
        out.withColumn("diverge_kind", F.when(F.col("diverge_index") == shared, "ran_out").otherwise("token_differs"))
        .withColumn("expected_window", arrays.window_around(a, F.col("diverge_index"), width))
        .withColumn("actual_window", arrays.window_around(b, F.col("diverge_index"), width))
    )


# --- rows ---------------------------------------------------------------------------------


def _cuts(rows: DataFrame, long: DataFrame, part: Sequence[str], turn: str, max_prompt: int, max_response: int, cut_type: str) -> DataFrame:
    """Where the rows of ``long`` parts begin: the lengths of turns that may open one, folded in order."""
    openers = _joined(rows.where((F.col("n_prompt") <= max_prompt) | ~F.col("continues")), long, part)
    lengths = openers.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), "n_obs", "n_resp", F.col("_upto").alias("end")))).alias("_turns"))
    start = F.struct(F.lit(0).alias("len"), F.lit(-1).alias("i"), F.array().cast(cut_type).alias("cuts"))

    def place(acc: Column, x: Column) -> Column:
        i = acc["i"] + 1
        projected = acc["len"] + x["n_obs"] + x["n_resp"]
        cut = (i == 0) | (projected > max_response)
        here = F.struct(x["t"].alias("t"), (x["end"] - x["n_resp"]).alias("at"))
        return F.struct(
            F.when(cut, x["n_resp"]).otherwise(projected).alias("len"),
            i.alias("i"),
            F.when(cut, F.array_append(acc["cuts"], here)).otherwise(acc["cuts"]).alias("cuts"),
        )

    return lengths.select(*part, F.aggregate("_turns", start, place, lambda a: a["cuts"]).alias("_cuts"))


def merged_rows(links: DataFrame, key: Sequence[str], turn: str, max_prompt: int, max_response: int, policy: str = "split", **options) -> DataFrame:
    """Where each turn of ``links`` (from ``continuity``) goes: ``segment``, ``row_start`` and ``begin``, what it takes of its row.

    Only lengths are used.  Policies for a broken continuation: ``split`` opens a new
    row, ``drop`` leaves the whole rollout out, ``keep_terminal`` keeps only the last
    contiguous part.  The last two are for chains that must stay whole: one that does
    not fit the limits is an error, it is neither cut nor split.  ``policy_counts``
    counts what a policy leaves out.

    A part that fits ``max_response`` is one row.  In a longer one prompts only grow,
    so turns whose prompt still fits ``max_prompt`` are at most that many; only their
    lengths are gathered to place the cuts.  A later turn can not open a row and
    stays in the last one, counted as ``blocked``.
    """
    scan = Scan(links.drop("observation"), key, [turn], **options)
    breaks = F.when(F.col("continuity") == "broken", 1).otherwise(0)
    scan.add(segment=("sum", breaks), _upto=("sum", F.col("n_obs") + F.col("n_resp")), **({} if policy == "split" else {"_last": ("total", breaks)}))
    first_turn = ~F.col("continues")
    scan.add(_start=("last", F.when(first_turn, F.col("_upto") - F.col("n_resp"))), _first=("last", F.when(first_turn, F.struct(F.col(turn).alias("t")))))
    rows = scan.rows().withColumns({"segment": F.col("segment").cast("long"), "_upto": F.col("_upto") - F.col("_start")}).drop("_start")
    if policy != "split":
        rows = rows.where(F.col("_last") == 0) if policy == "drop" else rows.where(F.col("segment") == F.col("_last"))
        rows = rows.drop("_last")
    part = [*key, "segment"]
    rows = cut_lineage(rows, "parts")
    long = rows.groupBy(*part).agg(F.max("_upto").alias("_total")).where(F.col("_total") > max_response).drop("_total")
    cut_type = f"array<struct<t:{rows.schema[turn].dataType.simpleString()},at:bigint>>"
    if long.isEmpty():
        rows = rows.withColumn("_cuts", F.lit(None).cast(cut_type))
    else:
        rows = _joined(rows, _cuts(rows, long, part, turn, max_prompt, max_response, cut_type), part, "left")
    rows = rows.withColumn("_cut", F.array_max(F.filter("_cuts", lambda c: c["t"] <= F.col(turn))))
    rows = rows.withColumns({"row_start": F.coalesce("_cut.t", "_first.t"), "_over": F.col("_upto") - F.coalesce("_cut.at", F.lit(0))})
    rows = rows.withColumn("opens_row", truthy(F.col("row_start") == F.col(turn)))
    begin = F.when(F.col("opens_row"), 0).otherwise(F.col("_over") - F.col("n_obs") - F.col("n_resp"))
    blocked = ~F.col("opens_row") & (F.col("_over") > max_response) & (F.col("n_prompt") > max_prompt)
    out = rows.withColumns({"begin": begin.cast("long"), "blocked": blocked}).drop("_cuts", "_cut", "_over", "_upto", "_first")
    return out if policy == "split" else out.where(_whole(max_prompt, max_response, key, turn))


def _whole(max_prompt: int, max_response: int, key: Sequence[str], turn: str) -> Column:
    """True for turns of chains that fit; a chain that would have to be cut fails the job."""
    opens = F.col("opens_row")
    over = F.col("blocked") | (opens & (F.col("continues") | (F.col("n_prompt") > max_prompt) | (F.col("n_resp") > max_response)))
    where = F.concat_ws(" ", F.lit("chain over its length limit: rollout"), *[F.col(k).cast("string") for k in key], F.lit("turn"), F.col(turn).cast("string"))
    return F.when(truthy(over), F.raise_error(where).cast("boolean")).otherwise(F.lit(True))


def policy_counts(turns: DataFrame, merged: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rollouts there were, kept and dropped by a policy, and the sampled tokens kept."""
    kept = merged.groupBy(*key).agg(F.sum("n_resp").alias("_n")).agg(F.count("*").alias("n_kept"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_sampled"))
    all_rollouts = turns.select(*key).distinct().agg(F.count("*").alias("n_rollouts"))
    both = all_rollouts.withColumn("_one", F.lit(1)).join(F.broadcast(kept.withColumn("_one", F.lit(1))), "_one").drop("_one")  # one row each
    return both.withColumn("n_dropped", F.col("n_rollouts") - F.col("n_kept"))


def training_rows(
    merged: DataFrame, turns: DataFrame, key: Sequence[str], turn: str, max_prompt: int, max_response: int, links: DataFrame | None = None, fill: bool = False, **options
) -> DataFrame:
    """One row per (rollout, row): prompt, response, mask (1 for sampled ids) and log-probs.

    The ids of ``turns`` meet ``merged`` here, and only here.  Only pieces that begin
    inside the response limit are gathered, so a row never takes in more than the
    limit plus one turn; the rest is counted as truncated.  ``links`` gives the
    observations of turns that continue by text; ``fill`` as in ``continuity``.
    """
    at, none = [*key, turn], F.array().cast(NO_IDS)
    by_key = _dealt_by_key(merged, key)
    meet = (lambda a, b, how="inner": _beside(a, b, key, turn, how)) if by_key else (lambda a, b, how="inner": _joined(a, b, at, how))
    own = ["_key"] if by_key else list(key)
    rows = meet(_dealt(merged, key) if by_key else merged, turns.select(*at, "prompt", "response", "logp"))
    if links is not None:
        rows = meet(rows, links.where("observation is not null").select(*at, "observation"), "left")
    else:
        rows = rows.withColumn("observation", F.lit(None).cast(NO_IDS))
    if fill:
        opened = merged.where("opens_row and continues").select(*at)
        filled = fill_prompts(turns.drop("logp"), key, turn, opened, **options).select(*at, F.col("prompt").alias("_filled"))
        rows = meet(rows, filled, "left").withColumn("prompt", F.coalesce("_filled", "prompt")).drop("_filled")
    by_ids = F.slice("prompt", F.col("n_prompt") - F.col("n_obs") + 1, F.col("n_obs"))
    observed = F.when(F.col("opens_row") | (F.col("n_obs") == 0), none).otherwise(F.coalesce("observation", by_ids))
    response = F.coalesce("response", none)
    piece = F.struct(
        F.col(turn).alias("t"),
        F.concat(observed, response).alias("ids"),
        F.concat(F.transform(observed, lambda _: F.lit(0)), F.transform(response, lambda _: F.lit(1))).alias("mask"),
        F.concat(F.transform(observed, lambda _: F.lit(0.0)), F.coalesce("logp", F.transform(response, lambda _: F.lit(None).cast("double")))).alias("logp"),
        F.when(F.col("opens_row"), F.slice("prompt", 1, max_prompt)).alias("prompt"),
    )
    inside = rows.withColumn("_piece", F.when(F.col("begin") < max_response, piece))
    out = inside.groupBy(*own, "row_start").agg(
        F.array_sort(F.collect_list("_piece")).alias("_p"),
        F.sum(F.when(F.col("opens_row"), F.col("n_resp")).otherwise(F.col("n_obs") + F.col("n_resp"))).cast("long").alias("n_full"),
        F.max(F.when(F.col("opens_row"), F.col("n_prompt"))).alias("_np"),
    )

    def joined(field: str) -> Column:
        return F.slice(F.flatten(F.transform("_p", lambda x: x[field])), 1, max_response)

    out = out.select(
        *(["_key.*"] if by_key else key),
        "row_start",
        F.element_at("_p", 1)["prompt"].alias("prompt"),
        joined("ids").alias("response"),
        joined("mask").alias("mask"),
        joined("logp").alias("logp"),
        ((F.col("n_full") > max_response) | (F.col("_np") > max_prompt)).alias("truncated"),
    )
    if not by_key:
        return out
    with _in_place(turns.sparkSession):
        return cut_lineage(out, "training-rows")


def merge_metrics(merged: DataFrame, key: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rollouts, rows, budget splits, blocked splits, breaks and text-level merges."""
    per = merged.groupBy(*keys, *[k for k in key if k not in keys]).agg(
        F.count_if("opens_row").alias("_rows"),
        F.count_if(F.col("opens_row") & F.col("continues")).alias("_splits"),
        F.count_if("blocked").alias("_blocked"),
        F.count_if(F.col("continuity") == "broken").alias("_breaks"),
        F.count_if(F.col("continuity") == "text").alias("_text"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.groupBy(*keys).agg(
        F.count("*").alias("n_rollouts"),
        total("_rows").alias("n_rows"),
        total("_splits").alias("n_budget_splits"),
        total("_blocked").alias("n_budget_splits_blocked"),
        total("_breaks").alias("n_merge_mismatch_rows"),
        F.count_if(F.col("_breaks") > 0).alias("n_unmerged_rollouts"),
        total("_text").alias("n_text_level_merges"),
    )


def place_rewards(rows: DataFrame, reward: str, on_action: bool) -> DataFrame:
    """Adds ``scores``: the reward on the last token, or on the last sampled one."""
    at = arrays.last_index_of(F.col("mask")) if on_action else F.size("mask") - 1
    return rows.withColumn("scores", arrays.place_reward(F.size("mask"), at, F.col(reward)))


def row_advantages(rows: DataFrame, values: str, gamma: float, lam: float) -> DataFrame:
    """Adds ``advantages`` and ``returns`` over the sampled tokens of each row (not whitened)."""
    out = rows.withColumn("_g", arrays.advantages(F.col("scores"), F.col(values), F.col("mask"), gamma, lam))
    return out.withColumn("advantages", F.transform("_g", lambda x: x["advantage"])).withColumn(
        "returns", F.transform("_g", lambda x: x["return"])
    ).drop("_g")


# --- breaks and scores -----------------------------------------------------------------------


def break_cause(rows: DataFrame, expected: str, actual: str, compaction: str, clipped: str) -> DataFrame:
    """Adds ``cause`` to broken continuations, from the two texts and what is known of the turn.

    compaction, then equal texts (retokenised), texts equal up to blanks, texts
    equal after CDATA wrappers go, a prose tag read as a call, a clip that moved,
    else unknown.  Only the text after the common beginning is compared.
    """
    a, b = F.col(expected), F.col(actual)
    no_blank = lambda t: F.regexp_replace(t, r"\s+", "")
    no_cdata = lambda t: no_blank(F.regexp_replace(t, r"<!\[CDATA\[|\]\]>", ""))
    return rows.withColumn(
        "cause",
        F.when(F.col(compaction), "A_compaction")
        .when(a == b, "D_retokenised")
        .when(no_blank(a) == no_blank(b), "B_whitespace")
        .when(no_cdata(a) == no_cdata(b), "C_cdata")
        .when(F.col(clipped), "F_clip_moved")
        .when(a.rlike(r"<function(?!\s+name=)"), "E_prose_tag")
        .otherwise("unknown"),
    )


def sequence_score(tokens: Column) -> Column:
    """Sum of chosen log-probs; the first alternative where one is missing; null when none is there."""
    picked = F.filter(
        F.transform(tokens, lambda t: F.coalesce(t["logprob"], F.try_element_at(t["top"], F.lit(1)))), lambda x: x.isNotNull()
    )
    return F.when(F.size(picked) > 0, F.aggregate(picked, F.lit(0.0), lambda a, x: a + x))


def token_advantage(teacher: DataFrame, student: DataFrame, key: str, pos: str, logp: str, scale: float = 0.5, limit: float = 3.0) -> DataFrame:
    """clip((teacher - student) / scale, +-limit) per token, joined on (trace, position)."""
    s = student.select(F.col(key).alias("_k"), F.col(pos).alias("_p"), F.col(logp).alias("_s"))
    joined = teacher.join(s, (F.col(key) == F.col("_k")) & (F.col(pos) == F.col("_p")))
    value = F.least(F.lit(limit), F.greatest(F.lit(-limit), (F.col(logp) - F.col("_s")) / scale))
    return joined.withColumn("advantage", value).drop("_k", "_p", "_s")
