"""Dataset curation: screening, splits, work lists, provenance, plans, cards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungauge.functions import hashing, ranks, text as tx
from rungauge.functions.guards import ratio, truthy
from rungauge.functions.ordered import running
from rungauge.functions.rows import global_position, keep_first
from rungauge.shared import cut_lineage, sent_if_small


def pass_rates(attempts: DataFrame, task: str, reward: str) -> DataFrame:
    """Share of attempts with a positive reward, and the number of attempts."""
    return attempts.groupBy(task).agg(
        F.avg(F.when(F.col(reward) > 0, 1.0).otherwise(0.0)).alias("pass_rate"), F.count("*").alias("n")
    )


def statement_of_prompt(prompt: Column) -> Column:
    """Task text between its marks in a cumulative prompt, null when a mark is missing."""
    start = F.instr(prompt, tx.STATEMENT_MARK)
    rest = F.substring(prompt, start + len(tx.STATEMENT_MARK), F.length(prompt))
    end = F.instr(rest, tx.STATEMENT_END)
    return F.when((start > 0) & (end > 0), tx.strip(F.substring(rest, F.lit(1), end - 1)))


def screen_tasks(
    rates: DataFrame, tasks: DataFrame, key: str, task_key: str, min_match: float = 0.9
) -> tuple[DataFrame, DataFrame]:
    """Tasks whose pass rate lies strictly between 0 and 1, and the counts by band.

    The share of rated keys that meet a task must reach ``min_match``: the kept
    rows carry that check, so a broken match fails the job and writes nothing.
    """
    known = tasks.select(F.col(task_key).alias("_t"), *[c for c in tasks.columns if c != task_key])
    joined = rates.join(known, rates[key] == F.col("_t"), "left")
    matched = F.col("_t").isNotNull()
    band = (
        F.when(~matched, "unmatched").when(F.col("pass_rate") == 0, "never").when(F.col("pass_rate") == 1, "always").otherwise("between")
    )
    report = joined.groupBy(band.alias("band")).agg(F.count("*").alias("n_tasks"))
    share = joined.agg(ratio(F.count_if(matched), F.count("*"))).scalar()
    # The threshold is checked inside the filter, so it cannot be pruned away.
    enough = F.when(share >= min_match, F.lit(True)).otherwise(
        F.raise_error(F.lit("too few prompts match a task")).cast("boolean")
    )
    kept = joined.where(matched & (F.col("pass_rate") > 0) & (F.col("pass_rate") < 1) & enough).drop("_t")
    return kept, report


def kept_guards(f2p: Column, p2p: Column, scope: str = "prefix") -> Column:
    """Guard tests in files that hold a wanted test; ``scope`` is ``prefix`` or ``exact``."""
    files = F.array_distinct(F.transform(f2p, lambda t: F.substring_index(t, "::", 1)))
    if scope == "exact":
        return F.filter(p2p, lambda t: F.array_contains(files, F.substring_index(t, "::", 1)))
    return F.filter(p2p, lambda t: F.exists(files, lambda f: t.startswith(f)))


def guard_outcome(f2p: Column, kept: Column) -> Column:
    """no_f2p, no_guard (dropped) or kept."""
    return F.when(F.coalesce(F.size(f2p), F.lit(0)) <= 0, "no_f2p").when(F.size(kept) == 0, "no_guard").otherwise("kept")


def work_list(
    tasks: DataFrame,
    key: str,
    image: str,
    n_f2p: str,
    first_by: Sequence[str],
    only: DataFrame | None = None,
    done: DataFrame | None = None,
    limit: int | None = None,
    shards: int = 1,
    shard: int = 0,
    **options,
) -> DataFrame:
    """Deduplicated, totally ordered, limited and sharded list of tasks still to do.

    First row per id wins, order is (image, wanted tests, id), a shard takes
    every n-th place, and ids already done leave last so places never move.
    """
    rows = keep_first(tasks.where(F.col(key).isNotNull()), [key], list(first_by))
    if only is not None:
        rows = rows.join(only.select(F.col(only.columns[0]).alias("_only")), F.col(key) == F.col("_only"), "left_semi")
    placed = global_position(rows, [image, n_f2p], [key], "place", **options)
    placed = placed.withColumn("place", F.col("place") - 1)
    if limit is not None:
        placed = placed.where(F.col("place") < limit)
    placed = placed.where(F.col("place") % shards == shard)
    if done is not None:
        placed = placed.join(done.select(F.col(done.columns[0]).alias("_done")), F.col(key) == F.col("_done"), "left_anti")
    return placed


def image_plan(tasks: DataFrame, image: str, batch_size: int, **options) -> DataFrame:
    """Images by number of tasks, in batches of ``batch_size`` images with running totals.

    Tasks are counted, not listed: one row per image is what gets ordered.
    """
    per = tasks.where(F.col(image).isNotNull() & (F.col(image) != "")).groupBy(image).agg(F.count("*").alias("n_tasks"))
    ordered = per.withColumn("_minus", -F.col("n_tasks"))
    placed = ranks.with_position(ordered, [], ["_minus", image], "place", **options)
    placed = placed.withColumn("batch", F.floor((F.col("place") - 1) / batch_size) + 1).drop("_minus")
    totals = placed.groupBy("batch").agg(F.count("*").alias("batch_images"), F.sum("n_tasks").cast("long").alias("batch_tasks"))
    return placed.join(totals, "batch")


def bucket_split(tasks: DataFrame, key: str, statement: str, protocol: str = "critic-v1:") -> DataFrame:
    """Hash split of whole text groups: bucket 0 of 10 validates, the rest trains.

    Texts that differ in blanks only share a group, so they never straddle the sides.
    """
    group = F.sha2(tx.one_blank(F.col(statement)), 256)
    bucket = hashing.digest_mod_10(F.sha2(F.concat(F.lit(protocol), F.col("text_group")), 256))
    return (
        tasks.withColumn("text_group", group)
        .withColumn("bucket", bucket)
        .withColumn("split", F.when(F.col("bucket") == 0, "validation").otherwise("train"))
    )


def held_out_split(rows: DataFrame, problem: str, seed: str, n_val: int) -> DataFrame:
    """``n_val`` problems, first in a seeded hash order, validate with all their rows."""
    chosen = (
        rows.groupBy(problem)
        .agg(F.count("*").alias("_n"))
        .select(F.col(problem).alias("_p"), hashing.hash_order(seed, F.col(problem)).alias("_h"))
        .orderBy("_h")
        .limit(n_val)
    )
    marked = rows.join(sent_if_small(cut_lineage(chosen, "held-out")), F.col(problem).eqNullSafe(F.col("_p")), "left")
    side = F.when(F.col("_h").isNotNull(), "val").otherwise("train")
    return marked.withColumn("split", side).drop("_p", "_h")


def hash_sample(rows: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """The first n rows in a salted hash order: a fixed sample that no score can sway."""
    return rows.withColumn("_h", hashing.hash_order(salt, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def purity(train: DataFrame, held_out: DataFrame, key: str, statement: str, held_key: str | None = None) -> DataFrame:
    """Counts that must all be 0 for a clean split: repeated ids, missing texts, ids also held out.

    An id may be a whole text: rows are counted by the digest of their id first, so
    what is shuffled is one narrow row per distinct id and no text.
    """
    blank = F.coalesce(F.length(tx.strip(F.col(statement))), F.lit(0)) == 0
    narrow = train.select(hashing.text_key(F.col(key)).alias("_key"), blank.alias("_blank"))
    per = narrow.groupBy("_key").agg(F.count("*").alias("_n"), F.count_if("_blank").alias("_blanks"))
    held = held_out.select(hashing.text_key(F.col(held_key or key)).alias("_held")).distinct()
    joined = per.join(held, F.col("_key") == F.col("_held"), "left")
    none = F.lit(0).cast("long")
    out = joined.agg(
        F.coalesce(F.sum("_n"), none).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_n"))), none).alias("n_missing_ids"),
        F.coalesce(F.sum("_blanks"), none).alias("n_missing_texts"),
        F.coalesce(F.sum(F.when(F.col("_held").isNotNull(), F.col("_n"))), none).alias("n_held_out"),
        F.count_if(F.col("_key").isNotNull() & (F.col("_n") > 1)).alias("n_repeated_ids"),
    )
    bad = F.col("n_missing_ids") + F.col("n_missing_texts") + F.col("n_held_out") + F.col("n_repeated_ids")
    return out.withColumn("clean", bad == 0)


def require_pure(train: DataFrame, held_out: DataFrame, key: str, statement: str, held_key: str | None = None) -> None:
    """Raises before anything is written when the split is not clean."""
    report = purity(train, held_out, key, statement, held_key).first()
    if not report.clean:
        raise ValueError(f"split is not clean: {report.asDict()}")


def duplicate_groups(rows: DataFrame, key: str, statement: str) -> DataFrame:
    """Groups of texts equal up to blanks: size and smallest id.  Copies merge before the shuffle."""
    return rows.groupBy(F.sha2(tx.one_blank(F.col(statement)), 256).alias("text_group")).agg(
        F.count("*").alias("n_copies"), F.min(key).alias("representative")
    )


def provenance(child: DataFrame, parent: DataFrame, key: str, free: str) -> DataFrame:
    """Child rows against their parents on every shared column but ``free``."""
    shared = [c for c in child.columns if c in parent.columns and c not in (key, free)]
    origin = parent.select(F.col(key).alias("_key"), F.struct(*shared).alias("_origin"))
    joined = child.select(key, F.struct(*shared).alias("_row")).join(origin, F.col(key) == F.col("_key"), "left")
    state = (
        F.when(F.col("_key").isNull(), "no_parent")
        .when(~F.col("_row").eqNullSafe(F.col("_origin")), "differs")
        .otherwise("same")
    )
    return joined.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def mixture(rows: DataFrame, shard: str, category: str) -> DataFrame:
    """Categories read from each shard's rows, and each component's share of the whole."""
    per = rows.groupBy(shard, category).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).scalar()
    sizes = per.groupBy(shard).agg(F.sum("n").alias("_n"), F.count("*").alias("n_categories"))
    return (
        per.join(sizes, shard)
        .withColumn("share_of_shard", F.col("n") / F.col("_n"))
        .withColumn("share_of_all", F.col("n") / total)
        .drop("_n")
    )


def card(rows: DataFrame, flags: str = "flags") -> DataFrame:
    """Headline counts of a dataset of segments, by rollout."""
    clean = (F.size(flags) == 0) | (F.col("segment") == "compact")
    per = rows.groupBy("run", "instance_id").agg(
        F.bool_and("resolved").alias("_resolved"),
        F.bool_and(clean).alias("_clean"),
        F.bool_or(F.array_contains(F.col(flags), "post_segments_missing")).alias("_incomplete"),
        F.sum(F.when(F.col("segment") != "compact", F.col("n_turns")).otherwise(0)).cast("long").alias("turns"),
        F.count("*").alias("_rows"),
        F.count_if(F.col("resolved")).alias("_rrows"),
        F.count_if(F.col("resolved") & (F.size(flags) == 0)).alias("_crows"),
    )
    problems = per.groupBy("instance_id").agg(F.count("*").alias("_n")).agg(F.count("*")).scalar()
    totals = per.agg(
        F.sum("_rows").cast("long").alias("n_rows"),
        F.count("*").alias("n_rollouts"),
        F.count_if("_resolved").alias("n_resolved_rollouts"),
        F.count_if(F.col("_resolved") & F.col("_clean")).alias("n_clean_resolved_rollouts"),
        F.count_if(~F.col("_incomplete")).alias("n_complete_rollouts"),
        F.sum("_rrows").cast("long").alias("n_resolved_rows"),
        F.sum("_crows").cast("long").alias("n_clean_resolved_rows"),
        F.avg("turns").alias("turns_mean"),
        F.max("turns").alias("turns_max"),
    ).withColumn("n_problems", problems)
    quantiles = ranks.value_at(
        per, [], "turns", {"turns_p50": ranks.index_card(0.5), "turns_p90": ranks.index_card(0.9)}
    )
    one = quantiles.withColumn("_one", F.lit(1))
    return totals.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")  # one row each


def card_histogram(rows: DataFrame, values: Column, name: str) -> DataFrame:
    """Frequency of the elements of an array column, e.g. flags or tool names."""
    return rows.select(F.explode(values).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def distributions(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], **options) -> DataFrame:
    """Per key: n, mean, index percentiles and maximum of the non-null values.

    Equal values are counted once; everything else is read off the counts, so any
    number of measures and percentiles costs one pass over the rows.
    """
    keys = list(keys)
    counted = cut_lineage(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")), "counts")
    placed = running(counted, keys, [value], {"_upto": ("sum", F.col("_c"))}, **options)
    totals = counted.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.sum("_c").alias("_n"), (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("_mean"), F.max(value).alias("_max")
    )
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])

    def at(share: float) -> Column:
        index = ranks.index_card(share)(F.col("_n"))
        return F.max(F.when((F.col("_upto") - F.col("_c") <= index) & (index < F.col("_upto")), F.col(value)))

    return placed.join(totals, on).groupBy(*keys).agg(
        F.max("_n").alias("n"), F.max("_mean").alias("mean"), *[at(p).alias(name) for name, p in shares.items()], F.max("_max").alias("max")
    )


def card_rollouts(rows: DataFrame) -> DataFrame:
    """One row per rollout: turns outside compactions, completeness, wall time (missing: 0), compactions (missing: null) and image."""
    return rows.groupBy("run", "instance_id").agg(
        F.sum(F.when(F.col("segment") != "compact", F.col("n_turns")).otherwise(0)).cast("double").alias("turns"),
        (~F.bool_or(truthy(F.array_contains("flags", "post_segments_missing")))).alias("complete"),
        F.coalesce(F.max("wall_seconds"), F.lit(0)).cast("double").alias("wall"),
        F.max("n_compactions").alias("n_compactions"), F.min("image").alias("image"),
    )


def card_distributions(rows: DataFrame, **options) -> DataFrame:
    """The card's distributions: tokens and turns per segment kind, largest turn, turns and wall time per rollout.

    Rows are segments: run, instance_id, segment, flags, n_turns, n_tokens,
    max_turn_tokens, wall_seconds.  All measures are laid out as (measure, value) and
    go through ``distributions`` together.  A measure without values has no row.
    """
    def laid_out(df: DataFrame, **measures: tuple[Column, Column | str]) -> DataFrame:
        cells = [F.when(when, F.struct(F.lit(name).alias("measure"), F.col(value).cast("double").alias("value"))) for name, (when, value) in measures.items()]
        return df.select(F.explode(F.array_compact(F.array(*cells))).alias("_m")).select("_m.*")

    kind = F.col("segment")
    by_row = laid_out(
        rows, **{f"tokens_{k}": (kind == k, "n_tokens") for k in ("main", "post", "compact")},
        **{f"turns_{k}": (kind == k, "n_turns") for k in ("main", "post")}, max_turn_tokens=(kind != "compact", "max_turn_tokens"),
    )
    by_rollout = laid_out(card_rollouts(rows), rollout_turns=(F.lit(True), "turns"), complete_rollout_turns=(F.col("complete"), "turns"), wall_seconds=(F.lit(True), "wall"))
    return distributions(by_row.unionByName(by_rollout), ["measure"], "value", {"p50": 0.5, "p90": 0.9}, **options)


def card_counts(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """The card's histograms as (kind, name, n): rows by run, segment and flag, rollouts by compactions and image, tool calls by name.

    ``messages`` has role, synthetic and tools (names called); calls of synthetic
    messages are not counted.  Unknown compactions are ``unknown(>=1)``.
    """
    rollouts = card_rollouts(rows)
    calls = messages.where((F.col("role") == "assistant") & ~truthy(F.col("synthetic"))).select(F.lit("tool").alias("kind"), F.explode("tools").alias("name"))
    per_row = rows.select(F.explode(F.concat(
        F.array(F.struct(F.lit("run").alias("kind"), F.col("run").cast("string").alias("name")), F.struct(F.lit("segment").alias("kind"), F.col("segment").alias("name"))),
        F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("name"))),
    )).alias("_c")).select("_c.*")
    compactions = F.coalesce(F.col("n_compactions").cast("string"), F.lit("unknown(>=1)"))
    per_rollout = rollouts.select(F.explode(F.array(
        F.struct(F.lit("compactions").alias("kind"), compactions.alias("name")), F.struct(F.lit("image").alias("kind"), F.col("image").cast("string").alias("name")),
    )).alias("_c")).select("_c.*")
    return per_row.unionByName(per_rollout).unionByName(calls).groupBy("kind", "name").agg(F.count("*").alias("n"))


def segment_distribution(rows: DataFrame, segment: str, value: str) -> DataFrame:
    """Per segment kind: n, mean, index p50 and p90, maximum."""
    sums = rows.groupBy(segment).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    quantiles = ranks.value_at(rows, [segment], value, {"p50": ranks.index_card(0.5), "p90": ranks.index_card(0.9)})
    return sums.join(quantiles, segment, "left")


def resolve_over_roots(wanted: DataFrame, key: str, roots: Sequence[DataFrame], columns: Sequence[str], fallback: Sequence[str] = ()) -> DataFrame:
    """First root that holds the id gives its row; fields it lacks come from the asking row."""
    union = None
    for i, root in enumerate(roots):
        part = root.select(F.col(key).alias("_key"), *columns, F.lit(i).alias("_root"))
        union = part if union is None else union.unionByName(part)
    first = keep_first(union, ["_key"], ["_root", F.struct(*columns)])
    renamed = first.select("_key", "_root", *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = wanted.join(renamed, F.col(key) == F.col("_key"), "left")
    filled = [
        (F.coalesce(F.col(f"_r_{c}"), F.col(c)) if c in fallback else F.col(f"_r_{c}")).alias(c) for c in columns
    ]
    return joined.select(key, F.coalesce("_root", F.lit(-1)).alias("root"), *filled)
