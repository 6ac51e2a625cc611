"""Joins of results, prompts, runs, intervals and node names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungauge.functions import text as tx
from rungauge.functions.guards import ratio, truthy
from rungauge.functions.hashing import text_key
from rungauge.functions.ordered import running
from rungauge.shared import cut_lineage, sent_if_small


def results_with_tasks(results: DataFrame, tasks: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Result and task must both exist; the status row is optional.

    Join sides are chosen by the optimiser from their sizes at run time.
    """
    t = tasks.withColumnRenamed(key, "_task")
    s = status.withColumnRenamed(key, "_status")
    return (
        results.join(t, F.col(key) == F.col("_task"))
        .join(s, F.col(key) == F.col("_status"), "left")
        .withColumn("has_status", F.col("_status").isNotNull())
        .drop("_task", "_status")
    )


PAIRED_ROWS = 1024  # about as many right rows of one prompt meet its left rows in one task


def rendered_key(text: Column) -> Column:
    """md5 of a prompt as it was rendered: stripped; quotes at its ends are its own."""
    return F.md5(tx.strip(text))


def by_prompt_hash(
    left: DataFrame, left_text: str, right: DataFrame, right_text: str, how: str = "inner", paired_rows: int = PAIRED_ROWS
) -> DataFrame:
    """Equi-join of rendered and captured prompts on their md5; the key is computed once per row.

    A left that has its ``prompt_key`` (of ``prompt_matches``) keeps it.  All pairs of
    a prompt are rows.  Where more than ``paired_rows`` right rows share a prompt, they
    are dealt over blocks by their hash and the prompt's left rows visit each block, so
    no task makes all pairs of a hot prompt.
    """
    a = left if "prompt_key" in left.columns else left.withColumn("prompt_key", rendered_key(F.col(left_text)))
    b = right.withColumn("_key", tx.prompt_key(F.col(right_text))).drop(right_text)
    if how.lower().endswith(("semi", "anti")):
        return a.join(b, F.col("prompt_key") == F.col("_key"), how)
    sizes = b.where("_key is not null").groupBy(F.col("_key").alias("_hot")).agg(F.ceil(F.count("*") / paired_rows).alias("_blocks"))
    hot = sent_if_small(cut_lineage(sizes.where("_blocks > 1"), "hot-prompts"))
    a = a.join(hot, F.col("prompt_key") == F.col("_hot"), "left").withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_blocks", F.lit(1)) - 1))
    )
    dealt = F.xxhash64(*[c for c, kind in b.dtypes if "map<" not in kind and "variant" not in kind])
    b = b.join(hot.withColumnsRenamed({"_hot": "_hot_key", "_blocks": "_of"}), F.col("_key") == F.col("_hot_key"), "left").select(
        *b.columns, F.pmod(dealt, F.coalesce("_of", F.lit(1))).alias("_at"), F.lit(True).alias("_met")
    )
    joined = a.join(b, (F.col("prompt_key") == F.col("_key")) & (F.col("_block") == F.col("_at")), how)
    # An outer join leaves a row for each block that is empty; the prompt's pairs come from the others.
    return joined.where("_hot is null or _met").drop("_key", "_hot", "_blocks", "_block", "_at", "_met")


def prompt_matches(left: DataFrame, left_text: str, right: DataFrame, right_text: str, right_id: Sequence[str]) -> DataFrame:
    """Every left row with its prompt's class on the right: ``n_matches`` rows, ``first_match`` the smallest id among them.

    Right rows of one prompt are one class row before they meet the left, so a
    prompt that both sides repeat n times gives n rows and not n squared.  With
    ``prompt_members``, which names the class of each right row, all pairs are known.
    A prompt that is null matches nothing.
    """
    a = left.withColumn("prompt_key", rendered_key(F.col(left_text)))
    classes = prompt_members(right, right_text, right_id).groupBy(F.col("prompt_key").alias("_key")).agg(
        F.count("*").alias("n_matches"), F.min(F.struct(*right_id)).alias("first_match")
    )
    joined = a.join(classes, F.col("prompt_key") == F.col("_key"), "left").drop("_key")
    return joined.withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("long")))


def prompt_members(rows: DataFrame, text: str, ids: Sequence[str]) -> DataFrame:
    """The ids of rows with the key of their prompt; rows without a prompt belong to no class."""
    return rows.select(*ids, tx.prompt_key(F.col(text)).alias("prompt_key")).where("prompt_key is not null")


def match_report(asked: DataFrame, key: str, known: DataFrame, known_key: str, min_match: float = 0.9) -> DataFrame:
    """Distinct asked keys, how many meet a known one, and whether the share is enough.

    Keys may be whole texts: their digests are what is shuffled.
    """
    keys = known.select(text_key(F.col(known_key)).alias("_k")).distinct()
    distinct = asked.select(text_key(F.col(key)).alias("_a")).where("_a is not null").distinct()
    joined = distinct.join(keys, F.col("_a") == F.col("_k"), "left")
    out = joined.agg(F.count("*").alias("n_asked"), F.count("_k").alias("n_matched")).withColumn(
        "match_rate", ratio(F.col("n_matched"), F.col("n_asked"))
    )
    return out.withColumn("enough", truthy(F.col("match_rate") >= min_match))


def keep_listed(rows: DataFrame, ids: DataFrame, key: str, id_column: str) -> DataFrame:
    return rows.join(ids.select(F.col(id_column).alias("_id")), F.col(key) == F.col("_id"), "left_semi")


def drop_listed(rows: DataFrame, ids: DataFrame, key: str, id_column: str) -> DataFrame:
    return rows.join(ids.select(F.col(id_column).alias("_id")), F.col(key) == F.col("_id"), "left_anti")


def id_sets(a: DataFrame, b: DataFrame, key: str, b_key: str | None = None) -> DataFrame:
    """One row: common, only in a, only in b, and whether the sets are equal."""
    left = a.select(F.col(key).alias("_a")).distinct()
    right = b.select(F.col(b_key or key).alias("_b")).distinct()
    joined = left.join(right, F.col("_a") == F.col("_b"), "full")
    return joined.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_common"),
        F.count_if(F.col("_b").isNull()).alias("n_only_a"),
        F.count_if(F.col("_a").isNull()).alias("n_only_b"),
    ).withColumn("equal", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0))


def interval_counts(
    intervals: DataFrame, events: DataFrame, interval_id: str, key: str, start: str, end: str, event_key: str, at: str,
    slack: float = 0.0, **options,
) -> DataFrame:
    """Events of the same key inside [start - slack, end + slack], counted per interval.

    Interval ends and events are laid on one time line per key and the events are
    counted as a running total, so no interval is ever paired with an event: the
    work grows with rows + intervals, and a busy key is cut into slices.
    At equal times a start stands before the events and an end after them.
    """
    marks = intervals.select(
        F.col(key).alias("_key"),
        F.explode(
            F.array(
                F.struct((F.col(start) - slack).cast("double").alias("at"), F.lit(0).alias("rank")),
                F.struct((F.col(end) + slack).cast("double").alias("at"), F.lit(2).alias("rank")),
            )
        ).alias("_m"),
        F.col(interval_id).alias("_id"),
    ).select("_key", F.col("_m.at").alias("_at"), F.col("_m.rank").alias("_rank"), "_id")
    line = marks.unionByName(
        events.select(F.col(event_key).alias("_key"), F.col(at).cast("double").alias("_at"), F.lit(1).alias("_rank")),
        allowMissingColumns=True,
    )
    counted = running(
        line, ["_key"], ["_at", "_rank"], {"_upto": ("sum", (F.col("_rank") == 1).cast("long"))}, **options
    ).where(F.col("_rank") != 1)
    per = counted.groupBy(F.col("_id").alias("_id")).agg(
        (F.max(F.when(F.col("_rank") == 2, F.col("_upto"))) - F.max(F.when(F.col("_rank") == 0, F.col("_upto")))).alias("n")
    )
    return intervals.join(per, F.col(interval_id) == F.col("_id"), "left").select(
        *intervals.columns, F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_events")
    )


def resolve_nodes(requested: DataFrame, collected: DataFrame, node: str, full: str) -> DataFrame:
    """Requested test ids to collected ones: exact, else the first word of exactly one.

    ``state`` is exact, truncated, unavailable, ambiguous, or shared when two
    requests land on the same collected id.  A null request stays, unavailable.

    Ids meet as digests.  Texts are shuffled where copies of one become one row, and
    at the end once more for the rows that name them.
    """
    names = collected.select(F.col(full).alias("_full")).where("_full is not null")
    names = names.groupBy(text_key(F.col("_full")).alias("_fd")).agg(F.first("_full").alias("_full"))
    first = F.element_at(F.split(tx.strip(F.col("_full")), rf"[{tx.BLANK}]+"), 1)
    narrow = cut_lineage(names.select("_fd", "_full", text_key(first).alias("_wd")), "names")
    by_first = narrow.groupBy(F.col("_wd").alias("_first")).agg(F.count("*").alias("_n"), F.min("_fd").alias("_one"))
    asked = cut_lineage(requested.groupBy(text_key(F.col(node)).alias("_d")).agg(F.first(node).alias("node")), "asked")
    joined = (
        asked.select("_d")
        .join(narrow.select("_fd"), F.col("_d") == F.col("_fd"), "left")
        .join(by_first, F.col("_d") == F.col("_first"), "left")
    )
    state = (
        F.when(F.col("_fd").isNotNull(), "exact")
        .when(F.col("_n").isNull(), "unavailable")
        .when(F.col("_n") > 1, "ambiguous")
        .otherwise("truncated")
    )
    resolved = joined.select("_d", F.coalesce(F.col("_fd"), F.when(F.col("_n") == 1, F.col("_one"))).alias("_to"), state.alias("state"))
    shared = resolved.where("_to is not null").groupBy(F.col("_to").alias("_f")).agg(F.count("*").alias("_users")).where("_users > 1")
    found = resolved.join(shared, F.col("_to") == F.col("_f"), "left").select(
        F.col("_d").alias("_of"), "_to", F.when(F.col("_users").isNotNull(), "shared").otherwise(F.col("state")).alias("state")
    )
    texts = narrow.select("_fd", F.col("_full").alias("full"))
    out = found.join(texts, F.col("_to") == F.col("_fd"), "left").join(asked, F.col("_of").eqNullSafe(F.col("_d")))
    return out.select("node", "full", "state")


def unique_names(requested: DataFrame, known: DataFrame, name: str, package: str, status: str) -> DataFrame:
    """Status of a name that lives in one package; in two it is ambiguous, in none MISSING."""
    per = known.groupBy(F.col(name).alias("_name")).agg(
        F.min(package).alias("_lo"), F.max(package).alias("_hi"), F.min(status).alias("_status")
    )
    asked = requested.select(name).distinct()
    joined = asked.join(per, F.col(name) == F.col("_name"), "left")
    return joined.select(
        name,
        F.when(F.col("_name").isNull(), "MISSING")
        .when(F.col("_lo") != F.col("_hi"), "ambiguous")
        .otherwise(F.col("_status"))
        .alias("status"),
    )


def tensor_blocks(rows: DataFrame, name: str, start: str, values: str, width: int = 4096) -> DataFrame:
    """Pieces of tensors (``values`` from position ``start`` on) as ``cells`` of a common grid: name, block, cells.

    A cell holds struct<v> per position, null where no piece has the position, so a
    null value is told from a missing one.  What is shuffled is one row per piece and
    block, not per value.  Positions of a tensor are unique; pieces of any length and
    start may come.
    """
    here, n = F.col(start).cast("long"), F.size(values)
    first, last = F.floor(here / width), F.floor((here + n - 1) / width)
    pieces = rows.where(n > 0).select(F.col(name).alias("name"), here.alias("_start"), F.transform(values, lambda v: F.struct(v.cast("double").alias("v"))).alias("_values"), F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("_start"), F.col("block") * width)
    high = F.least(F.col("_start") + F.size("_values"), (F.col("block") + 1) * width)
    cut = F.slice("_values", (low - F.col("_start") + 1).cast("int"), (high - low).cast("int"))
    pieces = pieces.select("name", "block", F.struct((low - F.col("block") * width).cast("int").alias("at"), cut.alias("values")).alias("piece"))
    none = F.lit(None).cast("struct<v:double>")
    put = lambda acc, p: F.concat(acc, F.array_repeat(none, p["at"] - F.size(acc)), p["values"])
    whole = F.aggregate(F.array_sort(F.collect_list("piece")), F.array().cast("array<struct<v:double>>"), put)
    return pieces.groupBy("name", "block").agg(whole.alias("cells"))


def weight_drift(new: DataFrame, old: DataFrame) -> DataFrame:
    """Per tensor of two tables of ``tensor_blocks``: norm of the change, norm of the start, relative drift, positions only one side has.

    Blocks meet by (name, block); their positions are compared side by side.
    """
    mine, theirs = new.withColumnRenamed("cells", "_new"), old.withColumnRenamed("cells", "_old")
    empty = F.array().cast("array<struct<v:double>>")
    pairs = F.zip_with(F.coalesce("_new", empty), F.coalesce("_old", empty), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("change", "norm")], *[F.lit(0).cast("long").alias(c) for c in ("both", "one")])

    def add(acc: Column, p: Column) -> Column:
        both = p["a"].isNotNull() & p["b"].isNotNull()
        square = lambda v: F.when(both, F.coalesce(v * v, F.lit(0.0))).otherwise(F.lit(0.0))
        single = p["a"].isNotNull() != p["b"].isNotNull()
        return F.struct(
            (acc["change"] + square(p["a"]["v"] - p["b"]["v"])).alias("change"), (acc["norm"] + square(p["b"]["v"])).alias("norm"),
            (acc["both"] + both.cast("long")).alias("both"), (acc["one"] + single.cast("long")).alias("one"),
        )

    sums = mine.join(theirs, ["name", "block"], "full").select("name", F.aggregate(pairs, start, add).alias("s"))
    shared = lambda c: F.sqrt(F.sum(F.when(F.col("s.both") > 0, F.col(f"s.{c}"))))
    out = sums.groupBy("name").agg(shared("change").alias("change"), shared("norm").alias("norm"), F.sum("s.one").alias("n_unmatched"))
    return out.withColumn("relative", F.when(F.col("norm") > 0, F.col("change") / F.col("norm")).otherwise(F.lit(0.0)))


def drift_summary(per_tensor: DataFrame, name: str) -> DataFrame:
    """Global relative drift, tensors compared, and the largest change among norm layers."""
    same = F.col("n_unmatched") == 0
    out = per_tensor.agg(
        F.count_if(same).alias("n_tensors"),
        F.count_if(~same).alias("n_unmatched"),
        F.sqrt(F.sum(F.when(same, F.col("change") * F.col("change")))).alias("_d"),
        F.sqrt(F.sum(F.when(same, F.col("norm") * F.col("norm")))).alias("_n"),
        F.max(F.when(same & F.lower(name).contains("norm"), F.col("change"))).alias("max_norm_layer"),
    )
    return out.select("n_tensors", "n_unmatched", F.try_divide("_d", "_n").alias("global_drift"), "max_norm_layer")


def gold_overlap(edits: DataFrame, gold: DataFrame, trace: str, path: str, hunk: str) -> DataFrame:
    """Traces that touch a gold file, and those that touch a gold hunk, over all traces.

    ``hunk`` is a line bucket: two edits overlap when they share file and bucket.
    """
    g = gold.select(F.col(trace).alias("_t"), F.col(path).alias("_p"), F.col(hunk).alias("_h")).distinct()
    files = g.select("_t", "_p").distinct()
    hit_file = edits.join(files, (F.col(trace) == F.col("_t")) & (F.col(path) == F.col("_p")), "left_semi").select(
        F.col(trace).alias("_ft")
    ).distinct()
    hit_hunk = edits.join(
        g, (F.col(trace) == F.col("_t")) & (F.col(path) == F.col("_p")) & (F.col(hunk) == F.col("_h")), "left_semi"
    ).select(F.col(trace).alias("_ht")).distinct()
    traces = edits.select(trace).distinct()
    joined = traces.join(hit_file, F.col(trace) == F.col("_ft"), "left").join(
        hit_hunk, F.col(trace) == F.col("_ht"), "left"
    )
    return joined.agg(
        F.count("*").alias("n_traces"), F.count("_ft").alias("n_file_hits"), F.count("_ht").alias("n_hunk_hits")
    ).select(
        "*",
        ratio(F.col("n_file_hits"), F.col("n_traces")).alias("file_rate"),
        ratio(F.col("n_hunk_hits"), F.col("n_traces")).alias("hunk_rate"),
    )


def shard_overlap(shards: DataFrame, key: str, shard: str) -> DataFrame:
    """Ids held by more than one shard, with the number of shards."""
    per = shards.groupBy(key, shard).agg(F.count("*").alias("_n"))
    return per.groupBy(key).agg(F.count("*").alias("n_shards"), F.sum("_n").cast("long").alias("n_rows")).where(
        (F.col("n_shards") > 1) | (F.col("n_rows") > 1)
    )


def difference_both_ways(a: DataFrame, b: DataFrame, key: str, b_key: str | None = None) -> DataFrame:
    """Rows (key, side): ids missing from a or extra in a, measured against b."""
    left = a.select(F.col(key).alias("key")).distinct()
    right = b.select(F.col(b_key or key).alias("key")).distinct()
    return right.exceptAll(left).withColumn("side", F.lit("missing")).unionByName(
        left.exceptAll(right).withColumn("side", F.lit("extra"))
    )


def require_disjoint(a: DataFrame, b: DataFrame, key: str, b_key: str | None = None) -> None:
    """Raises when the two tables share an id (reads one row)."""
    shared = a.select(F.col(key).alias("k")).join(b.select(F.col(b_key or key).alias("k")), "k", "left_semi")
    if not shared.isEmpty():
        raise ValueError("id sets overlap")
