"""Ordered logic per key: sessions, runs, cycles, drops, segments, budgets, duplicates.

Everything here is built from running values, so a key with most of the rows is
cut into slices and never ordered by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungauge.functions import text as tx
from rungauge.functions.guards import truthy
from rungauge.functions.ordered import Scan, running
from rungauge.functions.rows import keep_last


def gap_sessions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, gap: float, **options) -> DataFrame:
    """Adds ``session``: a new one starts after a pause longer than ``gap`` (0-based per key)."""
    scan = Scan(rows, keys, order, **options).add(_before=("prev", F.col(at)))
    starts = truthy((F.col(at) - F.col("_before")) > gap)
    return scan.add(session=("sum", starts.cast("long"))).rows("_before")


def identical_runs(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], signature: Column,
    start: tuple[Column, Column] | None = None, **options,
) -> DataFrame:
    """Adds ``signature`` and ``run_length``: equal consecutive signatures up to this row; 0 for no signature.

    ``start`` is the (signature, run length) a key brings along from earlier rows.
    """
    scan = Scan(rows.withColumn("signature", signature), keys, order, **options)
    scan.add(_before=("prev", F.struct(F.col("signature").alias("s"))), _place=("sum", F.lit(1)))
    first = F.col("_before").isNull()
    earlier = F.col("_before.s")
    carried = F.lit(0)
    if start is not None:
        earlier = F.when(first, start[0]).otherwise(earlier)
        carried = F.coalesce(start[1], F.lit(0))
    scan.add_run("_repeats", truthy(F.col("signature") == earlier))
    # A run that reaches back to the first row goes on from what the key brought along.
    whole = F.col("_repeats") == F.col("_place")
    length = F.when(F.col("signature").isNull(), 0).when(whole, F.col("_repeats") + carried).otherwise(F.col("_repeats") + 1)
    return scan.column("run_length", length.cast("long")).rows("_before", "_place", "_repeats")


def repetition_profile(runs: DataFrame, keys: Sequence[str], long_run: int = 5) -> DataFrame:
    """Share of repeated calls, keys with a long identical run, and the longest run."""
    per = runs.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count_if(F.col("run_length") > 1).alias("_rep"), F.max("run_length").alias("_max")
    )
    return per.agg(
        F.sum("_n").cast("long").alias("n_calls"),
        F.sum("_rep").cast("long").alias("n_repeated"),
        F.count("*").alias("n_keys"),
        F.count_if(F.col("_max") >= long_run).alias("n_looping_keys"),
        F.max("_max").alias("longest"),
    ).withColumn("repeated_share", F.col("n_repeated") / F.col("n_calls"))


def periodic_cycles(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], signature: Column, fingerprint: Column,
    repeats: int = 3, max_period: int = 2, **options,
) -> DataFrame:
    """Adds ``period``: the shortest period whose last ``repeats`` rounds are exact copies, else null.

    A row matches period p when it equals the row p places back; the cycle holds
    when (repeats - 1) * p rows in a row match.  A row without fingerprint clears
    the history.
    """
    sig = F.when(fingerprint.isNotNull(), F.struct(signature.alias("s"), fingerprint.alias("f")))
    scan = Scan(rows.withColumn("_b0", sig), keys, order, **options)
    for p in range(1, max_period + 1):
        scan.add(**{f"_b{p}": ("prev", F.col(f"_b{p - 1}"))})
    period = None
    for p in range(1, max_period + 1):
        whole = F.lit(True)
        for i in range(0, p + 1):
            whole = whole & F.col(f"_b{i}").isNotNull()
        scan.add_run(f"_m{p}", truthy(whole & (F.col("_b0") == F.col(f"_b{p}"))))
        hit = F.col(f"_m{p}") >= (repeats - 1) * p
        period = F.when(hit, p) if period is None else period.when(hit, p)
    back = [f"_b{i}" for i in range(max_period + 1)]
    return scan.column("period", period).rows(*back, *[f"_m{p}" for p in range(1, max_period + 1)])


def context_drops(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, floor: float, share: float = 0.5, **options) -> DataFrame:
    """Adds ``dropped``: the last non-zero context was above the floor and this one below its share.

    A context of 0 neither drops nor becomes the reference.
    """
    seen = F.when(F.col(size) > 0, F.col(size))
    scan = Scan(rows, keys, order, **options).add(_last=("last", seen)).add(_before=("prev", F.col("_last")))
    dropped = (F.col("_before") > floor) & (F.col(size) > 0) & (F.col(size) < share * F.col("_before"))
    return scan.column("dropped", truthy(dropped)).rows("_last", "_before")


def step_delta(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n_pass: str, total: str, check: str, **options) -> DataFrame:
    """Adds ``delta``, the change of the pass share, and ``flip``, +1 or -1 when a check turns.

    The first row starts from nothing passed and a failing check.
    """
    out = running(rows, keys, order, {"_p": ("prev", F.col(n_pass)), "_c": ("prev", F.col(check))}, **options)
    change = F.col(n_pass) - F.coalesce("_p", F.lit(0))
    was, now = truthy(F.col("_c")), truthy(F.col(check))
    return (
        out.withColumn("delta", F.when(F.col(total) > 0, change / F.col(total).cast("double")).otherwise(F.lit(0.0)))
        .withColumn("flip", F.when(now & ~was, 1.0).when(~now & was, -1.0).otherwise(0.0))
        .drop("_p", "_c")
    )


def client_segments(
    requests: DataFrame, client: str, order: Sequence[str], kind: str, task: str,
    start: tuple[Column, Column] | None = None, **options,
) -> DataFrame:
    """Adds ``run_no``, ``n_compact``, ``segment`` and ``task_key`` per request of a client.

    ``kind`` is task, compact, post or other.  A task request with another task
    than the client's current one starts a run; compactions are counted inside
    the run.  Requests before any task are ``unknown``.  ``start`` is the (task,
    compactions) a client brings along from earlier rows.
    """
    is_task = F.col(kind) == "task"
    scan = Scan(requests, [client], order, **options)
    scan.add(_last=("last", F.when(is_task, F.col(task))))
    if start is None:
        scan.column("task_key", F.col("_last")).column("_brought", F.lit(None).cast("string")).column("_start", F.lit(0))
    else:
        scan.column("_brought", start[0]).column("_start", F.coalesce(start[1], F.lit(0)))
        scan.column("task_key", F.coalesce("_last", "_brought"))
    scan.add(_former=("prev", F.col("task_key")), _any=("prev", F.lit(True)))
    former = F.when(F.col("_any").isNull(), F.col("_brought")).otherwise(F.col("_former"))
    scan.column("_starts", (is_task & ~F.col(task).eqNullSafe(former)).cast("long"))
    scan.column("_compact", (F.col(kind) == "compact").cast("long"))
    scan.add(run_no=("sum", F.col("_starts")), _all=("sum", F.col("_compact")))
    scan.add(_base=("last", F.when(F.col("_starts") == 1, F.col("_all") - F.col("_compact"))))
    n = F.when(F.col("run_no") == 0, F.col("_all") + F.col("_start")).otherwise(F.col("_all") - F.col("_base")).cast("long")
    started = F.col("task_key").isNotNull()
    name = (
        F.when(~started, F.lit("unknown"))
        .when(is_task, F.lit("task"))
        .when(F.col(kind) == "compact", F.concat(F.lit("compact"), n.cast("string")))
        .when(F.col(kind) == "post", F.concat(F.lit("post"), F.greatest(n, F.lit(1)).cast("string")))
        .otherwise(F.lit("other"))
    )
    scan.column("n_compact", F.when(started, n).otherwise(0).cast("long")).column("segment", name)
    return scan.rows("_last", "_brought", "_start", "_former", "_any", "_starts", "_compact", "_all", "_base")


def shared_budget(
    messages: DataFrame, keys: Sequence[str], order: Sequence[str], is_tool: Column, content: str, single: int, combined: int,
    **options,
) -> DataFrame:
    """Tool outputs clipped one by one, then by a budget shared in each run of consecutive ones.

    Inside a run the earlier texts stay, the one that crosses the budget is cut
    with a note, and later ones are only a note.  The result depends on the run
    alone, not on where it stands in the trace.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    over = F.length(text) - single
    clipped = F.when(
        over > 0, F.concat(F.substring(text, 1, single), F.lit("\n"), tx.clip_note(over))
    ).otherwise(text)
    rows = messages.withColumn("_tool", truthy(is_tool)).withColumn("_text", F.when(F.col("_tool"), clipped).otherwise(F.col(content)))
    rows = rows.withColumn("_len", F.when(F.col("_tool"), F.length("_text")).otherwise(0).cast("long"))
    scan = Scan(rows, keys, order, **options)
    scan.add(_island=("sum", F.when(F.col("_tool"), 0).otherwise(1)), _upto=("sum", F.col("_len")))
    # Lengths before the run: the running length at the last row that is no tool output.
    rows = scan.add(_before_run=("last", F.when(~F.col("_tool"), F.col("_upto")))).rows()
    totals = rows.where("_tool").groupBy(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], F.col("_island").alias("_ti")).agg(
        F.sum("_len").alias("_total")
    )
    on = F.col("_island") == F.col("_ti")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_t{i}"))
    rows = rows.join(totals, on, "left")
    before = F.col("_upto") - F.col("_len") - F.coalesce("_before_run", F.lit(0))
    budget = F.greatest(F.lit(0), F.lit(combined) - before)
    fits = F.col("_len") <= budget
    note = tx.clip_note(F.col("_len") - budget)
    cut = F.concat(F.substring(F.col("_text"), F.lit(1), budget.cast("int")), F.lit("\n"), note)
    squeezed = F.when(fits, F.col("_text")).when(budget > 0, cut).otherwise(tx.clip_note(F.col("_len")))
    out = rows.withColumn(
        content, F.when(F.col("_tool") & (F.col("_total") > combined), squeezed).otherwise(F.col("_text"))
    )
    drop = ["_tool", "_text", "_len", "_island", "_upto", "_before_run", "_total", "_ti"]
    return out.drop(*drop, *[f"_t{i}" for i in range(len(keys))])


def keep_last_request(requests: DataFrame, rollout: str, prompt: str, seq: str, valid: Column) -> DataFrame:
    """Requests with equal valid prompt ids: only the last stays; invalid ones are never merged."""
    key = F.when(truthy(valid), F.sha2(F.to_json(F.struct(F.col(prompt).alias("p"))), 256)).otherwise(
        F.concat(F.lit("row-"), F.col(seq).cast("string"))
    )
    return keep_last(requests.withColumn("_pk", key), [rollout, "_pk"], [seq]).drop("_pk")


def attempts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], resolved: str, allowed: int, **options) -> DataFrame:
    """Adds the attempt number, its own 0/1 reward, and whether another attempt follows a failure."""
    out = running(rows, keys, order, {"attempt": ("sum", F.lit(1))}, **options)
    done = truthy(F.col(resolved))
    return (
        out.withColumn("attempt", F.col("attempt").cast("long"))
        .withColumn("local_reward", F.when(done, 1.0).otherwise(0.0))
        .withColumn("should_recover", ~done & (F.col("attempt") < allowed))
    )


def step_budget(
    requests: DataFrame, client: str, order: Sequence[str], fresh: Column, counted: Column, budget: int, warn: int,
    start: Column | None = None, **options,
) -> DataFrame:
    """Adds the step number since the last fresh session and its state: ok, warn, used_up or over.

    Requests that are not counted keep the number and have no state.  ``start`` is
    the step number a client brings along from earlier rows.
    """
    rows = requests.withColumn("_fresh", truthy(fresh) & truthy(counted)).withColumn("_one", truthy(counted).cast("long"))
    rows = rows.withColumn("_start", F.lit(0) if start is None else F.coalesce(start, F.lit(0)))
    scan = Scan(rows, [client], order, **options).add(_n=("sum", F.col("_one")))
    out = scan.add(_base=("last", F.when(F.col("_fresh"), F.col("_n") - 1))).rows()
    n = (F.col("_n") - F.coalesce(F.col("_base"), -F.col("_start"))).cast("long")
    state = F.when(n > budget, "over").when(n >= budget, "used_up").when(n >= budget - warn, "warn").otherwise("ok")
    return out.withColumn("step", n).withColumn("budget_state", F.when(F.col("_one") == 1, state)).drop(
        "_fresh", "_one", "_start", "_n", "_base"
    )


def assemble_chunks(chunks: DataFrame, response: Sequence[str], order: Sequence[str], part: str, **options) -> DataFrame:
    """Deltas of one response put together in order, with the last finish and usage.

    Slices of a long response are joined side by side and the joined slices
    once more, so sorting one response is spread over tasks.
    """
    from rungauge.functions.ranks import with_position

    piece = 4096
    placed = with_position(chunks, response, order, "_at", **options).withColumn(
        "_piece", F.floor((F.col("_at") - 1) / piece)
    )
    pieces = placed.groupBy(*response, "_piece").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce(part, F.lit("")).alias("p")))), lambda x: x["p"]), ""
        ).alias("_text"),
        F.max_by("finish", F.when(F.col("finish").isNotNull(), F.col("_at"))).alias("_finish"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("_at"))).alias("_usage"),
        F.count("*").alias("_n"),
    )
    return pieces.groupBy(*response).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_text"))), lambda x: x["_text"]), ""
        ).alias("text"),
        F.max_by("_finish", F.when(F.col("_finish").isNotNull(), F.col("_piece"))).alias("finish"),
        F.max_by("_usage", F.when(F.col("_usage").isNotNull(), F.col("_piece"))).alias("usage"),
        F.sum("_n").cast("long").alias("n_chunks"),
    )


CHUNK = """struct<choices:array<struct<
  delta:struct<content:string,reasoning_content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>,
  finish_reason:string>>>"""


def chunk_deltas(lines: DataFrame, response: Sequence[str], order: Sequence[str], line: str) -> DataFrame:
    """What each line of a streamed response adds: kind, index (of a tool call, else 0), piece, and place in the line.

    Kinds: chunk (one per line that holds a chunk), content, reasoning, call (a tool
    call is there), id, name, arguments, finish, usage.  Lines that are not data, end
    marks and broken JSON add nothing; empty pieces neither.
    """
    text = F.trim(F.substring(line, 6, 2**31 - 1))
    data = F.when(F.startswith(line, F.lit("data:")) & ~text.isin("", "[DONE]"), text)
    usage = F.get_json_object("_data", "$.usage")
    rows = lines.select(*response, *order, data.alias("_data")).withColumns({"_chunk": F.from_json("_data", CHUNK), "_usage": F.when(~usage.isin("", "{}", "[]", "0", "false"), usage)})
    one = lambda kind, index, piece: F.struct(F.lit(kind).alias("kind"), index.cast("int").alias("index"), piece.cast("string").alias("piece"))
    zero, nothing = F.lit(0), F.lit(None)

    def of_call(call: Column) -> Column:
        index = F.coalesce(call["index"], zero)
        return F.array(one("call", index, F.lit("")), one("id", index, call["id"]), one("name", index, call["function"]["name"]), one("arguments", index, call["function"]["arguments"]))

    empty = F.array().cast("array<struct<kind:string,index:int,piece:string>>")

    def of_choice(choice: Column) -> Column:
        delta = choice["delta"]
        own = F.array(one("content", zero, delta["content"]), one("reasoning", zero, delta["reasoning_content"]), one("finish", zero, choice["finish_reason"]))
        return F.concat(own, F.coalesce(F.flatten(F.transform(delta["tool_calls"], of_call)), empty))

    is_object = F.get_json_object("_data", "$").startswith("{")
    all_of = F.concat(
        F.array(one("chunk", zero, F.when(is_object, ""))), F.coalesce(F.flatten(F.transform("_chunk.choices", of_choice)), empty), F.array(one("usage", zero, F.col("_usage")), one("line", zero, nothing))
    )
    rows = rows.select(*response, *order, F.posexplode(all_of).alias("place", "_delta")).select(*response, *order, "place", "_delta.*")
    said = F.col("kind").isin("chunk", "call") & F.col("piece").isNotNull() | (F.length("piece") > 0)
    return rows.where(F.coalesce(said, F.lit(False)) | (F.col("kind") == "line"))


def assemble_responses(deltas: DataFrame, response: Sequence[str], order: Sequence[str], **options) -> DataFrame:
    """One message per response from ``chunk_deltas``: content, reasoning, tool calls by index, the last finish and usage.

    Each part is put together on its own, keyed by (response, kind, index): its pieces
    are numbered, joined slice by slice and the slices once more, so a long answer
    is spread over tasks.  Content and reasoning are null when nothing was said; a tool
    call keeps the last id and all pieces of name and arguments; a response without
    any chunk has nulls, no calls and ``n_chunks`` 0.
    """
    from rungauge.functions.ranks import with_position

    slice_size = 4096
    part = [*response, "kind", "index"]
    placed = with_position(deltas, part, [*order, "place"], "_at", **options).withColumn("_slice", F.floor((F.col("_at") - 1) / slice_size))
    said = lambda at, piece: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, F.coalesce(piece, F.lit("")).alias("p")))), lambda x: x["p"]), "")
    slices = placed.groupBy(*part, "_slice").agg(
        said("_at", F.when(~F.col("kind").isin("chunk", "line", "id", "finish", "usage"), F.col("piece"))).alias("_text"), F.max_by("piece", "_at").alias("_last"), F.count("*").alias("_n")
    )
    parts = slices.groupBy(*part).agg(said("_slice", F.col("_text")).alias("text"), F.max_by("_last", "_slice").alias("last"), F.sum("_n").alias("n"))
    return messages_of_parts(parts, response)


def messages_of_parts(parts: DataFrame, response: Sequence[str]) -> DataFrame:
    """Messages from their parts: one row per (response, kind, index) with text, last piece and number of pieces."""
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    by_index = parts.groupBy(*response, "index").agg(
        *[F.max(of(kind, c)).alias(kind) for kind, c in (("id", "last"), ("name", "text"), ("arguments", "text"), ("content", "text"), ("reasoning", "text"), ("finish", "last"), ("usage", "last"), ("chunk", "n"), ("call", "n"))]
    )
    call = F.struct("index", "id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("arguments", F.lit("")).alias("arguments"))
    return by_index.groupBy(*response).agg(
        F.max("content").alias("content"), F.max("reasoning").alias("reasoning"), F.array_sort(F.collect_list(F.when(F.col("call") > 0, call))).alias("tool_calls"),
        F.max("finish").alias("finish"), F.max("usage").alias("usage"), F.coalesce(F.sum("chunk"), F.lit(0)).cast("long").alias("n_chunks"),
    )
