"""Trajectory assembly: role checks, splicing, rejection reasons, shortening, flags, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungauge.functions import text as tx
from rungauge.functions.guards import first_reason, truthy, violations
from rungauge.functions.ordered import running

# --- fixed values: commands that break the rules of a run, and commands that edit ---
COMMAND_START = r"(?:^|[\n;`(]|&&|\|\|?|\$\()\s*(?:\w+=\S+\s+)*"
FORBIDDEN = [
    ("git_use", r"(?i)" + COMMAND_START + r"(?:[\w./-]*/)?git(?:-[a-z]+)?(?:\s|$|;|&|\|)"),
    ("git_metadata", r"(?i)--git-dir|--work-tree|(?:^|[\s=:\"'/])\.git(?:/|\b)|/opt/agl_tmp"),
    (
        "network",
        r"(?i)" + COMMAND_START + r"(?:[\w./-]*/)?"
        r"(?:curl|wget|httpie|http|https|aria2c|scp|sftp|rsync|nc|ncat|netcat|telnet)(?:\s|$|;|&|\|)"
        r"|urllib\.request|\burlopen\b|\brequests\.(?:get|post|put|head|Session)\b|\bhttpx\."
        r"|\bsocket\.(?:socket|create_connection)\b|\burllib3\b",
    ),
    (
        "package_install",
        r"(?i)" + COMMAND_START + r"(?:(?:[\w./-]*/)?(?:pip|pip3|conda|mamba|easy_install|uv)\b[^\n;&|]*?\binstall\b"
        r"|(?:[\w./-]*/)?python[0-9.]*\s+-m\s+pip\b[^\n;&|]*?\binstall\b)",
    ),
    (
        "test_tampering",
        r"(?i)(?:>>?|\btee\b(?:\s+-a)?\s+)\s*['\"]?[^\s'\"|;&<>]*(?:conftest\.py|pytest\.ini|tox\.ini|sitecustomize\.py"
        r"|usercustomize\.py|setup\.cfg|pyproject\.toml|\.pth)(?:['\"\s;&|]|$)",
    ),
]
EDIT = (
    r"(?i)(?:^|[\n;`(]|&&|\|\|?)\s*(?:sed\b|perl\s+-i|ruby\s+-i|python[0-9.]*\b[^\n]*\b(?:open|write|Path)\b|tee\b|patch\b"
    r"|ed\b|ex\b|printf\b|cat\s+(?:>>|>)|>>|install\b)"
)
TEST_PATH = r"(^|/)(tests?|testing)(/|$)|(^|/)(test_[^/]*\.py|[^/]*_tests?\.py|conftest\.py)$"
RUNS_TESTS = (
    r"\b(pytest|py\.test|unittest|tox|nose2?|make\s+test|npm\s+test|cargo\s+test|go\s+test)\b"
)
MAX_SPLICE = 3
SECRET_FIELD = (
    r"(?i)api.?key|credential|password|secret|auth.?token|access.?token|service.?key|^AGL_KEY$"
)
REDACTED_KEYS = [
    "agl_key", "api_key", "service_key", "password", "authorization", "access_token", "refresh_token", "secret",
    "client_secret", "swanlab_api_key",
]
# --- end of fixed values --------------------------------------------------------------


def forbidden_reason(action: Column) -> Column:
    """First class of forbidden command that an action falls in, null when it is allowed."""
    return first_reason([(name, action.rlike(pattern)) for name, pattern in FORBIDDEN])


def is_submit(action: Column) -> Column:
    return truthy(F.contains(action, F.lit(tx.SUBMIT_MARKER)) | tx.is_submission(action))


def is_edit(action: Column) -> Column:
    """A submission, or an editing command in command position."""
    return is_submit(action) | truthy(action.rlike(EDIT))


# --- rejection sampling -----------------------------------------------------------------


def expected_role(index: Column) -> Column:
    """system, user, then assistant and user in turn."""
    return (
        F.when(index == 0, "system").when(index == 1, "user").when(index % 2 == 0, "assistant").otherwise("user")
    )


def role_check(messages: DataFrame, key: str, idx: str, role: str) -> DataFrame:
    """Per trace: messages, assistant messages, and whether roles alternate and end with the assistant."""
    return messages.groupBy(key).agg(
        F.count("*").alias("n_messages"),
        F.count_if(F.col(role) == "assistant").alias("n_assistant"),
        F.bool_and(F.col(role) == expected_role(F.col(idx))).alias("_pattern"),
        F.max_by(role, idx).alias("_last"),
    ).select(
        key, "n_messages", "n_assistant",
        (F.col("_pattern") & (F.col("_last") == "assistant") & (F.col("n_messages") >= 3)).alias("roles_ok"),
    )


def splice_bad_pairs(actions: DataFrame, key: str, idx: str, role: str, content: str, **options) -> DataFrame:
    """Adds ``spliced`` and ``splice_fault`` per message.

    An assistant message without an action, answered by a format error, leaves
    together with that answer.  One half without the other is a fault.
    """
    is_error = tx.lstrip(F.coalesce(F.col(content), F.lit(""))).startswith(tx.FORMAT_ERROR_PREFIX)
    rows = actions.withColumn("_err", is_error).withColumn(
        "_bad", (F.col(role) == "assistant") & (F.col("action").isNull()) & (F.col(idx) >= 2)
    )
    rows = running(
        rows, [key], [idx], {"_next_err": ("next", F.col("_err")), "_prev_bad": ("prev", F.col("_bad"))}, **options
    )
    next_err, prev_bad = truthy(F.col("_next_err")), truthy(F.col("_prev_bad"))
    turn = (F.col(role) == "assistant") & (F.col(idx) >= 2)
    pair_head = F.col("_bad") & next_err
    pair_tail = (F.col(role) != "assistant") & F.col("_err") & prev_bad
    fault = first_reason(
        [
            ("unparseable_unanswered", F.col("_bad") & ~next_err),
            ("format_error_on_parsed_turn", turn & ~F.col("_bad") & next_err),
        ]
    )
    return rows.withColumn("spliced", pair_head | pair_tail).withColumn("splice_fault", fault).drop(
        "_err", "_bad", "_next_err", "_prev_bad"
    )


def trace_facts(spliced: DataFrame, key: str, idx: str, role: str, content: str) -> DataFrame:
    """Everything the rejection rules need to know about a trace, in one aggregate."""
    left = ~F.col("spliced")
    assistant = F.col(role) == "assistant"
    empty = F.length(tx.strip(F.coalesce(F.col(content), F.lit("")))) == 0
    return spliced.groupBy(key).agg(
        F.count("*").alias("n_messages"),
        F.count_if(assistant).alias("n_assistant"),
        F.bool_and(F.col(role) == expected_role(F.col(idx))).alias("_pattern"),
        F.max_by(role, idx).alias("_last"),
        F.min_by("splice_fault", F.when(F.col("splice_fault").isNotNull(), F.col(idx))).alias("splice_fault"),
        F.count_if(F.col("spliced") & assistant).alias("n_spliced"),
        F.count_if(left & assistant & empty).alias("n_empty"),
        F.count_if(left & assistant).alias("n_turns_kept"),
        F.max_by("action", F.when(left & assistant, F.col(idx))).alias("last_action"),
        F.sum(F.when(left, F.length(F.coalesce(F.col(content), F.lit(""))))).cast("long").alias("n_chars"),
    ).withColumn(
        "roles_ok", F.col("_pattern") & (F.col("_last") == "assistant") & (F.col("n_messages") >= 3)
    ).drop("_pattern", "_last")


def drop_reason(max_tokens: int, keep_unsubmitted: bool = False) -> Column:
    """First failing rule of a rollout, null when it is kept.

    Needs resolved, timed_out, overflowed, error, submitted, has_session,
    prompt_ok, n_turns, n_length and the columns of ``trace_facts``.
    """
    return first_reason(
        [
            ("unresolved", ~truthy(F.col("resolved"))),
            ("timed_out", F.col("timed_out")),
            ("overflowed", F.col("overflowed")),
            ("harness_error", F.col("error").isNotNull() & (F.col("error") != "")),
            ("not_submitted", F.lit(not keep_unsubmitted) & ~truthy(F.col("submitted"))),
            ("session_missing", ~truthy(F.col("has_session"))),
            ("prompt_mismatch", ~truthy(F.col("prompt_ok"))),
            ("role_pattern", ~truthy(F.col("roles_ok"))),
            ("n_turns_mismatch", F.col("n_turns").isNotNull() & (F.col("n_turns") != F.col("n_assistant"))),
            (F.col("splice_fault"), F.col("splice_fault").isNotNull()),
            ("too_many_format_errors", F.col("n_spliced") > MAX_SPLICE),
            ("empty_assistant_remaining", F.col("n_empty") > 0),
            ("length_finish", F.col("n_length") > 0),
            ("no_submit_last", ~truthy(F.contains(F.col("last_action"), F.lit(tx.SUBMIT_MARKER)))),
            ("too_long", F.floor(F.col("n_chars") / 3) > max_tokens),
        ]
    )


def drop_counts(outcomes: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """Traces per drop reason; kept traces are the row ``kept``."""
    return outcomes.groupBy(F.coalesce(reason, F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


# --- shortening ---------------------------------------------------------------------------


def shorten_reason(actions: DataFrame, key: str, submitted: str, resolved: str, all_keys: DataFrame) -> DataFrame:
    """Why a trace may not be shortened: not_resolved, missing_termination, no_actions, forbidden_action."""
    per = actions.where("action is not null").groupBy(F.col(key).alias("_k")).agg(
        F.count("*").alias("n_actions"), F.bool_or(forbidden_reason(F.col("action")).isNotNull()).alias("_forbidden")
    )
    joined = all_keys.join(per, F.col(key) == F.col("_k"), "left")
    reason = first_reason(
        [
            ("not_resolved", ~truthy(F.col(resolved))),
            ("missing_termination", ~truthy(F.col(submitted))),
            ("no_actions", F.col("n_actions").isNull()),
            ("forbidden_action", F.col("_forbidden")),
        ]
    )
    return joined.select(
        key, submitted, resolved, F.coalesce("n_actions", F.lit(0)).alias("n_actions"), reason.alias("drop_reason")
    )


def keep_row(reason: Column, resolved: Column, n_messages: Column) -> Column:
    """No drop reason, resolved, and at least one message."""
    return truthy((reason.isNull() | (reason == "")) & truthy(resolved) & (n_messages > 0))


def route(reason: Column, n_turns: Column, has_instance: Column, min_turns: int) -> Column:
    """Where a trace goes: its drop reason, kept short, the prefix search, or no_instance."""
    return (
        F.when(reason.isNotNull(), reason)
        .when(n_turns <= min_turns, F.lit("short_kept"))
        .when(~truthy(has_instance), F.lit("no_instance"))
        .otherwise(F.lit("prefix_search"))
    )


def number_actions(actions: DataFrame, key: str, idx: str, **options) -> DataFrame:
    """Adds ``k``: how many parsed actions the trace holds up to and with this message."""
    return running(
        actions, [key], [idx], {"k": ("sum", F.col("action").isNotNull().cast("long"))}, **options
    )


def candidate_prefixes(numbered: DataFrame, key: str) -> DataFrame:
    """Prefix lengths worth a replay: after every editing action, and the whole trace."""
    acts = numbered.where("action is not null")
    edits = acts.where(is_edit(F.col("action"))).select(key, "k")
    return edits.unionByName(acts.groupBy(key).agg(F.max("k").alias("k"))).distinct()


def shortest_passing(outcomes: DataFrame, key: str, k: str, ok: str) -> DataFrame:
    """Smallest prefix length that passes; none at all is ``replay_drift``.

    Passing is not monotone in the length, so every outcome counts.
    """
    best = outcomes.groupBy(key).agg(F.min(F.when(truthy(F.col(ok)), F.col(k))).alias("k_prefix"))
    return best.withColumn("drop_reason", F.when(F.col("k_prefix").isNull(), "replay_drift"))


def truncate_at(numbered: DataFrame, prefixes: DataFrame, key: str, k: str) -> DataFrame:
    """Messages up to and with the k-th parsed action; a trace with fewer keeps all."""
    wanted = prefixes.select(F.col(key).alias("_k"), F.col(k).alias("_want"))
    here = F.col("action").isNotNull() & (F.col("k") == F.col("_want"))
    return numbered.join(wanted, F.col(key) == F.col("_k")).where((F.col("k") < F.col("_want")) | here).drop("_k", "_want")


def terminal_submit(messages: DataFrame, key: str, idx: str, role: str, content: str) -> DataFrame:
    """Adds a submit turn after traces whose last action is none."""
    last = messages.groupBy(key).agg(
        F.max_by("action", F.when(F.col("action").isNotNull(), F.col(idx))).alias("_last"), F.max(idx).alias("_end")
    )
    missing = last.where(~is_submit(F.coalesce("_last", F.lit(""))))
    types = {f.name: f.dataType for f in messages.schema.fields}
    added = missing.select(
        key,
        (F.col("_end") + 1).cast(types[idx]).alias(idx),
        F.lit("assistant").alias(role),
        F.lit(tx.SUBMIT_FENCE).alias(content),
    )
    return messages.select(key, idx, role, content).unionByName(added)


# --- learnable messages and flags ----------------------------------------------------------


def mark_learnable(messages: DataFrame, key: Sequence[str], idx: str, role: str, segment: str, synthetic: str | None = None, **options) -> DataFrame:
    """Adds ``learnable``: assistant, not synthetic, and in a post segment only the last of the leading run.

    The leading run is the assistant messages from index 2 on before any other role.
    """
    assistant = F.col(role) == "assistant"
    rows = running(
        messages, list(key), [idx],
        {
            "_others": ("sum", F.when((F.col(idx) >= 2) & ~assistant, 1).otherwise(0)),
            "_next_role": ("next", F.col(role)),
        },
        **options,
    )
    leading = assistant & (F.col(idx) >= 2) & (F.col("_others") == 0)
    not_last = leading & (F.coalesce("_next_role", F.lit("")) == "assistant")
    made = F.coalesce(F.col(synthetic), F.lit(False)) if synthetic else F.lit(False)
    return rows.withColumn(
        "learnable", assistant & ~made & ~((F.col(segment) == "post") & not_last)
    ).drop("_others", "_next_role")


def mark_synthetic(messages: DataFrame, key: Sequence[str], idx: str, role: str, segment: str) -> DataFrame:
    """Adds ``synthetic``: the first assistant message of a post segment is input, not target."""
    first = messages.where((F.col(segment) == "post") & (F.col(role) == "assistant")).groupBy(
        *[F.col(k).alias(f"_{k}") for k in key]
    ).agg(F.min(idx).alias("_first"))
    on = None
    for k in key:
        same = F.col(k) == F.col(f"_{k}")
        on = same if on is None else on & same
    joined = messages.join(first, on, "left")
    return joined.withColumn("synthetic", truthy(F.col(idx) == F.col("_first"))).drop("_first", *[f"_{k}" for k in key])


def quality_flags(limits: dict[str, int]) -> Column:
    """Flags of one segment row from its counts; rollout-level ones first."""
    return violations(
        [
            ("edits_tests", F.col("n_test_files") > 0),
            ("never_ran_tests", ~truthy(F.col("ran_tests"))),
            ("post_segments_missing", F.col("n_lost_segments") > 0),
            ("over_turn_cap", (F.col("rollout_turns") > limits["turns"]) | truthy(F.col("turn_capped"))),
            ("long_turn", F.col("max_turn_tokens") > limits["turn_tokens"]),
            ("over_context", F.col("n_tokens") > limits["context"]),
            (
                "no_final_answer",
                (F.col("is_last") | (F.col("segment") == "compact"))
                & (~truthy(F.col("has_final")) | ~F.col("finish").eqNullSafe(F.lit("stop"))),
            ),
        ]
    )


def ready_rollouts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per rollout: resolved, and free of flags on every row but compaction rows."""
    return rows.groupBy(*keys).agg(
        F.bool_and("resolved").alias("resolved"),
        F.bool_and((F.size("flags") == 0) | (F.col("segment") == "compact")).alias("clean"),
        F.count("*").alias("n_rows"),
    ).withColumn("sft_ready", F.col("resolved") & F.col("clean"))


# --- event logs of sessions -----------------------------------------------------------------


def session_rollup(events: DataFrame, session: str, kind: str, finish: str) -> DataFrame:
    """Per session: requests, retries, errors, and requests by how they finished.

    Finishes are counted, not listed, so a session of any length is one row.
    """
    request = F.col(kind) == "request"
    return events.where(~F.col(kind).isin("malformed", "no_session")).groupBy(session).agg(
        F.count_if(request).alias("n_req"),
        F.count_if(F.col(kind) == "retry").alias("n_retry"),
        F.count_if(F.col(kind) == "upstream_error").alias("n_err"),
        F.count_if(request & (F.col(finish) == "stop")).alias("n_stop"),
        F.count_if(request & (F.col(finish) == "length")).alias("n_length"),
    )


def api_usage(events: DataFrame) -> DataFrame:
    """Token totals over answered calls, and calls by status.  Missing counts are 0 tokens, not 0 calls."""
    ok = truthy(F.col("status") == 200) & F.col("has_usage")

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(ok, F.coalesce(F.col(column), F.lit(0)))), F.lit(0)).cast("long").alias(column)

    return events.agg(
        F.count_if(ok).alias("n_ok"),
        total("prompt_tokens"),
        total("completion_tokens"),
        total("reasoning_tokens"),
        total("cached_tokens"),
        F.count_if(F.col("status") == 429).alias("n_429"),
        F.count_if(~F.col("status").eqNullSafe(F.lit(200))).alias("n_not_200"),
    )


def in_windows(ts: Column, windows: Sequence[tuple[float, float]]) -> Column:
    """ts lies in one of the closed windows."""
    out = F.lit(False)
    for lo, hi in windows:
        out = out | ((ts >= lo) & (ts <= hi))
    return truthy(out)


def unsafe_secrets(pairs: DataFrame, path: str, value: str) -> DataFrame:
    """Secret-named fields and whether their value is empty, masked or exposed."""
    name = F.element_at(F.split(F.col(path), r"\."), -1)
    masked = F.lower(F.trim(F.col(value))).isin(
        "redacted", "<redacted>", "[redacted]", "***redacted***", "<masked>", "[masked]"
    ) | F.col(value).rlike(r"^\*+$")
    empty = F.col(value).isNull() | F.col(value).isin("", "false", "null")
    state = F.when(empty, "empty").when(masked, "masked").otherwise("unsafe")
    return pairs.where(name.rlike(SECRET_FIELD)).withColumn("state", state)


def terminal_state(events: DataFrame, key: str, order: Sequence[str], rc: str = "rc") -> DataFrame:
    """Per run: whether its log proves a clean end, and the reason.

    Needs columns type, session, part_session, reason.  Return code 124 is a
    timeout, other codes an error; a damaged row, a session mismatch, an error
    event or an unknown finish makes the log invalid.
    """
    finish = F.col("type") == "step_finish"
    invalid = (
        F.col("type").isNull()
        | F.col("session").isNull()
        | (F.col("session") == "")
        | truthy(F.col("part_session") != F.col("session"))
        | truthy(F.col("type") == "error")
        | (truthy(finish) & ~truthy(F.col("reason").isin("stop", "tool-calls")))
    )
    at = F.struct(*order)
    per = events.groupBy(key).agg(
        F.max(rc).alias("_rc"),
        F.count_if(invalid).alias("_invalid"),
        F.min("session").alias("_lo"),
        F.max("session").alias("_hi"),
        F.max_by(F.struct("type", "reason"), at).alias("_last"),
    )
    stopped = truthy(F.col("_last.type") == "step_finish") & truthy(F.col("_last.reason") == "stop")
    reason = (
        F.when(F.col("_rc") == 124, "runner_timeout")
        .when(F.col("_rc") != 0, "runner_error")
        .when(F.col("_invalid") > 0, "incomplete_or_invalid_log")
        .when((F.col("_lo") == F.col("_hi")) & stopped, "stop")
        .otherwise("missing_final_stop_or_mixed_sessions")
    )
    return per.select(key, (reason == "stop").alias("trajectory_terminal"), reason.alias("termination_reason"))


def stop_event_class(events: DataFrame, exported: DataFrame, message: str = "message_id") -> DataFrame:
    """Stop events matched to exactly one exported message: task_stop, compaction or unknown.

    Events need type, reason, session and the message id; exported messages need
    the id, session, role, summary, agent, finish and error.
    """
    per = exported.groupBy(F.col(message).alias("_mid")).agg(
        F.count("*").alias("_n"), F.min_by(F.struct("session", "role", "summary", "agent", "finish", "error"), "session").alias("_m")
    )
    joined = events.join(per, F.col(message) == F.col("_mid"), "left")
    stop = truthy((F.col("type") == "step_finish") & (F.col("reason") == "stop"))
    one = stop & truthy(F.col("_n") == 1)
    own = one & truthy((F.col("_m.session") == F.col("session")) & (F.col("_m.role") == "assistant"))
    compaction = own & (truthy(F.col("_m.summary")) | truthy(F.col("_m.agent") == "compaction"))
    clean = F.col("_m.error").isNull() | (F.col("_m.error") == "")
    task = own & truthy((F.col("_m.agent") == "build") & (F.col("_m.finish") == "stop") & clean)
    return joined.withColumn(
        "stop_class", F.when(compaction, "compaction").when(task, "task_stop").otherwise("unknown")
    ).drop("_mid", "_n", "_m")


def contains_then_parse(lines: DataFrame, line: str, needle: str, schema: str) -> DataFrame:
    """Rows whose text holds the needle, decoded after that cheap test."""
    found = lines.where(F.contains(F.col(line), F.lit(needle)))
    return found.withColumn("j", F.from_json(line, schema)).where("j is not null")


def patch_audit(patches: DataFrame, key: str, diff: str) -> DataFrame:
    """Touched files of a patch, the test files among them, one row per patch."""
    lines = F.split(F.col(diff), "\n")
    headers = F.filter(lines, lambda x: x.startswith("diff --git "))
    words = F.transform(headers, lambda x: F.split(F.trim(x), r"\s+"))
    targets = F.transform(F.filter(words, lambda w: F.size(w) >= 4), lambda w: F.get(w, F.lit(3)))
    plus = F.transform(
        F.filter(lines, lambda x: x.startswith("+++ ")), lambda x: F.trim(F.substring(x, F.lit(5), F.length(x)))
    )
    first_plus = F.slice(plus, 1, 1)
    named = F.when(F.size(targets) > 0, targets).otherwise(first_plus)
    files = F.array_sort(
        F.array_distinct(F.transform(named, lambda p: F.when(p.startswith("b/"), F.substring(p, F.lit(3), F.length(p))).otherwise(p)))
    )
    out = patches.withColumn("files", files)
    return out.withColumn("test_files", F.filter("files", lambda f: f.rlike(TEST_PATH))).withColumn(
        "edits_tests", F.size("test_files") > 0
    )
