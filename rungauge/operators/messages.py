"""Message jobs: explode, actions, hygiene, repair, rewriting, tool calls, sizes, loss spans."""

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungauge.functions import text as tx
from rungauge.functions.guards import truthy
from rungauge.functions.ordered import running

PARTS = "array<struct<type:string,text:string>>"


def content_text(content: Column) -> Column:
    """Content given as text, as a JSON list of parts, or missing, as one text."""
    parts = F.from_json(content, PARTS)
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    listed = F.startswith(F.coalesce(content, F.lit("")), F.lit("[")) & parts.isNotNull()
    return F.when(listed, joined).otherwise(F.coalesce(content, F.lit("")))


def call_arguments(arguments: Column) -> Column:
    """Arguments as a JSON object text; what is no JSON is kept under ``_raw``."""
    valid = F.get_json_object(arguments, "$").isNotNull()
    return F.when(arguments.isNull() | valid, arguments).otherwise(F.to_json(F.struct(arguments.alias("_raw"))))


def explode_messages(sessions: DataFrame, key: Sequence[str], messages: str) -> DataFrame:
    """One row per message: position, role, text and the arguments of its first call."""
    long = sessions.select(*key, F.posexplode(messages).alias("idx", "m"))
    fields = long.schema["m"].dataType.fieldNames()
    arguments = call_arguments(F.col("m.arguments")) if "arguments" in fields else F.lit(None).cast("string")
    return long.select(
        *key, "idx", F.col("m.role").alias("role"), content_text(F.col("m.content")).alias("text"), arguments.alias("arguments")
    )


def with_action(messages: DataFrame, content: str = "content", role: str = "role") -> DataFrame:
    """Adds ``action`` and ``action_kind`` to assistant rows (null on others)."""
    parsed = messages.withColumn("_p", F.when(F.col(role) == "assistant", tx.parse_action(F.col(content))))
    return parsed.withColumn("action", F.col("_p.action")).withColumn("action_kind", F.col("_p.kind")).drop("_p")


def action_classes(actions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Assistant turns by class of their action."""
    return actions.where("action_kind is not null").groupBy(*keys, "action_kind").agg(F.count("*").alias("n"))


def hygiene(content: Column) -> Column:
    """struct(content, trimmed, tag_lines): text cleaned around exactly one fence.

    The tail after the fence and lines that are only a tag go; three or more
    line ends become two.  When that would change the parsed action, or the
    number of fences is not one, the stripped text comes back untouched.
    """
    zero = F.lit(0)

    def around(v: Column) -> Column:
        c, fence = v["c"], F.try_element_at(v["fences"], F.lit(1))
        at = F.instr(c, fence)
        before = F.regexp_replace(F.substring(c, F.lit(1), at - 1), tx.THOUGHT_TAG, "")
        return F.struct(
            c.alias("c"),
            fence.alias("fence"),
            F.split(before, "\n", -1).alias("lines"),
            tx.strip(F.substring(c, at + F.length(fence), F.length(c))).alias("tail"),
        )

    def rebuilt(v: Column) -> Column:
        kept = F.filter(v["lines"], lambda line: ~line.rlike(tx.TAG_LINE))
        pre = tx.strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))
        lead = tx.let(pre, lambda p: F.when(F.length(p) > 0, F.concat(p, F.lit("\n\n"))).otherwise(F.lit("")))
        return F.struct(
            v["c"].alias("c"),
            F.concat(lead, v["fence"]).alias("out"),
            F.length(v["tail"]).alias("trimmed"),
            (F.size(v["lines"]) - F.size(kept)).alias("tag_lines"),
        )

    def checked(v: Column) -> Column:
        same = tx.parse_action(v["out"])["action"].eqNullSafe(tx.parse_action(v["c"])["action"])
        return F.when(
            same, F.struct(v["out"].alias("content"), v["trimmed"].alias("trimmed"), v["tag_lines"].alias("tag_lines"))
        ).otherwise(untouched(v["c"]))

    def untouched(c: Column) -> Column:
        return F.struct(c.alias("content"), zero.alias("trimmed"), zero.alias("tag_lines"))

    def fenced(c: Column) -> Column:
        return F.struct(c.alias("c"), tx.all_matches(c, tx.FENCE, 0).alias("fences"))

    return tx.let(
        tx.let(tx.strip(content), fenced),
        lambda v: F.when(F.size(v["fences"]) == 1, tx.let(tx.let(tx.let(v, around), rebuilt), checked)).otherwise(
            untouched(v["c"])
        ),
    )


def clean_messages(messages: DataFrame, content: str = "content", role: str = "role") -> DataFrame:
    """Assistant messages cleaned, with what was taken off each; other rows unchanged."""
    cleaned = messages.withColumn("_h", F.when(F.col(role) == "assistant", hygiene(F.col(content))))
    return (
        cleaned.withColumn("trimmed", F.coalesce(F.col("_h.trimmed"), F.lit(0)))
        .withColumn("tag_lines", F.coalesce(F.col("_h.tag_lines"), F.lit(0)))
        .withColumn("clean", F.coalesce(F.col("_h.content"), F.col(content)))
        .drop("_h")
    )


def hygiene_report(cleaned: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """Characters, tag lines and messages touched per run."""
    return cleaned.groupBy(*keys).agg(
        F.count("*").alias("n_messages"),
        F.sum("trimmed").cast("long").alias("trimmed_chars"),
        F.sum("tag_lines").cast("long").alias("tag_lines"),
        F.count_if(F.col("clean") != F.col(content)).alias("n_changed"),
    )


def repair_reply(content: Column, reasoning: Column) -> Column:
    """struct(content, fixes): a teacher reply brought back to one fence.

    A reply whose text is empty takes its reasoning when that holds one fence;
    one native call becomes a fence; text after a single fence is cut.
    """

    def state(text: Column, fixes: Column) -> Column:
        return F.struct(text.alias("t"), fixes.alias("fixes"))

    def one_fence(text: Column) -> Column:
        return F.contains(text, F.lit("```")) & (F.size(tx.all_matches(text, tx.FENCE, 0)) == 1)

    def promote(text: Column) -> Column:
        use = truthy((F.length(tx.strip(text)) == 0) & reasoning.isNotNull() & one_fence(reasoning))
        return F.when(use, state(reasoning, F.array(F.lit("promoted_reasoning")))).otherwise(
            state(text, F.array().cast("array<string>"))
        )

    def native(v: Column) -> Column:
        t = v["t"]
        at = F.instr(t, tx.DSML_START)
        commands = F.filter(F.transform(tx.all_matches(t, tx.DSML_COMMAND, 1), tx.strip), lambda x: F.length(x) > 0)
        pre = tx.strip(F.substring(t, F.lit(1), at - 1))
        lead = tx.let(pre, lambda p: F.when(F.length(p) > 0, F.concat(p, F.lit("\n\n"))).otherwise(F.lit("")))

        def fence(found: Column) -> Column:
            block = F.concat(lead, F.lit("```bash\n"), F.try_element_at(found, F.lit(1)), F.lit("\n```"))
            fixed = state(block, F.array_append(v["fixes"], F.lit("dsml_to_fence")))
            return F.when(F.size(found) == 1, fixed).otherwise(v)

        return F.when(~F.contains(t, F.lit("```")) & (at > 0), tx.let(commands, fence)).otherwise(v)

    def trim(v: Column) -> Column:
        t = v["t"]

        def cut(fences: Column) -> Column:
            fence = F.try_element_at(fences, F.lit(1))
            end = F.instr(t, fence) + F.length(fence) - 1
            tail = tx.strip(F.substring(t, end + 1, F.length(t)))
            fixed = state(F.substring(t, F.lit(1), end), F.array_append(v["fixes"], F.lit("trimmed_tail")))
            return F.when((F.size(fences) == 1) & (F.length(tail) > 0), fixed).otherwise(v)

        return F.when(F.contains(t, F.lit("```")), tx.let(tx.all_matches(t, tx.FENCE, 0), cut)).otherwise(v)

    def result(v: Column) -> Column:
        # A reply without text that nothing repaired keeps its missing text.
        kept = F.when(content.isNull() & (F.size(v["fixes"]) == 0), content).otherwise(v["t"])
        return F.struct(kept.alias("content"), v["fixes"].alias("fixes"))

    start = F.coalesce(content, F.lit(""))
    return tx.let(tx.let(tx.let(tx.let(start, promote), native), trim), result)


# --- protocol rewriting ----------------------------------------------------------
# Fences, markup and argument names teachers use.
THINK = r"(?is)<think>.*?</think>|<thinking>.*?</thinking>"
SHELL_FENCE = r"(?s)```(?:bash|mswea_bash_command|sh|shell)[^\S\n]*\n(.*?)```"
ANY_FENCE = r"(?s)```([^\n`]*)\n(.*?)```"
HERMES_JSON = r"(?is)<tool_call>\s*(\{.*?\})\s*</tool_call>"
HERMES_FUNCTION = r"(?is)<tool_call>\s*<function=([^>\s]+)>\s*(.*?)</function>\s*</tool_call>"
HERMES_PARAM = r"(?is)<parameter=([^>\s]+)>\s*(.*?)\s*</parameter>"
COMMAND_KEYS = ["command", "bash", "cmd", "script", "code", "input", "arguments"]
SHELL_LANGUAGES = ["", "bash", "sh", "shell", "mswea_bash_command"]


def _command_in(value) -> str | None:
    """First command text found in a decoded argument value."""
    todo = [value]
    while todo:
        item = todo.pop(0)
        if isinstance(item, str):
            text = item.strip()
            if text[:1] in ("{", "["):
                try:
                    todo.insert(0, json.loads(text))
                    continue
                except ValueError:
                    return text
            if text:
                return text
        elif isinstance(item, list):
            todo[:0] = item
        elif isinstance(item, dict):
            todo[:0] = [item[k] for k in COMMAND_KEYS if item.get(k) not in (None, "")]
    return None


@F.pandas_udf(T.StringType())
def first_command(early: pd.Series, bare: pd.Series, late: pd.Series) -> pd.Series:
    """The first command among JSON texts: those of ``early``, else ``bare``, which is one, else those of ``late``."""

    def among(texts) -> str | None:
        return next((found for t in texts if t is not None and (found := _command_in(t)) is not None), None)

    def pick(a, b, c) -> str | None:
        found = None if a is None else among(a)
        return found if found is not None else b if b is not None else None if c is None else among(c)

    return pd.Series([pick(*row) for row in zip(early, bare.where(bare.notna(), None), late)], dtype=object)


def _fence_language(label: Column) -> Column:
    return F.lower(F.coalesce(F.try_element_at(F.split(tx.strip(label), rf"[{tx.BLANK}]+"), F.lit(1)), F.lit("")))


def rewrite_replies(replies: DataFrame, content: str, arguments: str) -> DataFrame:
    """Adds ``rewritten_content`` and ``rewritten``: replies as thought plus one shell fence.

    In order: the first shell fence or a single unlabelled one, the arguments of
    the first tool call, a tool call written in the text as JSON or as markup,
    the whole text as JSON.  What yields no command stays as it was.
    """
    c = F.coalesce(F.col(content), F.lit(""))
    # Without a thinking tag the text is only stripped of blanks at its ends.
    rows = replies.withColumn("_s", tx.strip(F.regexp_replace(c, THINK, "")))
    s = F.col("_s")
    labels, bodies = tx.all_matches(s, ANY_FENCE, 1), tx.all_matches(s, ANY_FENCE, 2)
    shell = F.try_element_at(tx.all_matches(s, SHELL_FENCE, 1), F.lit(1))
    plain = F.when(
        (F.size(labels) == 1) & _fence_language(F.try_element_at(labels, F.lit(1))).isin(SHELL_LANGUAGES),
        F.try_element_at(bodies, F.lit(1)),
    )
    fenced = tx.strip(F.when(shell.isNotNull(), shell).otherwise(plain))
    rows = (
        rows.withColumn("_n", F.size(labels))
        .withColumn("_legal", shell.isNotNull() & (F.size(labels) == 1))
        .withColumn("_bash", F.when(F.length(fenced) > 0, fenced))
    )
    hermes_json = F.nullif(F.regexp_extract(s, HERMES_JSON, 1), F.lit(""))
    body = F.when(s.rlike(HERMES_FUNCTION), F.regexp_extract(s, HERMES_FUNCTION, 2))
    params = F.map_from_arrays(
        F.array_distinct(tx.all_matches(body, HERMES_PARAM, 1)),
        F.transform(
            F.array_distinct(tx.all_matches(body, HERMES_PARAM, 1)),
            lambda k: F.try_element_at(
                tx.all_matches(body, HERMES_PARAM, 2),
                F.array_position(tx.all_matches(body, HERMES_PARAM, 1), k).cast("int"),
            ),
        ),
    )
    bare_body = F.when(
        (F.length(tx.strip(body)) > 0) & (F.instr(body, "<parameter=") == 0), tx.strip(body)
    )
    # Only rows without a usable fence reach Python, and only their JSON does.
    need = F.col("_bash").isNull()
    whole = F.when(s.startswith("{") | s.startswith("["), s)
    whole = F.when(need & F.get_json_object(whole, "$").isNotNull(), whole)
    # A list of calls in the text stands for its first call's arguments.
    first_call = F.coalesce(
        F.get_json_object(whole, "$[0].function.arguments"),
        F.get_json_object(whole, "$[0].arguments"),
        F.get_json_object(whole, "$.function.arguments"),
    )
    # One call for all that a reply may hold; where nothing is needed the lists are null.
    command = first_command(
        F.when(need, F.array(F.col(arguments), hermes_json, F.to_json(params))),
        F.when(need, bare_body),
        F.when(need, F.array(F.when(whole.startswith("{"), whole), first_call)),
    )
    rows = rows.withColumn("_command", command)
    no_fences = tx.strip(F.regexp_replace(F.regexp_replace(s, SHELL_FENCE, ""), ANY_FENCE, ""))
    before_fence = tx.strip(F.substring(s, F.lit(1), F.instr(s, "```") - 1))
    no_calls = tx.strip(F.regexp_replace(F.regexp_replace(s, HERMES_JSON, ""), HERMES_FUNCTION, ""))
    no_calls = F.when(no_calls.startswith("{") | no_calls.startswith("["), F.lit("")).otherwise(no_calls)

    def fence_of(cmd: Column, thought: Column) -> Column:
        block = F.concat(F.lit("```bash\n"), tx.strip(cmd), F.lit("\n```"))
        return F.when(F.length(thought) > 0, F.concat(thought, F.lit("\n\n"), block)).otherwise(block)

    one, many = F.col("_bash").isNotNull() & (F.col("_n") <= 1), F.col("_bash").isNotNull() & (F.col("_n") > 1)
    untouched = one & F.col("_legal") & (s == c)
    text = (
        F.when(untouched, c)
        .when(one, fence_of(F.col("_bash"), no_fences))
        .when(many, fence_of(F.col("_bash"), before_fence))
        .when(F.col("_command").isNotNull(), fence_of(F.col("_command"), no_calls))
        .otherwise(c)
    )
    changed = ~untouched & (F.col("_bash").isNotNull() | F.col("_command").isNotNull())
    return rows.withColumn("rewritten_content", text).withColumn("rewritten", changed).drop(
        "_s", "_n", "_legal", "_bash", "_command"
    )


# --- tool calls --------------------------------------------------------------------
CALL_BLOCK = r"(?s)<function\s+name=['\"].*?</function>"
CALL_NAME = r"<function\s+name=['\"]([^'\"]+)['\"][^>]*>"
CALL_PARAM = r"(?s)<param\s+name=['\"]([^'\"]+)['\"]>(.*?)</param>"
PARAM_WITHOUT_NAME = r"(?s)<param(?![^>]*\bname=)[^>]*>"


def normal_markup(text: Column) -> Column:
    """Word-piece blanks and collapsed tag names put right."""
    plain = F.replace(text, F.lit("Ġ"), F.lit(" "))
    for tag in ("function", "param"):
        plain = F.replace(plain, F.lit(f"<{tag}name="), F.lit(f"<{tag} name="))
    return plain


def tool_calls(replies: DataFrame, key: Sequence[str], text: str, tools: dict[str, dict]) -> DataFrame:
    """One row per call block: name, parameters, and why a block is void.

    ``tools`` maps a tool to its parameters' types and its required parameters:
    ``{"bash": {"types": {"command": "string"}, "required": ["command"]}}``.
    A parameter that is repeated, unknown or nameless, or a required one that is
    missing, voids the block.  A CDATA value is kept verbatim, others are stripped;
    a value whose type is not string is kept as JSON text where it is JSON.
    """
    blocks = replies.withColumn("_t", normal_markup(F.col(text))).select(
        *key, F.posexplode(tx.all_matches(F.col("_t"), CALL_BLOCK, 0)).alias("call", "block")
    )
    names, values = tx.all_matches(F.col("block"), CALL_PARAM, 1), tx.all_matches(F.col("block"), CALL_PARAM, 2)
    cdata = r"(?s)\A<!\[CDATA\[(.*)\]\]>\z"
    clean = F.transform(
        values, lambda v: F.when(v.rlike(cdata), F.regexp_extract(v, cdata, 1)).otherwise(tx.strip(v))
    )
    rows = blocks.select(
        *key, "call", "block",
        tx.strip(F.regexp_extract("block", CALL_NAME, 1)).alias("name"),
        F.transform(names, tx.strip).alias("_names"),
        clean.alias("_values"),
    )
    known = F.col("name").isin(list(tools))
    allowed = F.create_map(*[x for t, d in tools.items() for x in (F.lit(t), F.array(*[F.lit(p) for p in d["types"]]))])
    required = F.create_map(*[x for t, d in tools.items() for x in (F.lit(t), F.array(*[F.lit(p) for p in d["required"]]))])
    allowed_here, required_here = F.try_element_at(allowed, F.col("name")), F.try_element_at(required, F.col("name"))
    cause = (
        F.when(F.length("name") == 0, "no_name")
        .when(~known, "unknown_tool")
        .when(F.col("block").rlike(PARAM_WITHOUT_NAME), "param_without_name")
        .when(F.size(F.array_distinct("_names")) < F.size("_names"), "duplicate_param")
        .when(F.size(F.array_except("_names", allowed_here)) > 0, "unknown_param")
        .when(F.size(F.array_except(required_here, F.col("_names"))) > 0, "missing_required")
    )
    rows = rows.withColumn("void_cause", cause)
    parameters = F.map_from_arrays("_names", "_values")
    return rows.select(
        *key, "call", "name", "void_cause", F.when(F.col("void_cause").isNull(), parameters).alias("parameters")
    )


def call_report(calls: DataFrame) -> DataFrame:
    """Call blocks by outcome."""
    return calls.groupBy(F.coalesce("void_cause", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


# --- sizes and spans ----------------------------------------------------------------


def token_sizes(messages: DataFrame, keys: Sequence[str], content: str, limit: int, count=tx.estimated_tokens) -> DataFrame:
    """Tokens per trace by the message estimate (or a plugged-in counter), by characters // 3, and over the limit."""
    out = messages.groupBy(*keys).agg(
        F.sum(count(F.col(content))).cast("long").alias("n_tokens"),
        F.sum(F.length(F.coalesce(F.col(content), F.lit("")))).cast("long").alias("n_chars"),
    )
    return out.withColumn("n_tokens_by_chars", F.floor(F.col("n_chars") / 3).cast("long")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def render_message(role: Column, content: Column) -> Column:
    """The default chat template: one message."""
    return F.concat(F.lit(OPEN), role, F.lit("\n"), content, F.lit(CLOSE))


def loss_spans(
    messages: DataFrame, keys: Sequence[str], order: str, role: str, content: str, learn: Column, render=render_message, **options
) -> DataFrame:
    """Character span of every learnable message in the rendered trace.

    A span starts after the assistant header and ends with the end mark, without
    the line end behind it.
    """
    sized = messages.withColumn("_len", F.length(render(F.col(role), F.col(content)))).withColumn("_learn", truthy(learn))
    placed = running(sized, keys, [order], {"_end": ("sum", F.col("_len"))}, **options)
    header = F.length(render(F.lit("assistant"), F.lit(""))) - len(CLOSE)
    return placed.where("_learn").select(
        *keys, order,
        (F.col("_end") - F.col("_len") + header).cast("long").alias("span_start"),
        (F.col("_end") - 1).cast("long").alias("span_end"),
    )


def loss_share(messages: DataFrame, spans: DataFrame, keys: Sequence[str], role: str, content: str, render=render_message) -> DataFrame:
    """Learnable characters over all rendered characters per group."""
    total = messages.groupBy(*keys).agg(F.sum(F.length(render(F.col(role), F.col(content)))).cast("long").alias("n_chars"))
    learned = spans.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.sum(F.col("span_end") - F.col("span_start")).cast("long").alias("_learned")
    )
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    return total.join(learned, on, "left").select(
        *keys, "n_chars", F.coalesce("_learned", F.lit(0)).alias("n_learned")
    ).withColumn("share", F.col("n_learned") / F.col("n_chars"))


def text_udf(load, returns: T.DataType | None = None):
    """A plug-in text function (counter, codec, renderer) as an Arrow-batched column function.

    ``load`` is called once per partition and returns the function that is
    applied to each text, so a heavy model is not loaded per batch.
    """

    @F.pandas_udf(returns or T.LongType())
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        function = load()
        for batch in batches:
            yield batch.map(function, na_action="ignore")

    return apply
