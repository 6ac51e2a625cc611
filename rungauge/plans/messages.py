"""Message and trajectory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungauge.functions import text as tx
from rungauge.functions.ordered import running
from rungauge.operators import messages as ms
from rungauge.operators import prefix_search as ps
from rungauge.operators import trajectories as tr
from rungauge.plans.registry import query
from rungauge.session import spread_table, table

# Conversations as agent traces: assistant texts get one of nine endings by
# (conv_id * 5 + turn) % 9, some user texts become format errors.  The same
# concatenation stands in the oracle.
ENDINGS = [
    "text || chr(10) || '```bash' || chr(10) || 'ls -la' || chr(10) || '```'",
    "text || chr(10) || '```bash' || chr(10) || 'sed -i s/a/b/ f.py' || chr(10) || '```' || chr(10) || '</parameter>' || chr(10) || 'and then'",
    "text",
    "'```bash' || chr(10) || 'ls' || chr(10) || '```' || text || '```bash' || chr(10) || 'pwd' || chr(10) || '```'",
    "text || '<function name=\"bash\"><param name=\"command\"><![CDATA[echo hi > x.txt]]></param></function>'",
    "text || '<function name=\"edit\"><param name=\"path\">a.py</param></function>'",
    "'<THOUGHT>' || chr(10) || '</invoke>' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || '```mswea_bash_command' || chr(10) || 'cd /testbed && git log' || chr(10) || '```'",
    "'```bash' || chr(10) || 'echo COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT' || chr(10) || '```'",
    "''",
]
CONTENT = (
    "case when role = 'assistant' then case (conv_id * 5 + turn) % 9 "
    + " ".join(f"when {i} then {e}" for i, e in enumerate(ENDINGS))
    + " end when role = 'user' and turn > 1 and (conv_id + turn) % 4 = 0 then '  Format error: expected one block' else text end"
)
MESSAGES = f"select conv_id as trace, cast(turn as integer) as idx, role, {CONTENT} as content from conversations"
FENCE_SQL = "'(?s)```(?:bash|mswea_bash_command)[^\\S\\n]*\\n(.*?)\\n?```'"
STRIP_SQL = "regexp_replace(regexp_replace({t}, '^[" + tx.BLANK.replace("{", "{{").replace("}", "}}") + "]+', ''), '[" + tx.BLANK.replace("{", "{{").replace("}", "}}") + "]+$', '')"


def strip_sql(column: str) -> str:
    return STRIP_SQL.format(t=column)


# The oracle's own parse: fences, shell calls and other calls, counted apart.
PARSED = f"""
select *, case when role <> 'assistant' then null when n_ok = 1 and n_other = 0 then 'ok' when n_ok = 0 and n_other > 0 then 'unavailable'
               when n_ok + n_other = 0 then 'none' else 'many' end as action_kind,
       case when role = 'assistant' and n_ok = 1 and n_other = 0 then {strip_sql("coalesce(fences[1], cmds[1])")} end as action
from (select *, len(fences) + len(cmds) as n_ok,
        len(regexp_extract_all(content, '<function\\s+name="([^"]*)"', 1)) - len(cmds) as n_other
      from (select *, regexp_extract_all(content, {FENCE_SQL}, 1) as fences,
              regexp_extract_all(content, '(?s)<function name="bash"><param name="command"><!\\[CDATA\\[(.*?)\\]\\]></param></function>', 1) as cmds
            from ({MESSAGES})))
"""


def messages(spark, root):
    return spread_table(spark, root, "conversations", "conv_id").select(
        F.col("conv_id").alias("trace"), F.col("turn").cast("int").alias("idx"), "role",
        F.expr(CONTENT.replace("chr(", "char(")).alias("content"),
    )


def parsed(spark, root):
    return ms.with_action(messages(spark, root))


@query("t01_actions", f"select trace, idx, action_kind, action from ({PARSED}) where role = 'assistant'")
def _(spark, root):
    return parsed(spark, root).where("role = 'assistant'").select("trace", "idx", "action_kind", "action")


@query("t01_action_classes", f"""
select trace % 10 as run, action_kind, count(*) as n from ({PARSED}) where role = 'assistant' group by 1, 2
""")
def _(spark, root):
    return ms.action_classes(parsed(spark, root).withColumn("run", F.col("trace") % 10), ["run"])


FENCED_DOCS = """
select doc_id, case doc_id % 4 when 0 then text || chr(10) || '```bash' || chr(10) || 'make' || chr(10) || '```'
  when 1 then text when 2 then '```bash' || chr(10) || text || chr(10) || '```'
  else '```bash' || chr(10) || 'a' || chr(10) || '```' || text || '```bash' || chr(10) || 'b' || chr(10) || '```' end as content
from documents
"""


@query("t01_document_actions", f"""
select doc_id, case doc_id % 4 when 1 then 'none' when 3 then 'many' else 'ok' end as kind,
       case doc_id % 4 when 0 then 'make' when 2 then {strip_sql("regexp_extract(content, " + FENCE_SQL + ", 1)")} end as action
from ({FENCED_DOCS})
""")
def _(spark, root):
    content = F.expr(FENCED_DOCS.split("select doc_id, ")[1].split(" as content")[0].replace("chr(", "char("))
    docs = spread_table(spark, root, "documents", "doc_id").select("doc_id", tx.parse_action(content).alias("p"))
    return docs.select("doc_id", F.col("p.kind").alias("kind"), F.col("p.action").alias("action"))


# What the hygiene job must leave of each ending.
CLEAN = f"""
select *, case when n_fence <> 1 then stripped else case when pre = '' then '' else pre || chr(10) || chr(10) end || fence end as clean,
       case when n_fence <> 1 then 0 else length({strip_sql("tail")}) end as trimmed,
       case when n_fence <> 1 then 0 else tags end as tag_lines
from (select *, substr(stripped, strpos(stripped, fence) + length(fence)) as tail,
        {strip_sql("regexp_replace(array_to_string(list_filter(string_split(before, chr(10)), lambda l: not regexp_matches(l, '^\\s*</?[A-Za-z_][A-Za-z0-9_:-]*(?:\\s[^>\\n]*)?>\\s*$')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")} as pre,
        len(list_filter(string_split(before, chr(10)), lambda l: regexp_matches(l, '^\\s*</?[A-Za-z_][A-Za-z0-9_:-]*(?:\\s[^>\\n]*)?>\\s*$'))) as tags
      from (select *, regexp_replace(substr(stripped, 1, strpos(stripped, fence) - 1), '</?THOUGHT>', '', 'g') as before
            from (select *, regexp_extract(stripped, {FENCE_SQL}, 0) as fence,
                    len(regexp_extract_all(stripped, {FENCE_SQL}, 0)) as n_fence
                  from (select *, {strip_sql("content")} as stripped from ({MESSAGES}) where role = 'assistant'))))
"""


@query("t03_hygiene", f"select trace, idx, clean, trimmed, tag_lines from ({CLEAN})")
def _(spark, root):
    return ms.clean_messages(messages(spark, root)).where("role = 'assistant'").select(
        "trace", "idx", "clean", "trimmed", "tag_lines"
    )


@query("t03_hygiene_report", f"""
select trace % 10 as run, count(*) as n_messages, cast(sum(trimmed) as bigint) as trimmed_chars,
       cast(sum(tag_lines) as bigint) as tag_lines, count_if(clean <> content) as n_changed from ({CLEAN}) group by 1
""")
def _(spark, root):
    cleaned = ms.clean_messages(messages(spark, root).where("role = 'assistant'"))
    return ms.hygiene_report(cleaned.withColumn("run", F.col("trace") % 10), ["run"])


# Teacher replies from documents: empty text with reasoning, native markup, a tail, or plain.
REPLY_CONTENT = """case doc_id % 5 when 0 then '  ' when 1 then text || '<｜｜DSML｜｜ invoke name="bash"><｜｜DSML｜｜ parameter name="command" string="true"> ls ' || doc_id || ' </｜｜DSML｜｜ parameter>'
  when 2 then text || chr(10) || '```bash' || chr(10) || 'ls' || chr(10) || '```' || chr(10) || '</invoke> more' when 3 then text else null end"""
REPLY_REASONING = "case when doc_id % 10 = 0 then text || chr(10) || '```bash' || chr(10) || 'pwd' || chr(10) || '```' else text end"


@query("t04_repair", f"""
select doc_id, case doc_id % 5 when 0 then case when doc_id % 10 = 0 then text || chr(10) || '```bash' || chr(10) || 'pwd' || chr(10) || '```' else '  ' end
   when 1 then case when {strip_sql("text")} = '' then '' else {strip_sql("text")} || chr(10) || chr(10) end || '```bash' || chr(10) || 'ls ' || doc_id || chr(10) || '```'
   when 2 then text || chr(10) || '```bash' || chr(10) || 'ls' || chr(10) || '```' when 3 then text end as content,
   case when doc_id % 10 = 0 then 'promoted_reasoning' when doc_id % 5 = 1 then 'dsml_to_fence' when doc_id % 5 = 2 then 'trimmed_tail' else '' end as fixes
from documents
""")
def _(spark, root):
    rows = spread_table(spark, root, "documents", "doc_id").select(
        "doc_id",
        F.expr(REPLY_CONTENT.replace("chr(", "char(")).alias("content"),
        F.expr(REPLY_REASONING.replace("chr(", "char(")).alias("reasoning"),
    )
    fixed = rows.withColumn("_f", ms.repair_reply(F.col("content"), F.col("reasoning")))
    return fixed.select(
        "doc_id", F.col("_f.content").alias("content"), F.array_join("_f.fixes", ",").alias("fixes")
    )


@query("t04_repair_histogram", """
select fix, count(*) as n from (select case when doc_id % 10 = 0 then 'promoted_reasoning' when doc_id % 5 = 1 then 'dsml_to_fence'
  when doc_id % 5 = 2 then 'trimmed_tail' end as fix from documents) where fix is not null group by 1
""")
def _(spark, root):
    rows = spread_table(spark, root, "documents", "doc_id").select(
        F.expr(REPLY_CONTENT.replace("chr(", "char(")).alias("content"),
        F.expr(REPLY_REASONING.replace("chr(", "char(")).alias("reasoning"),
    )
    fixes = rows.select(F.explode(ms.repair_reply(F.col("content"), F.col("reasoning"))["fixes"]).alias("fix"))
    return fixes.groupBy("fix").agg(F.count("*").alias("n"))


# Replies in six protocols.
REWRITE_CONTENT = """case doc_id % 7 when 0 then '<think>' || text || '</think>' || chr(10) || '```sh' || chr(10) || 'ls ' || doc_id || chr(10) || '```'
  when 1 then text || chr(10) || '```bash' || chr(10) || 'pwd' || chr(10) || '```'
  when 2 then 'x' || text || '<tool_call>{"name": "bash", "arguments": {"command": "ls ' || doc_id || '"}}</tool_call>'
  when 3 then 'x' || text || '<tool_call><function=bash><parameter=command> cat f </parameter></function></tool_call>'
  when 4 then 'x' || text when 5 then 'x' || text || chr(10) || '```' || chr(10) || 'make' || chr(10) || '```' || chr(10) || '```' || chr(10) || 'b' || chr(10) || '```'
  else 'x' || text || chr(10) || '```' || chr(10) || 'make' || chr(10) || '```' end"""
REWRITE_ARGUMENTS = """case when doc_id % 14 = 4 then '{"command": "grep ' || doc_id || '"}' end"""
S_TEXT = strip_sql("text")


def block(command: str) -> str:
    return f"'```bash' || chr(10) || {command} || chr(10) || '```'"


@query("t05_protocol_rewrite", f"""
select doc_id, case doc_id % 7 when 0 then {block("'ls ' || doc_id")} when 1 then {REWRITE_CONTENT}
   when 2 then {strip_sql("'x' || text")} || chr(10) || chr(10) || {block("'ls ' || doc_id")}
   when 3 then {strip_sql("'x' || text")} || chr(10) || chr(10) || {block("'cat f'")}
   when 4 then case when doc_id % 14 = 4 then {strip_sql("'x' || text")} || chr(10) || chr(10) || {block("'grep ' || doc_id")} else 'x' || text end
   when 5 then 'x' || text || chr(10) || '```' || chr(10) || 'make' || chr(10) || '```' || chr(10) || '```' || chr(10) || 'b' || chr(10) || '```'
   else {strip_sql("'x' || text")} || chr(10) || chr(10) || {block("'make'")} end as content,
   case doc_id % 7 when 0 then true when 1 then {S_TEXT} <> text and not starts_with({REWRITE_CONTENT}, {S_TEXT}) when 2 then true when 3 then true
        when 4 then doc_id % 14 = 4 when 5 then false else true end as rewritten
from documents
""")
def _(spark, root):
    rows = spread_table(spark, root, "documents", "doc_id").select(
        "doc_id",
        F.expr(REWRITE_CONTENT.replace("chr(", "char(")).alias("content"),
        F.expr(REWRITE_ARGUMENTS).alias("arguments"),
    )
    out = ms.rewrite_replies(rows, "content", "arguments")
    return out.select("doc_id", F.col("rewritten_content").alias("content"), "rewritten")


TOOLS = {
    "bash": {"types": {"command": "string", "timeout": "integer"}, "required": ["command"]},
    "edit": {"types": {"path": "string", "old": "string", "new": "string"}, "required": ["path"]},
}
CALL_TEXT = """text || case doc_id % 8 when 0 then '<function name="bash"><param name="command"><![CDATA[  ls ' || doc_id || ']]></param></function>'
  when 1 then '<function name="bash"><param name="command"> ls </param><param name="timeout">5</param></function>'
  when 2 then '<function name="bash"><param name="command">a</param><param name="command">b</param></function>'
  when 3 then '<function name="edit"><param name="old">x</param></function>'
  when 4 then '<function name="fly"><param name="to">x</param></function>'
  when 5 then '<functionname="edit"><paramname="path">a.py</param></function>'
  when 6 then '<function name="bash"><param name="command">a</param><param name="speed">b</param></function>' else '' end"""


@query("t06_tool_calls", """
select doc_id, 0 as call, case doc_id % 8 when 3 then 'edit' when 4 then 'fly' when 5 then 'edit' else 'bash' end as name,
       case doc_id % 8 when 2 then 'duplicate_param' when 3 then 'missing_required' when 4 then 'unknown_tool' when 6 then 'unknown_param' end as void_cause,
       case doc_id % 8 when 0 then 'command=  ls ' || doc_id when 1 then 'command=ls;timeout=5' when 5 then 'path=a.py' end as parameters
from documents where doc_id % 8 <> 7
""")
def _(spark, root):
    rows = spread_table(spark, root, "documents", "doc_id").select("doc_id", F.expr(CALL_TEXT).alias("t"))
    out = ms.tool_calls(rows, ["doc_id"], "t", TOOLS)
    pairs = F.transform(F.map_entries("parameters"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("doc_id", "call", "name", "void_cause", F.array_join(pairs, ";").alias("parameters"))


@query("t06_call_report", """
select case doc_id % 8 when 2 then 'duplicate_param' when 3 then 'missing_required' when 4 then 'unknown_tool' when 6 then 'unknown_param'
  else 'valid' end as outcome, count(*) as n from documents where doc_id % 8 <> 7 group by 1
""")
def _(spark, root):
    rows = spread_table(spark, root, "documents", "doc_id").select("doc_id", F.expr(CALL_TEXT).alias("t"))
    return ms.call_report(ms.tool_calls(rows, ["doc_id"], "t", TOOLS))


def sessions(spark, root):
    """Conversations cut into segments of four turns, one row per segment."""
    content = F.when(
        F.col("turn") % 3 == 1, F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    ).when(F.col("turn") % 5 == 4, F.lit(None)).otherwise(F.concat(F.lit("."), "text"))
    arguments = F.when(F.col("turn") % 2 == 0, F.lit('{"a": 1}')).otherwise(F.concat(F.lit("run "), F.col("turn").cast("string")))
    message = F.struct("turn", "role", content.alias("content"), arguments.alias("arguments"))
    # At most four turn numbers fall in a segment: the array is bounded by the key.
    return table(spark, root, "conversations").groupBy(
        F.col("conv_id").alias("trace"), F.floor(F.col("turn") / 4).cast("int").alias("segment_index")
    ).agg(F.array_sort(F.collect_list(message)).alias("messages"))


@query("t08_message_explode", """
select conv_id as trace, (turn // 4)::int as segment_index, (turn % 4)::int as idx, role,
       case when turn % 3 = 1 then text when turn % 5 = 4 then '' else '.' || text end as text,
       case when turn % 2 = 0 then '{"a": 1}' else '{"_raw":"run ' || turn || '"}' end as arguments
from conversations
""")
def _(spark, root):
    return ms.explode_messages(sessions(spark, root), ["trace", "segment_index"], "messages")


RENDERED = "length('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10))"


@query("t09_loss_spans", f"""
with m as (select *, {RENDERED} as len from ({MESSAGES})),
     s as (select *, sum(len) over (partition by trace order by idx) as e from m)
select trace, idx, cast(e - len + 22 as bigint) as span_start, cast(e - 1 as bigint) as span_end from s where role = 'assistant'
""")
def _(spark, root):
    return ms.loss_spans(messages(spark, root), ["trace"], "idx", "role", "content", F.col("role") == "assistant")


@query("t09_loss_share", f"""
with m as (select *, {RENDERED} as len from ({MESSAGES}))
select trace, cast(sum(len) as bigint) as n_chars, cast(coalesce(sum(len - 23) filter (where role = 'assistant'), 0) as bigint) as n_learned,
       round(coalesce(sum(len - 23) filter (where role = 'assistant'), 0) / sum(len), 6) as share from m group by 1
""")
def _(spark, root):
    rows = messages(spark, root)
    spans = ms.loss_spans(rows, ["trace"], "idx", "role", "content", F.col("role") == "assistant")
    return ms.loss_share(rows, spans, ["trace"], "role", "content").withColumn("share", F.round("share", 6))


@query("t10_token_sizes", f"""
select trace, cast(sum(cast(floor(length(content) / 3.7::double + 0.5) as bigint)) as bigint) as n_tokens, cast(sum(length(content)) as bigint) as n_chars,
       cast(sum(length(content)) // 3 as bigint) as n_tokens_by_chars, sum(cast(floor(length(content) / 3.7::double + 0.5) as bigint)) > 300 as over_limit
from ({MESSAGES}) group by 1
""")
def _(spark, root):
    return ms.token_sizes(messages(spark, root), ["trace"], "content", 300)


@query("p01_token_counter", r"""
with c as (select source, len(regexp_extract_all(text, '[^\x09-\x0D ]+')) as w, length(text) as n from documents)
select source, cast(sum(w) as bigint) as n_tokens, cast(sum(n) as bigint) as n_chars, cast(sum(n) // 3 as bigint) as n_tokens_by_chars, sum(w) > 100000 as over_limit from c group by 1
""")
def _(spark, root):
    """A plugged-in counter (words) in place of the character estimate."""
    words = ms.text_udf(lambda: lambda text: len(text.split()))
    docs = spread_table(spark, root, "documents", "doc_id").select("source", "text")
    return ms.token_sizes(docs, ["source"], "text", 100_000, words)


@query("p02_chat_renderer", """
select conv_id as trace, cast(sum(length('[' || role || '] ' || text || chr(10))) as bigint) as n_chars from conversations group by 1
""")
def _(spark, root):
    """A plugged-in template in place of the default one."""
    def bracket(role, text):
        return F.concat(F.lit("["), role, F.lit("] "), text, F.lit("\n"))

    rows = table(spark, root, "conversations")
    return rows.groupBy(F.col("conv_id").alias("trace")).agg(
        F.sum(F.length(bracket(F.col("role"), F.col("text")))).cast("long").alias("n_chars")
    )


# --- rejection sampling ------------------------------------------------------------

SPLICED = f"""
with p as ({PARSED}), q as (select *, regexp_matches(content, '^[{tx.BLANK}]*Format error:') as err,
   role = 'assistant' and action is null and idx >= 2 as bad from p),
 r as (select *, coalesce(lead(err) over (partition by trace order by idx), false) as next_err,
              coalesce(lag(bad) over (partition by trace order by idx), false) as prev_bad from q)
select *, bad and next_err or (role <> 'assistant' and err and prev_bad) as spliced,
       case when bad and not next_err then 'unparseable_unanswered'
            when role = 'assistant' and idx >= 2 and not bad and next_err then 'format_error_on_parsed_turn' end as splice_fault from r
"""


def spliced(spark, root):
    return tr.splice_bad_pairs(parsed(spark, root), "trace", "idx", "role", "content")


@query("w15_splice", f"select trace, idx, spliced, splice_fault from ({SPLICED})")
def _(spark, root):
    return spliced(spark, root).select("trace", "idx", "spliced", "splice_fault")


@query("w14_role_pattern", """
select conv_id as trace, count(*) as n_messages, count_if(role = 'assistant') as n_assistant,
       bool_and(role = case when turn = 0 then 'system' when turn = 1 then 'user' when turn % 2 = 0 then 'assistant' else 'user' end)
         and arg_max(role, turn) = 'assistant' and count(*) >= 3 as roles_ok from conversations group by 1
""")
def _(spark, root):
    return tr.role_check(messages(spark, root), "trace", "idx", "role")


OUTCOME = f"""
with s as ({SPLICED}),
 f as (select trace, count(*) as n_messages, count_if(role = 'assistant') as n_assistant,
   bool_and(role = case when idx = 0 then 'system' when idx = 1 then 'user' when idx % 2 = 0 then 'assistant' else 'user' end)
     and arg_max(role, idx) = 'assistant' and count(*) >= 3 as roles_ok,
   arg_min(splice_fault, idx) filter (where splice_fault is not null) as splice_fault, count_if(spliced and role = 'assistant') as n_spliced,
   count_if(not spliced and role = 'assistant' and {strip_sql("content")} = '') as n_empty,
   arg_max_null(action, idx) filter (where not spliced and role = 'assistant') as last_action,
   sum(length(content)) filter (where not spliced) as n_chars from s group by 1),
 t as (select f.*, coalesce(quality, 1) = 1 as resolved, trace % 17 = 5 as timed_out, trace % 19 = 6 as overflowed, trace % 23 = 7 as error,
   trace % 13 <> 4 as submitted, trace % 29 <> 8 as has_session, trace % 31 <> 9 as prompt_ok,
   case when trace % 11 = 3 then 1 else n_assistant end as n_turns, trace % 7 = 2 as length_finish
   from f left join labels on doc_id = trace)
select trace, case when not resolved then 'unresolved' when timed_out then 'timed_out' when overflowed then 'overflowed' when error then 'harness_error'
   when not submitted then 'not_submitted' when not has_session then 'session_missing' when not prompt_ok then 'prompt_mismatch'
   when not roles_ok and trace % 2 = 0 then 'role_pattern' when n_turns <> n_assistant then 'n_turns_mismatch' when splice_fault is not null then splice_fault
   when n_spliced > 3 then 'too_many_format_errors' when n_empty > 0 then 'empty_assistant_remaining' when length_finish then 'length_finish'
   when not coalesce(contains(last_action, 'COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT'), false) then 'no_submit_last'
   when n_chars // 3 > 400 then 'too_long' end as drop_reason from t
"""


def outcomes(spark, root):
    facts = tr.trace_facts(spliced(spark, root), "trace", "idx", "role", "content")
    labels = table(spark, root, "labels").select("doc_id", "quality")
    t = F.col("trace")
    rows = facts.join(labels, t == F.col("doc_id"), "left").select(
        *facts.columns,
        (F.coalesce("quality", F.lit(1)) == 1).alias("resolved"),
        (t % 17 == 5).alias("timed_out"),
        (t % 19 == 6).alias("overflowed"),
        F.when(t % 23 == 7, "lost").alias("error"),
        (t % 13 != 4).alias("submitted"),
        (t % 29 != 8).alias("has_session"),
        (t % 31 != 9).alias("prompt_ok"),
        F.when(t % 11 == 3, 1).otherwise(F.col("n_assistant")).alias("n_turns"),
        F.when(t % 7 == 2, 1).otherwise(0).alias("n_length"),
    )
    # Few conversations open with a system message; odd traces are let past that rule.
    rows = rows.withColumn("roles_ok", F.col("roles_ok") | (t % 2 == 1))
    return rows.withColumn("drop_reason", tr.drop_reason(400))


@query("f01_rejection_chain", OUTCOME)
def _(spark, root):
    return outcomes(spark, root).select("trace", "drop_reason")


@query("f01_drop_counts", f"select coalesce(drop_reason, 'kept') as outcome, count(*) as n from ({OUTCOME}) group by 1")
def _(spark, root):
    return tr.drop_counts(outcomes(spark, root))


ACTS = f"select trace, idx, role, content, action from ({PARSED})"
GIT_SQL = "regexp_matches(action, '(?:^|[\\n;`(]|&&|\\|\\|?|\\$\\()\\s*(?:[\\w./-]*/)?git(?:\\s|$|;|&|\\|)')"


def traces(spark, root):
    return table(spark, root, "conversations").select(F.col("conv_id").alias("trace")).distinct().select(
        "trace", (F.col("trace") % 5 != 0).alias("resolved"), (F.col("trace") % 7 != 0).alias("submitted")
    )


SHORTEN = f"""
select t.trace, trace % 7 <> 0 as submitted, trace % 5 <> 0 as resolved, coalesce(n, 0) as n_actions,
       case when trace % 5 = 0 then 'not_resolved' when trace % 7 = 0 then 'missing_termination' when n is null then 'no_actions'
            when f then 'forbidden_action' end as drop_reason
from (select distinct conv_id as trace from conversations) t left join
 (select trace as k, count(*) as n, bool_or({GIT_SQL}) as f from ({ACTS}) where action is not null group by 1) on k = t.trace
"""


def shorten(spark, root):
    return tr.shorten_reason(parsed(spark, root), "trace", "submitted", "resolved", traces(spark, root))


@query("f02_shortening_eligibility", SHORTEN)
def _(spark, root):
    return shorten(spark, root)


@query("f03_keep_row", f"""
select trace, drop_reason is null and resolved and n_actions > 0 as keep from ({SHORTEN})
""")
def _(spark, root):
    return shorten(spark, root).select(
        "trace", tr.keep_row(F.col("drop_reason"), F.col("resolved"), F.col("n_actions")).alias("keep")
    )


@query("f04_routing", f"""
select trace, case when drop_reason is not null then drop_reason when n_actions <= 1 then 'short_kept' when trace % 9 = 0 then 'no_instance'
       else 'prefix_search' end as route from ({SHORTEN})
""")
def _(spark, root):
    where = tr.route(F.col("drop_reason"), F.col("n_actions"), F.col("trace") % 9 != 0, 1)
    return shorten(spark, root).select("trace", where.alias("route"))


COMMANDS = [
    "cd /testbed && git log", "cat src/.git/config", "curl http://x", "python -c 'import urllib.request'", "pip install x",
    "python3 -m pip install y", "echo a > tests/conftest.py", "cat x | tee -a setup.cfg", "grep digit f.py", "echo install git",
]


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# What each command is, written down apart from the patterns under test.
REASONS = ["git_use", "git_metadata", "network", "network", "package_install", "package_install", "test_tampering", "test_tampering", None, None]
REASON_SQL = "[" + ", ".join("null" if r is None else quoted(r) for r in REASONS) + "][doc_id % 10 + 1]"


@query("f12_forbidden_action", f"select doc_id, {REASON_SQL} as reason from documents")
def _(spark, root):
    command = F.get(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("doc_id") % 10).cast("int"))
    action = F.concat("text", F.lit("\n"), command)
    return spread_table(spark, root, "documents", "doc_id").select("doc_id", tr.forbidden_reason(action).alias("reason"))


@query("f13_edit_action", f"""
select trace, idx, regexp_matches(action, '(?i)(?:^|[\\n;`(]|&&|\\|\\|?)\\s*(?:sed\\b|tee\\b|patch\\b|printf\\b|cat\\s+(?:>>|>)|>>|install\\b)')
  or contains(action, 'COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT') as is_edit from ({ACTS}) where action is not null
""")
def _(spark, root):
    acts = parsed(spark, root).where("action is not null")
    return acts.select("trace", "idx", tr.is_edit(F.col("action")).alias("is_edit"))


NUMBERED = f"select *, count(action) over (partition by trace order by idx) as k from ({ACTS})"
EDIT_SQL = "(starts_with(action, 'sed') or contains(action, 'COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT'))"
CANDIDATES = f"""
select distinct trace, k from ({NUMBERED}) where action is not null and {EDIT_SQL}
union select trace, max(k) from ({NUMBERED}) where action is not null group by 1
"""


def numbered(spark, root):
    return tr.number_actions(parsed(spark, root), "trace", "idx")


@query("w11_candidate_prefixes", CANDIDATES)
def _(spark, root):
    return tr.candidate_prefixes(numbered(spark, root), "trace")


# A prefix passes in the replay table when (trace + k) % 3 > 0.
SHORTEST = f"""
select trace, min(k) filter (where (trace + k) % 3 > 0) as k_prefix,
       case when min(k) filter (where (trace + k) % 3 > 0) is null then 'replay_drift' end as drop_reason from ({CANDIDATES}) group by 1
"""


def shortest(spark, root):
    candidates = tr.candidate_prefixes(numbered(spark, root), "trace")
    replayed = candidates.withColumn("ok", (F.col("trace") + F.col("k")) % 3 > 0)
    return tr.shortest_passing(replayed, "trace", "k", "ok")


@query("w12_shortest_passing", SHORTEST)
def _(spark, root):
    return shortest(spark, root)


@query("p03_prefix_evaluator", """
with o as (select l_orderkey as trace, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as k, l_returnflag = 'R' as ok from lineitem)
select trace, min(k) filter (where ok) as k_prefix, case when min(k) filter (where ok) is null then 'replay_drift' end as drop_reason from o group by 1
""")
def _(spark, root):
    """The replay outcomes come as a table: line items as prefixes, returned ones pass."""
    from rungauge.functions.ranks import with_position

    lines = table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("trace"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("ok")
    )
    placed = with_position(lines, ["trace"], ["l_linenumber", "l_partkey", "l_suppkey"], "k")
    return tr.shortest_passing(placed, "trace", "k", "ok")


# Each candidate knows how many characters of commands a replay would run; the evaluator passes two thirds of them.
CHARS = f"select trace, k, max(chars) as chars from (select *, sum(length(action)) over (partition by trace order by idx) as chars from ({NUMBERED})) join ({CANDIDATES}) using (trace, k) where action is not null group by 1, 2"
RANKED = f"select *, (trace + k + chars) % 3 > 0 as ok, row_number() over (partition by trace order by k) as rank from ({CHARS})"


def replay():
    """A replay in place of a container: looks at the trace, the prefix and the commands' length."""
    import pyarrow as pa

    def passes(batch):
        total = sum(batch[c].to_numpy() for c in ("trace", "k", "chars"))
        return pa.array(total % 3 > 0)

    return passes


def replay_candidates(spark, root):
    acts = numbered(spark, root)
    chars = running(acts, ["trace"], ["idx"], {"chars": ("sum", F.length("action"))}).where("action is not null")
    return tr.candidate_prefixes(acts, "trace").join(chars.select("trace", "k", "chars"), ["trace", "k"])


@query("p03_frontier_search", f"""
with r as ({RANKED}), first as (select trace, min(rank) filter (where ok) as hit, count(*) as n from r group by 1)
select r.trace, max(k) filter (where rank = hit) as k_prefix, any_value(coalesce(hit, n))::bigint as n_evaluated, any_value(n) as n_candidates,
  case when any_value(hit) is null then 'replay_drift' end as drop_reason from r join first using (trace) group by 1
""")
def _(spark, root):
    """Prefixes asked from the smallest up, one a round; the number of asked ones is part of the result."""
    return ps.shortest(ps.search(replay_candidates(spark, root), "trace", "k", replay), "trace", "k")


@query("p03_evaluated_pairs", f"""
with r as ({RANKED}), first as (select trace, min(rank) filter (where ok) as hit from r group by 1)
select trace, k, rank, case when hit is null or rank < (((hit - 1) // 2) * 2 + 3) then ok end as ok from r join first using (trace)
""")
def _(spark, root):
    """Two prefixes a round: every pair with its answer, null where it was never asked."""
    return ps.search(replay_candidates(spark, root), "trace", "k", replay, width=2)


TRUNCATED = f"""
select n.trace, n.idx, n.role, n.content, n.action from ({NUMBERED}) n join ({SHORTEST}) s on s.trace = n.trace
where s.k_prefix is not null and (n.k < s.k_prefix or (n.action is not null and n.k = s.k_prefix))
"""


def truncated(spark, root):
    return tr.truncate_at(numbered(spark, root), shortest(spark, root).where("k_prefix is not null"), "trace", "k_prefix")


@query("w10_truncate", f"select trace, idx, role, length(content) as n_chars from ({TRUNCATED})")
def _(spark, root):
    return truncated(spark, root).select("trace", "idx", "role", F.length("content").alias("n_chars"))


@query("w13_terminal_submit", f"""
with t as ({TRUNCATED}), l as (select trace, max(idx) as e, arg_max(action, idx) filter (where action is not null) as a from t group by 1)
select trace, idx, role, content from t union all
select trace, e + 1, 'assistant', '```bash' || chr(10) || 'echo COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT' || chr(10) || '```' from l
where a is null or not contains(a, 'COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT')
""")
def _(spark, root):
    return tr.terminal_submit(truncated(spark, root), "trace", "idx", "role", "content")


SEGMENTED = f"select *, case when trace % 2 = 0 then 'post' else 'main' end as segment from ({MESSAGES})"


def segmented(spark, root):
    return messages(spark, root).withColumn("segment", F.when(F.col("trace") % 2 == 0, "post").otherwise("main"))


@query("w16_learnable", f"""
with m as (select trace, idx, segment, case when idx in (2, 3) then 'assistant' else role end as role from ({SEGMENTED})),
 o as (select *, sum(case when idx >= 2 and role <> 'assistant' then 1 else 0 end) over (partition by trace order by idx) as others,
              lead(role) over (partition by trace order by idx) as next_role from m)
select trace, idx, role = 'assistant' and not (segment = 'post' and idx >= 2 and others = 0 and coalesce(next_role, '') = 'assistant') as learnable from o
""")
def _(spark, root):
    rows = segmented(spark, root).withColumn("role", F.when(F.col("idx").isin(2, 3), "assistant").otherwise(F.col("role")))
    return tr.mark_learnable(rows, ["trace"], "idx", "role", "segment").select("trace", "idx", "learnable")


@query("w17_synthetic", f"""
select trace, idx, segment = 'post' and role = 'assistant' and idx = min(case when role = 'assistant' then idx end) over (partition by trace) as synthetic
from ({SEGMENTED})
""")
def _(spark, root):
    return tr.mark_synthetic(segmented(spark, root), ["trace"], "idx", "role", "segment").select("trace", "idx", "synthetic")


LIMITS = {"turns": 4, "turn_tokens": 60, "context": 300}
FLAGGED = f"""
with m as ({MESSAGES}), s as (select trace, count_if(role = 'assistant') as n_turns,
   max(case when role = 'assistant' then cast(floor(length(content) / 3.7::double + 0.5) as bigint) end) as mt,
   sum(cast(floor(length(content) / 3.7::double + 0.5) as bigint)) as nt, arg_max(role, idx) = 'assistant' and length(arg_max(content, idx)) > 0 as has_final
   from m group by 1)
select trace, (case trace % 3 when 0 then 'main' when 1 then 'post' else 'compact' end) as segment, trace % 4 > 0 as resolved, n_turns, list_filter([case when trace % 11 = 0 then 'edits_tests' end, case when trace % 6 = 1 then 'never_ran_tests' end,
   case when trace % 13 = 0 then 'post_segments_missing' end, case when n_turns > 4 then 'over_turn_cap' end, case when mt > 60 then 'long_turn' end,
   case when nt > 300 then 'over_context' end, case when not has_final or trace % 10 = 3 then 'no_final_answer' end], lambda x: x is not null) as flags from s
"""


def flagged(spark, root):
    tokens = tx.estimated_tokens(F.col("content"))
    assistant = F.col("role") == "assistant"
    t = F.col("trace")
    rows = messages(spark, root).groupBy("trace").agg(
        F.count_if(assistant).alias("rollout_turns"),
        F.max(F.when(assistant, tokens)).alias("max_turn_tokens"),
        F.sum(tokens).alias("n_tokens"),
        (F.max_by("role", "idx") == "assistant").alias("_a"),
        F.max_by(F.length("content"), "idx").alias("_l"),
    ).select(
        "trace",
        F.when(t % 3 == 0, "main").when(t % 3 == 1, "post").otherwise("compact").alias("segment"),
        (t % 4 > 0).alias("resolved"),
        "rollout_turns",
        F.col("rollout_turns").alias("n_turns"),
        "max_turn_tokens",
        "n_tokens",
        (F.col("_a") & (F.col("_l") > 0)).alias("has_final"),
        F.when(t % 11 == 0, 1).otherwise(0).alias("n_test_files"),
        (t % 6 != 1).alias("ran_tests"),
        F.when(t % 13 == 0, 1).otherwise(0).alias("n_lost_segments"),
        F.lit(False).alias("turn_capped"),
        F.lit(True).alias("is_last"),
        F.when(t % 10 == 3, "length").otherwise("stop").alias("finish"),
    )
    return rows.withColumn("flags", tr.quality_flags(LIMITS))


@query("f19_quality_flags", f"select trace, array_to_string(flags, ',') as flags from ({FLAGGED})")
def _(spark, root):
    return flagged(spark, root).select("trace", F.array_join("flags", ",").alias("flags"))


ROWS = f"select 'r' || trace % 2 as run, trace // 3 as instance_id, segment, resolved, n_turns, flags from ({FLAGGED})"


def card_rows(spark, root):
    return flagged(spark, root).select(
        F.concat(F.lit("r"), (F.col("trace") % 2).cast("string")).alias("run"),
        F.floor(F.col("trace") / 3).alias("instance_id"), "segment", "resolved", "n_turns", "flags",
    )


@query("f08_sft_ready", f"""
select run, instance_id, bool_and(resolved) as resolved, bool_and(len(flags) = 0 or segment = 'compact') as clean, count(*) as n_rows,
       bool_and(resolved) and bool_and(len(flags) = 0 or segment = 'compact') as sft_ready from ({ROWS}) group by 1, 2
""")
def _(spark, root):
    return tr.ready_rollouts(card_rows(spark, root), ["run", "instance_id"])


@query("a18_dataset_card", f"""
with p as (select run, instance_id, bool_and(resolved) as r, bool_and(len(flags) = 0 or segment = 'compact') as c,
   bool_or(list_contains(flags, 'post_segments_missing')) as inc, sum(case when segment <> 'compact' then n_turns else 0 end)::bigint as turns,
   count(*) as n, count_if(resolved) as rr, count_if(resolved and len(flags) = 0) as cr from ({ROWS}) group by 1, 2),
 o as (select turns, row_number() over (order by turns) - 1 as i, count(*) over () as c from p)
select cast(sum(n) as bigint) as n_rows, count(*) as n_rollouts, count_if(r) as n_resolved_rollouts, count_if(r and c) as n_clean_resolved_rollouts,
   count_if(not inc) as n_complete_rollouts, cast(sum(rr) as bigint) as n_resolved_rows, cast(sum(cr) as bigint) as n_clean_resolved_rows,
   round(avg(turns), 6) as turns_mean, max(turns) as turns_max, count(distinct instance_id) as n_problems,
   (select turns from o where i = least(c - 1, floor(0.5 * c))) as turns_p50, (select turns from o where i = least(c - 1, floor(0.9 * c))) as turns_p90 from p
""")
def _(spark, root):
    from rungauge.operators.curation import card

    return card(card_rows(spark, root)).withColumn("turns_mean", F.round("turns_mean", 6))


@query("a18_flag_histogram", f"select flag, count(*) as n from (select unnest(flags) as flag from ({ROWS})) group by 1")
def _(spark, root):
    from rungauge.operators.curation import card_histogram

    return card_histogram(card_rows(spark, root), F.col("flags"), "flag")


@query("a18_segment_distribution", f"""
with o as (select segment, n_turns, row_number() over (partition by segment order by n_turns) - 1 as i, count(*) over (partition by segment) as c from ({ROWS}))
select segment, count(*) as n, round(avg(n_turns), 6) as mean, max(n_turns) as max, max(case when i = least(c - 1, floor(0.5 * c)) then n_turns end) as p50,
   max(case when i = least(c - 1, floor(0.9 * c)) then n_turns end) as p90 from o group by 1
""")
def _(spark, root):
    from rungauge.operators.curation import segment_distribution

    return segment_distribution(card_rows(spark, root), "segment", "n_turns").withColumn("mean", F.round("mean", 6))


# Conversations as segments: three in a row are one rollout; every turn of the assistant calls up to two tools.
CARD_ROWS = """
select 'r' || conv_id % 2 as run, conv_id // 6 as instance_id, case conv_id % 3 when 0 then 'main' when 1 then 'post' else 'compact' end as segment,
  case when conv_id % 11 = 0 then ['post_segments_missing'] when conv_id % 7 = 0 then ['no_final', 'turn_capped'] else [] end as flags,
  count_if(role = 'assistant') as n_turns, coalesce(sum(length(text)), 0)::bigint as n_tokens, coalesce(max(length(text)), 0) as max_turn_tokens,
  case when conv_id // 6 % 5 <> 1 then (conv_id // 6 % 97) * 1.5 end as wall_seconds, case when conv_id // 6 % 4 <> 2 then conv_id // 6 % 3 end as n_compactions, 'img' || conv_id // 6 % 8 as image
from conversations group by conv_id
"""
CARD_ROLLOUTS = f"""
select run, instance_id, sum(case when segment <> 'compact' then n_turns else 0 end) as turns, not bool_or(list_contains(flags, 'post_segments_missing')) as complete,
  coalesce(max(wall_seconds), 0) as wall, max(n_compactions) as n_compactions, min(image) as image from ({CARD_ROWS}) group by 1, 2
"""


def card_segments(spark, root):
    c, instance = F.col("conv_id"), F.floor(F.col("conv_id") / 6)
    per = table(spark, root, "conversations").where("conv_id is not null").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "assistant").alias("n_turns"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_tokens"), F.coalesce(F.max(F.length("text")), F.lit(0)).alias("max_turn_tokens")
    )
    flags = F.when(c % 11 == 0, F.array(F.lit("post_segments_missing"))).when(c % 7 == 0, F.array(F.lit("no_final"), F.lit("turn_capped"))).otherwise(F.array().cast("array<string>"))
    return per.select(
        F.concat(F.lit("r"), (c % 2).cast("string")).alias("run"), instance.alias("instance_id"), F.when(c % 3 == 0, "main").when(c % 3 == 1, "post").otherwise("compact").alias("segment"),
        flags.alias("flags"), "n_turns", "n_tokens", "max_turn_tokens", F.when(instance % 5 != 1, (instance % 97) * 1.5).alias("wall_seconds"),
        F.when(instance % 4 != 2, instance % 3).alias("n_compactions"), F.concat(F.lit("img"), (instance % 8).cast("string")).alias("image"),
    )


@query("a18_card_distributions", f"""
with r as ({CARD_ROWS}), o as ({CARD_ROLLOUTS}),
 m as (select 'tokens_' || segment as measure, n_tokens::double as v from r union all select 'turns_' || segment, n_turns from r where segment <> 'compact'
   union all select 'max_turn_tokens', max_turn_tokens from r where segment <> 'compact' union all select 'rollout_turns', turns from o
   union all select 'complete_rollout_turns', turns from o where complete union all select 'wall_seconds', wall from o),
 p as (select *, row_number() over (partition by measure order by v) - 1 as i, count(*) over (partition by measure) as c from m)
select measure, count(*) as n, round(avg(v), 6) as mean, max(case when i = least(c - 1, floor(0.5 * c)) then v end) as p50, max(case when i = least(c - 1, floor(0.9 * c)) then v end) as p90, max(v) as max
from p group by 1
""")
def _(spark, root):
    from rungauge.operators.curation import card_distributions

    return card_distributions(card_segments(spark, root)).withColumn("mean", F.round("mean", 6))


@query("a18_card_counts", f"""
with r as ({CARD_ROWS}), o as ({CARD_ROLLOUTS}), t as (select unnest(case when length(text) % 2 = 0 then ['bash', 'edit' || length(text) % 5] else ['view'] end) as tool from conversations where role = 'assistant' and turn % 7 <> 5),
 c as (select 'run' as kind, run as name from r union all select 'segment', segment from r union all select 'flag', unnest(flags) from r
   union all select 'compactions', coalesce(n_compactions::varchar, 'unknown(>=1)') from o union all select 'image', image from o union all select 'tool', tool from t)
select kind, name, count(*) as n from c group by 1, 2
""")
def _(spark, root):
    from rungauge.operators.curation import card_counts

    n = F.length("text")
    tools = F.when(n % 2 == 0, F.array(F.lit("bash"), F.concat(F.lit("edit"), (n % 5).cast("string")))).otherwise(F.array(F.lit("view")))
    messages = table(spark, root, "conversations").select("role", (F.col("turn") % 7 == 5).alias("synthetic"), tools.alias("tools"))
    return card_counts(card_segments(spark, root), messages)


DIFF = """case doc_id % 4 when 0 then 'diff --git a/src/x.py b/src/x.py' || chr(10) || '--- a/src/x.py' || chr(10) || '+++ b/src/x.py' || chr(10) || '+' || replace(text, chr(10), ' ')
  when 1 then 'diff --git a/src/y.py b/src/y.py' || chr(10) || '+a' || chr(10) || 'diff --git a/tests/test_y.py b/tests/test_y.py' || chr(10) || '+' || replace(text, chr(10), ' ')
  when 2 then '--- a/z/conftest.py' || chr(10) || '+++ b/z/conftest.py' || chr(10) || '+' || replace(text, chr(10), ' ') else '' end"""


@query("t21_patch_audit", """
select doc_id, case doc_id % 4 when 0 then 'src/x.py' when 1 then 'src/y.py tests/test_y.py' when 2 then 'z/conftest.py' else '' end as files,
       case doc_id % 4 when 1 then 'tests/test_y.py' when 2 then 'z/conftest.py' else '' end as test_files, doc_id % 4 in (1, 2) as edits_tests
from documents
""")
def _(spark, root):
    rows = spread_table(spark, root, "documents", "doc_id").select("doc_id", F.expr(DIFF.replace("chr(", "char(")).alias("diff"))
    out = tr.patch_audit(rows, "doc_id", "diff")
    return out.select(
        "doc_id", F.array_join("files", " ").alias("files"), F.array_join("test_files", " ").alias("test_files"), "edits_tests"
    )
