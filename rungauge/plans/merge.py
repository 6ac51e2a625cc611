"""Turn merge, guard and token-array queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungauge.functions import arrays
from rungauge.functions.codec import PieceCodec, continuation_of, ids_of, text_of
from rungauge.functions.ordered import running
from rungauge.operators import batches as bt
from rungauge.operators import merge as mg
from rungauge.plans import bindings as b
from rungauge.plans.registry import query
from rungauge.plans.sequences import TURNS, turns
from rungauge.session import table
from rungauge.shared import cut_lineage

# Line items as captured turns.  The token stream of an order is 1, 2, 3, ...: a
# turn samples ``resp`` ids and the next prompt holds ``obs`` ids more.  Where
# the line is open and the quantity small, the prompt is shifted and so broken.
BY = "partition by rollout order by turn"
TURN_SQL = """
select rollout, turn, resp, obs, base, case when turn > 1 and flag then 1000 else 0 end as shift,
  sum(obs + resp) over (partition by rollout order by turn) - resp as n_prompt
from (select l_orderkey as rollout, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as turn,
        (l_quantity::integer % 5 + 1)::bigint as resp, (l_partkey % 3 + 1)::bigint as obs, 0 as base, l_linestatus = 'O' and l_quantity < 12 as flag from lineitem)
"""


def token_turns(spark, root):
    """Captured turns with token arrays made of running sums, as a written table; log-probs differ by id."""
    lines = turns(spark, root).withColumnRenamed("l_orderkey", "rollout")
    lines = lines.withColumns({
        "resp": (F.col("l_quantity").cast("int") % 5 + 1).cast("long"), "obs": (F.col("l_partkey") % 3 + 1).cast("long"),
        "flag": (F.col("l_linestatus") == "O") & (F.col("l_quantity") < 12),
    })
    rows = running(lines, ["rollout"], TURNS, {"turn": ("sum", F.lit(1)), "_upto": ("sum", F.col("obs") + F.col("resp"))})
    n_prompt = (F.col("_upto") - F.col("resp")).cast("int")
    shift = F.when((F.col("turn") > 1) & F.col("flag"), 1000).otherwise(0)
    ids = lambda lo, hi: F.transform(F.sequence(lo, hi), lambda i: (i + shift).cast("int"))
    response = ids(n_prompt + 1, n_prompt + F.col("resp").cast("int"))
    return cut_lineage(rows.select(
        "rollout", "turn", ids(F.lit(1), n_prompt).alias("prompt"), response.alias("response"),
        F.transform(response, lambda i: -(i % 7 + 1) / 8.0).alias("logp"),
    ), "turns")


def merge(rows, max_prompt, max_response, **options):
    """Where each turn goes, from its links to the turn before."""
    return mg.merged_rows(mg.continuity(rows, ["rollout"], "turn"), ["rollout"], "turn", max_prompt, max_response, **options)


def train(rows, max_prompt, max_response):
    """The training rows of captured turns."""
    return mg.training_rows(merge(rows, max_prompt, max_response), rows, ["rollout"], "turn", max_prompt, max_response)


def digests(rows):
    """Every value of the rows in one digest per field."""
    text = lambda c, f: F.md5(F.array_join(F.transform(c, f), ",").cast("binary"))
    plain = lambda x: x.cast("string")
    return rows.select(
        "rollout", "row_start", "truncated", text("prompt", plain).alias("prompt_md5"), text("response", plain).alias("response_md5"),
        text("mask", plain).alias("mask_md5"), text("logp", lambda x: (x * 8).cast("int").cast("string")).alias("logp_md5"),
    )


# A break: the prompt's shift differs from the one before.
LINKED = f"""
select *, case when turn = 1 then 'first' when shift = lag(shift) over ({BY}) then 'ids' else 'broken' end as continuity from ({TURN_SQL})
"""
SEGMENTED = f"select *, cast(count_if(continuity = 'broken') over ({BY}) as bigint) as segment from ({LINKED})"


@query("w21_merge_breaks", f"""
select rollout, turn, continuity, segment, case when continuity = 'ids' then obs else 0 end as n_observed from ({SEGMENTED})
""")
def _(spark, root):
    out = merge(token_turns(spark, root), 10_000, 10_000)
    return out.select("rollout", "turn", "continuity", "segment", F.col("n_obs").cast("long").alias("n_observed"))


@query("w21_merged_rows", f"""
select rollout, min(turn) as row_start, cast(sum(resp) as bigint) as n_sampled,
  cast(sum(resp) + sum(case when continuity = 'ids' then obs else 0 end) as bigint) as n_tokens, cast(arg_min(n_prompt, turn) as bigint) as n_prompt
from ({SEGMENTED}) group by rollout, segment
""")
def _(spark, root):
    out = train(token_turns(spark, root), 10_000, 10_000)
    return out.select(
        "rollout", "row_start", F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n_sampled"),
        F.size("response").cast("long").alias("n_tokens"), F.size("prompt").cast("long").alias("n_prompt"),
    )


def digest_sql(rows, max_prompt, max_response):
    """Digests of rows whose ids are a range: ``rows`` gives rollout, row_start, np, shift, n (ids of the response) and m (its mask as text)."""
    ids = lambda lo, hi: f"array_to_string(list_transform(range({lo}, {hi}), lambda i: i + shift), ',')"
    logp = f"array_to_string(list_transform(range(1, least(n, {max_response}) + 1), lambda i: case when m[i] = '1' then -((np + i + shift) % 7 + 1) else 0 end), ',')"
    return f"""
select rollout, row_start, n > {max_response} or np > {max_prompt} as truncated, md5({ids(1, f"least(np, {max_prompt}) + 1")}) as prompt_md5,
  md5({ids("np + 1", f"np + least(n, {max_response}) + 1")}) as response_md5, md5(array_to_string(string_split(m[1:{max_response}], ''), ',')) as mask_md5, md5({logp}) as logp_md5
from (select rollout, row_start, np::bigint as np, shift, length(m) as n, m from ({rows}))
"""


@query("w21_row_digests", digest_sql(f"""
select rollout, min(turn) as row_start, arg_min(n_prompt, turn) as np, any_value(shift) as shift,
  string_agg(case when continuity = 'ids' then repeat('0', obs::int) else '' end || repeat('1', resp::int), '' order by turn) as m from ({SEGMENTED}) group by rollout, segment
""", 10_000, 10_000))
def _(spark, root):
    """Every prompt id, response id, mask bit and log-prob of the merged rows."""
    return digests(train(token_turns(spark, root), 10_000, 10_000))


LIMIT_PROMPT, LIMIT_RESPONSE = 20, 9
# The cuts turn by turn, as a recursive query.
FOLDED = f"""
with recursive s as (select *, case when continuity = 'ids' then obs else 0 end as o, row_number() over (partition by rollout, segment order by turn) as i from ({SEGMENTED})),
 f as (select rollout, segment, turn, i, resp as len, turn as row_start, true as opens, false as blocked, n_prompt from s where i = 1
   union all
   select s.rollout, s.segment, s.turn, s.i, case when f.len + s.o + s.resp > {LIMIT_RESPONSE} and s.n_prompt <= {LIMIT_PROMPT} then s.resp else f.len + s.o + s.resp end,
     case when f.len + s.o + s.resp > {LIMIT_RESPONSE} and s.n_prompt <= {LIMIT_PROMPT} then s.turn else f.row_start end,
     f.len + s.o + s.resp > {LIMIT_RESPONSE} and s.n_prompt <= {LIMIT_PROMPT}, f.len + s.o + s.resp > {LIMIT_RESPONSE} and s.n_prompt > {LIMIT_PROMPT}, s.n_prompt
   from f join s on s.rollout = f.rollout and s.segment = f.segment and s.i = f.i + 1)
"""


@query("w22_budget_split", f"{FOLDED} select rollout, turn, row_start, opens as opens_row, blocked from f")
def _(spark, root):
    out = merge(token_turns(spark, root), LIMIT_PROMPT, LIMIT_RESPONSE)
    return out.select("rollout", "turn", "row_start", "opens_row", "blocked")


@query("w22_merge_metrics", f"""
{FOLDED}, c as (select f.*, s.continuity from f join s on s.rollout = f.rollout and s.turn = f.turn),
 p as (select rollout, count_if(opens) as r, count_if(opens and continuity = 'ids') as sp, count_if(blocked) as b, count_if(continuity = 'broken') as k from c group by 1)
select count(*) as n_rollouts, sum(r)::bigint as n_rows, sum(sp)::bigint as n_budget_splits, sum(b)::bigint as n_budget_splits_blocked, sum(k)::bigint as n_merge_mismatch_rows,
  count_if(k > 0) as n_unmerged_rollouts, 0::bigint as n_text_level_merges from p
""")
def _(spark, root):
    out = merge(token_turns(spark, root), LIMIT_PROMPT, LIMIT_RESPONSE)
    return mg.merge_metrics(out, ["rollout"])


@query("w22_budget_rows", f"""
{FOLDED}, c as (select f.*, s.resp, s.o from f join s on s.rollout = f.rollout and s.turn = f.turn),
 r as (select rollout, row_start, sum(case when opens then resp else o + resp end) as n, arg_min(n_prompt, turn) as np from c group by 1, 2)
select rollout, row_start, least(n, {LIMIT_RESPONSE})::bigint as n_tokens, least(np, {LIMIT_PROMPT})::bigint as n_prompt, n > {LIMIT_RESPONSE} or np > {LIMIT_PROMPT} as truncated from r
""")
def _(spark, root):
    out = train(token_turns(spark, root), LIMIT_PROMPT, LIMIT_RESPONSE)
    return out.select(
        "rollout", "row_start", F.size("response").cast("long").alias("n_tokens"), F.size("prompt").cast("long").alias("n_prompt"), "truncated"
    )


@query("w22_row_digests", FOLDED + ", t as (" + digest_sql("""
select f.rollout, f.row_start, arg_min(s.n_prompt, f.turn) as np, any_value(s.shift) as shift,
  string_agg(case when f.opens then '' else repeat('0', s.o::int) end || repeat('1', s.resp::int), '' order by f.turn) as m
from f join s on s.rollout = f.rollout and s.turn = f.turn group by 1, 2
""", LIMIT_PROMPT, LIMIT_RESPONSE) + ") select * from t")
def _(spark, root):
    """The same for rows that budgets cut and limits shorten."""
    return digests(train(token_turns(spark, root), LIMIT_PROMPT, LIMIT_RESPONSE))


@query("w23_missing_prompts", f"""
select rollout, turn, case when turn > 1 and rollout % 4 = 0 and turn % 3 <> 1 then
   arg_max(n_prompt, turn) filter (where not (turn > 1 and rollout % 4 = 0 and turn % 3 <> 1)) over (partition by rollout order by turn)
   + sum(resp) over (partition by rollout, (turn - 1) // 3 order by turn) - resp else n_prompt end::bigint as n_prompt from ({TURN_SQL})
""")
def _(spark, root):
    rows = token_turns(spark, root)
    lost = (F.col("turn") > 1) & (F.col("rollout") % 4 == 0) & (F.col("turn") % 3 != 1)
    rows = rows.withColumn("prompt", F.when(lost, F.array().cast("array<int>")).otherwise(F.col("prompt")))
    out = mg.fill_prompts(rows, ["rollout"], "turn")
    return out.select("rollout", "turn", F.size("prompt").cast("long").alias("n_prompt"))


@query("w24_strict_prefix", f"""
with s as ({SEGMENTED}), m as (select rollout, max(segment) as last from s group by 1)
select 'drop' as policy, count(distinct s.rollout) as n_rollouts, count(distinct s.rollout) filter (last = 0) as n_kept, count(distinct s.rollout) filter (last > 0) as n_dropped,
  cast(sum(resp) filter (last = 0) as bigint) as n_sampled from s join m using (rollout)
union all select 'keep_terminal', count(distinct s.rollout), count(distinct s.rollout), 0, cast(sum(resp) filter (segment = last) as bigint) from s join m using (rollout)
""")
def _(spark, root):
    rows = token_turns(spark, root)
    links = mg.continuity(rows, ["rollout"], "turn")  # the same for both policies
    out = None
    for policy in ("drop", "keep_terminal"):
        merged = mg.merged_rows(links, ["rollout"], "turn", 10_000, 10_000, policy=policy)
        part = mg.policy_counts(rows, merged, ["rollout"]).withColumn("policy", F.lit(policy))
        out = part if out is None else out.unionByName(part)
    return out


@query("w25_reward_placement", f"""
select rollout, min(turn) as row_start, cast(sum(resp) + sum(case when continuity = 'ids' then obs else 0 end) - 1 as bigint) as reward_at, 1 as n_scores
from ({SEGMENTED}) group by rollout, segment
""")
def _(spark, root):
    rows = train(token_turns(spark, root), 10_000, 10_000).withColumn("reward", F.lit(0.75))
    out = mg.place_rewards(rows, "reward", on_action=True)
    return out.select(
        "rollout", "row_start", (F.array_position("scores", 0.75) - 1).alias("reward_at"),
        F.size(F.filter("scores", lambda x: x != 0)).alias("n_scores"),
    )


# Values per token of an embedding; observations are every third token.
ARRAYS = """
select vec_id, list_transform(range(1, 65), lambda i: round(abs(embedding[i]::double), 4)) as v,
  list_transform(range(1, 65), lambda i: case when i % 3 = 0 and i < 64 then 0 else 1 end) as m from embeddings
"""


def value_rows(spark, root):
    index = F.sequence(F.lit(1), F.size("embedding"))
    mask = F.transform(index, lambda i: F.when((i % 3 == 0) & (i < 64), 0).otherwise(1))
    return table(spark, root, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")), 4)).alias("values"), mask.alias("mask")
    ).withColumn("reward", F.col("label") / 10.0)


# Over sampled tokens only: delta_t summed with weights (gamma * lambda) ** distance.
@query("w26_advantages", """
with a as (""" + ARRAYS + """), e as (select vec_id, v, m, label / 10.0 as r from a join (select vec_id, label from embeddings) using (vec_id)),
 t as (select vec_id, unnest(list_filter(range(1, 65), lambda i: m[i] = 1)) as i, v, r from e),
 n as (select *, row_number() over (partition by vec_id order by i) as j, count(*) over (partition by vec_id) as n, v[i] as vi, lead(v[i]) over (partition by vec_id order by i) as vn from t),
 d as (select *, (case when j = n then r else 0 end) + 0.9 * coalesce(vn, 0) - vi as delta from n)
select vec_id, round(sum(delta * pow(0.72, j - 1)), 6) as first_advantage, round(sum(delta * pow(0.72, j - 1)) + any_value(v[1]), 6) as first_return from d group by 1
""")
def _(spark, root):
    rows = mg.place_rewards(value_rows(spark, root), "reward", on_action=True)
    out = mg.row_advantages(rows, "values", 0.9, 0.8)
    return out.select(
        "vec_id", F.round(F.element_at("advantages", 1), 6).alias("first_advantage"), F.round(F.element_at("returns", 1), 6).alias("first_return")
    )


@query("l10_pad_to_batch", """
with r as (select vec_id, label as batch, 10 + vec_id % 23 as np, 5 + vec_id % 17 as nr from embeddings),
 w as (select batch, max(np) as wp, max(nr) as wr from r group by 1)
select vec_id, r.batch, wp::bigint as prompt_width, wr::bigint as response_width, (wp - np)::bigint as left_pads, (wr - nr)::bigint as right_pads, nr::bigint as real_response from r join w on w.batch = r.batch
""")
def _(spark, root):
    ids = F.transform("embedding", lambda x: (F.abs(x.cast("double")) * 1000 + 1).cast("int"))
    rows = table(spark, root, "embeddings").select(
        "vec_id", F.col("label").alias("batch"), F.slice(ids, F.lit(1), (F.col("vec_id") % 23 + 10).cast("int")).alias("prompt"),
        F.slice(ids, F.lit(30), (F.col("vec_id") % 17 + 5).cast("int")).alias("response"),
    )
    out = bt.pad_to_batch(rows, ["batch"], "prompt", "response", 0)
    zero = lambda c: F.size(F.filter(c, lambda x: x == 0)).cast("long")
    return out.select(
        "vec_id", "batch", F.size("prompt").cast("long").alias("prompt_width"), F.size("response").cast("long").alias("response_width"),
        zero("prompt").alias("left_pads"), zero("response").alias("right_pads"),
        F.aggregate("response_pad_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("real_response"),
    )


@query("t13_divergence", """
select vec_id, case when vec_id % 3 = 0 then 64 - vec_id % 40 else vec_id % 64 end::bigint as diverge_index, case when vec_id % 3 = 0 then 'ran_out' else 'token_differs' end as diverge_kind,
  least(64, case when vec_id % 3 = 0 then 64 - vec_id % 40 else vec_id % 64 end + 5) - greatest(0, case when vec_id % 3 = 0 then 64 - vec_id % 40 else vec_id % 64 end - 5) as n_expected from embeddings
""")
def _(spark, root):
    i = F.col("vec_id")
    ids = F.transform("embedding", lambda x: (x.cast("double") * 100000).cast("int"))
    changed = F.transform(ids, lambda x, j: F.when(j == i % 64, x + 1).otherwise(x))
    short = F.slice(ids, F.lit(1), (64 - i % 40).cast("int"))
    rows = table(spark, root, "embeddings").select(
        "vec_id", ids.alias("expected"), F.when(i % 3 == 0, short).otherwise(changed).alias("actual")
    )
    out = mg.divergence(rows, "expected", "actual", 5)
    return out.select("vec_id", "diverge_index", "diverge_kind", F.size("expected_window").cast("long").alias("n_expected"))


@query("t14_text_continuation", """
with c as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations)
select conv_id, turn, case when before is null then 'first' when (conv_id + turn) % 5 = 0 then 'broken' else 'ids' end as continuity,
  case when before is not null and (conv_id + turn) % 5 > 0 then length(text) else 0 end as n_observed from c
""")
def _(spark, root):
    # Code points as ids: each prompt is the text before it plus its own, a fifth of them altered.
    points = lambda t: F.transform(F.split(t, ""), lambda ch: F.ascii(ch))
    rows = running(table(spark, root, "conversations"), ["conv_id"], ["turn"], {"before": ("prev", F.col("text"))})
    prompt = F.concat(
        F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.lit("~")).otherwise(""), F.coalesce("before", F.lit("")), "text"
    )
    pairs = rows.select(
        "conv_id", "turn", points(prompt).alias("prompt"), points(F.coalesce("before", F.lit(""))).alias("context"), F.col("before").isNull().alias("first")
    )
    same = arrays.starts_with(F.col("prompt"), F.col("context"))
    how = F.when(F.col("first"), "first").when(same, "ids").otherwise("broken")
    rest = F.size(arrays.rest_after(F.col("prompt"), F.size("context")))
    return pairs.select("conv_id", "turn", how.alias("continuity"), F.when(~F.col("first") & same, rest).otherwise(0).alias("n_observed"))


# Neighbouring texts of a conversation as a rollout of two turns.  Pieces are single bytes and pairs of
# frequent letters; two of three responses were sampled byte by byte, a fifth of the prompts lost their first letter.
PAIRED = "etaoinshr"
PIECES_SQL = f"regexp_extract_all({{}}, '[{PAIRED}]{{{{2}}}}|(?s:.)')"
PAIRS_SQL = f"""
select rollout, altered, p1 || r1 as context, case when altered then substr(p1 || r1, 2) else p1 || r1 end || tail as p2,
  {PIECES_SQL.format("p1")} || case when sampled then string_split(r1, '') else {PIECES_SQL.format("r1")} end as context_pieces, tail
from (select conv_id * 1000 + turn as rollout, (conv_id + turn) % 5 = 0 as altered, (conv_id + turn) % 3 > 0 as sampled, before as p1, text as r1, chr(10) || role as tail
  from (select *, lag(text) over (partition by conv_id order by turn) as before from conversations) where before is not null)
"""
TEXT_LINKS = f"""
select rollout, case when list_slice(pieces, 1, len(context_pieces)) = context_pieces then 'ids' when starts_with(p2, context) then 'text' else 'broken' end as continuity, p2, context, tail
from (select *, {PIECES_SQL.format("p2")} as pieces from ({PAIRS_SQL}))
"""


def letter_codec():
    """All single bytes, then pairs of frequent letters."""
    return PieceCodec([bytes([i]) for i in range(256)] + [(a + b).encode() for a in PAIRED for b in PAIRED])


def text_turns(spark, root):
    """Two turns per rollout: a text and the next as prompt and response, then both and more as a prompt."""
    rows = running(table(spark, root, "conversations"), ["conv_id"], ["turn"], {"before": ("prev", F.col("text"))}).where("before is not null")
    encode = ids_of(letter_codec)
    number = F.col("conv_id") + F.col("turn")
    both = F.concat("before", "text")
    prompt = F.concat(F.when(number % 5 == 0, F.substring(both, 2, 2**31 - 1)).otherwise(both), F.lit("\n"), "role")
    single = F.transform(F.filter(F.split(F.hex(F.encode("text", "utf-8")), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("int"))
    texts = rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("rollout"), encode(F.col("before")).alias("p1"), encode(prompt).alias("p2"),
        F.when(number % 3 > 0, single).otherwise(encode(F.col("text"))).alias("r1"),
    )
    turn = lambda n, p, r: F.struct(F.lit(n).alias("turn"), p.alias("prompt"), r.alias("response"), F.transform(r, lambda _: F.lit(-0.5)).alias("logp"))
    last = F.array(F.lit(33)).cast("array<int>")
    return cut_lineage(texts.select("rollout", F.inline(F.array(turn(0, F.col("p1"), F.col("r1")), turn(1, F.col("p2"), last)))), "text-turns")


@query("t14_codec_continuation", f"""
select rollout, 1 as turn, continuity, case when continuity in ('ids', 'text') then substr(p2, length(context) + 1) end as observed from ({TEXT_LINKS})
union all select rollout, 0, 'first', null from ({PAIRS_SQL})
""")
def _(spark, root):
    """Links by ids, by text and broken, with the text that a turn adds."""
    rows = text_turns(spark, root)
    links = mg.continuity(rows, ["rollout"], "turn", codec=continuation_of(letter_codec))
    ids = F.when(F.col("continuity") == "ids", F.slice("prompt", F.col("n_prompt") - F.col("n_obs") + 1, F.col("n_obs"))).otherwise(F.col("observation"))
    return links.join(rows.select("rollout", "turn", "prompt"), ["rollout", "turn"]).select("rollout", "turn", "continuity", text_of(letter_codec)(ids).alias("observed"))


@query("w22_text_metrics", f"""
with c as ({TEXT_LINKS}) select count(*) as n_rollouts, (count(*) + count_if(continuity = 'broken'))::bigint as n_rows, 0::bigint as n_budget_splits, 0::bigint as n_budget_splits_blocked,
  count_if(continuity = 'broken') as n_merge_mismatch_rows, count_if(continuity = 'broken') as n_unmerged_rollouts, count_if(continuity = 'text') as n_text_level_merges from c
""")
def _(spark, root):
    links = mg.continuity(text_turns(spark, root), ["rollout"], "turn", codec=continuation_of(letter_codec))
    return mg.merge_metrics(mg.merged_rows(links, ["rollout"], "turn", 100_000, 100_000), ["rollout"])


@query("w22_text_rows", f"""
with c as (select rollout, continuity, context, tail, p1 from ({TEXT_LINKS}) join (select rollout, p1 from (select conv_id * 1000 + turn as rollout, lag(text) over (partition by conv_id order by turn) as p1 from conversations)) using (rollout))
select rollout, 0 as row_start, p1 as prompt, substr(context, length(p1) + 1) || case when continuity = 'broken' then '' else tail || '!' end as response from c
union all select rollout, 1, p2, '!' from ({TEXT_LINKS}) where continuity = 'broken'
""")
def _(spark, root):
    """Training rows of text-level merges, decoded: the response is what was said, whatever its pieces were."""
    rows = text_turns(spark, root)
    links = mg.continuity(rows, ["rollout"], "turn", codec=continuation_of(letter_codec))
    merged = mg.merged_rows(links, ["rollout"], "turn", 100_000, 100_000)
    out = mg.training_rows(merged, rows, ["rollout"], "turn", 100_000, 100_000, links=links)
    decode = text_of(letter_codec)
    return out.select("rollout", "row_start", decode(F.col("prompt")).alias("prompt"), decode(F.col("response")).alias("response"))


@query("t24_sequence_score", """
select vec_id, case when vec_id % 7 = 0 then null else round(list_sum(list_transform(range(1, 65), lambda i: -abs(embedding[i]::double))), 6) end as score from embeddings
""")
def _(spark, root):
    i = F.col("vec_id")
    token = lambda x, j: F.struct(
        F.when((j % 2 == 0) & (i % 7 != 0), -F.abs(x.cast("double"))).alias("logprob"),
        F.when(i % 7 != 0, F.array(-F.abs(x.cast("double")))).alias("top"),
    )
    rows = table(spark, root, "embeddings").select("vec_id", F.transform("embedding", token).alias("tokens"))
    return rows.select("vec_id", F.round(mg.sequence_score(F.col("tokens")), 6).alias("score"))


@query("t25_token_advantage", """
with t as (select l_orderkey as k, l_partkey as p, l_suppkey as s, -l_discount * 10 as a, -l_tax * 30 as b from lineitem)
select k as trace, round(avg(least(3.0, greatest(-3.0, (a - b) / 0.5))), 6) as mean_advantage, count_if(abs(a - b) / 0.5 >= 3) as n_clipped, count(*) as n_tokens from t group by 1
""")
def _(spark, root):
    lines = table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("trace"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"), "l_discount", "l_tax"
    )
    teacher = lines.select("trace", "pos", (-F.col("l_discount") * 10).alias("logp"))
    student = lines.select("trace", "pos", (-F.col("l_tax") * 30).alias("logp"))
    out = mg.token_advantage(teacher, student, "trace", "pos", "logp")
    return out.groupBy("trace").agg(
        F.round(F.avg("advantage"), 6).alias("mean_advantage"), F.count_if(F.abs("advantage") >= 3).alias("n_clipped"), F.count("*").alias("n_tokens")
    )


@query("t26_sampled_ids", """
select case when vec_id % 11 = 0 then 'missing' when vec_id % 7 = 0 then 'mixed' when vec_id % 5 = 0 then 'disagree' else 'ok' end as state, count(*) as n from embeddings group by 1
""")
def _(spark, root):
    from rungauge.operators.grader import sampled_id_state

    i = F.col("vec_id")
    ids = F.transform("embedding", lambda x: (F.abs(x.cast("double")) * 1000).cast("long"))
    tokens = F.transform(ids, lambda x, j: F.concat(F.when((i % 7 == 0) & (j == 3), "tok:").otherwise("token_id:"), x.cast("string")))
    tokens = F.when(i % 11 == 0, F.transform(ids, lambda x: x.cast("string"))).otherwise(tokens)
    stored = F.when(i % 5 == 0, F.transform(ids, lambda x: x + 1)).when(i % 2 == 0, ids)
    rows = table(spark, root, "embeddings").select(tokens.alias("tokens"), stored.alias("stored"))
    return rows.groupBy(sampled_id_state(F.col("tokens"), F.col("stored")).alias("state")).agg(F.count("*").alias("n"))


@query("f09_reward_guard", f"""
select rollout_id, case when rollout_id % 13 = 0 then 'missing_or_non_finite' when rollout_id % 11 = 0 then 'runner_error' when rollout_id % 7 = 0 then 'evaluator_rejected'
   when rollout_id % 5 = 0 then 'missing_approval' when rollout_id % 3 = 0 then 'approved_value_disagrees' end as reason from ({b.ROLLOUTS})
""")
def _(spark, root):
    i = F.col("rollout_id")
    reward = F.when(i % 26 == 0, F.lit(float("nan"))).when(i % 13 == 0, F.lit(None)).otherwise(F.col("reward"))
    data = F.struct(
        (i % 7 != 0).alias("reward_eligible"), F.when(i % 5 == 0, "partial").otherwise("complete").alias("evaluation_state"),
        F.when(i % 3 == 0, F.col("reward") + 1).otherwise(F.col("reward")).alias("value"),
    )
    rows = b.rollouts(spark, root).select(
        "rollout_id", reward.alias("reward"), F.when(i % 11 == 0, "lost").alias("error_message"),
        F.array(F.struct(F.lit("reward").alias("event_type"), data.alias("data"))).alias("events"),
    )
    return rows.select("rollout_id", mg.reward_reason(require_approval=True).alias("reason"))


@query("f10_alignment_guard", """
select vec_id, case when vec_id % 7 = 0 then 'missing_ids' when vec_id % 5 = 0 then 'missing_logprobs' when vec_id % 3 = 0 then 'length_mismatch' end as reason from embeddings
""")
def _(spark, root):
    i = F.col("vec_id")
    ids = F.transform("embedding", lambda x: (F.abs(x.cast("double")) * 1000).cast("int"))
    logp = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    response = F.when(i % 7 == 0, F.array().cast("array<int>")).otherwise(ids)
    probs = F.when(i % 5 == 0, F.lit(None)).when(i % 3 == 0, F.slice(logp, 1, 10)).otherwise(logp)
    probs = F.when(i % 7 == 0, F.array().cast("array<double>")).otherwise(probs)
    rows = table(spark, root, "embeddings").select(
        "vec_id", F.array(F.struct(response.alias("response"), probs.alias("logp"))).alias("turns")
    )
    return rows.select("vec_id", mg.alignment_reason(F.col("turns")).alias("reason"))


@query("a32_break_causes", """
select case when doc_id % 6 = 0 then 'A_compaction' when doc_id % 6 = 1 then 'B_whitespace' when doc_id % 6 = 2 then 'C_cdata' when doc_id % 6 = 3 then 'D_retokenised' when doc_id % 6 = 4 then 'E_prose_tag' else 'F_clip_moved' end as cause, count(*) as n
from documents group by 1
""")
def _(spark, root):
    i, t = F.col("doc_id") % 6, F.col("text")
    expected = F.when(i == 2, F.concat(F.lit("<![CDATA["), t, F.lit("]]>"))).when(i == 4, F.concat(t, F.lit("<function Email at 0x7f>"))).otherwise(t)
    actual = F.when(i == 1, F.concat(F.lit("    "), t)).when(i == 3, t).when(i == 2, t).otherwise(F.concat(t, F.lit("#other")))
    rows = table(spark, root, "documents").select(
        expected.alias("expected"), actual.alias("actual"), (i == 0).alias("compaction"), (i == 5).alias("clipped")
    )
    return mg.break_cause(rows, "expected", "actual", "compaction", "clipped").groupBy("cause").agg(F.count("*").alias("n"))


@query("a43_token_conservation", f"""
with s as ({SEGMENTED})
select (rollout % 50)::bigint as step, cast(sum(resp) as bigint) as n_output, cast(sum(resp) as bigint) as n_mask, cast(sum(resp) as bigint) as n_logp, true as conserved from s group by 1
""")
def _(spark, root):
    turns_table = token_turns(spark, root)
    made = turns_table.groupBy((F.col("rollout") % 50).alias("step")).agg(F.sum(F.size("response")).alias("n_output"))
    rows = train(turns_table, 10_000, 10_000)
    real = F.size(F.filter("logp", lambda x: x != 0))
    trained = rows.groupBy((F.col("rollout") % 50).alias("step")).agg(
        F.sum(F.aggregate("mask", F.lit(0), lambda a, x: a + x)).alias("n_mask"), F.sum(real).alias("n_logp")
    )
    from rungauge.operators.evaluation import token_conservation

    return token_conservation(made.join(trained, "step"), "step", ["n_output", "n_mask", "n_logp"])


@query("p06_ordered_fold", f"""
select rollout, cast(max(segment) + 1 as bigint) as n_segments, count(*) as n_turns from ({SEGMENTED}) group by 1
""")
def _(spark, root):
    merged = merge(token_turns(spark, root), 10_000, 10_000)
    return merged.groupBy("rollout").agg(
        (F.max("segment") + 1).cast("long").alias("n_segments"), F.count("*").alias("n_turns")
    )
