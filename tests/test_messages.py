"""Text jobs on known replies."""

import json

import pytest
from pyspark.sql import functions as F

from rungauge.functions import text as tx
from rungauge.operators import curation, grader, messages, trajectories
from rungauge.sources import readers

FENCE = "```bash\n{}\n```"


def parse(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.parse_action(F.col("t")).alias("p"))
    return [(r.p.action, r.p.kind) for r in rows.orderBy("i").collect()]


def test_actions(spark):
    native = '<function name="{}"><param name="{}">{}</param></function>'
    got = parse(
        spark, "x " + FENCE.format("ls"), "no fence", FENCE.format("a") + FENCE.format("b"), native.format("shell", "cmd", " pwd "),
        native.format("bash", "command", "<![CDATA[  a < b\n]]>"), native.format("edit", "path", "f"), "```mswea_bash_command  \nmake\n```",
        "```python\nx\n```", '<function name="bash"><![CDATA[ls]]></function>', '<function name="bash">ls</function>',
        FENCE.format("a") + native.format("edit", "p", "f"),
    )
    assert got == [
        ("ls", "ok"), (None, "none"), (None, "many"), ("pwd", "ok"), ("a < b", "ok"), (None, "unavailable"), ("make", "ok"), (None, "none"),
        ("ls", "ok"), (None, "unavailable"), (None, "many"),
    ]


def rewrite(spark, content, arguments=None):
    df = spark.createDataFrame([(content, arguments)], "c string, a string")
    r = messages.rewrite_replies(df, "c", "a").first()
    return r.rewritten_content, r.rewritten


@pytest.mark.parametrize("content, arguments, want", [
    (FENCE.format("ls"), None, (FENCE.format("ls"), False)),
    ("<think>hm</think>\ndo\n```sh\nls\n```", None, ("do\n\n" + FENCE.format("ls"), True)),
    ("do it\n```\nls\n```", None, ("do it\n\n" + FENCE.format("ls"), True)),
    ("```python\nx\n```", None, ("```python\nx\n```", False)),
    ("", '{"command": "ls -l"}', (FENCE.format("ls -l"), True)),
    ("", '{"arguments": "{\\"cmd\\": \\"pwd\\"}"}', (FENCE.format("pwd"), True)),
    ('go <tool_call>{"name": "bash", "arguments": {"command": "ls"}}</tool_call>', None, ("go\n\n" + FENCE.format("ls"), True)),
    ("go <tool_call><function=bash><parameter=command>\nls\n</parameter></function></tool_call>", None, ("go\n\n" + FENCE.format("ls"), True)),
    ('[{"function": {"name": "bash", "arguments": "{\\"command\\": \\"id\\"}"}}]', None, (FENCE.format("id"), True)),
    ('{"command": "id"}', None, (FENCE.format("id"), True)),
    ("just words", None, ("just words", False)),
    ("a\n```bash\nx\n```\nb\n```\ny\n```", None, ("a\n\n" + FENCE.format("x"), True)),
])
def test_rewrite(spark, content, arguments, want):
    assert rewrite(spark, content, arguments) == want


def test_hygiene_never_changes_the_action(spark):
    text = "<THOUGHT>\nfix it\n</invoke>\n\n\n\nnow\n" + FENCE.format("ls") + "\n</parameter>\nmore"
    df = spark.createDataFrame([(text,), ("two " + FENCE.format("a") + FENCE.format("b") + " tail",)], "t string")
    got = [r.h for r in df.select(messages.hygiene(F.col("t")).alias("h")).collect()]
    assert (got[0].content, got[0].trimmed, got[0].tag_lines) == ("fix it\n\nnow\n\n" + FENCE.format("ls"), len("</parameter>\nmore"), 1)
    assert got[1].trimmed == 0 and got[1].content.endswith("tail")


def test_call_blocks(spark):
    tools = {"bash": {"types": {"command": "string"}, "required": ["command"]}}
    text = ('see <function Email at 0x7f> then <function name="bash"><param name="command"><![CDATA[  x\n]]></param></function>'
            '<function name="bash"></function><functionname="bash"><paramname="command"> y </param></function>'
            '<function name="bash"><param>z</param></function>')
    out = messages.tool_calls(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t", tools).orderBy("call").collect()
    assert [(r.void_cause, r.parameters) for r in out] == [
        (None, {"command": "  x\n"}), ("missing_required", None), (None, {"command": "y"}), ("param_without_name", None)]


def test_statement_between_its_marks(spark):
    df = spark.createDataFrame([("a Consider the following PR description:\n fix \n</pr_description> b",), ("none",)], "p string")
    assert [r[0] for r in df.select(curation.statement_of_prompt(F.col("p"))).collect()] == ["fix", None]


def test_prompt_key_undoes_quoting(spark):
    df = spark.createDataFrame([(' say "hi"  ',), ('"say \\"hi\\""',)], "p string").select(tx.prompt_key(F.col("p")).alias("k"))
    assert len({r.k for r in df.collect()}) == 1


@pytest.mark.parametrize("action, reason", [
    ("cd x && git log", "git_use"), ("grep git f", None), ("cat .git/HEAD", "git_metadata"), ("wget http://x", "network"),
    ("python -c 'import requests; requests.get(1)'", "network"), ("uv pip install x", "package_install"), ("pip list", None),
    ("echo x >> pytest.ini", "test_tampering"), ("cat conftest.py", None), ("ls /opt/agl_tmp", "git_metadata"),
])
def test_forbidden(spark, action, reason):
    df = spark.createDataFrame([(action,)], "a string").select(trajectories.forbidden_reason(F.col("a")).alias("r"))
    assert df.first().r == reason


def test_strict_sampled_ids(spark):
    cases = [(["token_id:0", "token_id:12"], None, "ok"), (["token_id:1"], [2], "disagree"), (["a"], None, "missing"), ([], None, "missing"),
             (["token_id:1", "x"], None, "mixed"), (["token_id:-1"], None, "missing"), (["token_id:1", "token_id:٣"], None, "mixed")]
    df = spark.createDataFrame([(t, s) for t, s, _ in cases], "t array<string>, s array<bigint>")
    assert [r.x for r in df.select(grader.sampled_id_state(F.col("t"), F.col("s")).alias("x")).collect()] == [w for _, _, w in cases]


def test_redaction_leaves_the_source_alone(spark):
    source = json.dumps({"a": {"Api_Key": "x", "n": [{"secret": {"k": 1}}, 2]}, "token": "kept"})
    df = spark.createDataFrame([(source,), ("not json",)], "j string").withColumn("r", grader.redact_json(F.col("j")))
    rows = df.collect()
    assert rows[0].j == source and json.loads(rows[0].r.json) == {"a": {"Api_Key": "<redacted>", "n": [{"secret": "<redacted>"}, 2]}, "token": "kept"}
    assert rows[0].r.touched == ["a.Api_Key", "a.n.0.secret"] and "not json" not in rows[1].r.json


def test_task_lists_in_three_forms(spark, tmp_path):
    lines = [{"instance_id": "a", "FAIL_TO_PASS": ["x", "y"]}, {"instance_id": "b", "FAIL_TO_PASS": '["x"]'}, {"instance_id": "c", "FAIL_TO_PASS": "x::y"}, {"instance_id": "d"}]
    (tmp_path / "t.jsonl").write_text("\n\n".join(json.dumps(r) for r in lines) + "\n")
    got = {r.instance_id: r.FAIL_TO_PASS for r in readers.read_tasks(spark, str(tmp_path)).collect()}
    assert got == {"a": ["x", "y"], "b": ["x"], "c": ["x::y"], "d": []}
    (tmp_path / "t.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        readers.read_tasks(spark, str(tmp_path))


def test_broken_rows_are_quarantined(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1,\n\n"t": "a"}\n{"id": 2, "t":\n{"id": 3, "t": "c"}\n')
    out = readers.read_broken_json(spark, str(tmp_path), "id int, t string", '{"id"').collect()
    assert sorted((r.id, r.bad) for r in out if not r.bad) == [(1, False), (3, False)] and sum(r.bad for r in out) == 1


def test_numpy_numbers_and_later_lines(spark, tmp_path):
    log = ("step:1 - timing/step_start_wall:1 - training/reward:0.1 - actor/grad_norm:np.float64(2.5e-3)\nnoise\n"
           "step:1 - timing/step_start_wall:1 - training/reward:0.2\nstep:2 - timing/step_start_wall:1 - training/reward:np.float64(-1.5)\n")
    (tmp_path / "t.log").write_text(log)
    rows = {r.step: r for r in readers.trainer_metrics(readers.read_lines(spark, str(tmp_path))).collect()}
    assert rows[1].training_reward == 0.2 and rows[1].actor_grad_norm is None and rows[2].training_reward == -1.5
