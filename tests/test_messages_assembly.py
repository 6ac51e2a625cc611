"""Streamed answers put together: parts by kind and index, whatever the order of arrival, against a plain loop."""

import json
import random

import pytest

from rungauge.operators import sequences as sq


def assembled(lines):
    """One answer by a plain loop over its lines."""
    content, reasoning, calls, finish, usage, n = [], [], {}, None, None, 0
    for line in lines:
        if line is None or not line.startswith("data:"):
            continue
        try:
            obj = json.loads(line[5:].strip())
        except ValueError:
            continue
        n += 1
        usage = obj.get("usage") or usage
        for choice in obj.get("choices") or []:
            delta = choice.get("delta") or {}
            content.append(delta.get("content") or "")
            reasoning.append(delta.get("reasoning_content") or "")
            for call in delta.get("tool_calls") or []:
                slot = calls.setdefault(call.get("index", 0), [None, "", ""])
                fn = call.get("function") or {}
                slot[0] = call.get("id") or slot[0]
                slot[1] += fn.get("name") or ""
                slot[2] += fn.get("arguments") or ""
            finish = choice.get("finish_reason") or finish
    text = lambda parts: "".join(parts) or None
    return text(content), text(reasoning), [(i, *calls[i]) for i in sorted(calls)], finish, usage, n


def chunk(**fields):
    return "data: " + json.dumps({"choices": [{"index": 0, "delta": fields.pop("delta", {}), **fields}]})


def random_lines(rng, n):
    made = [
        lambda i: chunk(delta={"content": f"é{i} "}),
        lambda i: chunk(delta={"content": "", "reasoning_content": f"r{i}\n"}),
        lambda i: chunk(delta={"content": None, "tool_calls": [{"index": rng.randrange(3), "id": f"id{i}", "type": "function", "function": {"name": "run", "arguments": ""}}]}),
        lambda i: chunk(delta={"tool_calls": [{"index": rng.randrange(3), "function": {"arguments": f'{{"a": "{i}"'}}, {"function": {"arguments": "}"}}]}),
        lambda i: chunk(delta={"tool_calls": [{"index": 5}]}),
        lambda i: chunk(finish_reason=rng.choice(["stop", "tool_calls", None, ""])),
        lambda i: "data: " + json.dumps({"choices": [], "usage": rng.choice([{"total": i}, {}, None])}),
        lambda i: "data: " + json.dumps({"usage": {"total": i, "prompt": {"cached": 1}}}),
        lambda i: rng.choice([": ping", "data: [DONE]", "data:", "", None, "data: {broken", "event: x"]),
    ]
    return [rng.choice(made)(i) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"target_rows": 50}])
def test_answers_match_the_loop(spark, options):
    rng = random.Random(8)
    answers = {f"a{i}": random_lines(rng, rng.choice([1, 5, 40])) for i in range(40)}
    answers["long"] = [chunk(delta={"content": f"{i},"}) for i in range(9000)]  # several slices
    answers["nothing"] = [None, "data: [DONE]"]
    rows = [(name, i, line) for name, lines in answers.items() for i, line in enumerate(lines)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "answer string, n int, line string").repartition(5)
    got = {}
    for r in sq.assemble_responses(sq.chunk_deltas(df, ["answer"], ["n"], "line"), ["answer"], ["n"], **options).collect():
        calls = [tuple(c) for c in r["tool_calls"]]
        got[r["answer"]] = (r["content"], r["reasoning"], calls, r["finish"], json.loads(r["usage"]) if r["usage"] else None, r["n_chunks"])
    assert got == {name: assembled(lines) for name, lines in answers.items()}


def test_no_lines_give_no_answers(spark):
    df = spark.createDataFrame([], "answer string, n int, line string")
    assert sq.assemble_responses(sq.chunk_deltas(df, ["answer"], ["n"], "line"), ["answer"], ["n"]).count() == 0
