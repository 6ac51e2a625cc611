"""Scans that lose nothing."""

import pytest

from rungauge.functions import text as tx
from rungauge.sources import readers as rd


def written(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def broken(spark, tmp_path, text, **options):
    rows = rd.read_broken_json(spark, written(tmp_path, "in/a.jsonl", text), "a long, b string", **options).collect()
    return sorted((r.a, r.b) for r in rows if not r.bad), [r.text_of_bad for r in rows if r.bad]


def test_records_over_lines(spark, tmp_path):
    text = '{"a": 1,\n"b": "x"}\n{"b": "}{\\"", "a": 2}\r\n\n{\n "a":\r\n 3,\n "c": [{},\n {"a": 9}\n]}\n[1]\n{"a": 4} {"a": 5}\n{"a": 6, "a": 7}\n'
    good, bad = broken(spark, tmp_path, text)
    assert good == [(1, "x"), (2, '}{"'), (3, None)]
    assert sorted(bad) == ["[1]", '{"a": 4} {"a": 5}', '{"a": 6, "a": 7}']


def test_a_stray_closing_bracket_spoils_nothing_behind_it(spark, tmp_path):
    text = '{"a": 1}\n}\n{"a": 2,\n"b": "x"}\n{"a": 3}\n]}\n{"a":\n4}\n'
    good, bad = broken(spark, tmp_path, text)
    assert good == [(1, None), (2, "x"), (3, None), (4, None)] and sorted(bad) == ["]}", "}"]
    good, bad = broken(spark, tmp_path / "x", text, record_start="{")
    assert good == [(1, None), (2, "x"), (3, None), (4, None)] and "".join(bad).count("}") == 2


def test_cut_record_takes_what_follows_unless_a_start_is_known(spark, tmp_path):
    text = '{"a": 1}\n{"a": 2, "b": \n{"b": "y", "a": 3}\n{"a": 4}'
    good, bad = broken(spark, tmp_path, text)
    assert good == [(1, None)] and "".join(bad).count("\n") == 2
    good, bad = broken(spark, tmp_path / "x", text, record_start="{")
    assert good == [(1, None), (3, "y"), (4, None)] and bad == ['{"a": 2, "b": ']


def test_limit_is_for_what_never_closes(spark, tmp_path):
    long = "z" * 500
    good, bad = broken(spark, tmp_path, f'{{"a": 1,\n"b": "{long}"}}\n{{"a": 2,\n"b": "{long}",\n"c": "{long}",\n', max_chars=100)
    assert good == [(1, long)] and len(bad) > 1 and sum(len(b) for b in bad) > 1000


def test_result_files(spark, tmp_path):
    root = tmp_path / "res"
    contents = {"1": '{"v": 1}', "2": "", "3": " \n", "4": '[{"v": 4}]', "5": '{"v": 5', "6": '{"v": 6} x', "7": '{"v": "text"}', "8": "null", "a b": '\n{"v": 8}\n'}
    for name, text in contents.items():
        written(root, f"run=r/instance={name}/result.json", text)
    got = {r.instance_id: (r.v, r.unreadable) for r in rd.read_results(spark, str(root), "v int", r"run=([^/]+)/instance=([^/]+)/").collect()}
    assert {k: v for k, v in got.items() if not v[1]} == {"1": (1, False), "a b": (8, False)}
    assert len(got) == len(contents)


def test_task_lines(spark, tmp_path):
    path = written(tmp_path, "t.jsonl", '{"instance_id": "a", "FAIL_TO_PASS": ["x"]}\n{"instance_id": "b"\n{"repo": "r"}\n\n')
    rows = rd.scan_tasks(spark, path).collect()
    assert sorted((r.instance_id or "", r.malformed) for r in rows) == [("", False), ("", True), ("a", False)]
    with pytest.raises(Exception, match="malformed task line"):
        rd.read_tasks(spark, path).collect()
    path = written(tmp_path, "ok.jsonl", '{"instance_id": "a"}\n{"repo": "r"}\n')
    assert rd.read_tasks(spark, path).count() == 2


def test_one_object(spark):
    from pyspark.sql import functions as F

    cases = {'{"a": "}{"}': True, "{}": True, '{"a": [1, {"b": 2}]}': True, '{"a": 1}, {"b": 2}': False, "{}{}": False, "[{}]": False, "": False, "{": False, '{"a\\\\": 1}': True}
    df = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    assert df.where(tx.is_json_object(F.col("t")) != F.col("want")).collect() == []
