"""Scans of task tables, result folders, sessions, logs and archives.

Every scan declares its schema.  A damaged row is counted or quarantined, never
silently lost and never turned into an empty success.
"""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungauge.functions import text as tx
from rungauge.functions.guards import truthy
from rungauge.functions.ordered import running
from rungauge.functions.rows import keep_first, keep_last
from rungauge.sources.files import file_system, list_files, read_files, run_folders, scheme_of

TASK_FIELDS = (
    "instance_id string, problem_statement string, image_name string, repo string, "
    "FAIL_TO_PASS string, PASS_TO_PASS string"
)
EVENT_FIELDS = (
    "ts double, session string, event string, status int, "
    "response struct<finish_reason:string,usage:struct<prompt_tokens:long,completion_tokens:long,"
    "prompt_tokens_details:struct<cached_tokens:long>,"
    "completion_tokens_details:struct<reasoning_tokens:long>>>"
)
# Fixed values of the log formats.
TRAINER_METRICS = [
    "response_length/mean",
    "critic/score/mean",
    "training/reward",
    "actor/grad_norm",
    "training/dynamic_sampling/n_groups_zero_adv",
    "training/dynamic_sampling/n_groups_seen",
    "training/n_rollouts",
    "training/n_rollouts_w_trace",
    "rollout_corr/rollout_is_mean",
    "training/n_trace_merge_mismatch_rows",
]
NUMBER = r"(?:np\.float\d+\(|np\.int\d+\()?(-?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
STEP_LINE = r"step:(\d+) - timing/step_start_wall"
ANSI_CODE = r"\x1b\[[0-9;]*m"
ROLLOUT_START = r"^([\d-]+ [\d:,]+) INFO SmithAgent start: instance=(\S+) max_turns=(\d+)"
ROLLOUT_DONE = (
    r"done: mode=(\w+) submitted=(\w+) patch=(\d+)B reward=([-\d.]+) raw_reward=([-\d.]+) "
    r"binary=([\d.]+) f2p_ratio=([\d.]+) n_turns=(\d+) max_prompt_tokens=(\d+) reason=(.*)"
)
ROLLOUT_COUNTS = r"FAIL_TO_PASS (\d+)/(\d+) passed, PASS_TO_PASS (\d+)/(\d+) ok"
SESSION_FILE = r"^([0-9a-f]{32})(?:\.(compact|post)(\d+))?\.json$"
ACTION_LINE = r"(?s)turn=.*? cmd=(.*) rc="


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The table, or an error when it has no row at all (reads one row)."""
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df


def text_list(value: Column) -> Column:
    """A list given as JSON text, or one bare text, as an array; null becomes empty."""
    parsed = F.from_json(value, "array<string>")
    bare = F.when(F.length(tx.strip(value)) > 0, F.array(value))
    return F.coalesce(parsed, bare, F.array().cast("array<string>"))


def list_text(value: Column) -> Column:
    """What a JSON field read as text holds: JSON text keeps one level of quoting."""
    unquoted = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    return F.when(value.startswith('"'), unquoted).otherwise(value)


def scan_tasks(spark: SparkSession, path: str | list[str], source: str | None = None) -> DataFrame:
    """Task table from JSON lines, every line that is not blank: ``malformed`` ones keep their ``line`` and have no fields.

    Fixed fields, list columns as arrays, source and id added; a row without id stays.
    """
    fields = T.StructType.fromDDL(TASK_FIELDS + ", _corrupt_record string")
    lines = spark.read.text(path).where(F.length(tx.strip(F.col("value"))) > 0)
    parsed = F.from_json("value", fields, {"columnNameOfCorruptRecord": "_corrupt_record"})
    origin = F.lit(source) if source else F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    raw = lines.select(parsed.alias("row"), origin.alias("data_source")).select("row.*", "data_source")
    out = raw.withColumns({c: text_list(F.col(c)) for c in ("FAIL_TO_PASS", "PASS_TO_PASS")})
    out = out.withColumn("malformed", F.col("_corrupt_record").isNotNull()).withColumnRenamed("_corrupt_record", "line")
    return require_rows(out.withColumn("data_id", F.col("instance_id")), str(path))


def read_tasks(spark: SparkSession, path: str | list[str], source: str | None = None) -> DataFrame:
    """The rows of ``scan_tasks``; a malformed line fails the job that meets it, and says which."""
    rows = scan_tasks(spark, path, source)
    problem = F.concat(F.lit("malformed task line: "), F.left("line", F.lit(200)))
    sound = F.when(F.col("malformed"), F.raise_error(problem).cast("boolean")).otherwise(F.lit(True))
    return rows.where(sound).drop("malformed", "line")


def _parsed_files(files: DataFrame, schema: str) -> tuple[DataFrame, list[str]]:
    """``root``, ``path``, ``link``, the fields of each file's one JSON object, and ``unreadable``."""
    fields = T.StructType.fromDDL(schema + ", _corrupt_record string")
    names = [f.name for f in fields if f.name != "_corrupt_record"]
    read = files.withColumn("text", F.col("content").cast("string")).withColumn("sound", truthy(tx.is_json_object(F.col("text"))))
    parsed = F.from_json(F.when(F.col("sound"), F.col("text")), fields, {"columnNameOfCorruptRecord": "_corrupt_record"})
    bad = ~F.col("sound") | F.col("row._corrupt_record").isNotNull()
    rows = read.select("root", "path", "link", "sound", parsed.alias("row"))
    return rows.select("root", "path", "link", *[F.when(~bad, F.col(f"row.{n}")).alias(n) for n in names], bad.alias("unreadable")), names


def read_results(spark: SparkSession, root: str, schema: str, key_pattern: str) -> DataFrame:
    """One row per result file, whatever it holds; keys come from the folder names.

    ``key_pattern`` has two groups, run and instance.  ``unreadable`` marks files
    that are not one JSON object of the schema: empty, cut, followed by something
    else, an array, a repeated key.  The lenient caller filters them, the gate
    reports them.  Run folders are listed in tasks, so empty files come too.
    """
    rows, names = _parsed_files(read_files(list_files(spark, run_folders(root))), schema)
    return rows.select(*names, F.regexp_extract("path", key_pattern, 1).alias("run"), F.regexp_extract("path", key_pattern, 2).alias("instance_id"), "unreadable")


MISPLACED = ("unexpected_layout", "missing_id", "id_disagrees")


def read_shards(spark: SparkSession, shards: Sequence[str], schema: str, key: str = "instance_id", name: str = "result.json") -> DataFrame:
    """Result files of shard folders, laid out shard/instance/``name``, for the gate.

    ``schema`` holds ``key``.  ``folder`` is the instance's folder, ``unreadable`` as in
    ``read_results``.  ``misplaced`` says why a file does not speak for an id: it lies
    elsewhere or behind a symbolic link, has no id, or its id is not its folder's name.
    A shard may not be given twice, nor lie inside another.
    """
    roots = [scheme_of(s) + file_system(s)[1].rstrip("/") for s in shards]
    if not roots or any(i != j and (a + "/").startswith(b + "/") for i, a in enumerate(roots) for j, b in enumerate(roots)):
        raise ValueError("shard folders must be given, once each, and must not overlap")
    files = list_files(spark, roots).where(F.substring_index("path", "/", -1) == name)
    rows, names = _parsed_files(read_files(files), schema)
    parts, ids = F.split("path", "/"), F.col(key)
    shard = F.element_at(F.split("root", "/"), -1)
    laid_out = F.col("path").endswith(F.concat_ws("/", shard, F.col("folder"), F.lit(name))) & (F.size(parts) == F.size(F.split("root", "/")) + 2) & ~F.col("link")
    why = (
        F.when(~laid_out, "unexpected_layout")
        .when(F.col("unreadable"), None)
        .when(ids.isNull() | (ids == ""), "missing_id")
        .when(ids != F.col("folder"), "id_disagrees")
    )
    return rows.withColumn("folder", F.element_at(parts, -2)).select("path", *names, "folder", "unreadable", why.alias("misplaced"))


def read_manifest(spark: SparkSession, path: str, key: str = "instance_id") -> tuple[DataFrame, str]:
    """The planned ids of a manifest, and the SHA-256 of its bytes.

    A manifest is one JSON list of distinct texts that are not blank; anything else is refused.
    """
    content = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("digest"))
    # As the one field of an object, so that nothing may follow the list.
    whole = F.concat(F.lit('{"ids": '), "text", F.lit("}"))
    listed = tx.is_json_object(whole) & (F.schema_of_variant(F.try_parse_json(whole)) == "OBJECT<ids: ARRAY<STRING>>")
    ids = F.when(listed, F.from_json("text", "array<string>"))
    fine = (F.size(ids) > 0) & F.forall(ids, lambda i: tx.strip(i) != "") & (F.size(F.array_distinct(ids)) == F.size(ids))
    head = content.select("digest", truthy(fine).alias("fine")).collect()
    if len(head) != 1 or not head[0].fine:
        raise ValueError(f"not a list of distinct ids: {path}")
    return content.select(F.explode(ids).alias(key)), head[0].digest


def session_segments(
    files: DataFrame,
    name: str = "file_name",
    modified: str = "modified",
    ts: str = "ts",
    since: float | None = None,
    until: float | None = None,
    slack: float = 3600.0,
) -> DataFrame:
    """Session files named <32 hex>[.compactK|.postK].json as key, segment and index.

    A cheap window on the modification time comes before the exact one, so that
    most files outside the window are never opened.
    """
    out = files.where(F.col(name).rlike(SESSION_FILE))
    if since is not None:
        out = out.where(F.col(modified) >= since - slack)
    if until is not None:
        out = out.where(F.col(modified) <= until + slack)
    exact = F.coalesce(F.col(ts), F.col(modified))
    if since is not None:
        out = out.where(exact >= since)
    if until is not None:
        out = out.where(exact <= until)
    kind = F.regexp_extract(name, SESSION_FILE, 2)
    index = F.regexp_extract(name, SESSION_FILE, 3)
    return out.select(
        "*",
        F.regexp_extract(name, SESSION_FILE, 1).alias("key"),
        F.when(kind == "", F.lit("main")).otherwise(kind).alias("segment"),
        F.when(index == "", F.lit(0)).otherwise(index.try_cast("int")).alias("segment_index"),
    )


SESSION = "ts double, request struct<messages:array<struct<role:string,content:string>>>"


def message_text(content: Column) -> Column:
    """What a message says: its text, or the text parts of its list; anything else says nothing."""
    parts = F.from_json(F.when(content.startswith("["), content), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.when(parts.isNotNull(), joined).when(content.startswith("{"), F.lit("")).otherwise(F.coalesce(content, F.lit("")))


def read_sessions(
    spark: SparkSession, root: str | list[str], since: float | None = None, until: float | None = None, main_only: bool = False, slack: float = 3600.0
) -> DataFrame:
    """Session files <32 hex>[.compactK|.postK].json below the folders: key, segment, segment_index, path, ts, text.

    A main file's key is that of its first user message, a segment's is in its name.
    First names and modification times are held against the pattern and the window
    (``slack`` seconds wider); a file that this rules out is not opened.  Then the time
    in the file decides, or the file's own where it has none.  Without a window only
    main files are opened: ``text`` is null for files that were not.  Opened files that
    are no JSON object, and main files without a user message, are left out.  Of files for
    the same (key, segment, index) the latest stays, by time and then path.
    """
    windowed = since is not None or until is not None
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(root)  # listed once
    name, modified = F.col("_metadata.file_name"), F.unix_timestamp("_metadata.file_modification_time").cast("double")

    def listed(opened: bool, main: bool) -> DataFrame:
        """Files of one kind; their text is read only when it is asked for, and only theirs."""
        columns = [F.col("_metadata.file_path").alias("path"), name.alias("_name"), modified.alias("_modified")]
        kept = reader.where(name.rlike(SESSION_FILE) & (F.regexp_extract(name, SESSION_FILE, 2) == "" if main else F.regexp_extract(name, SESSION_FILE, 2) != ""))
        if since is not None:
            kept = kept.where(F.col("modificationTime") >= F.timestamp_micros(F.lit(int((since - slack) * 1e6)))).where(modified >= since - slack)
        if until is not None:
            kept = kept.where(F.col("modificationTime") <= F.timestamp_micros(F.lit(int((until + slack) * 1e6)))).where(modified <= until + slack)
        return kept.select(*columns, (F.col("content").cast("string") if opened else F.lit(None).cast("string")).alias("text"))

    files = listed(True, True)
    if not main_only:
        files = files.unionByName(listed(windowed, False))
    rows = files.withColumn("_session", F.from_json("text", SESSION))
    rows = rows.where(F.col("text").isNull() | F.get_json_object("text", "$").startswith("{"))
    ts = F.coalesce(F.when(F.col("_session.ts") != 0, F.col("_session.ts")), F.col("_modified"))
    users = F.filter("_session.request.messages", lambda m: m["role"] == "user")
    stem, kind, index = (F.regexp_extract("_name", SESSION_FILE, i) for i in (1, 2, 3))
    key = F.when(kind != "", stem).when(F.size(users) > 0, tx.prompt_key(message_text(F.get(users, F.lit(0))["content"])))
    rows = rows.select(
        key.alias("key"), F.when(kind == "", F.lit("main")).otherwise(kind).alias("segment"), F.when(index == "", F.lit(0)).otherwise(index.try_cast("int")).alias("segment_index"),
        "path", ts.alias("ts"), "text",
    ).where("key is not null")
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    if until is not None:
        rows = rows.where(F.col("ts") <= until)
    return keep_last(rows, ["key", "segment", "segment_index"], ["ts", "path"])


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Event log in JSON lines; malformed lines stay visible as ``malformed``."""
    fields = T.StructType.fromDDL(EVENT_FIELDS + ", _corrupt_record string")
    raw = spark.read.schema(fields).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return event_kinds(raw.withColumn("malformed", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record"))


def event_kinds(events: DataFrame) -> DataFrame:
    """Adds ``kind``: malformed, no_session, retry, upstream_error or request."""
    failed = (F.col("event") == "upstream_error") | (
        F.col("status").isNotNull() & (F.col("status") != 0) & (F.col("status") != 200)
    )
    no_session = F.col("session").isNull() | (F.col("session") == "")
    return events.withColumn(
        "kind",
        F.when(F.col("malformed"), F.lit("malformed"))
        .when(no_session, F.lit("no_session"))
        .when(F.coalesce(F.col("event") == "retry", F.lit(False)), F.lit("retry"))
        .when(F.coalesce(failed, F.lit(False)), F.lit("upstream_error"))
        .otherwise(F.lit("request")),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a file-wide order (file, block, line) that needs no whole-file read."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def trainer_metrics(
    lines: DataFrame, keys: Sequence[str] = ("file",), order: Sequence[str] = ("block", "line")
) -> DataFrame:
    """One row per run and step from a trainer log; a step written twice keeps its later line.

    A metric that is not on the line is null, never 0.
    """
    value = F.col("value")
    rows = lines.where(value.contains("step:")).where(value.rlike(STEP_LINE))
    metrics = [
        F.regexp_extract("value", _quote(m) + ":" + NUMBER, 1).try_cast("double").alias(m.replace("/", "_"))
        for m in TRAINER_METRICS
    ]
    rows = rows.select(
        *keys, *order, F.regexp_extract("value", STEP_LINE, 1).try_cast("int").alias("step"), *metrics
    )
    return keep_last(rows, [*keys, "step"], list(order)).drop(*order)


def _quote(literal: str) -> str:
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|/" and ch != "/" else ch for ch in literal)


def curve_metrics(
    lines: DataFrame, keys: Sequence[str] = ("file",), order: Sequence[str] = ("block", "line")
) -> DataFrame:
    """Train and validation curves from a coloured log: one row per run, split and step."""
    clean = F.regexp_replace("value", ANSI_CODE, "")
    step = F.regexp_extract(clean, r"\bstep:(\d+)\b", 1).try_cast("int")

    def grab(key: str) -> Column:
        return F.regexp_extract(clean, r"\b" + _quote(key) + r":(-?[0-9.]+)\b", 1).try_cast("double")

    sides = {
        "val": ("val/reward", "val/n_rollouts", "val/n_rollouts_w_trace", "val/n_rollouts_w_reward",
                "val/mean_response_length_per_turn", None),
        "train": ("training/reward", "training/n_rollouts", "training/n_rollouts_w_trace",
                  "training/n_rollouts_w_reward", "response_length/training/avg_by_turn", "timing_s/step"),
    }
    names = ("reward", "n", "n_w_trace", "n_w_reward", "resp_len", "step_secs")
    records = [
        F.struct(
            F.lit(side).alias("split"),
            *[(grab(k) if k else F.lit(None).cast("double")).alias(n) for k, n in zip(fields, names)],
        )
        for side, fields in sides.items()
    ]
    rows = (
        lines.withColumn("step", step)
        .where(F.col("step").isNotNull())
        .select(*keys, *order, "step", F.explode(F.array(*records)).alias("r"))
        .select(*keys, *order, "step", "r.*")
        .where(F.col("reward").isNotNull())
    )
    return keep_last(rows, [*keys, "split", "step"], list(order)).drop(*order)


def rollout_logs(lines: DataFrame, rollout: str = "file", order: Sequence[str] = ("block", "line")) -> DataFrame:
    """One row per rollout log: first start line joined with the last done line.

    Logs without both lines are left out by this form; ``rollout_log_errors``
    counts them.
    """
    return _rollout_lines(lines, rollout, order).where(
        F.col("start").isNotNull() & F.col("done").isNotNull()
    ).select(*_rollout_fields(rollout))


def rollout_log_errors(lines: DataFrame, rollout: str = "file", order: Sequence[str] = ("block", "line")) -> DataFrame:
    """Logs by outcome: complete, no_start, no_done.  No log at all is a row of its own."""
    seen = _rollout_lines(lines, rollout, order).select(
        F.when(F.col("start").isNull(), F.lit("no_start"))
        .when(F.col("done").isNull(), F.lit("no_done"))
        .otherwise(F.lit("complete"))
        .alias("outcome")
    )
    counted = seen.groupBy("outcome").agg(F.count("*").alias("n_logs"))
    none = counted.agg(F.coalesce(F.sum("n_logs"), F.lit(0)).alias("n")).where("n = 0").select(
        F.lit("no_logs").alias("outcome"), F.lit(0).cast("long").alias("n_logs")
    )
    return counted.unionByName(none)


def _rollout_lines(lines: DataFrame, rollout: str, order: Sequence[str]) -> DataFrame:
    at = F.struct(*order)
    value = F.col("value")
    is_start, is_done = value.rlike(ROLLOUT_START), value.rlike(ROLLOUT_DONE)
    return lines.groupBy(rollout).agg(
        F.min_by(value, F.when(is_start, at)).alias("start"),
        F.max_by(value, F.when(is_done, at)).alias("done"),
    )


def _rollout_fields(rollout: str) -> list[Column]:
    def done(i: int) -> Column:
        return F.regexp_extract("done", ROLLOUT_DONE, i)

    def count(i: int) -> Column:
        return F.regexp_extract(done(10), ROLLOUT_COUNTS, i).try_cast("int")

    stamp = F.substring_index(F.regexp_extract("start", ROLLOUT_START, 1), ",", 1)
    numbers = [("reward", 4), ("raw", 5), ("binary", 6), ("f2p", 7)]
    return [
        F.col(rollout),
        F.regexp_extract("start", ROLLOUT_START, 2).alias("inst"),
        stamp.try_cast("timestamp_ntz").alias("ts"),
        done(1).alias("mode"),
        (done(2) == "True").alias("submitted"),
        done(3).try_cast("int").alias("patch"),
        *[done(i).try_cast("double").alias(n) for n, i in numbers],
        done(8).try_cast("int").alias("turns"),
        done(9).try_cast("int").alias("ptok"),
        *[count(i + 1).alias(n) for i, n in enumerate(["f2p_pass", "f2p_tot", "p2p_ok", "p2p_tot"])],
        (count(3) != count(4)).alias("p2p_broke"),
    ]


def read_archive(spark: SparkSession, root: str, logical_pattern: str) -> DataFrame:
    """Plain and gzip copies of a record are one logical record; the plain copy wins.

    A damaged gzip file fails the job, whatever the session says about corrupt files.
    """
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", False)
        .option("wholetext", True)
        .text(root)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    return archive_records(raw, logical_pattern)


def archive_records(files: DataFrame, logical_pattern: str) -> DataFrame:
    """Keeps one copy per logical name (first group of the pattern), plain before gzip."""
    named = files.select(
        F.regexp_extract("path", logical_pattern, 1).alias("logical_name"),
        F.col("path").endswith(".gz").alias("is_gz"),
        "path",
        "value",
    )
    return keep_first(named, ["logical_name"], ["is_gz", "path"])


def read_broken_json(spark: SparkSession, path: str, schema: str, record_start: str | None = None, max_chars: int = 8_000_000) -> DataFrame:
    """JSON objects that may span several lines, fields in any order; every line ends up in one row.

    A string holds no line break, so each line's change of bracket depth is its
    own, and a record ends where the running depth of its file is back at its
    lowest so far: a stray closing bracket is a bad record of its own.  ``bad`` rows are records that do not parse as one object; they keep
    their ``text``.  A record that was cut never closes: it takes what follows
    with it, as the sequential reader would, up to ``max_chars`` at a time, or
    up to the next line that begins with ``record_start`` when one is given.
    """
    lines = read_lines(spark, path).withColumn("value", F.regexp_replace("value", r"\r$", ""))
    return join_broken_json(lines.where(F.length(tx.strip(F.col("value"))) > 0), schema, record_start, max_chars)


def join_broken_json(
    lines: DataFrame, schema: str, record_start: str | None = None, max_chars: int = 8_000_000, file: str = "file", order: Sequence[str] = ("block", "line")
) -> DataFrame:
    """The records of ordered lines (``value``): parsed fields, ``bad``, and the ``text`` of bad ones."""
    narrow = lines.select(
        file, *order, "value", tx.json_depth(F.col("value")).cast("long").alias("_d"), (F.length("value") + 1).cast("long").alias("_n"),
        (F.col("value").startswith(record_start) if record_start else F.lit(False)).cast("long").alias("_start"),
    )
    at = list(order)
    rows = running(narrow, [file], at, {"_part": ("sum", F.col("_start")), "_depth": ("sum", F.col("_d")), "_chars": ("sum", F.col("_n"))})
    # A line that may begin a record sets the depth back; without such lines the file is one part.
    rows = rows.withColumn("_before", F.col("_depth") - F.col("_d"))
    base = rows.where("_start = 1").select(F.col(file).alias("_f"), F.col("_part").alias("_p"), F.col("_before").alias("_base"))
    rows = rows.join(base, (F.col(file) == F.col("_f")) & (F.col("_part") == F.col("_p")), "left").withColumn("_base", F.coalesce("_base", F.lit(0)))
    # A closing bracket without an opening one lowers the ground that later records stand on.
    rows = running(rows, [file, "_part"], at, {"_low": ("min", F.col("_depth"))})
    rows = rows.withColumn("_ends", (F.col("_depth") <= F.least("_base", "_low")).cast("long")).select(file, *at, "value", "_n", "_chars", "_part", "_ends")
    rows = running(rows, [file], at, {"_closed": ("sum", F.col("_ends"))}).withColumn("_record", F.col("_closed") - F.col("_ends"))
    first = rows.groupBy(file, "_part", "_record").agg(F.min(F.col("_chars") - F.col("_n")).alias("_from"), F.sum("_n").alias("_size"))
    keys = [F.col(file).alias("_f"), F.col("_part").alias("_p"), F.col("_record").alias("_r"), "_from", "_size", F.col("_ends_well").alias("_well")]
    ended = rows.groupBy(file, "_part", "_record").agg(F.max("_ends").alias("_ends_well"))
    first = first.join(ended, [file, "_part", "_record"]).select(*keys)
    same = (F.col(file) == F.col("_f")) & (F.col("_part") == F.col("_p")) & (F.col("_record") == F.col("_r"))
    # Only what never closes is cut: a whole record is one value, however long.
    piece = F.when(F.col("_well") == 1, F.lit(0)).otherwise(F.floor((F.col("_chars") - F.col("_n") - F.col("_from")) / max_chars))
    rows = rows.join(first, same).withColumn("_piece", piece.cast("long"))
    joined = rows.groupBy(file, "_part", "_record", "_piece").agg(F.array_sort(F.collect_list(F.struct(*at, "value"))).alias("_lines"))
    joined = joined.select(F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("text"))
    parsed = T.StructType.fromDDL(schema + ", _corrupt_record string")
    out = joined.withColumn("_sound", tx.is_json_object(F.col("text"))).withColumn(
        "_j", F.from_json(F.when(F.col("_sound"), F.col("text")), parsed, {"columnNameOfCorruptRecord": "_corrupt_record"})
    )
    bad = ~F.col("_sound") | F.col("_j._corrupt_record").isNotNull()
    names = [f.name for f in parsed if f.name != "_corrupt_record"]
    return out.select(*[F.when(~bad, F.col(f"_j.{n}")).alias(n) for n in names], bad.alias("bad"), F.when(bad, F.col("text")).alias("text_of_bad"))


@F.pandas_udf(T.StringType())
def literal_text(values: pd.Series) -> pd.Series:
    """Text behind a Python string literal; a damaged literal loses its outer quotes only."""

    def decode(blob):
        if blob is None:
            return None
        try:
            value = ast.literal_eval(blob)
        except (SyntaxError, ValueError):
            return blob.strip("'\"")
        return value if isinstance(value, str) else None

    return values.map(decode)


def action_log(lines: DataFrame, trace: str = "file", order: Sequence[str] = ("block", "line")) -> DataFrame:
    """Executed commands from lines ``turn=.. cmd=<literal> rc=..``, in order, one row each."""
    value = F.col("value")
    rows = lines.where(value.contains("turn=") & value.contains(" cmd=") & value.contains(" rc="))
    blob = F.regexp_extract("value", ACTION_LINE, 1)
    return rows.select(trace, *order, literal_text(blob).alias("action")).where(
        F.col("action").isNotNull() & (F.col("action") != "")
    )


MESSAGE_LIST = "array<struct<role:string,content:string,reasoning_content:string,synthetic:boolean>>"


def read_samples(spark: SparkSession, paths: str | list[str], limit: int | None = None) -> DataFrame:
    """Training samples from parquet: messages and tools decoded from their JSON columns."""
    raw = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if limit is not None:
        raw = raw.limit(limit)
    return raw.withColumn("messages", F.from_json("messages_json", MESSAGE_LIST)).drop("messages_json")
