"""URL filters: fixed host and path rules, and association rules mined from what these decide.

URLs that a fixed rule covers are the labelled examples.  FP-growth mines the
combinations of URL tokens that go with a label; rules below the support or the
confidence asked for, and rules that a part of their tokens predicts as well, are
pruned.  Tokens that always occur together are one item.  The rest are matched by an inverted index: each rule hangs on its rarest
token, a URL meets the rules of its own tokens, and keeps those whose tokens it
has all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungauge.shared import cut_lineage

# Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty for a null url or one without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as (rule, verdict); null when none does."""
    out = None
    for verdict, domain, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(start))
        found = F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<rule: string, verdict: string>") if out is None else out


def tokens_of(host: Column, path: Column, rest: Column) -> Column:
    """Sorted distinct tokens: host labels and their parts, path words, names of query parameters; numbers are alike."""
    split = lambda text, pattern: F.filter(F.split(text, pattern), lambda t: t != "")
    number = lambda t: F.when(t.rlike("^[0-9]+$"), "0").otherwise(t)
    lower = lambda t: F.translate(t, UPPER, LOWER)
    host_parts = F.transform(split(host, r"[.:@_-]"), lambda t: F.concat(F.lit("h:"), number(t)))
    path_parts = F.transform(split(path, r"[/._~+,;=-]"), lambda t: F.concat(F.lit("p:"), number(lower(t))))
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    names = F.transform(split(query, r"[&;]"), lambda t: F.concat(F.lit("q:"), lower(F.split(t, "=")[0])))
    return F.array_sort(F.array_distinct(F.concat(host_parts, path_parts, names)))


def mined(labelled: DataFrame, support: float, confidence: float, fit_rows: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """``items``, ``verdict``, ``confidence``, ``support`` and ``anchor`` (the rarest item) of each rule kept, and the classes of tokens.

    ``labelled``: tokens, verdict, and ``pick``, by whose hash about ``fit_rows`` rows at
    most are mined, whatever files they lie in; all rows where no number is given.  Items
    are classes (``token_classes``).  A class that only occurs with one verdict is a rule
    by itself, and every rule that holds it and more is pruned: it needs no mining.  The
    classes of both verdicts are mined, all of them.  None when there are no rows.
    """
    rows = cut_lineage(labelled.select("tokens", "verdict", F.xxhash64("pick").alias("pick")), "url-labels")
    n = rows.count()
    if not n:
        return None
    if fit_rows is not None and n > fit_rows:
        rows = cut_lineage(rows.filter(F.pmod("pick", F.lit(1 << 20)) < int(fit_rows / n * (1 << 20))), "url-sample")
    numbered = cut_lineage(rows.withColumn("id", F.monotonically_increasing_id()), "url-rows")
    n = numbered.count()
    classes = cut_lineage(token_classes(numbered, math.ceil(support * n)), "url-classes")
    pairs = numbered.select("id", F.explode("tokens").alias("token")).join(classes.where("told.share < 1"), "token")
    kept_items = pairs.groupBy("id").agg(F.collect_set("class").alias("items"))
    rows = numbered.join(kept_items, "id", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    rows = cut_lineage(rows, "url-items")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows)
    rules = model.associationRules.filter(F.startswith(F.element_at("consequent", 1), F.lit("=")))
    rules = rules.select(F.array_sort("antecedent").alias("items"), F.substring(F.element_at("consequent", 1), 2, 100).alias("verdict"), "confidence", "support")
    sure = classes.where("told.share = 1").select("class", "told").distinct()
    sure = sure.select(F.array("class").alias("items"), F.col("told.verdict").alias("verdict"), F.lit(1.0).alias("confidence"), (F.col("told.n") / n).alias("support"))
    rules = cut_lineage(rules.unionByName(sure), "url-rules")
    smaller = rules.select(F.col("items").alias("part"), F.col("verdict").alias("part_verdict"), F.col("confidence").alias("part_confidence"))
    parts = rules.withColumn("part", F.explode(F.transform("items", lambda x: F.array_remove(F.col("items"), x))))
    weaker = parts.join(smaller, ["part"]).filter((F.col("verdict") == F.col("part_verdict")) & (F.col("part_confidence") >= F.col("confidence"))).select("items", "verdict")
    kept = rules.join(weaker.distinct(), ["items", "verdict"], "left_anti")
    single = classes.select(F.col("class").alias("item"), F.col("told.n").alias("freq")).distinct()
    by_item = kept.select("items", F.explode("items").alias("item")).join(single, "item").groupBy("items").agg(F.min_by("item", F.struct("freq", "item")).alias("anchor"))
    return cut_lineage(kept.join(by_item, "items"), "url-index"), classes.select("token", "class")


def token_classes(rows: DataFrame, least: int) -> DataFrame:
    """``class`` of each token that at least ``least`` rows (id, tokens, verdict) hold, and ``told``: the share, the number and the verdict of most of its rows.

    Tokens that occur in exactly the same rows are one class, named by its least
    token: they are told apart by the number and two sums of hashes of their rows.
    A long path that many URLs share is then one item, not as many as it has parts.
    """
    halves = {"low": F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFFFF)), "high": F.shiftrightunsigned(F.xxhash64("id"), 32)}
    tokens = rows.select("verdict", *[c.alias(n) for n, c in halves.items()], F.explode("tokens").alias("token"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    counted = counted.filter(F.col("n") >= least)
    named = counted.groupBy("n", "low", "high").agg(F.min("token").alias("class"), F.first("blocked").alias("blocked"))
    mostly = F.when(F.col("blocked") * 2 > F.col("n"), "block").otherwise("allow")
    told = F.struct((F.greatest("blocked", F.col("n") - F.col("blocked")) / F.col("n")).alias("share"), "n", mostly.alias("verdict"))
    return counted.select("token", "n", "low", "high").join(named.select("n", "low", "high", "class", told.alias("told")), ["n", "low", "high"]).select("token", "class", "told")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, support: float = 0.01, confidence: float = 0.8, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``mined`` (the tokens of the mined rule that decided).

    A null url, or one without ``://``, has empty host and path.  A URL that no
    rule fits, fixed or mined, is allowed.  Of several mined rules the most
    confident decides, then the better supported, then the longer.  Rows come
    back as often as they came; columns of these names in the input are replaced.
    """
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "mined")]
    rest = rest_of(F.col(f"row.`{url}`"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")).withColumn("rest", rest)
    rows = rows.withColumn("host", host_of(F.col("rest"))).withColumn("path", path_of(F.col("rest")))
    rows = rows.withColumn("fixed", fixed(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("host"), F.col("path"), F.col("rest")))
    rows = cut_lineage(rows.withColumn("key", F.md5(F.array_join("tokens", "\x00").cast("binary"))).drop("rest"), "urls")
    found = mined(rows.filter("fixed is not null").select("tokens", "fixed.verdict", F.col("row").alias("pick")), support, confidence)
    base = [F.col("row.*"), F.col("host"), F.col("path"), F.col("fixed.rule").alias("rule")]
    if found is None:
        return rows.select(*base, F.coalesce("fixed.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("mined"))
    asked = rows.filter("fixed is null").groupBy("key").agg(F.first("tokens").alias("tokens"))  # URLs alike in all tokens are judged once
    index, classes = found
    # A URL has a class when it has any token of it.
    asked = asked.select("key", F.explode("tokens").alias("token")).join(classes, "token").groupBy("key").agg(F.collect_set("class").alias("tokens"))
    met = asked.select("key", "tokens", F.explode("tokens").alias("anchor")).join(index, "anchor")
    met = met.filter(F.size(F.array_except("items", "tokens")) == 0)
    strength = F.struct("confidence", "support", F.size("items").alias("n"), F.array_join("items", " ").alias("mined"), "verdict")
    decided = met.groupBy("key").agg(F.max(strength).alias("by")).select("key", F.col("by.verdict").alias("by_mined"), F.col("by.mined").alias("mined"))
    joined = rows.join(decided, "key", "left")
    free = F.col("fixed").isNull()
    return joined.select(
        *base, F.coalesce("fixed.verdict", "by_mined", F.lit("allow")).alias("verdict"), F.when(free, F.col("mined")).alias("mined")
    )
