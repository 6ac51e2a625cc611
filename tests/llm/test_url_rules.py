"""URL verdicts against a plain reading of the rules, and against brute-force rule mining."""

import time
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from rungauge.llm import url_rules


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(d + p, v) for v, d, p in url_rules.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0])) if fits else None


ODD = [
    None, "", "nothing", "://", "http://", "http://net/", "http://NET", "http://a.net?x=/", "HTTP://WWW.Example.NET/en/1#f?x", "http://xnet/a",
    "http://example.com/de/", "http://example.com/DE/", "http://example.com.org/fr/x?a=1&b", "x://y://z/", "http://é.org/fr/ü", "http://a.net/" + "p/" * 5000,
]


def urls():
    hosts = ["a.net", "example.net", "b.example.com", "c.org", "win-casino.com"]
    return [f"http://{h}/{s}/{i}.html" for i, h in enumerate(hosts * 8) for s in ("en", "de", "fr")]


def test_fixed_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(ODD + urls() + ["http://a.net/x"] * 3)]
    got = url_rules.judged(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert len(got) == len(rows)
    by = {i: plain(u) for i, u, _ in rows}
    for r in got:
        host, path, rule = by[r.page_id]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.mined is None) == ((rule[0], True) if rule else (None, r.mined is None))
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")


def test_mined_rules_are_the_frequent_confident_ones(spark):
    df = spark.createDataFrame([(u,) for u in urls()], "url string")
    rest = url_rules.rest_of(F.col("url"))
    host, path = url_rules.host_of(rest), url_rules.path_of(rest)
    rows = df.select(url_rules.tokens_of(host, path, rest).alias("tokens"), url_rules.fixed(host, path, url_rules.RULES).alias("f")).filter("f is not null").select("tokens", "f.verdict")
    rows = rows.withColumn("pick", F.monotonically_increasing_id())
    data, least, sure = [(r.tokens, r.verdict) for r in rows.collect()], 0.05, 0.8
    index, classes = url_rules.mined(rows, least, sure)
    n, named = len(data), token_classes(data, least)
    assert {(r["token"], r["class"]) for r in classes.collect()} == set(named.items())
    count, with_label = Counter(), Counter()
    for tokens, verdict in data:
        held = sorted({named[t] for t in tokens if t in named})
        for k in range(1, len(held) + 1):
            for c in combinations(held, k):
                count[c] += 1
                with_label[c, verdict] += 1
    rules = {(c, v): m / count[c] for (c, v), m in with_label.items() if m >= least * n and m / count[c] >= sure}
    want = {(c, v) for (c, v), q in rules.items() if not any(rules.get((p, v), 0) >= q for p in combinations(c, len(c) - 1) if p)}
    got = index.collect()
    assert {(tuple(r["items"]), r.verdict) for r in got} == want
    assert all(r.anchor in r["items"] for r in got)


def token_classes(data, least):
    """Least token of those that stand in exactly the same rows, for tokens that are frequent enough."""
    places = {}
    for i, (tokens, _) in enumerate(data):
        for t in tokens:
            places.setdefault(t, set()).add(i)
    places = {t: frozenset(p) for t, p in places.items() if len(p) >= least * len(data)}
    return {t: min(u for u in places if places[u] == p) for t, p in places.items()}


def test_matching_is_what_a_plain_reading_of_all_rules_gives(spark):
    mixed = urls() + [f"http://{h}/{a}/{b}?{c}=1" for h in ("new.com", "win-casino.io", "b.example.info") for a in ("de", "en", "x") for b in ("fr", "1.html", "casino") for c in ("de", "q")]
    df = spark.createDataFrame(list(enumerate(mixed)), "page_id long, url string")
    rest = url_rules.rest_of(F.col("url"))
    host, path = url_rules.host_of(rest), url_rules.path_of(rest)
    rows = df.select("page_id", url_rules.tokens_of(host, path, rest).alias("tokens"), url_rules.fixed(host, path, url_rules.RULES).alias("f"))
    index, classes = url_rules.mined(rows.filter("f is not null").select("tokens", "f.verdict", F.col("page_id").alias("pick")), 0.05, 0.8)
    named, rules = {r["token"]: r["class"] for r in classes.collect()}, index.collect()
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in url_rules.judged(df, support=0.05, confidence=0.8).collect()}
    decided = 0
    for r in rows.filter("f is null").collect():
        held = {named[t] for t in r["tokens"] if t in named}
        fits = [(u["confidence"], u["support"], len(u["items"]), " ".join(u["items"]), u["verdict"]) for u in rules if set(u["items"]) <= held]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        assert got[r["page_id"]] == (best[4], best[3])
        decided += bool(fits)
    assert decided > 5


def test_long_common_paths_end_soon(spark):
    """Forty tokens that always come together are one item; forty that nearly do are cut to a bounded number."""
    together = "/".join(f"part{i}" for i in range(40))
    for path in (lambda i: together, lambda i: "/".join(p for k, p in enumerate(together.split("/")) if k != i % 40)):
        rows = [f"http://s{i}.net/{path(i)}/{i}" for i in range(80)] + [f"http://o{i}.org/fr/{i}" for i in range(240)] + [f"http://new.com/{together}/x"]
        start = time.time()
        got = {r["url"]: r for r in url_rules.judged(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()}
        assert got[rows[-1]]["verdict"] == "block" and got[rows[-1]]["mined"]
        assert time.time() - start < 60


def test_the_sample_does_not_depend_on_files(spark):
    rows = [(["p:a", f"p:{i % 7}"], "block" if i % 3 else "allow", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string, pick long")
    found = [sorted((tuple(r["items"]), r["verdict"], round(r["support"], 9)) for r in url_rules.mined(d, 0.02, 0.5, fit_rows=300)[0].collect()) for d in (df.repartition(5), df.coalesce(1))]
    assert found[0] == found[1] and found[0]


def test_mined_rules_decide_the_rest(spark):
    df = spark.createDataFrame(list(enumerate(urls())), "page_id long, url string")
    got = {r.url: r for r in url_rules.judged(df, support=0.05).collect()}
    assert got["http://c.org/de/3.html"].verdict == "block" and "p:de" in got["http://c.org/de/3.html"].mined
    assert got["http://c.org/fr/3.html"].rule == "org/fr/"


def test_empty(spark):
    assert url_rules.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_of_urls_with_many_mixed_tokens_are_all_mined(spark):
    """Thirteen and more tokens that go with both verdicts: a rule of the least telling ones is found as well."""
    rows = []
    for i in range(400):
        blocked = i % 2 == 0
        held = [f"p:m{k:02d}" for k in range(13) if (i // 2 + k) % 13 or not blocked] if i % 20 < 2 else []
        pair = ["p:a"] * (i % 4 < 3) + ["p:b"] * (i % 4 in (0, 3) or i % 40 == 1)
        rows.append((sorted(held + pair), "block" if blocked else "allow", i))
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string, pick long")
    least, sure = 0.04, 0.8
    index, classes = url_rules.mined(df, least, sure)
    data = [(t, v) for t, v, _ in rows]
    named = token_classes(data, least)
    assert {(r["token"], r["class"]) for r in classes.collect()} == set(named.items())
    assert max(len({named[t] for t in t_ if t in named}) for t_, _ in data) > 12
    count, blocked = Counter(), Counter()
    for tokens, verdict in data:
        held = sorted({named[t] for t in tokens if t in named})
        for k in range(1, len(held) + 1):
            for c in combinations(held, k):
                count[c] += 1
                blocked[c] += verdict == "block"
    rules = {}
    for c, n in count.items():
        for v, m in (("block", blocked[c]), ("allow", n - blocked[c])):
            if m >= least * len(data) and m / n >= sure:
                rules[c, v] = m / n
    want = {(c, v) for (c, v), q in rules.items() if not any(rules.get((p, v), 0) >= q for p in combinations(c, len(c) - 1) if p)}
    assert {(tuple(r["items"]), r["verdict"]) for r in index.collect()} == want and want


def test_all_labelled_rows_are_mined(spark):
    """A token in a few of many rows counts with all of its rows."""
    df = spark.range(250_000).select(
        F.when(F.col("id") % 50 == 0, F.array(F.lit("p:x"), F.lit("p:y"))).otherwise(F.array(F.lit("p:y"))).alias("tokens"),
        F.when(F.col("id") % 50 == 0, "block").otherwise("allow").alias("verdict"), F.col("id").alias("pick"),
    )
    index, _ = url_rules.mined(df, 0.01, 0.8)
    assert {(tuple(r["items"]), r["verdict"], round(r["support"] * 250_000)) for r in index.collect()} == {(("p:x",), "block", 5_000), (("p:y",), "allow", 245_000)}
