"""Personal data: labelers vote on spans, expectation-maximisation weighs them, a classifier decides.

Only DataFrame functions touch the rows.  Matches of a pattern are placed by the
lengths of the gaps between them (``split`` and ``regexp_extract_all`` walk a text
alike).  Every candidate has a vote per labeler: 1, 0, or none.  Labelers see few
vote patterns, so the rows are counted by pattern, and the reliabilities are
estimated from the counts; a logistic regression trained on the estimated labels
then scores every pattern, also those in which labelers disagree.

Spans of the four checked kinds (``BASE``) always stay; the classifier adds spans
of the other kinds.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungauge.shared import cut_lineage

# Patterns.  Possessive quantifiers and look-behinds change nothing in
# what is found from left to right; they keep long runs linear and the stack flat.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"(?<![0-9A-Za-z.@_+)-])(?<![0-9)][\x20-])[0-9](?:[\x20-]?[0-9]){8,18}+(?![\x20-]?[0-9])(?![0-9A-Za-z@_])"
NAME = (
    r"\b(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?"
    r"|(?:James|John|Robert|Michael|William|David|Mary|Patricia|Jennifer|Linda|Elizabeth|Susan|Sarah|Karen|Anna|Maria"
    r"|Hans|Peter|Klaus|Petra|Pierre|Jean|Marie|Claire|José|Juan|Carlos|Carmen|Lucía)\x20\p{Lu}\p{Ll}++)"
)

BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "name")
LABELERS = ("shape", "check", "gazetteer", "for_it", "against_it")
CONTEXT = 40  # characters before a span that context labelers read
FOR_IT = r"(?i)(?:phone|tel|call|fax|mobile|card|visa|account|iban|ssn|passport|e-?mail|contact|mail|ip|address|name|dear|telefon|konto|compte|cuenta|teléfono)[^\p{L}]*+$"
AGAINST_IT = r"(?i)(?:id|no|nr|num|number|version|isbn|order|item|page|total|hash|token|serial|sku|build|chapter)[^\p{L}]*+$"
ISSUERS = r"^(?:4|5[1-5]|34|37|6011|65|35)"
BLOCK = 256


def placed(text: Column, pattern: str) -> Column:
    """start, end, matched part and the characters before each match of a pattern, from left to right.

    Ends are running sums of lengths, summed by blocks, so that a text with very
    many matches takes time in proportion to them.
    """
    gaps = F.split(text, pattern, -1)
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.transform(parts, lambda p, i: F.length(F.get(gaps, i)) + F.length(p))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x),
    )
    before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def span(bundle: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            inside = F.aggregate(F.slice(bundle.steps, block * BLOCK + 1, i % BLOCK + 1), F.lit(0), lambda a, x: a + x)
            end = F.get(bundle.before, block) + inside
            return F.struct(
                (end - F.length(p)).cast("long").alias("start"), end.cast("long").alias("end"), p.alias("part"), F.right(F.get(bundle.gaps, i), F.lit(CONTEXT)).alias("context")
            )

        return F.transform(bundle.parts, one)

    bundle = F.struct(parts.alias("parts"), gaps.alias("gaps"), steps.alias("steps"), before.alias("before"))
    # One evaluation of the bundle, whatever number of matches refers to it.
    return F.when(F.size(parts) > 0, F.element_at(F.transform(F.array(bundle), span), 1))


def digits(part: Column) -> Column:
    return F.regexp_replace(part, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def octets(part: Column) -> Column:
    """Whether no part of a dotted number exceeds 255, however many zeros lead it."""
    return F.forall(F.transform(F.split(part, r"\."), lambda p: F.regexp_replace(p, "^0+", "")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def votes(kind: str, part: Column, context: Column) -> Column:
    """Each labeler's vote as a character: 1 for personal data, 0 against it, - for none."""
    number = digits(part)
    n = F.length(number)
    shape, check, gazetteer = F.lit("1"), F.lit("-"), F.lit("-")
    if kind == "email":
        gazetteer = F.when(part.rlike(r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk)$"), "1").otherwise("0")
    elif kind == "ip":
        check = F.when(part.rlike(r"^(?:0|10|127)\."), "0").otherwise("1")
    elif kind == "card":
        check, gazetteer = F.lit("1"), F.when(number.rlike(ISSUERS), "1").otherwise("0")
    elif kind == "phone":
        gazetteer = F.when(part.rlike(r"^\+(?:1|33|34|39|4[1-9]|7)\b"), "1").otherwise("-")
    elif kind == "number":
        shape = F.when(part.rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:[0-9]{4}[\x20-]){3}[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})$"), "1").otherwise("0")
        check = F.when(n.between(14, 19), F.when(luhn(number), "1").otherwise("0")).otherwise("-")
        gazetteer = F.when(n.between(15, 16), F.when(number.rlike(ISSUERS), "1").otherwise("0")).otherwise("-")
    elif kind == "name":
        gazetteer = F.when(part.rlike(r"^\p{Lu}\p{Ll}+\.?\x20\p{Lu}\p{Ll}+\x20\p{Lu}"), "1").otherwise("-")
    for_it = F.when(context.rlike(FOR_IT), "1").otherwise("-")
    against_it = F.when(context.rlike(AGAINST_IT), "0").otherwise("-")
    return F.concat(F.lit(f"{kind}:"), shape, check, gazetteer, for_it, against_it)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``more``: arrays of (start, order, kind, end, pattern of votes)."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def spans(kind: str, pattern: str, hint: Column, keep) -> Column:
        found = F.coalesce(placed(F.when(hint, content), pattern), F.array().cast("array<struct<start: bigint, end: bigint, part: string, context: string>>"))
        order = (BASE + ADDED).index(kind)
        return F.transform(
            F.filter(found, keep),
            lambda s: F.struct(s.start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s.end.alias("end"), votes(kind, s.part, s.context).alias("pattern")),
        )

    def plain_phone(s: Column) -> Column:
        return F.length(digits(s.part)).between(10, 15)

    base = F.concat(
        spans("email", EMAIL, F.contains(content, F.lit("@")), lambda s: F.lit(True)),
        spans("ip", IP, content.rlike(r"[0-9]\.[0-9]"), lambda s: octets(s.part)),
        spans("card", CARD, content.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), lambda s: luhn(digits(s.part))),
        spans("phone", PHONE, F.contains(content, F.lit("+")), plain_phone),
    )
    more = F.concat(
        spans("number", NUMBER, content.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), lambda s: ~(F.length(digits(s.part)).between(14, 19) & luhn(digits(s.part)))),
        spans("name", NAME, F.lit(True), lambda s: F.lit(True)),
    )
    return docs.withColumn("base", F.array_sort(base)).withColumn("more", F.array_sort(more))


def reliabilities(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """The probability that a vote pattern marks personal data, by expectation-maximisation.

    Two classes, labelers independent within a class.  A labeler's rate of saying
    1 in either class is smoothed towards being right; a vote that is missing says
    nothing.  ``counts``: at most 3^5 patterns a kind, whatever the table's size.
    """
    rows = [(p, p.split(":")[1], n) for p, n in counts.items()]
    yes, no, prior = [0.8] * len(LABELERS), [0.2] * len(LABELERS), 0.5
    chance: dict[str, float] = {}
    for _ in range(rounds):
        for pattern, given, _ in rows:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(given):
                if v != "-":
                    odds += math.log(yes[j] / no[j]) if v == "1" else math.log((1 - yes[j]) / (1 - no[j]))
            chance[pattern] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        prior = (1 + sum(n * chance[p] for p, _, n in rows)) / (2 + sum(n for *_, n in rows))
        for j in range(len(LABELERS)):
            said = [(given[j] == "1", n, chance[p]) for p, given, n in rows if given[j] != "-"]
            yes[j] = (8 + sum(n * c for one, n, c in said if one)) / (10 + sum(n * c for _, n, c in said))
            no[j] = (2 + sum(n * (1 - c) for one, n, c in said if one)) / (10 + sum(n * (1 - c) for _, n, c in said))
    return chance


def classified(patterns: DataFrame, chance: dict[str, float]) -> DataFrame:
    """``pattern`` and ``probability`` by a logistic regression trained on the estimated labels."""
    given = F.split_part("pattern", F.lit(":"), F.lit(2))
    kind = F.split_part("pattern", F.lit(":"), F.lit(1))
    features = {f"is_{k}": (kind == k).cast("double") for k in BASE + ADDED}
    for j, name in enumerate(LABELERS):
        vote = F.substring(given, j + 1, 1)
        features |= {f"{name}_1": (vote == "1").cast("double"), f"{name}_0": (vote == "0").cast("double")}
    spark = patterns.sparkSession
    labels = spark.createDataFrame([(p, float(c)) for p, c in chance.items()], "pattern string, chance double")
    rows = patterns.join(F.broadcast(labels), "pattern").withColumns(features)
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    both = rows.select("features", (F.col("n") * F.col("chance")).alias("weight"), F.lit(1.0).alias("label")).unionByName(
        rows.select("features", (F.col("n") * (1 - F.col("chance"))).alias("weight"), F.lit(0.0).alias("label"))
    )
    model = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=50).fit(both.coalesce(1))
    return model.transform(rows).select("pattern", vector_to_array("probability")[1].alias("probability"))


def detected(docs: DataFrame, threshold: float = 0.9, text: str = "text") -> DataFrame:
    """``docs`` (without their text) with ``base`` and ``spans``: arrays of (start, order, kind, end, pattern), sorted.

    ``base`` holds the checked kinds, ``spans`` these and the added ones that the
    classifier gives at least ``threshold``, and only where a context or gazetteer
    labeler speaks for them and more labelers speak for than against.  Positions are code points, ends exclusive.  A null
    or empty text has none; repeated rows are scanned each for itself; a table
    without candidates adds none.  Columns base, more and spans are replaced.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "base", "more", "spans")]
    found = cut_lineage(candidates(docs.select(*others, F.col(text)), text).drop(text), "pii-candidates")
    voted = found.select(F.explode(F.concat("base", "more")).alias("span")).groupBy(F.col("span.pattern").alias("pattern")).agg(F.count("*").alias("n"))
    counts = {r.pattern: r.n for r in voted.collect()}  # bounded by the number of patterns
    accepted: list[str] = []
    if any(p.split(":")[0] in ADDED for p in counts):
        patterns = docs.sparkSession.createDataFrame(list(counts.items()), "pattern string, n long")
        sure = classified(patterns, reliabilities(counts)).filter(F.col("probability") >= threshold)
        supported = lambda given: "1" in given[2:4] and given.count("1") > given.count("0")
        accepted = sorted(r.pattern for r in sure.collect() if r.pattern.split(":")[0] in ADDED and supported(r.pattern.split(":")[1]))
    added = F.filter("more", lambda s: s.pattern.isin(accepted) if accepted else F.lit(False))
    return found.withColumn("spans", F.array_sort(F.concat("base", added))).drop("more")
