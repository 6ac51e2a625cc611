"""Toxicity by a weighted finite-state pattern grammar.

Words are read as classes: insult, threat, will, target, negation, report.  Four
transducers run over a clause one after the other: negation and reported speech
turn an insult into a weaker class, a target in the same clause strengthens it,
and a threat counts when it is announced and has a target.  What is scored is the
matched clause, so the same word weighs more in "you are an idiot" than in "he
said he was not an idiot".

The insults' stems and weights are learned: words and beginnings of words that
stand in toxic labelled texts more often than chance allows.  A logistic curve
over the clause scores, fitted on the same rows, gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungauge.llm.folds import held_out
from rungauge.llm.words import Words, combined, pieces
from rungauge.shared import cut_lineage

FIT_ROWS = 12_000  # labelled rows the lexicon and the curve are fitted on, about; all, if there are fewer
TERMS = 2_000  # words and beginnings in the lexicon at most
STEMS = (3, 4, 5, 6, 7)  # lengths of beginnings
REJECT = 0.7

# Words of the grammar's closed classes.
CLASSES = {
    "threat": "kill hurt beat destroy burn shoot stab punch strangle crush töten schlagen verbrennen tuer frapper brûler matar golpear quemar",
    "will": "will shall gonna going must should i'll we'll werde werden wollen vais allons voy vamos",
    "target": "you your you're u he she they them him her these those this that du dich dir ihr euch sie tu te toi vous ils eux usted ustedes ellos ti",
    "negation": "not never no nobody isn't aren't don't without nicht kein keine nie ne pas jamais nunca jamás sin",
    "report": "said says say wrote writes quoted quote called claims claimed reported sagte schrieb dit écrit dijo escribió",
}
CLOSED = {word: name for name, words in CLASSES.items() for word in words.split()}
INSULTS = "idiot moron stupid scum loser trash pathetic worthless disgusting imbecile"
SEED_WEIGHT = 1.0  # of these where no labels speak

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]")
CLAUSE = re.compile(r"[^.!?;:\n]+")


@dataclass
class Transducer:
    """Arcs from (state, class) to (state, class, log weight); a pair without arc keeps both at weight 0."""

    arcs: dict[tuple[str, str], tuple[str, str, float]] = field(default_factory=dict)
    lapse: dict[str, str] = field(default_factory=dict)  # the state that follows when a word of no class is read

    def run(self, classes: list[str], weights: list[float]) -> tuple[list[str], list[float]]:
        state, out, total = "", [], []
        for name, weight in zip(classes, weights):
            arc = self.arcs.get((state, name))
            if arc:
                state, name, more = arc
                weight += more
            else:
                state = self.lapse.get(state, state)
            out.append(name)
            total.append(weight)
        return out, total


# A negation reaches over three words; reported speech to the end of its clause.
NEGATION = Transducer({("", "negation"): ("3", "negation", 0.0)}, {"3": "2", "2": "1", "1": ""})
for _state in "321":
    NEGATION.arcs[_state, "insult"] = ("", "denied", math.log(0.25))
    NEGATION.arcs[_state, "threat"] = ("", "denied", math.log(0.25))
    NEGATION.arcs[_state, "negation"] = ("3", "negation", 0.0)
REPORT = Transducer({("", "report"): ("told", "report", 0.0), ("told", "insult"): ("told", "insult", math.log(0.5)), ("told", "threat"): ("told", "threat", math.log(0.5))})
TARGET = Transducer({
    ("", "target"): ("aimed", "target", 0.0),
    ("aimed", "insult"): ("aimed", "insult", math.log(2.0)),
    ("aimed", "report"): ("", "report", 0.0),  # who speaks is not who is meant
    ("", "insult"): ("open", "insult", 0.0),
    ("open", "target"): ("aimed", "struck", math.log(0.5)),  # an insult first, then its target: half of one more
})
THREAT = Transducer({
    ("", "will"): ("announced", "will", 0.0),
    ("announced", "threat"): ("near", "threat", math.log(0.5)),
    ("near", "target"): ("", "menace", math.log(3.0)),
    ("near", "struck"): ("", "menace", math.log(3.0)),
    ("", "threat"): ("", "other", 0.0),
})
GRAMMAR = (NEGATION, REPORT, TARGET, THREAT)
SCORED = ("insult", "denied", "struck", "menace")


@dataclass
class Lexicon:
    """Log weights of insulting words and of beginnings of words."""

    words: dict[str, float]
    stems: dict[str, float]

    def pattern(self) -> re.Pattern:
        """Finds a text that can score at all: an insult or a threat."""
        forms = [re.escape(w) + r"\b" for w in [*self.words, *CLASSES["threat"].split()]] + [re.escape(s) + r"\w" for s in self.stems]
        by: dict[str, list[str]] = {}
        for form in sorted(forms):
            by.setdefault(form[0], []).append(form[1:] if form[0] != "\\" else form)
        return re.compile(r"\b(?:" + "|".join(f"{re.escape(c) if c != chr(92) else ''}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")" if by else r"(?!)")

    def classes(self, clause: str) -> tuple[list[str], list[float]]:
        names, weights = [], []
        for word in WORD.findall(clause):
            if word in self.words:
                name, weight = "insult", self.words[word]
            elif stem := next((word[:n] for n in STEMS if n < len(word) and word[:n] in self.stems), None):
                name, weight = "insult", self.stems[stem]
            else:
                name, weight = ("report" if word in "\"“”«»" else CLOSED.get(word, "")), 0.0
            names.append(name)
            weights.append(math.log(weight) if weight > 0 else 0.0)
        return names, weights

    def matched(self, text: str, quick: re.Pattern) -> list[float]:
        """Scores of the clauses of a text that match the grammar."""
        text = text.lower()
        out, end = [], -1
        for hit in quick.finditer(text):
            if hit.start() < end:
                continue
            floor = max(end, 0)  # the last clause ended at a mark or in this clause, so nothing before it is searched again
            start = max(max(text.rfind(c, floor, hit.start()) for c in ".!?;:\n") + 1, floor)
            clause = CLAUSE.match(text, start)
            end = clause.end() if clause else hit.end()
            names, weights = self.classes(text[start:end])
            for transducer in GRAMMAR:
                names, weights = transducer.run(names, weights)
            score = sum(math.exp(w) for n, w in zip(names, weights) if n in SCORED)
            if score > 0:
                out.append(score)
        return out


@dataclass
class Model:
    lexicon: Lexicon
    curve: tuple[float, float, float]  # of 1, log(1 + sum of clause scores), highest clause score

    def features(self, text: str | None, quick: re.Pattern) -> tuple[float, float]:
        scores = self.lexicon.matched(text or "", quick)
        return math.log1p(sum(scores)), max(scores, default=0.0)

    def score(self, total: float, most: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * total + c * most))))


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``text`` and ``toxic`` of labelled rows that aren't held out, copies and near-copies of a text once.

    Copies would make a rare word look like evidence: of the texts that share
    the least hash of their five-word runs, one is kept per label.  At most about
    ``fit_rows`` labels are joined, so they can be sent to every task.
    """
    given = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = given.filter(~held_out(F.col("doc_id")))
    n = given.count()
    if n > fit_rows:
        given = given.filter(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) < int(fit_rows / n * (1 << 20)))
    given = given.select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(given), F.col("doc_id") == F.col("of")).select("text", "toxic")

    def families(batches) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches):
            words = Words(data, offsets)
            runs = combined(words.hashes, 5) >> np.uint64(1)
            family = np.zeros(batch.num_rows, np.int64)
            for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                family[i] = runs[a : b - 4].min().astype(np.int64) if b - a >= 5 else (words.hashes[a:b].min() >> np.uint64(1) if b > a else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(family)], names=["text", "toxic", "family"])

    marked = rows.mapInArrow(families, "text string, toxic int, family long")
    one = marked.groupBy("family", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))  # the same text on every run
    return cut_lineage(one.select("least.text", "toxic"), "toxic-sample")


def learned(rows: DataFrame, terms: int = TERMS) -> Lexicon:
    """Words and beginnings that stand in toxic texts beyond chance.

    The evidence of a term in n texts with a toxic share p is n KL(p || base).
    It must exceed the log of the number of terms tried, over 0.05: none is
    expected to pass by chance.  A beginning stands for the words under it when
    it is as pure as they are.
    """
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}'’]+")), lambda w: F.length(w) >= 3)

    def beginnings(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.left(w, F.lit(n)), F.lit("*")))

    exploded = rows.select("toxic", F.explode(F.array_distinct(F.concat(words, *[beginnings(n) for n in STEMS]))).alias("term"))
    counts = exploded.groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    size = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    seeds = dict.fromkeys(INSULTS.split(), SEED_WEIGHT)
    if not size["bad"] or size["bad"] == size["n"]:
        return Lexicon(seeds, {})
    base = size["bad"] / size["n"]
    counts = cut_lineage(counts.filter("bad >= 2"), "toxic-terms")
    tried = counts.count()
    p = F.col("bad") / F.col("n")
    kl = p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0)
    strong = counts.withColumn("gain", F.col("n") * kl).filter((p >= 0.5) & (p > base) & (F.col("gain") >= math.log(max(tried, 1) / 0.05)))
    best = {r.term: (r.bad, r.n) for r in strong.orderBy(F.col("gain").desc(), "term").limit(terms).collect()}
    weight = lambda bad, n: math.log((bad + 0.5) / (n - bad + 0.5)) - math.log(base / (1 - base))
    kept: dict[str, float] = {}
    for term in sorted((t[:-1] for t in best if t.endswith("*")), key=lambda t: (len(t), t)):
        bad, n = best[term + "*"]
        alone = max((m for w, (_, m) in best.items() if not w.endswith("*") and w.startswith(term)), default=0)
        if bad / n >= 0.9 and alone < 0.9 * n and not any(term[:k] in kept for k in STEMS if k < len(term)):
            kept[term] = weight(bad, n)
    found = {t: weight(*c) for t, c in best.items() if not t.endswith("*") and not any(t[:k] in kept for k in STEMS if k < len(t))}
    return Lexicon(seeds | found, kept)


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's steps; the ridge keeps separable data finite."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    beta = np.zeros(x.shape[1])
    pull = ridge * np.eye(x.shape[1])
    pull[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + pull
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(beta)), x.T @ (y - p) - pull @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of the labelled rows that aren't held out."""
    rows = sample(docs, labels, fit_rows)
    model = Model(learned(rows), (-3.0, 3.0, 1.0))

    def measure(batches) -> Iterator[pa.RecordBatch]:
        quick = model.lexicon.pattern()
        for batch in batches:
            both = [model.features(t.as_py(), quick) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in both], pa.float64()), pa.array([b[1] for b in both], pa.float64()), batch.column(1)], names=["total", "most", "toxic"])

    seen = rows.mapInArrow(measure, "total double, most double, toxic int").toPandas()  # two numbers a row, at most about fit_rows rows
    y = seen["toxic"].to_numpy(np.float64)
    if len(y) and 0 < y.sum() < len(y):
        a, b, c = curve(seen[["total", "most"]].to_numpy(np.float64), y)
        if b > 0 or c > 0:
            model.curve = (float(a), float(max(b, 0.0)), float(max(c, 0.0)))
    return model


def scored_rows(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` (a struct of all columns), ``score`` and ``clauses``; the text is sent to Python once, inside its row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches) -> Iterator[pa.RecordBatch]:
        own = sent.value
        quick = own.lexicon.pattern()
        for batch in batches:
            out, clauses = [], []
            for value in pc.struct_field(batch.column(0), text):
                scores = own.lexicon.matched(value.as_py() or "", quick)
                out.append(own.score(math.log1p(sum(scores)), max(scores, default=0.0)))
                clauses.append(len(scores))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(clauses, pa.int32())], names=["row", "score", "clauses"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.mapInArrow(score, T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("clauses", T.IntegerType())]))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``clauses`` (how many matched).

    Whole texts are read.  A null or empty text scores like one without matches;
    repeated rows are scored each for itself; columns of these names in the input
    are replaced.  The model is bounded by ``TERMS``.
    """
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("score", "clauses")]
    return scored_rows(docs, model, text).select(*kept, "score", "clauses")
