"""Toxicity and language scoring: laws of the parts, held-out accuracy on the given tables."""

import math
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungauge.llm import lm_scoring, toxicity
from rungauge.llm import queries as q
from rungauge.llm.folds import held_out
from rungauge.llm.words import PLAIN, TOKEN, Words

ROOT = os.environ.get("LLM_DIR", "/root/testdata/sf0.01")


def auc(pairs):
    """Chance that a positive outranks a negative, ties counted half."""
    positive, negative = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in positive for n in negative) / (len(positive) * len(negative))


@pytest.fixture(scope="module")
def lexicon():
    return toxicity.Lexicon({"idiot": 4.0, "moron": 4.0}, {"lowei": 3.0})


def clause(lexicon, text):
    return lexicon.matched(text, lexicon.pattern())


def test_grammar_scores_clauses(lexicon):
    plain = clause(lexicon, "an idiot walks")[0]
    assert clause(lexicon, "you are an idiot")[0] > plain > clause(lexicon, "he said: not an idiot")[0]
    assert clause(lexicon, "is not an idiot")[0] < plain and clause(lexicon, "she wrote idiot there")[0] < plain
    assert clause(lexicon, "i will kill you")[0] > 0 and not clause(lexicon, "i kill time. you wait")
    assert clause(lexicon, "loweiung LOWEIheit")[0] == pytest.approx(6.0) and not clause(lexicon, "lowei idiotic smorons")
    assert clause(lexicon, "not one two three four idiot")[0] == plain  # the negation has lapsed
    assert len(clause(lexicon, "idiot. fine. moron; ok")) == 2 and not clause(lexicon, "") and not clause(lexicon, "\n.!?")


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, f"common words {i} " + ("zorgle" if i % 2 else "plain") + " end", "en", i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    away = docs.filter(held_out(F.col("doc_id"))).select("doc_id", "toxic")
    assert toxicity.fitted(docs, away).lexicon.stems == {} and "zorgle" not in toxicity.fitted(docs, away).lexicon.words
    learned = toxicity.fitted(docs, docs.select("doc_id", "toxic"))
    assert "zorgle" in learned.lexicon.words or "zor" in learned.lexicon.stems
    got = {r.doc_id: r.score for r in toxicity.scored(docs, learned).collect()}
    assert all((got[i] >= 0.7) == bool(i % 2) for i in range(400))


def test_chance_words_are_not_learned(spark):
    rnd = np.random.default_rng(2)
    rows = [(" ".join(f"word{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rnd.integers(0, 600, 40)), int(i % 10 == 0)) for i in range(400)]
    lexicon = toxicity.learned(spark.createDataFrame(rows, "text string, toxic int"))
    assert set(lexicon.words) == set(toxicity.INSULTS.split()) and not lexicon.stems


def test_odd_texts_score(spark):
    model = toxicity.Model(toxicity.Lexicon({"idiot": 4.0}, {}), (-3.0, 3.0, 1.0))
    rows = [(1, None, "x"), (2, "", "x"), (3, "you idiot " * 20_000, "x"), (3, "you idiot", "x"), (None, "x" * 100_000, "x")]
    got = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score > 0.7 for r in got if r.doc_id == 3} == {True} and len({r.score for r in got if r.doc_id in (1, 2, None)}) == 1


def test_toxicity_of_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    rows = [r for r in q.score_toxicity(spark, ROOT).collect() if r.held_out and r.doc_id in labels]
    assert auc([(r.score, labels[r.doc_id]) for r in rows]) > 0.75
    assert not any(r.predicted and not labels[r.doc_id] for r in rows)


def loss(text, size=64, vocabulary=()):
    data = np.frombuffer(text.encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]), TOKEN, PLAIN)
    return lm_scoring.pairs(data, words, np.sort(np.array(vocabulary, np.uint64)), size)


def test_losses_are_probabilities():
    size = 48
    codes = np.array([0, 1, 5 * size + 7, 5 * size + 8])
    table = lm_scoring.losses(codes, np.array([3.0, 4.0, 1.0, 9.0]), size).reshape(size, size)
    assert np.allclose(np.exp(-table.astype(np.float64)).sum(1), 1, atol=1e-4)
    assert table[5, 8] < table[5, 7] < table[5, 9]


def test_pairs_begin_anew_in_each_text():
    data = b"Aa bb cc"
    words = Words(np.frombuffer(data, np.uint8), np.array([0, 0, 5, 5, 8]), TOKEN, PLAIN)
    codes = lm_scoring.pairs(np.frombuffer(data, np.uint8), words, np.sort(words.hashes), 64)
    assert (codes // 64 == 63).tolist() == [True, False, True] and len(set(codes % 64)) == 3


def test_language_scores(spark):
    good, other = "the cat sat on the mat", "ZX!! 99 QQ## 77"
    rows = [(i, (good if i % 2 else other) + f" {i}") for i in range(200)] + [(900, None), (901, ""), (902, good), (902, good), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x"))
    got = lm_scoring.scored(docs, docs.filter("doc_id % 2 = 1 and doc_id < 200").select("doc_id"), size=64).collect()
    assert len(got) == len(rows) and {(r.n_tokens, r.difference) for r in got if r.doc_id in (900, 901)} == {(0, None)}
    assert max(r.difference for r in got if r.doc_id is not None and r.doc_id % 2 and r.doc_id < 200) < 0 < min(r.difference for r in got if r.doc_id is not None and r.doc_id % 2 == 0 and r.doc_id < 200)
    assert all(abs(r.target_loss - r.background_loss - r.difference) < 1e-9 for r in got if r.n_tokens)
    alone = lm_scoring.scored(docs, docs.filter("false").select("doc_id"), size=64).collect()
    assert len(alone) == len(rows)


def test_quality_of_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    rows = [r for r in q.score_language(spark, ROOT).collect() if r.held_out and r.doc_id in labels and r.n_tokens]
    assert auc([(-r.difference, labels[r.doc_id]) for r in rows]) > 0.85


def brute_losses(texts, roles, scored, frequent):
    """Mean loss of ``scored`` under both models, by formula from plain counters; ``frequent``: tokens with symbols of their own."""
    from collections import Counter

    size = lm_scoring.VOCABULARY
    every = sorted({w for t in texts for w in t.split()})

    def symbol(word):
        data = np.frombuffer(word.encode(), np.uint8)
        shape = int(lm_scoring.shapes(data, Words(data, np.array([0, len(data)]), TOKEN, PLAIN))[0])
        return lm_scoring.SHAPES + sorted(frequent).index(word) if word in frequent else shape

    of = {w: symbol(w) for w in every} | {None: size - 1}
    rare = [w for w in every if w not in frequent]
    total = [sum(len(t.split()) for t, r in zip(texts, roles) if r == role) for role in (1, 0)]
    out = []
    for role, n in zip((1, 0), total):
        scale = min(total) / n
        gram, lead, word = Counter(), Counter(), Counter()
        classes = Counter()
        for t, r in zip(texts, roles):
            for u, w in zip([None, *t.split()], t.split()):
                if r == role:
                    gram[u, w] += scale
                    lead[u] += scale
                    word[w] += scale
                    classes[of[u], of[w]] += scale
        codes = np.array([a * size + b for a, b in classes])
        base = np.exp(-lm_scoring.losses(codes, np.array([*classes.values()]), size).astype(np.float64))
        pull = lm_scoring.PULL

        def inside(w):
            same = [x for x in rare if of[x] == of[w]]
            return 1.0 if w in frequent else (word[w] + 0.5) / sum(word[x] + 0.5 for x in same)

        def chance(u, w):
            p = base[of[u] * size + of[w]]
            if u is None or u in frequent:
                return p if w in frequent else p * (gram[u, w] + pull * inside(w)) / (classes[of[u], of[w]] + pull)
            return (gram[u, w] + pull * p * inside(w)) / (lead[u] + pull)

        out.append([-np.mean([np.log(chance(u, w)) for u, w in zip([None, *t.split()], t.split())]) for t in scored])
    return out


def test_pairs_of_rare_tokens_count(spark):
    """More tokens than symbols: content words of one shape tell documents apart, as plain counting does."""
    rnd = np.random.default_rng(3)
    side = lambda j: "the " + " ".join(f"w{chr(97 + j)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in rnd.integers(0, 600, 12)) + " the of"
    texts = [side(i % 2) for i in range(300)]
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1][:300]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    wanted = spark.createDataFrame([(i,) for i, t in zip(ids, texts) if t.startswith("the wb")], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.scored(docs, wanted, size=lm_scoring.SHAPES + 3).collect()}
    size, lm_scoring.VOCABULARY = lm_scoring.VOCABULARY, lm_scoring.SHAPES + 3
    try:
        a, b = brute_losses(texts, [int(t.startswith("the wb")) for t in texts], texts[:20], {"the", "of"})
    finally:
        lm_scoring.VOCABULARY = size
    assert np.allclose([got[i].target_loss for i in ids[:20]], a, atol=1e-4) and np.allclose([got[i].background_loss for i in ids[:20]], b, atol=1e-4)
    assert max(got[i].difference for i, t in zip(ids, texts) if t.startswith("the wb")) < 0 < min(got[i].difference for i, t in zip(ids, texts) if t.startswith("the wa"))


def test_only_labelled_rows_are_held_out(spark):
    docs = spark.createDataFrame([(i, "text") for i in range(300)] + [(None, "text")], "doc_id long, text string")
    labels = docs.filter("doc_id < 60")
    rows = lm_scoring.training(docs, labels.filter("doc_id < 30").select("doc_id"), labels).withColumn("away", held_out(F.col("key"))).collect()
    assert len(rows) == 301 and sum(r.away for r in rows) > 50
    for r in rows:
        labelled = r.key is not None and r.key < 60
        assert r.role == (2 if labelled and r.away else int(r.key is not None and r.key < 30))


def clause_scores(lexicon, text, quick):
    """Scores clause by clause: every clause of the text is read, whether or not anything is found in it."""
    out = []
    for clause in toxicity.CLAUSE.findall(text.lower()):
        names, weights = lexicon.classes(clause)
        for transducer in toxicity.GRAMMAR:
            names, weights = transducer.run(names, weights)
        score = sum(math.exp(w) for n, w in zip(names, weights) if n in toxicity.SCORED)
        if score > 0 and quick.search(clause):
            out.append(score)
    return out


def test_clauses_are_scored_as_a_plain_reading_does():
    rnd, lexicon = random.Random(5), toxicity.Lexicon({"idiot": 4.0, "moron": 3.0}, {"lowei": 3.0})
    quick = lexicon.pattern()
    words = ["you", "are", "an", "idiot", "not", "moron", "loweish", "he", "said", '"', "i", "will", "kill", "the", "they", "nice", ".", "!", "?", ";", ":", "\n", ",", "..", "é"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 30, 200]))) for _ in range(400)]
    texts += [t.replace(" .", ".").replace(" !", "!") for t in texts]
    for text in texts:
        assert lexicon.matched(text, quick) == clause_scores(lexicon, text, quick)


def test_very_long_texts_of_short_clauses_take_linear_time():
    lexicon = toxicity.Lexicon({"idiot": 4.0}, {})
    quick, took = lexicon.pattern(), []
    for n in (40_000, 400_000):
        start = time.time()
        found = lexicon.matched("You are an idiot. " * n, quick)
        took.append(time.time() - start)
        assert len(found) == n
    assert took[1] < 40 * max(took[0], 0.05) and took[1] < 60
