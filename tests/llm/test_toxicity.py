"""Operator 12: matching against plain search, learning by held-out accuracy."""

import random
from collections import Counter

import numpy as np
from llm_rows import edge_rows
from wareproof.llm import toxicity
from wareproof.llm.toxicity import Lexicon, words_of


def test_folding():
    assert words_of("An 1D10T! idіоt ＩＤＩＯＴ $cum, p@thetic!! a1 2024 x") == [
        "an", "idiot", "idiot", "idiot", "scum", "pathetic", "ai", "x"]
    assert words_of(None) == words_of("") == words_of(" 12 ... !") == []
    assert words_of("über Straße été") == ["über", "straße", "été"]


def plain(entries, exceptions, words):
    """The same finds word by word."""
    hidden = set()
    for phrase in exceptions:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i:i + len(parts)] == parts:
                hidden |= set(range(i, i + len(parts)))
    out, at = [], 0
    for i, w in enumerate(words):
        own = [e for e in entries if (w == e.strip() if e.endswith(" ") else w.startswith(e.strip()))]
        if own and i not in hidden:
            out.append((at, max((entries[e], e) for e in own)[1]))
        at += len(w) + 1
    return out


def test_matches_against_plain_search():
    draw = random.Random(3)
    for _ in range(300):
        entries = {" " + "".join(draw.choices("ab", k=draw.randrange(1, 4))) + draw.choice(["", " "]): draw.random() for _ in range(5)}
        exceptions = [" ".join("".join(draw.choices("ab", k=draw.randrange(1, 3))) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(3))]
        words = ["".join(draw.choices("ab", k=draw.randrange(1, 5))) for _ in range(draw.randrange(30))]
        assert Lexicon(entries, exceptions).matches(words) == plain(entries, exceptions, words)


def test_exceptions_hide_only_what_is_inside():
    lexicon = Lexicon({" trash ": 2.0, " clown ": 1.0}, ["trash can", "clown fish tank"])
    assert [k for _, k in lexicon.matches("the trash can is trash".split())] == [" trash "]
    assert [k for _, k in lexicon.matches("clown fish clown fish tank trash".split())] == [" clown ", " trash "]


def test_measures_are_normalised_by_length():
    weights = {" bad ": 3.0}
    short, long = (toxicity.measures(n, Counter({" bad ": 1}), weights) for n in (10, 1000))
    assert short[0] == long[0] and short[1] > long[1] and short[2] > long[2]
    assert toxicity.measures(0, Counter(), weights) == [0.0] * 4


def corpus(spark, n=1500, seed=4):
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = draw.random() < 0.2
        words = [draw.choice(["wind", "river", "stone", "cloud", "meadow"]) for _ in range(draw.randrange(5, 60))]
        if toxic:
            for _ in range(1 + len(words) // 20):
                words.insert(draw.randrange(len(words)), draw.choice(["trash", "z0rk", "zorkish", "zorkling", "grubb"]))
        elif draw.random() < 0.06:
            words.insert(draw.randrange(len(words)), "trash can")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_learned_on_one_part_and_tested_on_the_other(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(toxicity.learning_rows(docs, labels))
    assert any(e.startswith(" zor") for e in model.weights)
    assert "trash can" in model.exceptions
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.98
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_given_table(spark):
    at = "/root/testdata/sf0.01/"
    docs, labels = (spark.read.parquet(f"{at}{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    got = got[got.held_out]
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 3
    assert (got[got.toxic == 1].predicted == 1).mean() > 0.6


def test_labels_of_held_out_rows_are_not_used(spark):
    from pyspark.sql import functions as F

    docs, labels = corpus(spark, 400)
    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity(docs, of).orderBy("doc_id").toPandas() for of in (labels, turned))
    assert a.equals(b) and a.held_out.any()


def test_edges(spark, edges, clashing, no_rows):
    ids = sorted({r[0] for r in edge_rows() if r[0] is not None})
    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None) for i in ids] + [(1, 1), (None, 1), (None, None)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(edges, labels).orderBy("doc_id", "score").toPandas()
    assert len(got) == len(edge_rows()) and got.score.between(0, 1).all() and not got.held_out[got.doc_id.isna()].any()
    extra = toxicity.toxicity(clashing, labels.selectExpr("*", "'theirs' AS text", "'theirs' AS score")).orderBy("doc_id", "score").toPandas()
    assert got.equals(extra)
    assert toxicity.toxicity(no_rows, labels).collect() == []
    unlabelled = toxicity.toxicity(edges, labels.filter("toxic > 5")).toPandas()
    assert (unlabelled.score < 1e-6).all() and (unlabelled.predicted == 0).all()
    all_toxic = toxicity.toxicity(edges, labels.filter("toxic = 1")).toPandas()
    assert all_toxic.score.nunique() == 1


def test_long_text_in_linear_time():
    words = words_of("z0rk " * 300_000 + "x" * 500_000)
    assert len(words) == 300_001
    found = Lexicon({" zork ": 1.0, " zo": 0.5}, ["zork x"]).matches(words)
    assert len(found) == 300_000 and {k for _, k in found} == {" zork "}


def test_curve_is_the_penalised_optimum():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 3))
    y = (x @ [1.5, -1.0, 0.0] + draw.logistic(size=400) > 0).astype(float)
    w, b = toxicity.logistic(x, y, ridge=1e-6)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y)).max() < 1e-3 and abs((p - y).sum()) < 1e-3
