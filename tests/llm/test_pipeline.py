"""The stages of the corpus pipeline, each on the input it gets, and the registered queries."""

import re
from collections import Counter

import numpy as np
import pytest
from llm_rows import rows_of
from pyspark.sql import functions as F
from test_joins import plain_components, plain_without_repeats

import __spark_entry__
import corpus_pipeline
from wareproof.llm import lang_id, sampling
from wareproof.llm.common import written


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def check_stages(spark, docs, tokenizers_at):
    columns = docs.columns
    first = written(corpus_pipeline.language_id(spark, docs, ""), "t1")
    predicted = lang_id.predicted(docs, lang_id.fit(lang_id.learning_rows(docs)), names=("p", "q"))
    want = predicted.filter("p != 'und' AND q >= 0.5").select(*columns)
    assert rows_of(first) == rows_of(want) and first.columns == columns

    second = written(corpus_pipeline.line_dedup(spark, first, ""), "t2")
    texts = plain_without_repeats([(r.doc_id, r.text) for r in first.collect()], 50)
    want = Counter()
    for r in first.collect():
        text, n, gone = texts[(r.doc_id, r.text)]
        if not gone or gone < n:
            want[(r.doc_id, text, r.source, len(text) if gone else r.n_chars)] += 1
    assert Counter((r.doc_id, r.text, r.source, r.n_chars) for r in second.collect()) == want and second.columns == columns

    third = written(corpus_pipeline.near_dedup(spark, second, ""), "t3")
    kept = {d for d, _, _, own in plain_components([(r.doc_id, r.text) for r in second.collect()]) if own}
    assert rows_of(third) == sorted((tuple(r) for r in second.collect() if r.doc_id in kept), key=repr) and third.columns == columns

    fourth = written(corpus_pipeline.source_mixing(spark, third, ""), "t4")
    times, there = Counter(map(tuple, fourth.collect())), Counter(map(tuple, third.collect()))
    assert set(times) <= set(there) and all(n <= 2 * there[r] for r, n in times.items()) and fourth.columns == columns

    path = tokenizers_at("piece_bpe_32k.model")
    fifth = corpus_pipeline.sentencepiece(spark, fourth, "")
    for r in fifth.collect():
        assert sampling.decode_ids(np.array(r.piece_ids, dtype=np.int64), path) == (r.text or "")
    assert rows_of(fifth.drop("piece_ids")) == rows_of(fourth)
    return [df.count() for df in (first, second, third, fourth)]


def test_stages_over_documents(spark, documents, tokenizers_at):
    assert all(n > 0 for n in check_stages(spark, documents, tokenizers_at))


def test_stages_over_edges(spark, edges, clashing, no_rows, tokenizers_at):
    check_stages(spark, edges, tokenizers_at)
    docs, plain = clashing, edges
    for name, stage in corpus_pipeline.STAGES:
        docs, plain = written(stage(spark, docs, ""), name), written(stage(spark, plain, ""), name)
        own = [c for c in edges.columns]
        assert rows_of(docs.select(own)) == rows_of(plain.select(own))
    docs = no_rows
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_a_clean_text_stays_whose_id_has_a_near_copy_too(spark):
    one, other = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(80))
    rows = [(1, one), (2, one + " ende"), (2, other), (3, one), (None, one)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert rows_of(got) == sorted([(1, one), (2, other), (None, one)], key=repr)


def test_mixing_moves_the_shares_to_the_targets(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", ("a", "b", "c")[min(i % 5, 2)], 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.source: r["count"] for r in corpus_pipeline.source_mixing(spark, docs, "").groupBy("source").count().collect()}
    # a and b stop at twice their 400, or get 3 and 1 sixths of 3000; c gets the rest.
    assert abs(got["a"] - 800) < 40 and abs(got["a"] + got["b"] + got["c"] - 3000) < 100


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6, 10])
def test_queries_give_a_row_for_every_document(spark, documents, k):
    name = next(n for n in __spark_entry__.queries() if n.startswith(f"op{k}_"))
    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert got.count() == documents.count() and got.select(F.countDistinct("doc_id")).first()[0] == documents.count()
    assert re.match("op", name)
