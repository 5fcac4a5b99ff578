"""Operators 1, 4 and 6: languages, personal data, quality."""

import hashlib
import random
import re
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_rows import rows_of
from wareproof.llm import lang_id, pii, quality


# ---- 1 -------------------------------------------------------------------------------------------

def test_languages_of_held_out_documents(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    got = lang_id.language_id(documents).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.lang_pred in set(truth.values()) and 0 <= r.score <= 1
    held_out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held_out) >= 0.97 * len(held_out)


def test_predictions_use_the_text_alone(documents):
    from pyspark.sql import functions as F

    model = lang_id.fit(lang_id.learning_rows(documents))
    before = rows_of(lang_id.predicted(documents.select("text"), model))
    changed = documents.select("text", (-F.col("doc_id")).alias("doc_id"), F.lit("xx").alias("lang"), F.lit(None).alias("source"))
    assert rows_of(lang_id.predicted(changed, model).select("text", "lang_pred", "score")) == before


def test_held_out_rows_are_not_learned_from(documents):
    from pyspark.sql import functions as F

    held_out = lang_id.fold("doc_id") == 0
    spoiled = documents.withColumn("lang", F.when(held_out, F.lit("xx")).otherwise(F.col("lang")))
    assert rows_of(lang_id.language_id(spoiled)) == rows_of(lang_id.language_id(documents))


def test_language_edges(edges, clashing, no_rows):
    got = {(r.doc_id, r.held_out): r for r in lang_id.language_id(edges).collect()}
    by_id = {r.doc_id: r for r in got.values()}
    for doc in (2, 3, 4, 5):
        assert (by_id[doc].lang_pred, by_id[doc].score) == ("und", 0.0)
    assert by_id[6].lang_pred != "und" and not by_id[None].held_out
    assert rows_of(lang_id.language_id(clashing)) == rows_of(lang_id.language_id(edges))
    assert rows_of(lang_id.language_id(no_rows)) == []
    assert all(r.lang_pred == "und" for r in lang_id.language_id(edges.filter("doc_id = 6")).collect()) == (zlib.crc32(b"6") % 5 == 0)


def test_ngrams_by_hand():
    features, held = lang_id.ngrams(["Ab, c", None, "7", "\U00010400b"])
    # " ab c": 3 letters, 4 pairs, 3 triples; " \U00010428b": 2, 2 and 1.
    assert held.tolist() == [10, 0, 0, 5]
    assert (lang_id.ngrams(["ab c"])[0] == features[:10]).all()


def test_ftrl_is_sparse_and_separates():
    draw = np.random.default_rng(0)
    examples = [(np.array([k % 2, 2 + draw.integers(50), lang_id.DIM]), np.array([2.0, 0.01, 1.0]), k % 2) for k in range(400)]
    w = lang_id.ftrl(examples, 2)
    assert w[0, 0] > 0 > w[1, 0] and (w[2:52] == 0).mean() > 0.9


# ---- 4 -------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], list(PLAIN).index(x[2])))


def test_examples_are_made_one_at_a_time():
    """The driver holds the rows of the sample, not an array of features and one of values for each of them."""
    draw, idf, alive = np.random.default_rng(1), np.ones(lang_id.DIM), []
    rows = [(k % 2, np.arange(k, k + 50, dtype="<i4").tobytes(), draw.integers(1, 9, 50).astype("<i4").tobytes()) for k in range(200)]
    examples, held = lang_id.Examples(rows, idf), list(lang_id.Examples(rows, idf))
    assert [lang for _, _, lang in examples] == [lang for lang, _, _ in rows]
    assert all(abs(values[:-1].sum() - 100) < 1e-3 and features[-1] == lang_id.DIM for features, values, _ in examples)
    assert np.array_equal(lang_id.ftrl(examples, 2), lang_id.ftrl(held, 2))
    for features, _, _ in examples:
        alive = [a for a in alive if a() is not None] + [weakref.ref(features)]
    assert len(alive) <= 2


def test_base_spans_are_those_of_the_patterns():
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab1@.-+ 0(%") for _ in range(draw.randint(0, 70))) for _ in range(4000)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "0" * 15 + ".1.2.3", "1.2.3.4.5.6.7.8", "+1 (555) 010-9999."]
    for text in texts:
        assert sorted(pii.base_spans(text)) == sorted(plain_base(text)), text


def test_address_parts_of_many_zeros():
    zeros = "0" * 5000
    for text, ends in ((f"{zeros}.1.2.3", True), (f"1.2.3.{zeros}", True), (f"{zeros}256.1.2.3", False), (f"1.2.3.{zeros}255", True)):
        found = [(s, e) for s, e, kind in pii.base_spans(text) if kind == "ip"]
        assert found == ([(0, len(text))] if ends else [])


def test_further_spans_need_checks_and_words():
    def kinds(text):
        return [k for _, _, k in pii.find_spans(text)[1]]

    assert kinds("konto DE89 3704 0044 0532 0130 00 ok") == ["iban"]
    assert kinds("konto DE88 3704 0044 0532 0130 00 ok") == []
    assert kinds("my ssn is 219-09-9999.") == ["ssn"] and kinds("part 219-09-9999.") == []
    assert kinds("ssn 000-09-9999") == []
    assert kinds("call (415) 555-2671 now") == ["local_phone"] and kinds("sum 415 555-2671 now") == []


def test_personal_data_of_tables(edges, clashing, documents, no_rows):
    for docs in (edges, documents):
        want = Counter()
        for r in docs.collect():
            base = plain_base(r.text or "")
            digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
            want[(r.doc_id, *(sum(k == kind for _, _, k in base) for kind in PLAIN), digest)] += 1
        got = pii.personal_data(docs).collect()
        assert Counter(tuple(r)[:6] for r in got) == want
        for r in got:
            listed = [x for x in r.spans.split(",") if x.split(":")[0] in PLAIN]
            assert hashlib.sha256(",".join(listed).encode()).hexdigest() == r.base_sha256
    assert rows_of(pii.personal_data(clashing)) == rows_of(pii.personal_data(edges))
    assert rows_of(pii.personal_data(no_rows)) == []


# ---- 6 -------------------------------------------------------------------------------------------

def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i:i + 8])].append(i)
    covered = {p for own in places.values() if len(own) > 1 for i in own for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(edges, clashing, documents, no_rows):
    for docs in (edges, documents):
        want = Counter()
        for r in docs.collect():
            n = plain_counts(r.text)
            want[(r.doc_id, *n, n[0] < 20 or 100 * n[4] > 30 * n[0])] += 1
        got = quality.quality(docs).collect()
        assert Counter(tuple(r)[:7] for r in got) == want
        assert not any(r.base_failed and r.kept for r in got)
    assert rows_of(quality.quality(clashing)) == rows_of(quality.quality(edges))
    assert rows_of(quality.quality(no_rows)) == []


def test_buckets_are_close_and_exact_below_128(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("b")).collect()
    assert all(r.b == r.id for r in rows if r.id < 128)
    assert all(r.b <= r.id < r.b + max(1, r.b / 64) + 1e-9 for r in rows)


def test_thresholds_follow_the_source(spark):
    """What is odd in one source is usual in another."""
    rows = [(k, f"{'#' * (k % 3)} " + " ".join(f"w{(k * 31 + i) % 997}" for i in range(60)), "en", "prose") for k in range(200)]
    rows += [(1000 + k, " ".join(f"#w{(k * 17 + i) % 997}#$" for i in range(60)), "en", "code") for k in range(200)]
    rows += [(5000, " ".join(f"#v{i}#$" for i in range(60)), "en", "prose")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert got.pop(5000) is False and all(got.values())


def test_sketches_merge(documents):
    from pyspark.sql import functions as F

    counted = quality.signals(documents, "doc_id", "text", "lang", "source")
    whole = quality.sketches(counted)
    halves = quality.sketches(counted.filter("doc_id % 2 = 0")).union(quality.sketches(counted.filter("doc_id % 2 = 1")))
    merged = halves.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert rows_of(merged) == rows_of(whole)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9])
def test_repeats_need_whole_windows(n):
    texts = [b" ".join([b"a"] * n), b"b"]
    assert quality.counts(texts)[4].tolist() == [n if n > 8 else 0, 0]


def test_every_measure_rejects_what_the_base_rule_keeps(spark):
    """Documents that are odd in one measure in a source of plain ones."""
    draw = random.Random(5)

    def plain(n=100):
        return [f"{draw.choice(['ab', 'abc', 'abcd', 'abcde'])}{draw.randrange(1000):03d}"[:6] + chr(97 + draw.randrange(26)) for _ in range(n)]

    rows = [(i, " ".join(plain(60)) + "\n" + " ".join(plain(60)), "en", "a") for i in range(80)]
    run = plain(12)
    odd = {
        1000: " ".join(w * 4 for w in plain()),  # long words
        1001: " ".join(w + "###" if k % 4 == 0 else w for k, w in enumerate(plain())),  # symbols
        1002: "\n".join(x for k in range(12) for x in (" ".join(plain(5)), "zeile")),  # one line again and again
        1003: " ".join([*plain(40), *run, *plain(40), *run]),  # a run of words twice: 23 percent
    }
    rows += [(i, t, "en", "a") for i, t in odd.items()]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not any(got[i].base_failed for i in odd)
    assert {i for i in odd if not got[i].kept} == set(odd)
    assert sum(got[i].kept for i in range(80)) >= 78


# ---- 1: the fit; 4: long texts --------------------------------------------------------------------

def test_every_language_is_learned(spark):
    """More languages than any list holds, each with a letter pair of its own."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    langs = [f"l{k:03d}" for k in range(201)]
    rows = [(k * 10 + i, " ".join([letters[k // 15] * 2 + letters[k % 15 + 5] * 3] * 6), langs[k]) for k in range(201) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = lang_id.fit(lang_id.learning_rows(docs))
    assert model.langs == langs
    got = lang_id.predicted(docs, model).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.9 * len(got)


def test_no_labelled_rows_keep_documents_with_letters(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "ab", None), (2, "12", None), (3, None, None), (4, "é", None)], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 4]


def plain_ftrl(examples, n_langs, passes):
    """Coordinate by coordinate."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f, k):
        if abs(z[f, k]) <= lang_id.L1:
            return 0.0
        return -(z[f, k] - np.sign(z[f, k]) * lang_id.L1) / ((lang_id.BETA + np.sqrt(n[f, k])) / lang_id.ALPHA + lang_id.L2)

    for _ in range(passes):
        for features, values, lang in examples:
            own = {(f, k): weight(f, k) for f in features for k in range(n_langs)}
            logits = [sum(v * own[f, k] for f, v in zip(features, values)) for k in range(n_langs)]
            e = np.exp(np.array(logits) - max(logits))
            p = e / e.sum()
            for f, v in zip(features, values):
                for k in range(n_langs):
                    g = v * (p[k] - (k == lang))
                    sigma = (np.sqrt(n[f, k] + g * g) - np.sqrt(n[f, k])) / lang_id.ALPHA
                    z[f, k] += g - sigma * own[f, k]
                    n[f, k] += g * g
    return weight


def test_ftrl_against_a_plain_version():
    draw = np.random.default_rng(7)
    examples = []
    for _ in range(60):
        features = draw.choice(30, size=6, replace=False)
        examples.append((np.append(features, lang_id.DIM), np.append(draw.random(6) * 2, 1.0), int(draw.integers(3))))
    w, weight = lang_id.ftrl(examples, 3, passes=2), plain_ftrl(examples, 3, 2)
    for f in [*range(30), lang_id.DIM]:
        for k in range(3):
            assert abs(w[f, k] - weight(f, k)) < 1e-3


def test_temperature_against_a_grid():
    draw = np.random.default_rng(8)
    langs = draw.integers(4, size=500)
    logits = draw.normal(size=(500, 4)) * 6
    logits[np.arange(500), langs] += 5
    n = len(langs)
    target = np.full((n, 4), 1 / (n + 4))
    target[np.arange(n), langs] = (n + 1) / (n + 4)

    def loss(t):
        x = logits / t
        return -(target * (x - np.log(np.exp(x).sum(axis=1, keepdims=True)))).sum(axis=1).mean()

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 4000))
    assert abs(np.log(lang_id.best_temperature(logits, langs) / min(grid, key=loss))) < 0.01


def test_further_spans_against_all_pairs(monkeypatch):
    draw = random.Random(11)
    parts = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "123-45-6789", "(555) 234-5678", "555-234-5678", "+49 30 1234567 call", "ssn", "iban", "phone", "4111 1111 1111 1111", "a@b.de", "x"]
    for _ in range(300):
        text = "".join(draw.choice(parts) + draw.choice([" ", "", "-", ", "]) for _ in range(draw.randrange(1, 40)))
        base = pii.base_spans(text)
        want = []
        for kind, pattern in (("iban", pii.IBAN), ("ssn", pii.SSN), ("local_phone", pii.LOCAL_PHONE)):
            for m in pattern.finditer(text):
                if not pii._confirmed(kind, m[0]):
                    continue
                around = text[max(0, m.start() - pii.WINDOW):m.start()] + "\n" + text[m.end():m.end() + pii.WINDOW]
                score = pii.CHECKED[kind] + pii.NEAR * bool(pii.CONTEXT[kind].search(around))
                if score >= pii.THRESHOLD and all(m.end() <= s or e <= m.start() for s, e, _ in base + want):
                    want.append((m.start(), m.end(), kind))
        assert pii.more_spans(text, base) == want


def test_long_texts_of_numbers_take_linear_time():
    import time

    text = "call phone 555-234-5678, mail a.b@c-d.org or ssn 123-45-6789, 10.0.0.1; " * 28_000  # 2 MB
    start = time.process_time()
    base, more = pii.find_spans(text)
    assert time.process_time() - start < 5
    assert len(base) == 2 * 28_000 and len(more) >= 28_000
