"""Operators 2, 3 and 10: token ids in files, token counts, sampled pieces."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_rows import CLASHES, rows_of
from wareproof.llm import pieces, sampling, simple8b, token_counts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50_000) | st.integers(0, 1), max_size=1200))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, dtype=np.uint64)
    packed, offsets = simple8b.encode(ids)
    assert (simple8b.decode(packed, offsets, len(ids)) == ids).all()
    assert len(offsets) == math.ceil(len(ids) / simple8b.BLOCK)
    if len(offsets) > 1:
        assert (simple8b.decode(packed, offsets, len(ids), blocks=slice(1, 2)) == ids[512:1024]).all()


def test_simple8b_packs_small_ids():
    packed, _ = simple8b.encode(np.ones(512, dtype=np.uint64))
    assert len(packed) == math.ceil(512 / 60)


def expected_ids(rows, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]


@pytest.mark.parametrize("which", ["documents", "edges"])
def test_files_hold_the_tokenizers_ids(request, spark, tmp_path, tokenizers_at, which):
    docs = request.getfixturevalue(which)
    simple8b.write_ids(docs, f"{tmp_path}/ids", tokenizers_at("word_bpe_49k.json"), segment_bytes=20_000)
    want = expected_ids([(r.doc_id, r.text) for r in docs.collect()], tokenizers_at("word_bpe_49k.json"))
    got = {}
    for r in simple8b.read_ids(spark, f"{tmp_path}/ids").collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(i for e, i in want if e == d) for d, _ in want}
    digests = simple8b.read_digests(spark, f"{tmp_path}/ids").collect()
    start = 0
    for r in sorted(digests, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(digests, key=lambda r: r.start)] == sorted((d for d, _ in want), key=lambda d: (d is not None, d))
    crc = Counter((d, len(i), zlib.crc32(np.array(i, dtype="<u4").tobytes())) for d, i in want)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in digests) == crc


def test_no_documents_give_no_ids(spark, tmp_path, tokenizers_at, no_rows):
    simple8b.write_ids(no_rows, f"{tmp_path}/ids", tokenizers_at("word_bpe_49k.json"))
    assert simple8b.read_digests(spark, f"{tmp_path}/ids").collect() == []


def test_words_are_remembered_up_to_a_limit(tokenizers_at):
    path = tokenizers_at("word_bpe_49k.json")
    small, large = simple8b.WordEncoder(path, 10), simple8b.WordEncoder(path, 10_000)
    for k in range(5):
        batch = [f"wort{k}{i}.".encode() for i in range(8)] * 2
        assert [x.tolist() for x in small.ids(batch)] == [x.tolist() for x in large.ids(batch)]
        assert len(small.slots) <= 10


def ways(word, vocab):
    """All segmentations of a pre-token as (pieces, score)."""
    if not word:
        return [((), 0.0)]
    out = []
    for end in range(1, min(len(word), vocab.longest) + 1):
        found = vocab.ids.get(word[:end])
        if found is None and end > 1:
            continue
        piece, score = (found, vocab.scores[found]) if found is not None else (-1 - ord(word[0]), vocab.unknown)
        out += [((piece, *rest), score + more) for rest, more in ways(word[end:], vocab)]
    return out


def test_token_counts_are_those_of_the_best_segmentation(tokenizers_at):
    path = tokenizers_at("piece_bpe_32k.model")
    vocab = pieces.vocabulary(path)
    texts = ["the there these", "été ▁ x\n\n  y", "", None, "日本語 thinkable"]
    held, got = token_counts.counts(texts, path)
    for text, n, tokens in zip(texts, held, got, strict=True):
        split = pieces.pretokens(text or "")
        best = [max(ways(w, vocab), key=lambda x: x[1])[0] for w in split]
        size = sum(1 if p >= 0 else len(chr(-1 - p).encode()) for way in best for p in way)
        assert (n, tokens) == (len(split), size)


def test_long_pretokens_count_like_short_ones(monkeypatch, tokenizers_at):
    path = tokenizers_at("piece_bpe_32k.model")
    texts = ["internationalisation " * 3 + "ab" * 30, "é" * 50]
    before = [x.tolist() for x in token_counts.counts(texts, path)]
    monkeypatch.setattr(pieces, "LONG", 3)
    assert [x.tolist() for x in token_counts.counts(texts, path)] == before


def test_token_counts_of_tables(edges, clashing, no_rows, tokenizers_at):
    path = tokenizers_at("piece_bpe_32k.model")
    got = rows_of(token_counts.token_counts(edges, path))
    assert len(got) == edges.count()
    assert {r[0]: r[1:] for r in got}[2] == (0, 0) == {r[0]: r[1:] for r in got}[3]
    assert rows_of(token_counts.token_counts(clashing, path)) == got
    assert rows_of(token_counts.token_counts(edges.repartition(5), path)) == got
    assert rows_of(token_counts.token_counts(no_rows, path)) == []


def test_sampling_follows_the_distribution(tokenizers_at):
    path = tokenizers_at("piece_bpe_32k.model")
    vocab = pieces.vocabulary(path)
    word, n = "there", 20_000
    want = {way: math.exp(score) for way, score in ways(" " + word, vocab)}
    total = sum(want.values())
    ids, lengths = sampling.encode_texts([word] * n, np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), path)
    got = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(lengths)[:-1]))
    for way, p in want.items():
        p /= total
        assert abs(got[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_sampled_pieces_decode_to_the_text(edges, no_rows, tokenizers_at):
    path = tokenizers_at("piece_bpe_32k.model")
    for r in sampling.sampled_pieces(edges, path).collect():
        assert sampling.decode_ids(np.array(r.piece_ids, dtype=np.int64), path) == (r.text or "")
    digests = sampling.sampled_pieces(edges, path, digests=True)
    assert all(r.lossless for r in digests.collect())
    assert rows_of(sampling.sampled_pieces(no_rows, path)) == []


def test_samples_depend_on_rows_and_seed_alone(documents, edges, clashing, tokenizers_at):
    path = tokenizers_at("piece_bpe_32k.model")
    one = rows_of(sampling.sampled_pieces(documents, path).select("doc_id", "piece_ids"))
    assert rows_of(sampling.sampled_pieces(documents.repartition(7), path).select("doc_id", "piece_ids")) == one
    assert rows_of(sampling.sampled_pieces(documents, path, seed=1).select("doc_id", "piece_ids")) != one
    theirs = sampling.sampled_pieces(clashing, path)
    assert theirs.columns == [*(c for c in clashing.columns if c != "piece_ids"), "piece_ids"]
    assert set(CLASHES) <= set(theirs.columns)
    assert rows_of(theirs.select("doc_id", "piece_ids")) == rows_of(sampling.sampled_pieces(edges, path).select("doc_id", "piece_ids"))


def test_long_pretokens_are_sampled_like_short_ones(monkeypatch, tokenizers_at):
    path = tokenizers_at("piece_bpe_32k.model")
    texts, seeds = ["internationalisation and thinkability"] * 20, np.arange(20, dtype=np.uint64)
    before = sampling.encode_texts(texts, seeds, path)[0].tolist()
    monkeypatch.setattr(pieces, "LONG", 3)
    assert sampling.encode_texts(texts, seeds, path)[0].tolist() == before
