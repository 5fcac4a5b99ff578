"""Operator 10: SentencePiece encoding by sampled segmentations, and lossless decoding.

Forward filtering sums, for every prefix of a pre-token, the probability of all its segmentations (raised to
``alpha``); backward sampling then draws the last piece in proportion, steps back by it, and goes on until the
start. Draws come from a counter hashed with a seed made of the document's key: a rerun, another partitioning
or a lost executor gives the same pieces. All pre-tokens of a batch take their steps together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareproof.llm.common import parts, spread_ranges, sums_of
from wareproof.llm.pieces import Lattice, Vocabulary, lattice, pretokens, vocabulary

BATCH_BYTES = 4_000_000
ALPHA = 1.0
STEP = np.uint64(0x9E3779B97F4A7C15)


def _uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from a seed and a counter (the mixing of SplitMix64)."""
    with np.errstate(over="ignore"):
        z = seed + counter.astype(np.uint64) * STEP
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _cumulative(trie: Lattice) -> np.ndarray:
    """For every arc the probability that it or one before it is the last on the way to its node."""
    held = np.diff(trie.first)
    of = np.repeat(np.arange(len(held)), held)
    cumulative = np.cumsum(np.exp(trie.score + trie.value[trie.source] - trie.value[of]))
    cumulative -= np.concatenate(([0.0], cumulative))[trie.first[:-1]][of]
    cumulative[trie.first[1:][held > 0] - 1] = 1.0  # whatever rounding left over
    return cumulative


def _sampled(texts: list[str | None], seeds: np.ndarray, vocab: Vocabulary, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece codes of all texts one after the other, and how many each text has."""
    split = [pretokens(text or "") for text in texts]
    per_text = np.array([len(one) for one in split], dtype=np.int64)
    at, words = pd.factorize(np.array([w for one in split for w in one], dtype=object))
    if not len(words):
        return np.zeros(0, dtype=np.int64), per_text * 0
    scaled = replace(vocab, scores=vocab.scores * alpha, unknown=vocab.unknown * alpha)
    trie = lattice(list(words), scaled, best=False)
    cumulative = _cumulative(trie)
    node = trie.terminal[at]
    seed = np.repeat(seeds, per_text)
    # Each pre-token of a text has a range of counters of its own, as long as it has characters.
    n_chars = np.array([len(w) for w in words], dtype=np.int64)[at]
    ends = np.cumsum(n_chars)
    starts_of_texts = np.concatenate(([0], ends))[np.cumsum(per_text) - per_text]
    counter = ends - n_chars - np.repeat(starts_of_texts, per_text)
    active, step = np.arange(len(node)), 0
    taken_by, taken = [], []
    steps = np.zeros(len(node), dtype=np.int64)
    while len(active):
        here = node[active]
        u = _uniform(seed[active], counter[active] + step + 1)
        arc = trie.first[here]
        behind = np.flatnonzero(cumulative[arc] <= u)
        while len(behind):
            arc[behind] += 1
            behind = behind[cumulative[arc[behind]] <= u[behind]]
        taken_by.append(active)
        taken.append(trie.piece[arc])
        steps[active] += 1
        node[active] = trie.source[arc]
        active, step = active[node[active] > 0], step + 1
    ends = np.cumsum(steps)
    out = np.empty(int(ends[-1]), dtype=np.int64)
    for back, (who, what) in enumerate(zip(taken_by, taken, strict=True)):
        out[ends[who] - 1 - back] = what
    return out, sums_of(steps, per_text)


def _with_bytes(codes: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids in place of codes: a character without a piece becomes the pieces of its bytes."""
    odd = np.flatnonzero(codes < 0)
    if not len(odd):
        return codes, lengths
    spelled = [chr(-1 - int(c)).encode() for c in codes[odd]]
    width = np.ones(len(codes), dtype=np.int64)
    width[odd] = [len(s) for s in spelled]
    ids = np.repeat(codes, width)
    starts = np.cumsum(width) - width
    ids[spread_ranges(starts[odd], width[odd])] = vocab.first_byte + np.frombuffer(b"".join(spelled), dtype=np.uint8).astype(np.int64)
    return ids, sums_of(width, lengths)


def encode_texts(texts: list[str | None], seeds: np.ndarray, model: str, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts one after the other, and how many each text has."""
    vocab = vocabulary(model)
    return _with_bytes(*_sampled(texts, seeds, vocab, alpha), vocab)


def decode_ids(ids: np.ndarray, model: str) -> str:
    """The text of ids: the bytes of the pieces, without the space put in front of every text."""
    pieces = vocabulary(model).as_bytes
    return b"".join([pieces[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


def sampled_pieces(
    docs: DataFrame, model: str, seed: int = 0, alpha: float = ALPHA, doc_id: str = "doc_id", text: str = "text",
    digests: bool = False,
) -> DataFrame:
    """All columns of ``docs`` and ``piece_ids``, a sampled segmentation of the text; with ``digests`` only
    (doc_id, n_pieces, pieces_crc32, n_chars_decoded, lossless).

    The draws depend on ``seed``, the row's ``doc_id`` (null: a fixed stand-in) and the text alone, so
    repeated rows get equal pieces. ``alpha`` sharpens (above 1) or flattens the distribution. A null or
    empty text has no pieces (``piece_ids`` is empty). ``piece_ids`` must not be a column of ``docs``
    already: it is replaced. Batches hold ``BATCH_BYTES`` of text or one long document.
    """
    rest = [] if digests else [c for c in docs.columns if c != "piece_ids"]
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    rows = docs.select(*rest, F.col(doc_id).cast("bigint").alias("__doc_id"), F.col(text).alias("__text"), key.alias("__seed"))
    kinds = {f.name: f for f in rows.schema.fields}
    names = [*rest, "piece_ids"]
    if digests:
        schema = T.StructType.fromDDL("doc_id bigint, n_pieces bigint, pieces_crc32 bigint, n_chars_decoded bigint, lossless boolean")
    else:
        schema = T.StructType([*(kinds[c] for c in rest), T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "__text", BATCH_BYTES):
            texts = batch.column("__text").to_pylist()
            seeds = batch.column("__seed").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ids, lengths = encode_texts(texts, seeds, model, alpha)
            ends = np.cumsum(lengths)
            if not digests:
                offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                column = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), column], names)
                continue
            back = [decode_ids(ids[e - n:e], model) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            sums = [zlib.crc32(ids[e - n:e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("__doc_id"), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                pa.array([len(b) for b in back], pa.int64()),
                pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)]),
            ], schema.names)

    return rows.mapInArrow(run, schema)
