"""Operator 1: language identification.

Sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams, trained with
follow-the-regularised-leader (McMahan and others, 2013) under an elastic-net penalty, then calibrated by a temperature.

Document frequencies are counted over all learning rows, in tasks, with the sums of a partition shuffled. The
classifier is fitted on the driver to a sample of about ``TRAIN_ROWS`` of them, equally many per language as far
as there are, and about ``LEAST_ROWS`` of every language at least; a fifth of the sample is held back for the temperature. Every language is
learned; most weights are zero and only the others are kept. Prediction reads whole texts and only sums
weights: the term frequency is the n-gram's share of the text's n-grams, so a text needs no table of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareproof.llm.common import parts, written

BITS = 16
DIM = 1 << BITS
SIZES = (1, 2, 3)
TRAIN_ROWS = 4000
LEAST_ROWS = 20
PASSES = 2
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.05, 0.01
BATCH_BYTES = 2_000_000
UNKNOWN = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_FINAL = np.uint64(0xD6E8FEB86659FD93)


# ---- n-grams -------------------------------------------------------------------------------------

def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts one after the other, and how many each has. Letters are lowered; a word has a space
    in front, and everything that is no letter is dropped."""
    joined = "".join("\n" + (t or "").lower() for t in texts)
    lengths = np.array([1 + len((t or "").lower()) for t in texts], dtype=np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _LETTER[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    letter[high] = [chr(c).isalpha() for c in codes[high].tolist()]
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    kept = np.flatnonzero(keep)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[kept]
    codes = np.where(letter[kept], codes[kept], 32).astype(np.uint64)
    features, docs = [], []
    with np.errstate(over="ignore"):
        for size in SIZES:
            n = len(codes) - size + 1
            if n <= 0:
                continue
            value = codes[:n] * np.uint64(_FACTORS[0]) + np.uint64(size)
            for k in range(1, size):
                value += codes[k:k + n] * np.uint64(_FACTORS[k])
            value = ((value ^ (value >> np.uint64(31))) * _FINAL) >> np.uint64(64 - BITS)
            inside = doc[:n] == doc[size - 1:]
            if size == 1:
                inside &= codes != 32
            features.append(value[inside].astype(np.int32))
            docs.append(doc[:n][inside])
    if not features:
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    docs = np.concatenate(docs)
    order = np.argsort(docs, kind="stable")  # the sizes of a text together
    return np.concatenate(features)[order], np.bincount(docs, minlength=len(texts))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: in how many documents a feature occurs, and documents per language."""
    total, langs = np.zeros(DIM, dtype=np.int64), {}
    for batch in parts(batches, "text", BATCH_BYTES):
        features, held = ngrams(batch.column("text").to_pylist())
        start = 0
        for lang, n in zip(batch.column("lang").to_pylist(), held.tolist(), strict=True):
            if n:
                seen = np.zeros(DIM, dtype=bool)
                seen[features[start:start + n]] = True
                total += seen
                langs[lang] = langs.get(lang, 0) + 1
            start += n
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([
        pa.array([*used.tolist(), *[-1] * len(langs)], pa.int32()), pa.array([*[None] * len(used), *langs], pa.string()),
        pa.array([*total[used].tolist(), *langs.values()], pa.int64()),
    ], ["feature", "lang", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text", BATCH_BYTES):
        features, held = ngrams(batch.column("text").to_pylist())
        found = [np.unique(one, return_counts=True) for one in np.split(features, np.cumsum(held)[:-1])]
        yield pa.RecordBatch.from_arrays([
            batch.column("lang"), batch.column("h"), pa.array([x.astype("<i4").tobytes() for x, _ in found], pa.binary()),
            pa.array([n.astype("<i4").tobytes() for _, n in found], pa.binary()),
        ], ["lang", "h", "features", "counts"])


# ---- the model -----------------------------------------------------------------------------------

@dataclass
class Model:
    """``weights``: per language the features whose weight is not zero and their weights, with the inverse document frequencies in them;
    ``bias`` per language."""

    langs: list[str]
    weights: list[tuple[np.ndarray, np.ndarray]]
    bias: np.ndarray
    temperature: float

    def column(self, lang: int) -> np.ndarray:
        """The weights of all features for one language."""
        out = np.zeros(DIM, dtype=np.float32)
        features, values = self.weights[lang]
        out[features] = values
        return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _proximal(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the regularised leader: zero where the sum of gradients is within the L1 penalty."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


class Examples:
    """(features, values, language) of (language, features, counts) rows. Each is made when it is its turn, so that the driver only holds the rows."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], idf: np.ndarray) -> None:
        self.rows, self.idf = rows, idf

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for lang, features, counts in self.rows:
            features, counts = np.frombuffer(features, dtype="<i4"), np.frombuffer(counts, dtype="<i4")
            values = (100 / counts.sum() * counts * self.idf[features]).astype(np.float32)
            yield np.append(features, np.int32(DIM)), np.append(values, np.float32(1)), lang


def ftrl(examples: Iterable[tuple[np.ndarray, np.ndarray, int]], n_langs: int, passes: int = PASSES) -> np.ndarray:
    """Weights, DIM + 1 x languages (the last row is the bias), from (features, values, language) examples."""
    z, n = np.zeros((DIM + 1, n_langs), dtype=np.float32), np.zeros((DIM + 1, n_langs), dtype=np.float32)
    for _ in range(passes):
        for features, values, lang in examples:
            w = _proximal(z[features], n[features])
            error = _softmax(values @ w)
            error[lang] -= 1
            g = values[:, None] * error
            sigma = (np.sqrt(n[features] + g**2) - np.sqrt(n[features])) / ALPHA
            z[features] += g - sigma * w
            n[features] += g**2
    return _proximal(z, n)


def best_temperature(logits: np.ndarray, langs: np.ndarray) -> float:
    """The temperature of the least log-loss, by golden section over its logarithm. As in Platt's scaling, the target is
    a little less than certain, so that rows without an error do not ask for infinite confidence."""
    n, n_langs = logits.shape
    if not n or n_langs < 2:
        return 1.0
    target = np.full((n, n_langs), 1 / (n + n_langs))
    target[np.arange(n), langs] = (n + 1) / (n + n_langs)

    def loss(t: float) -> float:
        return -(target * np.log(np.maximum(_softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(learning: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model from (text, lang, h); ``h`` is a hash that picks the sample. None if nothing can be learned.

    To the driver come a count per feature and language, and the sample: about ``train_rows`` rows, or ``LEAST_ROWS`` per language where these are more, never
    more than twice as many, with at most DIM features each. The fit holds 8 bytes per feature and language.
    """
    counted = learning.mapInArrow(_document_counts, "feature int, lang string, n bigint")
    counted = written(counted.groupBy("feature", "lang").agg(F.sum("n").alias("n")), "document-counts")
    langs = {r.lang: r.n for r in counted.filter("feature < 0").collect()}
    if not langs:
        return None
    names = sorted(langs)
    table = counted.filter("feature >= 0").select("feature", "n").toArrow()
    frequency = np.zeros(DIM)
    frequency[table.column("feature").to_numpy()] = table.column("n").to_numpy()
    idf = np.log((1 + sum(langs.values())) / (1 + frequency)) + 1
    each = max(train_rows / len(names), LEAST_ROWS)
    share = F.element_at(F.create_map(*(F.lit(x) for n in names for x in (n, each / langs[n]))), F.col("lang"))
    drawn = learning.filter(F.col("lang").isin(names)).filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    # Features are made where the texts are; only they travel.
    found = drawn.mapInArrow(_examples, "lang string, h bigint, features binary, counts binary")
    table = found.orderBy("h", "lang").limit(int(2 * each * len(names))).toArrow()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("h", "lang", "features", "counts")), strict=True))
    del table
    rows = [(names.index(lang), features, counts) for _, lang, features, counts in rows if features]
    spare = rows[::5] if len(rows) >= 5 * len(names) else []
    w = ftrl(Examples([x for i, x in enumerate(rows) if not spare or i % 5], idf), len(names))
    logits = np.array([values @ w[features] for features, values, _ in Examples(spare, idf)]).reshape(-1, len(names))
    temperature = best_temperature(logits, np.array([lang for lang, _, _ in spare], dtype=np.int64))
    kept = []
    for column in w[:DIM].T:
        features = np.flatnonzero(column).astype(np.int32)
        kept.append((features, (column[features] * idf[features] * 100).astype(np.float32)))
    return Model(names, kept, w[DIM], temperature)


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    """Languages and calibrated probabilities of whole texts; without letters UNKNOWN and 0."""
    features, held = ngrams(texts)
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    some = np.flatnonzero(held)
    if model is None or not len(some):
        return langs, scores
    starts = (np.cumsum(held) - held)[some]
    sums = np.stack([np.add.reduceat(model.column(k)[features], starts, dtype=np.float64) for k in range(len(model.langs))], axis=1)
    p = _softmax((sums / held[some, None] + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    for i, lang in zip(some.tolist(), best.tolist(), strict=True):
        langs[i] = model.langs[lang]
    scores[some] = p[np.arange(len(some)), best]
    return langs, scores


# ---- over tables ---------------------------------------------------------------------------------

def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def learning_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(text, lang, h) of the rows to learn from: those with a language and a text whose fold is not 0."""
    rows = docs.filter((fold(doc_id) != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(doc_id, text).alias("h"))


def predicted(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score in columns ``names``, in place of any of these names."""
    columns = [c for c in docs.columns if c not in names]
    fields = docs.select(*columns).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages at most, most of it zero and left out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text, BATCH_BYTES):
            langs, scores = predict(batch.column(text).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(langs, pa.string()), pa.array(scores)], [*columns, *names])

    return docs.select(*columns).mapInArrow(run, fields.add(names[0], "string").add(names[1], "double"))


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Learned from the rows of other folds than 0; predicted from the text alone. A null text, or one without a letter, is
    ``und`` with score 0, and so is every text if there is nothing to learn from. A null id is not held out and not
    learned from; rows that share an id are predicted each by its text; other columns are ignored; an empty table
    gives no rows. Equal probabilities go to the language that is first in code-point order.
    """
    model = fit(learning_rows(docs, doc_id, text, lang), train_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(doc_id) == 0, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return predicted(rows, model).select("doc_id", "held_out", "lang_pred", "score")
