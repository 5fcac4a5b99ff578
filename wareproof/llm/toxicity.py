"""Operator 12: toxicity by a weighted lexicon.

Texts are folded first: compatibility forms, small letters, look-alike letters of other scripts, digits and signs that stand for letters
inside a word. An entry of the lexicon is a word or the beginning of words, with a weight; an Aho-Corasick automaton finds all entries
and all exception phrases of a text in one pass. Of the entries that match at one word the heaviest counts, and none counts inside an exception
phrase. Every further find of the same entry adds less, sums are normalised by the length of the text, and a logistic
curve makes them a score.

Entries, exceptions and curve are learned from labelled rows: beginnings and words are counted by label over a bounded sample, in tasks
and summed by a shuffle. Weights are log odds; a learning row is scored with weights that leave it out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareproof.llm.common import parts, written

#: Rows of each label that are learned from, the first by a hash of their id.
TRAIN_ROWS = 12_000
#: Entries and exception phrases that a learned lexicon holds at most, the surest first.
MAX_ENTRIES = 20_000
#: Letters of a beginning: the shortest, the longest.
SHORTEST, LONGEST = 3, 8
#: An entry stands in so many toxic rows at least, and its log odds are above the first and above the second times their own error.
LEAST_ROWS, LEAST_ODDS, LEAST_SIGMAS = 3, 1.5, 2.5
#: An exception phrase stands in so many rows that are not toxic, and in toxic ones so many times less.
EXCEPTION_ROWS, EXCEPTION_TIMES = 5, 4
PREDICTED = 0.7
BATCH_BYTES = 2_000_000

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i",
    "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ɡ": "g", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ӏ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_FOLDED = str.maketrans(LOOK_ALIKES)
_SUBSTITUTED = str.maketrans(SUBSTITUTES)
_TOKEN = re.compile(r"[\w@$!]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The folded words of a text: runs of letters, in which digits and signs that stand for letters count as these. Signs at the end of a
    token are punctuation."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLDED)
    out = []
    for token in _TOKEN.findall(text):
        if token.isalpha():
            out.append(token)
            continue
        token = token.strip("!")
        if any(c.isalpha() for c in token):
            token = token.translate(_SUBSTITUTED)
        out += _LETTERS.findall(token)
    return out


def patterns_of(word: str) -> list[str]:
    """The entries a word can match: its beginnings and, between spaces, the word itself."""
    return [" " + word[:k] for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)] + [f" {word} "]


# ---- matching ------------------------------------------------------------------------------------

class Lexicon:
    """Entries with their weights and exception phrases, as one automaton over the folded words between spaces.

    An entry ``" abc"`` matches words that begin so, ``" abc "`` the word. An exception is a phrase of whole words; words
    inside one found in the text match nothing.
    """

    def __init__(self, entries: dict[str, float], exceptions: list[str] = ()):
        import ahocorasick

        self.entries, self.exceptions = dict(entries), [" ".join(words_of(e)) for e in exceptions]
        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, list] = {}
        for entry, weight in self.entries.items():
            kinds.setdefault(entry, [len(entry), None, False])[1] = weight
        for phrase in self.exceptions:
            if phrase:
                kinds.setdefault(f" {phrase} ", [len(phrase) + 2, None, False])[2] = True
        for key, (length, weight, exception) in kinds.items():
            self.automaton.add_word(key, (key, length, weight, exception))
        self.filled = bool(kinds)
        if self.filled:
            self.automaton.make_automaton()

    def matches(self, words: list[str]) -> list[tuple[int, str]]:
        """(start of the word in the joined words, entry) of all finds outside exceptions."""
        if not self.filled or not words:
            return []
        best: dict[int, tuple[float, str]] = {}
        spans = []
        for end, (key, length, weight, exception) in self.automaton.iter(" " + " ".join(words) + " "):
            start = end - length + 1
            if weight is not None and (start not in best or (weight, key) > best[start]):
                best[start] = (weight, key)
            if exception:
                spans.append((start, end))
        if spans:  # by end; a span hides the words that begin before its last space
            starts = sorted(best)
            hidden, at = set(), 0
            for first, last in _merged(spans):
                while at < len(starts) and starts[at] < first:
                    at += 1
                while at < len(starts) and starts[at] < last:
                    hidden.add(starts[at])
                    at += 1
            best = {start: found for start, found in best.items() if start not in hidden}
        return [(start, key) for start, (_, key) in sorted(best.items())]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; spans that only share a space stay apart."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def measures(n_words: int, found: Counter, weights: dict[str, float]) -> list[float]:
    """What the curve sees of a text: the sum of its finds, as it is and by the length, and the heaviest entry."""
    n = max(n_words, 1)
    parts_of = [weights[e] * (1 + np.log(k)) for e, k in found.items() if weights[e] > 0]
    total = float(sum(parts_of))
    return [np.log1p(total), total / np.sqrt(n), 10 * total / n, max((weights[e] for e in found), default=0.0)]


# ---- learning ------------------------------------------------------------------------------------

@dataclass
class Model:
    """A lexicon with its curve: ``bias`` and a weight per measure."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))
    bias: float = -20.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.curve, -40, 40)))


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def learning_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(text, toxic) of at most ``train_rows`` labelled ids of each label whose fold is not 1: the first by a hash of the id."""
    known = labels.select(F.col(doc_id).alias("__id"), (F.col(toxic) == 1).alias("toxic")).filter((fold("__id") != 1) & F.col("toxic").isNotNull())
    known = known.groupBy("__id").agg(F.max("toxic").alias("toxic"))
    first = [known.filter(F.col("toxic") == F.lit(v)).orderBy(F.xxhash64("__id"), "__id").limit(train_rows) for v in (True, False)]
    drawn = written(first[0].unionByName(first[1]), "drawn")  # 2 * train_rows short rows at most, so every task can hold it
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text"))
    return rows.join(F.broadcast(drawn), "__id").select("text", "toxic")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct entries that every row can match, a list per row."""
    for batch in parts(batches, "text", BATCH_BYTES):
        found = [sorted({p for w in set(words_of(t)) for p in patterns_of(w)}) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["toxic", "found"])


def _odds(n1: Column, n0: Column, all1: float, all0: float) -> Column:
    return F.log((n1 + 0.5) / (all1 + 1)) - F.log((n0 + 0.5) / (all0 + 1))


def _weight(n1: np.ndarray, n0: np.ndarray, all1: int, all0: int) -> np.ndarray:
    """Log odds less their own error: what can be relied on."""
    n1, n0 = np.maximum(n1, 0) + 0.5, np.maximum(n0, 0) + 0.5
    return np.log(n1 / (all1 + 1)) - np.log(n0 / (all0 + 1)) - np.sqrt(1 / n1 + 1 / n0)


def _entries(counted: DataFrame, all1: int, all0: int, max_entries: int) -> dict[str, tuple[int, int]]:
    """Rows (toxic, other) of the entries. A longer beginning is left out where a shorter entry says as much."""
    n1, n0 = F.col("n1"), F.col("n0")
    odds, error = _odds(n1, n0, all1, all0), F.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    sure = counted.filter((n1 >= LEAST_ROWS) & (odds > LEAST_ODDS) & (odds > LEAST_SIGMAS * error))
    rows = sure.orderBy((odds / error).desc(), "pattern").limit(max_entries).collect()
    kept: dict[str, tuple[int, int]] = {}
    value = {r.pattern: float(_weight(np.array([r.n1]), np.array([r.n0]), all1, all0)[0]) for r in rows}
    for r in sorted(rows, key=lambda r: (len(r.pattern), r.pattern)):
        stem = r.pattern.rstrip()
        shorter = [stem[:k] for k in range(SHORTEST + 1, len(stem) + (stem != r.pattern))]
        if not any(s in kept and value[s] >= value[r.pattern] for s in shorter):
            kept[r.pattern] = (r.n1, r.n0)
    return kept


def _finds(lexicon: Lexicon):
    """Of learning rows: words, finds by entry, and phrases of a find with the word before or after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", BATCH_BYTES):
            n, entries, times, phrases = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                matches = lexicon.matches(words)
                found = Counter(key for _, key in matches)
                n.append(len(words))
                entries.append(list(found))
                times.append(list(found.values()))
                phrases.append(sorted(_phrases(words, {start for start, _ in matches})) if matches else [])
            yield pa.RecordBatch.from_arrays([
                batch.column("toxic"), pa.array(n, pa.int64()), pa.array(entries, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64())),
                pa.array(phrases, pa.list_(pa.string()))], ["toxic", "n_words", "entries", "times", "phrases"])
    return run


FINDS = "toxic boolean, n_words bigint, entries array<string>, times array<bigint>, phrases array<string>"


def _phrases(words: list[str], starts: set[int]) -> set[str]:
    out, at = set(), 0
    for i, word in enumerate(words):
        if at in starts:
            if i:
                out.add(f"{words[i - 1]} {word}")
            if i + 1 < len(words):
                out.add(f"{word} {words[i + 1]}")
        at += len(word) + 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic curve with a small penalty, by Newton's method."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    penalty = ridge * np.diag([1.0] * x.shape[1] + [1e-6])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


def fit(learning: DataFrame, max_entries: int = MAX_ENTRIES) -> Model:
    """A model from (text, toxic). Without rows of both labels, or without any entry that tells them apart, its lexicon is empty and its
    scores are the share of toxic rows.

    To the driver come at most ``max_entries`` entries and phrases, and of every learning row, whose number is bounded, its finds."""
    seen = written(learning, "learning")
    totals = {r.toxic: r.n for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    all1, all0 = totals.get(True, 0), totals.get(False, 0)
    share = all1 / (all1 + all0) if all1 + all0 else 0.0
    none = Model({}, [], np.zeros(4), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if not all1 or not all0:
        return none
    rows = seen.mapInArrow(_counted, "toxic boolean, found array<string>").select("toxic", F.explode("found").alias("pattern"))
    one = F.col("toxic").cast("int")
    counted = rows.groupBy("pattern").agg(F.sum(one).alias("n1"), F.sum(1 - one).alias("n0")).filter(F.col("n1") >= LEAST_ROWS)
    entries = _entries(written(counted, "patterns"), all1, all0, max_entries)
    if not entries:
        return none
    n1, n0 = (np.array([c[i] for c in entries.values()], dtype=np.float64) for i in (0, 1))
    weights = dict(zip(entries, _weight(n1, n0, all1, all0).tolist(), strict=True))
    finds = written(seen.mapInArrow(_finds(Lexicon(weights)), FINDS), "finds")
    of_phrase = finds.select(one.alias("one"), F.explode("phrases").alias("phrase")).groupBy("phrase").agg(
        F.sum("one").alias("n1"), F.sum(1 - F.col("one")).alias("n0"))
    clean = of_phrase.filter((F.col("n0") >= EXCEPTION_ROWS) & (F.col("n0") / all0 >= EXCEPTION_TIMES * (F.col("n1") + 0.5) / all1))
    exceptions = [r.phrase for r in clean.orderBy(F.col("n0").desc(), "phrase").limit(max_entries).collect()]
    if exceptions:
        finds = written(seen.mapInArrow(_finds(Lexicon(weights, exceptions)), FINDS), "finds")
    # A learning row counts with the weights that all other rows give.
    without = {
        True: dict(zip(entries, _weight(n1 - 1, n0, all1 - 1, all0).tolist(), strict=True)),
        False: dict(zip(entries, _weight(n1, n0 - 1, all1, all0 - 1).tolist(), strict=True)),
    }
    table = finds.select("toxic", "n_words", "entries", "times").toArrow().to_pylist()
    x = np.array([measures(r["n_words"], Counter(dict(zip(r["entries"], r["times"], strict=True))), without[r["toxic"]]) for r in table])
    curve, bias = logistic(x, np.array([r["toxic"] for r in table], dtype=np.float64))
    return Model(weights, exceptions, curve, bias)


# ---- over tables ---------------------------------------------------------------------------------

def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in column ``name``, in place of any of this name."""
    columns = [c for c in docs.columns if c != name]
    schema = docs.select(*columns).schema.add(name, "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        lexicon = Lexicon(own.weights, own.exceptions)
        for batch in parts(batches, text, BATCH_BYTES):
            x = []
            for one in batch.column(text).to_pylist():
                words = words_of(one)
                x.append(measures(len(words), Counter(key for _, key in lexicon.matches(words)), own.weights))
            scores = own.score(np.array(x).reshape(len(x), 4))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores, pa.float64())], [*columns, name])

    return docs.select(*columns).mapInArrow(run, schema)


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", train_rows: int = TRAIN_ROWS,
    predicted: float = PREDICTED,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Learned from the labelled rows of other folds than 1, scored from the text alone, whatever its length: a text is read whole, in time
    proportional to it. A null or empty text, and one without a letter, has no finds and gets the score of these; without labels every score is 0.
    A null id is not held out and not learned from. Rows that share an id are scored each by its text, and all of them are learned from under the
    id's label; an id with several labels is toxic if any says so; null labels do not count. Other columns of both tables are ignored; an
    empty table gives no rows.
    """
    model = fit(learning_rows(docs, labels, train_rows, doc_id, text, toxic))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(doc_id) == 1, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    found = scored(rows, model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= predicted).cast("int").alias("predicted"))
