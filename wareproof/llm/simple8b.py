"""Operator 2: token ids in files of Simple-8b words.

Simple-8b (Anh and Moffat, 2010) puts as many ids as fit into the low 60 bits of a 64-bit word; the high
four bits, the selector, say how many and how wide. Ids are cut into blocks of ``BLOCK`` that start at a word
of their own, and the file keeps the first word of every block: blocks are packed and unpacked side by side
with array operations, and a document can be read without the blocks before it.

File format: Parquet, a row per segment of whole documents. ``shard`` is the file's place in the order of
documents and ``segment`` the row's place in it; ``first`` the number of ids of the shard before it;
``doc_ids`` and ``lengths`` the documents in it; ``words`` the packed ids, little-endian; ``offsets`` the first
word of every block as little-endian uint32. Spark's committer writes the files, so a lost task leaves none.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wareproof.llm.common import parts, spread_ranges

# Fixed values of the format: selector -> (ids in a word, bits of an id).
SELECTORS = {
    2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7),
    9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60),
}
# An id of more than 60 bits takes two words: its low 32 bits (one id), then its high 32 bits (no id).
ESCAPE_LOW, ESCAPE_HIGH = 1, 0
COUNTS = np.array([0, 1] + [SELECTORS[s][0] for s in range(2, 16)], dtype=np.int64)
BLOCK = 512
CACHE_IDS = 16_384
PAYLOAD = np.uint64((1 << 60) - 1)

END_ID = 2
SEGMENT_BYTES = 4_000_000
CACHED_WORDS = 800_000
FILE_SCHEMA = (
    "shard int, segment int, first bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, "
    "words binary, offsets binary"
)
READ_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


# ---- the code ------------------------------------------------------------------------------------

def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, at least one."""
    if len(ids) and int(ids.max()) < 1 << 20:  # all token ids: one exact conversion
        return np.maximum(np.frexp(ids.astype(np.float32))[1], 1).astype(np.int8)
    high = np.frexp((ids >> np.uint64(32)).astype(np.float64))[1]
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.maximum(np.where(high > 0, high + 32, low), 1).astype(np.int8)


def _choices(widths: np.ndarray, block: int) -> np.ndarray:
    """For every position the selector of a word that starts there, at least as wide as its ids and with room
    for as many as fit. Worked off in runs of blocks that stay in the processor's cache."""
    n, step = len(widths), max(1, CACHE_IDS // block) * block
    chosen = np.full(n, ESCAPE_LOW, dtype=np.int8)
    for start in range(0, n, step):
        own, out = widths[start:start + step], chosen[start:start + step]
        m, widest = len(own), int(own.max())
        place = np.arange(m, dtype=np.int32)
        ends = np.minimum((place // block + 1) * block, m).astype(np.int32)
        for selector in range(15, 1, -1):
            count, bits = SELECTORS[selector]
            if widest <= bits:
                out[:] = selector
                continue
            narrow = own <= bits
            if np.count_nonzero(narrow) < count:
                break
            next_wide = np.minimum.accumulate(np.where(narrow, np.int32(m), place)[::-1])[::-1]
            out[next_wide >= np.minimum(place + np.int32(count), ends)] = selector
    return chosen


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned 64-bit ids as words, and the first word of every block. No ids give no words."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, dtype="<u8"), np.zeros(0, dtype="<u4")
    block_ends = np.minimum((np.arange(n, dtype=np.int32) // block + 1) * block, n)
    chosen = _choices(_widths(ids), block)
    # All blocks are walked at once, a word of each at a time.
    at, is_start = np.arange(0, n, block), np.zeros(n, dtype=bool)
    while len(at):
        is_start[at] = True
        after = at + COUNTS[chosen[at]]
        at = after[after < block_ends[at]]
    starts = np.flatnonzero(is_start)
    selectors = chosen[starts]
    words = np.zeros(len(starts), dtype=np.uint64)
    padded = np.concatenate([ids, np.zeros(60, dtype=np.uint64)])
    for selector in np.unique(selectors):
        rows = np.flatnonzero(selectors == selector)
        first = starts[rows]
        if selector == ESCAPE_LOW:
            words[rows] = (np.uint64(ESCAPE_LOW) << np.uint64(60)) | (ids[first] & np.uint64(0xFFFFFFFF))
            continue
        count, bits = SELECTORS[int(selector)]
        packed, ends = np.full(len(rows), np.uint64(selector) << np.uint64(60)), block_ends[first]
        for k in range(count):
            value = np.where(first + k < ends, padded[first + k], np.uint64(0))
            packed |= value << np.uint64(bits * k)
        words[rows] = packed
    first_words = np.searchsorted(starts, np.arange(0, n, block))
    escaped = selectors == ESCAPE_LOW
    if escaped.any():
        high = (np.uint64(ESCAPE_HIGH) << np.uint64(60)) | (ids[starts] >> np.uint64(32))
        before = np.concatenate(([0], np.cumsum(escaped)))
        words = np.insert(words, np.flatnonzero(escaped) + 1, high[escaped])
        first_words = first_words + before[first_words]
    return words.astype("<u8"), first_words.astype("<u4")


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK, blocks: slice = slice(None)) -> np.ndarray:
    """The ids of the blocks that ``blocks`` names (all by default); ``n`` is the number of all ids."""
    first, last, _ = blocks.indices(len(offsets))
    if last <= first:
        return np.zeros(0, dtype=np.uint64)
    bounds = np.append(offsets.astype(np.int64), len(words))
    words = words[bounds[first]:bounds[last]].astype(np.uint64)
    bounds = bounds[first:last] - bounds[first]
    n_out = min(n, last * block) - first * block
    selectors = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[selectors]
    before = np.cumsum(held) - held
    of = np.repeat(np.arange(len(bounds)), np.diff(np.append(bounds, len(words))))
    starts = before - before[bounds][of] + of * block
    ends = np.minimum((of + 1) * block, n_out)
    out = np.zeros(n_out, dtype=np.uint64)
    for selector in np.unique(selectors):
        rows = np.flatnonzero(selectors == selector)
        if selector == ESCAPE_HIGH:
            out[starts[rows] - 1] |= (words[rows] & PAYLOAD) << np.uint64(32)
        elif selector == ESCAPE_LOW:
            out[starts[rows]] |= words[rows] & PAYLOAD
        else:
            count, bits = SELECTORS[int(selector)]
            payload, mask = words[rows], np.uint64((1 << bits) - 1)
            full = starts[rows] + count <= ends[rows]
            base, payload_full = starts[rows][full], payload[full]
            for k in range(count):
                out[base + k] = (payload_full >> np.uint64(bits * k)) & mask
            for row in rows[~full]:  # the last word of a block
                k = np.arange(ends[row] - starts[row])
                out[starts[row] + k] = (words[row] >> (bits * k).astype(np.uint64)) & mask
    return out


# ---- token ids -----------------------------------------------------------------------------------

# Byte-level tokenizers write a byte as the character of its number, or, where that cannot be printed, as the next
# character from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _as_bytes(words: list[str]) -> list[str]:
    beyond = [i for i, w in enumerate(words) if not w.isascii()]
    if beyond:
        named = "\n".join([words[i] for i in beyond]).encode().decode("latin-1").translate(_BYTE_NAMES)
        words = list(words)
        for i, w in zip(beyond, named.split(chr(_BYTE_NAMES[ord("\n")])), strict=True):
            words[i] = w
    return words


class WordEncoder:
    """Token ids of words, each distinct word encoded once while it is remembered.

    For tokenizers that lower letters and drop white space: no pre-token crosses it, so the ids of a text are those
    of its words in order. A word's last full stop or comma after a plain letter is a pre-token of its own. A word of
    small letters in their usual form is one pre-token as it stands and goes straight to the tokenizer's model, as bytes. These, and
    other words of letters, are encoded many at a time and come apart where tokens end a pre-token; all others take the whole way one by one.
    Texts are split and their words numbered by Arrow, so that only the distinct words of a batch are looked up. At
    most ``limit`` words are remembered: before a batch that would pass it, and after one that does alone, the memory starts afresh.
    """

    GROUP = 2000
    PROBE = ["thé", "Cat.", "dogs,", "it's", "a1", "supercalifragilistic", "naïve"]

    def __init__(self, path: str, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        marks = [self._encoded([mark])[0] for mark in ".,"]
        if any(len(m) != 1 for m in marks):
            raise ValueError("the tokenizer has no tokens of full stop and comma")
        self.marks = np.array([m[0] for m in marks], dtype=np.uint32)
        self.forget()
        whole = self._encoded([" ".join(self.PROBE)])[0]
        if self.text_ids(pa.array([" ".join(self.PROBE)], pa.binary()))[0].tolist() != whole:
            raise ValueError("words of this tokenizer cannot be encoded apart")
        self.forget()

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
        """Ids of distinct stems one after the other, how many each has, and the place of each."""
        plain, letters, others = [], [], []
        for t in stems:
            kind = others if not t.isalpha() else plain if t.islower() and is_normalized("NFC", t) else letters
            kind.append(t)
        found = [self._grouped(self.bare, _as_bytes(plain)), self._grouped(self.tokenizer, letters), self._listed(self._encoded(others))]
        flat, lengths = (np.concatenate(x) for x in zip(*found, strict=True))
        return flat, lengths, dict(zip(chain(plain, letters, others), range(len(lengths)), strict=True))

    def _listed(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(lengths.sum())), lengths

    def _grouped(self, tokenizer, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of stems that are a pre-token each, encoded many at a time."""
        flat, lengths = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(stems), self.GROUP):
            group = stems[at:at + self.GROUP]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group):
                own = np.diff(ends, prepend=0)
            else:  # lowering turned a letter into more than letters
                ids, own = self._listed([e.ids for e in tokenizer.encode_batch_fast(group, add_special_tokens=False)])
            flat.append(ids)
            lengths.append(own)
        return np.concatenate(flat), np.concatenate(lengths)

    def _learn(self, words: list[bytes]) -> None:
        texts = b"\n".join(words).decode("utf-8", "replace").split("\n")
        marked = [t[-1] in ".," and "a" <= t[-2:-1] <= "z" for t in texts]
        stems = [t[:-1] if m else t for t, m in zip(texts, marked, strict=True)]
        flat, lengths, place = self._stems(list(dict.fromkeys(stems)))
        at = np.fromiter(map(place.__getitem__, stems), dtype=np.int64, count=len(stems))
        own = lengths[at]
        ids = flat[spread_ranges((np.cumsum(lengths) - lengths)[at], own)]
        ends = np.flatnonzero(marked)
        mark = self.marks[np.array([texts[i][-1] == "," for i in ends.tolist()], dtype=np.int64)]
        ids = np.insert(ids, np.cumsum(own)[ends], mark)
        own[ends] += 1
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(own) - own])
        self.lengths = np.concatenate([self.lengths, own])
        self.flat = np.concatenate([self.flat, ids])

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        coded = pa.array(words, pa.binary()).dictionary_encode()
        return self._coded_ids(coded.indices.to_numpy(), coded.dictionary.to_pylist())

    def text_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (binary, UTF-8) one after the other, and how many each has; a null text has none.

        Letters are lowered here unless a special token may stand in a text, which is told by case."""
        own = texts.view(pa.string())
        lowered, special = pc.ascii_lower(own), pc.fill_null(pc.match_substring(own, "<|"), False)
        if pc.any(special).as_py():
            lowered = pc.if_else(special, own, lowered)
        split = pc.ascii_split_whitespace(lowered)
        bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy())))
        coded = split.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        if b"" in words:  # white space at the ends of a text
            empty = words.index(b"")
            filled = codes != empty
            bounds = np.concatenate(([0], np.cumsum(filled)))[bounds]
            codes = codes[filled]
            codes = codes - (codes > empty)
            words.pop(empty)
        ids, per_word = self._coded_ids(codes, words)
        return ids, np.diff(np.concatenate(([0], np.cumsum(per_word)))[bounds])

    def _coded_ids(self, codes: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` of the words that ``codes`` number in the distinct ``words``."""
        fresh = [w for w in words if w not in self.slots]
        if fresh and self.slots and len(self.slots) + len(fresh) > self.limit:
            self.forget()
            fresh = words
        if fresh:
            self.slots.update(zip(fresh, range(len(self.slots), len(self.slots) + len(fresh)), strict=True))
            self._learn(fresh)
        at = np.fromiter(map(self.slots.__getitem__, words), dtype=np.int64, count=len(words))[codes]
        lengths = self.lengths[at]
        ids = self.flat[spread_ranges(self.starts[at], lengths)]
        if len(self.slots) > self.limit:
            self.forget()
        return ids, lengths


@lru_cache(maxsize=1)
def word_encoder(path: str, limit: int) -> WordEncoder:
    return WordEncoder(path, limit)


def _with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> np.ndarray:
    """``end_id`` after the ids of every document."""
    return np.insert(ids, np.cumsum(lengths), end_id)


def _segments(tokenizer: str, end_id: int, segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        encoder = word_encoder(tokenizer, CACHED_WORDS)
        for batch in parts(batches, "text", segment_bytes):
            ids, lengths = encoder.text_ids(batch.column("text"))
            packed, offsets = encode(_with_end(ids, lengths, end_id))
            n = len(ids) + len(lengths)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()),
                "first": [first], "n_ids": [n], "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "lengths": pa.array([lengths + 1], pa.list_(pa.int64())),
                "words": pa.array([packed.tobytes()], pa.binary()), "offsets": pa.array([offsets.tobytes()], pa.binary()),
            })
            segment, first = segment + 1, first + n
    return run


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
    segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Encode every whole text and write the ids below ``path`` in ascending order of ``doc_id``.

    A null text counts as empty and keeps its end id; a null ``doc_id`` comes first; rows that share an
    id follow each other, by a hash of their text. An empty table writes files without rows. Other columns are ignored.
    The texts are shuffled once, by range, and never gathered; ``segment_bytes`` of text, or one long
    document, are in memory at a time.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    keyed = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order: list[Column] = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_row").asc()]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    encoded = ranged.mapInArrow(_segments(tokenizer, end_id, segment_bytes), FILE_SCHEMA)
    encoded.write.option("compression", "none").parquet(path)


def _unpack(row: dict) -> np.ndarray:
    return decode(np.frombuffer(row["words"], dtype="<u8"), np.frombuffer(row["offsets"], dtype="<u4"), row["n_ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "words", SEGMENT_BYTES):
        for row in batch.to_pylist():
            ids = _unpack(row).astype("<u4").tobytes()
            lengths = np.array(row["lengths"], dtype=np.int64)
            ends = np.cumsum(lengths)
            sums = [zlib.crc32(ids[4 * (e - k):4 * e]) for k, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "start": pa.array(row["shard_first"] + row["first"] + ends - lengths, pa.int64()),
                "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
            })


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "words", SEGMENT_BYTES):
        for row in batch.to_pylist():
            ends = np.cumsum(row["lengths"])
            for doc, ids in zip(row["doc_ids"], np.split(_unpack(row), ends[:-1]), strict=True):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([doc], pa.int64()), "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64())),
                })


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document in the files."""
    return spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(_ids, "doc_id bigint, ids array<bigint>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    ``start`` counts the ids of all documents before it: those of the shards before, summed over a row per
    file, and those of the shard before the document.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_first"))
    return files.join(firsts, "shard").select(
        "shard_first", "first", "n_ids", "doc_ids", "lengths", "words", "offsets"
    ).mapInArrow(_digests, READ_SCHEMA)
