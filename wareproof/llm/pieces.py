"""A vocabulary of pieces with unigram weights, and the lattice of pieces over a trie of pre-tokens.

Pieces come from a public SentencePiece model. A space starts a pre-token and a line break is one of its own; no piece
crosses such a border, so a text's lattice is a chain of the lattices of its pre-tokens. Distinct
pre-tokens are put in a trie; every node is a prefix, and what is computed for it (the arcs that end there, the best
or the summed score of all ways to it) is shared by all pre-tokens that begin with it.

The model's scores are merge ranks. As a unigram model needs probabilities, a piece of rank r gets weight
1 / (r + 2.7) (Zipf and Mandelbrot), scaled to sum to one. A character without a piece of its own falls back to its
UTF-8 bytes, with a weight e^-10 times the lowest. The space mark written out in a text counts as such a
character, which keeps decoding lossless.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SPACE_MARK = "▁"
ZIPF_SHIFT = 2.7
UNKNOWN_PENALTY = 10.0
#: Pre-tokens of more characters are worked off one by one: a trie level for each would cost more.
LONG = 64
NO_PIECE = -(1 << 31)
BASE = np.uint64(0x9E3779B97F4A7C15)
PRETOKEN = re.compile(" *[^ \n]+|\n| +")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, in order; their concatenation is a space and the text. An empty text has none."""
    return PRETOKEN.findall(" " + text) if text else []


@dataclass
class Vocabulary:
    """Pieces, with a space where the model has its mark. ``scores`` are log-probabilities."""

    ids: dict[str, int]
    scores: np.ndarray
    as_bytes: list[bytes]
    first_byte: int
    unknown: float
    longest: int
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _mixed(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def _hash(text: str) -> int:
    value = 0
    for code in _mixed(np.array([ord(c) for c in text])).tolist():
        value = (value * int(BASE) + code) % (1 << 64)
    return value


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids = [i for i in range(size) if model.is_byte(i)]
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    texts = {i: model.id_to_piece(i).replace(SPACE_MARK, " ") for i in plain}
    weights = 1 / (np.arange(len(plain)) + ZIPF_SHIFT)
    scores = np.full(size, -np.inf)
    scores[plain] = np.log(weights / weights.sum())
    as_bytes = [b""] * size
    for i, text in texts.items():
        as_bytes[i] = text.encode()
    for value, i in enumerate(byte_ids):
        as_bytes[i] = bytes([value])
    longest = max(map(len, texts.values()))
    tables = []
    for length in range(longest + 1):
        own = sorted((_hash(t), i) for i, t in texts.items() if len(t) == length)
        keys = np.array([k for k, _ in own], dtype=np.uint64)
        if len(set(keys.tolist())) < len(keys):
            raise ValueError("two pieces share a hash")
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[(keys >> np.uint64(48)).astype(np.int64)] = True
        tables.append((keys, np.array([i for _, i in own], dtype=np.int32), maybe))
    unknown = float(scores[plain].min()) - UNKNOWN_PENALTY
    return Vocabulary({t: i for i, t in texts.items()}, scores, as_bytes, byte_ids[0], unknown, longest, tables)


@dataclass
class Lattice:
    """Arcs of the nodes of a trie. The arcs into node n are ``first[n]`` to ``first[n + 1]``; an arc has the node
    it comes from, the code of its piece (an id, or -1 - c for the bytes of character c) and its score.
    ``terminal`` is the node of every pre-token; ``value`` what was summed or maximised per node,
    ``count`` the number of tokens of its best way."""

    first: np.ndarray
    source: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    terminal: np.ndarray
    value: np.ndarray
    count: np.ndarray


def _lookup(table: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray, out: np.ndarray) -> None:
    """Put the ids of pieces into ``out`` by hash; where there is none it stays as it is."""
    known, ids, maybe = table
    if len(known):
        rows = np.flatnonzero(maybe[(keys >> np.uint64(48)).astype(np.int64)])
        own = keys[rows]
        at = np.searchsorted(known, own)
        at[at == len(known)] = 0
        hit = known[at] == own
        out[rows[hit]] = ids[at[hit]]


def _bytes_of(codes: np.ndarray) -> np.ndarray:
    """The number of UTF-8 bytes of characters."""
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def lattice(words: list[str], vocab: Vocabulary, best: bool) -> Lattice:
    """The lattice of distinct pre-tokens. ``best``: values are the scores of the best ways (on ties the way whose last
    piece is shorter), and token counts are kept; otherwise the log of the summed probability of all ways."""
    order = sorted(range(len(words)), key=words.__getitem__)
    words = [words[i] for i in order]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    node = np.zeros(len(words), dtype=np.int64)  # the root is node 0
    most = 1 + len(codes)  # a trie has at most a node for every character, and the root
    parent_of, hash_of = np.zeros(most, np.int64), np.zeros(most, np.uint64)
    value_of, count_of = np.zeros(most), np.zeros(most, np.int64)
    arcs: list[tuple[np.ndarray, ...]] = []
    n_nodes, depth = 1, 0
    powers = [np.uint64(1)]
    with np.errstate(over="ignore"):
        for _ in range(vocab.longest):
            powers.append(powers[-1] * BASE)
    active = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    while len(active):
        char = codes[starts[active] + depth]
        # Words are sorted, so equal prefixes stand together.
        new = np.ones(len(active), dtype=bool)
        new[1:] = (node[active][1:] != node[active][:-1]) | (char[1:] != char[:-1])
        parent, char_new = node[active][new], char[new]
        node[active] = n_nodes + np.cumsum(new) - 1
        depth += 1
        with np.errstate(over="ignore"):
            own = hash_of[parent] * BASE + _mixed(char_new)
        m, reach = len(parent), min(depth, vocab.longest)
        found = np.full((m, reach), NO_PIECE, dtype=np.int32)
        source = np.empty((m, reach), dtype=np.int32)
        above = parent
        for length in range(1, reach + 1):
            with np.errstate(over="ignore"):
                _lookup(vocab.tables[length], own - hash_of[above] * powers[length], found[:, length - 1])
            source[:, length - 1] = above
            if length < reach:
                above = parent_of[above]
        missing = found[:, 0] == NO_PIECE
        found[missing, 0] = -1 - char_new[missing]
        is_arc = found != NO_PIECE
        row, source, piece = np.nonzero(is_arc)[0], source[is_arc], found[is_arc]
        held = is_arc.sum(axis=1)  # at least one, that of the last character
        begin = np.cumsum(held) - held
        score = np.where(piece >= 0, vocab.scores[piece], vocab.unknown)
        ways = value_of[source] + score
        top = np.maximum.reduceat(ways, begin)
        if best:
            at_top = np.flatnonzero(ways == top[row])[::-1]
            pick = np.empty(m, dtype=np.int64)
            pick[row[at_top]] = at_top  # the first of a node is written last
            tokens = np.where(missing, _bytes_of(char_new), 1)
            value, count = top, count_of[source[pick]] + np.where(piece[pick] < 0, tokens, 1)
        else:
            value, count = top + np.log(np.add.reduceat(np.exp(ways - top[row]), begin)), np.zeros(m, dtype=np.int64)
            arcs.append((held, source, piece, score))
        fresh = slice(n_nodes, n_nodes + m)
        parent_of[fresh], hash_of[fresh], value_of[fresh], count_of[fresh] = parent, own, value, count
        n_nodes += m
        active = active[lengths[active] > depth]
    for i in np.flatnonzero(lengths > LONG).tolist():
        chain, chain_value, chain_count = _chain(words[i], vocab, best)
        ids = np.concatenate(([0], n_nodes + np.arange(len(words[i]))))  # node of each prefix
        if not best:
            arcs.append((chain[0], ids[chain[1]], chain[2], chain[3]))
        fresh = slice(n_nodes, n_nodes + len(words[i]))
        value_of[fresh], count_of[fresh] = chain_value, chain_count
        n_nodes += len(words[i])
        node[i] = n_nodes - 1
    terminal = np.empty(len(words), dtype=np.int64)
    terminal[order] = node
    if arcs:
        per_node = np.concatenate([np.zeros(1, np.int64), *[a[0] for a in arcs]])
        first = np.concatenate(([0], np.cumsum(per_node)))
        source, piece, score = (np.concatenate([a[k] for a in arcs]) for k in (1, 2, 3))
    else:
        first, source, piece, score = np.zeros(n_nodes + 1, np.int64), *(np.zeros(0, np.int64),) * 2, np.zeros(0)
    return Lattice(first, source, piece, score, terminal, value_of, count_of)


def _chain(word: str, vocab: Vocabulary, best: bool):
    """Arcs, values and counts of the prefixes of one long pre-token; arcs name prefixes by length."""
    n = len(word)
    value, count = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
    per_node, source, piece, score = np.zeros(n, dtype=np.int64), [], [], []
    for end in range(1, n + 1):
        ways = []
        for start in range(end - 1, max(-1, end - 1 - vocab.longest), -1):
            found = vocab.ids.get(word[start:end])
            if found is not None:
                ways.append((start, found, vocab.scores[found], 1))
            elif start == end - 1:
                ways.append((start, -1 - ord(word[start]), vocab.unknown, len(word[start].encode())))
        sums = [value[s] + x for s, _, x, _ in ways]
        top = max(sums)
        if best:
            at = sums.index(top)
            value[end], count[end] = top, count[ways[at][0]] + ways[at][3]
        else:
            value[end] = top + np.log(np.exp(np.array(sums) - top).sum())
            per_node[end - 1] = len(ways)
            source += [w[0] for w in ways]
            piece += [w[1] for w in ways]
            score += [w[2] for w in ways]
    arcs = (per_node, np.array(source, dtype=np.int64), np.array(piece, dtype=np.int64), np.array(score))
    return arcs, value[1:], count[1:]
