"""Operator 4: personal data in texts.

Regular expressions propose spans; checks confirm them (part ranges, digit counts, Luhn for cards, mod-97 for bank account
numbers, the number ranges of social security numbers); words near a span move its score, and a span is
reported from ``THRESHOLD`` on. The four base kinds are certain once they pass their checks. Three more need
more than a match: an IBAN its check digits, a social security number and a national phone number a context word.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareproof.llm.common import parts

# The patterns of the base kinds, in the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE = KINDS[:4]
# `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`, sought from the @ so that long words cost nothing.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])")
CONTEXT = {
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
    "local_phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax)\b", re.I),
}
# Points of a span that passed its checks, of a context word within WINDOW characters, and the points needed. Base kinds
# have enough by themselves; check digits speak for an IBAN, the other two need the word as well.
CHECKED = {"iban": 60, "ssn": 50, "local_phone": 30}
NEAR, THRESHOLD, WINDOW = 30, 60, 40

BATCH_BYTES = 8_000_000
SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, "
    "n_spans bigint"
)
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(number: str) -> bool:
    """Check digits of a bank account number: moved to the end, letters as two digits, it leaves 1."""
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> list[Span]:
    """Leftmost matches without overlap. The part before the @ cannot hold one, so it is found backwards from
    there, as far as the class goes or the last match ended."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        tail = EMAIL_TAIL.match(text, at)
        if tail:
            start = at
            while start > last and EMAIL_HEAD.match(text, start - 1):
                start -= 1
            if start < at:
                found.append((start, tail.end(), "email"))
                last = tail.end()
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[Span]:
    """Base spans that pass their checks."""
    found = emails(text)
    for m in IP.finditer(text):
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (x.lstrip("0") for x in m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return found


def _confirmed(kind: str, match: str) -> bool:
    if kind == "iban":
        return mod97(match.replace(" ", ""))
    if kind == "ssn":
        area, group, serial = match.split("-")
        return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    return _digits(match)[0] not in "01" and _digits(match)[3] not in "01"


def _disjoint(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order; spans that overlap are one stretch."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end, _ in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def more_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of the further kinds whose score reaches the threshold and that overlap none found before. What is covered is kept
    in order, so that a text with many spans takes a search in it for each."""
    found: list[Span] = []
    starts, ends = _disjoint(base)
    for kind, pattern in (("iban", IBAN), ("ssn", SSN), ("local_phone", LOCAL_PHONE)):
        for m in pattern.finditer(text):
            if not _confirmed(kind, m[0]):
                continue
            at = bisect_left(starts, m.end())  # the stretches before begin before the match ends
            if at and ends[at - 1] > m.start():
                continue
            around = text[max(0, m.start() - WINDOW):m.start()] + "\n" + text[m.end():m.end() + WINDOW]
            if CHECKED[kind] + NEAR * bool(CONTEXT[kind].search(around)) >= THRESHOLD:
                found.append((m.start(), m.end(), kind))
                starts.insert(at, m.start())
                ends.insert(at, m.end())
    return found


def joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and further spans of a text; offsets count code points, ends are exclusive."""
    text = text or ""
    base = base_spans(text)
    return base, more_spans(text, base)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text", BATCH_BYTES):
        rows = {name: [] for name in ("email", "ip", "card", "phone", "hash", "spans", "n")}
        for text in batch.column("text").to_pylist():
            base, more = find_spans(text)
            for kind in BASE:
                rows[kind].append(sum(s[2] == kind for s in base))
            rows["hash"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            rows["spans"].append(joined(base + more))
            rows["n"].append(len(base) + len(more))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(rows[k], pa.int64()) for k in BASE), pa.array(rows["hash"], pa.string()),
             pa.array(rows["spans"], pa.string()), pa.array(rows["n"], pa.int64())],
            ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"],
        )


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row.

    ``spans`` lists kind:start:end of every span, ``base_sha256`` digests those of the base kinds. A null or
    empty text has no spans; rows that share an id each give a row; other columns are ignored; an
    empty table gives no rows. Texts are read whole, one after the other, in time that grows with their length and the
    logarithm of their spans; nothing is shuffled.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_runs, SCHEMA)
