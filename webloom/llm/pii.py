"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Base kinds, leftmost and without overlap within a kind: ``email``, ``ip`` (parts
at most 255), ``card`` (14 to 19 digits passing Luhn), ``phone`` (10 to 15
digits). Further kinds: ``iban`` (mod 97) and ``ssn`` (no checksum, so the score
decides). Every span has a score: its kind's prior, raised by words such as
"card" or "call" shortly before it, lowered by words such as "version". Base
spans are kept whatever their score; further kinds need ``MIN_SCORE``.

Every pattern runs in linear time on any text: runs of characters are taken
possessively, and a run that cannot match is passed over as a whole, which
cannot lose a match as all later starts in the run would fail alike.

Null and empty texts have no span. Positions are code points, ends exclusive.
Repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free, plus, tidy

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
MIN_SCORE = 0.5

# The optional part fails only where every later start in the same run fails too.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}))")
#: Characters of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.95, "ssn": 0.4}
CONTEXT = {
    "email": {"mail": 0.1, "contact": 0.05, "write": 0.05},
    "ip": {"ip": 0.2, "address": 0.1, "host": 0.1, "version": -0.4, "release": -0.3},
    "card": {"card": 0.1, "visa": 0.1, "credit": 0.1, "isbn": -0.4, "order": -0.1},
    "phone": {"phone": 0.2, "call": 0.2, "tel": 0.2, "fax": 0.1, "mobile": 0.2},
    "iban": {"iban": 0.05, "account": 0.05},
    "ssn": {"ssn": 0.4, "social": 0.3, "security": 0.2, "part": -0.2},
}
CONTEXT_CHARS = 40
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    rest = 0
    for c in moved:
        v = int(c, 36)
        rest = (rest * (10 if v < 10 else 100) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and not _LOCAL_END.match(text, lo - 1):
            lo -= 1
        m = _EMAIL.match(text, lo) if lo < at else None
        if m and m.group(1):
            yield m.span()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if m.group(1) and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Capitals may follow a number, so its end is where its country's length is full; of other countries the longest end that mod 97 confirms."""
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() < done:
            continue
        end, size, ends = m.end(), 4, []
        for c in m.group(1):
            end += 1
            size += c != " "
            if c != " " and not text[end : end + 1].isalnum() and size >= 15:
                ends.append((size, end))
        length = IBAN_LENGTHS.get(text[m.start() : m.start() + 2])
        for size, end in reversed(ends):
            if (length is None or size == length) and mod97(text[m.start() : end].replace(" ", "")):
                yield m.start(), end
                done = end
                break


def score(kind: str, text: str, start: int) -> float:
    near = set(_WORD.findall(text[max(0, start - CONTEXT_CHARS) : start].lower()))
    return min(1.0, max(0.0, PRIOR[kind] + sum(v for w, v in CONTEXT[kind].items() if w in near)))


def find(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of all spans, by start and then by kind in the order of KINDS."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(a, b, "ip") for a, b in _ips(text)]
        found += [(a, b, "card") for a, b in _cards(text)]
        if "+" in text:
            found += [(a, b, "phone") for a, b in _phones(text)]
        found += [(a, b, "iban") for a, b in _ibans(text)]
        if "-" in text:
            found += [(a, b, "ssn") for a, b in ((m.start(), m.end()) for m in _SSN.finditer(text))]
    out = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]))):
        s = score(kind, text, a)
        if kind in BASE_KINDS or s >= MIN_SCORE:
            out.append((a, b, kind, s))
    return out


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union goes, named for the first."""
    spans = find(text)
    if not spans:
        return text
    out, done, end, name = [], 0, -1, ""
    for a, b, kind, _ in spans:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out.append(f"[{name.upper()}]")
            done = end
        out.append(text[done:a])
        end, name = b, kind
    return "".join([*out, f"[{name.upper()}]", text[end:]])


def _joined(spans: list[tuple[int, int, str, float]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in spans)


def with_spans(docs: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """``docs`` with a column of spans; all other columns stay."""
    name = free(docs, spans)

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in find(t)] for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, name])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(tidy(work), plus(docs.schema, **{name: T.ArrayType(span)}))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text``; columns, rows and their order of columns stay."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            new = pa.array([redact(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(tidy(work), docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """For each document the numbers of its base spans, their digest and all spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [find(t) for t in b.column(1).to_pylist()]
            base = [[s for s in r if s[2] in BASE_KINDS] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    *(pa.array([sum(s[2] == k for s in r) for r in base], pa.int64()) for k in BASE_KINDS),
                    pa.array([hashlib.sha256(_joined(r).encode()).hexdigest() for r in base], pa.string()),
                    pa.array([_joined(r) for r in rows], pa.string()),
                ],
                names=names,
            )

    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} bigint" for k in BASE_KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(tidy(work), schema)

