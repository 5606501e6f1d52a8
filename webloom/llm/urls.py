"""URL filtering with a bit-parallel wildcard automaton.

Glob rules over the canonical URL (host, then path, a border between them) are packed into
one Shift-And automaton of as many 64-bit words as all rules need: a bit for
each literal position of each rule, a loop mask for positions that a ``*``
precedes, and a mask per byte value. One pass over a URL's bytes moves all rules
at once; numpy does it for all URLs of a batch together, longest first, so that
a long URL costs steps of its own only.

Verdicts: of the list rules (host, path prefix) that fit, the longest decides.
A list rule fits its host and all its subdomains. Where none fits, glob rules
decide: block if any block glob fits and no allow glob does. They see the
canonical form: the host without credentials, port and last dot, the path with
unreserved escapes decoded and dot segments resolved. What a glob has before its
first slash, if it is more than stars, must end where the host ends.

Null URLs and those without ``://`` have an empty host and path and are allowed
unless a glob fits the empty string. Repeated rows give repeated results, an
empty table an empty one; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

#: (verdict, rule): a host and a path, the longest one that fits decides.
LIST_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: (verdict, glob over host and path) for URLs that no list rule fits.
GLOBS = (
    ("block", "*cheap-pills.*"),
    ("block", "*casino*"),
    ("block", "ads.*"),
    ("block", "*.ads.*/*"),
    ("block", "*/track/*"),
    ("allow", "*.edu/*"),
)
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@dataclass
class Automaton:
    """Shift-And over several patterns; ``*`` stands for any bytes, all else for itself."""

    words: int
    by_byte: np.ndarray  # (256, words): positions whose literal is that byte
    first: np.ndarray  # (words,): positions that the start of a text allows
    anywhere: np.ndarray  # first literals after a leading star
    loop: np.ndarray  # positions that stay once reached, as a star follows
    final: list[tuple[int, bool, bool]]  # per pattern its last position (-1: none), whether a star ends it, whether empty

    @classmethod
    def of(cls, patterns: list[str]) -> Automaton:
        literal, first, anywhere, loop, cut, final = [], [], [], [], [], []
        for p in patterns:
            raw = p.encode()
            last = -1
            star = False
            begin = len(literal)
            for c in raw:
                if c == 42:
                    star = True
                    if len(literal) > begin:
                        loop.append(len(literal) - 1)
                    continue
                if len(literal) == begin:
                    (anywhere if star else first).append(len(literal))
                    cut.append(len(literal))
                last = len(literal)
                literal.append(c)
                star = False
            final.append((last, star, last < 0 and not raw.startswith(b"*")))
        n = max(1, -(-len(literal) // 64))
        by_byte = np.zeros((256, n), np.uint64)
        for i, c in enumerate(literal):
            by_byte[c, i // 64] |= np.uint64(1 << i % 64)
        masks = []
        for places in (first, anywhere, loop, cut):
            m = np.zeros(n, np.uint64)
            for i in places:
                m[i // 64] |= np.uint64(1 << i % 64)
            masks.append(m)
        self = cls(n, by_byte, masks[0], masks[1], masks[2], final)
        self.cut = ~masks[3]
        return self

    def match(self, texts: list[bytes]) -> np.ndarray:
        """(texts, patterns): which patterns match which whole text."""
        n = len(texts)
        out = np.zeros((n, len(self.final)), bool)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        raw = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        sorted_lengths = lengths[order]
        state = np.zeros((n, self.words), np.uint64)
        carry, one = np.uint64(63), np.uint64(1)
        alive = n
        for i in range(int(lengths.max()) if n else 0):
            alive = int(np.searchsorted(-sorted_lengths[:alive], -i, side="left"))  # those longer than i
            s = state[:alive]
            moved = s << one
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> carry
            moved &= self.cut
            # A position followed by a star stays set and so lets the next literal come at any later byte.
            moved |= self.anywhere
            if i == 0:
                moved |= self.first
            state[:alive] = (moved & self.by_byte[raw[starts[:alive] + i]]) | (s & self.loop)
        for k, (last, star, empty) in enumerate(self.final):
            if last < 0:
                out[order, k] = (sorted_lengths == 0) if empty else True
            else:
                hit = (state[:, last // 64] >> np.uint64(last % 64)) & one
                out[order, k] = hit.astype(bool)
                if not star and (self.loop[last // 64] >> np.uint64(last % 64)) & one:
                    raise AssertionError("a loop at a last position needs a trailing star")
        return out


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.search(url or "")
    return (m.group(1).translate(_LOWER), m.group(2)) if m else ("", "")


#: Stands between host and path for the list rules, so that a rule's host ends where the URL's host does.
BORDER = "\0"


def _list_globs(rules) -> list[str]:
    """Two globs for each list rule: its host itself and all subdomains."""
    bordered = [r.replace("/", BORDER + "/", 1) for _, r in rules]
    return [g for r in bordered for g in (r + "*", "*." + r + "*")]


_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})")
_UNRESERVED = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def _decoded(m: re.Match) -> str:
    c = chr(int(m.group(1), 16))
    return c if c in _UNRESERVED else m.group().upper()


def canonical(host: str, path: str) -> tuple[str, str]:
    """The host and path that a URL's writing stands for."""
    host = _ESCAPE.sub(_decoded, host.rpartition("@")[2]).translate(_LOWER)
    host = re.sub(r":[0-9]*\Z", "", host).rstrip(".")
    path = _ESCAPE.sub(_decoded, path)
    if "/." in path:
        out: list[str] = []
        parts = path.split("/")[1:]
        for i, p in enumerate(parts):
            if p in (".", ".."):
                if p == ".." and out:
                    out.pop()
                if i == len(parts) - 1:
                    out.append("")
            else:
                out.append(p)
        path = "/" + "/".join(out)
    return host, path


def _bordered(host: str, path: str) -> bytes:
    return (host.replace(BORDER, "%00") + BORDER + path.replace(BORDER, "%00")).encode()


def _own_globs(globs) -> list[str]:
    """The globs with a border where their host ends."""
    out = []
    for _, g in globs:
        host, slash, path = g.partition("/")
        out.append(f"{host}{BORDER}/{path}" if slash and host.strip("*") else g)
    return out


def judge(pages: DataFrame, rules=LIST_RULES, globs=GLOBS, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule and verdict of each page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, wild = Automaton.of(_list_globs(rules)), Automaton.of(_own_globs(globs))
        rising = sorted(range(len(rules)), key=lambda i: len(rules[i][1]))  # the longest comes last and stays
        allow = np.array([v == "allow" for v, _ in globs], bool)
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            hits = listed.match([_bordered(h, p) for h, p in parts])
            best = np.full(len(parts), -1)
            for i in rising:
                best[hits[:, 2 * i] | hits[:, 2 * i + 1]] = i
            own = wild.match([_bordered(*canonical(h, p)) if h or p else b"" for h, p in parts])
            blocked = own[:, ~allow].any(axis=1) & ~own[:, allow].any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([rules[i][1] if i >= 0 else None for i in best.tolist()], pa.string()),
                    pa.array([rules[i][0] if i >= 0 else ("block" if x else "allow") for i, x in zip(best.tolist(), blocked.tolist(), strict=True)], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(page_id, url).mapInArrow(tidy(work), f"page_id {kind}, host string, path string, rule string, verdict string")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages
), h AS (
  SELECT page_id, regexp_extract(t, '^[^/?#]*') AS h0, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), p AS (
  SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/'
  END AS rule, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS c FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN (c LIKE '%cheap-pills.%' OR path LIKE '%cheap-pills.%' OR c LIKE '%casino%' OR path LIKE '%casino%' OR c LIKE 'ads.%' OR (c LIKE '%.ads.%' AND path LIKE '/%') OR path LIKE '%/track/%')
      AND NOT (c LIKE '%.edu' AND path LIKE '/%') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
