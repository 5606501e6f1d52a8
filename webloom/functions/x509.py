"""Names, validity and fingerprint of X.509 certificates given as bytes, and their Arrow UDF."""

from __future__ import annotations

import hashlib
import ipaddress
from collections.abc import Iterator

import pyarrow as pa

from .udf import arrow_function

# Object identifiers and their short names.
_NAMES = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU"}
_ALT_NAMES = "2.5.29.17"
FIELDS = ("subject_dn", "subject_cn", "issuer_dn", "issuer_cn", "not_before", "not_after", "fingerprint_sha256")


def _items(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, content) of each value in a DER sequence."""
    i = 0
    while i < len(data):
        tag, n, i = data[i], data[i + 1], i + 2
        if n & 128:
            k = n & 127
            n, i = int.from_bytes(data[i : i + k], "big"), i + k
        if i + n > len(data):
            raise ValueError("cut short")
        yield tag, data[i : i + n]
        i += n


def _oid(raw: bytes) -> str:
    parts, value = [], 0
    for b in raw:
        value = value << 7 | b & 127
        if not b & 128:
            parts.append(value)
            value = 0
    first = min(parts[0] // 40, 2)
    return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]]))


def _name(raw: bytes) -> list[tuple[str, str]]:
    out = []
    for _, group in _items(raw):
        for _, pair in _items(group):
            (_, kind), (tag, text) = _items(pair)
            oid = _oid(kind)
            out.append((_NAMES.get(oid, oid), text.decode("utf-16-be" if tag == 30 else "utf-8", "replace")))
    return out


def _time(tag: int, raw: bytes) -> str:
    t = raw.decode()
    if tag == 23:  # two digits of the year
        t = ("19" if t[:2] >= "50" else "20") + t
    return f"{t[:4]}-{t[4:6]}-{t[6:8]} {t[8:10]}:{t[10:12]}:{t[12:14]} UTC"


def _alt_names(raw: bytes) -> list[str]:
    out = []
    for _, extension in _items(raw):
        parts = list(_items(extension))
        if _oid(parts[0][1]) == _ALT_NAMES:
            _, names = next(_items(parts[-1][1]))
            for tag, v in _items(names):
                if tag == 0x82:
                    out.append(v.decode("ascii", "replace"))
                elif tag == 0x87 and len(v) in (4, 16):
                    out.append(str(ipaddress.ip_address(v)) if len(v) == 4 else ":".join(v[i : i + 2].hex() for i in range(0, 16, 2)))
    return out


def parse(der: bytes | None) -> dict | None:
    """The certificate's fields, or None if it cannot be read."""
    try:
        whole = next(_items(next(_items(der))[1]))[1]
        parts = list(_items(whole))
        parts = parts[1:] if parts[0][0] == 0xA0 else parts
        issuer, subject = _name(parts[2][1]), _name(parts[4][1])
        times = list(_items(parts[3][1]))
        extensions = next((v for t, v in parts if t == 0xA3), b"")
        dn = lambda n: ", ".join(f"{k}={v}" for k, v in n)
        first = lambda n, k: next((v for x, v in n if x == k), "")
        return {
            "subject_dn": dn(subject), "subject_cn": first(subject, "CN"), "issuer_dn": dn(issuer), "issuer_cn": first(issuer, "CN"),
            "not_before": _time(*times[0]), "not_after": _time(*times[1]), "fingerprint_sha256": hashlib.sha256(der).digest().hex(":"),
            "subject_an": _alt_names(next(_items(extensions))[1]) if extensions else [], "issuer_org": [v for k, v in issuer if k == "O"],
        }
    except (ValueError, IndexError, StopIteration, TypeError, UnicodeDecodeError):
        return None


@arrow_function("struct<" + ",".join(f"{f}:string" for f in FIELDS) + ",subject_an:array<string>,issuer_org:array<string>>")
def certificate(der: pa.Array) -> pa.Array:
    kind = pa.struct([*((f, pa.string()) for f in FIELDS), ("subject_an", pa.list_(pa.string())), ("issuer_org", pa.list_(pa.string()))])
    return pa.array([parse(d) for d in der.to_pylist()], kind)
