"""URL parsing and resolution after the WHATWG URL standard, in Python, and its Arrow UDFs."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, replace
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column
from .udf import arrow_function

# Fixed values of the standard.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_FRAGMENT = set(' "<>`')
_QUERY = set(' "#<>')
_PATH = _QUERY | set("?^`{}")
_USERINFO = _PATH | set("/:;=@[\\]|")
_FORBIDDEN_HOST = set("\x00\t\n\r #/:<>?@[\\]^|")
_FORBIDDEN_DOMAIN = _FORBIDDEN_HOST | {chr(c) for c in range(32)} | set("%\x7f")

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):(.*)", re.S)
_EDGES = "".join(map(chr, range(33)))
_SINGLE = {".", "%2e"}
_DOUBLE = {"..", ".%2e", "%2e.", "%2e%2e"}


@dataclass(frozen=True)
class Url:
    scheme: str
    userinfo: str | None = None
    host: str | None = None
    port: int | None = None
    path: tuple[str, ...] | str = ()  # a str if opaque
    query: str | None = None
    fragment: str | None = None

    @property
    def path_text(self) -> str:
        return self.path if isinstance(self.path, str) else "".join("/" + p for p in self.path)

    def __str__(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            out += "//" + (self.userinfo + "@" if self.userinfo else "") + self.host + (f":{self.port}" if self.port is not None else "")
        elif not isinstance(self.path, str) and len(self.path) > 1 and self.path[0] == "":
            out += "/."
        out += self.path_text
        if self.query is not None:
            out += "?" + self.query
        return out + ("#" + self.fragment if self.fragment is not None else "")


def _encode(text: str, reserved: set[str]) -> str:
    return "".join(c if 32 < ord(c) < 127 and c not in reserved else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _number(part: str) -> int | None:
    if not part:
        return None
    base = 10
    if part[:2].lower() == "0x":
        part, base = part[2:], 16
    elif len(part) > 1 and part[0] == "0":
        part, base = part[1:], 8
    try:
        return int(part, base) if part and not set(part) & set("+-_ ") else (0 if not part else None)
    except ValueError:
        return None


def _ipv4(host: str) -> str | None | bool:
    """The address, None if the host is no number, False if it is a bad one."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not (parts[-1].isdigit() or re.fullmatch(r"0[xX][0-9A-Fa-f]*", parts[-1])):
        return None
    numbers = [_number(p) for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return False
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _host(text: str, special: bool) -> str | None:
    if text.startswith("["):
        if not text.endswith("]"):
            return None
        try:
            return f"[{ipaddress.IPv6Address(text[1:-1]).compressed}]"
        except ValueError:
            return None
    if not special:
        return None if set(text) & _FORBIDDEN_HOST else _encode(text, set())
    try:
        domain = unquote_to_bytes(text).decode("utf-8")
        domain = domain.lower() if domain.isascii() else ".".join(p.encode("idna").decode() if p else "" for p in re.split("[.。．｡]", domain.lower()))
    except UnicodeError:
        return None
    if not domain or set(domain) & _FORBIDDEN_DOMAIN:
        return None
    address = _ipv4(domain)
    return None if address is False else address or domain


def _authority(u: Url, text: str) -> Url | None:
    special = u.scheme in DEFAULT_PORTS
    userinfo, at, rest = text.rpartition("@")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", rest, re.S)
    if not m or (at and not m.group(1)):
        return None
    if special and u.scheme != "file" and not m.group(1):
        return None
    host = _host(m.group(1), special) if m.group(1) else ""
    if host is None:
        return None
    port = int(m.group(2)) if m.group(2) else None
    if port is not None and port > 65535:
        return None
    name, colon, word = userinfo.partition(":")
    info = _encode(name, _USERINFO) + (":" + _encode(word, _USERINFO) if colon and word else "") if at else None
    return replace(u, userinfo=info or None, host=host, port=None if port == DEFAULT_PORTS.get(u.scheme, -1) else port)


def _walk(start: tuple[str, ...], text: str, special: bool) -> tuple[str, ...]:
    out = list(start)
    parts = re.split(r"[/\\]" if special else "/", text)
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        low = p.lower()
        if low in _DOUBLE:
            if out:
                out.pop()
            if last:
                out.append("")
        elif low in _SINGLE:
            if last:
                out.append("")
        else:
            out.append(_encode(p, _PATH))
    return tuple(out)


def parse(text: str, base: Url | None = None) -> Url | None:
    """The URL that a text stands for, seen from a base; None if it is none."""
    text = text.strip(_EDGES).translate({9: None, 10: None, 13: None})
    text, hashed, fragment = text.partition("#")
    fragment = _encode(fragment, _FRAGMENT) if hashed else None
    m = _SCHEME.match(text)
    if m:
        scheme, rest = m.group(1).lower(), m.group(2)
        special = scheme in DEFAULT_PORTS
        relative = special and scheme != "file" and base is not None and base.scheme == scheme and not re.match(r"[/\\]{2}", rest)
        if not relative:
            return _absolute(Url(scheme, fragment=fragment), rest, special)
        text = rest
    if base is None:
        return None
    special = base.scheme in DEFAULT_PORTS
    if isinstance(base.path, str):
        return replace(base, fragment=fragment) if not text and hashed else None
    if re.match(r"[/\\]{2}" if special else "//", text):
        return _absolute(Url(base.scheme, fragment=fragment), text, special)
    path, asked, query = text.partition("?")
    query = _encode(query, _QUERY | ({"'"} if special else set())) if asked else None
    u = replace(base, query=query, fragment=fragment)
    if not path:
        return u if asked else replace(u, query=base.query)
    if path[0] == "/" or (special and path[0] == "\\"):
        return replace(u, path=_walk((), path[1:], special))
    return replace(u, path=_walk(base.path[:-1], path, special))


def _absolute(u: Url, rest: str, special: bool) -> Url | None:
    rest, asked, query = rest.partition("?")
    u = replace(u, query=_encode(query, _QUERY | ({"'"} if special else set())) if asked else None)
    if special:
        rest = re.sub(r"^[/\\]*", "", rest) if u.scheme != "file" else re.sub(r"^[/\\]{2}", "", rest)
        cut = re.search(r"[/\\]", rest)
        host, path = (rest[: cut.start()], rest[cut.end() :]) if cut else (rest, "")
        u = _authority(u, host)
        return u and replace(u, path=_walk((), path, True))
    if rest.startswith("//"):
        host, slash, path = rest[2:].partition("/")
        u = _authority(u, host)
        return u and replace(u, path=_walk((), path, False) if slash else ())
    if rest.startswith("/"):
        return replace(u, path=_walk((), rest[1:], False))
    return replace(u, path=_encode(rest, set()).replace("%20", " ").rstrip(" ") if u.query is None else _encode(rest, set()))


def join(base: str | None, ref: str | None) -> str | None:
    if base is None or ref is None:
        return None
    b = parse(base)
    u = b and parse(ref, b)
    return str(u) if u else None


@arrow_function("string")
def absolute_url(base: pa.Array, ref: pa.Array) -> pa.Array:
    """The reference resolved against the base; null if that gives no URL. Bases repeat, so they are parsed once."""
    known: dict[str, Url | None] = {}
    out = []
    for b, r in zip(base.to_pylist(), ref.to_pylist(), strict=True):
        if b is not None and b not in known:
            known[b] = parse(b)
        u = parse(r, known[b]) if b is not None and r is not None and known[b] else None
        out.append(str(u) if u else None)
    return pa.array(out, pa.string())


@arrow_function("struct<href:string,scheme:string,host:string,port:int,path:string,query:string,fragment:string>")
def parsed_url(url: pa.Array) -> pa.Array:
    out = []
    for text in url.to_pylist():
        u = parse(text) if text else None
        out.append(None if u is None else {"href": str(u), "scheme": u.scheme, "host": u.host, "port": u.port, "path": u.path_text, "query": u.query, "fragment": u.fragment})
    kind = pa.struct([(n, pa.int32() if n == "port" else pa.string()) for n in ("href", "scheme", "host", "port", "path", "query", "fragment")])
    return pa.array(out, kind)


def is_url(url: Column) -> Column:
    return parsed_url(url).isNotNull()
