"""Endpoints in scripts: a small JavaScript parser, constant folding and labelled candidates.

The parser knows the expression grammar and the statements that can hold
endpoints. Whatever it cannot read is skipped up to the next statement and
counted as a fault; a script with faults, or without any finding, is also
searched with the patterns of functions.text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

from . import text as T
from .whatwg import parse
from .udf import arrow_function

_TOKEN = re.compile(
    r"""(?P<space>[\s\ufeff]+|//[^\n]*|/\*.*?\*/|<!--[^\n]*)
    |(?P<num>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
    |(?P<name>[#@]?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)
    |(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.])""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "&&", "||", "==", "===", "!=", "!==", "+", "-", "*", "%", "<", ">", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "??"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
_ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.)", re.S)


class Fault(Exception):
    pass


def _unescaped(s: str) -> str:
    def one(m: re.Match) -> str:
        x = m.group(1)
        if x[0] in "ux" and len(x) > 1:
            code = int(x.strip("ux{}"), 16)
            return chr(code) if code < 0x110000 else ""
        return "" if x in ("\n", "\r\n") else _ESCAPES.get(x, x)

    return _ESCAPE.sub(one, s)


def tokens(src: str) -> list[tuple]:
    """(kind, value, whether a line ends before it); templates hold their parts and the tokens of their holes."""
    out: list[tuple] = []
    at, line = 0, False
    while at < len(src):
        c = src[at]
        if c == "`":
            value, at = _template(src, at + 1)
            out.append(("tmpl", value, line))
            line = False
            continue
        if c == "/" and (not out or out[-1][0] == "op" and out[-1][1] not in (")", "]", "++", "--") or out[-1][1] in _BEFORE_REGEX) and (m := _REGEX.match(src, at)):
            out.append(("regex", m.group(), line))
        elif m := _TOKEN.match(src, at):
            kind = m.lastgroup
            if kind == "space":
                line |= "\n" in m.group()
                at = m.end()
                continue
            out.append((kind, _unescaped(m.group()[1:-1]) if kind == "str" else m.group(), line))
        else:
            out.append(("bad", c, line))
            at += 1
            continue
        line = False
        at = m.end()
    return out


def _template(src: str, at: int) -> tuple[tuple[list[str], list[list[tuple]]], int]:
    parts, holes, begin = [], [], at
    while at < len(src):
        if src[at] == "\\":
            at += 2
        elif src[at] == "`":
            return (parts + [src[begin:at]], holes), at + 1
        elif src.startswith("${", at):
            parts.append(src[begin:at])
            depth, end = 1, at + 2
            while end < len(src) and depth:
                if src[end] == "`":
                    _, end = _template(src, end + 1)
                    continue
                depth += {"{": 1, "}": -1}.get(src[end], 0)
                end += 1
            holes.append(tokens(src[at + 2 : end - 1]))
            begin = at = end
        else:
            at += 1
    raise Fault("open template")


_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8,
    "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_MAX_DEPTH = 200


class Parser:
    """Statements as ("kind", ...) tuples; expressions likewise."""

    def __init__(self, toks: list[tuple]):
        self.t, self.i, self.faults, self.depth = toks, 0, 0, 0

    def peek(self, k: int = 0):
        return self.t[self.i + k][1] if self.i + k < len(self.t) and self.t[self.i + k][0] in ("op", "name") else None

    def take(self, value: str) -> bool:
        if self.peek() == value:
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise Fault(value)

    def program(self) -> list[tuple]:
        out = []
        while self.i < len(self.t):
            out += self.guarded()
        return out

    def guarded(self) -> list[tuple]:
        start = self.i
        try:
            s = self.statement()
            return [s] if s else []
        except (Fault, IndexError, RecursionError):
            self.faults += 1
            self.depth = 0
            self.i = max(self.i, start + 1)
            while self.i < len(self.t) and self.peek() not in (";", "}") and not self.t[self.i][2]:
                self.i += 1
            if self.peek() in (";", "}"):
                self.i += 1
            return []

    def end(self) -> None:
        if not self.take(";") and self.i < len(self.t) and self.peek() != "}" and not self.t[self.i][2]:
            raise Fault("end")

    def block(self) -> tuple:
        self.need("{")
        out = []
        while self.i < len(self.t) and self.peek() != "}":
            out += self.guarded()
        self.need("}")
        return ("block", out)

    def statement(self) -> tuple | None:
        kind, word = self.t[self.i][0], self.peek()
        nxt = self.peek(1)
        if word == "{":
            return self.block()
        if word == ";":
            self.i += 1
            return None
        if kind == "name":
            if word in ("var", "let", "const") and (self.i + 1 < len(self.t)):
                s = self.declaration()
                self.end()
                return s
            if word == "async" and nxt == "function":
                self.i += 1
                word = "function"
            if word == "function":
                return self.function(True)
            handler = getattr(self, "s_" + word, None) if nxt not in (":", "=", ".") or word in ("return", "throw") else None
            if handler:
                self.i += 1
                return handler()
        e = self.sequence()
        if e[0] == "id" and self.take(":"):
            return ("label", self.statement())
        self.end()
        return ("expr", e)

    def declaration(self) -> tuple:
        self.i += 1
        out = []
        while True:
            name = None
            if self.peek() in ("{", "["):
                self.balanced()
            else:
                name = self.t[self.i][1]
                self.i += 1
            if self.take(":"):  # a type annotation
                while self.i < len(self.t) and self.peek() not in ("=", ",", ";", "of", "in") and not self.t[self.i][2]:
                    self.i += 1
            out.append((name, self.assignment() if self.take("=") else None))
            if not self.take(","):
                return ("declare", out)

    def balanced(self) -> None:
        pairs, depth = {"{": 1, "(": 1, "[": 1, "}": -1, ")": -1, "]": -1}, 0
        while self.i < len(self.t):
            depth += pairs.get(self.peek(), 0)
            self.i += 1
            if depth <= 0:
                return
        raise Fault("open")

    def function(self, declared: bool) -> tuple:
        self.i += 1
        self.take("*")
        if self.t[self.i][0] == "name":
            self.i += 1
        self.balanced()
        body = self.block()
        return ("function", body) if declared else ("opaque",)

    def s_if(self):
        self.need("(")
        test = self.sequence()
        self.need(")")
        yes = self.statement()
        return ("if", test, yes, self.statement() if self.take("else") else None)

    def s_while(self):
        self.need("(")
        test = self.sequence()
        self.need(")")
        return ("loop", test, self.statement())

    def s_do(self):
        body = self.statement()
        self.need("while")
        self.need("(")
        test = self.sequence()
        self.need(")")
        self.take(";")
        return ("loop", test, body)

    def s_for(self):
        self.take("await")
        self.balanced()
        return ("body", self.statement())

    def s_return(self):
        e = None if self.i >= len(self.t) or self.peek() in (";", "}") or self.t[self.i][2] else self.sequence()
        self.end()
        return ("expr", e) if e else None

    s_throw = s_return

    def s_try(self):
        parts = [self.block()]
        if self.take("catch"):
            if self.peek() == "(":
                self.balanced()
            parts.append(self.block())
        if self.take("finally"):
            parts.append(self.block())
        return ("block", parts)

    def s_switch(self):
        self.need("(")
        test = self.sequence()
        self.need(")")
        self.need("{")
        cases = []
        while not self.take("}"):
            if self.take("case"):
                cases.append(("expr", self.sequence()))
                self.need(":")
            elif self.peek() == "default" and self.peek(1) == ":":
                self.i += 2
            else:
                cases += self.guarded()
        return ("block", [("expr", test), *cases])

    def s_class(self):
        while self.peek() != "{":
            self.i += 1
        self.balanced()

    def s_import(self):
        if self.peek() in ("(", "."):
            self.i -= 1
            e = self.sequence()
            self.end()
            return ("expr", e)
        while self.i < len(self.t) and self.t[self.i][0] != "str":
            self.i += 1
        self.i += 1
        self.end()

    def s_export(self):
        if self.take("default"):
            if self.peek() == "function" or (self.peek() == "async" and self.peek(1) == "function"):
                self.take("async")
                return self.function(True)
            self.assignment()
            self.end()
            return None
        self.statement()
        return None

    def s_break(self):
        if self.i < len(self.t) and self.t[self.i][0] == "name" and not self.t[self.i][2]:
            self.i += 1
        self.end()

    s_continue = s_break

    def sequence(self) -> tuple:
        first = self.assignment()
        if self.peek() != ",":
            return first
        items = [first]
        while self.take(","):
            items.append(self.assignment())
        return ("many", items)

    def assignment(self) -> tuple:
        self.depth += 1
        if self.depth > _MAX_DEPTH:
            raise Fault("depth")
        try:
            if self.arrow():
                return ("opaque",)
            left = self.conditional()
            if self.peek() in _ASSIGN:
                op = self.t[self.i][1]
                self.i += 1
                return ("assign", op, left, self.assignment())
            return left
        finally:
            self.depth -= 1

    def arrow(self) -> bool:
        start = self.i
        self.take("async")
        try:
            if self.peek() == "(":
                self.balanced()
            elif self.i < len(self.t) and self.t[self.i][0] == "name":
                self.i += 1
            else:
                raise Fault
            if self.take("=>"):
                if self.peek() == "{":
                    self.balanced()
                else:
                    self.assignment()
                return True
        except Fault:
            pass
        self.i = start
        return False

    def conditional(self) -> tuple:
        test = self.binary(1)
        if not self.take("?"):
            return test
        yes = self.assignment()
        self.need(":")
        return ("many", [test, yes, self.assignment()])

    def binary(self, least: int) -> tuple:
        left = self.unary()
        while (op := self.peek()) in _BINARY and _BINARY[op] >= least:
            self.i += 1
            right = self.binary(_BINARY[op] + (op != "**"))
            left = ("plus", left, right) if op == "+" else ("many", [left, right])
        return left

    def unary(self) -> tuple:
        if self.peek() in ("!", "~", "+", "-", "typeof", "void", "delete", "await", "++", "--"):
            update = self.peek() in ("++", "--")
            self.i += 1
            inner = self.unary()
            return ("opaque",) if update else ("many", [inner])
        if self.peek() == "yield":
            self.i += 1
            self.take("*")
            if self.peek() not in (")", "]", "}", ",", ";", None):
                self.assignment()
            return ("opaque",)
        e = self.postfix(self.primary())
        if self.peek() in ("++", "--") and not self.t[self.i][2]:
            self.i += 1
            return ("opaque",)
        return e

    def arguments(self) -> list[tuple]:
        self.need("(")
        return self.items(")")

    def items(self, close: str) -> list[tuple]:
        out = []
        while not self.take(close):
            if self.take(","):
                continue
            spread = self.take("...")
            e = self.assignment()
            out.append(("spread", e) if spread else e)
            if self.peek() != close:
                self.need(",")
        return out

    def postfix(self, e: tuple, calls: bool = True) -> tuple:
        while self.i < len(self.t):
            if self.take(".") or (self.peek() == "?." and self.peek(1) not in ("(", "[") and self.take("?.")):
                e = ("dot", e, self.t[self.i][1])
                self.i += 1
            elif self.peek() == "[" or (self.peek() == "?." and self.peek(1) == "["):
                self.take("?.")
                self.i += 1
                e = ("at", e, self.sequence())
                self.need("]")
            elif calls and (self.peek() == "(" or (self.peek() == "?." and self.peek(1) == "(")):
                self.take("?.")
                e = ("call", e, self.arguments())
            elif self.t[self.i][0] == "tmpl":
                self.primary()
                e = ("opaque",)
            else:
                break
        return e

    def primary(self) -> tuple:
        kind, value, _ = self.t[self.i]
        self.i += 1
        if kind == "str":
            return ("str", value)
        if kind == "num":
            return ("num", value)
        if kind == "tmpl":
            holes = []
            for h in value[1]:
                p = Parser(h)
                holes.append(p.sequence() if h else ("opaque",))
                self.faults += p.i < len(h)
            return ("tmpl", value[0], holes)
        if kind == "regex":
            return ("opaque",)
        if value == "(":
            e = self.sequence()
            self.need(")")
            return ("paren", e)
        if value == "[":
            return ("list", self.items("]"))
        if value == "{":
            return self.object()
        if kind == "name":
            if value == "function" or (value == "async" and self.peek() == "function"):
                self.i -= value == "function"
                return self.function(False)
            if value == "class":
                self.s_class()
                return ("opaque",)
            if value == "new":
                callee = self.postfix(self.primary(), calls=False)
                return ("new", callee, self.arguments() if self.peek() == "(" else [])
            if value in ("true", "false"):
                return ("bool", value)
            return ("id", value)
        raise Fault(value)

    def object(self) -> tuple:
        out = []
        while not self.take("}"):
            if self.take(","):
                continue
            if self.take("..."):
                self.assignment()
                continue
            while self.peek() in ("get", "set", "async", "static") and self.peek(1) not in (":", ",", "(", "}"):
                self.i += 1
            self.take("*")
            kind, key, _ = self.t[self.i]
            if key == "[" and kind == "op":
                self.balanced()
                key = None
            elif kind in ("name", "str", "num"):
                self.i += 1
            else:
                raise Fault("key")
            if self.take(":"):
                out.append((key if kind != "num" else None, self.assignment()))
            elif self.peek() == "(":
                self.balanced()
                self.balanced()
            elif kind == "name":
                out.append((key, ("id", key)))
                if self.take("="):
                    self.assignment()
            else:
                raise Fault("value")
            if self.peek() != "}":
                self.need(",")
        return ("object", out)


# Names of calls that fetch, and of properties that hold addresses.
CALL_NAMES = {"fetch", "open", "websocket", "eventsource", "request"}
CALL_PREFIXES = ("axios", "$.", "jquery.")
CALL_SUFFIXES = (".open", ".get", ".post", ".put", ".delete", ".patch", ".ajax", ".sendbeacon", ".navigate", ".push")
URL_KEYS = {"url", "uri", "endpoint", "path", "route", "action", "src", "href", "api", "target", "link", "download", "baseurl", "hostname", "host"}
RANK = {"jsluice-call": 4, "jsluice-property": 3, "jsluice-template": 2, "jsluice-variable": 2, "jsluice-assignment": 2}
_CANDIDATE = re.compile(r"(?:/|https?://|\./|\.\./)[^\n\r\t<>]*\Z")


def is_candidate(s: str) -> bool:
    s = s.strip()
    return bool(_CANDIDATE.match(s)) and len(s.encode("utf-8", "replace")) <= 1024


def _slashes(s: str) -> str:
    head, mark, rest = s.partition("://")
    if mark:
        return head + mark + re.sub("/+", "/", rest)
    return "//" + re.sub("/+", "/", s[2:]) if s.startswith("//") else re.sub("/+", "/", s)


def _fetches(callee: tuple) -> bool:
    parts = []
    while callee[0] == "dot":
        parts.append(callee[2])
        callee = callee[1]
    if callee[0] == "id":
        parts.append(callee[1])
    name = ".".join(reversed(parts)).lower()
    return name in CALL_NAMES or name.startswith(CALL_PREFIXES) or name.endswith(CALL_SUFFIXES)


def _number_text(raw: str) -> str:
    raw = raw.replace("_", "").rstrip("n")
    v = float(int(raw, 0)) if raw[:2].lower() in ("0x", "0b", "0o") else float(raw)
    return str(int(v)) if v.is_integer() and abs(v) < 1e16 else repr(v)


class Walk:
    """Folds constants and yields (text, label) in order of the source."""

    def __init__(self):
        self.known: dict[str, str] = {}

    def value(self, e: tuple) -> str | None:
        kind = e[0]
        if kind == "str" or kind == "bool":
            return e[1]
        if kind == "num":
            return _number_text(e[1])
        if kind == "id":
            return self.known.get(e[1])
        if kind == "paren":
            return self.value(e[1])
        if kind == "plus":
            a, b = self.value(e[1]), self.value(e[2])
            return None if a is None or b is None else a + b
        if kind == "tmpl":
            holes = [self.value(h) or "" for h in e[2]]
            joined = "".join(x for pair in zip(e[1], [*holes, ""], strict=True) for x in pair)
            return _slashes(joined) if joined else None
        return None

    def labelled(self, e: tuple, label: str) -> Iterator[tuple[str, str]]:
        v = self.value(e)
        if v is not None:
            yield v, label

    def statements(self, items: list[tuple | None]) -> Iterator[tuple[str, str]]:
        for s in items:
            if not s:
                continue
            kind = s[0]
            if kind == "declare":
                for name, init in s[1]:
                    if init:
                        yield from self.expression(init)
                        v = self.value(init)
                        if v is not None:
                            if name:
                                self.known[name] = v
                            yield v, "jsluice-variable"
            elif kind in ("block", "function"):
                yield from self.statements(s[1] if kind == "block" else [s[1]])
            elif kind == "expr":
                yield from self.expression(s[1])
            elif kind == "if":
                yield from self.expression(s[1])
                yield from self.statements([s[2], s[3]])
            elif kind == "loop":
                yield from self.expression(s[1])
                yield from self.statements([s[2]])
            elif kind == "body":
                yield from self.statements([s[1]])

    def expression(self, e: tuple) -> Iterator[tuple[str, str]]:
        kind = e[0]
        if kind == "str":
            yield e[1], "jsluice-literal"
        elif kind == "tmpl":
            for h in e[2]:
                yield from self.expression(h)
            yield e[1][0], "jsluice-template"
            yield from self.labelled(e, "jsluice-template")
        elif kind in ("call", "new"):
            yield from self.expression(e[1])
            label = "jsluice-call" if kind == "new" or _fetches(e[1]) else "jsluice-literal"
            for a in e[2]:
                if a[0] != "spread":
                    yield from self.expression(a)
                    yield from self.labelled(a, label)
        elif kind == "object":
            for key, v in e[1]:
                yield from self.expression(v)
                yield from self.labelled(v, "jsluice-property" if key and key.lower() in URL_KEYS else "jsluice-literal")
        elif kind in ("list", "many"):
            for x in e[1]:
                if x[0] != "spread":
                    yield from self.expression(x)
        elif kind == "assign":
            yield from self.expression(e[3])
            v = self.value(e[3])
            if v is not None:
                if e[2][0] == "id":
                    self.known[e[2][1]] = v
                yield v, "jsluice-assignment"
        elif kind == "plus":
            yield from self.expression(e[1])
            yield from self.expression(e[2])
            yield from self.labelled(e, "jsluice-variable")
        elif kind == "paren" or kind == "dot":
            yield from self.expression(e[1])
        elif kind == "at":
            yield from self.expression(e[1])
            yield from self.expression(e[2])


def by_syntax(script: str) -> tuple[dict[str, str], int]:
    """Candidates in order of discovery with their best label, and the number of faults."""
    try:
        p = Parser(tokens(script))
        program = p.program()
    except (Fault, RecursionError):
        return {}, 1
    best: dict[str, str] = {}
    for s, label in Walk().statements(program):
        if is_candidate(s):
            s = s.strip()
            if s not in best or RANK.get(label, 1) > RANK.get(best[s], 1):
                best[s] = label
    return best, p.faults


def _compiled(p: str) -> re.Pattern:
    return re.compile(p)


_PATTERNS = [(_compiled(T.CALL), "jsluice-call"), (_compiled(T.PROPERTY), "jsluice-property"), (_compiled(T.TEMPLATE), "jsluice-template"), (_compiled(T.RELATIVE_ENDPOINT), "jsluice-regex")]


def by_pattern(script: str) -> dict[str, str]:
    best: dict[str, str] = {}
    for p, label in _PATTERNS:
        for m in p.finditer(f" {script} " if label == "jsluice-regex" else script):
            s = (re.sub(T.HOLE, "", m.group(1)) if label == "jsluice-template" else m.group(1)).strip()
            if is_candidate(s):
                best.setdefault(s, label)
    return best


def endpoints(base: str, script: str) -> list[tuple[str, str]]:
    """(absolute URL, label) of a script, by syntax and, where that falls short, by patterns."""
    b = parse(base)
    if b is None:
        return []
    found: dict[str, str] = {}
    best, faults = by_syntax(script)
    for s, label in best.items():
        u = parse(s, b)
        if u:
            found.setdefault(str(u), label)
    if faults or not found:
        for s, label in by_pattern(script).items():
            u = parse(s, b)
            if u:
                found.setdefault(str(u), label)
    return list(found.items())


@arrow_function("array<struct<url:string,attribute:string>>")
def js_endpoints(base: pa.Array, script: pa.Array) -> pa.Array:
    rows = [[{"url": u, "attribute": a} for u, a in endpoints(b, s)] if b and s else [] for b, s in zip(base.to_pylist(), script.to_pylist(), strict=True)]
    return pa.array(rows, pa.list_(pa.struct([("url", pa.string()), ("attribute", pa.string())])))
