"""One pass over a page: links, inline scripts and forms, as an Arrow UDF.

The standard library's tokenizer feeds a few rules of tree construction that
change the output: cells outside a table and frames outside a frame set go, an
``image`` outside SVG is an ``img``, content of ``template`` and ``noscript`` is
kept apart, nested forms are ignored.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F

from .predicates import HREF_REJECTED
from .simhash import split_words
from .whatwg import Url, parse
from .udf import arrow_function

# Selector, attribute; in this order.
LINK_PLACES = (
    ("a", "href"), ("a", "ping"), ("link[href]", "href"), ("script[src]", "src"), ("iframe", "src"), ("frame", "src"), ("embed", "src"),
    ("img", "src"), ("img", "dynsrc"), ("img", "longdesc"), ("img", "lowsrc"), ("video", "src"), ("video", "poster"), ("track", "src"),
    ("audio", "src"), ("source", "src"), ("body", "background"), ("table", "background"), ("td", "background"), ("blockquote", "cite"),
    ("area", "ping"), ("button", "formaction"), ("object", "data"), ("object", "codebase"), ("applet", "archive"), ("applet", "codebase"),
    ("html", "manifest"), ("image", "href"), ("[hx-get]", "hx-get"), ("[hx-post]", "hx-post"), ("[hx-put]", "hx-put"), ("[hx-patch]", "hx-patch"),
)
_METHODS = {"hx-post": "POST", "hx-put": "PUT", "hx-patch": "PATCH"}
_BY_TAG: dict[str, list[int]] = {}
for _i, (_s, _a) in enumerate(LINK_PLACES):
    _BY_TAG.setdefault(_s.partition("[")[0], []).append(_i)


class Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str]] = []
        self.sets: list[tuple[int, str]] = []
        self.scripts: list[str] = []
        self.forms: list[dict] = []
        self.form: dict | None = None
        self.text: list[str] | None = None
        self.tables = self.framesets = self.svg = self.apart = 0

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag in ("template", "noscript"):
            self.apart += 1
            return
        if self.apart:
            return
        self.tables += tag == "table"
        self.framesets += tag == "frameset"
        self.svg += tag == "svg"
        if (tag in ("td", "th") and not self.tables) or (tag == "frame" and not self.framesets):
            return
        if tag == "image" and not self.svg:
            tag = "img"
        for i in (*_BY_TAG.get(tag, ()), *_BY_TAG[""]):
            name = LINK_PLACES[i][1]
            if LINK_PLACES[i][0].startswith("[") and name not in a:
                continue
            if name in a:
                self.found.append((i, a[name]))
            if "srcset" in a:
                self.sets += [(i, words[0]) for part in a["srcset"].split(",") if (words := split_words(part))]
        if tag == "script":
            self.text = []
        elif tag == "form" and self.form is None:
            self.form = {"action": a.get("action", ""), "method": (a.get("method") or "GET").upper(), "enctype": a.get("enctype") or "application/x-www-form-urlencoded", "parameters": []}
            self.forms.append(self.form)
        elif tag in ("input", "select", "textarea") and self.form is not None and a.get("name", "").strip():
            self.form["parameters"].append(a["name"])

    def handle_endtag(self, tag):
        if tag in ("template", "noscript"):
            self.apart = max(0, self.apart - 1)
        elif not self.apart:
            self.tables -= tag == "table" and self.tables > 0
            self.framesets -= tag == "frameset" and self.framesets > 0
            self.svg -= tag == "svg" and self.svg > 0
            if tag == "script" and self.text is not None:
                if s := "".join(self.text).strip():
                    self.scripts.append(s)
                self.text = None
            elif tag == "form":
                self.form = None

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


def _link(base: Url, place: int, ref: str, attribute: str) -> dict | None:
    ref = ref.strip()
    u = parse(ref, base) if ref and not ref.startswith(HREF_REJECTED) else None
    return {"method": _METHODS.get(attribute, "GET"), "url": str(u), "tag": LINK_PLACES[place][0], "attribute": attribute} if u else None


def parse_page(base: str | None, html: str | None) -> dict:
    """links (distinct, by selector and then in document order), scripts and forms of a page."""
    p = Page()
    p.feed(html or "")
    p.close()
    b = parse(base) if base else None
    links: dict[tuple, dict] = {}
    if b is not None:
        both = [(i, 0, r, LINK_PLACES[i][1]) for i, r in p.found] + [(i, 1, r, "srcset") for i, r in p.sets]
        for i, _, ref, attribute in sorted(both, key=lambda x: x[:2]):
            x = _link(b, i, ref, attribute)
            if x:
                links.setdefault(tuple(x.values()), x)
    return {"links": list(links.values()), "scripts": p.scripts, "forms": p.forms}


_LINK = pa.struct([(n, pa.string()) for n in ("method", "url", "tag", "attribute")])
_FORM = pa.struct([("action", pa.string()), ("method", pa.string()), ("enctype", pa.string()), ("parameters", pa.list_(pa.string()))])
_PAGE = pa.struct([("links", pa.list_(_LINK)), ("scripts", pa.list_(pa.string())), ("forms", pa.list_(_FORM))])


@arrow_function(
    "struct<links:array<struct<method:string,url:string,tag:string,attribute:string>>,scripts:array<string>,"
    "forms:array<struct<action:string,method:string,enctype:string,parameters:array<string>>>>"
)
def page_parts(base: pa.Array, html: pa.Array) -> pa.Array:
    """Links, scripts and forms of each page; each page is read once."""
    return pa.array([parse_page(b, h) for b, h in zip(base.to_pylist(), html.to_pylist(), strict=True)], _PAGE)
