"""Extractors on page and script text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import predicates

# Patterns of endpoints.
LOC = r"(?i)<loc>\s*([^<]+)\s*</loc>"
SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script>"
ENDINGS = r"(?:aspx?|action|cfm|cgi|do|pl|css|x?html?|js(?:p|on)?|pdf|php5?|py|rss)"
BODY_ENDPOINT = (
    r"(?i)(?:((?:[\.]{1,2}/[A-Za-z0-9\-_/\\?&@\.?=%]+)"
    r"|(https?://[A-Za-z0-9_\-\.]+(?:[\.]{0,2})?/[A-Za-z0-9\-_/\\?&@\.?=%]+)"
    r"|(/[A-Za-z0-9\-_/\\?&@\.%]+\." + ENDINGS + r")"
    r"|([A-Za-z0-9\-_?&@\.%]+/[A-Za-z0-9/\\\-_?&@\.%]+\." + ENDINGS + r")))"
)
RELATIVE_ENDPOINT = (
    r"""(?i)(?:"|'|\s)((?:(https?://[A-Za-z0-9_\-.]+(?:\:\d{1,5})?)+([\.]{1,2})?/[A-Za-z0-9/\-_\\.%]+(?:[\?|#][^"']+)?)"""
    r"""|((\.{1,2}/)?[a-zA-Z0-9\-_/\\%]+\.(?:aspx?|js(?:on|p)?|html|php5?|action|do)(?:[\?|#][^"']+)?)"""
    r"""|((\.{0,2}/)[a-zA-Z0-9\-_/\\%]+(?:/|\\)[a-zA-Z0-9\-_]{3,}(?:[\?|#][^"']+)?)"""
    r"""|((\.{0,2})[a-zA-Z0-9\-_/\\%]{3,}/))(?:"|'|\s)"""
)
CALL = r"""(?i)(?:fetch|\$\.(?:get|post|ajax)|axios(?:\.(?:get|post|put|delete|patch))?|open|WebSocket|EventSource)\s*\(\s*["'`]([^"'`]+)["'`]"""
PROPERTY = r"""(?i)(?:url|endpoint|path|route|action|uri|src|href)\s*:\s*["'`]([^"'`]+)["'`]"""
TEMPLATE = r"`(/[^`]+)`"
HOLE = r"\$\{[^}]+\}"
STRIPPED = (
    (r"(?is)<script\b[^>]*>.*?</script>", ""),
    (r"(?is)<style\b[^>]*>.*?</style>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"""(?i)\b(?:csrf|nonce|token|timestamp|_t|_ts|auth|session|sig)\s*=\s*["'][^"']*["']""", ""),
    (r"\s+", " "),
)
A_HREF = r'(?i)<a\s[^>]*?href="([^"]*)"'


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def capped_body(body: Column, n_bytes: int) -> Column:
    """The first bytes of a body; a cut character becomes U+FFFD."""
    return F.make_valid_utf8(F.substring(F.encode(body, "UTF-8"), 1, n_bytes).cast("string"))


def anchors(html: Column) -> Column:
    """Values of double-quoted ``a[href]``, natively; see functions.html for the full parser."""
    return all_of(html, A_HREF)


def robots_values(text: Column) -> Column:
    """Paths of allow and disallow lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", ""))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))

    def wanted(x: Column) -> Column:
        name = F.lower(trimmed(F.substring_index(x, ":", 1)))
        return (name.startswith("allow") | (name == "disallow")) & (trimmed(F.regexp_extract(x, r"^[^:]*:(.*)", 1)) != "")

    return F.transform(F.filter(lines, wanted), lambda x: trimmed(F.regexp_extract(x, r"^[^:]*:(.*)", 1)))


def sitemap_values(text: Column) -> Column:
    return F.filter(F.transform(all_of(text, LOC), trimmed), lambda x: x != "")


def inline_scripts(html: Column) -> Column:
    return F.filter(F.transform(all_of(html, SCRIPT), trimmed), lambda x: x != "")


def body_endpoints(text: Column) -> Column:
    return F.array_distinct(all_of(text, BODY_ENDPOINT))


def relative_endpoints(text: Column) -> Column:
    return F.array_distinct(all_of(F.concat(F.lit(" "), text, F.lit(" ")), RELATIVE_ENDPOINT))


def js_candidates(script: Column) -> Column:
    """Array of (url, attribute) in order of discovery; the first label of a text counts."""

    def labelled(values: Column, label: str) -> Column:
        return F.transform(F.filter(F.transform(values, trimmed), predicates.is_js_candidate), lambda v: F.struct(v.alias("url"), F.lit(label).alias("attribute")))

    templates = F.transform(all_of(script, TEMPLATE), lambda t: F.regexp_replace(t, HOLE, ""))
    found = F.concat(
        labelled(all_of(script, CALL), "jsluice-call"),
        labelled(all_of(script, PROPERTY), "jsluice-property"),
        labelled(templates, "jsluice-template"),
        labelled(relative_endpoints(script), "jsluice-regex"),
    )
    urls = F.transform(found, lambda x: x["url"])
    return F.filter(found, lambda x, i: F.array_position(urls, x["url"]) == i + 1)


def strip_dom(html: Column) -> Column:
    for pattern, by in STRIPPED:
        html = F.regexp_replace(html, pattern, by)
    return trimmed(html)


def custom_field(headers: Column | None, body: Column, patterns: tuple[str, ...], group: int = 0, part: str = "response") -> Column:
    """Sorted distinct matches of a field's patterns. Part ``header`` looks at ``name: value`` lines, all else at the body."""
    text = body
    if part.lower() in ("header", "headers"):
        text = F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    found = F.flatten(F.array(*[all_of(text, p, group) for p in patterns]))
    return F.array_sort(F.array_distinct(F.filter(found, lambda v: v != "") if group else found))


#: The field that is there without a configuration.
EMAIL_FIELD = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
