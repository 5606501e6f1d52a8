"""URL operators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of two labels that the registrable domain knows.
TWO_LABEL_SUFFIXES = ("co.uk", "com.au", "ac.id", "co.id", "gov.uk", "org.uk")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(authority(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    """The port as text, empty if it is none or the scheme's own."""
    p = F.regexp_extract(authority(url), r":0*([0-9]+)\z", 1)
    s = scheme(url)
    own = (s.isin("http", "ws") & (p == "80")) | (s.isin("https", "wss") & (p == "443")) | ((s == "ftp") & (p == "21"))
    return F.when(own, F.lit("")).otherwise(p)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)", 1)


def query(url: Column) -> Column:
    """The query; null if there is none."""
    return F.when(url.rlike(r"^[^?#]*\?"), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))


def site(url: Column) -> Column:
    """Scheme, host and port, without credentials."""
    p = port(url)
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(p == "", F.lit("")).otherwise(F.concat(F.lit(":"), p)))


def _form_decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def query_keys(url: Column) -> Column:
    """Decoded keys in order, with repeats."""
    pairs = F.filter(F.split(F.coalesce(query(url), F.lit("")), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: _form_decoded(F.substring_index(p, "=", 1)))


def dedup_key(method: Column, url: Column, body: Column) -> Column:
    plain = F.coalesce(F.upper(method), F.lit("")).isin("", "GET")
    return F.when(plain, url).otherwise(F.concat(url, F.lit(":"), F.coalesce(body, F.lit(""))))


def has_hex_letter(text: Column) -> Column:
    return text.rlike("[a-fA-F]")


def normal_segment(segment: Column) -> Column:
    """A path segment, or the placeholder for its kind of identifier."""
    s = F.replace(F.replace(segment, F.lit("%7B"), F.lit("{")), F.lit("%7D"), F.lit("}"))
    hexes = has_hex_letter(s)
    # Patterns and placeholders, the first that fits counts.
    out = F.when(s.startswith("{") & s.endswith("}"), s)
    out = out.when(s.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"), "{uuid}")
    for n, name in ((64, "{sha256}"), (40, "{sha1}"), (32, "{md5}"), (24, "{oid}")):
        out = out.when(s.rlike(rf"^[0-9a-fA-F]{{{n}}}\z") & hexes, name)
    out = out.when(s.rlike(r"^[0-9a-fA-F]{8,}\z") & hexes, "{hex}")
    out = out.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), "{date}")
    out = out.when(s.rlike(r"^[0-9]{10}([0-9]{3})?\z"), "{ts}")
    return out.when(s.rlike(r"^[0-9]+\z"), "{num}").otherwise(s)


def is_identifier(segment: Column) -> Column:
    return normal_segment(segment).rlike(r"^\{.*\}\z")


def raw_path(url: Column) -> Column:
    """The path as written: from the first slash after the scheme, else the first ``?`` or ``#``, up to a query or else a fragment."""
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    tail = (
        F.when(rest.contains("/"), F.regexp_extract(rest, r"(?s)^[^/]*(.*)", 1))
        .when(rest.contains("?"), F.regexp_extract(rest, r"(?s)^[^?]*(.*)", 1))
        .when(rest.contains("#"), F.regexp_extract(rest, r"(?s)^[^#]*(.*)", 1))
        .otherwise(F.lit(""))
    )
    return F.when(tail.contains("?"), F.substring_index(tail, "?", 1)).otherwise(F.substring_index(tail, "#", 1))


def segments(url: Column) -> Column:
    """Segments of the raw path with identifiers replaced; empty for an empty path or the root."""
    trimmed = F.regexp_replace(raw_path(url), r"^/+|/+\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(trimmed, "/"), normal_segment))


def fingerprint(url: Column, with_segments: Column | None = None) -> Column:
    """Structure of a URL: identifiers become placeholders, the query its sorted distinct keys, the fragment goes."""
    p = raw_path(url)
    body = F.concat(F.lit("/"), F.array_join(segments(url) if with_segments is None else with_segments, "/"), F.when(p.endswith("/"), F.lit("/")).otherwise(F.lit("")))
    keys = F.array_sort(F.array_distinct(query_keys(url)))
    asked = F.when(F.size(keys) > 0, F.concat(F.lit("?"), F.array_join(keys, "&"))).otherwise(F.lit(""))
    whole = F.concat(site(url), F.when(p.isin("", "/"), p).otherwise(body), asked)
    return F.when(host(url) == "", url).otherwise(whole)


def _form_encoded(text: Column) -> Column:
    return F.url_encode(text)


def blank_query_values(url: Column, value: str = "") -> Column:
    """Every query value replaced; keys keep their order and repeats."""
    pairs = F.array_join(F.transform(query_keys(url), lambda k: F.concat(_form_encoded(k), F.lit("=" + value))), "&")
    head, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)\z", 1)
    return F.when(query(url).isNull(), url).otherwise(F.concat(head, F.lit("?"), pairs, tail))


def parent_paths(url: Column) -> Column:
    """Folders above the path, longest first, without the root."""
    parts = F.split(F.regexp_replace(path(url), r"^/+|/+\z", ""), "/")
    n = F.size(parts)
    up = F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.concat(site(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when((n > 1) & (host(url) != ""), up).otherwise(F.array().cast("array<string>"))


def registrable_domain(name: Column) -> Column:
    h = F.regexp_replace(name, r"^\.+|\.+\z", "")
    labels = F.split(h, r"\.")
    last = lambda k: F.substring_index(h, ".", -k)
    return F.when(F.size(labels) < 2, h).when(last(2).isin(*TWO_LABEL_SUFFIXES) & (F.size(labels) >= 3), last(3)).otherwise(last(2))


def domain_keyword(name: Column) -> Column:
    return F.substring_index(registrable_domain(name), ".", 1)


def extension(name: Column) -> Column:
    e = F.lower(F.trim(name))
    return F.when((e == "") | e.startswith("."), e).otherwise(F.concat(F.lit("."), e))


def single_slashes(text: Column) -> Column:
    """Runs of slashes become one, but for that after a scheme and a leading pair."""
    one = lambda c: F.regexp_replace(c, "/+", "/")
    after = lambda mark: F.substring(text, F.instr(text, mark) + F.lit(len(mark)), F.length(text))
    return (
        F.when(text.contains("://"), F.concat(F.substring_index(text, "://", 1), F.lit("://"), one(after("://"))))
        .when(text.startswith("//"), F.concat(F.lit("//"), one(F.substring(text, F.lit(3), F.length(text)))))
        .otherwise(one(text))
    )


def root_relative(page: Column, href: Column) -> Column:
    """Native resolution of ``/path`` references whose characters are letters, digits, ``,``, ``.``, ``-``, ``_`` and ``/``."""
    encoded = F.replace(F.replace(F.url_encode(href), F.lit("%2F"), F.lit("/")), F.lit("%2C"), F.lit(","))
    return F.concat(site(page), encoded)


def form_request(action_url: Column, method: Column, parameters: Column, value_of) -> Column:
    """The request that a form would make; only the row is built."""
    payload = F.array_join(F.transform(parameters, lambda p: F.concat(p, F.lit("="), value_of(p))), "&")
    post = F.upper(method) == "POST"
    joined = F.when(payload == "", action_url).otherwise(F.concat(action_url, F.when(action_url.contains("?"), F.lit("&")).otherwise(F.lit("?")), payload))
    return F.struct(
        F.when(post, F.lit("POST")).otherwise(F.lit("GET")).alias("method"),
        F.when(post, action_url).otherwise(joined).alias("url"),
        F.when(post, payload).otherwise(F.lit("")).alias("body"),
    )
