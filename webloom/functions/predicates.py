"""Filters of a crawl as boolean Columns."""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Extensions, Policy, Scope
from . import urls
from .udf import arrow_function

# Endings that are not followed unless asked for.
DENIED_EXTENSIONS = (
    ".3g2 .3gp .7z .apk .arj .avi .axd .bmp .csv .deb .dll .doc .drv .eot .exe .flv .gif .gifv .gz .h264 .ico .iso .jar "
    ".jpeg .jpg .lock .m4a .m4v .map .mkv .mov .mp3 .mp4 .mpeg .mpg .msi .ogg .ogm .ogv .otf .pdf .pkg .png .ppt .psd .rar "
    ".rm .rpm .svg .swf .sys .tar.gz .tar .tif .tiff .ttf .txt .vob .wav .webm .webp .wmv .woff .woff2 .xcf .xls .xlsx .zip"
).split()

# Fixed value: URLs that end a session.
LOGOUT = (
    r"(?i)(log[\s_-]?out|sign[\s_-]?out|signout|deconnexion|cerrar[\s_-]?sesion|sair|abmelden|uitloggen|ausloggen|disconnect|"
    r"terminate|end[\s_-]?session|salir|desconectar|afmelden|wyloguj|sign[\s_-]?off)"
)

#: Names of widely used public script packages; one of them anywhere before ``.js`` marks a vendor file.
VENDOR_PACKAGES = (
    "jquery angular react vue ember backbone knockout svelte preact lodash underscore moment dayjs bootstrap foundation materialize semantic "
    "modernizr require requirejs systemjs webpack polyfill core-js regenerator babel d3 chart highcharts echarts three pixi leaflet mapbox "
    "gsap anime velocity scrollmagic swiper slick flickity owl.carousel isotope masonry select2 chosen datatables handlebars mustache "
    "socket.io sockjs axios superagent rxjs redux mobx zepto mootools prototype dojo yui ext-all tinymce ckeditor codemirror ace highlight "
    "prism marked popper tippy fontawesome google-analytics gtag gtm analytics hotjar segment sentry stripe recaptcha hcaptcha"
).split()
VENDOR = r"(?i)(" + "|".join(re.escape(p) for p in VENDOR_PACKAGES) + r")[a-z0-9._-]*\.js"

IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\z"
#: Deny items that are a host's name or address and no pattern.
HOST_NAME = re.compile(r"[\w-]+(\.[\w-]+)*\.?|\[?[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]?")
CYCLE = r"(?s)(.{10,})\1{9}"
CYCLE_BYTES = 2_097_152
HREF_REJECTED = ("#", "data:", "javascript:", "mailto:", "vbscript:")


def java_pattern(pattern: str) -> str | None:
    """A pattern as the JVM takes it (named groups in its form), or None if it does not compile there."""
    from pyspark.sql import SparkSession

    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m.group(1).replace('_', '')}>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m.group(1).replace('_', '')}>", pattern)
    jvm = SparkSession.active()._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return None
    return pattern


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def is_ip(host: Column) -> Column:
    return host.rlike(IPV4) | (host.contains(":") & host.rlike(r"^\[?[0-9a-fA-F:.]+\]?\z"))


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^\[|\]\z", "")


def dns_scope(host: Column, root: Column, mode: str) -> Column:
    if mode not in ("rdn", "dn", "fqdn"):
        return host.rlike(mode)
    h, r = _bare(host), _bare(root)
    same = h == r
    if mode == "fqdn":
        return same
    if mode == "dn":
        wide = F.contains(h, urls.domain_keyword(r))
    else:
        domain = urls.registrable_domain(r)
        wide = (h == domain) | F.endswith(h, F.concat(F.lit("."), domain))
    return F.when(is_ip(h) | is_ip(r), same).otherwise(wide)


def url_scope(url: Column, scope: Scope) -> Column:
    inside = any_of(url, scope.in_patterns) if scope.in_patterns else F.lit(True)
    return ~any_of(url, scope.out_patterns) & inside


def in_scope(url: Column, root: Column, scope: Scope, host: Column | None = None) -> Column:
    """``host``: the URL's host, where it is known already."""
    host = urls.host(url) if host is None else host
    dns = F.lit(True) if scope.no_scope else dns_scope(host, root, scope.field_scope)
    return (host != "") & dns & url_scope(url, scope)


def is_private_ipv4(host: Column) -> Column:
    p = F.split(host, r"\.")
    a, b = F.try_element_at(p, F.lit(1)).try_cast("int"), F.try_element_at(p, F.lit(2)).try_cast("int")
    # Ranges that are not public.
    inner = (
        (a == 127) | host.isin("0.0.0.0", "255.255.255.255") | (a >= 240) | (a == 10) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    )
    return F.coalesce(host.rlike(IPV4) & inner, F.lit(False))


def private_v6(text: str) -> bool:
    try:
        ip = ipaddress.IPv6Address(text.strip("[]"))
    except ValueError:
        return False
    if ip.ipv4_mapped is not None:
        v4 = ip.ipv4_mapped
        nets = ("127.0.0.0/8", "0.0.0.0/32", "255.255.255.255/32", "240.0.0.0/4", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "100.64.0.0/10")
        return any(v4 in ipaddress.IPv4Network(n) for n in nets)
    return str(ip) in ("::1", "::") or any(ip in ipaddress.IPv6Network(n) for n in ("fc00::/7", "fe80::/10"))


@arrow_function("boolean")
def is_private_ipv6(host: pa.Array) -> pa.Array:
    return pa.array([h is not None and private_v6(h) for h in host.to_pylist()], pa.bool_())


def policy_allows(host: Column, policy: Policy, with_v6: bool = False, whole_names: bool = False) -> Column:
    """Host names and addresses that a network policy lets through. ``with_v6`` adds IPv6 ranges by an Arrow UDF.

    An item of the deny list is a host and an unanchored pattern at once, so ``m.a.org`` also
    denies ``farm.a.org`` and ``www.m.a.org``; with ``whole_names`` host names and addresses
    among the items deny that host only.
    """
    deny = [d.strip() for d in policy.deny if d.strip()]
    private = policy.exclude_private or any(d.lower() == "private-ips" for d in deny)
    deny = [d for d in deny if d.lower() != "private-ips"]
    h = _bare(host)
    bad = F.lit(False)
    if private:
        bad = bad | is_private_ipv4(h) | h.isin("localhost", "::1") | F.endswith(h, F.lit(".localhost"))
        if with_v6:
            bad = bad | is_private_ipv6(F.when(h.contains(":"), h))
    if deny:
        bad = bad | h.isin(*[d.lower().strip("[]") if whole_names and HOST_NAME.fullmatch(d) else d.lower() for d in deny])
    for d in deny:
        d = None if whole_names and HOST_NAME.fullmatch(d) else java_pattern(d)
        if d is not None:
            bad = bad | h.rlike(d)
    return ~bad


def extension_of(path: Column) -> Column:
    last = F.substring_index(F.lower(path), "/", -1)
    return F.when(last.endswith(".tar.gz"), ".tar.gz").otherwise(F.regexp_extract(last, r"(\.[^.]*)\z", 1))


def extension_allows(path: Column, ext: Extensions) -> Column:
    norm = lambda e: (e := e.strip().lower()) and (e if e.startswith(".") else "." + e)
    e = extension_of(path)
    if ext.match:
        return e.isin(*[norm(x) for x in ext.match])
    denied = [*(DENIED_EXTENSIONS if ext.use_defaults else ()), *(norm(x) for x in ext.deny)]
    return ~e.isin(*denied) if denied else F.lit(True)


def is_logout(url: Column) -> Column:
    return url.rlike(LOGOUT)


def is_cycle(url: Column) -> Column:
    n = F.octet_length(url)
    return (n > CYCLE_BYTES) | ((n >= 100) & url.rlike(CYCLE))


def href_candidate(href: Column) -> Column:
    """Trimmed reference, or null if it leads nowhere."""
    h = F.regexp_replace(href, r"^\s+|\s+\z", "")
    bad = h == ""
    for p in HREF_REJECTED:
        bad = bad | h.startswith(p)
    return F.when(~bad, h)


def is_js_candidate(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+\z", "")
    return t.rlike(r"^(/|https?://|\./|\.\./)[^\n\r\t<>]*\z") & (F.octet_length(t) <= 1024)


def is_vendor_script(path: Column) -> Column:
    return path.rlike(VENDOR)


def is_script(final_url: Column, content_type: Column) -> Column:
    return final_url.endswith(".js") | final_url.endswith(".css") | F.coalesce(F.contains(content_type, F.lit("/javascript")), F.lit(False))


def is_throttled(status: Column) -> Column:
    return status.isin(429, 503)


def output_kept(url: Column, match: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> Column:
    return (any_of(url, match) if match else F.lit(True)) & ~any_of(url, drop)
