"""Literal rows for operators of which the driver's tables hold no case, and what is expected of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..config import Crawl, Limits, Policy, Scope


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """A SELECT over literal rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({columns})"


def golden(rows: list[tuple], columns: str, also: str | None = None) -> str:
    """SQL that gives the expected rows, and those of another SELECT if one is named."""
    return values(rows, columns) + (f" UNION ALL {also}" if also else "")


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


RESOLVED = [
    ("http://a/b/c/d?q", "../g", "http://a/b/g"),
    ("http://a/b/c/d", "g;x=1/./y", "http://a/b/c/g;x=1/y"),
    ("http://a/b", "//H.Com:80/x", "http://h.com/x"),
    ("http://a/b", "http:foo", "http://a/foo"),
    ("https://ex.com/a", "\\x\\y", "https://ex.com/x/y"),
    ("https://ex.com/", "/für,x y", "https://ex.com/f%C3%BCr,x%20y"),
    ("https://ex.com/a?b#c", "?z", "https://ex.com/a?z"),
    ("https://ex.com/a?b#c", "#n", "https://ex.com/a?b#n"),
    ("http://0x7f.1/", "/", "http://127.0.0.1/"),
    ("http://[::1]:8080/", "x", "http://[::1]:8080/x"),
    ("http://a/", "/a/b/../../../c/%2e%2E/d", "http://a/d"),
    ("http://a/", "http://b:99999/", None),
    ("not a url", "/x", None),
    ("https://u:p@Ex.com:443/a", "b", "https://u:p@ex.com/b"),
]

_H = "0123456789abcdef"
SEGMENTS = [
    ("123e4567-e89b-12d3-a456-426614174000", "{uuid}", True),
    (_H * 4, "{sha256}", True),
    ((_H * 3)[:40], "{sha1}", True),
    (_H * 2, "{md5}", True),
    ((_H * 2)[:24], "{oid}", True),
    ("DEADBEEF", "{hex}", True),
    ("1234567890" * 4, "{num}", True),
    ("2024-01-31", "{date}", True),
    ("1700000000", "{ts}", True),
    ("1700000000123", "{ts}", True),
    ("42", "{num}", True),
    ("%7Bid%7D", "{id}", True),
    ("about-us", "about-us", False),
    ("abc", "abc", False),
    ("12\n", "12\n", False),
    ("", "", False),
]

FINGERPRINTS = [
    ("https://Example.com", "https://example.com"),
    ("https://example.com/", "https://example.com/"),
    ("https://example.com:443/a/", "https://example.com/a/"),
    ("http://example.com:8080/users/42/posts/2024-01-31#frag", "http://example.com:8080/users/{num}/posts/{date}"),
    ("https://example.com/p?b=2&a=1&b=3", "https://example.com/p?a&b"),
    ("https://u:p@example.com/x//y/", "https://example.com/x//y/"),
    ("https://example.com?x=1", "https://example.com?x"),
    ("https://example.com/a?next=%2Fb%20c&t", "https://example.com/a?next&t"),
    ("https://example.com/%7Bid%7D/7", "https://example.com/{id}/{num}"),
    ("no url", "no url"),
    ("", ""),
]

SLASHES = [("https://a//b///c", "https://a/b/c"), ("//a//b", "//a/b"), ("/a//b", "/a/b"), ("a", "a"), ("", ""), ("///x", "///x")]

ROOTS = ["tionsh.example.net", "www.example.com", "example.org"]
POLICY = [
    ("127.0.0.1", False), ("10.1.2.3", False), ("172.16.0.1", False), ("172.32.0.1", True), ("192.168.1.1", False), ("169.254.0.9", False),
    ("100.64.0.1", False), ("100.128.0.1", True), ("0.0.0.0", False), ("0.0.0.1", True), ("255.255.255.255", False), ("241.1.1.1", False),
    ("8.8.8.8", True), ("localhost", False), ("[::1]", False), ("fc00::1", False), ("fe80::1", False), ("::ffff:10.0.0.1", False), ("2001:db8::1", True), ("999.1.1.1", True),
]

FILES = [
    "https://a.com/x.PNG", "https://a.com/y.tar.gz", "https://a.com/z.gz?x=.html", "https://a.com/w.php", "https://a.com/v.b/c", "https://a.com/u.", "https://a.com/t.woff2#.html",
]
SESSION_URLS = [
    "https://a.com/logout", "https://a.com/Log-Out?x", "https://a.com/sign_off", "https://a.com/user/deconnexion", "https://a.com/cerrar sesion", "https://a.com/login", "https://a.com/abmelden/",
]
SCRIPTS = [
    "https://a.com/js/jquery-3.7.1.min.js", "https://a.com/vendor/React-dom.production.js", "https://a.com/app.js", "https://a.com/bootstrap.bundle.min.js?v=1", "https://a.com/main.css",
]
CYCLES = [
    ("https://a.com/" + "abcdefghi/" * 10, True), ("https://a.com/" + "abcdefghi/" * 9, False), ("https://a.com/" + "abcde/" * 20, True), ("https://a.com/" + "x" * 99, False),
    ("https://a.com/" + "y" * 120, True), ("https://a.com/plain", False),
]
HREFS = [
    (" /a ", "/a", True), ("#x", None, False), ("javascript:f()", None, False), ("JavaScript:f()", "JavaScript:f()", False), ("mailto:a@b", None, False), ("data:x", None, False),
    ("", None, False), ("a/b", "a/b", False), ("./a", "./a", True), ("https://a.com/x", "https://a.com/x", True), ("/a<b", "/a<b", False), ("/" + "z" * 1024, "/" + "z" * 1024, False),
]

FUNNEL_ROWS = [
    (2_000_001, "nothing", 0), (2_000_002, "https://localhost/x", 0), (2_000_003, "http://127.0.0.1/y", 1), (2_000_004, "http://10.0.0.7/", 1), (2_000_005, "https://s.example.com/pic.jpeg", 0),
    (2_000_006, "https://s.example.com/logout", 0), (2_000_007, "https://s.example.com/deep", 3), (2_000_008, "https://s.example.com/p?utm_a=1", 1), (2_000_009, "https://s.example.com/p?utm_a=2", 1),
]

ROBOTS = "# about\nUser-agent: *\nDisallow: /private\n Allow : /open \nDisallow:\nallow-extra: /more\r\nCrawl-delay: 3\nDISALLOW: /x # y"
ROBOTS_EXPECTED = ["/private", "/open", "/more", "/x # y"]

SCRIPT_ROWS = [
    (9_000_001, "fetch('/api/users'); $.get(\"/v1/items\"); axios.post('/save')"),
    (9_000_002, "var c = {url: '/conf', endpoint: \"https://x.example.com/e\"}"),
    (9_000_003, "const p = `/users/${id}/posts`; new WebSocket('wss://x/y')"),
    (9_000_004, "see \"/admin/panel/settings\" or './lib/app.js' and https://site.example.com/path/page?x=1 end"),
    (9_000_005, "a/b.php ../up/x /static/site.css nothing"),
    (9_000_006, ""),
]

JS_SCRIPTS = [
    ("https://a.com/x/", "const b = '/api'; fetch(b + '/users'); var o = {url: '/o', k: './lit'}; x = '/assigned'; new WebSocket('/ws')"),
    ("https://b.com/", "if (a) { axios.post('/p', {path: '/q'}) } for (var i = 0; i < 2; i++) { fetch('/loop') } const f = () => fetch('/hidden'); function g() { return open('/g') }"),
    ("https://c.com/", "let r = /ab[/]c/g; y = b / c / d; list.push('/z'); t = `/t/${b}//u`"),
    ("https://d.com/", "x x x (( fetch('/m') "),
    ("https://e.com/", "var vendor = 1;"),
]
JS_EXPECTED = [
    ("https://a.com/x/", "https://a.com/api", "jsluice-variable"), ("https://a.com/x/", "https://a.com/users", "jsluice-literal"), ("https://a.com/x/", "https://a.com/api/users", "jsluice-call"),
    ("https://a.com/x/", "https://a.com/o", "jsluice-property"), ("https://a.com/x/", "https://a.com/x/lit", "jsluice-literal"), ("https://a.com/x/", "https://a.com/assigned", "jsluice-assignment"),
    ("https://a.com/x/", "https://a.com/ws", "jsluice-call"),
    ("https://b.com/", "https://b.com/p", "jsluice-call"), ("https://b.com/", "https://b.com/q", "jsluice-property"), ("https://b.com/", "https://b.com/loop", "jsluice-call"), ("https://b.com/", "https://b.com/g", "jsluice-call"),
    ("https://c.com/", "https://c.com/z", "jsluice-call"), ("https://c.com/", "https://c.com/t/", "jsluice-template"), ("https://c.com/", "https://c.com/t/u", "jsluice-template"),
    ("https://d.com/", "https://d.com/m", "jsluice-call"),
]

FORM_PAGES = [
    ("https://a.com/d/p", "<form action='/login' method=post><input name=user><input name=password type=password><button name=go></form><form action='s?x=1'><select name=q><textarea name=comment></textarea><input name=' '></form>"),
    ("https://b.com/", "<form><input name=email></form><p>none</p>"),
]
_URLENC = "application/x-www-form-urlencoded"
FORMS_EXPECTED = [("https://a.com/d/p", "/login", "POST", _URLENC, "user,password"), ("https://a.com/d/p", "s?x=1", "GET", _URLENC, "q,comment"), ("https://b.com/", "", "GET", _URLENC, "email")]
FORM_REQUESTS = [("POST", "https://a.com/login", "user=admin&password=Password123!"), ("GET", "https://a.com/d/s?x=1&q=example&comment=example_test", "")]

RAW_REQUESTS = [
    ("POST /a?b=c HTTP/1.1\r\nHost: x.com:81\r\nA: 1:2\r\n\r\nbody\r\nmore", True),
    ("get https://y.com/z HTTP/1.1\nhost: y.com\n\n", False),
    ("GET / HTTP/1.1\n\n", False),
    ("", True),
]
RAW_EXPECTED = [
    ("POST", "https://x.com:81/a?b=c", "body\nmore", "x.com:81", None),
    ("GET", "https://y.com/z", "", "y.com", None),
    (None, None, None, None, "no host"),
    (None, None, None, None, "bad request line"),
]

API_ROWS = [
    ("wss://a.com/s", "", ""), ("https://a.com/GraphQL", "", ""), ("https://a.com/x", "", "mutation { a }"), ("https://a.com/x.wsdl", "", ""), ("https://a.com/y", "text/xml", "<soap:Envelope>"),
    ("https://a.com/api/x", "", ""), ("https://a.com/v2/x", "application/json", ""), ("https://a.com/z", "Application/JSON; charset=utf-8", ""), ("https://a.com/w", "text/html", "Mutation {"),
]

# Put together here, so that no text of this file looks like a key.
_A = "A" * 40
SECRET_ROWS = [
    (9_000_001, "key AK" + "IA" + "ABCDEFGHIJKLMNOP and again AK" + "IA" + "ABCDEFGHIJKLMNOP."),
    (9_000_002, "gh" + "p_" + "a1" * 18 + " sk" + "_live_" + "b2" * 12 + " pk" + "_live_" + "c3" * 12),
    (9_000_003, "AI" + "za" + "x" * 35 + " https://hooks." + "slack.com/services/T1/B2/c3"),
    (9_000_004, "ey" + "J" + "a" * 12 + ".ey" + "J" + "b" * 12 + "." + "c" * 12 + " api" + '_key = "' + "d4" * 12 + '"'),
    (9_000_005, "nothing here: token " + _A),
]

TECH_ROWS = [
    (9_000_001, {"Server": "nginx/1.2", "X-Powered-By": "Express"}, ""),
    (9_000_002, {"set-cookie": "PHPSESSID=1; laravel_session=2", "CF-Ray": "x"}, "<p>"),
    (9_000_003, {}, '<meta name="generator" content="WordPress 6"><script src="/wp-content/jquery.js"></script><link href="/tailwind.css">'),
    (9_000_004, {}, '<meta content="Hugo 0.1" name="generator"><div data-reactroot></div><script src=https://www.googletagmanager.com/x.js></script>'),
    (9_000_005, {"x-drupal-cache": "HIT"}, None),
]
TECH_EXPECTED = [
    (9_000_001, "Express,Nginx,Node.js"),
    (9_000_002, "Cloudflare,Laravel,PHP"),
    (9_000_003, "PHP,Tailwind CSS,WordPress,jQuery"),
    (9_000_004, "Google Analytics,Hugo,React"),
    (9_000_005, "Drupal,PHP"),
]

SPA_ROWS = [
    (9_000_001, "text/html", '<body><div id="root"></div></body>'),
    (9_000_002, "", "<noscript>You need to enable JavaScript</noscript>"),
    (9_000_003, "TEXT/HTML", '<script src="/static/chunk-vendors.1.js"></script><p>Laden …</p>'),
    (9_000_004, "", '<script src="/react.js"></script><p>' + "long text " * 40 + "</p>"),
    (9_000_005, "application/json", '<div id="app"></div>'),
    (9_000_006, "", "<app-root ng-version='1'> </app-root>"),
]

CAPTCHA_ROWS = [
    (9_000_001, '<div class="h-captcha big" data-sitekey="hk-1"></div>'),
    (9_000_002, "<div data-sitekey='tk-2' class='x cf-turnstile'></div>"),
    (9_000_003, '<script src="https://www.google.com/recaptcha/api.js?render=v3key"></script>'),
    (9_000_004, '<script src="https://www.google.com/recaptcha/enterprise.js?render=entkey"></script>'),
    (9_000_005, '<script src="https://www.google.com/recaptcha/api.js?render=explicit"></script><div class="g-recaptcha" data-sitekey="v2key"></div>'),
    (9_000_006, '<i src="recaptcha/enterprise.js"><div class="g-recaptcha" data-sitekey="v2ent"></div>'),
    (9_000_007, '<b data-sitekey="' + "k" * 20 + '"></b>'),
    (9_000_008, '<b data-sitekey="short"></b>'),
]
CAPTCHA_EXPECTED = [
    (9_000_001, "hcaptcha", "hk-1"), (9_000_002, "turnstile", "tk-2"), (9_000_003, "recaptcha_v3", "v3key"), (9_000_004, "recaptcha_v3_enterprise", "entkey"),
    (9_000_005, "recaptcha_v2", "v2key"), (9_000_006, "recaptcha_v2_enterprise", "v2ent"), (9_000_007, "recaptcha_v2", "k" * 20), (9_000_008, None, None),
]
CAPTCHA_JSON = [
    (json.dumps({"provider": "HCaptcha", "sitekey": "a"}), "hcaptcha", "a"),
    (json.dumps({"provider": "turnstile", "sitekey": ""}), None, None),
    (json.dumps({"provider": "other", "sitekey": "b"}), None, None),
]

ROOT = "https://site.example.com/"
CRAWL = Crawl(scope=Scope("rdn"), policy=Policy(), limits=Limits(max_depth=3), js_crawl=True, known_files="all")
_KEY = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
_SITE = [
    ("/", 200, "text/html", {}, '<a href="/a">a</a><a href="/api/v1/list">api</a><a href="/img.png">i</a><a href="https://other.test/x">o</a><a href="/">self</a><script>fetch("/hidden-by-js")</script>', None),
    ("/a", 200, "text/html", {}, '<a href="b">b</a><a href="/missing">m</a>', None),
    ("/b", 200, "text/html", {}, '<a href="/c">c</a>', None),
    ("/c", 200, "text/html", {}, '<a href="/too-deep">d</a>', None),
    ("/too-deep", 200, "text/html", {}, "", None),
    ("/api/v1/list", 200, "application/json", {}, '{"k": "' + _KEY + '"}', None),
    ("/hidden-by-js", 200, "text/html", {}, "<p>found</p>", None),
    ("/robots.txt", 200, "text/plain", {}, "User-agent: *\nDisallow: /from-robots\n", None),
    ("/sitemap.xml", 200, "text/xml", {}, "<urlset><url><loc>/from-sitemap</loc></url></urlset>", None),
    ("/from-robots", 301, "text/html", {"Location": "/moved"}, "", None),
    ("/moved", 200, "text/html", {}, "ok", None),
    ("/from-sitemap", 200, "text/html", {}, '<a href="next">n</a>', ROOT + "folder/page"),
    ("/folder/page", 200, "text/html", {}, "target", None),
    ("/folder/next", 200, "text/html", {}, "relative to the final address", None),
]


def mini_site(spark: SparkSession) -> DataFrame:
    rows = [(ROOT[:-1] + p, *rest) for p, *rest in _SITE]
    return spark.createDataFrame(rows, "url string, status int, content_type string, headers map<string,string>, html string, final_url string")


CRAWL_EXPECTED = [
    (ROOT, 0, 200, "seed"),
    (ROOT + "a", 1, 200, "a"),
    (ROOT + "api/v1/list", 1, 200, "a"),
    (ROOT + "hidden-by-js", 1, 200, "script"),
    (ROOT + "b", 2, 200, "a"),
    (ROOT + "missing", 2, None, "a"),
    (ROOT + "c", 3, 200, "a"),
    (ROOT + "from-robots", 2, 301, "file"),
    (ROOT + "from-sitemap", 2, 200, "file"),
    (ROOT + "moved", 3, 200, "header"),
    (ROOT + "folder/page", 2, 200, "redirect"),
    (ROOT + "folder/next", 3, 200, "a"),
]
CRAWL_FINDINGS = [(u, "rest" if "/api/" in u else None, 1 if "/api/" in u else 0) for u, _, status, _ in CRAWL_EXPECTED if status is not None]

FUNNEL_PROBES = [
    (1, "http://[fd00::1]/", "network_policy"), (2, "http://[fe80::2]/", "network_policy"), (3, "http://2130706433/", "network_policy"), (4, "http://0x7f.1/", "network_policy"),
    (5, "http://exa mple.com/", "invalid"), (6, "http://a.example.com:99999/", "invalid"), (7, "not a url", "invalid"), (8, "http://a.example.com/x", None),
    (8, "http://a.example.com/x", "duplicate"), (9, "http://a.example.com/x", "duplicate"), (10, "http://u:p@a.example.com/y", None), (11, "http://10.0.0.1/", "network_policy"),
    (12, "http://[2001:db8::1]/", "out_of_scope"), (13, "http://EXAMPLE.com/z", None), (14, "http://other.test/", "out_of_scope"), (90, "http://other.test/seed", None),
    (91, "http://localhost/seed", "network_policy"),
]

# Exact tries with a threshold of three: values seen before a position is promoted stay, all later ones are parameters.
TRIE_ROWS = [("h", i, [v]) for i, v in enumerate("abcda", 1)] + [("h", 6, ["e", "x"]), ("k", 1, ["a"]), ("k", 2, ["b", "c"])]
TRIE_EXPECTED = [("h", 1, "a"), ("h", 2, "b"), ("h", 3, "c"), ("h", 4, "{param}"), ("h", 5, "{param}"), ("h", 6, "{param}/x"), ("k", 1, "a"), ("k", 2, "b/c")]

STATE_ROWS = [("a", 1, 0), ("a", 2, 1), ("a", 3, 7), ("a", 4, 15), ("a", 5, -1), ("a", 6, -2), ("b", 1, 1), ("b", 2, 1)]
STATE_EXPECTED = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, False), ("a", 5, True), ("a", 6, False), ("b", 1, True), ("b", 2, False)]

KINDS = [
    ("https://a.test/x.js", "text/html", 200, True, False, ".text/html"), ("https://a.test/x.css", "", 429, True, True, ""), ("https://a.test/x", "Application/javascript", 503, True, True, ".application/javascript"),
    ("https://a.test/x", " HTML", 404, False, False, ".html"), ("https://a.test/x.js?y", ".Js", 500, False, False, ".js"),
]

ARGUMENTS = [
    ("patterns", "a,b{1,2},[c,d]", "a|b{1,2}|[c,d]"), ("patterns", r"a\,b, c", r"a\,b|c"), ("patterns", "", ""), ("seconds", "10s", "10"), ("seconds", "5m", "300"), ("seconds", "2h", "7200"),
    ("seconds", "1d", "86400"), ("seconds", "7", "7"), ("header", "X-A: b:c", "X-A=b:c"), ("header", "none", "none"),
]

_PLACES = [
    ("a", "href"), ("a", "ping"), ("link", "href"), ("script", "src"), ("iframe", "src"), ("embed", "src"), ("img", "src"), ("img", "dynsrc"), ("img", "longdesc"), ("img", "lowsrc"),
    ("video", "src"), ("video", "poster"), ("track", "src"), ("audio", "src"), ("source", "src"), ("blockquote", "cite"), ("area", "ping"), ("button", "formaction"), ("object", "data"),
    ("object", "codebase"), ("applet", "archive"), ("applet", "codebase"), ("div", "hx-get"), ("div", "hx-post"), ("div", "hx-put"), ("div", "hx-patch"),
]
PLACES_PAGE = (
    '<html manifest="/html-manifest"><body background="/body-background"><table background="/table-background"><tr><td background="/td-background"></td></tr></table>'
    + "".join(f'<{t} {a}="/{t}-{a}"></{t}>' for t, a in _PLACES)
    + '<img srcset="/one 1x, /two 2x"><a href="javascript:x()">x</a><a href="#x">x</a><a href="mailto:x@y.z">x</a></body></html>'
)
_SELECTORS = {"link": "link[href]", "script": "script[src]"}
PLACES_EXPECTED = [
    *((f"https://h.example/{t}-{a}", f"[{a}]" if t == "div" else _SELECTORS.get(t, t), a, {"hx-post": "POST", "hx-put": "PUT", "hx-patch": "PATCH"}.get(a, "GET")) for t, a in _PLACES),
    *((f"https://h.example/{t}-{a}", t, a, "GET") for t, a in (("html", "manifest"), ("body", "background"), ("table", "background"), ("td", "background"))),
    *((f"https://h.example/{u}", "img", "srcset", "GET") for u in ("one", "two")),
]
