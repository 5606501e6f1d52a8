"""URL, text and script functions on vectors, and properties of them."""

import random

import pytest

from webloom.functions import html, js, predicates, simhash, urls, whatwg
from webloom.operators.trie import PARAM, Trie
from webloom.plans import fixtures as X
from webloom.sources import readers


@pytest.mark.parametrize("base,ref,want", X.RESOLVED)
def test_join(base, ref, want):
    assert whatwg.join(base, ref) == want


def test_parsing_is_idempotent():
    rng = random.Random(1)
    pieces = ["http://", "HTTPS://", "a.B", "/", "\\", "..", ".", "%2e", "?", "#", " ", "ü", "@", ":", "80", "x=1", "&", "[::1]", "1.2", "'", "|", "{", "\t"]
    for _ in range(3000):
        u = whatwg.parse("".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))), whatwg.parse("http://base.test/x/y?q"))
        if u is not None:
            assert str(whatwg.parse(str(u))) == str(u)


def test_fingerprint_is_idempotent(spark):
    rows = [(u,) for u, _ in X.FINGERPRINTS] + [("https://h.test/" + "/".join(s for s, _, _ in X.SEGMENTS if s and "\n" not in s),)]
    df = spark.createDataFrame(rows, "u string").withColumn("f", urls.fingerprint(urls.F.col("u")))
    assert df.where(urls.fingerprint(urls.F.col("f")) != urls.F.col("f")).count() == 0


def test_trie_promotes_a_position():
    t = Trie(3)
    assert [t.walk(["u", str(i)]) for i in range(5)] == [["u", "0"], ["u", "1"], ["u", "2"], ["u", PARAM], ["u", PARAM]]
    assert t.walk(["u", "0", "x"]) == ["u", PARAM, "x"] and t.walk(["other"]) == ["other"]
    whole = Trie(1)
    assert [whole.walk([c]) for c in "abc"] == [["a"], [PARAM], [PARAM]]


def test_private_v6():
    assert [predicates.private_v6(h) for h in ("::1", "fd00::1", "fe80::1", "::ffff:192.168.0.1", "2001:db8::1", "x")] == [True, True, True, True, False, False]


def test_simhash_of_words():
    a, b = (simhash.simhash_py(x.encode().split()) for x in ("the quick brown fox jumps", "the quick brown fox leaps"))
    c = simhash.simhash_py(b"wholly different words are here now".split())
    bits = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    assert bits(a, b) < bits(a, c) and simhash.simhash_py([]) == 0
    assert simhash.fnv1a_py(b"") == 0xCBF29CE484222325 and simhash.fnv1a_py(b"a") == 0xAF63DC4C8601EC8C


@pytest.mark.parametrize("text,want", [("a\x1cb c", ["a\x1cb", "c"]), (" a\u2003b\x85\x1f", ["a", "b", "\x1f"]), ("a\x0bb\u3000 c", ["a", "b", "c"]), ("", []), (" \n", [])])
def test_words_end_at_unicode_white_space_only(spark, text, want):
    assert simhash.split_words(text) == want
    got = spark.createDataFrame([(text,)], "t string").select(simhash.simhash("t")).first()[0]
    assert got == simhash.simhash_py([w.encode() for w in want])


@pytest.mark.parametrize(
    "script,want",
    [
        ("fetch('/a')", {"/a": "jsluice-call"}),
        ("x = cond ? '/y' : '/n'", {"/y": "jsluice-literal", "/n": "jsluice-literal"}),
        ("var a = '/v' + 1 + '/w'", {"/v": "jsluice-literal", "/w": "jsluice-literal", "/v1": "jsluice-variable", "/v1/w": "jsluice-variable"}),
        ("try { fetch('/t') } catch (e) { open('/c') } finally { }", {"/t": "jsluice-call", "/c": "jsluice-call"}),
        ("switch (k) { case 1: fetch('/s'); break; default: $.get('/d') }", {"/s": "jsluice-call", "/d": "jsluice-call"}),
        ("class A { m() { fetch('/no') } }; fetch('/yes')", {"/yes": "jsluice-call"}),
        ("a = {get x() { return 1 }, url: '/u', 'path': '/p', n: '/l'}", {"/u": "jsluice-property", "/p": "jsluice-property", "/l": "jsluice-literal"}),
        ("if (a) return; for (const x of y) fetch('/in')", {"/in": "jsluice-call"}),
        ("import x from 'y'; export default function f() { fetch('/e') }", {"/e": "jsluice-call"}),
        ("a?.b?.get('/o'); q = /[/'\"]/.test(s); r = a / b", {"/o": "jsluice-call"}),
        ("", {}),
    ],
)
def test_scripts(script, want):
    assert js.by_syntax(script)[0] == want


def test_broken_scripts_end():
    for s in ("`open", "f((((", "{" * 500, "x = " + "(" * 2000, "var = ;;; fetch('/k')", "'", "/*", "a" * 100_000):
        js.endpoints("https://a.test/", s)
    assert ("https://a.test/k", "jsluice-call") in js.endpoints("https://a.test/", "var = ;;; fetch('/k')")


def test_pages():
    page = html.parse_page(
        "https://e.test/a/b",
        '<base href="/zz/"><a href="c/../d e">x</a><a href="javascript:1">y</a><img srcset="s1 1x, s2 2x" src=/i><td background=/no><table><td background=/u></table>'
        '<image href="/no"><noscript><a href="/no2"></noscript><div hx-post="/hx"><script>var t="</p>";</script>',
    )
    assert [(x["method"], x["url"]) for x in page["links"]] == [
        ("GET", "https://e.test/a/d%20e"), ("GET", "https://e.test/i"), ("GET", "https://e.test/a/s1"), ("GET", "https://e.test/a/s2"), ("GET", "https://e.test/u"), ("POST", "https://e.test/hx"),
    ]
    assert page["scripts"] == ['var t="</p>";'] and html.parse_page(None, None) == {"links": [], "scripts": [], "forms": []}


def test_arguments():
    assert readers.split_patterns(r"a{1,2},[b,c],d\,e, ,f") == ["a{1,2}", "[b,c]", r"d\,e", "f"]
    assert [readers.seconds(x) for x in ("10s", "5m", "2h", "1d", "7")] == [10, 300, 7200, 86400, 7]
    assert readers.header_argument("A: b:c ") == ("A", "b:c") and readers.header_argument("x") is None
    with pytest.raises(ValueError):
        readers.seconds("soon")
