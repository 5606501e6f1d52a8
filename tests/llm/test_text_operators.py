"""PII, BPE, media and URL filters against brute force, the library, round trips and edge cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken

from webloom.llm import bpe, media, pii, urls

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EDGES = [(1, None), (2, ""), (3, "   \n"), (4, "word " * 30_000), (5, "x" * 100_000), (6, "same"), (7, "same"), (8, "é ß 中文 😀 \x00"), (None, "no id")]


def brute_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_equals_brute_force():
    rng = random.Random(1)
    pieces = ["a", "B", "@", ".", "-", "+", "%", " ", "1", "25", "4111111111111111", "0", "(", ")", "é", "a.b", "@x.y"]
    for _ in range(5000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert [s[:3] for s in pii.find(t) if s[2] in pii.BASE_KINDS] == brute_pii(t), t


@pytest.mark.parametrize("text", ["a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000])
def test_pii_is_linear(text):
    pii.find(text)


def test_pii_checksums_and_context():
    kinds = {s[2] for s in pii.find("IBAN GB82 WEST 1234 5698 7654 32, social security ssn 123-45-6789")}
    assert {"iban", "ssn"} <= kinds
    assert "ssn" not in {s[2] for s in pii.find("part 123-45-6789")}
    assert "iban" not in {s[2] for s in pii.find("GB82 WEST 1234 5698 7654 33")}
    assert pii.redact("call +49 (30) 1234567 or a@b.co") == "call [PHONE] or [EMAIL]"
    assert pii.redact(None) is None and pii.redact("clean") == "clean"


def test_pii_query(docs):
    rows = [*EDGES, (9, "a@b.co 10.0.0.1"), (9, "a@b.co 10.0.0.1")]
    out = pii.digest(docs(rows)).collect()
    assert len(out) == len(rows)
    nine = [r for r in out if r.doc_id == 9]
    assert len(nine) == 2 and nine[0] == nine[1] and nine[0].n_email == nine[0].n_ip == 1
    assert nine[0].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:15").hexdigest()
    assert pii.digest(docs([])).collect() == []


def test_pii_keeps_columns(docs):
    df = docs([(1, "a@b.co"), (2, None)])
    assert pii.redacted(df).columns == df.columns
    out = pii.with_spans(df.withColumnRenamed("lang", "pii_spans"))
    assert out.columns[-1] == "pii_spans_"


@pytest.fixture(scope="module")
def library():
    path, pattern = bpe.vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    path, pattern = bpe.vocabulary()
    with open(path, "rb") as f:
        return bpe.Encoder(f.read().splitlines(), pattern)


def test_bpe_equals_the_library(encoder, library):
    rng = random.Random(2)
    pieces = ["a", "the", "ing", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "é", "ß", "中", "😀", "1", "²", "½", "'s", "'t", "!", "--", "́", "क्", "e", "r", "00", "==", "A", "\r", "_", "<|endoftext|>"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        assert encoder.encode(t) == library.encode_ordinary(t), t
        assert encoder.decode(encoder.encode(t)) == t.encode()
    for _ in range(300):
        t = "".join(rng.choice("abcdeihnorst") for _ in range(rng.randint(50, 300)))
        assert encoder.encode(t) == library.encode_ordinary(t)


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 100_000, " " * 200_000, "=" * 100_000])
def test_bpe_is_linear(encoder, text):
    assert encoder.decode(encoder.encode(text)) == text.encode()


def test_bpe_query(docs, library):
    rows = EDGES
    out = {r.doc_id: r for r in bpe.digest(docs(rows)).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digest(docs([])).count() == 0


def test_bpe_columns(docs, library):
    df = docs(EDGES[:4]).withColumnRenamed("lang", "token_ids")
    out = bpe.decoded(bpe.encoded(df), ids="token_ids_").collect()
    for r, (_, t) in zip(sorted(out, key=lambda r: r.doc_id), EDGES[:4], strict=True):
        assert r.text == t and bytes(r.decoded).decode() == (t or "") and r.token_ids_ == library.encode_ordinary(t or "")


def test_media_round_trip():
    for raw in (b"", b"a" * 192, b"b" * 193, bytes(range(254)) * 40, b"ID3\x04\x00\x00" * 64):
        p = media.padded(raw)
        s = media.parse(m := media.pack(p))
        assert media.unpack(m, s) == p and len(p) % 192 == 0 and s.bad == 0 and s.good == len(p) // 192
        assert s.samples == 1152 * (len(p) // 192) and s.table == "xing" and s.table_frames == len(p) // 192


def test_media_resynchronises_and_finds_damage():
    m = media.pack(media.padded(b"x" * 1000))
    s = media.parse(b"\xff\xfbjunk" + m + b"TAG" + b" " * 125)
    assert len(s.offsets) == 6 and s.skipped > 0
    hurt = bytearray(m)
    hurt[len(m) - 240 + 10] ^= 1  # in the last frame's side information
    assert media.parse(bytes(hurt)).bad == 1
    assert media.parse(b"no audio here").head is None
    vbri = bytearray(240)
    vbri[:4] = b"\xff\xfb\x64\x00"
    vbri[36:62] = b"VBRI" + b"\0" * 6 + (480).to_bytes(4, "big") + (1).to_bytes(4, "big") + (0).to_bytes(2, "big") + b"\0\1\0\2\0\1"
    assert media.parse(bytes(vbri) + m[27 + 240 :]).table == "vbri"


def test_media_query(docs):
    out = {r.doc_id: r for r in media.digest(docs(EDGES)).collect()}
    for i, t in EDGES:
        raw = (t or "").encode()
        p = media.padded(raw)
        assert (out[i].n_bytes, out[i].payload_bytes) == (len(raw), len(p))
        assert out[i].payload_sha256 == hashlib.sha256(p).hexdigest() and out[i].tail_crc32 == zlib.crc32(p[-16:])
    assert out[1].media_sha256 == out[2].media_sha256 and out[6].media_sha256 == out[7].media_sha256
    assert media.with_media(docs([(1, "a")]).withColumnRenamed("lang", "media")).columns[-2:] == ["media_", "media_offsets"]


def test_globs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        patterns = ["".join(rng.choice("ab*c") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 30))]
        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(20)]
        got = urls.Automaton.of(patterns).match([t.encode() for t in texts])
        for i, t in enumerate(texts):
            for k, p in enumerate(patterns):
                assert got[i, k] == bool(re.fullmatch(".*".join(map(re.escape, p.split("*"))), t))


def test_url_rules(spark):
    rows = [
        (1, "https://WWW.Example.com/en/7?x"), (2, "http://example.com/en/8"), (3, "http://badexample.com/en/7"), (4, "http://a.net/de/"), (5, "http://x.example.net/de/8#y"),
        (6, "http://org/es/"), (7, None), (8, "no scheme"), (9, "http://cheap-pills.biz/x"), (10, "http://a.com/q/com/en/"), (11, "http://h.com?q=/en/"), (12, "http://" + "y" * 50_000 + ".org/es/z"),
    ]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame([*rows, rows[0]], "page_id bigint, url string")).collect()}
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert [out[i].rule for i in (2, 3, 4, 5, 6)] == ["com/en/", "com/en/", "net/de/", "example.net/de/8", "org/es/"]
    assert [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in (7, 8)] == [("", "", None, "allow")] * 2
    assert (out[9].rule, out[9].verdict) == (None, "block") and out[10].rule is None and (out[11].path, out[11].rule) == ("", None) and out[12].verdict == "block"


@pytest.mark.parametrize(
    "text,want",
    [
        ("pay GB82WEST12345698765432 BIC NWBKGB2L", [(4, 26)]),
        ("GB82 WEST 1234 5698 7654 32 PAY NOW", [(0, 27)]),
        ("DE89 3704 0044 0532 0130 00 GB82WEST12345698765432", [(0, 27), (28, 50)]),
        ("GB82WEST12345698765433 GB82WEST123456987654321", []),
        ("xGB82WEST12345698765432", []),
    ],
)
def test_ibans_end_where_their_country_says(text, want):
    assert [(a, b) for a, b, kind, _ in pii.find(text) if kind == "iban"] == want


def test_spans_beside_clashing_columns(docs):
    df = docs([(1, "mail a@b.cd now"), (2, None)]).withColumnRenamed("lang", "pii_spans")
    out = pii.with_spans(df)
    assert out.columns == [*df.columns, "pii_spans_"]
    assert {r.doc_id: [(s.start, s.end, s.kind) for s in r.pii_spans_] for r in out.collect()} == {1: [(5, 11, "email")], 2: []}


@pytest.mark.parametrize(
    "url,verdict",
    [
        ("http://evil.com/x.edu/casino", "block"), ("http://shop.com/a.ads.b/c", "allow"), ("http://u@ads.x.com/", "block"), ("http://x.com/%63asino", "block"),
        ("http://x.com:80/a/./track/../track/b", "block"), ("http://a.edu/casino", "allow"), ("http://www.ads.com/x", "block"), ("http://x.com/a/track/b", "block"), (None, "allow"),
    ],
)
def test_globs_see_the_canonical_url(spark, url, verdict):
    df = spark.createDataFrame([(1, url, "x")], "page_id int, url string, host string")
    assert [r.verdict for r in urls.judge(df).collect()] == [verdict]
    assert urls.judge(df.limit(0)).collect() == []


def test_media_equals_frames_written_one_by_one(docs):
    """The stored stream built byte by byte after the format's description, and the features counted from it."""

    def crc(data):
        x = 0xFFFF
        for byte in data:
            for k in range(7, -1, -1):
                x = (x << 1 ^ (0x8005 if (x >> 15 ^ byte >> k) & 1 else 0)) & 0xFFFF
        return x

    texts = [None, "", "short", "é" * 150, "w " * 2000, "short"]
    got = {r.doc_id: r for r in media.digest(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * ((192 - len(raw) % 192) % 192 or (192 if not raw else 0))
        n = len(payload) // 192
        head = bytes([0xFF, 0xFA, 0x64, 0x00])
        lead = head + crc(head[2:] + bytes(32)).to_bytes(2, "big") + bytes(32)
        seek = bytes(min(255, (k * n // 100 + 1) * 256 // (n + 1)) for k in range(100))
        first = lead + b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * 240).to_bytes(4, "big") + seek
        tag = b"ID3\x04\x00\x00\x00\x00\x00\x11TENC\x00\x00\x00\x07\x00\x00\x03webloo"
        stream = tag + first.ljust(240, b"\0") + b"".join((lead + payload[k * 192 : k * 192 + 192]).ljust(240, b"\0") for k in range(n))
        offsets = np.array([len(tag) + 240 * (k + 1) for k in range(n)], "<i8")
        seconds = __import__("fractions").Fraction(1152 * n, 48000)
        feature = f"mpeg1-layer3;48000hz;frames={n};seconds={seconds.numerator}/{seconds.denominator};crc={n}/{n};table=xing:{n};skipped=0;seek={hashlib.sha256(offsets.tobytes()).hexdigest()[:16]}"
        assert (got[i].media_sha256, got[i].media_bytes, got[i].feature) == (hashlib.sha256(stream).hexdigest(), len(stream), feature)
    assert media.digest(docs([])).collect() == []


def test_media_reports_a_damaged_table_frame_and_what_it_cannot_check():
    whole = media.pack(b" " * 384)
    assert not media.parse(whole).table_damaged
    assert media.parse(whole[:35] + b"\1" + whole[36:]).table_damaged
    frame = bytes([0xFF, 0xFC, 0x54, 0x00])  # layer II, protected
    s = media.parse((frame + bytes(media.header(frame, 0).length - 4)) * 3)
    assert (len(s.offsets), s.unchecked, s.good, s.bad) == (3, 3, 0, 0)


def frame24(name, body, flags=b"\0\0"):
    n = len(body)
    return name + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + flags + body


def id3(major, body, flags=0):
    n = len(body)
    return b"ID3" + bytes((major, 0, flags, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body


@pytest.mark.parametrize(
    "tag,want",
    [
        (id3(4, frame24(b"TIT2", b"\x03caf\xc3\xa9 \xf0\x9f\x98\x80") + frame24(b"TPE1", b"\x00a\0b\0") + bytes(20)), [("TIT2", "café 😀"), ("TPE1", "a / b")]),
        (id3(4, frame24(b"TIT2", b"\x03" + b"x" * 300) + frame24(b"APIC", b"\x00png")), [("TIT2", "x" * 300), ("APIC", None)]),
        (id3(4, frame24(b"TIT2", b"\0\0\0\x04\x00\xff\0y", b"\0\x03")), [("TIT2", "ÿy")]),
        (id3(4, frame24(b"TIT2", b"\x00zip", b"\0\x08")), [("TIT2", None)]),
        (id3(3, b"\0\0\0\x06" + bytes(6) + b"TALB\0\0\0\x07\0\0\x01\xff\xfea\0b\0" + b"WOAR\0\0\0\x05\0\0u://x", 64), [("TALB", "ab"), ("WOAR", "u://x")]),
        (id3(2, b"TT2\0\0\x05\x00name" + b"COM\0\0\x02\x00x"), [("TT2", "name"), ("COM", None)]),
        (id3(3, b"TIT2\0\0\x09\x09\0\0\x00cut"), []),
        (id3(9, b"anything"), []),
    ],
)
def test_media_reads_tags(tag, want):
    body = media.pack(b" " * 384)[27:]
    s = media.parse(tag + body)
    assert (s.tags, s.id3, len(s.offsets), s.skipped) == (want, 1, 2, 0)
    last = b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30) + bytes(30) + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07" + b"\x11"
    s = media.parse(body + last)
    assert s.tags == [("title", "Title"), ("artist", "Artist"), ("year", "1999"), ("comment", "note"), ("track", "7"), ("genre", "17")] and len(s.offsets) == 2


def test_media_reads_any_bytes():
    rng = random.Random(4)
    for _ in range(300):
        media.parse(b"ID3" + bytes(rng.choice((0, 2, 3, 4, 64, 128, rng.randrange(256))) for _ in range(rng.randint(0, 60))))


def test_media_details_of_any_column(spark):
    whole = media.pack(media.padded(b"some text " * 100))
    hurt = bytearray(whole)
    hurt[-240 + 10] ^= 1
    rows = [(1, whole), (1, whole), (2, None), (3, b""), (4, b"no audio"), (5, bytes(hurt))]
    df = spark.createDataFrame([(i, x, "kept") for i, x in rows], "page bigint, media binary, media_details string")
    out = media.with_details(df)
    assert out.columns == [*df.columns, "media_details_"] and media.with_details(df.limit(0)).collect() == []
    got = sorted(out.collect(), key=lambda r: r.page)
    assert got[0] == got[1] and got[2].media_details_ is None and all(r.media_details == "kept" for r in got)
    d = got[0].media_details_
    assert (d.samples, d.rate, d.frames, d.good, d.bad, d.table_frames) == (1152 * 6, 48000, 6, 6, 0, 6) and d.offsets == [27 + 240 * (k + 1) for k in range(6)]
    assert [(t.name, t.value) for t in d.tags] == [("TENC", "webloo")]
    assert [(r.media_details_.frames, r.media_details_.rate) for r in got[3:5]] == [(0, None)] * 2
    assert (got[5].media_details_.good, got[5].media_details_.bad) == (5, 1)
