"""Funnel, crawl, tries, similarity, sinks and streams."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.config import Crawl, Extensions, Limits, Policy, Scope
from webloom.functions import simhash, urls
from webloom.operators import backoff, funnel, similarity, trie
from webloom.plans import crawl as crawling
from webloom.plans import fixtures as X
from webloom.sources import readers, sinks
from webloom.streaming import state


def rows_of(spark, items):
    return spark.createDataFrame(items, "seq bigint, url string, depth int, root_hostname string")


def test_funnel_order_and_uniqueness(spark):
    cfg = Crawl(scope=Scope("rdn"), policy=Policy(True), extensions=Extensions(), limits=Limits(max_depth=2))
    df = rows_of(
        spark,
        [(1, "https://o.test/a", 0, "s.example.com"), (2, "https://o.test/a", 0, "o.test"), (3, "https://s.example.com/x", 3, "s.example.com"), (4, "https://s.example.com/x", 2, "s.example.com"), (5, "https://s.example.com/i.png", 9, "s.example.com"), (6, "", 0, ""), (7, "http://10.0.0.1/i.png", 0, "")],
    )
    out = {r.seq: r.reject_reason for r in funnel.judged(df, cfg).collect()}
    # the first row uses its key up although scope rejects it then
    assert out == {1: "out_of_scope", 2: "duplicate", 3: "max_depth", 4: None, 5: "extension", 6: "invalid", 7: "network_policy"}
    seen = spark.createDataFrame([("https://s.example.com/x",)], "dedup_key string")
    assert {r.seq: r.reject_reason for r in funnel.judged(df, cfg, seen).collect()}[4] == "duplicate"


def test_funnel_quota_and_similar(spark):
    df = rows_of(spark, [(i, f"https://a.test/u/{i}", 0, "a.test") for i in range(30)])
    quota = Crawl(scope=Scope(no_scope=True), limits=Limits(max_pages_per_root=7))
    assert funnel.judged(df, quota).where("reject_reason IS NULL").count() == 7
    fetched = spark.createDataFrame([("a.test", 5)], "root_hostname string, n bigint")
    assert funnel.judged(df, quota, None, fetched).where("reject_reason IS NULL").count() == 2
    similar = Crawl(scope=Scope(no_scope=True), filter_similar=True)
    assert funnel.judged(df, similar).where("reject_reason IS NULL").count() == 1


def test_crawl_resumes_without_losing_the_queue(spark, tmp_path):
    site, start = X.mini_site(spark), crawling.seeds(spark, [X.ROOT])
    whole = {(r.url, r.depth) for r in crawling.crawl(site, start, X.CRAWL).responses.collect()}
    assert whole == {(u, d) for u, d, _, _ in X.CRAWL_EXPECTED}
    part = crawling.crawl(site, start, X.CRAWL, max_levels=1)
    sinks.save_checkpoint(part.visited, part.pending, str(tmp_path))
    visited, pending = sinks.load_checkpoint(spark, str(tmp_path))
    done = {r.url for r in part.responses.collect()}
    waiting = visited.join(pending, "dedup_key", "left_anti")
    rest = crawling.crawl(site, pending.withColumn("skip_validation", F.lit(True)).drop("dedup_key"), X.CRAWL, visited=waiting)
    assert done | {r.url for r in rest.responses.collect()} == {u for u, _ in whole}
    late = crawling.crawl(site, start, X.CRAWL, seconds=0)
    assert late.responses.count() == 0 and late.pending.count() == 3


def test_trie_modes(spark):
    rng = random.Random(2)
    df = rows_of(spark, [(i, f"https://h{i % 2}.test/p/{rng.randrange(8 + 20 * (i % 2))}a-b", 0, "") for i in range(200)])
    out = {r.f for r in trie.with_set_mode(df, "url", "f").collect()}
    assert "https://h1.test/p/{param}" in out and len([f for f in out if "h0" in f]) == 8 and len([f for f in out if "h1" in f]) == 1
    by_seq = {r.seq: r.segments for r in trie.exact_mode(df).collect()}
    assert by_seq[1][1] != "{param}" and by_seq[199] == ["p", "{param}"]


@pytest.mark.parametrize("shown", [False, True])
def test_out_of_scope_rows_are_shown_under_the_flag(spark, shown):
    html = '<a href="https://a.test/in">x</a><a href="https://b.test/out">y</a>'
    site = spark.createDataFrame([("https://a.test/", 200, "text/html", None, html)], "url string, status int, content_type string, headers map<string,string>, html string")
    out = crawling.crawl(site, crawling.seeds(spark, ["https://a.test/"]).withColumn("root_hostname", F.lit("a.test")), Crawl(scope=Scope("fqdn"), display_out_scope=shown))
    assert {(r.url, r.source, r.error) for r in out.errors.collect()} == ({("https://b.test/out", "https://a.test/", "endpoint is out of scope")} if shown else set())


def test_long_pattern_lists_are_read_whole(spark, tmp_path):
    (tmp_path / "long.txt").write_text("\n".join(f"^p{i}$" for i in range(10_050)))
    assert readers.lines_or_value(spark, str(tmp_path / "long.txt")) == [f"^p{i}$" for i in range(10_050)]


def folded(paths, threshold):
    out = {p: [] for p in paths}
    for i in range(max(map(len, paths))):
        below = {}
        for p in out:
            if len(p) > i:
                below.setdefault(tuple(out[p]), set()).add(p[i])
        for p in out:
            if len(p) > i:
                out[p] = [*out[p], "{param}" if len(below[tuple(out[p][:i])]) > threshold else p[i]]
    return {"/".join(p) for p in out.values()}


def test_set_mode_folds_deep_paths(spark):
    names = ["a-b", "c-d"] + [f"{x}{y}-z" for x in "efghi" for y in "klm"]
    rng = random.Random(4)
    wide = {3, 17, 18, 21}
    paths = [tuple(rng.choice(names) if k in wide else rng.choice(names[:2]) if k == 19 else f"p{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(rng.randint(18, 24))) for _ in range(300)]
    paths.append(paths[0][:1] + ("one-deep",) * 60)
    df = rows_of(spark, [(i, "https://h.test/" + "/".join(p), 0, "") for i, p in enumerate(paths)])
    out = {r.f.removeprefix("https://h.test/") for r in trie.with_set_mode(df, "url", "f").collect()}
    assert out == folded(paths, trie.THRESHOLD) and len(out) < 60 and any(f.split("/")[17] == "{param}" for f in out)
    rejected = funnel.judged(df, Crawl(filter_similar=True)).where("reject_reason = 'duplicate'").count()
    assert rejected == len(paths) - len(out)


def test_simhash_forms_agree(spark):
    texts = [(i, " ".join(random.Random(i).choices(["a", "b", "für", "中", "dd", "e"], k=i))) for i in range(12)]
    df = spark.createDataFrame(texts, "id bigint, t string")
    a = {r.id: r.s for r in df.select("id", simhash.simhash(F.col("t")).alias("s")).collect()}
    b = {r.id: r.simhash for r in similarity.native_simhash(df.select("id", F.filter(F.split("t", " "), lambda w: w != "").alias("w")), "id", "w").collect()}
    assert a == b


def test_pairs_and_greedy(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(20)]
    sigs = base + [b ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for b in base] + base[:5]
    df = spark.createDataFrame(list(enumerate(sigs)), "id bigint, simhash bigint")
    got = {(r.a, r.b): r.n_pairs for r in similarity.pairs(similarity.classes(df), 3).collect()}
    first = {}
    for i, s in enumerate(sigs):
        first.setdefault(s, i)
    want = {tuple(sorted((i, j))) for s, i in first.items() for t, j in first.items() if i < j and (s ^ t).bit_count() <= 3}
    assert set(got) == want
    out = {r.seq: r.accepted for r in similarity.greedy_accept(df.withColumn("g", F.lit("x")), "g", "id", 2).collect()}
    assert all(out[i] for i in range(20)) and not any(out[i] for i in range(20, 45) if (sigs[i] ^ base[i % 20]).bit_count() <= 2)


def test_backoff_equals_a_loop(spark):
    rng = random.Random(4)
    steps = [(i, rng.random() < 0.5) for i in range(200)]
    out = {r.i: (r.consecutive, r.delay_ms) for r in backoff.schedule(spark.createDataFrame(steps, "i bigint, t boolean").withColumn("h", F.lit(1)), "h", ["i"], F.col("t")).collect()}
    n = 0
    for i, t in steps:
        n = n + 1 if t else max(0, n - 1)
        assert out[i] == (n, min(30000, 1000 * 2 ** (n - 1)) if n else None)


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"h{rng.randrange(3)}", rng.random() < 0.5, ["p", f"x{rng.randrange(20)}"], rng.getrandbits(6)) for i in range(120)]
    schema = "seq bigint, host string, throttled boolean, segments array<string>, simhash bigint"
    for k in range(3):  # three files, taken one at a time, in order
        spark.createDataFrame(rows[k * 40 : (k + 1) * 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(stream, name):
        state.run_available(stream, str(tmp_path / name), str(tmp_path / f"{name}-state"))
        return spark.read.parquet(str(tmp_path / name))

    df = spark.createDataFrame(rows, schema)
    got = {r.seq: (r.consecutive, r.delay_ms) for r in run(state.backoff(src(), "host", "seq", "throttled", 0), "b").collect()}
    assert got == {r.seq: (r.consecutive, r.delay_ms) for r in backoff.schedule(df, "host", ["seq"], F.col("throttled")).collect()}
    walked = {r.seq: r.segments for r in run(state.trie(src(), "host", "seq", "segments", 5, 0), "t").collect()}
    tries = {}
    assert walked == {i: tries.setdefault(h, trie.Trie(5)).walk(list(s)) for i, h, _, s, _ in rows}
    new = {r.seq: r.accepted for r in run(state.new_states(src(), "host", "seq", 2, 0), "n").collect()}
    assert new == {r.seq: r.accepted for r in similarity.greedy_accept(df, "host", "seq", 2).collect()}
    assert run(state.unique(src().select("host"), ["host"]), "u").count() == 3


def test_sinks_and_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text(" https://a.test/ \n\nhttps://b.test/x\n")
    assert [r.url for r in readers.url_list(spark, str(tmp_path / "list.txt")).collect()] == ["https://a.test/", "https://b.test/x"]
    assert readers.lines_or_value(spark, str(tmp_path / "list.txt")) == ["https://a.test/", "https://b.test/x"]
    assert readers.lines_or_value(spark, "^no such file$") == ["^no such file$"]
    (tmp_path / "r.txt").write_text("POST /p HTTP/1.1\r\nHost: a.test\r\n\r\nx=1")
    assert readers.raw_requests(spark, str(tmp_path / "r.txt"), True).first().url == "https://a.test/p"
    (tmp_path / "c.json").write_text('{\n "visited_urls": ["a"], "in_flight_urls": [], "timestamp": "t"\n}')
    assert readers.checkpoint(spark, str(tmp_path / "c.json")).first().visited_urls == ["a"]
    sinks.store_responses(X.mini_site(spark), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/responses")).count() == 14 and spark.read.text(str(tmp_path / "store/index")).count() == 14
    common, own = (F.create_map(*map(F.lit, x)) for x in (("A", "1", "B", "2"), ("B", "3")))
    raw = spark.range(1).select(sinks.raw_request(F.lit(""), F.lit("https://a.test:8/p?q=1#f"), common, own, F.lit("body")).alias("r")).first().r
    assert raw == "GET /p?q=1 HTTP/1.1\r\nHost: a.test:8\r\nA: 1\r\nB: 3\r\n\r\nbody"
    df = spark.createDataFrame([("https://a.test/",)], "url string")
    sinks.write_urls(df, str(tmp_path / "u"))
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().url == "https://a.test/"


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def name(**parts):
    oids = {"CN": b"\x55\x04\x03", "O": b"\x55\x04\x0a"}
    return der(0x30, *(der(0x31, der(0x30, der(6, oids[k]), der(12, v.encode()))) for k, v in parts.items()))


def test_certificates_and_streamed_results(spark, tmp_path):
    alt = der(0x30, der(0x82, b"a.test"), der(0x87, bytes([10, 0, 0, 1])), der(0x87, bytes([0x20, 1, 0x0D, 0xB8, *[0] * 11, 1])))
    extensions = der(0xA3, der(0x30, der(0x30, der(6, b"\x55\x1d\x11"), der(4, alt))))
    times = der(0x30, der(23, b"240131120000Z"), der(24, b"20510131120000Z"))
    inner = der(0x30, der(0xA0, der(2, b"\2")), der(2, b"\1"), der(0x30), name(CN="root", O="Org"), times, name(CN="a.test"), der(0x30), extensions)
    cert = der(0x30, inner, der(0x30), der(3, b"\0"))
    certs = spark.createDataFrame([("a.test", 443, bytearray(cert)), ("b.test", 443, bytearray(b"no"))], "host string, port int, der binary")
    pages = spark.createDataFrame([("https://A.test/x",), ("http://a.test/",), ("https://b.test/",)], "url string")
    out = {r.url: r.tls_data for r in sinks.with_certificates(pages, certs).collect()}
    t = out["https://A.test/x"]
    assert (t.subject_cn, t.issuer_dn, t.issuer_org, t.subject_an) == ("a.test", "CN=root, O=Org", ["Org"], ["a.test", "10.0.0.1", "2001:0db8:0000:0000:0000:0000:0000:0001"])
    assert (t.not_before, t.not_after) == ("2024-01-31 12:00:00 UTC", "2051-01-31 12:00:00 UTC") and len(t.fingerprint_sha256) == 95
    assert out["http://a.test/"] is None and out["https://b.test/"] is None
    df, seen = sinks.counted(pages)
    df.write.parquet(str(tmp_path / "p"))
    assert seen.get["n"] == 3
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "p"))
    sinks.stream_results(stream, str(tmp_path / "r"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.json(str(tmp_path / "r")).count() == 3


def test_sql_registration(spark):
    from webloom.sql import register

    register(spark)
    assert spark.sql("SELECT absolute_url('https://a.test/b/c', '../d') AS u, is_private_ipv6('::1') AS p").first() == ("https://a.test/d", True)


@pytest.mark.parametrize("n", [0, 3])
def test_dedup_key(spark, n):
    df = spark.createDataFrame([(m, "u", "b") for m in ("GET", "get", "", None, "POST")], "m string, u string, b string")
    assert [r[0] for r in df.select(urls.dedup_key(F.col("m"), F.col("u"), F.col("b"))).collect()] == ["u"] * 4 + ["u:b"]


def test_java_patterns(spark):
    field = readers.custom_fields("- name: x\n  group: 1\n  regex: ['(?P<a_b>a+)b', '(?P<']\n")[0]
    assert spark.range(1).select(F.regexp_extract(F.lit("caab"), field.regex[0], 1).alias("v")).first().v == "aa" and len(field.regex) == 1


def test_set_mode_scans_grow_with_the_depth(spark):
    rows = [("https://h.test/" + "/".join(f"s{i}-{k % 12 if i in (3, 15) else 0}" for i in range(20)),) for k in range(60)]
    out = trie.with_set_mode(spark.createDataFrame(rows, "url string"), "url", "fp")
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan") <= 4
    assert {r.fp for r in out.collect()} == {"https://h.test/" + "/".join("{param}" if i in (3, 15) else f"s{i}-0" for i in range(20))}
