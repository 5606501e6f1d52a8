"""Jaccard join, embeddings, substrings, mixing, classifiers and the pipeline against brute force and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from webloom.llm import jaccard, mixing, neardup, quality, substring, toxicity
from webloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(lower)
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_jaccard(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = roots(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def near_copies(seed, groups=4, copies=40, size=80, edits=(0, 6), vocabulary=3000):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    boiler = [word() for _ in range(25)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            t = base[:]
            for _ in range(rng.randint(*edits)):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.4:
                t = t + boiler
            texts.append(" ".join(t))
    texts += [" ".join([word() for _ in range(rng.randint(1, 60))] + boiler * (rng.random() < 0.5)) for _ in range(60)]
    texts += [None, "", " \t ", "A b", "a B", "one", "one", "x y z q", "long " * 3000, texts[0], texts[0], texts[1].upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,hot", [(1, 20), (2, 3), (3, 60)])
def test_jaccard_equals_brute_force(docs, monkeypatch, seed, hot):
    monkeypatch.setattr(jaccard, "HOT_LEAST", hot)  # also with nearly all and with no columns hot
    rows = near_copies(seed)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(rows)).collect()}
    assert out == brute_jaccard(rows)


def test_jaccard_beyond_its_broadcast(docs, monkeypatch):
    """Hot columns that may not be broadcast are looked up by a join: nothing else changes."""
    monkeypatch.setattr(jaccard, "HOT_LEAST", 1)
    rows = near_copies(4)
    every = jaccard._hot_columns(docs(rows), 8)
    kept = {r.id: (r.n, r.cold, r.hot) for r in jaccard._kept_columns(docs(rows), 8, every).collect()}
    monkeypatch.setattr(jaccard, "HOT_MOST", 50)
    some = jaccard._hot_columns(docs(rows), 8)
    assert len(some.fp) <= 50 and len(some.fp) + some.others.count() == len(every.fp)
    assert {r.id: (r.n, r.cold, r.hot) for r in jaccard._kept_columns(docs(rows), 8, some).collect()} == kept
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(rows)).collect()} == brute_jaccard(rows)


def test_jaccard_columns_of_thousands_of_documents(docs, monkeypatch):
    """One passage in all texts, in growing shares: most stay apart, those of nearly equal words link."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(80)]
    texts = [" ".join([f"u{rng.randrange(10**9)}" for _ in range(rng.randint(0, 60))] + passage[: rng.choice([80, 60, 30])]) for _ in range(600)]
    monkeypatch.setattr(jaccard, "HOT_MOST", 20)
    rows = list(enumerate(texts))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(rows)).collect()} == brute_jaccard(rows)


def test_jaccard_edges(docs):
    assert jaccard.join(docs([])).collect() == []
    out = jaccard.join(docs([(1, None), (2, "a b"), (None, "a b"), (2, "a b")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in out) == [(0, 0, 1), (1, 1, 0), (2, 2, 1), (2, 2, 1)]
    clashing = docs([(1, "a b"), (2, "a  b")]).selectExpr("doc_id", "text", "doc_id AS id", "1 AS n", "2 AS fp", "3 AS i", "'x' AS component_id")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(clashing).collect()) == [(1, 1), (2, 1)]
    df = docs([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "other words"), (5, "other words")]).withColumnRenamed("lang", "component_id")
    kept = jaccard.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (201, 200), (200, 201)]
    out = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert out == roots({x for p in links for x in p}, links)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def brute_substring(rows):
    seen, cover = {}, {i: set() for i, _ in rows}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        w = words[i]
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                cover[i].update(range(p, p + 20))
            else:
                seen[k] = (i, p)
    return {i: (len(w), len(cover[i]), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in cover[i]).encode()).hexdigest()) for i, w in words.items()}


@pytest.mark.parametrize("seed,batches,buffer", [(1, 2, 1 << 20), (2, 5, 200), (3, 1, 50)])
def test_substrings_equal_brute_force(docs, monkeypatch, seed, batches, buffer):
    monkeypatch.setattr(substring, "BUFFER", buffer)
    rng = random.Random(seed)
    word = lambda n=500: f"v{rng.randrange(n)}"
    passages = [[word() for _ in range(rng.randint(15, 60))] for _ in range(6)]
    texts = []
    for _ in range(120):
        t = [word() for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 10)
            at = rng.randint(0, len(t))
            t[at:at] = p[cut : len(p) - rng.randint(0, 5)]
        texts.append(rng.choice([" ", "\n", "  "]).join(t))
    texts += [None, "", "a " * 400, "a b " * 60, "é " * 25, texts[0], texts[0], " ".join(["x"] * 19), " ".join(["x"] * 20), "y" * 50_000]
    rows = list(enumerate(texts))
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(docs(rows), batches).collect()}
    assert out == brute_substring(rows)


def test_substring_edges(docs):
    assert substring.deduplicate(docs([])).collect() == []
    t = " ".join(f"w{i}" for i in range(30))
    out = substring.deduplicate(docs([(1, t), (1, t), (None, t), (2, t)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 0), (1, 0), (1, 0), (2, 30)]


def passages_of(rng, n=120):
    word = lambda k=500: f"v{rng.randrange(k)}"
    passages = [[word() for _ in range(rng.randint(15, 60))] for _ in range(6)]
    texts = []
    for _ in range(n):
        t = [word() for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            at = rng.randint(0, len(t))
            t[at:at] = p[rng.randint(0, 10) : len(p) - rng.randint(0, 5)]
        texts.append(" ".join(t))
    return texts


def test_substring_index_goes_on_in_another_session(spark, docs, tmp_path):
    """Five batches, the index closed and opened after the second: as if all had been there at once; runs are compacted, history is never shuffled."""
    texts = passages_of(random.Random(9))
    texts[70], texts[90] = texts[3], texts[3]
    rows = list(enumerate(texts))
    want, got = brute_substring(rows), {}
    cuts = [0, 30, 55, 56, 100, 120]
    index = substring.Index.create(spark, f"file://{tmp_path}/index", n_docs=200)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if k == 2:
            index.close()
            index = substring.Index.open(spark.newSession(), f"file://{tmp_path}/index")
        out = index.deduplicate(docs(rows[a:b]), docs(rows[:b]))
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()}
    assert got == want
    assert any(level for _, level in index.state["runs"]) and len(index.state["runs"]) <= 3
    assert {p.name for p in (tmp_path / "index" / "entries").iterdir() if p.name.startswith("part=")} == {f"part=run-{r}" for r, _ in index.state["runs"]}
    merge = index._merged(docs(rows[:5]), 99)._jdf.queryExecution().executedPlan().toString()
    assert merge.count("Exchange") == 1 and "Exchange" not in index._compacted([r for r, _ in index.state["runs"]], 99)._jdf.queryExecution().executedPlan().toString()
    index.delete()
    assert not (tmp_path / "index").exists()


def test_an_attempt_that_did_not_end_leaves_no_trace(spark, docs, tmp_path, monkeypatch):
    rows = list(enumerate(passages_of(random.Random(11), 40)))
    index = substring.Index.create(spark, f"file://{tmp_path}/index", n_docs=40)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.deduplicate(docs(rows[:20])).collect()}

    def fail(*_):
        raise RuntimeError

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(substring, "_repeats", fail)
        index.add(docs(rows[20:]), docs(rows))
    index.close()
    index = substring.Index.open(spark, f"file://{tmp_path}/index")
    got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.deduplicate(docs(rows[20:]), docs(rows)).collect()}
    assert got == brute_substring(rows)


def test_substrings_of_extreme_ids_and_other_columns(spark):
    t = " ".join(f"w{i}" for i in range(30))
    ends = [-(1 << 63), -(1 << 63) + 1, 0, (1 << 63) - 2, (1 << 63) - 1]
    df = spark.createDataFrame([(i, t if k % 2 else t + f" x{k}", 1, "a", "b") for k, i in enumerate(ends)], "doc_id bigint, text string, id int, at string, k1 string")
    out = {r.doc_id: (r.n_words, r.n_removed) for r in substring.deduplicate(df).collect()}
    assert out == {ends[0]: (31, 0), ends[1]: (30, 30), ends[2]: (31, 30), ends[3]: (30, 30), ends[4]: (31, 30)}


def brute_vectors(rows):
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(i for i, _ in rows)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if a in ok and b in ok and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.9]
    comp = roots(ids, links)
    return {i: (sum(i in p for p in links), comp[i], comp[i] == i) for i in ids}


@pytest.mark.parametrize("shard", [4096, 60])
def test_vectors_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(neardup, "SHARD", shard)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[100:180] = x[0] + rng.normal(size=(80, 16)) * 0.08
    x[200:230] = x[1]
    x[231] = -x[1]
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(x)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, [1.0, 2.0]), (405, [2.0, 4.0]), (406, []), (407, [1e30] * 16), (408, [3e-30] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    want = brute_vectors(rows)
    assert set(out) == set(want)
    assert sum(out[i] == want[i] for i in want) >= 0.97 * len(want)
    assert all(out[i][0] <= want[i][0] for i in want)
    assert all(out[i] == want[i] for i in range(400, 409))
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_large_cells_get_centroids_of_their_own(spark, monkeypatch):
    """A dense cell stays whole; of others no class has more copies than the overlap, and no link is lost."""
    monkeypatch.setattr(neardup, "SHARD", 120)
    monkeypatch.setattr(neardup, "CELL", 60)
    monkeypatch.setattr(neardup, "CELLS_MOST", 8)
    monkeypatch.setattr(neardup, "ASSIGN", 100)
    rng = np.random.default_rng(11)
    x = np.concatenate([*(group(rng, 4, 16, 0.05) for _ in range(200)), group(rng, 150, 16, 0.05)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    made = []
    inner = neardup._refined
    monkeypatch.setattr(neardup, "_refined", lambda *a: made.append((inner(*a), a[2])) or made[-1][0])
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    cells, overlap = made[0]
    found = cells.collect()
    assert len(found) == 950 and max(len(r.cells) for r in found) <= overlap and len({c for r in found for c in r.cells}) > 6
    want = brute_vectors(rows)
    assert sum(out[i] == want[i] for i in want) >= 0.95 * len(want) and all(out[i][0] <= want[i][0] for i in want)


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0]), (None, [1.0, 0.0]), (5, [-1.0, 0.01])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id bigint, embedding array<double>, key int, component_id string")
    out = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in neardup.near_duplicates(df).collect())
    assert out == [(0, 0, 0, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False)]


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def group(rng, size, dims, noise=0.14):
    return unit(rng.normal(size=(1, dims))) + rng.normal(size=(size, dims)) * noise / dims**0.5


@pytest.mark.parametrize("sizes", [[600] + [2] * 60, [80] * 20, [150] * 4])
def test_every_group_of_a_shard_is_reached(sizes):
    rng = np.random.default_rng(7)
    if len(sizes) == 4:  # tight parts of one group
        base = group(rng, 1, 64)
        parts = [base + rng.normal(size=(1, 64)) * 0.025 + rng.normal(size=(s, 64)) * 0.0025 for s in sizes]
    else:
        parts = [group(rng, s, 64) for s in sizes]
    x = unit(np.concatenate([*parts, rng.normal(size=(200, 64))]))
    x = x[rng.permutation(len(x))]
    found = {i: set(hits.tolist()) - {i} for i, hits in neardup.search(x, neardup.build(x), np.ones(len(x), int))}
    true = {i: set(np.flatnonzero(r).tolist()) - {i} for i, r in enumerate(x @ x.T >= neardup.THRESHOLD)}
    assert sum(map(bool, true.values())) >= sum(sizes) and found == true


def test_vectors_that_the_graph_does_not_reach_are_compared(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARD", 60)
    monkeypatch.setattr(neardup, "CELL", 50)
    monkeypatch.setattr(neardup, "search", lambda x, graph, counts: iter(()))
    rng = np.random.default_rng(8)
    x = np.concatenate([group(rng, 70, 16), group(rng, 2, 16), group(rng, 3, 16), rng.normal(size=(60, 16))])
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(x)] + [(500, [1.0, 2.0]), (501, [2.0, 4.1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert out == brute_vectors(rows)


@pytest.mark.parametrize("sizes,drawn", [([400] + [2] * 30, 256), ([2], 16)])
def test_audit_sees_lost_pairs(spark, monkeypatch, sizes, drawn):
    monkeypatch.setattr(neardup, "AUDIT", drawn)
    monkeypatch.setattr(neardup, "search", lambda x, graph, counts: ((i, hits) for i, hits in neardup.compare(x) if len(hits) > 2))
    rng = np.random.default_rng(9)
    x = np.concatenate([*(group(rng, s, 32) for s in sizes), rng.normal(size=(300, 32))])
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    e = unit(np.array([v for _, v in rows]))
    out = {r.vec_id: r.n_links for r in neardup.near_duplicates(df).collect()}
    assert out == dict(enumerate(((e @ e.T >= neardup.THRESHOLD).sum(axis=1) - 1).tolist()))


def targets(sizes):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    w = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[n] for n in open_)
        full = {n for n in open_ if left * w[n] / total > 2 * sizes[n]}
        if not full:
            out |= {n: left * w[n] / total for n in open_}
            break
        for n in full:
            out[n] = 2 * sizes[n]
            left -= 2 * sizes[n]
        open_ -= full
    return out


def test_mixing_meets_its_targets(docs):
    rng = random.Random(6)
    rows = [(i, None if i % 50 == 7 else " ".join("word" for _ in range(rng.randint(0, 40)))) for i in range(800)]
    rows += [(900 + i, "big " * 2000) for i in range(3)] + [(0, rows[0][1])]
    df = docs(rows)
    source = {r.doc_id: r.source for r in df.collect()}
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and out and sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    sizes, got, goal = {}, {}, {}
    for r in out:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        got[s] = got.get(s, 0) + r.taken
        goal[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = targets(sizes)
    for s in sizes:
        assert abs(goal[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(got[s] - want[s]) <= 1
    words = {}
    for r in mixing.mixed(df).collect():
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text))
    for s in sizes:  # whole documents: within half of the longest
        longest = max((r.size for r in out if source[r.doc_id] == s), default=0)
        assert abs(words.get(s, 0) - want[s]) <= longest / 2 + max(r.size for r in out if r.doc_id == 0) + 1


def test_mixing_edges(docs):
    assert mixing.mix(docs([])).collect() == []
    assert [(r.size, r.taken) for r in mixing.mix(docs([(1, None), (2, ""), (3, " ")])).collect()] == [(0, 0)] * 3
    df = docs([(1, "a b c"), (2, "d")]).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "taken")
    assert mixing.mixed(df).columns == df.columns


def test_mixing_has_no_python(docs):
    plan = mixing.mix(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def labelled(spark, n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 80))]
        if not good:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["scoundrel", "rotter", "blighter"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    return rows, spark.createDataFrame([*labels, (1, None, None)], "doc_id bigint, quality int, toxic int"), labels


def test_quality_on_held_out_rows(spark, docs):
    rows, labels, truth = labelled(spark)
    out = {r.doc_id: r for r in quality.digest(docs([*rows, (5000, None), (5001, ""), (5002, "z" * 60_000)]), labels).collect()}
    held = [(out[i], q) for i, q, _ in truth if out[i].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out) and len(held) > 40
    assert np.mean([r.predicted == q for r, q in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def test_quality_does_not_learn_held_out_labels(spark, docs):
    rows, labels, _ = labelled(spark)
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    for op in (quality, toxicity):
        a, b = ({r.doc_id: r.score for r in op.digest(docs(rows), x).collect()} for x in (labels, other))
        assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_classifiers_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for op in (quality, toxicity):
        out = op.digest(docs([(1, "a"), (2, None)]), none).collect()
        assert len(out) == 2 and all(0 <= r.score <= 1 for r in out)
        assert op.digest(docs([]), none).collect() == []


def test_quality_keeps_columns(spark, docs):
    rows, labels, truth = labelled(spark)
    df = docs(rows).withColumnRenamed("lang", "score")
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(i in ids) == bool(q) for i, q, _ in truth]) > 0.97


def test_toxicity_on_held_out_rows(spark, docs):
    rows, labels, truth = labelled(spark, 1500)
    out = {r.doc_id: r for r in toxicity.digest(docs([*rows, (5000, None), (5001, "")]), labels).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    held = [(out[i], t) for i, _, t in truth if out[i].held_out]
    assert np.mean([r.predicted == t for r, t in held]) > 0.97


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, labels, truth = labelled(spark)
    texts = [t for _, t in rows]
    texts[3] += " mail me at someone@example.org"
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate([*texts, texts[10], texts[11]])]
    docs.append((900, None, None, None, None))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids"]
    got = out.collect()
    good = {i for i, q, _ in truth if q}
    ids = {r.doc_id for r in got}
    assert len(ids & set(range(400)) - good) <= 3 and 400 not in ids and 401 not in ids
    assert all("@" not in r.text and r.n_chars == len(r.text) for r in got if r.text is not None)
    assert sum(r.doc_id == got[0].doc_id for r in got) <= 2


def test_mixing_buckets_are_even(spark):
    """Texts without spaces have small weights, so their keys crowd far from those of others; sources may be many."""
    rows = [(i, "x" * 90 if i % 2 else "six chars words are plain here", "a" if i % 3 else f"s{i % 500}") for i in range(40_000)]
    df = mixing.keyed(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    sizes = [r["count"] for r in mixing.bucketed(df, "source", "key", "b").where("source = 'a'").groupBy("b").count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    per = {}
    for r in out:
        x = per.setdefault(r.target, [0, r.target])
        x[0] += r.taken
    assert len(out) == len(rows) and abs(sum(r.taken for r in out) - 1.5 * sum(r.size for r in out)) <= 600


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(1, 200, 12)).astype(np.int32), int(rng.random() < 0.4)) for _ in range(150)]
    z, n = {}, {}

    def weight(i):
        pull = 0.0 if i == 0 else toxicity.L1
        if abs(z.get(i, 0.0)) <= pull:
            return 0.0
        return -(z[i] - (pull if z[i] > 0 else -pull)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, y in rows:
            w = {int(i): weight(int(i)) for i in [0, *x]}
            g = (1 / (1 + np.exp(-sum(w.values()))) - y) * (toxicity.POSITIVE if y else 1.0)
            for i, wi in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * wi
                n[i] = old + g * g
    i, w = toxicity.train(rows)
    got = dict(zip(i.tolist(), w.tolist(), strict=True))
    want = {i: weight(i) for i in z if weight(i)}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_toxicity_takes_any_id(spark, kind, monkeypatch):
    rows = [(i, "you vile fool " * (i % 3) + f"word{i} text", int(i % 3 > 0)) for i in range(60)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    plain = {r.doc_id: r.score for r in toxicity.digest(df, labels).collect()}
    cast = lambda d: d.withColumn("doc_id", d["doc_id"].cast(kind))
    assert {int(r.doc_id): r.held_out for r in toxicity.digest(cast(df), cast(labels)).collect()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in plain}
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)  # learns from a part
    assert toxicity.digest(cast(df).withColumn("y", cast(df)["text"]), cast(labels)).count() == 60
    assert toxicity.digest(df.limit(0), labels).collect() == []


def test_quality_equals_plain_densities(spark, docs):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Plain", "words", "that", "read", "well."] if i % 2 else ["B@D", "$$$", "x9", "ZZZZ", "words"]) for _ in range(rng.randint(5, 60))) for i in range(80)]
    df = docs(list(enumerate(texts)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(3, 1), (5, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality.digest(df, labels).collect()}
    x = {r.doc_id: np.array(r.x) for r in quality.with_statistics(df, "x").collect()}
    want = plain_quality([(i, v) for i, v in x.items()], {i: i % 2 for i in x})
    assert all(abs(got[i] - want[i]) < 1e-4 for i in x)


def plain_quality(stats, label):
    """Scores by a plain quadratic discriminant; ``stats``: (id, statistics) of each row."""
    seen = [(i, v) for i, v in stats if i in label and zlib.crc32(str(i).encode()) % 5]
    part = [np.array([v for i, v in seen if label[i] == k]) for k in (0, 1)]
    cov = [np.cov(p.T, bias=True) for p in part]
    pooled = sum(len(p) * c for p, c in zip(part, cov)) / len(seen)
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    shrunk = [0.88 * c + 0.1 * pooled + 0.02 * scale for c in cov]
    out = {}
    for i, v in stats:
        d = [(v - p.mean(0)) @ np.linalg.solve(c, v - p.mean(0)) + np.linalg.slogdet(c)[1] for p, c in zip(part, shrunk)]
        out[i] = 1 / (1 + np.exp(-np.clip((d[0] - d[1]) / 2 + np.log(len(part[1]) / len(part[0])), -500, 500)))
    return out


def plain_mix(rows):
    """How often each (id, source, text) is taken whole: keys, whole epochs, then documents in order of the key."""
    by_source = {}
    for i, source, text in rows:
        by_source.setdefault(source, []).append((i, text, len(WORD.findall(text or ""))))
    goal, out = targets({s: sum(n for _, _, n in d) for s, d in by_source.items()}), {}
    for s, d in by_source.items():
        total = sum(n for _, _, n in d)
        epochs = int(goal[s] // total) if total else 0
        rest = int(goal[s] + 0.5) - epochs * total
        keyed = []
        for i, text, n in d:
            weight = max(0.25, 1 / (1 + abs(len(text or "") / max(n, 1) - 6) / 4))
            u = (int(hashlib.md5(f"{'null' if i is None else i}:mix-1".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            keyed.append((-np.log(u) / weight, i, n))
        for _, i, n in sorted(keyed, key=lambda k: k[0]):
            out[i] = (epochs + (2 * max(0, min(n, rest)) >= n)) if n else 0
            rest -= n
    return out


def test_pipeline_stages_equal_plain_ones(spark, tmp_path):
    """Every stage on its own input, with repeated rows, nulls and columns that clash; then an empty table."""
    import tiktoken

    from webloom.llm import bpe

    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    texts = [t for _, t in near_copies(13, groups=3, copies=20)]
    texts += [" ".join("".join(rng.choice("QWERTY") for _ in range(rng.randint(2, 8))) + "!!" for _ in range(rng.randint(5, 60))) for _ in range(50)]
    texts[5] = "ask someone@example.org or 10.1.2.3 " + " ".join(f"name{i}" for i in range(40))
    label = {i: int("!!" not in (t or "")) for i, t in enumerate(texts)}
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], None if t is None else len(t), 0.0, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[8], (None, "without an id but with words of its own", "en", "a", 7, 0.0, "x", "y")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string, token_ids string"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*label.items(), (2, None)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))

    def after(k, docs):
        out = pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        assert out.columns == [*df.columns, *["token_ids_"] * (k == 4)]
        out.write.parquet(str(tmp_path / f"stage{k}"))
        out = spark.read.parquet(str(tmp_path / f"stage{k}"))
        return out, sorted(((r.doc_id, r.text, r.source, r.n_chars, *r[8:]) for r in out.collect()), key=str)

    base = sorted(((r[0], r[1], r[3], r[4]) for r in rows), key=str)
    docs, got = after(0, spark.read.parquet(str(tmp_path / "documents.parquet")))
    score = plain_quality([(r.doc_id, np.array(r.x)) for r in quality.with_statistics(df, "x").collect()], label)
    assert got == [r for r in base if score[r[0]] >= 0.3] and 0 < len(got) < len(base) - 30

    comp = brute_jaccard(sorted({(r[0], r[1]) for r in got if r[0] is not None}))
    want = [r for k, r in enumerate(got) if r[0] is None or (comp[r[0]][1] == r[0] and (r not in got[:k] or not comp[r[0]][0]))]
    docs, got = after(1, docs)
    assert got == want and len(got) < 130

    def clean(r):
        t = r[1] and r[1].replace("someone@example.org", "[EMAIL]").replace("10.1.2.3", "[IP]")
        return (r[0], t, r[2], len(t) if t is not None and len(r[1]) == r[3] else r[3])

    want = sorted(map(clean, got), key=str)
    docs, got = after(2, docs)
    assert got == want and any("[EMAIL] or [IP]" in (r[1] or "") for r in got)

    times = plain_mix([(r[0], r[2], r[1]) for r in got])
    want = [r for r in got for _ in range(times[r[0]])]
    docs, got = after(3, docs)
    assert got == want and {0, 1} <= set(times.values())

    path, pattern = bpe.vocabulary()
    with open(path, "rb") as f:
        ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    _, last = after(4, docs)
    assert [r[:4] for r in last] == got and all(r[4] == library.encode_ordinary(r[1]) for r in last)

    assert sorted(((r.doc_id, r.text, r.source, r.n_chars, r.token_ids_) for r in pipeline.run(spark, str(tmp_path)).collect()), key=str) == last
    none = tmp_path / "none"
    df.limit(0).write.parquet(str(none / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).limit(0).write.parquet(str(none / "labels.parquet"))
    assert pipeline.run(spark, str(none)).collect() == []


def test_mixing_equals_a_plain_sample_with_equal_keys(docs):
    rows = [(i, "word " * (i % 30)) for i in range(500)]
    want = plain_mix([(r.doc_id, r.source, r.text) for r in docs(rows).collect()])
    got = {}
    for r in mixing.mixed(docs(rows)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in want.items() if n}
    same = docs([(7, "a b c"), (7, "d e"), (7, "a b c"), (None, "f g"), (None, "h")])
    runs = [sorted(map(str, mixing.mix(d).collect())) for d in (same, same.orderBy("text"), same.repartition(4))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 5
