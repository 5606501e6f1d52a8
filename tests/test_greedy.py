"""Greedy acceptance against a loop over all accepted signatures, and how its work grows."""

import random

import pytest

from webloom.operators import similarity


def plain(rows, k):
    kept, out = {}, []
    for grp, seq, h in sorted(rows, key=lambda r: r[1]):
        near = h is not None and any(((h ^ o) & (1 << 64) - 1).bit_count() <= k for o in kept.get(grp, []))
        if h is not None and not near:
            kept.setdefault(grp, []).append(h)
        out.append((str(grp), seq, not near))
    return sorted(out)


def near_rows(n):
    rng = random.Random(7)
    sigs, out = [rng.getrandbits(64) for _ in range(4)], []
    for i in range(n):  # long chains, as most are one or two bits beside an earlier one
        h = rng.choice(sigs) ^ (1 << rng.randrange(64) if rng.random() < 0.8 else 0) ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0)
        sigs.append(h)
        out.append((rng.choice(["a", "b", None]), i, None if i % 97 == 5 else h - (1 << 64) if h >> 63 else h))
    return out


@pytest.mark.parametrize("k, local", [(2, 1 << 20), (2, 50), (0, 50), (1, 50), (3, 50)])
def test_greedy_equals_a_loop(spark, monkeypatch, k, local):
    monkeypatch.setattr(similarity, "LOCAL_CELLS", local)
    rows = near_rows(600)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "g string, id bigint, simhash bigint")
    got = similarity.greedy_accept(df, "g", "id", k).collect()
    assert sorted((str(r.grp), r.seq, r.accepted) for r in got) == plain(rows, k)


def test_greedy_cells_grow_with_the_rows(spark):
    # all signatures agree in 48 bits, so that any key of half the bits puts many of them together
    df = spark.range(4096).selectExpr("'a' AS grp", "id AS seq", "id AS n", "(id * 4 + 3) << 20 AS simhash")
    assert similarity._cells(df, 2).count() == 65 * 4096 and similarity._cells(df, 2).groupBy("cell").count().agg({"count": "max"}).first()[0] <= 65
    # no group goes to one Python task with all its rows
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", None, 6), ("a", 3, None)], "g string, id bigint, simhash bigint")
    assert sorted((str(r.seq), r.accepted) for r in similarity.greedy_accept(df, "g", "id").collect()) == [("1", False), ("1", True), ("3", True), ("None", False)]
