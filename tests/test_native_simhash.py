"""Votes are folded where the words are: words neither cross the network nor fill a task's table."""

from webloom.functions import simhash
from webloom.operators import similarity


def test_native_simhash_shuffles_ids_only(spark):
    texts = [(1, ["a", "b", "a", None, "für", "a"]), (2, []), (3, None), (4, [None, None]), (5, ["x"] * 70 + ["y", "z"]), (6, ["b", "a"]), (6, ["a", "a"])]
    df = spark.createDataFrame(texts, "id bigint, w array<string>")
    out = similarity.native_simhash(df, "id", "w")
    words = {}
    for i, w in texts:
        words.setdefault(i, []).extend(x.encode() for x in w or [] if x is not None)
    assert {r.id: r.simhash for r in out.collect()} == {i: simhash.simhash_py(w) for i, w in words.items()}
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
