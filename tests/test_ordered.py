from pyspark.sql import functions as F

from docweave.operators import ordered


def test_two_level_windows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "STRETCH", 4)
    data = [("g", i, f"k{i:03}", i if i % 5 == 2 else None) for i in range(30)]
    df = spark.createDataFrame(data, "g string, o int, k string, v int")
    got = {r.o: r for r in ordered.running_sum(df, "g", ["o", "k"], F.lit(2), "s").collect()}
    assert all(got[i].s == 2 * (i + 1) for i in range(30))
    last = {r.o: r.l for r in ordered.last_value(df, "g", ["o", "k"], F.col("v"), "l").collect()}
    assert last == {i: max((x for x in range(i + 1) if x % 5 == 2), default=None) for i in range(30)}
    before = {r.o: r.p for r in ordered.previous(df, "g", ["o", "k"], F.col("o"), "p").collect()}
    assert before == {i: i - 1 if i else None for i in range(30)}


def test_ranks_over_ranges(spark):
    data = [("hot" if i % 4 else None, f"p{(i * 37) % 101:03}") for i in range(101)]
    df = spark.createDataFrame(data, "g string, k string")
    got = {(r.g, r.k): r.n for r in ordered.ranked(df, ["g"], ["k"], "n", slices=7).collect()}
    for g in ("hot", None):
        own = sorted(k for h, k in data if h == g)
        assert [got[(g, k)] for k in own] == list(range(1, len(own) + 1))
    assert ordered.ranked(df.limit(0), ["g"], ["k"], "n").count() == 0
