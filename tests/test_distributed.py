import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from neurolith.functions.distributed import bits_for, hot_keys, lookup, previous_value, running_total, salted_rank, within


def test_salted_rank_is_a_rank_in_hash_order(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").withColumn("rank", F.lit("clash"))
    df = df.drop("rank")
    out = salted_rank(df, ["k"], F.xxhash64("id"), "rank").withColumn("h", F.xxhash64("id")).toPandas()
    for _, g in out.groupby("k"):
        assert sorted(g["rank"]) == list(range(len(g)))
        assert g.sort_values("rank")["h"].is_monotonic_increasing


def test_salted_rank_of_repeated_rows_and_one_hot_group(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), F.lit(7).alias("id"))
    assert sorted(r["rank"] for r in salted_rank(df, ["k"], F.xxhash64("id"), "rank").collect()) == list(range(500))


def test_running_total_and_previous_value_match_numpy_over_stretches(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": ["a"] * 300 + ["b"] * 5, "t": [*rng.permutation(3000)[:300].tolist(), 1, 5, 9, 17, 33], "v": rng.normal(size=305)})
    df = spark.createDataFrame(pdf)
    got = previous_value(running_total(df, ["k"], "t", "v", "before", width=8), ["k"], "t", "v", "prev", width=8).toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values("t")
        assert np.allclose(g["before"], np.r_[0, np.cumsum(g["v"])[:-1]])
        assert np.isnan(g["prev"].iloc[0]) and np.allclose(g["prev"].iloc[1:], g["v"].iloc[:-1])


def test_within_equals_a_plain_range_join(spark):
    points = spark.createDataFrame([("a", t) for t in range(0, 1000, 7)], "k string, t int")
    spans = spark.createDataFrame([(i, "a", s, s + n) for i, (s, n) in enumerate([(0, 10), (250, 300), (255, 2), (999, 0), (-5, 3)])], "i int, k string, s int, e int")
    got = {(r.i, r.t) for r in within(points, spans, "k", "t", "s", "e", width=16).collect()}
    assert got == {(i, t) for i, (s, n) in enumerate([(0, 10), (250, 300), (255, 2), (999, 0), (-5, 3)]) for t in range(0, 1000, 7) if s <= t < s + n}


def test_lookup_spreads_hot_keys_and_equals_a_join(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("k"), F.lit(1).alias("x"), "id")
    facts = spark.createDataFrame([("hot", 1, 5), ("6", 1, 7), ("absent", 1, 9)], "k string, x int, v int")
    hot = hot_keys(df, ["k", "x"], parts=16, least=10)
    assert [(r.k, r.x, r["_copies"]) for r in hot.collect()] == [("hot", 1, 11)]
    for how in ("inner", "left"):
        want = sorted(map(str, df.join(facts, ["k", "x"], how).select("k", "x", "id", "v").collect()))
        assert sorted(map(str, lookup(df, facts, ["k", "x"], hot, how).select("k", "x", "id", "v").collect())) == want
    assert hot_keys(df, ["k"], least=5000) is None and hot_keys(df.limit(0), ["k"]) is None


def test_bits_follow_the_rows():
    assert [bits_for(n) for n in (0, 10, 50_000, 60_000, 10_000_000, 10**15)] == [1, 1, 1, 1, 8, 24]
