import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from neurolith.operators import retrieval as rt
from neurolith.operators import tables as tb


def test_top_k_equals_brute_force_over_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(300), "embedding": x.tolist()})).repartition(5)
    got = rt.top_k(df, df.filter("vec_id % 10 = 0"), 3, block=7).toPandas()
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        assert g.sort_values("rn")["id"].tolist() == np.lexsort((-np.arange(300), -s))[:3].tolist()
    assert len(got) == 90


def test_top_k_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0]), (5, None), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ask = lambda v: spark.createDataFrame([(9, v)], "vec_id bigint, embedding array<double>")
    assert [(r.id, r.rn) for r in rt.top_k(df, ask([1.0, 0.0]), 3).orderBy("rn").collect()] == [(2, 1), (1, 2)]  # ties: larger id; not above 0: no hit
    assert [r.id for r in rt.top_k(df, ask([0.0, 1.0]), 2).collect()] == [3]  # the best one is returned even so
    assert rt.top_k(df, ask([1.0, 0.0, 0.0])).count() == 0
    assert rt.top_k(df, ask(None)).count() == 0
    assert rt.top_k(df.limit(0), ask([1.0])).count() == 0
    assert rt.top_k(df, ask([1.0, 0.0]), 0).count() == 1


def test_hash_counts_by_definition():
    got = rt.hash_counts("Ab  abcd", 10)  # the dimension is at least 64
    bucket = lambda g: int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little") % 64
    assert set(got) == {bucket("ab"), bucket("abc"), bucket("bcd")}
    assert sum(v * v for v in got.values()) == pytest.approx(1)
    assert rt.hash_counts("  ", 64) == {}


def test_hash_search_equals_brute_force(spark):
    texts = [f"run {i % 7} of the wavelet cleaning {'left' if i % 2 else 'right'} strip {i % 5}" for i in range(40)] + ["", None]
    df = spark.createDataFrame([(f"c{i:02d}", t) for i, t in enumerate(texts)], "id string, t string").repartition(3)
    q = spark.createDataFrame([(1, "cleaning of the left strip"), (2, " "), (3, None), (4, "run 3 wavelet")], "q int, s string")
    got = rt.hash_search(df, q, "id", "t", "q", "s", 3, 512, block=1).toPandas()
    assert set(got["query_id"]) == {"1", "4"}
    for i, text in ((1, "cleaning of the left strip"), (4, "run 3 wavelet")):
        a = rt.hash_counts(text, 512)
        score = lambda t: sum(a.get(b, 0) * w for b, w in rt.hash_counts(t, 512).items())  # noqa: B023, E731
        want = sorted(((round(score(t), 9), f"c{n:02d}") for n, t in enumerate(texts) if t), reverse=True)[:3]
        g = got[got["query_id"] == str(i)].sort_values("rn")
        assert [round(s, 9) for s in g["score"]] == [s for s, _ in want]
    assert rt.hash_search(df.limit(0), q, "id", "t", "q", "s").count() == 0


def test_upsert_is_idempotent_and_carries_flags(spark):
    old = spark.createDataFrame([("d", 0, "x", False), ("d", 1, "y", True), ("e", 0, "z", None)], "document_id string, ord int, content string, enabled boolean")
    new = spark.createDataFrame([("d", 0, "n", None), ("d", 1, "m", None), ("d", 2, "k", None), ("f", 0, "w", None)], "document_id string, ord int, content string, enabled boolean")
    once = rt.upsert(old, new, "document_id", "enabled", "ord")
    got = {(r.document_id, r.ord): (r.content, r.enabled) for r in once.collect()}
    assert got == {("d", 0): ("n", False), ("d", 1): ("m", True), ("d", 2): ("k", True), ("e", 0): ("z", None), ("f", 0): ("w", True)}
    assert sorted(map(tuple, rt.upsert(once, new, "document_id", "enabled", "ord").collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    assert rt.remove(old, new, "document_id").count() == 1


def test_manifest_and_context(spark):
    f = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, s int")
    i = spark.createDataFrame([("b", 3), ("c", None), ("d", 1)], "k string, s int")
    assert {r.k: r.state for r in rt.manifest_diff(f, i, "k", "s").collect()} == {"a": "new", "b": "changed", "c": "same", "d": "gone"}
    h = spark.createDataFrame([(1, 2, "T2", "c2"), (1, 1, "T1", "c1")], "query_id int, rn int, title string, content string")
    assert rt.context_block(h).collect()[0].context == "[1] T1\nc1\n\n[2] T2\nc2"


def test_zero_vector_stays(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "e array<double>")
    assert [r[0] for r in df.select(rt.l2_normalized(F.col("e"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_table_upkeep(spark):
    log = spark.createDataFrame([("j", 1, "a", None), ("j", 2, None, 5), ("j", 3, None, None), ("k", 1, None, None)], "job string, seq int, status string, n int")
    assert {r.job: (r.status, r.n) for r in tb.last_known(log, ["job"], "seq", ["status", "n"]).collect()} == {"j": ("a", 5), "k": (None, None)}
    assert sorted((r.job, r.seq) for r in tb.since_last(log, ["job"], "seq", F.col("status") == "a").collect()) == [("j", 1), ("j", 2), ("j", 3), ("k", 1)]
    d = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "key string, value string")
    s = spark.createDataFrame([("x", " "), ("y", "9"), ("q", "7")], "key string, value string")
    assert {r.key: r.value for r in tb.overlay(d, s, "key", "value").collect()} == {"x": "1", "y": "9", "z": "3"}
    a = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "a array<int>")
    assert [r[0] for r in a.select(tb.tail(F.col("a"), 2)).collect()] == [[2, 3], [], None]
    j = spark.createDataFrame([('{"a": 1}',), ("{bad",), ("",), (None,)], "p string")
    assert [r[0] for r in j.select(tb.decoded(F.col("p"), "a int", F.struct(F.lit(0).alias("a")))["a"]).collect()] == [1, 0, 0, 0]
    assert [r[0] for r in j.select(tb.json_equals(F.col("p"), "$.a", "1")).collect()] == [True, False, False, False]
    x = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, None)], "id int, dataset_id string")
    g = spark.createDataFrame([("d1",), ("d1",)], "dataset_id string")
    assert {r.id: r.dataset_id for r in tb.with_nulled(x, g, "dataset_id").collect()} == {1: None, 2: "d2", 3: None}
    assert [r.id for r in tb.keep_first(x, F.lit(1), F.col("id")).collect()] == [1]
    assert [r.id for r in tb.newest(x, 0, "id", "id").collect()] == [3]
