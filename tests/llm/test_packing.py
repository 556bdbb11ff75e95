from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from neurolith.llm import mixing as mx
from neurolith.llm import packing as pk
from neurolith.llm.tokens import DEFAULT_VOCABULARY, token_count

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(DEFAULT_VOCABULARY), reason="no vocabulary")


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20), st.integers(50, 80))
def test_plan_places_every_text_once_within_capacity(counts, capacity):
    load: Counter = Counter()
    ranks = defaultdict(list)
    for size, rank, number, first in pk.plan_containers(counts, capacity):
        for i in range(number):
            load[first + i] += size
            ranks[size].append(rank + i)
    assert all(v <= capacity for v in load.values())
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
    assert sorted(load) == list(range(len(load)))
    least = -(-sum(s * n for s, n in counts.items()) // capacity) if counts else 0
    assert len(load) <= 2 * least + 1


@pytest.fixture(scope="module")
def tables(spark):
    texts = [(i, "signal " * (i % 40 + 1), ["Lab Wiki", "lab_wiki", "glossary", None][i % 4]) for i in range(400)]
    texts += [(900 + i, "signal " * 5, "glossary") for i in range(300)]  # one hot length
    texts += [(2000, None, "glossary"), (2001, "", "glossary"), (2002, "word " * 3000, "lab-wiki"), (2003, "   ", "glossary")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, source string").selectExpr("*", "1 as tokens", "2 as size", "3 as rank")
    specs = spark.createDataFrame([("a", 64), ("b", 500), ("b", 256), ("c", 0), (None, 9)], "spec_id string, capacity_tokens int")
    return docs, specs


def test_pack_is_whole_and_tight(spark, tables):
    docs, specs = tables
    sizes = {r[0]: r[1] for r in docs.select("doc_id", token_count(docs.text)).collect() if r[1]}
    got = pk.pack(docs, specs).toPandas()
    assert set(got["spec_id"]) == {"a", "b"}
    for s, cap in (("a", 64), ("b", 500)):
        g = got[got["spec_id"] == s]
        assert g.groupby("doc_id")["size"].sum().to_dict() == sizes
        assert (g.groupby("container")["size"].sum() <= cap).all()
        split = g.groupby("doc_id").size()
        assert all(sizes[d] > cap for d in split[split > 1].index)
        assert g["size"].sum() / (g["container"].nunique() * cap) > 0.97
    fill = {r.spec_id: r for r in pk.fill(pk.pack(docs, specs), specs).collect()}
    assert fill["a"].fullest <= 64 and fill["a"].share_used > 0.97


def test_harmonic_containers_take_a_fixed_count(tables):
    g = pk.pack_harmonic(*tables).toPandas()
    per = g.groupby(["spec_id", "class", "container"]).agg(n=("size", "size"), used=("size", "sum")).reset_index()
    assert (per["n"] <= per["class"]).all() and (per["used"] <= per["spec_id"].map({"a": 64, "b": 500})).all()


def test_empty(spark, tables):
    docs, specs = tables
    assert pk.pack(docs.limit(0), specs).count() == 0 and pk.pack(docs, specs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=12), st.integers(0, 600))
def test_subset_sum_is_exact(counts, budget):
    take = mx.subset_sum(counts, budget)
    got = sum(n * c for n, c in take.items())
    assert all(0 <= take[n] <= c for n, c in counts.items()) and got <= budget
    # never farther from the budget than what the proportional start leaves to an exact knapsack over the rest
    total = sum(n * c for n, c in counts.items())
    if budget < total:
        start = {n: c * budget // total for n, c in counts.items()}
        rest, missing = [n for n, c in counts.items() for _ in range(c - start[n])], budget - sum(n * c for n, c in start.items())
        reach = 1
        for n in rest:
            reach |= reach << n
        assert got == budget - missing + (reach & ((1 << (missing + 1)) - 1)).bit_length() - 1


def test_mix_reaches_shares_and_respects_repeats(spark, tables):
    docs, _ = tables
    t = spark.createDataFrame([("m", "lab wiki", 0.5, 2), ("m", "glossary", 0.4, 3), ("m", "absent", 0.1, 2), ("n", "GLOSSARY", 1.0, 1), (None, "glossary", 1.0, 1), ("o", "absent", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    d = mx.draw(docs, t)
    got = d.toPandas()
    assert got.groupby(["mix_id", "doc_id"]).size().max() == 1
    assert got[(got["mix_id"] == "m") & (got["source"] == "lab_wiki")]["repeats"].max() <= 2 and got[got["source"] == "glossary"]["repeats"].max() <= 3
    r = {(x.mix_id, x.source): x for x in mx.reached(d, t).collect()}
    assert abs(r["m", "lab_wiki"].actual_share - 5 / 9) < 1e-3 and r["m", "absent"].actual_share == 0 and r["o", "absent"].tokens == 0
    assert r["n", "glossary"].actual_share == 1.0
    assert sorted(map(tuple, mx.draw(docs, t).collect())) == sorted(map(tuple, d.collect()))
    assert sorted(map(tuple, mx.draw(docs, t, seed=18).collect())) != sorted(map(tuple, d.collect()))
    assert mx.draw(docs.limit(0), t).count() == 0 and mx.draw(docs, t.limit(0)).count() == 0


def test_long_runs_are_counted(spark):
    df = spark.createDataFrame([("x" * 200_000,), (None,), ("",), ("<|endoftext|>",)], "t string")
    n = [r[0] for r in df.select(token_count(df.t)).collect()]
    assert n[0] > 1000 and n[1] is None and n[2] == 0 and n[3] > 1
