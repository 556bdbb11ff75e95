import pytest
from pyspark.sql import functions as F

from neurolith.functions import text as tx
from neurolith.functions.distributed import as_of
from neurolith.operators import experiment as ex
from neurolith.operators import index as ix
from neurolith.operators import papers as pp
from neurolith.operators import tables as tb

CAND = "candidate_id bigint, query_id string, pos int, title string, authors array<string>, abstract string, source string, url string, pdf_url string, doi string"


def cand(i, q="q", title=None, abstract=None, source=None, pdf=None, doi=None, pos=0):
    return (i, q, pos, title, None, abstract, source, f"u{i}", pdf, doi)


def test_candidates_without_repeats_in_order(spark):
    rows = [cand(1, title="A b"), cand(2, title="a  B!", pdf="p"), cand(3, doi="10.1/X", abstract="t"), cand(4, doi="10.1/x", pdf="p"), cand(5, title="C", pdf="p"), cand(6, source="direct_url"), cand(7, None)]
    df = pp.gathered(spark.createDataFrame(rows, CAND).withColumn("rank", F.lit("clash")).drop("rank"))
    got = pp.deduplicated(df, ["query_id"], ["part", "candidate_id"]).filter("query_id = 'q'").orderBy("rank")
    assert [(r.candidate_id, r["rank"]) for r in got.collect()] == [(5, 0), (3, 1), (6, 2), (1, 3)]
    many = spark.createDataFrame([cand(i, title=f"T {i}") for i in range(20)], CAND)
    assert pp.deduplicated(many, ["query_id"], ["candidate_id"]).count() == pp.MOST_CANDIDATES
    assert pp.deduplicated(many.limit(0), ["query_id"], ["candidate_id"]).count() == 0


def test_ranking_prefers_score_then_pdf_then_abstract(spark):
    rows = [cand(1, title="deep tcn"), cand(2, title="deep tcn two", pdf="p"), cand(3, title="nothing"), cand(4, title="nothing else", source="direct_url"), cand(5, title="tcn deep x", abstract="deep")]
    q = spark.createDataFrame([("q", "deep tcn"), ("other", "x")], "query_id string, query_text string")
    got = pp.ranked(spark.createDataFrame(rows, CAND), q, "query_id", ["candidate_id"]).orderBy("rn").collect()
    assert [r.candidate_id for r in got] == [2, 5, 1, 4] and got[-1].score == 0
    blank = pp.ranked(spark.createDataFrame(rows, CAND), q.withColumn("query_text", F.lit("")), "query_id", ["candidate_id"])
    assert [r.candidate_id for r in blank.collect()] == [4]


def test_expanded_queries(spark):
    df = spark.createDataFrame([("raw", ["A  b", None, "a B", " ", "c", *"defghij"]), (" raw ", [None]), (None, ["x"])], "q string, l array<string>")
    got = [r[0] for r in df.select(pp.expanded_queries(F.col("q"), F.col("l"))).collect()]
    assert got == [["A b", "c", "d", "e", "f", "g", "h", "i"], ["raw"], ["x"]]


def test_known_folders_by_key_then_title(spark):
    c = spark.createDataFrame([cand(1, doi="10.1/A", title="x"), cand(2, title="Some Title"), cand(3, title="new")], CAND)
    stored = spark.createDataFrame([("doi_10.1_a", "other", "f2"), ("doi_10.1_a", None, "f1"), (None, "some title", "f3"), ("k", "", "f0")], "key string, title string, folder string")
    assert [tuple(r) for r in pp.known_folders(c, stored).orderBy("candidate_id").collect()] == [(1, "f1", "key"), (2, "f3", "title")]


FILES = "source string, path string, updated_at timestamp, size_chars bigint, text string"


def test_index_refresh_update_and_load(spark):
    files = spark.createDataFrame([("a", "/a", None, 3, "one\n\ntwo"), ("b", "/b", None, 1, "b"), ("g", "/g", None, 9, "/G34/G35" * 20), ("n", "/n", None, 0, None), ("e", "/e", None, 1, " \n ")], FILES)
    old = spark.createDataFrame([("a#1", False), ("b#0", None)], "chunk_id string, enabled boolean")
    got = ix.refresh(files, old, ix.by_paragraphs, 64).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.content, r.enabled) for r in got] == [("a#0", "one", True), ("a#1", "two", False), ("b#0", "b", True)] and all(r.buckets for r in got)
    with pytest.raises(ix.StaleIndexError, match="no file"):
        ix.refresh(files.limit(0), old)
    with pytest.raises(ix.StaleIndexError, match="no readable"):
        ix.refresh(files.filter("source = 'g'"), None)
    index = ix.refresh(files.filter("source in ('a', 'b')"), old, ix.by_paragraphs, None).withColumn("content", F.concat(F.lit("old "), "content"))
    manifest = spark.createDataFrame([("a", "/a", None, 3), ("b", "/b", None, 2), ("z", "/z", None, 1)], "source string, path string, updated_at timestamp, size_chars bigint")
    state = ix.states(files.filter("source in ('a', 'b', 'e')"), manifest)
    assert {r.source: r.state for r in state.collect()} == {"a": "current", "b": "stale", "e": "unindexed", "z": "missing"}
    assert {r.state for r in ix.states(files, manifest, same_settings=False).filter("source = 'a'").collect()} == {"stale"}
    new = ix.update(index, files, state, ix.by_paragraphs, None).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.content, r.enabled) for r in new] == [("a#0", "old one", True), ("a#1", "old two", False), ("b#0", "b", True)]
    with pytest.raises(ix.StaleIndexError, match="b is stale|z is missing"):
        ix.loaded(index, state)
    fine = state.filter("state in ('current', 'unindexed')")
    assert ix.loaded(index, fine).count() == 3
    with pytest.raises(ix.StaleIndexError, match="unindexed"):
        ix.loaded(index, fine, allow_unindexed=False)


def test_listing_and_finding_sources(spark):
    k = spark.createDataFrame([("x/b.md",), ("a/b.md",), ("b.md",), ("c",)], "source string")
    assert [r.source for r in ix.listed(k, 0).collect()] == ["a/b.md"] and ix.listed(k).count() == 4
    assert [ix.found(k, n).collect()[0].source for n in ("b.md", "/b.md")] == ["b.md", "a/b.md"] and ix.found(k, "no").count() == 0
    assert spark.createDataFrame([("abc",)], "t string").select(ix.excerpt(F.col("t"), 0)).collect()[0][0] == "a"


def test_statements(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "b", None)], "id int, status string, v string")
    assert [tuple(r) for r in tb.updated(t, F.col("status") == "a", {"v": F.lit("new")}).orderBy("id").collect()] == [(1, "a", "new"), (2, None, "y"), (3, "b", None)]
    assert [tuple(r) for r in tb.merged(t, spark.createDataFrame([(2, "z"), (9, "q")], "id int, status string"), "id").orderBy("id").collect()] == [(1, "a", "x"), (2, "z", "y"), (3, "b", None)]
    assert [tuple(r) for r in tb.inserted(t, spark.createDataFrame([(4,)], "id int")).filter("id = 4").collect()] == [(4, None, None)]
    gone = spark.createDataFrame([(1,), (7,), (1,)], "id int")
    assert tb.deleted(t, gone, "id").count() == 2 and {r.id: r.n for r in tb.affected(t, gone, "id").collect()} == {1: 1, 7: 0}
    assert tb.with_default(t, t.limit(1)).count() == 3 and tb.with_default(t.limit(0), t.filter("id = 2")).count() == 1


def test_as_of_join_equals_brute_force(spark):
    left = [(i, f"k{i % 3}" if i % 10 else None, i * 7 % 101 if i % 11 else None) for i in range(120)]
    right = [(f"k{i % 4}", i * 13 % 101, float(i)) for i in range(60)] + [("k0", 5, None), (None, 1, 1.0)]
    got = {r.i: r.v for r in as_of(spark.createDataFrame(left, "i int, k string, at bigint"), spark.createDataFrame(right, "k string, at bigint, v double"), "k", "at", "v", width=8).collect()}
    assert len(got) == 120
    for i, k, at in left:
        near = [(t, -1.0 if v is None else v) for kk, t, v in right if kk is not None and kk == k and at is not None and t <= at]
        want = max(near)[1] if near else None
        assert got[i] == (None if want == -1.0 else want)


@pytest.mark.parametrize(("text", "want"), [("hello", tx.PLAIN_CHAT), ("my fNIRS question", tx.IN_DOMAIN), ("weather", tx.OUTSIDE), (None, None)])
def test_guardrail(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.guardrail(F.col("t"))).collect()[0][0] == want


def test_stream_pieces_give_the_text_back(spark):
    def pieces(text):
        out, held = [], ""
        for c in text:
            held += c
            if len(held) >= 28 or c in "。！？\n":
                out.append(held)
                held = ""
        return [*out, held] if held else out

    texts = ["", "a" * 28, "a" * 57, "ab。cd\n" + "e" * 27 + "！f", "。。", "x" * 27 + "\n" + "y"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.stream_pieces(F.col("t")).alias("p")).collect()
    assert all(r.p == pieces(r.t) for r in got)


def test_experiments_by_strategy(spark):
    rows = spark.createDataFrame([(i, i % 2, f"s{i % 4}", [float(i % 2) + 0.01 * i, 1.0]) for i in range(40)], "epoch_id int, label int, grp string, x array<double>")
    for name, folds in (("LOSO", 4), (None, 4), (" Group-KFold", 2), ("holdout", 1)):
        o = ex.run(rows, "epoch_id", name, folds=2)
        assert o.folds.count() == folds and o.predictions.filter("label = prediction").count() == o.predictions.count()
        p = o.progress.orderBy("seq").collect()
        assert [r.seq for r in p] == list(range(folds + 4)) and [p[0].progress, p[-1].progress] == [0.05, 1.0]
    assert ex.run(rows, "epoch_id", "holdout").predictions.count() == 8
    with pytest.raises(ex.ExperimentError):
        ex.run(rows.filter("label = 1"), "epoch_id")
    with pytest.raises(ex.ExperimentError):
        ex.strategy_name("lottery")


def test_search_over_stored_vectors_equals_hashing_anew(spark):
    from neurolith.operators import retrieval as rt

    c = spark.createDataFrame([(f"c{i}", f"run {i % 5} of the wavelet cleaning {i}") for i in range(30)] + [("blank", " ")], "chunk_id string, content string")
    q = spark.createDataFrame([("q1", "wavelet run 3"), ("q2", "cleaning 17"), ("q3", "")], "q string, s string")
    want = sorted(map(tuple, rt.hash_search(c, q, "chunk_id", "content", "q", "s", 3, 256).collect()))
    stored = ix.embedded(c, 256)
    assert sorted(map(tuple, rt.hash_search(stored, q, "chunk_id", "content", "q", "s", 3, 256).collect())) == want and len(want) == 6


def test_moments_survive_a_large_offset(spark):
    from neurolith.operators import prototype as pt

    rows = spark.createDataFrame([(i % 2, f"s{i % 3}", [1e9 + i % 4]) for i in range(24)], "label int, grp string, x array<double>")
    got = pt.train_moments(pt.leave_one_group_out(rows)).collect()
    assert len(got) == 3 and all(abs(r.sd - 1.25**0.5) < 1e-6 and abs(r["mean"] - 1e9 - 1.5) < 1e-6 for r in got)
