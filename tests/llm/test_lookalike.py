import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from neurolith.llm import lookalike as la

SAME = [
    ("windows of one", "ｗｉｎｄｏｗｓ of one"),
    ("café", "cafe\u0301"),
    ("the file", "the ﬁle"),
    ("20 °C", "20 ℃"),
    ("a b", "a\u00a0b"),
    ("a b", "a\u2009b"),
    ("word", "wo\u200brd"),
    ("word", "\ufeffwo\u00adr\u034fd"),
    ("speech report", "sреесh rероrt"),
    ("dev-030", "dev\u2011030"),
    ("0.2 µM", "0.2 μM"),
    ("一口人", "⼀⼝⼈"),
    ("дрейф левой", "дpeйф левoй"),
    ("лобной", "лобнои\u0306"),
    ("a\nb", "a\r\nb"),
]
UNLIKE = [("cafe", "café"), ("word", "Word"), ("end.", "end?"), ("cm2", "cm²"), ("a-b", "a–b"), ("3 mm", "3 cm"), ("run 1", "run l"), ("a b", "ab"), ("½", "1/2"), ("①", "1")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert la.skeleton(a) == la.skeleton(b) and a != b


@pytest.mark.parametrize(("a", "b"), UNLIKE)
def test_unlike(a, b):
    assert la.skeleton(a) != la.skeleton(b)


def test_pairs_equal_brute_force(spark):
    texts = [t for p in SAME for t in p] + [t for p in UNLIKE for t in p] + ["", " ", "\u200b", None, "word"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as look", "2 as own", "3 as skeleton")
    got = {tuple(r) for r in la.alike_pairs(df).collect()}
    real = [(i, t) for i, t in enumerate(texts) if t and la.skeleton(t).strip()]
    assert got == {(i, j) for i, a in real for j, b in real if i < j and a != b and la.skeleton(a) == la.skeleton(b)}
    assert len(got) >= len(SAME)


def test_one_form_per_look_and_scripts_stay(spark):
    texts = ["дpeйф левoй лобной", "дрейф левой лобной", "sреесh", "plain", None, " ", "ｗide", "⼀⼝"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.canonical_id, r.form) for r in la.unify(df).collect()}
    assert got[0][1] == got[1][1] == "дрейф левой лобной" and got[0][0] == got[1][0] == 1
    assert got[2] == (2, "speech") and got[3] == (3, "plain") and got[4] == (None, None) and got[5] == (None, " ") and got[6][1] == "wide" and got[7][1] == "一口"


def test_hot_look_of_exact_copies_gives_no_pairs(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'the ﬁle' as text").union(spark.range(3000, 3002).selectExpr("id", "'the file'"))
    assert la.alike_pairs(df.filter("doc_id < 3000")).count() == 0
    assert la.alike_pairs(df.filter("doc_id >= 2990")).count() == 20


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_mapping_is_stable(text):
    assert la.skeleton(la.skeleton(text)) == la.skeleton(text)
    assert la.skeleton(la.written_form(text)) == la.skeleton(text)


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert la.alike_pairs(none).count() == 0 and la.unify(none).count() == 0
    long = "naïve ﬁle " * 50_000
    df = spark.createDataFrame([(1, long), (2, long.replace("ﬁ", "fi"))], "doc_id bigint, text string")
    assert [tuple(r) for r in la.alike_pairs(df).collect()] == [(1, 2)]


def test_canonical_member_is_judged_by_the_whole_text(spark):
    start = "дрейф левой лобной области был больше чем показывал прибор во время записи"
    clean = [f"{start} и прибор рос {n}" for n in range(20)]
    wrong = [t.replace("и прибор рос", "и п\u0070ибо\u0070 \u0070\u006f\u0063") for t in clean]
    assert len(start) > 64 and la.changed(clean[0]) == 0 and la.changed(wrong[0]) == 2 and la.written_form(wrong[0]) != la.written_form(clean[0])
    df = spark.createDataFrame([(f"{k}{n}", t) for k, texts in (("clean", clean), ("wrong", wrong)) for n, t in enumerate(texts)], "doc_id string, text string")
    got = {r.doc_id: (r.canonical_id, r.form) for r in la.unify(df).collect()}
    assert all(got[f"{k}{n}"] == (f"clean{n}", t) for n, t in enumerate(clean) for k in ("clean", "wrong"))
