import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from neurolith.llm import pieces as pc

TEXT = st.text(alphabet=st.sampled_from(list("ab .\n#。é́中,!?-\r")), max_size=400)


def rejoined(text, cuts, overlap):
    return "".join(text[s if i == 0 else s + overlap : e] for i, (s, e) in enumerate(cuts))


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 60), st.integers(0, 30))
def test_round_trip_limits_and_overlap(text, limit, overlap):
    cuts = pc.cut_points(text, limit, overlap)
    overlap = min(overlap, limit - 1)
    assert all(e - s <= limit for s, e in cuts)
    assert all(b[0] == a[1] - overlap for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert rejoined(text, cuts, overlap) == text
    assert len(text) > limit or len(cuts) == 1


def test_cuts_fall_at_the_coarsest_boundary():
    para = "One sentence here. Another one there. A third follows."
    text = f"{para}\n\n{para}\n\n## Next\n\n{para}"
    ends = [text[s:e] for s, e in pc.cut_points(text, 130, 10)]
    assert ends[0].endswith("\n") and text[pc.cut_points(text, 130, 10)[0][1] :].startswith("## Next")
    words = pc.cut_points("word " * 50, 23, 0)
    assert all(e % 5 == 0 for _, e in words)
    assert pc.cut_points("x" * 25, 10, 0) == [(0, 10), (10, 20), (20, 25)]
    assert pc.cut_points("e\u0301" * 9, 5, 0)[0][1] % 2 == 0  # a combining accent stays with its letter


def test_numbers_with_points_and_abbreviations_are_no_ends():
    text = "A drift of 3.47 units, e.g. at the cap, was seen. " * 3
    assert all(text[:e].endswith("seen. ") for _, e in pc.cut_points(text, 60, 0)[:-1])


@pytest.fixture
def tables(spark):
    chunks = [("d", 0, "short", 1), ("d", 2, "word " * 30, 1), ("d", 2, "word " * 30, 2), ("d", 5, "tail", 1), ("d", 6, None, 1), ("e", 0, "中" * 25, 1), ("x", 0, "y" * 99, 1), (None, 0, "z", 1), ("d", 7, "", 1)]
    c = spark.createDataFrame(chunks, "document_id string, ord int, content string, at int").selectExpr("*", "timestamp_seconds(at) as indexed_at", "'s' as shelf", "1 as n_pieces").drop("at")
    k = spark.createDataFrame([("d", "a"), ("e", "b"), ("e", "b"), ("f", None)], "document_id string, shelf string")
    limits = spark.createDataFrame([("a", 50, 10), ("b", 10, None), (None, 1, 1)], "shelf string, max_chars int, overlap_chars int")
    return c, k, limits


def test_pieces_continue_the_order(tables):
    got = {(r.document_id, r.new_ord): r for r in pc.all_pieces(*tables).collect()}
    d = [got["d", i] for i in range(sum(k[0] == "d" for k in got))]
    assert [r.ord for r in d] == [0, 2, 2, 2, 2, 5, 7] and [r.piece_idx for r in d] == [0, 0, 1, 2, 3, 0, 0]
    assert "".join(r.piece if r.piece_idx == 0 else r.piece[10:] for r in d if r.ord == 2) == "word " * 30
    assert [got["e", i].n_chars for i in range(3)] == [10, 10, 5] and got["x", 0].n_chars == 99  # no shelf, no limit


def test_sizes_agree(tables):
    got = {r.document_id: (r.size_chars, r.chunk_count) for r in pc.recomputed_sizes(*tables).collect()}
    assert got == {"d": (159, 7), "e": (25, 3), "x": (99, 1)}


def test_empty(spark, tables):
    c, k, limits = (t.limit(0) for t in tables)
    assert pc.all_pieces(c, k, limits).count() == 0 and pc.recomputed_sizes(c, k, limits).count() == 0


def test_very_long_text():
    text = ("Sentence with some words. " * 40 + "\n\n") * 400
    cuts = pc.cut_points(text, 900, 120)
    assert rejoined(text, cuts, 120) == text and len(cuts) > 400
