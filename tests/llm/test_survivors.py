import datetime as dt

import pytest

from neurolith.llm import survivors as sv

SCHEMA = "candidate_id bigint, title string, authors array<string>, year string, abstract string, source string, doi string, fetched_at timestamp"
T = "Sparse unmixing of event-locked averages in night-shift crews during reach-to-grasp"
A = "The export from the device lists many events but only some of them carry a subject in the second cohort of the study"
NAMES = ["Mokel Istgalrt", "Mofen Dunquaé"]
AT = dt.datetime(2024, 1, 1)

ROWS = [
    (1, f"{T}: an open protocol", NAMES, "2020", None, "open_index", "10.1111/abc", AT),
    (2, f"{T.upper()}: AN OPEN PROTOCOL.", ["M. Istgalrt", "et al."], "2020-05", "n/a", "registry_feed", "https://resolver.example/10.1111%2FABC", AT),
    (3, f"<i>{T}</i> – an opne protocol", ["Istgalrt, Mokel", "Dunquae, Mofen"], "2019", f"Abstract: {A}", "preprint_hub", "10.0777/pre.77.v2", AT),
    (4, f"[{T[:60]}…", NAMES, None, f"<p>{A[:80]}", "model_candidate", "n/a", AT + dt.timedelta(days=3)),
    (5, f"{T}, Part I: an open protocol", NAMES, "2020", None, "open_index", None, AT),
    (6, f"{T}, Part II: an open protocol", NAMES, "2020", None, "open_index", None, AT),
    (7, f"Corrigendum to: {T}: an open protocol", NAMES, "2020", None, "open_index", None, AT),
    (8, "Editorial", ["A. Aaa"], "2020", None, "open_index", "10.1/proc.1", AT),
    (9, "Editorial", ["B. Bbb"], "2020", None, "open_index", "10.1/proc.1", AT),
    (10, "Editorial", ["Aaa, Anna"], "2020", None, "open_index", None, AT),
    (11, None, None, None, f"{A}", "direct_url", None, None),
    (12, None, None, None, None, None, None, None),
    (13, None, None, None, None, None, None, None),
    (14, f"{T}: an open protocol", ["X. Other", "Y. Else"], "2020", None, "open_index", "10.1111/zzz", AT),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS + [ROWS[0]], SCHEMA).withColumn("work_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))


def test_pairs(table):
    got = {tuple(r) for r in sv.same_work_pairs(table).collect()}
    one = [1, 2, 3, 4, 11]
    assert got == {(a, b) for a in one for b in one if a < b} | {(8, 10)}


def test_survivor_fields(spark, table):
    trust = spark.createDataFrame([("registry_feed", 1), ("open_index", 2), ("preprint_hub", 3), ("model_candidate", 5)], "source string, trust_rank int")
    got = {r.work_id: r for r in sv.survivors(table, trust).collect()}
    r = got[1]
    assert r.records == 5 and r.title == f"{T}: an open protocol" and r.doi == "10.1111/abc" and r.source == "registry_feed" and r.abstract.startswith("The export")
    assert got[12].title is None and got[12].records == 1 and len(got) == 9


def test_hot_keys_are_joined_by_a_second_trait_only(spark):
    rows = [(i, i == 7, [f"1 t{i % 10}", "n x"] if i != 3 else [f"1 t{i % 10}"], "d|10.1/vol") for i in range(40)] + [(50, False, [], "z|o"), (51, True, [], "z|o"), (52, False, [], "z|o")]
    df = spark.createDataFrame(rows, "rep bigint, bare boolean, fine array<string>, key string")
    full = {tuple(r) for r in sv.candidate_pairs(df).collect()}
    assert full == {(i, j) for i in range(40) for j in range(i + 1, 40)} | {(50, 51), (51, 52)}
    few = {tuple(r) for r in sv.candidate_pairs(df.filter("array_contains(fine, '1 t3') or key like 'z%'"), most=2).collect()}
    assert few == {(i, j) for i in (3, 13, 23, 33) for j in (3, 13, 23, 33) if i < j}


def test_cleaning():
    assert sv.clean_title("Comment on: A b c") == ("a b c", "comment", 0, False)
    assert sv.clean_title("  n/a ")[0] is None and sv.clean_title(None)[0] is None
    assert sv.clean_title("X of Y, Part IV")[2] == 4 and sv.clean_title("X of Y dur…")[2:] == (-1, True)
    assert sv.clean_doi(" DOI 10.1/AB.") == (None, False)  # a registrant has four digits or more
    assert sv.clean_doi("doi:10.1234/AB.C.") == ("10.1234/ab.c", False) and sv.clean_doi("10.0000/000") == (None, False)
    assert sv.clean_doi("10.0777/pre.1.v3") == ("10.0777/pre.1", True)
    assert sv.clean_names(["Dorrié T", "T. Fen", "Fen, Tom", "et al."]) == (["dorrie", "fen", "fen"], True)
    assert sv.near("conuting", "counting", 2) and not sv.near("grip", "gaze", 2) and sv.near("", "ab", 2)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sv.same_work_pairs(none).count() == 0
    assert sv.survivors(none, spark.createDataFrame([], "source string, trust_rank int")).count() == 0


def test_abstracts_are_compared_as_a_whole(spark):
    start = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70))
    ends = [" ".join(f"{w}{chr(97 + i)}" for i in range(20)) for w in ("left", "right")]
    assert sv.clean_abstract(f"{start} {ends[0]}") == f"{start} {ends[0]}"
    assert sv.abstracts_agree(f"{start} a 5 b c d", f"{start} a 6 b c d") == 0
    assert sv.abstracts_agree(start, f"{start} {ends[0]}") == 69
    rows = [(i, None, NAMES, "2020", f"{start} {end}", "open_index", None, AT) for i, end in enumerate([ends[0], ends[1], ends[0]], 1)]
    assert [tuple(r) for r in sv.same_work_pairs(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 3)]


def test_slips_in_the_titles_do_not_make_a_volume(spark):
    a, b = "Robust tuinng of frontal oxygen levels under changing amplitude", "Robust tuning of frontal oxygen levels under changign maplitude"
    c, d = "Robust tuning of fronatl oxygen levels under changing amplitude", "Gaze and posture in older drivers on rural roads at night"
    assert not sv.titles_differ(sv.plain(a), sv.plain(b)) and sv.titles_differ(sv.plain(a), sv.plain(d)) and sv.titles_differ("editorial", sv.plain(d))
    doi, vol = "10.1111/one", "10.1111/vol"
    rows = [(i, t, None, "2020", None, "open_index", doi, AT) for i, t in enumerate([a, b, c, None], 1)]
    rows += [(i, t, None, "2020", None, "open_index", vol, AT) for i, t in enumerate([c, d, None], 11)]
    df = spark.createDataFrame(rows, SCHEMA)
    titled = spark.createDataFrame([(doi, sv.plain(t)) for t in (a, b, c)] + [(vol, sv.plain(t)) for t in (c, d)], "doi string, core string")
    assert [r.doi for r in sv.volumes(titled).collect()] == [vol]
    got = {tuple(r) for r in sv.same_work_pairs(df).collect()}
    assert {(i, j) for i in range(1, 5) for j in range(i + 1, 5)} <= got and not any(13 in p or p == (11, 12) for p in got)


def test_no_link_depends_on_how_many_share_a_key(spark):
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "xz"]
    slipped = f"{T}: an open protocol".replace("Sparse", "Sprse").replace("event-locked averages in", "event-lockd averages in")
    rows = [(i, f"{T}: an open protocol", ["A. Holm"], "2020", " ".join(words[i % 90 : i % 90 + 12]) + f" copy {i}", "open_index", "10.1111/hot", AT) for i in range(450)]
    rows += [(900, None, None, None, None, "direct_url", "10.1111/hot", AT), (901, slipped, ["A. Hol"], "2020", None, "open_index", "10.1111/hot", AT)]
    got = {r.candidate_id: r.work_id for r in sv.work_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got.values()) == {0} and len(got) == 452


def test_pairs_are_rejected_beside_their_keys_and_no_link_is_lost(spark):
    """Many unlike works share the words of a key or an opening sentence: their texts are not compared, all links stay."""
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "xz"]
    some = lambda i, n: " ".join(words[(i * 7 + k * (i % 11 + 1)) % len(words)] for k in range(n))
    stock = "In the naive split windows of one person appeared on both sides which"
    title = "Adaptive gating of baseline stability in amateur dancers: "
    rows = [(i, title + some(i, 6), [f"A. {words[i]}um"], "2020", f"{stock} {some(i + 5, 30)}", "open_index", None, AT) for i in range(100)]
    rows += [(200 + i, (title + some(i, 6)).replace("stability", "stabiltiy").upper(), None, "2021", None, "open_index", None, AT) for i in range(0, 100, 4)]
    rows += [(300 + i, (title + some(i, 6))[:80] + "…", [f"{words[i]}um, Ann"], "2020", None, "open_index", None, AT) for i in range(0, 100, 5)]
    rows += [(400 + i, None, None, None, f"{stock} {some(i + 5, 20)} [truncated]", "direct_url", None, AT) for i in range(0, 100, 3)]
    rows += [(600, None, None, None, "Run one two one two one two one two one two one two one two one two one two one two three", "direct_url", None, AT)]
    rows += [(601, None, None, None, "one two one two one two one two one two one two one two one two one two one two three", "direct_url", None, AT)]
    records = list(next(sv._features(iter(spark.createDataFrame(rows, SCHEMA).toArrow().combine_chunks().to_batches()))).to_pylist())
    f = spark.createDataFrame([tuple(r.values()) for r in records], sv.FEATURES).withColumnRenamed("candidate_id", "rep")
    likely = {tuple(r) for r in sv.likely_pairs(f).collect()}
    keyed = [(r["candidate_id"], r["core"] is None, k) for r in records for k in set(sv.keys_of(r["core"], r["kind"], r["part"], r["names"], r["doi"], r["abstract"]))]
    shared = {tuple(r) for r in sv.candidate_pairs(spark.createDataFrame(keyed, "rep bigint, bare boolean, key string")).collect()}
    by_id = {}
    for r in records:
        x = by_id[r["candidate_id"]] = sv._Row()
        x.shared = False
        for c in sv.TEXTS:
            setattr(x, c, r[c])
    linked = {(i, j) for i, j in shared if sv.same_work(by_id[i], by_id[j])}
    assert linked <= likely <= shared
    assert len(linked) > 50 and 2 * len(likely) < len(shared)
