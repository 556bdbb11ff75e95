import numpy as np
import pandas as pd
import pytest

from neurolith.llm import splits as sp

REC = "recording_id string, dataset_id string, site string, default_subject string, subject_ids array<string>"
EPO = "epoch_id bigint, recording_id string, subject string, label int"
LNK = "site_a string, code_a string, site_b string, code_b string"


@pytest.mark.parametrize(("code", "want"), [("S032", "32"), (" s1 ", "1"), ("Ｓ０１８", "18"), ("sub-040_ses-02", "40"), ("S019_run3", "19"), ("Subject 2", "2"), ("participant 9", "9"), ("7", "7"), ("S-0", "0"), ("S00000", "0"), ("n/a", None), ("?", None), ("", None), ("test", None), ("unknown", None), ("subject_0", None), ("Subject_0", None), (" SUBJECT_0 ", None), ("ｓｕｂｊｅｃｔ＿０", None), ("subject_1", "1"), (None, None), ("abc", None)])
def test_person_number(spark, code, want):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(sp.person_number(df.c)).collect()[0][0] == want


def groups(rec, epo, links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def union(a, b):
        parent[find(b)] = find(a)

    number = lambda c: c[1:].lstrip("0") or "0"
    for r, _, site, d, subs in rec:
        for c in [d, *(subs or [])]:
            if c:
                union(("r", r), ("p", site, number(c)))
    site_of = {r[0]: r[2] for r in rec}
    for _, r, s, _ in epo:
        if s and r in site_of:
            union(("r", r), ("p", site_of[r], number(s)))
    for a, b, c, d in links:
        union(("p", a, number(b)), ("p", c, number(d)))
    out = {}
    for e, r, _, _ in epo:
        out.setdefault(find(("r", r)), []).append(e)
    return {(min(g), e) for g in out.values() for e in g if e != min(g)}


def test_tied_epochs_equal_union_find(spark):
    rng = np.random.default_rng(2)
    rec = [(f"r{i}", f"d{i % 3}", f"s{i % 2}", f"S{rng.integers(60):03d}", [f"S{rng.integers(60):02d}" for _ in range(rng.integers(0, 3))] or None) for i in range(60)]
    epo = [(i, f"r{rng.integers(70)}", rng.choice(["", *[f"S{k}" for k in range(60)]]) or None, int(rng.integers(3))) for i in range(300)]
    links = [(f"s{rng.integers(2)}", f"S{rng.integers(60)}", f"s{rng.integers(2)}", f"S{rng.integers(60)}") for _ in range(8)]
    got = {tuple(r) for r in sp.tied_epochs(spark.createDataFrame(rec, REC), spark.createDataFrame(epo, EPO), spark.createDataFrame(links, LNK)).collect()}
    assert got == groups(rec, epo, links)


def test_stand_ins_tie_nothing(spark):
    rec = [("a", "d", "s", "subject_0", ["Subject_0", "S1"]), ("b", "d", "s", None, ["subject_0"]), ("c", "d", "s", "SUBJECT_0", ["S2"]), ("e", "d", "s", None, ["participant 1"])]
    epo = [(1, "a", "subject_0", 0), (2, "b", "Subject_0", 0), (3, "c", "subject_0", 1), (4, "e", "subject_0", 1), (5, "b", None, 1)]
    links = [("s", "subject_0", "s", "S2"), ("s", "S1", "t", "Subject_0")]
    got = {tuple(r) for r in sp.tied_epochs(spark.createDataFrame(rec, REC), spark.createDataFrame(epo, EPO), spark.createDataFrame(links, LNK)).collect()}
    assert got == {(1, 4), (2, 5)}


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(f"r{i:04d}", f"p{j}") for i in range(300) for j in (i, i + 1)], "record string, entity string")
    labels = sp.propagate(edges).collect()
    assert len(labels) == 300 and {r.label for r in labels} == {"r0000"}


def test_splits_keep_groups_and_hold_shares(spark):
    rng = np.random.default_rng(3)
    rec = [(f"r{i}", "d", "s", f"S{i // 2 + 1}", None) for i in range(200)]
    epo = [(i, f"r{i % 200}", None, int(rng.integers(2)) if i % 9 else None) for i in range(4000)]
    x = spark.createDataFrame([("e1", "d", 7, 70.0, 15.0, 15.0), ("e2", "d", 8, 0.5, None, 0.25), ("e3", None, 1, 0.5, 0.25, 0.25), ("e4", "d", None, None, None, None)], "experiment_id string, dataset_id string, seed bigint, train_share double, val_share double, test_share double")
    links = spark.createDataFrame([], LNK)
    got = sp.split_epochs(spark.createDataFrame(rec, REC), spark.createDataFrame(epo, EPO), links, x).toPandas()
    assert set(got["experiment_id"]) == {"e1", "e2", "e4"} and len(got) == 3 * 4000
    for e, want in (("e1", [0.7, 0.15, 0.15]), ("e2", [0.5, 0.25, 0.25]), ("e4", [0.7, 0.15, 0.15])):
        g = got[got["experiment_id"] == e].assign(person=lambda d: d["epoch_id"] % 200 // 2)
        assert (g.groupby("person")["split"].nunique() == 1).all()
        assert np.allclose([(g["split"] == s).mean() for s in sp.SPLITS], want, atol=0.02)
        labels = g.merge(pd.DataFrame(epo, columns=["epoch_id", "r", "s", "label"]), on="epoch_id")
        ones = labels.groupby("split")["label"].mean()
        assert ones.max() - ones.min() < 0.05
    again = sp.split_epochs(spark.createDataFrame(rec, REC), spark.createDataFrame(epo, EPO), links, x, items=20).toPandas()  # most groups in bundles
    assert (again[again["experiment_id"] == "e1"].assign(person=lambda d: d["epoch_id"] % 200 // 2).groupby("person")["split"].nunique() == 1).all()


def test_empty_and_null_rows(spark):
    none = [spark.createDataFrame([], s) for s in (REC, EPO, LNK)]
    assert sp.tied_epochs(*none).count() == 0
    rec = spark.createDataFrame([("a", None, None, "S1", None), (None, "d", "s", "S1", ["S1"])], REC + "")
    epo = spark.createDataFrame([(1, "a", None, None), (2, "a", "S9", 0), (3, None, "S1", 0), (None, "a", None, 0), (2, "a", "S9", 0)], EPO)
    links = spark.createDataFrame([("s", None, "s", "S1"), (None, "S1", "s", "S2"), ("s", "S1", "s", "S1")], LNK)
    assert [tuple(r) for r in sp.tied_epochs(rec, epo, links).collect()] == [(1, 2)]
