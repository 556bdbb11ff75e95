import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from neurolith.operators import prototype as pt


def brute(x, y, g):
    """Leave-one-group-out nearest centroids, written out."""
    out = np.empty(len(y), int)
    dist = {}
    for fold in np.unique(g):
        tr, va = g != fold, g == fold
        mu, sd = x[tr].mean(0), x[tr].std(0)
        sd[sd < 1e-12] = 1
        z = (x - mu) / sd
        classes = np.unique(y[tr])
        c = np.stack([z[tr & (y == k)].mean(0) for k in classes])
        d = np.linalg.norm(z[va][:, None, :] - c[None], axis=2)
        out[va] = classes[d.argmin(1)]
        for i, row in zip(np.flatnonzero(va), d, strict=True):
            dist[i] = dict(zip(classes.tolist(), row, strict=True))
    return out, dist


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 6))
    x[:, 3] = 1.0  # constant feature
    y, g = rng.integers(0, 3, 80), rng.integers(0, 4, 80)
    df = spark.createDataFrame(pd.DataFrame({"id": range(80), "label": y, "grp": g, "x": x.tolist()}))
    return x, y, g, df


def test_predictions_equal_brute_force(table):
    x, y, g, df = table
    want, dist = brute(x, y, g)
    d = pt.distances(pt.leave_one_group_out(df), "id").cache()
    assert all(abs(r.distance - dist[r.id][r["class"]]) < 1e-8 for r in d.collect())
    got = {r.id: r.prediction for r in pt.predictions(d, "id").collect()}
    assert [got[i] for i in range(80)] == want.tolist()
    p = pt.probabilities(d, "id").toPandas()
    assert np.allclose(p.groupby("id")["p"].sum(), 1.0)


def test_metrics(spark):
    pred = spark.createDataFrame([(1, "f", 0, 0), (2, "f", 0, 1), (3, "g", 1, 1), (4, "g", 2, 1)], "id int, fold string, label int, prediction int")
    cm = {(r.label, r.prediction): r.n for r in pt.confusion(pred).collect()}
    assert len(cm) == 9 and sum(cm.values()) == 4 and cm[2, 2] == 0 and cm[0, 1] == 1
    m = {r["class"]: (r.precision, r.recall) for r in pt.class_metrics(pred).collect()}
    assert m == {0: (1.0, 0.5), 1: (1 / 3, 1.0), 2: (0.0, 0.0)}
    assert {r.fold: r.accuracy for r in pt.fold_accuracy(pred).collect()} == {"f": 0.5, "g": 0.5}
    assert pt.confusion(pred.limit(0)).count() == 0


def test_a_training_part_of_one_class_predicts_it(spark):
    df = spark.createDataFrame([(1, 0, 0, [1.0]), (2, 0, 0, [2.0]), (3, 1, 1, [5.0])], "id int, label int, grp int, x array<double>")
    got = {r.id: r.prediction for r in pt.predictions(pt.distances(pt.leave_one_group_out(df), "id"), "id").collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_folds_and_holdout(table, spark):
    df = table[3]
    k = pt.group_k_fold(df, 3, 1).toPandas()
    assert k["fold"].nunique() == 3 and (k.groupby("grp")["fold"].nunique() == 1).all()
    few = pt.group_k_fold(df, 3, 1, most=2).toPandas()  # the way for very many groups
    assert (few.groupby("grp")["fold"].nunique() == 1).all() and len(few) == 80
    h = pt.holdout(df.select("id"), "id").toPandas()
    assert h["is_val"].sum() == 16 and h[h["is_val"]]["id"].min() == 64
    assert pt.holdout(df.select("id").limit(1), "id").collect()[0]["is_val"] is False


@settings(max_examples=20, deadline=None)
@given(st.sampled_from(["TCN", "graph_tcn", " Hybrid-3D-CNN ", "cnn_lstm"]))
def test_family_names(name):
    assert pt.family_features(name)[:5] == ["mean", "sd", "peak", "trough", "slope"]


def test_unknown_family():
    with pytest.raises(ValueError):
        pt.family("tree")


def test_holdout_cut_is_the_rank_whatever_the_spread(spark):
    from pyspark.sql import functions as F

    values = [5, -3, 10**15, 7, 8, 9, 11, -(10**12), 4, 6]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "o bigint")
    got = {r.o: r.is_val for r in pt.holdout(df, "o", 0.8, buckets=3).collect()}
    want = sorted(values)
    assert got == {None: False, **{v: i + 1 >= 8 for i, v in enumerate(want)}}
    ties = spark.createDataFrame([(1,)] * 6 + [(2,)] * 4, "o bigint")
    assert pt.holdout(ties, "o", 0.8).filter("is_val").count() == 4 and pt.holdout(ties.limit(1), "o").filter("is_val").count() == 0
    assert pt.holdout(ties.limit(0), "o").count() == 0 and pt.holdout(df.filter(F.col("o").isNull()), "o").filter("is_val").count() == 0
