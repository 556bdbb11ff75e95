"""Queries of the prototype classifier and of vector search over the embeddings table, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolith.operators import prototype as pt
from neurolith.operators import retrieval as rt
from neurolith.plans.signal_queries import snap, snap_sql
from neurolith.session import table
from neurolith.sources import sinks


def _rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").filter("vec_id is not null and label is not null and embedding is not null")
    return e.select("vec_id", "label", (F.col("vec_id") % 5).alias("grp"), F.col("embedding").alias("x"))


def _loso(spark, d):
    return pt.leave_one_group_out(_rows(spark, d))


def _pred(spark, d):
    return pt.predictions(pt.distances(_loso(spark, d), "vec_id"), "vec_id")


def loso_folds(spark, d):
    return _loso(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("n_val"))


def group_kfold(spark, d):
    """Groups per fold of the seeded shuffle."""
    r = pt.group_k_fold(_rows(spark, d).withColumn("grp", F.col("vec_id") % 23), 5, 42)
    return r.groupBy("fold").agg(F.count(F.lit(1)).alias("n_val"), F.countDistinct("grp").alias("n_groups"))


def holdout_split(spark, d):
    return pt.holdout(_rows(spark, d).select("vec_id", "label"), "vec_id").select("vec_id", "is_val")


def standardize_train(spark, d):
    return pt.train_moments(_loso(spark, d)).select("fold", "f", "n", snap(F.col("mean")).alias("mean"), snap(F.col("sd")).alias("sd"))


def centroids(spark, d):
    return pt.centroids(_loso(spark, d)).select("fold", "label", "f", snap(F.col("c"), 5).alias("c"))


def prototype_distance(spark, d):
    return pt.distances(_loso(spark, d), "vec_id").select("vec_id", "fold", "class", snap(F.col("distance"), 5).alias("distance"))


def prototype_softmax(spark, d):
    return pt.probabilities(pt.distances(_loso(spark, d), "vec_id"), "vec_id").select("vec_id", "fold", "class", snap(F.col("p"), 5).alias("p"))


def prototype_predict(spark, d):
    return _pred(spark, d)


def fold_accuracy(spark, d):
    return pt.fold_accuracy(_pred(spark, d)).select("fold", "n", snap(F.col("accuracy"), 4).alias("accuracy"))


def pooled_accuracy(spark, d):
    return _pred(spark, d).agg(F.count(F.lit(1)).alias("n"), snap(F.avg((F.col("label") == F.col("prediction")).cast("double")), 4).alias("accuracy"))


def confusion_matrix(spark, d):
    return pt.confusion(_pred(spark, d))


def per_class_metrics(spark, d):
    return pt.class_metrics(_pred(spark, d)).select("class", *[snap(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")])


def experiment_report(spark, d):
    """Markdown report of the pooled validation."""
    pred = _pred(spark, d)
    return sinks.report(sinks.result_json(pred, pt.fold_accuracy(pred), pt.confusion(pred)))


def l2_normalize_norms(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", snap(rt.l2_norm(F.col("embedding"))).alias("norm"), snap(rt.l2_norm(rt.l2_normalized(F.col("embedding")))).alias("after"))


def vector_topk(spark, d):
    """Queries: every row whose id is divisible by 100; index: all rows."""
    e = table(spark, d, "embeddings")
    return rt.top_k(e, e.filter("vec_id % 100 = 0"), 4).select("query_id", "id", "rn", snap(F.col("score")).alias("score"))


def vector_topk_enabled(spark, d):
    """Like vector_topk over an index whose label-0 rows are switched off before they are ranked."""
    e = table(spark, d, "embeddings")
    return rt.top_k(e.filter("label <> 0"), e.filter("vec_id % 100 = 0"), 10).select("query_id", "id", "rn", snap(F.col("score")).alias("score"))


R = "r AS (SELECT vec_id, label, 'LOSO ' || (vec_id % 5) AS fold, embedding::DOUBLE[] AS x FROM embeddings)"
L = f"{R}, l AS (SELECT vec_id, label, fold, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS f FROM r), folds AS (SELECT DISTINCT fold FROM r)"
T = f"{L}, m AS (SELECT folds.fold, f, count(*) AS n, avg(v) AS mean, CASE WHEN stddev_pop(v) < 1e-12 THEN 1 ELSE stddev_pop(v) END AS sd FROM folds JOIN l ON l.fold <> folds.fold GROUP BY ALL)"
CN = f"{T}, c AS (SELECT m.fold, l.label, m.f, avg((v - mean) / sd) AS c FROM m JOIN l ON l.fold <> m.fold AND l.f = m.f GROUP BY ALL)"
DI = f"{CN}, d AS (SELECT l.vec_id, l.fold, l.label, c.label AS class, sqrt(sum(((l.v - m.mean) / m.sd - c.c) ** 2)) AS distance FROM l JOIN m ON m.fold = l.fold AND m.f = l.f JOIN c ON c.fold = l.fold AND c.f = l.f GROUP BY ALL)"
PR = f"{DI}, p AS (SELECT vec_id, fold, label, arg_min(class, (distance, class)) AS prediction FROM d GROUP BY vec_id, fold, label)"


def _topk(where: str, k: int) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id % 100 = 0 AND {where}),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rn FROM s)
        SELECT query_id, id, CAST(rn AS INTEGER) AS rn, {snap_sql("score")} AS score FROM r WHERE rn <= {k} AND (score > 0 OR rn = 1)"""


SQL = {
    "loso_folds": f"WITH {R} SELECT fold, count(*) AS n_val FROM r GROUP BY fold",
    "holdout_split": "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 >= least(greatest(1, floor((SELECT count(*) FROM embeddings) * 0.8)), (SELECT count(*) FROM embeddings) - 1) AS is_val FROM embeddings",
    "standardize_train": f"WITH {T} SELECT fold, CAST(f AS INTEGER) AS f, n, {snap_sql('mean')} AS mean, {snap_sql('sd')} AS sd FROM m",
    "centroids": f"WITH {CN} SELECT fold, label, CAST(f AS INTEGER) AS f, {snap_sql('c', 5)} AS c FROM c",
    "prototype_distance": f"WITH {DI} SELECT vec_id, fold, class, {snap_sql('distance', 5)} AS distance FROM d",
    "prototype_softmax": f"WITH {DI}, s AS (SELECT vec_id, fold, class, exp(-(distance - min(distance) OVER (PARTITION BY vec_id))) AS e FROM d) SELECT vec_id, fold, class, {snap_sql('e / greatest(sum(e) OVER (PARTITION BY vec_id), 1e-8)', 5)} AS p FROM s",
    "prototype_predict": f"WITH {PR} SELECT vec_id, fold, label, prediction FROM p",
    "fold_accuracy": f"WITH {PR} SELECT fold, count(*) AS n, {snap_sql('avg((label = prediction)::INTEGER)', 4)} AS accuracy FROM p GROUP BY fold",
    "pooled_accuracy": f"WITH {PR} SELECT count(*) AS n, {snap_sql('avg((label = prediction)::INTEGER)', 4)} AS accuracy FROM p",
    "confusion_matrix": f"WITH {PR}, k AS (SELECT label AS c FROM p UNION SELECT prediction FROM p) SELECT a.c AS label, b.c AS prediction, count(p.vec_id) AS n FROM k a JOIN k b ON true LEFT JOIN p ON p.label = a.c AND p.prediction = b.c GROUP BY a.c, b.c",
    "per_class_metrics": f"""WITH {PR}, k AS (SELECT label AS c FROM p UNION SELECT prediction FROM p), g AS (SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (label = c) AS n, count(*) FILTER (prediction = c) AS m FROM k JOIN p ON true GROUP BY c),
        f AS (SELECT c, tp / greatest(m, 1) AS pr, tp / greatest(n, 1) AS re FROM g) SELECT c AS class, {snap_sql('pr', 4)} AS precision, {snap_sql('re', 4)} AS recall, {snap_sql('2 * pr * re / greatest(pr + re, 1e-8)', 4)} AS f1 FROM f""",
    "l2_normalize_norms": f"WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) SELECT vec_id, {snap_sql('n')} AS norm, {snap_sql('CASE WHEN n = 0 THEN 0 ELSE 1 END')} AS after FROM n",
    "vector_topk": _topk("true", 4),
    "vector_topk_enabled": _topk("e.label <> 0", 10),
}

QUERIES = {
    f.__name__: f
    for f in (
        loso_folds, group_kfold, holdout_split, standardize_train, centroids, prototype_distance, prototype_softmax, prototype_predict, fold_accuracy,
        pooled_accuracy, confusion_matrix, per_class_metrics, experiment_report, l2_normalize_norms, vector_topk, vector_topk_enabled,
    )
}
