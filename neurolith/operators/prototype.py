"""Subject-wise validation of a nearest-centroid classifier, all folds in one plan.

Rows are (key..., label, grp, x) with x an array of features. The sums of a fold's training rows are the sums of all rows less
those of the fold's own groups, so that every row is read once, whatever the number of folds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leave_one_group_out(rows: DataFrame) -> DataFrame:
    """Adds fold: the row's own group is the validation part of the fold that bears its name."""
    return rows.withColumn("fold", F.concat(F.lit("LOSO "), F.col("grp").cast("string")))


def group_k_fold(rows: DataFrame, folds: int = 5, seed: int = 42, most: int = 100_000) -> DataFrame:
    """Adds fold: the sorted groups are shuffled by NumPy's generator and cut into nearly equal parts.

    Group names reach the driver, at most ``most``; beyond that a group's fold is a seeded hash of its name, so that the parts are
    of about equal size only.
    """
    groups = rows.select(F.col("grp").cast("string").alias("grp")).distinct()
    names = sorted(r[0] for r in groups.limit(most + 1).collect())
    folds = max(2, min(folds, max(2, len(names))))
    if len(names) <= most:
        shuffled = np.asarray(names)
        np.random.default_rng(seed).shuffle(shuffled)
        pairs = [(str(g), f"GroupKFold {i}") for i, part in enumerate(np.array_split(shuffled, folds), start=1) for g in part]
        where = rows.sparkSession.createDataFrame(pairs, "grp_name string, fold string")
        return rows.join(where, F.col("grp").cast("string") == F.col("grp_name")).drop("grp_name")
    return rows.withColumn("fold", F.concat(F.lit("GroupKFold "), (F.pmod(F.xxhash64(F.lit(seed), F.col("grp").cast("string")), F.lit(folds)) + 1).cast("string")))


def holdout(rows: DataFrame, order: str, share: float = 0.8, buckets: int = 4096) -> DataFrame:
    """Adds is_val: of the rows in ``order`` (a whole number) the last part. Fewer than two rows: none is validated.

    The cut is found by counts in ever narrower ranges of ``order``, at most ``buckets`` rows at a time, and the rows are only
    compared with it. Rows of equal order stay together, beyond the cut; those without one come first.
    """
    o = F.col(order)
    n, known, low, high = rows.agg(F.count(F.lit(1)), F.count(o), F.min(o), F.max(o)).first()
    cut = min(max(1, int(n * share)), n - 1) if n > 1 else n
    left = cut - (n - known)  # rows with an order that train
    if left >= known:
        return rows.withColumn("is_val", F.lit(False))
    low, high, left = int(low), int(high), max(left, 0)
    while high > low:
        width = -(-(high - low + 1) // buckets)
        counts = rows.filter(o.between(low, high)).groupBy(F.floor((o - F.lit(low)) / F.lit(width)).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        for b, m in sorted((int(r["b"]), r["n"]) for r in counts):
            if left < m:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            left -= m
    return rows.withColumn("is_val", F.coalesce(o >= F.lit(low), F.lit(False)))


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("fold", "label", F.posexplode("x").alias("f", "v")).withColumn("v", F.col("v").cast("double"))


def train_moments(rows: DataFrame) -> DataFrame:
    """(fold, f, n, mean, sd) over each fold's training rows; a standard deviation of 0 counts as 1.

    Sums of squares are kept about means (of a fold, of all rows), so that a large offset of a feature does not cancel them out.
    """
    part = _long(rows).groupBy("fold", "f").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"))
    centre = part.groupBy("f").agg(F.sum("n").alias("all_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all_mean"))
    x = part.join(centre, "f").withColumn("d", F.col("mean") - F.col("all_mean"))
    whole = x.groupBy("f").agg(F.sum(F.col("m2") + F.col("n") * F.col("d") * F.col("d")).alias("all_m2"))
    left = F.col("all_n") - F.col("n")
    shift = -F.col("n") * F.col("d") / left  # of the training mean from the mean of all
    rest = F.col("all_m2") - F.col("m2") - F.col("n") * F.col("d") * F.col("d") - left * shift * shift
    m = x.join(whole, "f").filter("all_n > n").select("fold", "f", left.alias("n"), (F.col("all_mean") + shift).alias("mean"), F.sqrt(F.greatest(rest, F.lit(0.0)) / left).alias("sd"))
    return m.withColumn("sd", F.when(F.col("sd") < 1e-12, 1.0).otherwise(F.col("sd")))


def centroids(rows: DataFrame) -> DataFrame:
    """(fold, label, f, c): mean of the standardised training rows of each class."""
    part = _long(rows).groupBy("fold", "label", "f").agg(F.count("v").alias("n"), F.sum("v").alias("s"))
    all_ = part.groupBy("label", "f").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    m = train_moments(rows)
    x = m.select("fold", "f", "mean", "sd").join(all_, "f").join(part, ["fold", "label", "f"], "left")
    n, s = F.col("all_n") - F.coalesce("n", F.lit(0)), F.col("all_s") - F.coalesce("s", F.lit(0.0))
    return x.filter(n > 0).select("fold", "label", "f", ((s / n - F.col("mean")) / F.col("sd")).alias("c"))


def distances(rows: DataFrame, key: str) -> DataFrame:
    """(key, fold, label, class, distance) of every row to the classes of its own fold's training rows."""
    packed = lambda df, by, v: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", v))), lambda s: s[v]).alias(v))
    m = train_moments(rows)
    scale = packed(m, ["fold"], "mean").join(packed(m, ["fold"], "sd"), "fold")
    c = packed(centroids(rows), ["fold", "label"], "c").withColumnRenamed("label", "class").join(scale, "fold")
    z = lambda: F.zip_with(F.zip_with(F.zip_with("x", "mean", lambda a, b: a.cast("double") - b), "sd", lambda a, b: a / b), "c", lambda a, b: (a - b) * (a - b))
    d = F.sqrt(F.aggregate(z(), F.lit(0.0), lambda a, b: a + b))
    return rows.select(key, "fold", "label", "x").join(c, "fold").select(key, "fold", "label", "class", d.alias("distance"))


def probabilities(dist: DataFrame, key: str) -> DataFrame:
    """Softmax of the negative distances over the classes of a row."""
    w = Window.partitionBy("fold", key)
    e = F.exp(-(F.col("distance") - F.min("distance").over(w)))
    return dist.withColumn("e", e).select(key, "fold", "label", "class", "distance", (F.col("e") / F.greatest(F.sum("e").over(w), F.lit(1e-8))).alias("p"))


def predictions(dist: DataFrame, key: str) -> DataFrame:
    """(key, fold, label, prediction): the nearest class, the smallest of equally near ones."""
    return dist.groupBy(key, "fold", "label").agg(F.min(F.struct("distance", "class")).alias("b")).select(key, "fold", "label", F.col("b.class").alias("prediction"))


def fold_accuracy(pred: DataFrame) -> DataFrame:
    return pred.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def confusion(pred: DataFrame) -> DataFrame:
    """(label, prediction, n) over all classes that occur as either, with zeros."""
    classes = pred.select(F.explode(F.array("label", "prediction")).alias("c")).agg(F.collect_set("c").alias("cs"))
    grid = classes.select("cs", F.explode("cs").alias("label")).select("label", F.explode("cs").alias("prediction"))
    counts = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(pred: DataFrame) -> DataFrame:
    """(class, precision, recall, f1), denominators at least 1 (1e-8 for f1)."""
    side = lambda c, real, said, tp: F.struct(F.col(c).alias("c"), F.lit(real).alias("real"), F.lit(said).alias("said"), tp.alias("tp"))
    sides = pred.select(F.explode(F.array(side("label", 1, 0, F.coalesce((F.col("label") == F.col("prediction")).cast("int"), F.lit(0))), side("prediction", 0, 1, F.lit(0)))).alias("x"))
    g = sides.groupBy(F.col("x.c").alias("class")).agg(F.sum("x.tp").alias("tp"), F.sum("x.real").alias("n"), F.sum("x.said").alias("m"))
    g = g.select("class", (F.col("tp") / F.greatest("m", F.lit(1))).alias("precision"), (F.col("tp") / F.greatest("n", F.lit(1))).alias("recall"))
    return g.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-8)))


# The families a model may be asked for; all share the prototype classifier.
FAMILIES = ("fnirs-eegnet", "cnn-lstm", "tcn", "graph-tcn", "hybrid-3d-cnn")


def family(name: str) -> str:
    """Canonical family name; raises for an unknown one."""
    n = name.strip().lower().replace("_", "-")
    if n not in FAMILIES:
        raise ValueError(f"unknown model family {name!r}")
    return n


def family_features(model: str) -> list[str]:
    """Feature columns of ``epochs.features`` that a family uses, in order."""
    base = ["mean", "sd", "peak", "trough", "slope"]
    extra = {"tcn": ["mean_step"], "graph-tcn": ["mean_step"], "hybrid-3d-cnn": ["energy"]}
    return base + extra.get(family(model), [])
