"""A whole experiment as one plan: preprocessing, windows, folds by strategy, predictions, metrics, progress and explanation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolith.operators import epochs as ep
from neurolith.operators import prototype as pt
from neurolith.operators import signals as sg

# Names of the strategies, and the share of the work that is done at each step.
STRATEGIES = {"loso": "loso", "leave_one_subject_out": "loso", "group_kfold": "group_kfold", "groupkfold": "group_kfold", "group_k_fold": "group_kfold", "holdout": "holdout"}
LOADED, PREPARED, FOLDS_FROM, FOLDS_SHARE, SAVED, DONE = 0.05, 0.15, 0.25, 0.6, 0.9, 1.0


class ExperimentError(ValueError):
    """An experiment that cannot be run on its rows."""


@dataclass(frozen=True)
class Preprocessing:
    """Steps in their order; low and high None: no band-pass."""

    optical_density: bool = True
    scale: bool = True
    repair_steps: bool = True
    low: float | None = None
    high: float | None = None
    method: str = "fft"
    tmin: float = -2.0
    tmax: float = 10.0


def preprocess(x: DataFrame, rates: DataFrame, c: Preprocessing) -> DataFrame:
    """Readings after optical density, scaling, repair and band-pass, as far as they are asked for."""
    for asked, step in ((c.optical_density, sg.optical_density), (c.scale, sg.scale_by_sd), (c.repair_steps, sg.repair_steps)):
        x = step(x) if asked else x
    return sg.band_pass(x, rates, c.low, c.high, c.method)


def epoch_samples(x: DataFrame, recordings: DataFrame, epochs: DataFrame, c: Preprocessing) -> DataFrame:
    """Samples of the event-locked windows of preprocessed readings."""
    heads = ep.headers(recordings)
    rates = heads.select("recording_id", F.col("sampling_rate").alias("rate"))
    return ep.samples(preprocess(x, rates, c), ep.windows(epochs, heads, c.tmin, c.tmax))


def epoch_rows(samples: DataFrame, epochs: DataFrame, names: list[str]) -> DataFrame:
    """(epoch_id, recording_id, label, x) of labelled epochs: the named features, averaged over the channels of an epoch, since
    recordings differ in theirs."""
    f = ep.features(samples).groupBy("epoch_id").agg(F.array(*[F.avg(n) for n in names]).alias("x"))
    e = epochs.filter("epoch_id is not null and label is not null").select("epoch_id", "recording_id", "label")
    return e.join(f, "epoch_id")


def strategy_name(name: str | None) -> str:
    """Canonical name of a strategy however it is spelled; null is loso. Raises for an unknown one."""
    n = (name or "loso").strip().lower().replace("-", "_").replace(" ", "_")
    if n not in STRATEGIES:
        raise ExperimentError(f"unknown strategy {name!r}")
    return STRATEGIES[n]


def folded(rows: DataFrame, strategy: str | None, folds: int = 5, seed: int = 42, order: str = "epoch_id") -> DataFrame:
    """Rows with fold, the fold that validates them; null for rows that only train (holdout)."""
    s = strategy_name(strategy)
    if s == "loso":
        return pt.leave_one_group_out(rows)
    if s == "group_kfold":
        return pt.group_k_fold(rows, folds, seed)
    return pt.holdout(rows, order).withColumn("fold", F.when(F.col("is_val"), "Holdout").otherwise("train")).drop("is_val")


@dataclass(frozen=True)
class Outcome:
    """Tables of an experiment."""

    predictions: DataFrame
    folds: DataFrame
    confusion: DataFrame
    metrics: DataFrame
    progress: DataFrame


def run(rows: DataFrame, key: str, strategy: str | None = None, folds: int = 5, seed: int = 42, strict: bool = True) -> Outcome:
    """Validates the classifier on rows (key, label, grp, x). Raises if fewer than two labels occur; unless ``strict``, such rows
    are classified as they are, and no rows give empty tables."""
    if strict and rows.select("label").distinct().limit(2).count() < 2:
        raise ExperimentError("an experiment needs at least two labels")
    split = folded(rows, strategy, folds, seed, key)
    pred = pt.predictions(pt.distances(split, key), key).filter("fold <> 'train'")
    return Outcome(pred, pt.fold_accuracy(pred), pt.confusion(pred), pt.class_metrics(pred), progress(split.filter("fold <> 'train'").select("fold")))


def progress(folds: DataFrame) -> DataFrame:
    """(seq, progress, message): what has been done when, a row per fold in the order of their names."""
    w = Window.partitionBy(F.lit(0)).orderBy("fold")
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    f = folds.distinct().select((F.row_number().over(w) - 1).alias("i"), n.alias("n"), "fold")
    middle = f.select((F.col("i") + 2).cast("bigint").alias("seq"), (FOLDS_FROM + FOLDS_SHARE * F.col("i") / F.col("n")).alias("progress"), F.concat(F.lit("training "), "fold").alias("message"))
    step = lambda seq, p, m: F.struct(seq.cast("bigint").alias("seq"), F.lit(p).alias("progress"), F.lit(m).alias("message"))
    ends = folds.distinct().agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(F.array(step(F.lit(0), LOADED, "loaded"), step(F.lit(1), PREPARED, "preprocessed"), step(F.col("n") + 2, SAVED, "saved"), step(F.col("n") + 3, DONE, "done"))).alias("s")
    )
    return middle.unionByName(ends.select("s.*"))


def explanation(importance: DataFrame, top: int = 8) -> DataFrame:
    """(axis, idx, importance): channels scaled by the most important one, times and bands as they are, to six decimals; and the
    ``top`` channels, to four, under the axis top."""
    ch = importance.filter("axis = 'channel'")
    most = ch.agg(F.greatest(F.max("importance"), F.lit(1e-8)).alias("_m"))
    scaled = ch.join(F.broadcast(most)).withColumn("importance", F.col("importance") / F.col("_m")).drop("_m")
    best = scaled.orderBy(F.desc("importance"), F.desc("idx")).limit(top).withColumn("axis", F.lit("top"))
    rest = importance.filter("axis <> 'channel'").unionByName(scaled)
    six: Column = F.round("importance", 6)
    return rest.withColumn("importance", six).unionByName(best.withColumn("importance", F.round("importance", 4)))


def explanation_json(rows: DataFrame, experiment_id: str, method: str = "prototype-activation") -> DataFrame:
    """One row with the JSON of an explanation; arrays in the order of their index, the top channels from the first on."""
    axis = lambda a: F.transform(F.array_sort(F.collect_list(F.when(F.col("axis") == a, F.struct("idx", "importance")))), lambda s: s["importance"]).alias(f"{a}_importance")
    best = F.array_sort(F.collect_list(F.when(F.col("axis") == "top", F.struct((-F.col("importance")).alias("_o"), (-F.col("idx")).alias("_i"), F.concat(F.lit("Ch"), (F.col("idx") + 1).cast("string")).alias("channel"), "importance"))))
    one = rows.agg(axis("channel"), axis("time"), axis("band"), F.transform(best, lambda s: F.struct(s["channel"].alias("channel"), s["importance"].alias("importance"))).alias("top_channels"))
    return one.select(F.to_json(F.struct(F.lit(experiment_id).alias("experiment_id"), F.lit(method).alias("method"), "channel_importance", "time_importance", "band_importance", "top_channels")).alias("json"))
