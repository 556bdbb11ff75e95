"""Queries of whole experiments and their explanation, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolith.operators import epochs as ep
from neurolith.operators import experiment as ex
from neurolith.operators import prototype as pt
from neurolith.operators import signals as sg
from neurolith.plans.signal_queries import C, D, E, H, S, X, _tddr, snap, snap_sql
from neurolith.session import table
from neurolith.sources import sinks

RAW = ex.Preprocessing(optical_density=False, scale=False, repair_steps=False)


def _samples(spark: SparkSession, d: str, c: ex.Preprocessing) -> DataFrame:
    return ex.epoch_samples(sg.readings(table(spark, d, "signal_long")), table(spark, d, "recordings"), table(spark, d, "epochs"), c)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled epochs with five features, grouped by site."""
    rows = ex.epoch_rows(_samples(spark, d, RAW), table(spark, d, "epochs"), pt.family_features("cnn-lstm"))
    sites = ep.headers(table(spark, d, "recordings")).filter("site is not null").select("recording_id", F.col("site").alias("grp"))
    return rows.join(sites, "recording_id").select("epoch_id", "label", "grp", "x")


def pipeline_epochs(spark, d):
    """Features of the windows after optical density, scaling and repair."""
    f = ep.features(_samples(spark, d, ex.Preprocessing()))
    return f.select("epoch_id", "channel_idx", "n", *[snap(F.col(c), 3).alias(c) for c in ("peak", "trough", "slope")])


def experiment_rows(spark, d):
    x = _rows(spark, d)
    return x.select("epoch_id", "label", "grp", *[snap(F.col("x")[i], 4).alias(f"x{i}") for i in range(5)])


def experiment_run(spark, d):
    """Accuracy by fold of leaving one site out."""
    return ex.run(_rows(spark, d), "epoch_id", "LOSO", strict=False).folds.select("fold", "n", snap(F.col("accuracy"), 4).alias("accuracy"))


def experiment_holdout(spark, d):
    """Confusion of the last fifth of the epochs."""
    return ex.run(_rows(spark, d), "epoch_id", "holdout", strict=False).confusion


def experiment_progress(spark, d):
    return ex.run(_rows(spark, d), "epoch_id", " loso", strict=False).progress.select("seq", snap(F.col("progress"), 4).alias("progress"), "message")


def _banded(spark: SparkSession, d: str) -> DataFrame:
    """Samples by band and channel: neighbouring channels are the two wavelengths of one place."""
    x = _samples(spark, d, RAW)
    return x.withColumn("band_idx", F.col("channel_idx") % 2).withColumn("channel_idx", F.floor(F.col("channel_idx") / 2).cast("int"))


def band_importance(spark, d):
    return ep.importance(_banded(spark, d), bands=True).select("axis", "idx", snap(F.col("importance"), 3).alias("importance"))


def explanation(spark, d):
    e = ex.explanation(ep.importance(_banded(spark, d), bands=True))
    return e.select("axis", "idx", snap(F.col("importance"), 3).alias("importance"))


def explanation_json(spark, d):
    return ex.explanation_json(ex.explanation(ep.importance(_banded(spark, d), bands=True)), "all")


def recommended_settings(spark, d):
    r = sg.recommendations(ep.headers(table(spark, d, "recordings")))
    return r.select("recording_id", "low", snap(F.col("high")).alias("high"), "repair_steps", "tmin", "tmax")


def stacked_bands(spark, d):
    """Readings per band: every third channel has both haemoglobins beside the raw readings, every third one of them."""
    x = sg.readings(table(spark, d, "signal_long"))
    names = F.when(F.col("channel_idx") % 3 == 0, F.array(F.lit("raw"), F.lit("HbO"), F.lit("HbR"))).when(F.col("channel_idx") % 3 == 1, F.array(F.lit("raw"), F.lit("HbR"))).otherwise(F.array(F.lit("raw")))
    s = x.withColumn("recording_id", F.concat_ws("/", "recording_id", (F.col("channel_idx") % 3).cast("string"))).withColumn("band", F.explode(names))
    return ep.stack_bands(s).groupBy("recording_id", "band", "band_idx").agg(F.count(F.lit(1)).alias("n"))


def result_document(spark, d):
    """Pooled accuracy and number of samples in the JSON of a result."""
    o = ex.run(_rows(spark, d), "epoch_id", "loso", strict=False)
    j = F.from_json("json", "n_samples bigint, accuracy double, folds array<string>").alias("j")
    return sinks.result_json(o.predictions, o.folds, o.confusion).select(j).select("j.n_samples", snap(F.col("j.accuracy"), 3).alias("accuracy"), F.size("j.folds").alias("folds"))


FEATURES = f"""{X}, {H}, {S}, {E}, ft AS (SELECT epoch_id, channel_idx, avg(v) AS mean, stddev_pop(v) AS sd, max(v) AS peak, min(v) AS trough, arg_max(v, k) - arg_min(v, k) AS slope FROM e GROUP BY 1, 2),
    rw AS (SELECT p.epoch_id, p.label, h.site AS grp, [avg(f.mean), avg(f.sd), avg(f.peak), avg(f.trough), avg(f.slope)] AS x FROM epochs p JOIN ft f USING (epoch_id) JOIN h ON h.recording_id = p.recording_id WHERE p.label IS NOT NULL AND h.site IS NOT NULL GROUP BY 1, 2, 3)"""


def _classified(fold: str, tested: str) -> str:
    """CTEs up to the prediction of every row by what the rows of other folds teach."""
    return f"""{FEATURES}, r AS (SELECT epoch_id, label, {fold} AS fold, x FROM rw), l AS (SELECT epoch_id, label, fold, unnest(x) AS v, generate_subscripts(x, 1) AS f FROM r), folds AS (SELECT DISTINCT fold FROM r WHERE {tested}),
    m AS (SELECT folds.fold, f, avg(v) AS mean, CASE WHEN stddev_pop(v) < 1e-12 THEN 1 ELSE stddev_pop(v) END AS sd FROM folds JOIN l ON l.fold <> folds.fold GROUP BY ALL),
    c AS (SELECT m.fold, l.label, m.f, avg((v - mean) / sd) AS c FROM m JOIN l ON l.fold <> m.fold AND l.f = m.f GROUP BY ALL),
    d AS (SELECT l.epoch_id, l.fold, l.label, c.label AS class, sqrt(sum(((l.v - m.mean) / m.sd - c.c) ** 2)) AS distance FROM l JOIN m ON m.fold = l.fold AND m.f = l.f JOIN c ON c.fold = l.fold AND c.f = l.f GROUP BY ALL),
    p AS (SELECT epoch_id, fold, label, arg_min(class, (distance, class)) AS prediction FROM d GROUP BY epoch_id, fold, label)"""


LOSO = _classified("'LOSO ' || grp", "true")
LAST = _classified("CASE WHEN (SELECT count(*) FROM rw q WHERE q.epoch_id < rw.epoch_id) >= least(greatest(1, floor((SELECT count(*) FROM rw) * 0.8)), (SELECT count(*) FROM rw) - 1) THEN 'Holdout' ELSE 'train' END", "fold = 'Holdout'")
BANDED = f"{X}, {H}, {S}, {E}, b AS (SELECT channel_idx // 2 AS ch, channel_idx % 2 AS band, k, abs(v) AS a FROM e)"
AXES = f"""{BANDED}, i AS (SELECT CASE WHEN grouping(ch) = 0 THEN 'channel' WHEN grouping(band) = 0 THEN 'band' ELSE 'time' END AS axis, CAST(CASE WHEN grouping(ch) = 0 THEN ch WHEN grouping(band) = 0 THEN band ELSE k END AS BIGINT) AS idx, avg(a) AS importance
    FROM b GROUP BY GROUPING SETS ((ch), (k), (band)))"""

SQL = {
    "pipeline_epochs": f"""WITH {X.replace("x AS", "x0 AS", 1)}, o AS (SELECT recording_id, channel_idx, t, -ln(greatest(v, 1e-6::DOUBLE) / greatest(avg(v) OVER ({C}), 1e-6::DOUBLE)) AS v FROM x0),
        x1 AS (SELECT recording_id, channel_idx, t, v / CASE WHEN stddev_pop(v) OVER ({C}) = 0 THEN 1 ELSE stddev_pop(v) OVER ({C}) END AS v FROM o), {D.replace("FROM x)", "FROM x1)")}, {_tddr("x1", 9).rsplit("SELECT recording_id, channel_idx, t,", 1)[0].rstrip()},
        x AS (SELECT recording_id, channel_idx, t, CASE WHEN hit THEN built ELSE v END AS v FROM c JOIN r USING (recording_id)), {H}, {S}, {E}
        SELECT epoch_id, channel_idx, count(*) AS n, {snap_sql('max(v)', 3)} AS peak, {snap_sql('min(v)', 3)} AS trough, {snap_sql('arg_max(v, k) - arg_min(v, k)', 3)} AS slope FROM e GROUP BY 1, 2""",
    "experiment_rows": f"WITH {FEATURES} SELECT epoch_id, label, grp, {', '.join(f'{snap_sql(f'x[{i + 1}]', 4)} AS x{i}' for i in range(5))} FROM rw",
    "experiment_run": f"WITH {LOSO} SELECT fold, count(*) AS n, {snap_sql('avg((label = prediction)::INTEGER)', 4)} AS accuracy FROM p GROUP BY fold",
    "experiment_holdout": f"WITH {LAST}, k AS (SELECT label AS c FROM p UNION SELECT prediction FROM p) SELECT a.c AS label, b.c AS prediction, count(p.epoch_id) AS n FROM k a JOIN k b ON true LEFT JOIN p ON p.label = a.c AND p.prediction = b.c GROUP BY a.c, b.c",
    "experiment_progress": f"""WITH {FEATURES}, g AS (SELECT DISTINCT 'LOSO ' || grp AS fold FROM rw), o AS (SELECT fold, row_number() OVER (ORDER BY fold) - 1 AS i, count(*) OVER () AS n FROM g)
        SELECT CAST(i + 2 AS BIGINT) AS seq, {snap_sql('0.25::DOUBLE + 0.6::DOUBLE * i / n', 4)} AS progress, 'training ' || fold AS message FROM o
        UNION ALL SELECT s, {snap_sql('p::DOUBLE', 4)}, m FROM (SELECT 0 AS s, 0.05 AS p, 'loaded' AS m UNION ALL SELECT 1, 0.15, 'preprocessed' UNION ALL SELECT (SELECT count(*) FROM g) + 2, 0.9, 'saved' UNION ALL SELECT (SELECT count(*) FROM g) + 3, 1.0, 'done')""",
    "band_importance": f"WITH {AXES} SELECT axis, idx, {snap_sql('importance', 3)} AS importance FROM i",
    "explanation": f"""WITH {AXES}, c AS (SELECT idx, importance / (SELECT greatest(max(importance), 1e-8) FROM i WHERE axis = 'channel') AS importance FROM i WHERE axis = 'channel')
        SELECT axis, idx, {snap_sql('round(importance, 6)', 3)} AS importance FROM i WHERE axis <> 'channel' UNION ALL SELECT 'channel', idx, {snap_sql('round(importance, 6)', 3)} FROM c
        UNION ALL SELECT * FROM (SELECT 'top', idx, {snap_sql('round(importance, 4)', 3)} FROM c ORDER BY importance DESC, idx DESC LIMIT 8)""",
    "recommended_settings": f"WITH {H} SELECT recording_id, CASE WHEN n_samples / greatest(sampling_rate, 1e-9) > 100 THEN 0.01::DOUBLE ELSE 0 END AS low, {snap_sql('least(0.2::DOUBLE, 0.45::DOUBLE * sampling_rate)')} AS high, n_samples > 20 AS repair_steps, -2.0::DOUBLE AS tmin, 10.0::DOUBLE AS tmax FROM h WHERE sampling_rate > 0 AND n_samples IS NOT NULL",
    "stacked_bands": f"""WITH {X}, s AS (SELECT recording_id || '/' || (channel_idx % 3) AS recording_id, unnest(CASE channel_idx % 3 WHEN 0 THEN ['HbO', 'HbR'] WHEN 1 THEN ['HbR'] ELSE ['raw'] END) AS band FROM x), g AS (SELECT recording_id, band, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT recording_id, band, CAST(dense_rank() OVER (PARTITION BY recording_id ORDER BY band) - 1 AS INTEGER) AS band_idx, n FROM g""",
    "result_document": f"WITH {LOSO} SELECT count(*) AS n_samples, {snap_sql('round(avg((label = prediction)::INTEGER), 4)', 3)} AS accuracy, CAST(count(DISTINCT fold) AS INTEGER) AS folds FROM p",
}

QUERIES = {
    f.__name__: f
    for f in (
        pipeline_epochs, experiment_rows, experiment_run, experiment_holdout, experiment_progress, band_importance, explanation, explanation_json,
        recommended_settings, stacked_bands, result_document,
    )
}
