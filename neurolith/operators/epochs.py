"""Event-locked windows of recordings, their features, and windows of recordings without events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolith.functions.distributed import within

EPOCH = ["epoch_id", "channel_idx"]


def headers(recordings: DataFrame) -> DataFrame:
    """One row per recording: the header uploaded last."""
    w = Window.partitionBy("recording_id").orderBy(F.desc("uploaded_at"), F.desc("source_path"))
    return recordings.filter("recording_id is not null").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")


def windows(epochs: DataFrame, heads: DataFrame, tmin: float, tmax: float) -> DataFrame:
    """(epoch_id, recording_id, event_idx, subject, label, onset, start, end) of the epochs whose window lies within the
    recording; offsets round half to even. Recordings without rate or sample count have no windows."""
    if tmax <= tmin:
        raise ValueError("tmax must be above tmin")
    h = heads.filter("sampling_rate > 0 and n_samples is not null").select("recording_id", "sampling_rate", "n_samples")
    e = epochs.select("epoch_id", "recording_id", "event_idx", "subject", "label", "onset").filter("onset is not null").join(h, "recording_id")
    start, end = F.col("onset") + half_even(F.col("sampling_rate") * tmin), F.col("onset") + half_even(F.col("sampling_rate") * tmax)
    e = e.withColumn("start", start).withColumn("end", end).filter("start >= 0 and end <= n_samples and end > start")
    return e.select("epoch_id", "recording_id", "event_idx", "subject", "label", "onset", "start", "end", "sampling_rate", "n_samples")


def samples(x: DataFrame, spans: DataFrame) -> DataFrame:
    """Readings of each epoch: (epoch_id, channel_idx, t, k, v), k counted from the window's start."""
    s = spans.select("epoch_id", "recording_id", "start", "end")
    return within(x, s, "recording_id", "t", "start", "end").select("epoch_id", "channel_idx", "t", (F.col("t") - F.col("start")).alias("k"), "v")


def features(ep: DataFrame) -> DataFrame:
    """Per epoch and channel: mean, sd (population), peak, trough, slope (last - first), mean step, energy."""
    slope = F.max_by("v", "k") - F.min_by("v", "k")
    f = ep.groupBy(*EPOCH).agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("sd"),
        F.max("v").alias("peak"),
        F.min("v").alias("trough"),
        slope.alias("slope"),
        F.avg(F.col("v") * F.col("v")).alias("energy"),
    )
    return f.withColumn("mean_step", F.col("slope") / F.greatest(F.col("n") - 1, F.lit(1)))


def baselines(x: DataFrame, spans: DataFrame, tmin: float, tmax: float) -> DataFrame:
    """(epoch_id, channel_idx, baseline): mean of a window around the onset; the row is missing (an offset of 0) where the
    window leaves the recording."""
    start, end = F.col("onset") + half_even(F.col("sampling_rate") * tmin), F.col("onset") + half_even(F.col("sampling_rate") * tmax)
    s = spans.select("epoch_id", "recording_id", start.alias("start"), end.alias("end"), "n_samples").filter("start >= 0 and end > start and end <= n_samples")
    return samples(x, s).groupBy(*EPOCH).agg(F.avg("v").alias("baseline"))


def hopping(heads: DataFrame) -> DataFrame:
    """(recording_id, window_idx, start, end, label): half-overlapping windows of ten seconds (at least 20 samples, at most
    the recording) with alternating placeholder labels; a single window is given twice, with either label."""
    h = heads.filter("sampling_rate > 0 and n_samples > 0").select("recording_id", "n_samples", F.floor(F.least(F.greatest(F.col("sampling_rate") * 10, F.lit(20.0)), F.col("n_samples"))).alias("w"))
    h = h.withColumn("step", F.greatest(F.floor(F.col("w") / 2), F.lit(1)))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n_samples") - F.col("w"), F.lit(0)), F.col("step"))
    h = h.withColumn("starts", starts).withColumn("starts", F.when(F.size("starts") == 1, F.concat("starts", "starts")).otherwise(F.col("starts")))
    h = h.select("recording_id", "w", F.posexplode("starts").alias("window_idx", "start"))
    return h.select("recording_id", "window_idx", "start", (F.col("start") + F.col("w")).alias("end"), (F.col("window_idx") % 2).alias("label"))


def time_axis(heads: DataFrame, tmin: float, tmax: float) -> DataFrame:
    """(recording_id, k, seconds) of an epoch's samples."""
    n = half_even(F.col("sampling_rate") * tmax) - half_even(F.col("sampling_rate") * tmin)
    h = heads.filter("sampling_rate > 0").select("recording_id", "sampling_rate", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("k"))
    return h.select("recording_id", "k", (F.col("k").cast("double") / F.col("sampling_rate") + tmin).alias("seconds"))


def stack_bands(signals: DataFrame) -> DataFrame:
    """Adds band_idx: HbO and HbR where a recording has either (raw is then dropped), else raw."""
    has = signals.groupBy("recording_id").agg(F.max(F.col("band").isin("HbO", "HbR")).alias("haemo"))
    s = signals.join(has, "recording_id").filter(F.when(F.col("haemo"), F.col("band") != "raw").otherwise(F.col("band") == "raw"))
    bands = s.select("recording_id", "band").distinct().withColumn("band_idx", F.dense_rank().over(Window.partitionBy("recording_id").orderBy("band")) - 1)
    return s.join(bands, ["recording_id", "band"]).drop("haemo")


def summary(heads: DataFrame, epochs: DataFrame) -> DataFrame:
    """Per recording: channels, samples, seconds, events, distinct subjects (1 if none is named), label counts."""
    per = epochs.groupBy("recording_id", "label").agg(F.count(F.lit(1)).alias("n"))
    labels = per.filter("label is not null").groupBy("recording_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", F.col("label").cast("string"), F.col("n").cast("string")))).alias("l"))
    people = epochs.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_events"), F.greatest(F.countDistinct("subject"), F.lit(1)).alias("n_subjects"))
    x = heads.join(people, "recording_id", "left").join(labels, "recording_id", "left")
    return x.select(
        "recording_id", "source_format", "n_channels", "n_samples", (F.col("n_samples") / F.col("sampling_rate")).alias("seconds"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_subjects", F.lit(1)).alias("n_subjects"), F.concat_ws(",", "l").alias("labels"),
    )


def label_distribution(epochs: DataFrame) -> DataFrame:
    return epochs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def importance(ep: DataFrame, bands: bool = False) -> DataFrame:
    """(axis, idx, importance): mean absolute reading by channel and by sample of the epoch, and by band_idx if asked, in one
    pass."""
    names = ["channel_idx", "k", *(["band_idx"] if bands else [])]
    g = ep.select(*names, F.abs("v").alias("a")).groupingSets([[n] for n in names], *names).agg(F.avg("a").alias("importance"), *[F.grouping(n).alias(f"g_{n}") for n in names])
    axis, idx = F.lit("time"), F.col("k").cast("bigint")
    for n, shown in (("channel_idx", "channel"), ("band_idx", "band")):
        if n in names:
            axis, idx = F.when(F.col(f"g_{n}") == 0, shown).otherwise(axis), F.when(F.col(f"g_{n}") == 0, F.col(n).cast("bigint")).otherwise(idx)
    return g.select(axis.alias("axis"), idx.alias("idx"), "importance")


def top_channels(imp: DataFrame, n: int = 8) -> DataFrame:
    """The most important channels, scaled by the largest; ties: the higher index first."""
    ch = imp.filter("axis = 'channel'")
    best = ch.orderBy(F.desc("importance"), F.desc("idx")).limit(n)  # the largest of all is among them
    w = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return best.select("idx", (F.col("importance") / F.greatest(F.max("importance").over(w), F.lit(1e-8))).alias("importance"))
