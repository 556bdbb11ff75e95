"""Queries on recordings: signals, epochs, windows and importance, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolith.operators import epochs as ep
from neurolith.operators import signals as sg
from neurolith.operators.anomalies import flag_samples
from neurolith.session import table


def snap(c: Column, digits: int = 6) -> Column:
    """Cut to a grid that no short decimal falls on the edge of, alike in every engine."""
    m = float(10**digits)
    return F.floor(c * m + 0.3713).cast("double") / m


def snap_sql(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.3713::DOUBLE) / 1e{digits}"


def _x(spark: SparkSession, d: str) -> DataFrame:
    return sg.readings(table(spark, d, "signal_long"))


def _heads(spark: SparkSession, d: str) -> DataFrame:
    return ep.headers(table(spark, d, "recordings"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return ep.windows(table(spark, d, "epochs"), _heads(spark, d), -2.0, 10.0)


def _epoch_samples(spark: SparkSession, d: str) -> DataFrame:
    return ep.samples(_x(spark, d), _spans(spark, d))


def _v(df: DataFrame) -> DataFrame:
    return df.select("recording_id", "channel_idx", "t", snap(F.col("v")).alias("v"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Implausible samples of all channels."""
    found = flag_samples(table(spark, d, "signal_long"), table(spark, d, "recordings"), table(spark, d, "devices"))
    return found.select("recording_id", "channel_idx", "t")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Flagged samples per recording, channel and reason."""
    found = flag_samples(table(spark, d, "signal_long"), table(spark, d, "recordings"), table(spark, d, "devices"))
    return found.groupBy("recording_id", "channel_idx", "reason").agg(F.count(F.lit(1)).alias("n"))


def p3_rules(spark: SparkSession, d: str) -> DataFrame:
    """The samples that the plausibility and stuck rules flag."""
    found = flag_samples(table(spark, d, "signal_long"), table(spark, d, "recordings"), table(spark, d, "devices"))
    return found.filter("reason <> 'spike'").select("recording_id", "channel_idx", "t", "reason")


def signal_readings(spark, d):
    return _v(_x(spark, d))


def channel_stats(spark, d):
    s = sg.channel_stats(_x(spark, d))
    return s.select("recording_id", "channel_idx", "n", snap(F.col("mean"), 4).alias("mean"), snap(F.col("sd"), 4).alias("sd"), snap(F.col("median")).alias("median"))


def mad_per_channel(spark, d):
    s = sg.spread(_x(spark, d))
    return s.select("recording_id", "channel_idx", snap(F.col("median")).alias("median"), snap(F.col("mad")).alias("mad"))


def optical_density(spark, d):
    return _v(sg.optical_density(_x(spark, d)))


def std_scale(spark, d):
    x = sg.scale_by_sd(_x(spark, d))
    return x.select("recording_id", "channel_idx", "t", snap(F.col("v"), 3).alias("v"))


def derivative(spark, d):
    return _v(sg.derivative(_x(spark, d)))


def cumulative_sum(spark, d):
    x = sg.cumulative(_x(spark, d))
    return x.select("recording_id", "channel_idx", "t", snap(F.col("v"), 3).alias("v"))


def tddr(spark, d):
    x = sg.repair_steps(_x(spark, d))
    return x.select("recording_id", "channel_idx", "t", snap(F.col("v"), 3).alias("v"))


def fft_bandpass(spark, d):
    rates = _heads(spark, d).select("recording_id", F.col("sampling_rate").alias("rate"))
    return _v(sg.band_pass(_x(spark, d), rates, 0.01, 0.2, "fft"))


def butterworth_bandpass(spark, d):
    rates = _heads(spark, d).select("recording_id", F.col("sampling_rate").alias("rate"))
    return _v(sg.band_pass(_x(spark, d), rates, 0.01, 0.2, "butterworth"))


def pipeline_od_sd_tddr(spark, d):
    """Optical density, scaling and repair in the order of the preprocessing chain."""
    x = sg.repair_steps(sg.scale_by_sd(sg.optical_density(_x(spark, d))))
    return x.select("recording_id", "channel_idx", "t", snap(F.col("v"), 4).alias("v"))


def sampling_rate(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("s"))
    return sg.sampling_rate(e, "user_id", "s", "event_id").select("user_id", snap(F.col("rate")).alias("rate"))


def recording_summary(spark, d):
    s = ep.summary(_heads(spark, d), table(spark, d, "epochs"))
    return s.withColumn("seconds", snap(F.col("seconds"), 4))


def label_distribution(spark, d):
    return ep.label_distribution(table(spark, d, "epochs"))


def latest_headers(spark, d):
    return _heads(spark, d).select("recording_id", "device_id", "sampling_rate", "n_channels", "n_samples", "uploaded_at")


def epoch_windows(spark, d):
    return _spans(spark, d).select("epoch_id", "recording_id", "label", "start", "end")


def epoch_labels(spark, d):
    """Epochs with the name of their label (its code where the header has none) and their subject, the header's default, or
    subject_0."""
    e = table(spark, d, "epochs").join(_heads(spark, d).select("recording_id", "event_id_map", "default_subject"), "recording_id", "left")
    name = F.coalesce(F.col("event_id_map")[F.col("label")], F.col("label").cast("string"))
    return e.select("epoch_id", name.alias("label_name"), F.coalesce("subject", "default_subject", F.lit("subject_0")).alias("subject"))


def epoch_features(spark, d):
    f = ep.features(_epoch_samples(spark, d))
    return f.select("epoch_id", "channel_idx", "n", *[snap(F.col(c), 4).alias(c) for c in ("mean", "sd", "peak", "trough", "slope")])


def features_tcn(spark, d):
    return ep.features(_epoch_samples(spark, d)).select("epoch_id", "channel_idx", snap(F.col("mean_step"), 5).alias("mean_step"))


def features_energy(spark, d):
    return ep.features(_epoch_samples(spark, d)).select("epoch_id", "channel_idx", snap(F.sqrt("energy"), 4).alias("rms"))


def epoch_baseline(spark, d):
    b = ep.baselines(_x(spark, d), _spans(spark, d), -2.0, 0.0)
    return b.select("epoch_id", "channel_idx", snap(F.col("baseline"), 4).alias("baseline"))


def epoch_time_axis(spark, d):
    t = ep.time_axis(_heads(spark, d), -2.0, 10.0)
    return t.select("recording_id", "k", snap(F.col("seconds")).alias("seconds"))


def hopping_windows(spark, d):
    return ep.hopping(_heads(spark, d))


def channel_time_importance(spark, d):
    return ep.importance(_epoch_samples(spark, d)).select("axis", "idx", snap(F.col("importance"), 3).alias("importance"))


def top_channels(spark, d):
    return ep.top_channels(ep.importance(_epoch_samples(spark, d))).select("idx", snap(F.col("importance"), 5).alias("importance"))


X = "x AS (SELECT recording_id, channel_idx, t, max(v) AS v FROM signal_long WHERE v IS NOT NULL AND isfinite(v) GROUP BY recording_id, channel_idx, t)"
H = "h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY uploaded_at DESC, source_path DESC) AS rn FROM recordings) WHERE rn = 1)"
S = (
    "s AS (SELECT * FROM (SELECT e.epoch_id, e.recording_id, e.label, e.onset, h.sampling_rate, h.n_samples, "
    "e.onset + CAST(round_even(h.sampling_rate * -2.0::DOUBLE, 0) AS BIGINT) AS start, e.onset + CAST(round_even(h.sampling_rate * 10.0::DOUBLE, 0) AS BIGINT) AS \"end\" "
    'FROM epochs e JOIN h USING (recording_id) WHERE h.sampling_rate > 0 AND h.n_samples IS NOT NULL) WHERE start >= 0 AND "end" <= n_samples AND "end" > start)'
)
E = 'e AS (SELECT s.epoch_id, x.channel_idx, x.t - s.start AS k, x.v FROM x JOIN s ON x.recording_id = s.recording_id AND x.t >= s.start AND x.t < s."end")'
C = "PARTITION BY recording_id, channel_idx"
D = f"d AS (SELECT recording_id, channel_idx, t, v, v - coalesce(lag(v) OVER ({C} ORDER BY t), v) AS dv FROM x)"


def _tddr(source: str, digits: int) -> str:
    return f"""
        m AS (SELECT recording_id, channel_idx, median(dv) AS med FROM d GROUP BY ALL),
        a AS (SELECT recording_id, channel_idx, median(abs(dv - med)) AS mad FROM d JOIN m USING (recording_id, channel_idx) GROUP BY ALL),
        z AS (SELECT d.*, med, abs(dv) / CASE WHEN mad = 0 THEN 1 ELSE mad END > 4.0::DOUBLE AS far FROM d JOIN m USING (recording_id, channel_idx) JOIN a USING (recording_id, channel_idx)),
        r AS (SELECT recording_id, bool_or(far) AS hit FROM z GROUP BY ALL),
        c AS (SELECT recording_id, channel_idx, t, v, sum(CASE WHEN far THEN med ELSE dv END) OVER ({C} ORDER BY t ROWS UNBOUNDED PRECEDING) AS built FROM z)
        SELECT recording_id, channel_idx, t, {snap_sql("CASE WHEN hit THEN built ELSE v END", digits)} AS v FROM c JOIN r USING (recording_id)"""


RULES = f"""WITH s AS (SELECT recording_id, channel_idx, t, max(v) AS v, max(device_id) AS device_id FROM signal_long WHERE v IS NOT NULL GROUP BY recording_id, channel_idx, t),
    {H}, y AS (SELECT s.*, coalesce(h.sampling_rate, d.nominal_rate) AS fs, CASE WHEN lower(coalesce(h.channel_names[channel_idx + 1], '')) LIKE 'aux%' THEN aux_min ELSE v_min END AS lo,
      CASE WHEN lower(coalesce(h.channel_names[channel_idx + 1], '')) LIKE 'aux%' THEN aux_max ELSE v_max END AS hi FROM s LEFT JOIN h USING (recording_id) LEFT JOIN devices d ON d.device_id = s.device_id),
    a AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY recording_id, channel_idx ORDER BY t) THEN 0 ELSE 1 END AS new FROM y),
    b AS (SELECT *, sum(new) OVER (PARTITION BY recording_id, channel_idx ORDER BY t) AS run FROM a),
    c AS (SELECT *, count(*) OVER (PARTITION BY recording_id, channel_idx, run) >= 2 * fs AS stuck, isnan(v) OR isinf(v) OR v < lo OR v > hi AS bad FROM b)
    SELECT recording_id, channel_idx, t, CASE WHEN bad THEN 'range' ELSE 'stuck' END AS reason FROM c WHERE bad OR stuck"""

SQL = {
    "p3_rules": RULES,
    "signal_readings": f"WITH {X} SELECT recording_id, channel_idx, t, {snap_sql('v')} AS v FROM x",
    "channel_stats": f"WITH {X} SELECT recording_id, channel_idx, count(*) AS n, {snap_sql('avg(v)', 4)} AS mean, {snap_sql('stddev_pop(v)', 4)} AS sd, {snap_sql('median(v)')} AS median FROM x GROUP BY ALL",
    "mad_per_channel": f"WITH {X}, m AS (SELECT recording_id, channel_idx, median(v) AS med FROM x GROUP BY ALL) SELECT recording_id, channel_idx, {snap_sql('any_value(med)')} AS median, {snap_sql('median(abs(v - med))')} AS mad FROM x JOIN m USING (recording_id, channel_idx) GROUP BY recording_id, channel_idx",
    "optical_density": f"WITH {X} SELECT recording_id, channel_idx, t, {snap_sql(f'-ln(greatest(v, 1e-6::DOUBLE) / greatest(avg(v) OVER ({C}), 1e-6::DOUBLE))')} AS v FROM x",
    "std_scale": f"WITH {X}, s AS (SELECT recording_id, channel_idx, stddev_pop(v) AS sd FROM x GROUP BY ALL) SELECT recording_id, channel_idx, t, {snap_sql('v / CASE WHEN sd = 0 THEN 1 ELSE sd END', 3)} AS v FROM x JOIN s USING (recording_id, channel_idx)",
    "derivative": f"WITH {X}, {D} SELECT recording_id, channel_idx, t, {snap_sql('dv')} AS v FROM d",
    "cumulative_sum": f"WITH {X} SELECT recording_id, channel_idx, t, {snap_sql(f'sum(v) OVER ({C} ORDER BY t ROWS UNBOUNDED PRECEDING)', 3)} AS v FROM x",
    "tddr": f"WITH {X}, {D}, {_tddr('x', 3)}",
    "pipeline_od_sd_tddr": f"""WITH {X.replace("x AS", "x0 AS", 1)}, o AS (SELECT recording_id, channel_idx, t, -ln(greatest(v, 1e-6::DOUBLE) / greatest(avg(v) OVER ({C}), 1e-6::DOUBLE)) AS v FROM x0),
        x AS (SELECT recording_id, channel_idx, t, v / CASE WHEN stddev_pop(v) OVER ({C}) = 0 THEN 1 ELSE stddev_pop(v) OVER ({C}) END AS v FROM o), {D}, {_tddr("x", 4)}""",
    "sampling_rate": f"WITH d AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) SELECT user_id, {snap_sql('coalesce(1.0::DOUBLE / median(d) FILTER (d > 0), 1.0::DOUBLE)')} AS rate FROM d GROUP BY user_id",
    "recording_summary": f"""WITH {H}, p AS (SELECT recording_id, count(*) AS n_events, greatest(count(DISTINCT subject), 1) AS n_subjects FROM epochs GROUP BY 1),
        l AS (SELECT recording_id, string_agg(label || ':' || n, ',' ORDER BY label || ':' || n) AS labels FROM (SELECT recording_id, label::VARCHAR AS label, count(*)::VARCHAR AS n FROM epochs WHERE label IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
        SELECT recording_id, source_format, n_channels, n_samples, {snap_sql('n_samples / sampling_rate', 4)} AS seconds, coalesce(n_events, 0) AS n_events, coalesce(n_subjects, 1) AS n_subjects, coalesce(labels, '') AS labels
        FROM h LEFT JOIN p USING (recording_id) LEFT JOIN l USING (recording_id)""",
    "label_distribution": "SELECT label, count(*) AS n FROM epochs GROUP BY label",
    "latest_headers": f"WITH {H} SELECT recording_id, device_id, sampling_rate, n_channels, n_samples, uploaded_at FROM h",
    "epoch_windows": f'WITH {H}, {S} SELECT epoch_id, recording_id, label, start, "end" FROM s',
    "epoch_labels": f"WITH {H} SELECT epoch_id, coalesce(event_id_map[label], label::VARCHAR) AS label_name, coalesce(subject, default_subject, 'subject_0') AS subject FROM epochs LEFT JOIN h USING (recording_id)",
    "epoch_features": f"WITH {X}, {H}, {S}, {E} SELECT epoch_id, channel_idx, count(*) AS n, {snap_sql('avg(v)', 4)} AS mean, {snap_sql('stddev_pop(v)', 4)} AS sd, {snap_sql('max(v)', 4)} AS peak, {snap_sql('min(v)', 4)} AS trough, {snap_sql('arg_max(v, k) - arg_min(v, k)', 4)} AS slope FROM e GROUP BY epoch_id, channel_idx",
    "features_tcn": f"WITH {X}, {H}, {S}, {E} SELECT epoch_id, channel_idx, {snap_sql('(arg_max(v, k) - arg_min(v, k)) / greatest(count(*) - 1, 1)', 5)} AS mean_step FROM e GROUP BY epoch_id, channel_idx",
    "features_energy": f"WITH {X}, {H}, {S}, {E} SELECT epoch_id, channel_idx, {snap_sql('sqrt(avg(v * v))', 4)} AS rms FROM e GROUP BY epoch_id, channel_idx",
    "epoch_baseline": f"WITH {X}, {H}, {S}, b AS (SELECT s.epoch_id, s.recording_id, s.onset + CAST(round_even(sampling_rate * -2.0::DOUBLE, 0) AS BIGINT) AS a, s.onset AS z FROM s WHERE s.onset + CAST(round_even(sampling_rate * -2.0::DOUBLE, 0) AS BIGINT) >= 0) SELECT epoch_id, channel_idx, {snap_sql('avg(v)', 4)} AS baseline FROM x JOIN b ON x.recording_id = b.recording_id AND t >= a AND t < z GROUP BY epoch_id, channel_idx",
    "epoch_time_axis": f"WITH {H} SELECT recording_id, k, {snap_sql('k::DOUBLE / sampling_rate + -2.0::DOUBLE')} AS seconds FROM (SELECT recording_id, sampling_rate, unnest(range(CAST(round_even(sampling_rate * 10.0::DOUBLE, 0) AS BIGINT) - CAST(round_even(sampling_rate * -2.0::DOUBLE, 0) AS BIGINT))) AS k FROM h WHERE sampling_rate > 0)",
    "hopping_windows": f"""WITH {H}, w AS (SELECT recording_id, n_samples, CAST(floor(least(greatest(sampling_rate * 10, 20), n_samples)) AS BIGINT) AS w FROM h WHERE sampling_rate > 0 AND n_samples > 0),
        g AS (SELECT recording_id, w, unnest(range(0, greatest(n_samples - w, 0) + 1, greatest(w // 2, 1))) AS start, greatest(w // 2, 1) AS step, (greatest(n_samples - w, 0) // greatest(w // 2, 1)) = 0 AS single FROM w),
        a AS (SELECT recording_id, w, start, start // step AS i FROM g UNION ALL SELECT recording_id, w, start, 1 FROM g WHERE single)
        SELECT recording_id, CAST(i AS INTEGER) AS window_idx, start, start + w AS "end", CAST(i % 2 AS INTEGER) AS label FROM a""",
    "channel_time_importance": f"WITH {X}, {H}, {S}, {E} SELECT CASE WHEN grouping(channel_idx) = 0 THEN 'channel' ELSE 'time' END AS axis, CAST(CASE WHEN grouping(channel_idx) = 0 THEN channel_idx ELSE k END AS BIGINT) AS idx, {snap_sql('avg(abs(v))', 3)} AS importance FROM e GROUP BY GROUPING SETS ((channel_idx), (k))",
    "top_channels": f"WITH {X}, {H}, {S}, {E}, i AS (SELECT channel_idx, avg(abs(v)) AS a FROM e GROUP BY 1) SELECT CAST(channel_idx AS BIGINT) AS idx, {snap_sql('a / (SELECT greatest(max(a), 1e-8) FROM i)', 5)} AS importance FROM i ORDER BY a DESC, channel_idx DESC LIMIT 8",
}

QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_reasons, p3_rules, signal_readings, channel_stats, mad_per_channel, optical_density, std_scale, derivative, cumulative_sum, tddr, fft_bandpass,
        butterworth_bandpass, pipeline_od_sd_tddr, sampling_rate, recording_summary, label_distribution, latest_headers, epoch_windows, epoch_labels,
        epoch_features, features_tcn, features_energy, epoch_baseline, epoch_time_axis, hopping_windows, channel_time_importance, top_channels,
    )
}
