import numpy as np
import datetime as dt
import pytest

from neurolith.operators.anomalies import AnomalyConfig, flag_samples, running_median, tail_cutoff

SIGNAL = "recording_id string, device_id string, channel_idx int, t int, v double, received_at timestamp"
HEAD = "recording_id string, sampling_rate double, channel_names array<string>, uploaded_at timestamp"
DEV = "device_id string, nominal_rate double, v_min double, v_max double, aux_min double, aux_max double"
AT = dt.datetime(2024, 1, 1)


def run(spark, channels, heads=(("r", 5.0, None, AT),), devices=(("d", 10.0, 0.0, 100.0, -16.0, 16.0),), config=AnomalyConfig(), extra=()):
    rows = [(r, "d", c, t, v, AT) for (r, c), points in channels.items() for t, v in points] + list(extra)
    df = flag_samples(spark.createDataFrame(rows, SIGNAL), spark.createDataFrame(list(heads), HEAD), spark.createDataFrame(list(devices), DEV), config)
    out = df.collect()
    assert len(out) == len({(x.recording_id, x.channel_idx, x.t) for x in out})
    return {(x.channel_idx, x.t): x.reason for x in out}


def noise(n, seed=0, level=50.0, sd=0.5):
    return np.round(level + np.random.default_rng(seed).normal(0, sd, n), 2)


def test_spikes_of_one_to_three_readings_but_no_step_and_no_restless_stretch(spark):
    v = noise(600)
    v[100] += 20
    v[200:203] -= 15
    v[300:] += 12  # lasting change
    v[400:460] = np.round(62 + np.random.default_rng(1).normal(0, 2.5, 60), 2)
    v[500:506] += 15  # too long for a spike
    got = run(spark, {("r", 0): list(enumerate(v.tolist()))})
    assert {t for (_, t), w in got.items() if w == "spike"} == {100, 200, 201, 202}


def test_impossible_readings_by_kind_of_channel(spark):
    v = noise(60).tolist()
    v[3], v[4], v[5], v[6] = float("nan"), float("inf"), 100.5, -0.1
    v[7], v[8] = 100.0, 0.0  # both ends are possible
    a = noise(60, 2, 1.0, 0.2).tolist()
    a[10] = 16.5
    got = run(spark, {("r", 0): list(enumerate(v)), ("r", 1): list(enumerate(a))}, heads=[("r", 5.0, ["S1", "AUX acc"], AT)])
    assert {k for k, w in got.items() if w == "range"} == {(0, 3), (0, 4), (0, 5), (0, 6), (1, 10)}


@pytest.mark.parametrize("block", [32768, 32])
def test_stuck_runs_also_over_block_edges(spark, block):
    v = noise(200).tolist()
    for i in range(25, 135):
        v[i] = 51.25  # longer than three blocks of 32
    for i in range(150, 159):
        v[i] = 49.5  # one short of ten
    points = [(t, x) for t, x in enumerate(v) if t % 13 != 5 or t < 20]  # missing samples don't end a run
    got = run(spark, {("r", 0): points}, config=AnomalyConfig(block=block, margin=16, after=8))
    kept = [t for t, _ in points]
    assert {t for (_, t), w in got.items() if w == "stuck"} == {t for t in kept if 25 <= t < 135}


def test_nulls_repeated_rows_and_unknown_headers(spark):
    v = noise(100).tolist()
    v[40] = 90.0
    points = list(enumerate(v))
    extra = [("r", "d", 0, 40, 90.0, AT), ("r", "d", 0, 41, None, AT), (None, "d", 0, 1, 500.0, AT), ("q", "x", 0, 1, 1e9, AT), ("r", "d", None, 1, 500.0, AT)]
    got = run(spark, {("r", 0): points}, heads=[], extra=extra)
    assert got == {(0, 40): "spike"}


def test_rate_falls_back_to_the_device_and_headers_count_once(spark):
    v = noise(120).tolist()
    v[10:30] = [50.0] * 20  # 20 = 2 x nominal rate
    heads = [("r", None, None, AT), ("r", None, None, AT + dt.timedelta(hours=1))]
    assert {t for (_, t), w in run(spark, {("r", 0): list(enumerate(v))}, heads=heads).items() if w == "stuck"} == set(range(10, 30))


def test_empty_tables(spark):
    assert run(spark, {}, heads=[], devices=[]) == {}


def test_clashing_extra_columns(spark):
    s = spark.createDataFrame([("r", "d", 0, t, float(v), AT, 1, 2) for t, v in enumerate(noise(50))], SIGNAL + ", blk int, k int")
    h = spark.createDataFrame([("r", 5.0, None, AT, 3)], HEAD + ", rate int")
    assert flag_samples(s, h, spark.createDataFrame([("d", 10.0, 0.0, 100.0, -16.0, 16.0, 9)], DEV + ", aux int")).count() == 0


def test_tail_cutoff_is_not_moved_by_the_spikes():
    z = np.abs(np.random.default_rng(3).normal(size=2000))
    dirty = z.copy()
    dirty[::200] = 50
    assert 4 < tail_cutoff(z, 1e-6) < tail_cutoff(dirty, 1e-6) < 8  # the spikes are at 50
    assert tail_cutoff(z[:10], 1e-6) == 0.0


def test_running_median_equals_brute_force():
    x = np.random.default_rng(4).normal(size=50)
    pad = np.pad(x, 6, mode="reflect")
    assert np.allclose(running_median(x, 6), [np.median(pad[i : i + 13]) for i in range(50)])


def test_the_size_of_blocks_does_not_matter(spark):
    v, w = noise(900, 5), noise(900, 6, sd=0.1)
    for t in (3, 63, 64, 127, 320, 640, 898):
        v[t] += 12
    w[256:258] -= 4
    w[400:500] += np.random.default_rng(8).normal(0, 1.5, 100)
    channels = {("r", 0): list(enumerate(v.tolist())), ("r", 1): list(enumerate(w.tolist()))}
    whole = run(spark, channels)
    assert {k for k, why in whole.items() if why == "spike"} == {*((0, t) for t in (3, 63, 64, 127, 320, 640, 898)), (1, 256), (1, 257)}
    assert run(spark, channels, config=AnomalyConfig(block=64, margin=64, after=64)) == whole
