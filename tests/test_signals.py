import numpy as np
import pandas as pd
import pytest

from neurolith.operators import epochs as ep
from neurolith.operators import signals as sg


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    m = {("a", 0): rng.normal(5, 1, 90), ("a", 1): rng.normal(3, 0.2, 90), ("b", 0): np.full(40, 2.0), ("c", 0): np.sin(np.arange(64) / 5) + 2}
    m["a", 0][30] += 40
    pdf = pd.DataFrame([(r, c, t, float(v)) for (r, c), x in m.items() for t, v in enumerate(x)], columns=["recording_id", "channel_idx", "t", "v"]).astype({"channel_idx": "int32", "t": "int32"})
    return m, spark.createDataFrame(pdf)


def matrices(df):
    return {k: g.sort_values("t")["v"].to_numpy() for k, g in df.toPandas().groupby(["recording_id", "channel_idx"])}


def repaired(m):
    out = {}
    for rec in {r for r, _ in m}:
        d = {k: np.diff(x, prepend=x[:1]) for k, x in m.items() if k[0] == rec}
        far = {}
        for k, x in d.items():
            mad = np.median(np.abs(x - np.median(x))) or 1.0
            far[k] = np.abs(x) / mad > 4
        hit = any(f.any() for f in far.values())
        for k, x in d.items():
            out[k] = np.cumsum(np.where(far[k], np.median(x), x)) if hit else m[k]
    return out


def test_against_numpy(data):
    m, df = data
    for got, want in (
        (sg.optical_density(df), lambda x: -np.log(np.maximum(x, 1e-6) / max(x.mean(), 1e-6))),
        (sg.scale_by_sd(df), lambda x: x / (x.std() or 1.0)),
        (sg.derivative(df), lambda x: np.diff(x, prepend=x[:1])),
        (sg.cumulative(df), np.cumsum),
    ):
        got = matrices(got)
        assert all(np.allclose(got[k], want(x), atol=1e-9) for k, x in m.items())


def test_one_spike_rebuilds_every_channel_of_its_recording_only(data):
    m, df = data
    got, want = matrices(sg.repair_steps(df)), repaired(m)
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in m)
    assert got["a", 1][0] == 0.0 and np.allclose(got["b", 0], 2.0)


def test_fft_and_butterworth_pass_the_band_and_stop_the_rest(spark):
    t = np.arange(2000) / 10
    x = np.sin(2 * np.pi * 0.1 * t) + np.sin(2 * np.pi * 2.0 * t) + 3
    inner = slice(300, -300)
    for y in (sg.fft_band(x, 10.0, 0.05, 0.5), sg.zero_phase(*sg.butterworth_sections(3, 0.05, 0.5, 10.0), x)):
        assert np.abs(y[inner] - np.sin(2 * np.pi * 0.1 * t)[inner]).max() < 0.05
    assert np.abs(sg.zero_phase(*sg.butterworth_sections(3, None, 0.5, 10.0), x)[inner] - np.sin(2 * np.pi * 0.1 * t)[inner] - 3).max() < 0.02
    assert np.abs(sg.zero_phase(*sg.butterworth_sections(3, 0.5, None, 10.0), x)[inner] - np.sin(2 * np.pi * 2.0 * t)[inner]).max() < 0.05
    b, a = sg.butterworth_sections(3, None, 1.0, 10.0)  # half power at the cutoff, unit gain at 0
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 10)) / np.polyval(a, np.exp(2j * np.pi * f / 10)))
    assert gain(0) == pytest.approx(1) and gain(1.0) == pytest.approx(2**-0.5)


def test_band_pass_falls_back_for_short_channels(spark, data):
    _, df = data
    rates = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "recording_id string, rate double")
    got = matrices(sg.band_pass(df.filter("t < 20"), rates, 0.01, 0.5, "butterworth"))
    assert set(k[0] for k in got) == {"a", "b"}
    assert sg.band_pass(df, rates, None, None) is df


def test_readings_drop_what_is_none_and_count_a_sample_once(spark):
    s = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 0, 1.0), ("a", 0, 1, None), ("a", 0, 2, float("nan")), ("a", 0, 3, float("inf")), (None, 0, 1, 1.0)], "recording_id string, channel_idx int, t int, v double")
    assert [tuple(r) for r in sg.readings(s).collect()] == [("a", 0, 0, 1.0)]
    assert sorted(r[0] for r in s.select(sg.zero_filled(s.v)).collect()) == [0.0, 0.0, 0.0, 1.0, 1.0, 1.0]
    assert sg.readings(s.limit(0)).count() == 0


def test_demo_recording_shape():
    x, e = sg.demo_recording()
    assert len(e) == 36 and e["onset"].tolist()[:2] == [30, 220] and x["t"].max() == 6839 and set(x["band"]) == {"raw", "HbO", "HbR"}


def test_demo_epochs_are_all_kept(spark):
    x, e = sg.demo_recording(3, 4)
    heads = spark.createDataFrame([("demo", 10.0, 2280)], "recording_id string, sampling_rate double, n_samples bigint")
    events = spark.createDataFrame([(i, "demo", int(i), s, int(c), int(o)) for i, o, c, s in e.itertuples(index=False)], "epoch_id bigint, recording_id string, event_idx int, subject string, label int, onset bigint")
    spans = ep.windows(events, heads, 0.0, 5.0)
    df = spark.createDataFrame(x[x["band"] == "raw"].assign(recording_id="demo").drop(columns="band").astype({"channel_idx": "int32", "t": "int32"}))
    s = ep.samples(df, spans)
    assert spans.count() == 12 and s.count() == 12 * 16 * 50
    f = ep.features(s).toPandas()
    raw = x[x["band"] == "raw"].pivot(index="channel_idx", columns="t", values="v").to_numpy()
    for r in f.itertuples():
        w = raw[r.channel_idx, int(e["onset"][r.epoch_id]) : int(e["onset"][r.epoch_id]) + 50]
        assert np.allclose([r.mean, r.sd, r.peak, r.trough, r.slope, r.mean_step, r.energy], [w.mean(), w.std(), w.max(), w.min(), w[-1] - w[0], np.diff(w).mean(), (w**2).mean()])


def test_windows_respect_bounds_and_round_half_to_even(spark):
    heads = spark.createDataFrame([("r", 7.8125, 100), ("n", None, 100), ("m", 5.0, None)], "recording_id string, sampling_rate double, n_samples bigint")
    ev = spark.createDataFrame([(1, "r", 0, "s", 0, 16), (2, "r", 1, "s", 0, 5), (3, "r", 2, "s", 0, 95), (4, "n", 0, "s", 0, 50), (5, "m", 0, "s", 0, 50), (6, "r", 3, None, None, None)], "epoch_id bigint, recording_id string, event_idx int, subject string, label int, onset bigint")
    got = {r.epoch_id: (r.start, r.end) for r in ep.windows(ev, heads, -2.0, 1.0).collect()}
    assert got == {1: (0, 24)}  # -15.625 -> -16, 7.8125 -> 8
    with pytest.raises(ValueError):
        ep.windows(ev, heads, 1.0, 1.0)


def test_hopping_windows_of_recordings_without_events(spark):
    heads = spark.createDataFrame([("a", 1.0, 100), ("b", 10.0, 190), ("c", 1.0, 10), ("d", None, 5)], "recording_id string, sampling_rate double, n_samples bigint")
    got = {k: g.sort_values("window_idx") for k, g in ep.hopping(heads).toPandas().groupby("recording_id")}
    assert got["a"]["start"].tolist() == list(range(0, 90, 10)) and got["a"]["label"].tolist() == [0, 1] * 4 + [0]
    assert got["b"]["label"].tolist() == [0, 1] and got["c"]["label"].tolist() == [0, 1] and got["c"]["start"].tolist() == [0, 0]


def test_bands_and_importance(spark):
    s = spark.createDataFrame([("a", "raw"), ("a", "HbO"), ("a", "HbR"), ("b", "raw")], "recording_id string, band string")
    assert sorted((r.recording_id, r.band, r.band_idx) for r in ep.stack_bands(s).collect()) == [("a", "HbO", 0), ("a", "HbR", 1), ("b", "raw", 0)]
    e = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, -3.0), (1, 1, 0, 2.0), (1, 1, 1, 2.0)], "epoch_id int, channel_idx int, k int, v double")
    imp = ep.importance(e)
    assert {(r.axis, r.idx): r.importance for r in imp.collect()} == {("channel", 0): 2.0, ("channel", 1): 2.0, ("time", 0): 1.5, ("time", 1): 2.5}
    assert [(r.idx, r.importance) for r in ep.top_channels(imp, 1).collect()] == [(1, 1.0)]


def test_block_medians_equal_numpy(spark):
    from neurolith.operators import blocks as bk

    rng = np.random.default_rng(5)
    pdf = pd.concat([pd.DataFrame({"recording_id": "a", "channel_idx": c, "t": rng.permutation(5000)[:n], "v": v}) for c, n, v in ((0, 301, rng.normal(size=301)), (1, 400, 3 + 1e-9 * rng.normal(size=400)), (2, 2, [-1.0, 2.0]), (3, 1, [0.0]), (4, 50, rng.integers(-2, 3, 50).astype(float)))])
    blocks = bk.pack(spark.createDataFrame(pdf).selectExpr("recording_id", "cast(channel_idx as int) channel_idx", "cast(t as int) t", "v"), width=64)
    got = {r.channel_idx: r.m for r in bk.medians(blocks, lambda r: r["vs"], "m").collect()}
    assert all(got[c] == pytest.approx(np.median(g["v"]), abs=1e-15) for c, g in pdf.groupby("channel_idx"))
    assert bk.medians(blocks.limit(0), lambda r: r["vs"], "m").count() == 0


def test_cascade_equals_the_filter_sample_by_sample():
    rng = np.random.default_rng(6)
    x = rng.normal(size=1500).cumsum()
    for order, low, high in ((3, 0.05, 0.5), (3, None, 0.2), (2, 0.05, None), (1, 0.1, 0.3)):
        b, a = sg.butterworth_sections(order, low, high, 10.0)
        whole = sg.zero_phase(b, a, x)
        parts = sg.zero_phase(b, a, x, sg.cascade(*sg.butterworth_roots(order, low, high, 10.0)))
        assert np.abs(whole - parts).max() < 1e-6 * np.abs(whole).max()


@pytest.mark.parametrize(("low", "high"), [(0.05, 0.5), (None, 0.4), (0.1, None)])
def test_filters_in_blocks_equal_those_of_whole_channels(spark, low, high):
    from neurolith.operators.filters import zero_phase_blocks

    rng = np.random.default_rng(9)
    channels = {("a", 0): rng.normal(size=700).cumsum(), ("a", 1): rng.normal(size=64), ("b", 0): rng.normal(size=23), ("b", 1): rng.normal(size=5)}
    rows = [(r, c, 3 * t + (t > 100) * 50, float(v)) for (r, c), x in channels.items() for t, v in enumerate(x)]
    rates = spark.createDataFrame([("a", 10.0), ("b", 8.0)], "recording_id string, rate double")
    done, short = zero_phase_blocks(spark.createDataFrame(rows, "recording_id string, channel_idx int, t int, v double"), rates, low, high, width=32)
    got, left = matrices(done), matrices(short)
    assert set(got) | set(left) == set(channels) and ("b", 1) in left and not set(got) & set(left)
    for k, y in got.items():
        f = (3, low, high, 10.0 if k[0] == "a" else 8.0)
        want = sg.zero_phase(*sg.butterworth_sections(*f), channels[k], sg.cascade(*sg.butterworth_roots(*f)))
        assert np.allclose(y, want, atol=1e-7 * np.abs(want).max())
    assert all(np.allclose(v, channels[k]) for k, v in left.items())
