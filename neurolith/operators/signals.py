"""Operators on sampled channels in long form (recording_id, channel_idx, t, v).

Per-channel statistics are aggregations joined back; differences and cumulative sums are two-level windows, so that a long
channel stays divided. Missing readings are left out, not filled.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolith.functions.distributed import cut_lineage, previous_value, running_total
from neurolith.operators import blocks as bk

CHANNEL = ["recording_id", "channel_idx"]
FLOOR = 1e-6


def finite(v: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def zero_filled(v: Column) -> Column:
    """The value, 0 where it is null, NaN or infinite."""
    return F.coalesce(finite(v), F.lit(0.0))


def readings(signal: DataFrame) -> DataFrame:
    """(recording_id, channel_idx, t, v): finite readings, one per sample; of unlike ones delivered twice the largest."""
    s = signal.select(*CHANNEL, "t", finite(F.col("v")).alias("v")).filter("v IS NOT NULL AND recording_id IS NOT NULL AND channel_idx IS NOT NULL AND t IS NOT NULL")
    return s.groupBy(*CHANNEL, "t").agg(F.max("v").alias("v"))


def channel_stats(x: DataFrame) -> DataFrame:
    """(channel, n, mean, sd, median): sd is the population's; the median is exact."""
    stats = x.groupBy(*CHANNEL).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return stats.join(bk.medians(bk.pack(x), lambda r: r["vs"], "median"), CHANNEL)


def spread(x: DataFrame) -> DataFrame:
    """(channel, median, mad): median of the absolute deviations from the median."""
    return _spread(bk.pack(x), lambda r: r["vs"])


def _spread(blocks: DataFrame, values) -> DataFrame:
    med = cut_lineage(bk.medians(blocks, values, "median"))
    mad = bk.medians(bk.attach(blocks, med, CHANNEL), lambda r: np.abs(values(r) - r["median"]), "mad")
    return med.join(mad, CHANNEL)


def optical_density(x: DataFrame) -> DataFrame:
    """Negative logarithm of each reading over its channel's mean, both at least 1e-6."""
    mean = x.groupBy(*CHANNEL).agg(F.avg("v").alias("mean"))
    od = -F.log(F.greatest("v", F.lit(FLOOR)) / F.greatest("mean", F.lit(FLOOR)))
    return x.join(mean, CHANNEL).select(*CHANNEL, "t", od.alias("v"))


def scale_by_sd(x: DataFrame) -> DataFrame:
    """Readings over their channel's population standard deviation; constant channels stay."""
    sd = x.groupBy(*CHANNEL).agg(F.stddev_pop("v").alias("sd"))
    return x.join(sd, CHANNEL).select(*CHANNEL, "t", (F.col("v") / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("v"))


def derivative(x: DataFrame) -> DataFrame:
    """First difference by sample order, 0 for the first reading of a channel."""
    return previous_value(x, CHANNEL, "t", "v", "_p").select(*CHANNEL, "t", (F.col("v") - F.coalesce("_p", "v")).alias("v"))


def cumulative(x: DataFrame) -> DataFrame:
    """Cumulative sum by sample order."""
    return running_total(x, CHANNEL, "t", "v", "_b").select(*CHANNEL, "t", (F.col("_b") + F.col("v")).alias("v"))


def repair_steps(x: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Derivative-based repair: differences beyond ``threshold`` MADs become the channel's median difference and the signal
    is summed up again.

    One such difference anywhere in a recording rebuilds all its channels (from 0); without one they stay untouched. Works on
    blocks: their differences give the medians, their sums the level that the next block goes on from.
    """
    blocks = bk.with_previous(bk.pack(x))

    def steps(r) -> np.ndarray:
        v = r["vs"]
        return np.diff(v, prepend=v[0] if r["before"] is None or np.isnan(r["before"]) else r["before"])

    def mended(r) -> tuple[np.ndarray, bool]:
        d = steps(r)
        far = np.abs(d) / (r["mad"] or 1.0) > threshold
        return np.where(far, r["median"], d), bool(far.any())

    def summed(r) -> tuple[bool, float]:
        d, far = mended(r)
        return far, float(d.sum())

    blocks = bk.attach(blocks, cut_lineage(_spread(blocks, steps)), CHANNEL)
    sums = cut_lineage(bk.each(blocks, summed, "far boolean, s double"))
    before = Window.partitionBy(*CHANNEL).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*bk.BLOCK, F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("base"))
    hit = sums.groupBy("recording_id").agg(F.max("far").alias("hit"))
    facts = cut_lineage(base.join(hit, "recording_id"))
    return bk.unpack(bk.attach(blocks, facts, bk.BLOCK), lambda r: r["base"] + np.cumsum(mended(r)[0]) if r["hit"] else r["vs"])


def sampling_rate(times: DataFrame, key: str, seconds: str, order: str) -> DataFrame:
    """(key, rate): 1 over the median positive step of ``seconds`` in ``order``; 1.0 without a positive step."""
    from pyspark.sql import Window

    step = F.col(seconds) - F.lag(seconds).over(Window.partitionBy(key).orderBy(order))
    d = times.withColumn("_d", step)
    return d.groupBy(key).agg(F.coalesce(1.0 / F.median(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(1.0)).alias("rate"))


def fft_band(v: np.ndarray, rate: float, low: float | None, high: float | None) -> np.ndarray:
    """The part of a signal between two frequencies, both included."""
    f = np.fft.rfftfreq(v.size, 1.0 / rate)
    keep = np.ones(f.size, bool) if low is None else f >= low
    if high is not None:
        keep &= f <= high
    return np.fft.irfft(np.where(keep, np.fft.rfft(v), 0), n=v.size)


def butterworth_roots(order: int, low: float | None, high: float | None, rate: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(zeros, poles, gain) of a digital Butterworth filter by the bilinear transform.

    Cutoffs are held within (1e-5, 0.999) of the Nyquist frequency; low alone is a high-pass, high alone a low-pass.
    """
    nyquist = rate / 2
    warp = lambda f: np.tan(np.pi * min(max(f / nyquist, 1e-5), 0.999) / 2)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if low is not None and high is not None:
        a, b = warp(low), warp(high)
        width, centre = b - a, np.sqrt(a * b)
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        p, z, gain = np.r_[half + root, half - root], np.zeros(order, complex), width**order
    elif low is not None:
        w = warp(low)
        p, z, gain = w / poles, np.zeros(order, complex), 1.0
    else:
        w = warp(high)
        p, z, gain = w * poles, np.zeros(0, complex), w**order
    zd = np.r_[(1 + z) / (1 - z), -np.ones(p.size - z.size)]
    return zd, (1 + p) / (1 - p), float(gain * np.real(np.prod(1 - z) / np.prod(1 - p)))


def butterworth_sections(order: int, low: float | None, high: float | None, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of ``butterworth_roots``."""
    z, p, k = butterworth_roots(order, low, high, rate)
    return k * np.real(np.poly(z)), np.real(np.poly(p))


def cascade(z: np.ndarray, p: np.ndarray, k: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections of at most two states in a row: each has a pair of poles and two zeros. Poles near the unit circle that lie close
    together cannot be told from the coefficients of one large filter, those of pairs can."""
    above = sorted((x for x in p if x.imag > 1e-12), key=abs)
    real = sorted(x.real for x in p if abs(x.imag) <= 1e-12)
    pairs = [[x, np.conj(x)] for x in above] + [real[i : i + 2] for i in range(0, len(real), 2)]
    zeros = sorted(z, key=lambda x: (x.real, x.imag))
    out = []
    for i, pair in enumerate(pairs):
        own = [zeros.pop(0 if j % 2 else -1) for j in range(len(pair)) if zeros]
        num = np.real(np.poly(own)) * (k if i == 0 else 1.0)
        out.append((np.r_[num, np.zeros(len(pair) + 1 - num.size)], np.real(np.poly(pair))))
    return out


def state_space(b: np.ndarray, a: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h, o, g, p) of a filter over ``length`` samples: its answer to an impulse, what a state adds to each output (rows), what each
    input adds to the state at the end (rows), and the state's own way to the end. States are those of the transposed form."""
    n = len(a) - 1
    step = np.c_[-a[1:], np.eye(n)[:, : n - 1]]
    take = b[1:] - a[1:] * b[0]
    o, g = np.empty((length, n)), np.empty((length, n))
    row, col = np.eye(n)[0], take
    for i in range(length):
        o[i], g[length - 1 - i] = row, col
        row, col = row @ step, step @ col
    h = np.r_[b[0], o[:-1] @ take]
    return h, o, g, np.linalg.matrix_power(step, length)


@lru_cache(maxsize=1024)
def _prepared(b: bytes, a: bytes, length: int) -> tuple[np.ndarray, ...]:
    """``state_space`` of coefficients given as bytes, with the answers of a whole stretch as a matrix, and the one-step matrix."""
    num, den = np.frombuffer(b), np.frombuffer(a)
    h, o, g, p = state_space(num, den, length)
    shift = np.arange(length)[:, None] - np.arange(length)[None, :]
    n = len(den) - 1
    return h, o, g, p, np.where(shift >= 0, h[np.maximum(shift, 0)], 0.0), np.c_[-den[1:], np.eye(n)[:, : n - 1]]


def run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray, length: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(output, state at the end). Stretches of ``length`` samples are filtered at once by their answers to impulses; only their
    states follow from each other."""
    h, o, g, p, answer, step = _prepared(np.asarray(b, float).tobytes(), np.asarray(a, float).tobytes(), length)
    whole = x.size // length
    out = np.empty(x.size)
    s = np.asarray(state, float)
    if whole:
        m = x[: whole * length].reshape(whole, length)
        ends, before = m @ g, np.empty((whole, s.size))
        for i in range(whole):
            before[i] = s
            s = p @ s + ends[i]
        out[: whole * length] = (m @ answer.T + before @ o.T).ravel()
    rest = x[whole * length :]
    n = rest.size
    if n:
        out[whole * length :] = answer[:n, :n] @ rest + o[:n] @ s
        s = np.linalg.matrix_power(step, n) @ s + rest @ g[length - n :]
    return out, s


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state that an endless input of 1 leads to."""
    n = len(a) - 1
    step = np.c_[-a[1:], np.eye(n)[:, : n - 1]]
    return np.linalg.solve(np.eye(n) - step, b[1:] - a[1:] * b[0])


def odd_ends(head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is put before and after a signal: its ends, turned about their first and last value."""
    return 2 * head[0] - head[:0:-1], 2 * tail[-1] - tail[-2::-1]


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """The filter run forwards and backwards over an odd extension of the ends, started in its steady state.

    sections: the same filter as a cascade; without it the filter is run as one, in short stretches if it has many states."""
    pad = 3 * max(len(a), len(b))
    if x.size <= pad:
        raise ValueError(f"needs more than {pad} samples")
    first, last = odd_ends(x[: pad + 1], x[-pad - 1 :])
    y = np.r_[first, x, last]
    for _ in range(2):
        level = y[0]
        for num, den in sections or [(b, a)]:
            y, _ = run_filter(num, den, y, steady_state(num, den) * level, 256 if len(den) <= 3 else 1)
            level = level * num.sum() / den.sum()
        y = y[::-1]
    return y[pad:-pad]


def band_pass(x: DataFrame, rates: DataFrame, low: float | None, high: float | None, method: str = "fft", order: int = 3) -> DataFrame:
    """Band-passed channels. ``rates``: (recording_id, rate). method: fft, or butterworth (zero phase, in blocks; a channel that is
    too short for it is filtered by fft).

    The Fourier transform needs a whole channel; that is the one operator whose task holds one. Channels without a positive rate are
    left out. Both cutoffs None: unchanged.
    """
    if low is None and high is None:
        return x
    known = rates.filter("rate > 0").select("recording_id", F.col("rate").cast("double").alias("rate"))
    if method == "butterworth":
        from neurolith.operators.filters import zero_phase_blocks

        done, short = zero_phase_blocks(x, known, low, high, order)
        return done.unionByName(band_pass(short, known, low, high))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        out = fft_band(pdf["v"].to_numpy(float), float(pdf["rate"].iloc[0]), low, high)
        return pd.DataFrame({"recording_id": pdf["recording_id"], "channel_idx": pdf["channel_idx"], "t": pdf["t"], "v": out})

    return x.join(known, "recording_id").groupBy(*CHANNEL).applyInPandas(run, "recording_id string, channel_idx int, t int, v double")


def demo_recording(subjects: int = 6, trials: int = 6, channels: int = 16, samples: int = 160, rate: float = 10.0, seed: int = 42) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(samples, events) of an invented recording: rests of 30 samples, then trials whose half sine grows with the label.

    samples: band, channel_idx, t, v. events: event_idx, onset, code, subject. Labels alternate by trial.
    """
    rng = np.random.default_rng(seed)
    pattern = rng.normal(0, 1, channels)
    rows, events, at = [], [], 0
    for s in range(subjects):
        for k in range(trials):
            label = k % 2
            rest = rng.normal(0, 0.02, (channels, 30))
            bump = np.sin(np.linspace(0, np.pi, samples)) * (0.35 + 0.4 * label)
            task = pattern[:, None] * bump[None, :] + rng.normal(0, 0.08, (channels, samples)) + 0.01 * s
            rows.append(np.hstack([rest, task]))
            events.append((len(events), at + 30, label, f"subject_{s}"))
            at += 30 + samples
    raw = np.hstack(rows)
    bands = {"raw": raw, "HbO": raw + rng.normal(0, 0.02, raw.shape), "HbR": -0.35 * raw + rng.normal(0, 0.02, raw.shape)}
    parts = [pd.DataFrame({"band": b, "channel_idx": np.repeat(np.arange(channels), at), "t": np.tile(np.arange(at), channels), "v": m.ravel()}) for b, m in bands.items()]
    return pd.concat(parts, ignore_index=True), pd.DataFrame(events, columns=["event_idx", "onset", "code", "subject"])


def recommend(rate: float, n_samples: int) -> dict[str, float | bool]:
    """Preprocessing settings that suit a recording: a band below its Nyquist frequency, repair when it is long enough."""
    high = min(0.2, 0.45 * rate)
    return {"low": 0.01 if n_samples / max(rate, 1e-9) > 100 else 0.0, "high": high, "repair_steps": n_samples > 20, "tmin": -2.0, "tmax": 10.0}


def recommendations(heads: DataFrame) -> DataFrame:
    """(recording_id, low, high, repair_steps, tmin, tmax): ``recommend`` for every recording with a rate and a sample count."""
    h = heads.filter("sampling_rate > 0 and n_samples is not null")
    low = F.when(F.col("n_samples") / F.greatest("sampling_rate", F.lit(1e-9)) > 100, 0.01).otherwise(0.0)
    return h.select("recording_id", low.alias("low"), F.least(F.lit(0.2), 0.45 * F.col("sampling_rate")).alias("high"), (F.col("n_samples") > 20).alias("repair_steps"), F.lit(-2.0).alias("tmin"), F.lit(10.0).alias("tmax"))
