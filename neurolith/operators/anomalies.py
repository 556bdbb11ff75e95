"""Implausible spikes, stuck stretches and impossible readings of sampled channels.

One shuffle brings the samples of a (recording, channel, block of samples) together in sample order; NumPy then
reads each block once. A block is bounded (``block`` samples and margins on both sides), so that a channel holding any part
of the table is spread over many tasks. Runs of equal readings that cross a block edge are stitched from one row per
block afterwards.

Spikes are found by peaks over threshold: residuals from a running median (the slow course of the channel) are scaled by the
channel's usual scatter, a generalised Pareto tail is fitted to the exceedances of all channels of a recording over a high quantile
(by quantiles, so that the spikes themselves cannot widen it), and the cutoff is where that tail reaches a fixed risk. Blocks
contribute histograms of their residuals (apart by the level of their chunk) and the surroundings of their peaks; scatter and cutoff come from the histograms of the
whole channel and recording, and the peaks are judged by them, so that the size of blocks doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurolith.functions.distributed import broadcast_if_small, cut_lineage


@dataclass(frozen=True)
class AnomalyConfig:
    """Parameters of the detector.

    half: readings on each side of the running median. risk: chance per reading beyond the tail cutoff. shapes: least and greatest
    shape of the tail. contrast: least size of a spike in scatters of its neighbourhood (restless stretches). follow: part of the
    cutoff that a spike's weaker readings reach. step: part of the cutoff by which it leaves the readings on both sides. longest: most
    readings of a spike. block: samples of a block. margin, after: samples repeated before and after a block.
    broadcast_rows: most rows of the channel headers that are broadcast; beyond it they are joined by shuffle.
    """

    half: int = 6
    risk: float = 1e-9
    shapes: tuple[float, float] = (-0.1, 0.0)
    contrast: float = 5.0
    follow: float = 0.7
    step: float = 0.5
    longest: int = 3
    block: int = 32768
    margin: int = 4096
    after: int = 64
    broadcast_rows: int = 400_000


#: Bins of a histogram per doubling of the residual, and the bin of residuals of 0.
PER_OCTAVE, NOUGHT = 16, -(1 << 15)
#: Readings on each side of a peak that are kept to judge it: residuals, readings and sample numbers.
AROUND, BESIDE, NEXT = 14, 5, 2
SCATTER = 1.4826
#: Sample numbers to a chunk, levels of chunks per doubling, and by how many of them a chunk may lie above its channel to be calm.
CHUNK, LEVELS_PER_OCTAVE, CALM = 32, 2, 2
#: Added to the bin of a level, so that none is negative; lower levels than 2^-500 are as good as 0.
LOWEST = 1000


def binned(r: np.ndarray) -> np.ndarray:
    """Bin of each residual (at least 0)."""
    out = np.full(r.size, NOUGHT, np.int32)
    above = r > 0
    out[above] = np.floor(np.log2(r[above]) * PER_OCTAVE)
    return out


def quantile_of(bins: np.ndarray, counts: np.ndarray, q: float) -> float:
    """Quantile of a histogram in ascending order of bins; within a bin in proportion to the logarithm."""
    upto = np.cumsum(counts)
    x = q * upto[-1]
    i = min(int(np.searchsorted(upto, x)), bins.size - 1)
    if bins[i] == NOUGHT:
        return 0.0
    return float(2.0 ** ((bins[i] + min(max((x - upto[i] + counts[i]) / counts[i], 0.0), 1.0)) / PER_OCTAVE))


def fitted_cutoff(bins: np.ndarray, counts: np.ndarray, risk: float, shapes: tuple[float, float] = (-0.1, 0.0)) -> float:
    """Peaks-over-threshold cutoff of scaled residuals, given as a histogram, at a fixed risk.

    Threshold: the 90 % quantile. Shape and scale come from the median and the 75 % quantile of the exceedances
    (never from the largest), the shape within ``shapes``. Fewer than 30 readings are not fitted: 0.
    """
    if counts.sum() < 30:
        return 0.0
    u = quantile_of(bins, counts, 0.9)
    a, b = quantile_of(bins, counts, 0.95) - u, quantile_of(bins, counts, 0.975) - u
    # quantiles of the GPD: a = s/x (2^x - 1), b = s/x (4^x - 1), hence b/a = 2^x + 1
    xi = float(np.clip(np.log2(max(b / a - 1, 1e-3)) if a > 0 else 0.0, *shapes))
    scale = a / np.log(2) if abs(xi) < 1e-6 else a * xi / (2**xi - 1)
    rare = 0.1 / risk
    return float(u + (scale * np.log(rare) if abs(xi) < 1e-6 else scale / xi * (rare**xi - 1)))


def tail_cutoff(z: np.ndarray, risk: float, shapes: tuple[float, float] = (-0.1, 0.0)) -> float:
    """``fitted_cutoff`` of residuals at hand."""
    bins, counts = np.unique(binned(z), return_counts=True)
    return fitted_cutoff(bins, counts, risk, shapes) if z.size else 0.0


def running_median(x: np.ndarray, half: int) -> np.ndarray:
    """Median over 2*half+1 readings, mirrored at the ends (at both ends fewer readings: the largest odd window)."""
    half = min(half, max(0, x.size - 1))
    if half == 0:
        return x
    pad = np.pad(x, half, mode="reflect")
    windows = np.lib.stride_tricks.sliding_window_view(pad, 2 * half + 1)
    return np.partition(windows, half, axis=1)[:, half]


def last_digit(x: np.ndarray) -> float:
    """Smallest step from one reading to the next that is none: the resolution of the channel; infinite for a constant one."""
    steps = np.abs(np.diff(x))
    steps = steps[steps > 1e-9 * max(1.0, np.abs(x).max())] if steps.size else steps
    return float(steps.min()) if steps.size else float("inf")


def run_bounds(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal readings; NaN equals NaN."""
    new = np.ones(v.size, bool)
    nan = np.isnan(v)
    new[1:] = (v[1:] != v[:-1]) & ~(nan[1:] & nan[:-1])
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, v.size))


def windows_at(x: np.ndarray, at: np.ndarray, half: int) -> np.ndarray:
    """The values on both sides of some positions, NaN beyond the ends."""
    pad = np.concatenate([np.full(half, np.nan), x, np.full(half, np.nan)])
    return pad[at[:, None] + np.arange(2 * half + 1)[None, :]]


def coded(r: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Bin of each residual, and that of its chunk's level above it."""
    tall = np.floor_divide(binned(level), PER_OCTAVE // LEVELS_PER_OCTAVE)
    return ((np.maximum(tall + LOWEST, 0) << 16) | (binned(r) - NOUGHT)).astype(np.int32)


def chunk_levels(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Per residual the median of the residuals of its chunk of ``CHUNK`` sample numbers (the upper one of two)."""
    chunk = t // CHUNK
    order = np.lexsort((r, chunk))
    start = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    size = np.diff(np.append(start, r.size))
    return np.repeat(r[order][start + size // 2], size)


def peaks(r: np.ndarray, level: np.ndarray, digit: float) -> np.ndarray:
    """Positions of residuals that are not below their neighbours and stand out from the levels around them: what may be the
    top of a spike, whatever scatter and cutoff turn out to be. Deliberately too many."""
    top = r > (2 * digit if np.isfinite(digit) else 0.0)
    top[1:] &= r[1:] >= r[:-1]
    top[:-1] &= r[:-1] >= r[1:]
    near = np.minimum(level, np.minimum(np.r_[level[AROUND:], level[-AROUND:]][: r.size], np.r_[level[:AROUND], level[:-AROUND]][: r.size]))
    return np.flatnonzero(top & (r >= 4 * SCATTER * near))


def judged(r: np.ndarray, x: np.ndarray, t: np.ndarray, scatter: float, cut: float, c: AnomalyConfig) -> list[int]:
    """Sample numbers of the spikes among peaks. r, x, t: windows around each peak.

    A spike is a run of at most ``longest`` readings far off; it stands out from its neighbourhood and from the readings
    on both sides (a step between two levels does not)."""
    out: list[int] = []
    far = r > c.follow * cut * scatter  # NaN: not
    for i in np.flatnonzero(r[:, AROUND] > cut * scatter):
        a = b = AROUND
        while far[i, a - 1] and b - a < c.longest:
            a -= 1
        while far[i, b + 1] and b - a < c.longest:
            b += 1
        if b - a + 1 > c.longest:
            continue
        size = r[i, a : b + 1].max()
        sides = [near[~np.isnan(near)] for near in (r[i, max(0, a - 12) : a - 1], r[i, b + 2 : b + 13])]
        if size < c.contrast * SCATTER * max((np.median(near) for near in sides if near.size >= 4), default=0.0):
            continue
        shift = BESIDE - AROUND
        left, right = x[i, max(0, a + shift - 3) : a + shift], x[i, b + shift + 1 : b + shift + 4]
        left, right = left[~np.isnan(left)], right[~np.isnan(right)]
        if left.size and right.size:
            own, (low, high) = x[i, a + shift : b + shift + 1], sorted((np.median(left), np.median(right)))
            if np.maximum(np.maximum(own - high, low - own), 0.0).min() < c.step * cut * scatter:
                continue
        out += t[i, a + NEXT - AROUND : b + NEXT - AROUND + 1].astype(int).tolist()
    return out


OUT = pa.schema(
    [
        ("recording_id", pa.string()), ("channel_idx", pa.int32()), ("blk", pa.int64()), ("k", pa.int64()),
        ("hits", pa.list_(pa.int32())), ("reasons", pa.list_(pa.string())),
        ("whole", pa.bool_()), ("head_v", pa.float64()), ("head_n", pa.int64()), ("head_t", pa.list_(pa.int32())),
        ("tail_v", pa.float64()), ("tail_n", pa.int64()), ("tail_t", pa.list_(pa.int32())),
        ("codes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("n", pa.int64()), ("digit", pa.float64()),
        ("peak_r", pa.list_(pa.float32())), ("peak_x", pa.list_(pa.float32())), ("peak_t", pa.list_(pa.int32())),
    ]
)
OUT_DDL = (
    "recording_id string, channel_idx int, blk bigint, k bigint, hits array<int>, reasons array<string>, whole boolean, "
    "head_v double, head_n bigint, head_t array<int>, tail_v double, tail_n bigint, tail_t array<int>, "
    "codes array<int>, counts array<int>, n bigint, digit double, peak_r array<float>, peak_x array<float>, peak_t array<int>"
)


def scan_block(blk: int, t, v, lo, hi, k: int | None, c: AnomalyConfig) -> tuple | None:
    """One output row of a block: hits with reasons, the runs at its edges, and what spikes are judged by: a histogram of the
    residuals (without stuck readings), the number of readings, their resolution and the peaks. None without an own reading.

    t is sorted; rows of one t are one reading. Null readings must have been removed.
    """
    keep = np.ones(t.size, bool)
    keep[1:] = t[1:] != t[:-1]
    if not keep.all():
        t, v, lo, hi = t[keep], v[keep], lo[keep], hi[keep]
    own = (t >= blk * c.block) & (t < (blk + 1) * c.block)
    if blk == 0:
        own |= t < 0
    if not own.any():
        return None
    with np.errstate(invalid="ignore"):
        bad = ~np.isfinite(v) | (v < lo) | (v > hi)
    start, length = run_bounds(v)
    stuck = np.zeros(v.size, bool)
    least = k if k is not None else 1 << 40
    for s, n in zip(start[length >= least], length[length >= least], strict=True):
        stuck[s : s + n] = True
    at = np.flatnonzero(~bad)
    x, mine = v[at], own[at]
    residual = np.abs(x - running_median(x, c.half)) if at.size else x
    digit = last_digit(x)
    level = chunk_levels(residual, t[at]) if at.size else residual
    used = mine & ~stuck[at]
    codes, counts = np.unique(coded(residual[used], level[used]), return_counts=True)
    top = peaks(residual, level, digit) if at.size else at
    top = top[mine[top]]
    beside = windows_at(x, top, BESIDE) - x[top, None]
    judge_by = (codes, counts, int(mine.sum()), digit, windows_at(residual, top, AROUND).ravel(), beside.ravel(), np.nan_to_num(windows_at(t[at].astype(float), top, NEXT), nan=-1).ravel().astype(np.int32))
    # runs among own readings; those at an edge are left to the stitching
    first, last = np.flatnonzero(own)[[0, -1]]
    ov, ot = v[first : last + 1], t[first : last + 1]
    start, length = run_bounds(ov)
    whole = start.size == 1
    held = np.zeros(ov.size, bool)
    if start.size > 2:
        for s, n in zip(start[1:-1], length[1:-1], strict=True) if (length[1:-1] >= least).any() else ():
            if n >= least:
                held[s : s + n] = True
    obad = bad[first : last + 1]
    hit = obad | held
    at = np.flatnonzero(hit)
    why = ["range" if obad[i] else "stuck" for i in at]
    open_ = ~hit  # of an edge run only the readings not flagged yet are named again
    hn, tn = int(length[0]), int(length[-1])
    ht = ot[:hn][open_[:hn]]
    tt = ot[-tn:][open_[-tn:]] if not whole else ht
    return (blk, k, ot[at], why, whole, float(ov[0]), hn, ht, float(ov[-1]), tn, tt, *judge_by)


def _scan(c: AnomalyConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[pa.RecordBatch] = []

        def group(batch: pa.RecordBatch) -> None:
            rid, ch, blk = batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), batch.column(2)[0].as_py()
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6)]
            k = batch.column(7)[0].as_py()
            row = scan_block(blk, *cols, k, c)
            if row is not None:
                rows.append((rid, ch, *row))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, OUT, strict=True)], schema=OUT)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            same = pc.and_(
                pc.equal(batch.column(0).slice(1), batch.column(0).slice(0, n - 1)),
                pc.and_(pc.equal(batch.column(1).slice(1), batch.column(1).slice(0, n - 1)), pc.equal(batch.column(2).slice(1), batch.column(2).slice(0, n - 1))),
            )
            cuts = np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1
            edges = [0, *cuts.tolist(), n]
            if held:
                if any(batch.column(i)[0] != held[-1].column(i)[0] for i in (0, 1, 2)):
                    group(pa.concat_batches(held))
                    held = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if b == n:
                    held.append(part)
                elif held:
                    group(pa.concat_batches([*held, part]))
                    held = []
                else:
                    group(part)
            if len(rows) >= 500:
                yield flush()
        if held:
            group(pa.concat_batches(held))
        if rows:
            yield flush()

    return run


def channel_headers(recordings: DataFrame) -> DataFrame:
    """(recording_id, rate, aux positions): one row per recording; a header delivered twice counts once (the latest)."""
    aux = F.filter(F.transform("channel_names", lambda x, i: F.when(F.lower(F.trim(x)).startswith("aux"), i)), lambda i: i.isNotNull())
    return (
        recordings.filter(F.col("recording_id").isNotNull())
        .groupBy("recording_id")
        .agg(F.max_by(F.struct("sampling_rate", "channel_names"), F.struct(F.col("channel_names").isNotNull(), "uploaded_at")).alias("h"))
        .select("recording_id", F.when(F.col("h.sampling_rate") > 0, F.col("h.sampling_rate")).alias("rate"), F.col("h.channel_names").alias("channel_names"))
        .select("recording_id", "rate", F.coalesce(aux, F.array().cast("array<int>")).alias("aux"))
    )


def flag_samples(signal: DataFrame, recordings: DataFrame, devices: DataFrame, config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Flagged samples: (recording_id, channel_idx, t, reason), reason one of range, stuck, spike.

    Defined results: rows with a null key or null v are no readings; a sample delivered twice counts once; an unknown
    device has no range, an unknown rate no stuck rule; a channel of fewer than 7 readings, or of a recording of fewer than 30, has no
    spikes; empty tables give an empty result. Other columns of the inputs are ignored.
    """
    c = config
    head = channel_headers(recordings)
    dev = devices.dropDuplicates(["device_id"]).select("device_id", "nominal_rate", "v_min", "v_max", "aux_min", "aux_max")
    few = recordings.limit(c.broadcast_rows + 1).count() <= c.broadcast_rows and devices.limit(c.broadcast_rows + 1).count() <= c.broadcast_rows
    hint = F.broadcast if few else (lambda x: x)
    rows = signal.select("recording_id", "device_id", "channel_idx", "t", "v").filter("v IS NOT NULL AND recording_id IS NOT NULL AND channel_idx IS NOT NULL AND t IS NOT NULL")
    rows = rows.join(hint(head), "recording_id", "left").join(hint(dev), "device_id", "left")
    is_aux = F.coalesce(F.array_contains("aux", F.col("channel_idx")), F.lit(False))
    rate = F.coalesce("rate", F.when(F.col("nominal_rate") > 0, F.col("nominal_rate")))
    block = lambda t: F.greatest(F.floor(t / F.lit(c.block)), F.lit(0))
    rows = rows.select(
        "recording_id",
        "channel_idx",
        F.explode(F.sequence(block(F.col("t") - c.after), block(F.col("t") + c.margin))).alias("blk"),
        "t",
        "v",
        F.coalesce(F.when(is_aux, F.col("aux_min")).otherwise(F.col("v_min")), F.lit(float("-inf"))).alias("lo"),
        F.coalesce(F.when(is_aux, F.col("aux_max")).otherwise(F.col("v_max")), F.lit(float("inf"))).alias("hi"),
        F.ceil(2 * rate).alias("k"),
    )
    rows = rows.repartition("recording_id", "channel_idx", "blk").sortWithinPartitions("recording_id", "channel_idx", "blk", "t")
    blocks = cut_lineage(rows.mapInArrow(_scan(c), OUT_DDL))
    found = stitch(blocks).unionByName(spikes(blocks, c))
    return found.groupBy("recording_id", "channel_idx", "t").agg(F.min("reason").alias("reason"))


def cutoffs(blocks: DataFrame, c: AnomalyConfig) -> DataFrame:
    """(recording_id, channel_idx, scatter, cut) of channels with at least 7 readings: the scatter from the histogram of the channel
    (at least its last digit), the cutoff from the scaled histograms of all channels of the recording, without restless chunks."""
    narrow = blocks.select("recording_id", "channel_idx", "codes", "counts", "n", "digit")
    rows = narrow.repartition("recording_id").sortWithinPartitions("recording_id", "channel_idx")
    return rows.mapInPandas(_fitted(c), "recording_id string, channel_idx int, scatter double, cut double")


def _fitted(c: AnomalyConfig):
    """Merges the histograms of sorted blocks as they come: a channel's in one, its calm part, scaled, in that of the recording."""

    class Recording:
        def __init__(self, rid):
            self.rid, self.found, self.pool = rid, [], []

        def channel(self, ch: int, parts: list, n: int, digit: float) -> None:
            if n < 2 * c.longest + 1:
                return
            codes, counts = merged(parts)
            bins, of = np.unique(codes & 0xFFFF, return_inverse=True)
            sizes = np.bincount(of, weights=counts)
            scatter = max(SCATTER * quantile_of(bins + NOUGHT, sizes, 0.5), digit if np.isfinite(digit) else 0.0, 1e-12) if bins.size else max(digit, 1e-12)
            calm = (codes >> 16) <= np.floor(np.log2(scatter / SCATTER) * LEVELS_PER_OCTAVE) + CALM + LOWEST
            own, shift = (codes[calm] & 0xFFFF) + NOUGHT, round(np.log2(scatter) * PER_OCTAVE) if np.isfinite(scatter) else 0
            self.pool = [merged([*self.pool, (np.where(own == NOUGHT, own, own - shift), counts[calm])])]
            self.found.append((self.rid, ch, scatter))

        def rows(self) -> list[tuple]:
            cut = fitted_cutoff(*self.pool[0], c.risk, c.shapes) if self.pool else 0.0
            return [(*f, cut) for f in self.found] if cut > 0 else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rec, ch, parts, n, digit = Recording(None), None, [], 0, float("inf")
        out: list[tuple] = []
        frame = lambda rows: pd.DataFrame(rows, columns=["recording_id", "channel_idx", "scatter", "cut"])
        for b in batches:
            for rid, k, codes, counts, m, d in zip(*(b[x] for x in ("recording_id", "channel_idx", "codes", "counts", "n", "digit")), strict=True):
                if (rid, k) != (rec.rid, ch):
                    rec.channel(ch, parts, n, digit)
                    parts, n, digit, ch = [], 0, float("inf"), k
                    if rid != rec.rid:
                        out += rec.rows()
                        rec = Recording(rid)
                parts.append((np.asarray(codes, np.int64), np.asarray(counts, np.int64)))
                n, digit = n + m, min(digit, d)
                if len(parts) > 500:
                    parts = [merged(parts)]
            if len(out) > 10_000:
                yield frame(out)
                out = []
        rec.channel(ch, parts, n, digit)
        yield frame(out + rec.rows())

    return run


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Histograms (values, counts) as one."""
    values, of = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(of, weights=np.concatenate([k for _, k in parts])).astype(np.int64)


def spikes(blocks: DataFrame, c: AnomalyConfig) -> DataFrame:
    """(recording_id, channel_idx, t, reason) of the spikes among the peaks of all blocks."""
    facts = broadcast_if_small(cut_lineage(cutoffs(blocks, c)), c.broadcast_rows)
    p = blocks.filter(F.size("peak_r") > 0).select("recording_id", "channel_idx", "peak_r", "peak_x", "peak_t").join(facts, ["recording_id", "channel_idx"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, ch, r, x, t, scatter, cut in zip(*(b[k] for k in ("recording_id", "channel_idx", "peak_r", "peak_x", "peak_t", "scatter", "cut")), strict=True):
                around = [np.asarray(w, float).reshape(-1, 2 * half + 1) for w, half in ((r, AROUND), (x, BESIDE), (t, NEXT))]
                rows += [(rid, ch, n) for n in judged(*around, scatter, cut, c)]
            yield pd.DataFrame(rows, columns=["recording_id", "channel_idx", "t"])

    found = p.select("recording_id", "channel_idx", "peak_r", "peak_x", "peak_t", "scatter", "cut").mapInPandas(run, "recording_id string, channel_idx int, t int")
    return found.withColumn("reason", F.lit("spike"))


def stitch(blocks: DataFrame) -> DataFrame:
    """Joins the runs at block edges and lists all flagged samples."""
    w = Window.partitionBy("recording_id", "channel_idx").orderBy("blk")
    same = F.lag("tail_v").over(w).eqNullSafe(F.col("head_v")) & F.lag("blk").over(w).isNotNull()
    b = blocks.withColumn("linked", same)
    b = b.withColumn("tail_chain", F.last(F.when(~(F.col("whole") & F.col("linked")), F.col("blk")), ignorenulls=True).over(w))
    # a head that continues the chain before it belongs to that chain, else to one of its own (negative numbers)
    b = b.withColumn("head_chain", F.when(F.col("linked"), F.lag("tail_chain").over(w)).otherwise(-1 - F.col("blk")))
    none = F.array().cast("array<int>")
    piece = lambda chain, n, ts: F.struct(chain.alias("chain"), n.alias("n"), ts.alias("ts"))
    pieces = F.when(F.col("whole"), F.array(piece(F.col("tail_chain"), F.col("tail_n"), F.col("tail_t")))).otherwise(
        F.array(piece(F.col("head_chain"), F.col("head_n"), F.col("head_t")), piece(F.col("tail_chain"), F.col("tail_n"), F.col("tail_t")))
    )
    sure = piece(F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), none)
    p = b.select("recording_id", "channel_idx", "k", "hits", "reasons", F.posexplode(F.concat(F.array(sure), pieces)).alias("i", "p"))
    w2 = Window.partitionBy("recording_id", "channel_idx", "p.chain")
    p = p.withColumn("total", F.when(F.col("i") > 0, F.sum("p.n").over(w2)))
    found = F.when(F.col("i") == 0, F.arrays_zip(F.col("hits").alias("t"), F.col("reasons").alias("reason"))).when(
        F.col("total") >= F.col("k"), F.transform(F.col("p.ts"), lambda t: F.struct(t.alias("t"), F.lit("stuck").alias("reason")))
    )
    return p.select("recording_id", "channel_idx", F.explode(found).alias("f")).select("recording_id", "channel_idx", F.col("f.t").alias("t"), F.col("f.reason").alias("reason"))
