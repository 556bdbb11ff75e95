"""Zero-phase filters over channels in blocks, exactly as over whole channels.

A filter is linear: what a block makes of its input and what it makes of the state it is entered with add up. So every block is first
run from rest; the states that blocks are entered with follow from these ends, one narrow row per block and channel, in order; and
every block is run again from its true state. The way back is the same on the blocks turned round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurolith.functions.distributed import cut_lineage
from neurolith.operators import blocks as bk
from neurolith.operators import signals as sg

Sections = list[tuple[np.ndarray, np.ndarray]]


@lru_cache(maxsize=256)
def sections_of(order: int, low: float | None, high: float | None, rate: float) -> tuple[Sections, int]:
    """The cascade of a Butterworth filter, and how many samples are put before and after a channel."""
    b, _ = sg.butterworth_sections(order, low, high, rate)
    return sg.cascade(*sg.butterworth_roots(order, low, high, rate)), 3 * len(b)


def sizes(sections: Sections) -> np.ndarray:
    """Where the states of the sections begin in their list."""
    return np.cumsum([0, *(len(a) - 1 for _, a in sections)])


def run(sections: Sections, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(output, states at the end) of a cascade that is entered with some states."""
    at, ends = sizes(sections), []
    for (b, a), i, j in zip(sections, at[:-1], at[1:], strict=True):
        x, s = sg.run_filter(b, a, x, state[i:j])
        ends.append(s)
    return x, np.concatenate(ends)


def at_rest(sections: Sections, level: float) -> np.ndarray:
    """The states that an endless input of ``level`` leads to."""
    out = []
    for b, a in sections:
        out.append(sg.steady_state(b, a) * level)
        level *= b.sum() / a.sum()
    return np.concatenate(out)


class Carried:
    """What states become over n samples of no input, worked out once per n."""

    def __init__(self, sections: Sections):
        self.sections, self.known = sections, {}

    def over(self, n: int) -> np.ndarray:
        if n not in self.known:
            self.known[n] = np.stack([run(self.sections, np.zeros(n), e)[1] for e in np.eye(int(sizes(self.sections)[-1]))], axis=1)
        return self.known[n]


def entered(ends: DataFrame, backwards: bool, order: int, low: float | None, high: float | None) -> DataFrame:
    """(channel, blk, state): what each block is entered with. ends: (channel, blk, rate, n, first, rest), n the samples of a block,
    first the value that it begins with on this way, rest its states at the end when entered with none.

    Rows stream by in order; only one channel's states are held."""
    key = (F.desc if backwards else F.asc)("blk")
    rows = ends.repartition(*bk.CHANNEL).sortWithinPartitions(*bk.CHANNEL, key)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, state, last = None, None, (0, np.zeros(0))
        carried: dict[float, Carried] = {}
        for b in batches:
            out = []
            for rid, ch, blk, rate, n, first, rest in zip(*(b[c] for c in (*bk.BLOCK, "rate", "n", "first", "rest")), strict=True):
                sections, _ = sections_of(order, low, high, rate)
                if (rid, ch) != channel:
                    channel, state = (rid, ch), at_rest(sections, first)
                else:
                    state = carried.setdefault(rate, Carried(sections)).over(last[0]) @ state + last[1]
                out.append((rid, ch, blk, state.tolist()))
                last = int(n), np.asarray(rest)
            yield pd.DataFrame(out, columns=[*bk.BLOCK, "state"])

    return rows.mapInPandas(follow, "recording_id string, channel_idx int, blk bigint, state array<double>")


def zero_phase_blocks(x: DataFrame, rates: DataFrame, low: float | None, high: float | None, order: int = 3, width: int = bk.WIDTH) -> tuple[DataFrame, DataFrame]:
    """(filtered channels, the channels that are too short for the filter, as they are). rates: (recording_id, rate), above 0."""
    blocks = bk.attach(bk.pack(x, width), rates, ["recording_id"])
    _, pad = sections_of(order, low, high, 1.0)
    w = Window.partitionBy(*bk.CHANNEL)
    tips = blocks.select(*bk.BLOCK, F.size("vs").alias("n"), F.slice("vs", 1, pad + 1).alias("head"), F.slice("vs", F.greatest(F.size("vs") - pad, F.lit(1)), pad + 1).alias("tail"))
    tips = tips.withColumn("up", F.row_number().over(w.orderBy("blk"))).withColumn("down", F.row_number().over(w.orderBy(F.desc("blk")))).withColumn("total", F.sum("n").over(w))
    tips = tips.filter((F.col("up") <= pad + 1) | (F.col("down") <= pad + 1))  # these hold the first and last pad + 1 samples
    near = lambda side, array: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(side) <= pad + 1, F.struct("blk", array)))), lambda s: s[array]))
    facts = tips.groupBy(*bk.CHANNEL).agg(near("up", "head").alias("heads"), near("down", "tail").alias("tails"), F.min("blk").alias("from_blk"), F.max("blk").alias("to_blk"), F.max("total").alias("total"))
    facts = cut_lineage(facts.select(*bk.CHANNEL, F.slice("heads", 1, pad + 1).alias("heads"), F.slice("tails", F.greatest(F.size("tails") - pad, F.lit(1)), pad + 1).alias("tails"), "from_blk", "to_blk", "total"))
    known = bk.attach(blocks, facts, bk.CHANNEL)
    long = known.filter(F.col("total") > pad)

    def widened(r: dict) -> np.ndarray:
        """A block with what is put before the first and after the last of its channel."""
        before, after = sg.odd_ends(np.asarray(r["heads"], float), np.asarray(r["tails"], float))
        return np.concatenate([before if r["blk"] == r["from_blk"] else [], r["vs"], after if r["blk"] == r["to_blk"] else []])

    def filtered(r: dict, v: np.ndarray, state) -> tuple[np.ndarray, np.ndarray]:
        return run(sections_of(order, low, high, r["rate"])[0], v, np.asarray(state, float))

    def ends(df: DataFrame, values: Callable[[dict], np.ndarray]) -> DataFrame:
        def fn(r: dict) -> tuple:
            v = values(r)
            rest = np.zeros(int(sizes(sections_of(order, low, high, r["rate"])[0])[-1]))
            return r["rate"], v.size, float(v[0]), filtered(r, v, rest)[1].tolist()

        return cut_lineage(bk.each(df, fn, "rate double, n bigint, first double, rest array<double>"))

    there = bk.attach(long, cut_lineage(entered(ends(long, widened), False, order, low, high)), bk.BLOCK)
    made = bk.each(there, lambda r: (r["rate"], r["ts"], int(r["blk"] == r["from_blk"]), filtered(r, widened(r), r["state"])[0].tolist()), "rate double, ts array<int>, lead int, ys array<double>")
    made = cut_lineage(made)
    turned = lambda r: np.asarray(r["ys"], float)[::-1]
    back = bk.attach(made, cut_lineage(entered(ends(made, turned), True, order, low, high)), bk.BLOCK)

    def final(r: dict) -> np.ndarray:
        v = filtered(r, turned(r), r["state"])[0][::-1]
        start = pad if r["lead"] else 0
        return v[start : start + len(r["ts"])]

    short = known.filter(F.col("total") <= pad)
    return bk.unpack(back, final), bk.unpack(short, lambda r: r["vs"])
