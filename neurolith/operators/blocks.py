"""Channels in blocks: one row per channel and stretch of samples, with the samples as arrays.

What needs the order of samples is done block by block in NumPy; what passes from one block to the next (last value, running sum, state
of a filter) is one narrow row per block, so that no task ever holds a channel. Medians are exact: a histogram over the leading bits
of the values finds the bucket that holds the middle, and only the values of that bucket are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurolith.functions.distributed import broadcast_if_small, cut_lineage

CHANNEL = ["recording_id", "channel_idx"]
BLOCK = [*CHANNEL, "blk"]
WIDTH = 8192
LONG = "recording_id string, channel_idx int, t int, v double"
#: Trailing bits of a double that buckets leave out: 12 bits of the mantissa remain.
DROPPED = 40


def pack(x: DataFrame, width: int = WIDTH) -> DataFrame:
    """(channel, blk, ts, vs): samples in order of t, ``width`` values of t to a block; written once."""
    b = x.groupBy(*CHANNEL, F.floor(F.col("t") / width).alias("blk")).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))
    return cut_lineage(b.select(*BLOCK, F.col("s.t").alias("ts"), F.col("s.v").alias("vs")))


def attach(blocks: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with narrow facts of their channel or block; the facts are broadcast if they are few enough."""
    return blocks.join(broadcast_if_small(facts), keys)


def with_previous(blocks: DataFrame) -> DataFrame:
    """Adds before: the last value of the channel's block before; null for the first."""
    ends = blocks.select(*BLOCK, F.element_at("vs", -1).alias("last"))
    w = Window.partitionBy(*CHANNEL).orderBy("blk")
    return attach(blocks, cut_lineage(ends.select(*BLOCK, F.lag("last").over(w).alias("before"))), BLOCK)


def sortable(v: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order."""
    bits = (np.asarray(v, float) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _stacked(b: pd.DataFrame, parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pd.DataFrame:
    """A row per element of the arrays that were made of each row of b, with the channel of that row."""
    size = [len(p[0]) for p in parts]
    out = {c: np.repeat(b[c].to_numpy(), size) for c in CHANNEL}
    return pd.DataFrame(out | {n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)})


def _rows(b: pd.DataFrame) -> list[dict]:
    return b.to_dict("records")


def medians(blocks: DataFrame, values: Callable[[dict], np.ndarray], name: str) -> DataFrame:
    """(channel, name): exact median per channel of what ``values`` makes of each block; the mean of the two in the middle."""

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield _stacked(b, [np.unique(sortable(values(r)) >> DROPPED, return_counts=True) for r in _rows(b)], ["bucket", "n"])

    h = blocks.mapInPandas(histogram, "recording_id string, channel_idx int, bucket bigint, n bigint").groupBy(*CHANNEL, "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*CHANNEL)
    h = h.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    h = h.withColumn("low", F.floor((F.col("total") - 1) / 2)).withColumn("high", F.floor(F.col("total") / 2)).withColumn("base", F.col("upto") - F.col("n"))
    # one bucket holds both middle values, or two hold one each
    holds = lambda r: (F.col("base") <= F.col(r)) & (F.col(r) < F.col("upto"))
    picked = h.filter(holds("low") | holds("high")).groupBy(*CHANNEL).agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.min("base").alias("base"), F.min("low").alias("low"), F.min("high").alias("high"))
    picked = cut_lineage(picked)

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for r in _rows(b):
                v = values(r)
                k = sortable(v) >> DROPPED
                parts.append(np.unique(v[(k == r["first"]) | (k == r["last"])] + 0.0, return_counts=True))
            if parts:
                yield _stacked(b, parts, ["u", "n"])

    found = attach(blocks, picked.select(*CHANNEL, "first", "last"), CHANNEL).mapInPandas(inside, "recording_id string, channel_idx int, u double, n bigint")
    found = found.groupBy(*CHANNEL, "u").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w.orderBy("u")))
    x = found.join(picked, CHANNEL)
    at = lambda r: F.min(F.when(F.col("base") + F.col("upto") > F.col(r), F.col("u")))
    return x.groupBy(*CHANNEL).agg(((at("low") + at("high")) / 2).alias(name))


def each(blocks: DataFrame, fn: Callable[[dict], tuple], ddl: str) -> DataFrame:
    """One row per block: channel, blk, and what ``fn`` gives of it. ddl: of the latter."""
    names = [f.strip().split(" ")[0] for f in ddl.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r["recording_id"], r["channel_idx"], r["blk"], *fn(r)) for r in _rows(b)], columns=[*BLOCK, *names])

    return blocks.mapInPandas(run, f"recording_id string, channel_idx int, blk bigint, {ddl}")


def unpack(blocks: DataFrame, fn: Callable[[dict], np.ndarray]) -> DataFrame:
    """(channel, t, v) with the values that ``fn`` makes of each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield _stacked(b, [(r["ts"], fn(r)) for r in _rows(b)], ["t", "v"])

    return blocks.mapInPandas(run, LONG)
