"""Ranks, running totals and cuts of lineage that stay spread over tasks whatever the skew."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolith.session import checkpoint_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written once to the session's shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows like ``cut_lineage``, as compressed Parquet: for wide rows, of which each step reads the columns it needs.

    The files lie in the checkpoint folder and are removed when the session's JVM ends.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bits_for(rows: int, bucket: int = 50_000) -> int:
    """Upper bits of a hash that cut ``rows`` rows of one group into buckets of about ``bucket`` rows."""
    return min(24, max(1, math.ceil(math.log2(max(rows, 1) / bucket))) if rows > bucket else 1)


def salted_rank(df: DataFrame, keys: list[str], order: Column, name: str, bits: int | None = None) -> DataFrame:
    """Adds the 0-based rank of each row within ``keys`` by a long ``order`` that is spread over all 64 bits (a hash).

    Two levels: the upper bits of the order cut each group into buckets that are ranked on their own; the offsets of the
    buckets come from counts that are aggregated before the shuffle. A group of any share of the rows stays divided.
    ``bits`` default to what cuts a group of all rows into buckets of 50,000 (the rows are counted).
    Ties in ``order`` get distinct ranks in an unspecified order.
    """
    bits = bits_for(df.count()) if bits is None else bits
    cols = [c for c in df.columns]
    d = df.withColumn("_o", order).withColumn("_b", F.shiftright("_o", 64 - bits).cast("int"))
    counts = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    ranked = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_o")))
    return ranked.join(offsets, [*keys, "_b"]).select(*cols, (F.col("_off") + F.col("_r") - 1).alias(name))


#: Most rows that are broadcast, of at most a few numbers and short names each (about 40 MB).
BROADCAST_ROWS = 400_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, marked for broadcast if they were counted to be at most ``most``; for narrow rows that are cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hot_keys(df: DataFrame, keys: list[str], parts: int = 512, least: int = 100_000) -> DataFrame | None:
    """(keys, _copies) of the keys that hold more than 1/``parts`` of the rows, hence fewer than ``parts`` of them; None if none."""
    n = df.count()
    limit = max(n // parts, least)
    if n <= limit:
        return None
    known = df.dropna(subset=keys).groupBy(*keys).count().filter(F.col("count") > limit)
    hot = [(*r[:-1], -(-r["count"] // limit)) for r in known.collect()]
    if not hot:
        return None
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.sparkSession.createDataFrame(hot, f"{kinds}, _copies bigint")


def lookup(df: DataFrame, facts: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``df`` joined to ``facts``, which has at most one row per key; the rows of ``hot`` keys are spread over copies of it.

    hot: from ``hot_keys`` of df, made once for any number of joins. The copies (at most twice ``parts``) are the only rows
    added. The salt is a hash of the row, so that a lost task gives the same rows again. how: inner or left.
    """
    if hot is None:
        return df.join(facts, keys, how)
    cols = df.columns
    salted = df.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*cols), F.coalesce("_copies", F.lit(1)))).drop("_copies")
    spread = facts.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def running_total(df: DataFrame, keys: list[str], position: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Adds the sum of ``value`` over the earlier positions within ``keys`` (exclusive), in two levels.

    Positions are cut into stretches of ``width``; only one row per stretch takes part in the window over a whole group.
    """
    cols = df.columns
    d = df.withColumn("_s", F.floor(F.col(position) / width))
    sums = d.groupBy(*keys, "_s").agg(F.sum(value).alias("_v"))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_s", F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, "_s").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return d.join(sums, [*keys, "_s"]).select(*cols, (F.col("_base") + F.col("_in")).alias(name))


def previous_value(df: DataFrame, keys: list[str], position: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Adds the value of the position before within ``keys`` (null for the first), in two levels like ``running_total``."""
    cols = df.columns
    d = df.withColumn("_s", F.floor(F.col(position) / width))
    lasts = d.groupBy(*keys, "_s").agg(F.max_by(value, position).alias("_last"))
    lasts = lasts.select(*keys, "_s", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_s")).alias("_before"))
    d = d.withColumn("_in", F.lag(value).over(Window.partitionBy(*keys, "_s").orderBy(position)))
    return d.join(lasts, [*keys, "_s"]).select(*cols, F.coalesce("_in", "_before").alias(name))


def within(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int = 256) -> DataFrame:
    """Points joined to the spans that hold them: equal ``key`` and start <= at < end.

    Spans are cut into stretches of ``width``, so that the join is on equal keys and only compares neighbours.
    """
    s = spans.filter(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    return p.join(s, [key, "_b"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, width: int = 4096) -> DataFrame:
    """``left`` with ``value`` of the latest row of ``right`` of the same key at or before ``at`` (a long); null without one.

    Both sides are stacked and cut into stretches of ``width``; only the last value per stretch takes part in the window over a
    whole key, so that a key with any share of the rows stays divided. No pairs are formed. Of several values at one time the
    largest counts.
    """
    cols = left.columns
    facts = right.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.max(F.struct(value)).alias("_v"))
    both = left.withColumn("_mine", F.lit(True)).unionByName(facts, allowMissingColumns=True).withColumn("_s", F.floor(F.col(at) / width))
    lasts = facts.withColumn("_s", F.floor(F.col(at) / width)).groupBy(key, "_s").agg(F.max_by("_v", at).alias("_last"))
    spans = both.select(key, "_s").distinct().join(lasts, [key, "_s"], "left")
    before = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(key, "_s", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    # of one time the facts come first
    inner = Window.partitionBy(key, "_s").orderBy(at, F.col("_mine").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    x = both.withColumn("_in", F.last("_v", ignorenulls=True).over(inner)).filter("_mine").join(spans, [key, "_s"], "left")
    return x.select(*cols, F.coalesce("_in", "_before")[value].alias(value))
