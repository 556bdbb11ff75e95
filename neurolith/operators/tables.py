"""Upkeep and reading of metadata tables: latest rows, overlays, folds of event logs, ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; Spark keeps one row per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def newest(df: DataFrame, n: int, at: str, tie: str) -> DataFrame:
    """The n newest rows (at least 1), ties by the larger ``tie``."""
    return df.orderBy(F.desc(at), F.desc(tie)).limit(max(n, 1))


def overlay(defaults: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """Defaults with the stored values that are not blank."""
    s = stored.select(key, F.col(value).alias("_v"))
    return defaults.join(s, key, "left").select(key, F.coalesce(F.when(F.trim("_v") != "", F.col("_v")), F.col(value)).alias(value))


def last_known(log: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Per key the last value of each field that is not null, in one aggregation."""
    return log.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def with_nulled(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """References to keys that are gone become null."""
    g = gone.select(F.col(column).alias("_g")).distinct()
    return df.join(g, F.col(column) == F.col("_g"), "left").withColumn(column, F.when(F.col("_g").isNull(), F.col(column))).drop("_g")


def json_equals(payload: Column, path: str, value: str) -> Column:
    """Whether a JSON text has a value at a path; texts that don't parse have none."""
    return F.coalesce(F.get_json_object(payload, path) == value, F.lit(False))


def decoded(payload: Column, schema: str, default: Column) -> Column:
    """A JSON text as a struct; the default where it doesn't parse."""
    return F.when(F.try_parse_json(payload).isNull(), default).otherwise(F.from_json(payload, schema))


def tail(items: Column, n: int) -> Column:
    """The last n items of an array."""
    return F.when(F.size(items) == 0, items).otherwise(F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n))


def last_values(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """(keys, items): the n largest values of each key in ascending order. Every task keeps n per key before anything is shuffled."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value))
    top = df.select(*keys, value).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("items"))


def since_last(df: DataFrame, keys: list[str], position: str, marker: Column) -> DataFrame:
    """Rows from the last marker of their key on; all rows of a key without one."""
    at = df.filter(marker).groupBy(*keys).agg(F.max(position).alias("_from"))
    return df.join(at, keys, "left").filter(F.col("_from").isNull() | (F.col(position) >= F.col("_from"))).drop("_from")


def keep_first(df: DataFrame, key: Column, order: Column) -> DataFrame:
    return latest(df.withColumn("_key", key), ["_key"], order).drop("_key")


def inserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with further rows; columns that these lack are null."""
    return df.unionByName(rows, allowMissingColumns=True)


def updated(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """The table with new values in the rows that a condition holds for; null counts as not holding."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def merged(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the values of ``changes`` (one row per key) in the columns that these have, null values too."""
    names = [c for c in changes.columns if c != key]
    n = changes.select(F.col(key).alias("_k"), F.struct(*names).alias("_n"))
    x = df.join(n, F.col(key) == F.col("_k"), "left")
    return x.select(*[F.when(F.col("_k").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def deleted(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The table without the rows of some keys."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def affected(df: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(key, n): how many rows of the table each asked key has; 0 for one that does not exist, to be known before a delete."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return asked.select(key).distinct().join(per, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def with_default(df: DataFrame, row: DataFrame) -> DataFrame:
    """The table, or the default row where it is empty."""
    one = df.limit(1).agg(F.count(F.lit(1)).alias("_n"))
    return df.unionByName(row.join(F.broadcast(one.filter("_n = 0")), F.lit(True)).drop("_n"))
