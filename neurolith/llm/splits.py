"""Train, validation and test splits that keep everything tied to one person together.

Recordings, links and persons form a bipartite graph (records name entities). Minimum labels travel along it until
nothing changes; labels are also replaced by their own labels each round, which halves long chains. The resulting
groups are then assigned to the splits so that sizes and label distributions deviate least.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolith.functions.distributed import cut_lineage, hot_keys, lookup

# What is typed where a subject is missing. The first is what recordings get when nobody is named.
STAND_INS = ["subject_0", "", "?", "-", "n/a", "na", "none", "null", "nan", "unknown", "test", "unk", "anonymous", "missing", "tbd"]
WIDE = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F))
NARROW = "".join(chr(c) for c in range(0x21, 0x7F))


def person_number(code: Column) -> Column:
    """Personal number of a typed code without leading zeros; null for stand-ins and codes without a number.

    The number is the first run of digits after an optional word; what follows (a session or run) is no part of it.
    """
    c = F.trim(F.lower(F.translate(F.regexp_replace(code, r"[\s 　]+", " "), WIDE, NARROW)))
    digits = F.regexp_extract(c, r"^[^0-9]*?0*([0-9]+)", 1)
    return F.when(~c.isin(STAND_INS) & (digits != ""), digits)


def naming(recordings: DataFrame, epochs: DataFrame, links: DataFrame) -> DataFrame:
    """Edges (record, entity): recordings and links name persons (site and number)."""
    head = recordings.filter("recording_id is not null").select("recording_id", "site", "default_subject", "subject_ids")
    codes = head.select("recording_id", "site", F.explode(F.array_distinct(F.concat(F.array("default_subject"), F.coalesce("subject_ids", F.array().cast("array<string>"))))).alias("code"))
    sites = head.filter("site is not null").groupBy("recording_id").agg(F.min("site").alias("site"))
    typed = epochs.filter("recording_id is not null and subject is not null").select("recording_id", F.col("subject").alias("code")).distinct()
    codes = codes.unionByName(typed.join(sites, "recording_id").select("recording_id", "site", "code"))
    key = lambda site, code: F.concat_ws("/", F.lit("p"), F.trim(F.lower(site)), person_number(code))
    known = codes.filter(F.col("site").isNotNull() & person_number(F.col("code")).isNotNull())
    edges = known.select(F.concat(F.lit("r/"), "recording_id").alias("record"), key(F.col("site"), F.col("code")).alias("entity"))
    ends = F.array(F.struct(F.col("site_a").alias("s"), F.col("code_a").alias("c")), F.struct(F.col("site_b").alias("s"), F.col("code_b").alias("c")))
    a, b = key(F.col("site_a"), F.col("code_a")), key(F.col("site_b"), F.col("code_b"))
    both = links.filter(F.col("site_a").isNotNull() & F.col("site_b").isNotNull() & person_number(F.col("code_a")).isNotNull() & person_number(F.col("code_b")).isNotNull())
    # records of links sort after those of recordings, so that a group with a recording is labelled by one
    tied = both.select(F.concat_ws("|", F.lit("z"), F.least(a, b), F.greatest(a, b)).alias("record"), F.explode(ends).alias("e"))
    return edges.unionByName(tied.select("record", key(F.col("e.s"), F.col("e.c")).alias("entity"))).distinct()


def propagate(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(record, label): the smallest record of each connected component of a bipartite graph.

    Each round takes the label of the label, then the minimum over a record's entities and their records. Both minima are
    aggregated before the shuffle; records, entities and labels of very many rows are spread (``lookup``). Raises if the
    labels still change after ``rounds`` rounds.
    """
    edges = cut_lineage(edges)
    hot_record, hot_entity = hot_keys(edges, ["record"]), hot_keys(edges, ["entity"])
    labels = edges.select("record").distinct().withColumn("label", F.col("record"))
    for i in range(rounds):
        far = labels.select(F.col("record").alias("label"), F.col("label").alias("far"))
        jumped = lookup(labels, far, ["label"], hot_keys(labels, ["label"])).select("record", F.col("label").alias("old"), F.col("far").alias("label")) if i else labels.withColumn("old", F.col("label"))
        by_entity = lookup(edges, jumped.select("record", "label"), ["record"], hot_record).groupBy("entity").agg(F.min("label").alias("label"))
        near = lookup(edges, by_entity, ["entity"], hot_entity).groupBy("record").agg(F.min("label").alias("label"))
        new = cut_lineage(near.join(jumped.select("record", "old"), "record").select("record", "label", (F.col("label") < F.col("old")).alias("moved")))
        labels = new.select("record", "label")
        if new.filter("moved").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def epoch_groups(recordings: DataFrame, epochs: DataFrame, links: DataFrame) -> DataFrame:
    """(epoch_id, recording_id, label, group): epochs with the key of the set that must stay together.

    An epoch whose recording has no header or names nobody is tied to its recording only; one without a recording_id is
    a group of its own. Repeated rows count once per epoch_id and recording.
    """
    labels = propagate(naming(recordings, epochs, links))
    e = epochs.select("epoch_id", "recording_id", "label", F.concat(F.lit("r/"), "recording_id").alias("record"))
    e = lookup(e, labels.withColumnRenamed("label", "group"), ["record"], hot_keys(e, ["record"]), "left")
    own = F.coalesce("group", "record", F.concat(F.lit("e/"), F.col("epoch_id").cast("string")))
    return e.select("epoch_id", "recording_id", "label", own.alias("group"))


def tied_epochs(recordings: DataFrame, epochs: DataFrame, links: DataFrame) -> DataFrame:
    """(anchor_epoch_id, epoch_id): of each set of two or more epochs, one row per epoch but the smallest."""
    e = cut_lineage(epoch_groups(recordings, epochs, links).filter("epoch_id is not null").select("epoch_id", "group").distinct())
    anchors = e.groupBy("group").agg(F.min("epoch_id").alias("anchor_epoch_id"))
    return lookup(e, anchors, ["group"], hot_keys(e, ["group"])).filter("epoch_id > anchor_epoch_id").select("anchor_epoch_id", "epoch_id")


SPLITS = ("train", "validation", "test")


def assign_groups(sizes: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Split of each group (rows: groups, columns: labels), largest first, so that the squared deviation of every
    split's label counts from its share of each label is least after each step. Ties go to the earlier split."""
    total = sizes.sum(axis=0)
    want = shares[:, None] * total[None, :]
    scale = 1.0 / np.maximum(total, 1)
    have = np.zeros_like(want, dtype=float)
    out = np.zeros(len(sizes), int)
    for i in range(len(sizes)):
        # only the chosen split's term changes: compare the change of its deviation
        before, after = (have - want) ** 2 * scale, (have + sizes[i] - want) ** 2 * scale
        change = (after - before).sum(axis=1)
        change[shares <= 0] = np.inf
        out[i] = int(np.argmin(change))
        have[out[i]] += sizes[i]
    return out


def shares_of(train: Column, val: Column, test: Column) -> Column:
    """Shares that add up to 1: per cent or fractions, missing ones from what the others leave, else 0.7, 0.15, 0.15."""
    parts = F.transform(F.array(train, val, test), lambda x: F.when(x.isNotNull() & ~F.isnan(x), F.greatest(x, F.lit(0.0))))
    known = F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    missing = F.size(F.filter(parts, lambda x: x.isNull()))
    unit = F.when(known > 1.5, F.lit(100.0)).otherwise(F.lit(1.0))
    rest = F.greatest(unit - known, F.lit(0.0)) / F.greatest(missing, F.lit(1))
    filled = F.transform(parts, lambda x: F.coalesce(x, rest))
    total = F.aggregate(filled, F.lit(0.0), lambda a, x: a + x)
    default = F.array(F.lit(0.7), F.lit(0.15), F.lit(0.15))
    return F.when((missing == 3) | (total <= 0), default).otherwise(F.transform(filled, lambda x: x / total))


def split_epochs(recordings: DataFrame, epochs: DataFrame, links: DataFrame, experiments: DataFrame, items: int = 2000) -> DataFrame:
    """(experiment_id, epoch_id, split) for every epoch of the recordings of an experiment's dataset.

    Groups below 1/``items`` of a dataset's epochs travel in bundles by hash (at most 2 x ``items`` of them), so that one
    assignment handles at most 3 x ``items`` rows per label, however many people a dataset has. Experiments without a dataset have
    no rows. Deterministic in the experiment's seed.
    """
    g = epoch_groups(recordings, epochs, links).filter("epoch_id is not null")
    data = recordings.filter("dataset_id is not null").groupBy("recording_id").agg(F.min("dataset_id").alias("dataset_id"))
    e = g.join(data, "recording_id").select("epoch_id", "dataset_id", "group", F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("label"))
    e = cut_lineage(e)
    counts = e.groupBy("dataset_id", "group", "label").agg(F.countDistinct("epoch_id").alias("n"))
    whole = counts.groupBy("dataset_id").agg(F.sum("n").alias("all"))
    weight = counts.groupBy("dataset_id", "group").agg(F.sum("n").alias("own"))
    item = F.when(F.col("own") * items >= F.col("all"), F.col("group")).otherwise(F.concat(F.lit("bundle/"), F.pmod(F.xxhash64("group"), F.lit(2 * items))))
    members = weight.join(whole, "dataset_id").select("dataset_id", "group", item.alias("item"))
    totals = counts.join(members, ["dataset_id", "group"]).groupBy("dataset_id", "item", "label").agg(F.sum("n").alias("n"))
    x = experiments.filter("experiment_id is not null and dataset_id is not null").dropDuplicates(["experiment_id"])
    x = x.select("experiment_id", "dataset_id", F.coalesce("seed", F.lit(0)).cast("bigint").alias("seed"), shares_of(F.col("train_share"), F.col("val_share"), F.col("test_share")).alias("shares"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="item", columns="label", values="n", aggfunc="sum", fill_value=0).sort_index()
        rng = np.random.default_rng(abs(int(pdf["seed"].iloc[0])))
        order = rng.permutation(len(table))
        order = order[np.argsort(-table.to_numpy()[order].sum(axis=1), kind="stable")]
        split = assign_groups(table.to_numpy(float)[order], np.asarray(pdf["shares"].iloc[0], float))
        return pd.DataFrame({"experiment_id": pdf["experiment_id"].iloc[0], "dataset_id": pdf["dataset_id"].iloc[0], "item": table.index.to_numpy()[order], "split": [SPLITS[i] for i in split]})

    chosen = x.join(totals, "dataset_id").groupBy("experiment_id").applyInPandas(assign, "experiment_id string, dataset_id string, item string, split string")
    placed = chosen.join(members, ["dataset_id", "item"]).select("experiment_id", "dataset_id", "group", "split")
    # one row per group with the splits of all experiments on its dataset, so that large groups can be spread
    splits = placed.groupBy("dataset_id", "group").agg(F.collect_list(F.struct("experiment_id", "split")).alias("x"))
    ids, keys = e.select("dataset_id", "group", "epoch_id").distinct(), ["dataset_id", "group"]
    return lookup(ids, splits, keys, hot_keys(e, keys)).select(F.explode("x").alias("x"), "epoch_id").select("x.experiment_id", "epoch_id", "x.split")
