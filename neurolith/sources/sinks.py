"""Writing results: JSON of experiments and explanations, a markdown report, and the chunk index."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolith.functions.distributed import cut_lineage


#: Folders of an index on disk: documents share them by a hash of their id, so that their number does not grow with the documents.
BUCKETS = 256


def write_index(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Chunks as Parquet in folders by hash of the document; of an existing index only the documents at hand are replaced.

    Folders that hold a document at hand are written anew with the chunks of all their other documents."""
    new = chunks.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))
    try:
        old = chunks.sparkSession.read.parquet(path)
    except AnalysisException:  # nothing there yet
        old = None
    if old is not None:
        touched, ids = new.select("bucket").distinct(), new.select("document_id").distinct()
        kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(ids, "document_id", "left_anti")
        new = cut_lineage(new.unionByName(kept.select(*new.columns)))  # read before its folders are overwritten
    new.repartition("bucket", F.pmod(F.xxhash64("document_id"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Rows with a column json as text, one document per row (results, explanations)."""
    rows.select("json").coalesce(1).write.mode("overwrite").text(path)


def checkpoint_json(family: str, seed: int) -> str:
    """Description of a fitted classifier, from which the experiment can be run again."""
    return json.dumps({"model_family": family, "seed": seed, "note": "run the experiment again for the centroids"}, ensure_ascii=False)


def result_json(predictions: DataFrame, accuracy: DataFrame, confusion: DataFrame) -> DataFrame:
    """One row with the JSON of an experiment: pooled accuracy, folds and confusion counts."""
    folds = accuracy.agg(F.array_sort(F.collect_list(F.struct("fold", "n", "accuracy"))).alias("folds"))
    cells = confusion.agg(F.array_sort(F.collect_list(F.struct("label", "prediction", "n"))).alias("confusion"))
    pooled = predictions.agg(F.count(F.lit(1)).alias("n_samples"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    x = one(pooled).join(one(folds), "_k").join(one(cells), "_k").drop("_k")
    return x.select(F.to_json(F.struct("n_samples", F.round("accuracy", 4).alias("accuracy"), "folds", "confusion")).alias("json"))


NOTE = "The figures describe the recordings at hand and this classifier only; they are no basis for decisions about people."


def report(result: DataFrame, top: DataFrame | None = None, config: dict | None = None, note: str = NOTE) -> DataFrame:
    """One row with a markdown report of ``result_json``: overview, folds, the top channels, the settings and a note on limits;
    missing values print as N/A, missing parts say so."""
    r = result.select(F.from_json("json", "n_samples bigint, accuracy double, folds array<struct<fold:string,n:bigint,accuracy:double>>").alias("r"))
    show = lambda c: F.coalesce(c.cast("string"), F.lit("N/A"))
    lines = F.array_join(F.transform("r.folds", lambda f: F.concat(F.lit("| "), show(f["fold"]), F.lit(" | "), show(f["n"]), F.lit(" | "), show(F.round(f["accuracy"], 4)), F.lit(" |"))), "\n")
    head = F.concat(F.lit("# Experiment\n\n- samples: "), show(F.col("r.n_samples")), F.lit("\n- accuracy: "), show(F.col("r.accuracy")), F.lit("\n\n## Folds\n\n| fold | n | accuracy |\n|---|---|---|\n"))
    tail = "\n\n## Settings\n\n```json\n" + json.dumps(config or {}, ensure_ascii=False, indent=2, sort_keys=True) + "\n```\n\n## Limits\n\n" + note
    if top is None:
        return r.select(F.concat(head, F.coalesce(lines, F.lit("N/A")), F.lit("\n\n## Channels\n\n- no explanation" + tail)).alias("report"))
    best = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("o"), "idx", "importance"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(F.lit("- channel "), x["idx"].cast("string"), F.lit(": "), F.round(x["importance"], 6).cast("string"))), "\n")
    out = r.select(F.concat(head, F.coalesce(lines, F.lit("N/A"))).alias("report")).withColumn("_k", F.lit(1)).join(best.withColumn("_k", F.lit(1)), "_k")
    return out.select(F.concat("report", F.lit("\n\n## Channels\n\n"), text, F.lit(tail)).alias("report"))
