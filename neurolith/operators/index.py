"""Building and upkeep of the chunk index: full refresh, update of what changed, and checks before it is used."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolith.functions import text as tx
from neurolith.functions.distributed import cut_lineage
from neurolith.operators import chunking, retrieval


class StaleIndexError(ValueError):
    """No source that can be indexed, or an index that does not fit its sources or settings."""


def by_sentences(files: DataFrame, most: int = 900) -> DataFrame:
    """(source, ord, content) by the chunker of ``chunking``."""
    return chunking.chunk_documents(files, "source", "text", most).select(F.col("document_id").alias("source"), "ord", "content")


def by_paragraphs(files: DataFrame) -> DataFrame:
    """(source, ord, content): what stands between blank lines, within the JVM."""
    parts = F.filter(F.transform(F.split("text", r"\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"^[ \t\n]+|[ \t\n]+$", "")), lambda p: p != "")
    return files.select("source", F.posexplode(parts).alias("ord", "content"))


def readable_files(files: DataFrame) -> DataFrame:
    """Files whose text is neither null nor blank and does not look like glyph names."""
    return files.filter(F.col("text").isNotNull() & (F.trim(F.regexp_replace("text", tx.BLANK + "+", " ")) != "") & ~tx.looks_like_glyphs(F.col("text")))


def embedded(chunks: DataFrame, dim: int = 4096) -> DataFrame:
    """Adds buckets and weights: the hash embedding as a sparse vector, in ascending order of the buckets."""

    @F.pandas_udf("struct<buckets: array<int>, weights: array<double>>")
    def vectors(s: pd.Series) -> pd.DataFrame:
        rows = [sorted(retrieval.hash_counts(t, dim).items()) if t else [] for t in s]
        return pd.DataFrame({"buckets": [[k for k, _ in r] for r in rows], "weights": [[v for _, v in r] for r in rows]})

    return chunks.withColumn("_e", vectors("content")).select(*chunks.columns, "_e.buckets", "_e.weights")


def new_chunks(files: DataFrame, flags: DataFrame, by: list[str], chunks_of: Callable[[DataFrame], DataFrame], dim: int | None = None) -> DataFrame:
    """(chunk_id, source, ord, content, enabled[, buckets, weights]) of readable files; enabled is carried over from ``flags``
    (by, enabled; of several the smallest), true where there is none. dim: of the embedding, None for none."""
    c = chunks_of(readable_files(files)).withColumn("chunk_id", F.concat_ws("#", "source", F.col("ord").cast("string")))
    was = flags.groupBy(*by).agg(F.min("enabled").alias("enabled"))
    c = c.join(was, by, "left").select("chunk_id", "source", "ord", "content", F.coalesce("enabled", F.lit(True)).alias("enabled"))
    return c if dim is None else embedded(c, dim)


def refresh(files: DataFrame, previous: DataFrame | None, chunks_of: Callable[[DataFrame], DataFrame] = by_sentences, dim: int | None = 4096) -> DataFrame:
    """The index of all files (source, text), with the flags of ``previous`` by chunk_id. Raises if there is no file, or none of
    them gives a chunk."""
    if files.limit(1).count() == 0:
        raise StaleIndexError("no file to index")
    flags = previous if previous is not None else files.sparkSession.createDataFrame([], "chunk_id string, enabled boolean")
    out = cut_lineage(new_chunks(files, flags.select("chunk_id", "enabled"), ["chunk_id"], chunks_of, dim))
    if out.limit(1).count() == 0:
        raise StaleIndexError("the files give no readable chunk")
    return out


def states(files: DataFrame, manifest: DataFrame, same_settings: bool = True) -> DataFrame:
    """(source, state) of files and manifest entries (source, path, updated_at, size_chars): unindexed, missing, current, or
    stale where path, time or size differ, or the settings the index was made with."""
    fields = ["path", "updated_at", "size_chars"]
    f = files.groupBy("source").agg(F.max(F.struct(*fields)).alias("f"))
    m = manifest.groupBy("source").agg(F.max(F.struct(*fields)).alias("m"))
    state = F.when(F.col("m").isNull(), "unindexed").when(F.col("f").isNull(), "missing").when(F.lit(same_settings) & F.col("f").eqNullSafe(F.col("m")), "current").otherwise("stale")
    return f.join(m, "source", "full").select("source", state.alias("state"))


def update(index: DataFrame, files: DataFrame, state: DataFrame, chunks_of: Callable[[DataFrame], DataFrame] = by_sentences, dim: int | None = 4096) -> DataFrame:
    """The index after its stale and unindexed files were chunked and embedded anew (flags carried by ord) and missing ones left
    out; chunks of current files stay as they are, vectors included."""
    state = cut_lineage(state)
    redo = state.filter("state in ('stale', 'unindexed')").select("source")
    kept = index.join(state.filter("state = 'current'").select("source"), "source", "left_semi")
    fresh = new_chunks(files.join(redo, "source", "left_semi"), index.select("source", "ord", "enabled"), ["source", "ord"], chunks_of, dim)
    return kept.select(*fresh.columns).unionByName(fresh)


def loaded(index: DataFrame, state: DataFrame, allow_unindexed: bool = True) -> DataFrame:
    """The index, checked: raises if a source is stale or missing (or unindexed, if that is not allowed). Empty chunks are left
    out."""
    bad = state.filter(~F.col("state").isin(["current", *(["unindexed"] if allow_unindexed else [])])).limit(1).collect()
    if bad:
        raise StaleIndexError(f"{bad[0]['source']} is {bad[0]['state']}")
    return index.filter("content is not null and content <> ''")


def listed(documents: DataFrame, limit: int = 50) -> DataFrame:
    """The first sources in alphabetical order, at least one."""
    return documents.select("source").distinct().orderBy("source").limit(max(limit, 1))


def found(documents: DataFrame, name: str) -> DataFrame:
    """The document whose source is ``name``; without one, the first in order whose source ends with it."""
    hit = documents.filter(F.col("source").endswith(name))
    return hit.orderBy(F.col("source") != name, "source").limit(1)


def excerpt(text: Column, most: int = 5000) -> Column:
    """The beginning of a text, at least one character."""
    return F.substring(text, 1, max(most, 1))
