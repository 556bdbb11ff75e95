"""Hash embeddings, exact vector search for a set of queries, and upkeep of an index table of chunks."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS = re.compile(r"[\w一-鿿]+")


def hash_counts(text: str, dim: int) -> dict[int, float]:
    """Bucket weights of a text: tokens of up to two characters and trigrams of longer ones, hashed by BLAKE2b (8 bytes,
    little-endian) modulo ``dim`` (at least 64), counted and scaled to length 1, in ascending order. Blank: none."""
    dim = max(dim, 64)
    text = " ".join(text.lower().split())
    grams: Counter = Counter()
    for token in TOKENS.findall(text) or text.split():
        for g in [token] if len(token) <= 2 else (token[i : i + 3] for i in range(len(token) - 2)):
            grams[int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little") % dim] += 1
    norm = sum(v * v for v in grams.values()) ** 0.5
    return {k: v / norm for k, v in sorted(grams.items())}


def hash_embedding(docs: DataFrame, id_col: str, text_col: str, dim: int = 4096) -> DataFrame:
    """(id, bucket, weight): sparse embeddings in long form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, v) for i, t in zip(b["i"], b["t"], strict=True) for k, v in sorted(hash_counts(t, dim).items())]
            yield pd.DataFrame(rows, columns=[id_col, "bucket", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null and i is not null").mapInPandas(run, f"{id_col} {kind}, bucket int, weight double")


#: Queries that one scan of the data answers, and queries whose scores are held at a time.
QUERIES_PER_SCAN, QUERIES_PER_BLOCK = 32768, 1024


def _best(scores: np.ndarray, ids: np.ndarray, best_s: np.ndarray, best_i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the rows so far and new ones in descending order, ties by the larger id.

    Only what reaches the k-th best score is sorted."""
    s = np.hstack([best_s, scores])
    i = np.hstack([best_i, np.broadcast_to(ids, (s.shape[0], ids.size))])
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        enough = s >= least[:, None]
        width = int(enough.sum(axis=1).max())
        keep = np.argsort(~enough, axis=1, kind="stable")[:, :width]  # those that reach it come first
        s, i = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
    order = np.lexsort((i, s), axis=1)[:, ::-1][:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _parts(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of ``size`` rows."""
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield part


def _ranked(hits: DataFrame | None, empty: DataFrame, k: int) -> DataFrame:
    """Hits of all partitions with their rank; the best one counts whatever its score, others only above 0."""
    if hits is None:
        return empty
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))
    return hits.withColumn("rn", F.row_number().over(w)).filter((F.col("rn") <= k) & ((F.col("score") > 0) | (F.col("rn") == 1)))


def hash_search(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k: int = 4, dim: int = 4096, block: int = QUERIES_PER_SCAN // 16) -> DataFrame:
    """(query_id, id, score, rn): the k best texts for each query text by hash embeddings, exactly.

    Like ``top_k``; a text is hashed once per scan, and its vector exists only while it is scored. Where the rows have stored vectors
    (buckets, weights of the same dimension, as an index has them), these are used. Blank queries and texts have no
    hits. The best hit counts whatever its score, others only above 0.
    """
    k, dim = max(k, 1), max(dim, 64)
    stored = {"buckets", "weights"} <= set(docs.columns)
    own = ["buckets", "weights"] if stored else [F.col(text_col).alias("t")]
    named = docs.filter(F.col("buckets" if stored else text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), *own)
    asked = queries.filter(F.col(query_text).isNotNull() & F.col(query_id).isNotNull()).select(F.col(query_id).cast("string").alias("q"), F.col(query_text).alias("t"))

    def score(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            best_s, best_i = np.full((len(names), 0), -np.inf), np.zeros((len(names), 0), object)
            for b in batches:
                for part in _parts(zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True), 512):
                    vectors = [(r[0], r[1], r[2]) if stored else (r[0], list(v := hash_counts(r[1], dim)), list(v.values())) for r in part]
                    got = [(i, at, w) for i, at, w in vectors if at]
                    if got:
                        cols = [matrix[at].T @ np.asarray(w, float) for _, at, w in got]
                        best_s, best_i = _best(np.stack(cols, 1), np.array([i for i, _, _ in got], object), best_s, best_i, k)
            n = best_s.shape[1]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n).tolist()), pa.array(best_i.ravel().tolist()), pa.array(best_s.ravel())], names=["query_id", "id", "score"])

        return run

    out = None
    for rows in _parts(asked.toLocalIterator(), block):
        vectors = [(r["q"], v) for r in rows if (v := hash_counts(r["t"], dim))]
        if vectors:
            m = np.zeros((dim, len(vectors)))
            for j, (_, v) in enumerate(vectors):
                m[list(v), j] = list(v.values())
            got = named.mapInArrow(score(docs.sparkSession.sparkContext.broadcast(([q for q, _ in vectors], m))), "query_id string, id string, score double")
            out = got if out is None else out.unionByName(got)
    return _ranked(out, docs.sparkSession.createDataFrame([], "query_id string, id string, score double, rn int"), k)


def l2_norm(e: Column) -> Column:
    return F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalized(e: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = l2_norm(e)
    return F.transform(e, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def top_k(index: DataFrame, queries: DataFrame, k: int = 4, block: int = QUERIES_PER_SCAN, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rn): the k best rows of ``index`` for each query by dot product, exactly.

    One scan of the index answers ``block`` queries (a bound on what is sent to the workers): every partition scores them in
    blocks, each as one matrix product, and hands on only its own k best. Rows whose dimension differs from the query's are no
    hits. k is at least 1. The best row is returned even if its score is not above 0, others only if it is. Ties: the larger id.
    Null vectors are left out.
    """
    k = max(k, 1)
    spark = index.sparkSession
    index = index.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("e"))
    queries = queries.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("query_id"), F.col(vec_col).cast("array<double>").alias("e"))

    def score(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = shared.value
            best = [(np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)) for ids, _ in blocks]
            for b in batches:
                lists = b.column("e")
                sizes, own = np.diff(lists.offsets.to_numpy()), b.column("id").to_numpy()
                for size in {v.shape[1] for _, v in blocks}:
                    keep = np.flatnonzero(sizes == size)
                    if not keep.size:
                        continue
                    m = np.vstack([lists[i].values.to_numpy() for i in keep]) if keep.size < sizes.size else lists.flatten().to_numpy().reshape(-1, size)
                    for j, (_, vectors) in enumerate(blocks):
                        if vectors.shape[1] == size:
                            best[j] = _best(vectors @ m.T, own[keep], *best[j], k)
            for (ids, _), (s, i) in zip(blocks, best, strict=True):
                if s.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, s.shape[1])), pa.array(i.ravel()), pa.array(s.ravel())], names=["query_id", "id", "score"])

        return run

    out = None
    for rows in _parts(queries.toLocalIterator(), block):
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r["e"]), []).append(r)
        blocks = [(np.array([r["query_id"] for r in p], np.int64), np.array([r["e"] for r in p], float).reshape(len(p), -1)) for part in by_size.values() for p in _parts(part, QUERIES_PER_BLOCK)]
        got = index.mapInArrow(score(spark.sparkContext.broadcast(blocks)), "query_id bigint, id bigint, score double")
        out = got if out is None else out.unionByName(got)
    return _ranked(out, spark.createDataFrame([], "query_id bigint, id bigint, score double, rn int"), k)


def upsert(old: DataFrame, new: DataFrame, key: str, carried: str | None = None, by: str | None = None) -> DataFrame:
    """The old rows of keys that ``new`` doesn't have, and all new rows. ``carried``: a flag that new rows take over from the
    old row of the same key and ``by`` (true where there is none)."""
    rest = old.join(new.select(key).distinct(), key, "left_anti")
    if carried:
        flags = old.groupBy(key, by).agg(F.min(carried).alias("_was"))
        new = new.drop(carried).join(flags, [key, by], "left").withColumn(carried, F.coalesce("_was", F.lit(True))).drop("_was")
    return rest.unionByName(new.select(*rest.columns))


def remove(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


def manifest_diff(found: DataFrame, indexed: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, state): new, changed, gone or same, by comparing the stamps of found and indexed sources."""
    f, i = found.groupBy(key).agg(F.max(stamp).alias("a")), indexed.groupBy(key).agg(F.max(stamp).alias("b"))
    state = F.when(F.col("in_i").isNull(), "new").when(F.col("in_f").isNull(), "gone").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return f.withColumn("in_f", F.lit(1)).join(i.withColumn("in_i", F.lit(1)), key, "full").select(key, state.alias("state"))


def context_block(hits: DataFrame) -> DataFrame:
    """(query_id, context): the hits of a query as one numbered text. hits: query_id, rn, title, content."""
    line = F.format_string("[%d] %s\n%s", "rn", "title", "content")
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("s")))).alias("l"))
    return g.select("query_id", F.array_join(F.transform("l", lambda x: x["s"]), "\n\n").alias("context"))
