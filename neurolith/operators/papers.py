"""Candidates of paper searches: gathering them from several sources, removing repeats, ranking and looking up known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolith.functions import text as tx
from neurolith.operators.tables import latest

# Sources whose candidates count whatever their score, and the least score of all others.
GIVEN = ("direct_url", "model_candidate")
LEAST_SCORE = 0.18
#: Most queries of an expansion, and most candidates that go on from a search.
MOST_QUERIES, MOST_CANDIDATES = 8, 8


def gathered(*parts: DataFrame) -> DataFrame:
    """The candidates of several sources below each other; adds part, the number of the source that they come from."""
    out = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    whole = out[0]
    for p in out[1:]:
        whole = whole.unionByName(p)
    return whole


def expanded_queries(query: Column, *more: Column) -> Column:
    """Distinct queries of a search (arrays of texts, the first one's first), cut to ``MOST_QUERIES``.

    Runs of blanks count as one, case does not count, the spelling that comes first stays. Nothing usable: the query itself.
    """
    clean = F.filter(F.transform(F.concat(*more), lambda q: F.trim(F.regexp_replace(q, tx.BLANK + "+", " "))), lambda q: q.isNotNull() & (q != ""))
    first = F.aggregate(
        clean,
        F.array().cast("array<string>"),
        lambda kept, q: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(q)), kept).otherwise(F.concat(kept, F.array(q))),
    )
    return F.when(F.size(first) > 0, F.slice(first, 1, MOST_QUERIES)).otherwise(F.array(F.trim(query)))


def with_identity(candidates: DataFrame) -> DataFrame:
    """Adds key: the identity by DOI, else title, else link."""
    return candidates.withColumn("key", tx.identity_key(F.col("doi"), F.col("title"), F.coalesce("pdf_url", "url")))


def _no_pdf() -> Column:
    return F.col("pdf_url").isNull()


def _no_abstract() -> Column:
    return F.coalesce(F.col("abstract"), F.lit("")) == ""


def deduplicated(candidates: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of each identity within ``by`` the first candidate in ``order``, numbered (rank, from 0): those with a PDF first, then
    those with an abstract, then those given directly, else in ``order``. Only the first ``MOST_CANDIDATES`` of a group go on.

    The limit is applied in every task before the shuffle, so that a group of any size stays divided."""
    one = latest(with_identity(candidates), [*by, "key"], *map(F.col, order))
    w = Window.partitionBy(*by).orderBy(_no_pdf(), _no_abstract(), F.coalesce(F.col("source"), F.lit("")) != "direct_url", *map(F.col, order))
    return one.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < MOST_CANDIDATES)


def score(query: Column, all_terms: Column, title_terms: Column, pdf: Column, doi: Column) -> Column:
    """Share of the query's terms found, more for those in the title, for a PDF and for a DOI; 0 for a query without terms."""
    n = F.greatest(F.size(query), F.lit(1))
    found = F.size(F.array_intersect(query, all_terms)) / n + 0.35 * F.size(F.array_intersect(query, title_terms)) / n
    return F.when(F.size(query) == 0, 0.0).otherwise(found + F.when(pdf, 0.05).otherwise(0.0) + F.when(doi, 0.03).otherwise(0.0))


def ranked(candidates: DataFrame, queries: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(by, candidate_id, score, rn): the deduplicated candidates of each query (by, query_text), best score first, of equal ones
    those with a PDF, then with an abstract, then in the order of ``deduplicated``.

    Candidates below ``LEAST_SCORE`` are left out unless their source is one of ``GIVEN``. Queries are one per ``by``.
    """
    c = deduplicated(candidates, [by], order)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.concat_ws(" ", "authors"), F.coalesce("doi", F.lit("")))
    x = c.join(queries.select(by, tx.content_terms(F.col("query_text")).alias("_q")), by)
    s = score(F.col("_q"), tx.content_terms(text), tx.content_terms(F.coalesce("title", F.lit(""))), ~_no_pdf(), F.coalesce("doi", F.lit("")) != "")
    x = x.withColumn("score", s).filter((F.col("score") >= LEAST_SCORE) | F.col("source").isin(*GIVEN))
    w = Window.partitionBy(by).orderBy(F.desc("score"), _no_pdf(), _no_abstract(), "rank")
    return x.withColumn("rn", F.row_number().over(w)).select(by, "candidate_id", "score", "rn")


def known_folders(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """(candidate_id, folder, by): where a candidate's paper is kept already. stored: (key, title, folder).

    The identity key counts first, then the normalised title; of several folders the smallest. One row per key and per title is
    joined, so that often stored papers do not multiply the candidates."""
    c = with_identity(candidates).select("candidate_id", "key", tx.title_key(F.col("title")).alias("title"))
    by_key = stored.filter("key is not null").groupBy("key").agg(F.min("folder").alias("by_key"))
    by_title = stored.select(tx.title_key(F.col("title")).alias("title"), "folder").filter("title <> ''").groupBy("title").agg(F.min("folder").alias("by_title"))
    x = c.join(by_key, "key", "left").join(by_title, "title", "left")
    found = x.withColumn("folder", F.coalesce("by_key", "by_title")).filter("folder is not null")
    return found.select("candidate_id", "folder", F.when(F.col("by_key").isNotNull(), "key").otherwise("title").alias("by"))
