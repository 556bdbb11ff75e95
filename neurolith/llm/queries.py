"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from neurolith.llm import encoding, lookalike, mixing, packing, pieces, splits, survivors
from neurolith.session import table


def _tables(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(encoding.texts_of(*_tables(spark, d, "chunks", "paper_materials"))).select("table_name", "record_id").distinct()


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(encoding.texts_of(*_tables(spark, d, "chunks", "paper_materials")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_epochs(*_tables(spark, d, "recordings", "epochs", "subject_links"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_epochs(*_tables(spark, d, "recordings", "epochs", "subject_links", "experiments"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.same_work_pairs(table(spark, d, "candidates"))


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(*_tables(spark, d, "candidates", "paper_sources"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the splitter had to cut."""
    stored = pieces.stored_chunks(*_tables(spark, d, "chunks", "kb_documents", "chunk_limits"))
    return pieces.oversized_pieces(stored).filter("piece_idx = 0").select("document_id", "ord")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.all_pieces(*_tables(spark, d, "chunks", "kb_documents", "chunk_limits"))


def p5_sizes(spark: SparkSession, d: str) -> DataFrame:
    return pieces.recomputed_sizes(*_tables(spark, d, "chunks", "kb_documents", "chunk_limits"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(*_tables(spark, d, "documents", "pack_specs"))


def p6_harmonic(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_harmonic(*_tables(spark, d, "documents", "pack_specs"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    docs, specs = _tables(spark, d, "documents", "pack_specs")
    return packing.fill(packing.pack(docs, specs), specs)


def p7_draw(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(*_tables(spark, d, "documents", "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = _tables(spark, d, "documents", "mix_targets")
    return mixing.reached(mixing.draw(docs, targets), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_pairs(table(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unify(table(spark, d, "documents"))


NUMBER = "CAST(CASE WHEN lower(trim({0})) IN ('', '?', 'n/a', 'none', 'test', 'unknown', 'subject_0') THEN NULL ELSE nullif(regexp_extract(translate({0}, '０１２３４５６７８９', '0123456789'), '[0-9]+'), '') END AS BIGINT)"

SQL = {
    "p2_found": f"""
        WITH RECURSIVE head AS (SELECT recording_id, min(site) AS site FROM recordings GROUP BY 1),
        named AS (SELECT recording_id, site, default_subject AS code FROM recordings UNION ALL SELECT recording_id, site, unnest(subject_ids) FROM recordings
          UNION ALL SELECT e.recording_id, h.site, e.subject FROM epochs e JOIN head h USING (recording_id)),
        who AS (SELECT DISTINCT 'r/' || recording_id AS a, 'p/' || site || '/' || {NUMBER.format("code")} AS b FROM named WHERE site IS NOT NULL),
        tie AS (SELECT 'p/' || site_a || '/' || {NUMBER.format("code_a")} AS a, 'p/' || site_b || '/' || {NUMBER.format("code_b")} AS b FROM subject_links),
        edge AS (SELECT a, b FROM who WHERE b IS NOT NULL UNION SELECT b, a FROM who WHERE b IS NOT NULL
          UNION SELECT a, b FROM tie WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM tie WHERE a IS NOT NULL AND b IS NOT NULL),
        reach AS (SELECT DISTINCT 'r/' || recording_id AS a, 'r/' || recording_id AS b FROM epochs UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
        root AS (SELECT a, min(b) AS set_id FROM reach WHERE b LIKE 'r/%' GROUP BY 1),
        member AS (SELECT epoch_id, min(epoch_id) OVER (PARTITION BY set_id) AS anchor_epoch_id FROM epochs JOIN root ON a = 'r/' || recording_id)
        SELECT anchor_epoch_id, epoch_id FROM member WHERE epoch_id > anchor_epoch_id
    """,
    "p5_found": """
        SELECT c.document_id, c.ord FROM (SELECT document_id, ord, arg_max(content, indexed_at) AS content FROM chunks
          WHERE content IS NOT NULL AND document_id IS NOT NULL AND ord IS NOT NULL GROUP BY document_id, ord) c
        JOIN kb_documents k USING (document_id) JOIN chunk_limits l ON l.shelf = k.shelf
        WHERE length(c.content) > l.max_chars
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (p1_found, p1_restored, p2_found, p2_splits, p4_found, p4_survivors, p5_found, p5_pieces, p5_sizes, p6_containers, p6_harmonic, p6_fill, p7_draw, p7_shares, p8_found, p8_forms)
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["oracle_sql", "queries"]
