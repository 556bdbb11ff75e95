"""Views of a directory's tables and the text rules as SQL functions, which stay in the JVM."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from neurolith.functions.text import BLANK, CJK, GLYPH

#: name -> (parameter and result types, body)
FUNCTIONS = {
    "document_id": ("s STRING", "STRING", "substring(sha1(s), 1, 16)"),
    "normalized_text": ("s STRING", "STRING", f"trim(regexp_replace(lower(s), r'{BLANK}+', ' '))"),
    "cjk_count": ("s STRING", "INT", f"regexp_count(s, r'{CJK}')"),
    "solid_length": ("s STRING", "INT", f"char_length(regexp_replace(s, r'{BLANK}+', ''))"),
    "glyph_count": ("s STRING", "INT", f"regexp_count(s, r'{GLYPH}')"),
    "dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"),
    "optical_density": ("v DOUBLE, m DOUBLE", "DOUBLE", "-ln(greatest(v, 1e-6D) / greatest(m, 1e-6D))"),
    "half_even": ("v DOUBLE", "BIGINT", "CAST(bround(v, 0) AS BIGINT)"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the rules callable from SQL for this session; returns their names."""
    for name, (params, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """A temporary view per Parquet table of a directory; returns their names."""
    names = sorted(f[:-8] for f in os.listdir(sf_dir) if f.endswith(".parquet"))
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
    return names
