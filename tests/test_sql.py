import pytest

from neurolith.functions.sql import register_functions, register_views


def test_functions_and_views(spark, tmp_path):
    spark.range(3).selectExpr("id", "array(1d, cast(id as double)) as e").write.parquet(str(tmp_path / "things.parquet"))
    assert register_views(spark, str(tmp_path)) == ["things"]
    register_functions(spark)
    assert [r[0] for r in spark.sql("SELECT dot(e, array(2d, 3d)) FROM things ORDER BY id").collect()] == [2.0, 5.0, 8.0]
    row = spark.sql("SELECT document_id('a'), normalized_text(' A  b\n'), cjk_count('ab中文'), solid_length(' a b '), glyph_count('/G34/G3F'), half_even(-19.5D), half_even(2.5D)").collect()[0]
    assert tuple(row) == ("86f7e437faa5a7fc", "a b", 2, 2, 2, -20, 2)
    assert spark.sql("SELECT optical_density(1d, 2.718281828459045d)").collect()[0][0] == pytest.approx(1)
