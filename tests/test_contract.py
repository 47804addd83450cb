import __spark_entry__ as contract


def test_entry_rows_and_schema(spark):
    df = contract.entry(spark)
    assert {"stratum", "selector", "budget", "mean_coverage"} <= set(df.columns)
    assert df.count() == 70


def test_names_agree():
    q, o = contract.queries(), contract.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180


def test_entropy_matches_built_in_histogram(spark, sf):
    from pyspark.sql import functions as F

    from spanframe.operators import sequence

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    a = sequence.tile_entropy(d, "doc_id", "text", 64).select("sample_id", "tile", F.round("entropy", 9).alias("e"))
    h = sequence.symbol_histogram_sql(d, "doc_id", "text", 64).groupBy("sample_id", "tile").agg(
        F.round(F.log2(F.sum("cnt")) - F.sum(F.col("cnt") * F.log2("cnt")) / F.sum("cnt"), 9).alias("e"))
    assert a.exceptAll(h).count() == 0 and a.count() == h.count()


def test_leak_guard(spark):
    import pytest

    from spanframe.operators import audit

    clean = spark.createDataFrame([("x", 1)], "name string, n int")
    assert audit.assert_no_leak(clean, ["sha256"]).count() == 1
    with pytest.raises(ValueError):
        audit.assert_no_leak(clean.withColumnRenamed("name", "sha256"), ["sha256"])
    with pytest.raises(ValueError):
        audit.assert_no_leak(spark.createDataFrame([("a" * 64, 1)], "name string, n int"), ["sha256"])
