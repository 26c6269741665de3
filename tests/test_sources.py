import pytest
from pyspark.sql import functions as F, types as T

from doseframe import schemas as S, session
from doseframe.plans.export import export_database
from doseframe.sources import sinks, tables
from doseframe.sources.sinks import export_tables


def test_export_skips_a_failing_table(spark, tmp_path):
    def read(name):
        if name == "broken":
            raise OSError("no such table")
        return spark.range({"small": 5, "large": 50}[name])

    out = str(tmp_path / "raw")
    status = {r.table_name: r for r in sinks.export_tables(spark, {"small", "large", "broken"}, read, out, limit=20).collect()}
    assert (status["small"].rows, status["large"].rows, status["broken"].ok) == (5, 20, False)
    assert "no such table" in status["broken"].error
    assert spark.read.parquet(f"{out}/raw_large.parquet").count() == 20
    import glob

    assert glob.glob(f"{out}/raw_small.parquet/*.zstd.parquet")


def test_export_database(spark, tmp_path):
    spark.sql("create database if not exists exported location '%s'" % (tmp_path / "db"))
    spark.range(7).write.saveAsTable("exported.seven")
    try:
        assert tables.list_tables(spark, "exported") == {"seven"}
        status = export_database(spark, "exported", str(tmp_path / "raw")).collect()
        assert [(r.table_name, r.rows, r.ok) for r in status] == [("seven", 7, True)]
    finally:
        spark.sql("drop database exported cascade")


def test_export_is_whole_unless_a_limit_is_given(spark, tmp_path):
    big = spark.range(0, 2_100_000, 1, 4)
    row = export_tables(spark, ["big"], lambda _: big, str(tmp_path / "a")).first()
    assert (row.rows, row.ok, row.truncated) == (2_100_000, True, False)
    assert len(list((tmp_path / "a/raw_big.parquet").glob("part-*"))) == 4
    row = export_tables(spark, ["big"], lambda _: big, str(tmp_path / "b"), 1000).first()
    assert (row.rows, row.truncated) == (1000, True)


def test_limited(spark):
    df = spark.range(100)
    assert tables.limited(df, None).count() == 100
    assert tables.limited(df, 7).count() == 7
    assert {r.id for r in tables.limited(df, 3, "id").collect()} == {0, 1, 2}


def test_jdbc_reader_checks_its_arguments(spark):
    with pytest.raises(ValueError):
        tables.jdbc_reader(spark, "jdbc:x")
    with pytest.raises(ValueError):
        tables.jdbc_reader(spark, "jdbc:x", table="a", query="select 1")
    with pytest.raises(ValueError):
        tables.jdbc_reader(spark, "jdbc:x", table="a", partition_column="id")
    assert tables.jdbc_reader(spark, "jdbc:x", table="a", partition_column="id", bounds=(0, 10), partitions=4) is not None


def test_coerced(spark):
    df = spark.createDataFrame([("1", "x", "2.5"), (None, "7", "n/a")], "a string, b string, c string")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.IntegerType()), T.StructField("c", T.DoubleType()), T.StructField("absent", T.StringType())])
    out = tables.coerced(df, schema)
    assert out.dtypes == [("a", "bigint"), ("b", "int"), ("c", "double")]
    assert [tuple(r) for r in out.collect()] == [(1, None, 2.5), (None, 7, None)]


def test_rows_to_frame(spark):
    out = tables.rows_to_frame(spark, [{"model": "MLP", "seed": 1}, {"model": "GNN", "r2_val": 0.5}], S.RESULT_SCHEMA)
    assert out.schema == S.RESULT_SCHEMA
    assert [(r.model, r.seed, r.r2_val) for r in out.collect()] == [("MLP", 1, None), ("GNN", None, 0.5)]


def test_read_table_takes_the_given_schema(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    assert sinks.write_parquet(spark.range(3).withColumn("x", F.lit(1.0)), path) == 3
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("later", T.StringType())])
    assert [tuple(r) for r in tables.read_table(spark, path, schema).orderBy("id").collect()] == [(0, None), (1, None), (2, None)]


def test_checkpoint_folder_is_the_session_s(spark):
    root = session.checkpoint_root(spark)
    assert root == spark.sparkContext.getCheckpointDir()
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")
    df = session.cut_lineage(spark.range(5).where("id > 2"))
    assert sorted(r.id for r in df.collect()) == [3, 4]
    assert session.staged(spark.range(5), "five").count() == 5
