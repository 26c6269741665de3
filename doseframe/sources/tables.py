"""Table scans: Parquet, JDBC, catalog listing, typed rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F
from pyspark.sql.types import StructType

from doseframe.operators.ordering import first_by_key


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet scan; a given schema is taken as it is, without reading footers for it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def list_tables(spark: SparkSession, database: str | None = None) -> set[str]:
    """Names of the catalog's tables and views."""
    return {t.name for t in spark.catalog.listTables(database)}


def jdbc_reader(
    spark: SparkSession, url: str, table: str | None = None, query: str | None = None, partition_column: str | None = None,
    bounds: tuple[int, int] | None = None, partitions: int | None = None, fetch_size: int = 10_000, driver: str | None = None,
) -> DataFrameReader:
    """Reader for a whole table (in parallel key ranges) or for a query the source runs."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options: dict[str, str] = {"url": url, "fetchsize": str(fetch_size)}
    if driver:
        options["driver"] = driver
    if query is not None:
        options["query"] = query
    else:
        options["dbtable"] = table
        if partition_column is not None:
            if bounds is None or partitions is None:
                raise ValueError("a partition column needs bounds and a partition count")
            options |= {
                "partitionColumn": partition_column, "lowerBound": str(bounds[0]),
                "upperBound": str(bounds[1]), "numPartitions": str(partitions),
            }
    return spark.read.format("jdbc").options(**options)


def limited(df: DataFrame, n: int | None, key: str | None = None) -> DataFrame:
    """At most n rows; with a unique numeric key the n smallest keys, so the subset is repeatable."""
    if n is None:
        return df
    return df.limit(n) if key is None else first_by_key(df, key, n)


def coerced(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns cast to the schema; text that is no value of the type becomes null."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields if f.name in df.columns])


def rows_to_frame(spark: SparkSession, rows: Iterable[dict], schema: StructType) -> DataFrame:
    """A small settings or result table from dicts; absent fields are null."""
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)
