"""Raw export job: every table of a catalog database, or of a JDBC source, to Parquet.

    spark-submit -m doseframe.plans.export <database> <output dir> [row limit]
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from doseframe.session import build_session
from doseframe.sources.sinks import export_tables
from doseframe.sources.tables import jdbc_reader, list_tables

# Fixed value: the catalog query of the relational source.
TABLE_LIST_QUERY = "SELECT name FROM sqlite_master WHERE type = 'table'"


def export_database(spark: SparkSession, database: str, out_dir: str, limit: int | None = None) -> DataFrame:
    return export_tables(spark, list_tables(spark, database), lambda n: spark.table(f"{database}.{n}"), out_dir, limit)


def export_jdbc(spark: SparkSession, url: str, out_dir: str, limit: int | None = None) -> DataFrame:
    """Needs the source's JDBC driver on the class path. The list of names is the only collect."""
    names = {r[0] for r in jdbc_reader(spark, url, query=TABLE_LIST_QUERY).load().distinct().collect()}
    return export_tables(spark, names, lambda n: jdbc_reader(spark, url, table=n).load(), out_dir, limit)


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    limit = int(sys.argv[3]) if len(sys.argv) > 3 else None
    status = export_database(build_session("raw-export"), sys.argv[1], sys.argv[2], limit)
    status.show(truncate=False)
