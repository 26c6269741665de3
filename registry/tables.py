"""Scans, typed reads and the raw export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F, types as T

from doseframe.operators import ordering as O
from doseframe.session import scratch_path
from doseframe.sources import sinks, tables
from registry.base import query, r, rounded
from registry.inputs import table

NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
         "pages", "benchmark", "labels", "conversations"]
COUNTS = " union all ".join(f"select '{n}' as table_name, count(*) as rows from {n}" for n in NAMES)


@query("table_inventory", COUNTS)
def table_inventory(spark, d):
    counts = [table(spark, d, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in NAMES]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("export_tables", f"select table_name, rows, true as ok from ({COUNTS}) union all select 'no_such_table', null, false")
def export_tables(spark, d):
    """A missing table is reported and does not stop the others."""
    status = sinks.export_tables(spark, [*NAMES, "no_such_table"], lambda n: table(spark, d, n), scratch_path(spark, "export"))
    return status.select("table_name", "rows", "ok")


@query("exported_rows", "select l_orderkey, count(*) as rows from lineitem group by 1")
def exported_rows(spark, d):
    out = scratch_path(spark, "export")
    sinks.export_tables(spark, ["lineitem"], lambda n: table(spark, d, n), out)
    back = tables.read_table(spark, f"{out}/raw_lineitem.parquet", table(spark, d, "lineitem").schema)
    return back.groupBy("l_orderkey").agg(F.count("*").alias("rows"))


@query("first_orders", "select o_orderkey, o_custkey from orders order by o_orderkey limit 500")
def first_orders(spark, d):
    return tables.limited(table(spark, d, "orders"), 500, "o_orderkey").select("o_orderkey", "o_custkey")


@query("preview", "select o_orderkey, o_orderstatus from orders order by o_orderkey limit 5")
def preview(spark, d):
    return O.first_by_key(table(spark, d, "orders"), "o_orderkey", 5).select("o_orderkey", "o_orderstatus")


@query("typed_columns", f"""select doc_id::VARCHAR::BIGINT as doc_id, try_cast(lang as INTEGER) as lang,
 try_cast(substr(source, 4) as INTEGER) as source, {r("try_cast(n_chars::VARCHAR as DOUBLE)")} as n_chars from documents""")
def typed_columns(spark, d):
    """Everything as text first, then to the wanted types; text that is no number becomes null."""
    raw = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "lang", F.expr("substring(source, 4)").alias("source"),
        F.col("n_chars").cast("string").alias("n_chars"),
    )
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("lang", T.IntegerType()),
        T.StructField("source", T.IntegerType()), T.StructField("n_chars", T.DoubleType()),
    ])
    return rounded(tables.coerced(raw, schema))
