"""Hand-computed cases of the activity table: units, label, join, rules."""

import math

import pytest
from pyspark.sql import functions as F

from doseframe import schemas as S
from doseframe.functions import potency as P
from doseframe.operators import cleaning as C
from doseframe.plans import etl

INF, NAN = float("inf"), float("nan")

CASES = [  # value, unit, ready label, unit after, label, kept by the ETL, kept for learning
    (50.0, "nM", 7.3, "nM", 7.301030, True, True),
    (10.0, None, None, "nM", 8.0, True, True),
    (0.01, None, None, "nM", 11.0, True, True),
    (1e6, None, None, "nM", 3.0, True, True),
    (2e6, None, 5.1, None, 5.1, True, True),
    (5.0, "uM", 5.3, "uM", 5.3, True, True),
    (None, "nM", 6.2, "nM", 6.2, True, True),
    (None, None, None, None, None, False, False),
    (0.0, "nM", 6.0, "nM", INF, False, False),
    (-1.0, "nM", 6.0, "nM", NAN, True, False),
]


def test_units_label_and_cleaning(spark):
    rows = [(i, v, u, p, f"s{i}") for i, (v, u, p, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "activity_id long, standard_value double, standard_units string, pchembl_value double, canonical_smiles string")
    done = {r.activity_id: r for r in C.with_potency(df).collect()}
    for i, (_, _, _, unit, label, _, _) in enumerate(CASES):
        assert done[i].standard_units == unit
        if label is None:
            assert done[i].pIC50 is None
        elif math.isnan(label):
            assert math.isnan(done[i].pIC50)
        else:
            assert done[i].pIC50 == pytest.approx(label, abs=1e-6)
    kept = {r.activity_id for r in etl.processed_activity(df).collect()}
    assert kept == {i for i, c in enumerate(CASES) if c[5]}
    learned = {r.activity_id for r in C.label_valid(etl.processed_activity(df), "canonical_smiles").collect()}
    assert learned == {i for i, c in enumerate(CASES) if c[6]}


def test_join_filters(spark):
    act = [  # id, assay, molecule, duplicate flag
        (1, 10, 100, 0), (2, 10, 100, 1), (3, 10, 101, None), (4, 11, 100, 0), (5, 10, None, 0), (6, 12, 100, 0), (7, 10, 102, 0),
    ]
    tables = {
        "activities": spark.createDataFrame([(a, s, m, 5.0, "nM", "IC50", "=", 6.0, d) for a, s, m, d in act], S.SOURCE_SCHEMAS["activities"]),
        "assays": spark.createDataFrame([(10, 1, 9), (11, 99, 9), (12, 2, 9)], S.SOURCE_SCHEMAS["assays"]),
        "target_dictionary": spark.createDataFrame([(1, "CHEMBL220", "A"), (2, "OTHER", "B")], S.SOURCE_SCHEMAS["target_dictionary"]),
        "compound_structures": spark.createDataFrame([(100, "C"), (101, "CC"), (102, None)], S.SOURCE_SCHEMAS["compound_structures"]),
        "compound_properties": spark.createDataFrame([(m, 1.0, 1.0, 1, 1, 1.0, 1, 1, 0.5) for m in (100, 101, 102)], S.SOURCE_SCHEMAS["compound_properties"]),
    }
    flat = etl.joined_activity(tables)
    assert flat.columns == S.ACTIVITY_SCHEMA.names[:-1]
    assert {r.activity_id for r in flat.collect()} == {1, 3}


def test_etl_job(spark, tmp_path):
    src = str(tmp_path / "src")
    for name, schema in S.SOURCE_SCHEMAS.items():
        rows = {
            "activities": [(i, 10, i % 3, 10.0 ** i, "nM", "Ki", None, 6.0, None) for i in range(9)],
            "assays": [(10, 1, 9)], "target_dictionary": [(1, "CHEMBL3177", "T")],
            "compound_structures": [(m, "CC" if m < 2 else "N") for m in range(3)],
            "compound_properties": [(m, 1.0, 1.0, 1, 1, 1.0, 1, 1, 0.5) for m in range(3)],
        }[name]
        spark.createDataFrame(rows, schema).write.parquet(f"{src}/{name}.parquet")
    out = str(tmp_path / "out")
    assert etl.run(spark, src, out) == 2
    saved = spark.read.parquet(out)
    assert saved.columns == S.ACTIVITY_SCHEMA.names
    assert {(r.canonical_smiles, r.activity_id) for r in saved.collect()} == {("CC", 0), ("N", 2)}
    again = etl.processed_activity(saved)
    assert again.count() == 2  # cleaning twice changes nothing


def test_rule_flags(spark):
    rows = [(500.0, 5.0, 5, 10, 0), (501.0, 5.1, 6, 11, 4), (501.0, 2.0, 1, 1, 1), (None, 2.0, 1, 1, None)]
    df = spark.createDataFrame(rows, "mw_freebase double, alogp double, hbd int, hba int, want int")
    out = C.with_rule_violations(df)
    assert dict(out.dtypes)["lipinski_violations"] == "tinyint"
    assert all(r.lipinski_violations == r.want for r in out.collect())
    from doseframe.operators.profile import share

    assert share(out, F.col("lipinski_violations") <= 1).first()["share"] == 0.5
    assert share(out.where("false"), F.col("lipinski_violations") <= 1).first()["share"] is None


def test_units_and_censoring(spark):
    df = spark.createDataFrame(
        [(1.0, "uM", ">"), (2.0, "M", None), (3.0, "%", "<"), (4.0, None, "=")], "standard_value double, standard_units string, standard_relation string"
    ).withColumn("pIC50", F.lit(9.0))
    assert {r.standard_value for r in C.with_common_unit(df).collect()} == {1000.0, 2e9}
    assert [r.censoring for r in C.with_censoring(df).orderBy("standard_value").collect()] == ["lower_bound", "exact", "upper_bound", "exact"]
    assert C.with_censoring(df, "drop").count() == 2
    assert [r.activity_class for r in C.with_censoring(df, "label").orderBy("standard_value").collect()][:2] == ["inactive", "potent"]
    with pytest.raises(ValueError):
        C.with_censoring(df, "guess")


def test_null_rules(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,)], "x double")
    assert C.drop_nulls(df, ["x"]).count() == 2
    assert C.drop_nulls(df, ["x"], nan_too=True).count() == 1
    filled = [r.x for r in C.impute_median(df, ["x"]).collect()]
    assert filled == [1.0, 1.0, 1.0]
    assert df.where(P.finite_or_nan("x")).count() == 2
