"""Potency label, unit handling and value predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from doseframe import schemas as S

INF = float("inf")
NAN = float("nan")

# Concentration units and their factor to nM.
UNIT_TO_NM = {"pM": 1e-3, "nM": 1.0, "uM": 1e3, "µM": 1e3, "mM": 1e6, "M": 1e9}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def neg_log10(x: str | Column) -> Column:
    """-log10 with IEEE results at and below zero, where Spark's log10 gives null."""
    x = _col(x).cast("double")
    return F.when(x > 0, -F.log10(x)).when(x == 0, F.lit(INF)).when(x < 0, F.lit(NAN))


def imputed_units(units: str = "standard_units", value: str = "standard_value") -> Column:
    """A missing unit becomes nM where the value lies in the usual nM range."""
    plausible = F.col(units).isNull() & F.col(value).between(S.IMPUTE_LOW, S.IMPUTE_HIGH)
    return F.when(plausible, F.lit(S.NANOMOLAR)).otherwise(F.col(units))


def pic50(
    value: str = "standard_value", units: str = "standard_units", ready: str = "pchembl_value"
) -> Column:
    """-log10 of the molar value for nM rows, else the ready-made value."""
    computable = (F.col(units) == S.NANOMOLAR) & F.col(value).isNotNull()
    return F.when(computable, neg_log10(F.col(value) * F.lit(1e-9))).otherwise(F.col(ready))


def is_infinite(x: str | Column) -> Column:
    return F.abs(_col(x)) == F.lit(INF)


def finite_or_nan(x: str | Column) -> Column:
    """Not null and not infinite; NaN passes."""
    return _col(x).isNotNull() & ~is_infinite(x)


def present(x: str | Column) -> Column:
    """Neither null nor NaN."""
    return _col(x).isNotNull() & ~F.isnan(_col(x).cast("double"))


def nan_to_null(x: str | Column) -> Column:
    return F.nanvl(_col(x).cast("double"), F.lit(None).cast("double"))


def value_in_nm(value: str = "standard_value", units: str = "standard_units") -> Column:
    """Concentration in nM; null for units that are no concentration."""
    factor = F.lit(None).cast("double")
    for unit, scale in UNIT_TO_NM.items():
        factor = F.when(F.col(units) == unit, F.lit(scale)).otherwise(factor)
    return F.col(value) * factor


def relation_or_equal(relation: str = "standard_relation") -> Column:
    return F.coalesce(F.col(relation), F.lit("="))


def censoring(relation: str = "standard_relation") -> Column:
    """'exact', 'lower_bound' (value is above) or 'upper_bound' (value is below)."""
    rel = relation_or_equal(relation)
    return (
        F.when(rel.isin(">", ">=", ">>"), F.lit("lower_bound"))
        .when(rel.isin("<", "<=", "<<"), F.lit("upper_bound"))
        .otherwise(F.lit("exact"))
    )


def potency_class(label: str = "pIC50") -> Column:
    return (
        F.when(F.col(label) > 8, F.lit("potent"))
        .when(F.col(label) > 6, F.lit("active"))
        .when(F.col(label).isNotNull(), F.lit("inactive"))
    )


def rule_flags(mw: str = "mw_freebase", logp: str = "alogp", hbd: str = "hbd", hba: str = "hba") -> dict[str, Column]:
    """The four drug-likeness flags; a null input gives a null flag."""
    return {
        "mw_violation": F.col(mw) > 500,
        "logp_violation": F.col(logp) > 5,
        "hbd_violation": F.col(hbd) > 5,
        "hba_violation": F.col(hba) > 10,
    }


def passes_strict_rule(mw: str = "mw_freebase", logp: str = "alogp", hbd: str = "hbd", hba: str = "hba") -> Column:
    return (F.col(mw) < 500) & (F.col(logp) < 5) & (F.col(hba) <= 10) & (F.col(hbd) <= 5)
