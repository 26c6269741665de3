"""Array encodings, text forms of numbers, and config fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def one_hot(value: Column, categories: list) -> Column:
    """array<double> with 1 at the matching category; all zeros when none matches."""
    return F.array(*[F.coalesce((value == F.lit(c)).cast("double"), F.lit(0.0)) for c in categories])


def truncated_share(share: float, n: Column) -> Column:
    """int(share * n) for n >= 0."""
    return F.floor(F.lit(float(share)) * n)


def project(weights: list[list[float]], feats: Column, bias: list[float] | None = None) -> Column:
    """Matrix times vector: one output element per row of `weights`."""
    bias = bias or [0.0] * len(weights)
    rows = []
    for row, b in zip(weights, bias):
        terms = [F.lit(float(w)) * F.get(feats, F.lit(i)) for i, w in enumerate(row) if w]
        rows.append(sum(terms, F.lit(float(b))))
    return F.array(*rows)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shortest(x: Column) -> Column:
    """A positive double in exponent form with the fewest of 15, 16 or 17 digits that read back as the same number.

    Sixteen digits are tried with their neighbours too, as the JVM may round its own text and not the number.
    """
    tries = [F.format_string(f"%.{d}e", x) for d in (14, 15, 16)]
    digits = F.regexp_replace(F.substring_index(tries[1], "e", 1), r"\.", "").try_cast("bigint")
    near = [F.concat(F.regexp_replace((digits + d).cast("string"), r"^(\d)", "$1."), F.lit("e"), F.substring_index(tries[1], "e", -1)) for d in (-1, 1)]
    fits = F.lit(None).cast("string")
    for text in (*near, tries[1], tries[0]):
        fits = F.when(text.try_cast("double") == x, text).otherwise(fits)
    return F.coalesce(fits, tries[2])


def _number_parts(text: Column) -> Column:
    """Exponent form as struct(exponent, lead, tail), the tail without trailing zeros."""
    return F.struct(
        F.regexp_extract(text, r"e([+-]\d+)$", 1).try_cast("int").alias("exponent"),
        F.regexp_extract(text, r"^(\d)", 1).alias("lead"),
        F.regexp_extract(text, r"^\d\.(\d*?)0*e", 1).alias("tail"),
    )


def _python_style(n: Column) -> Column:
    exponent, lead, tail = n["exponent"], n["lead"], n["tail"]
    digits = F.concat(lead, tail)
    mantissa = F.concat_ws(".", lead, F.nullif(tail, F.lit("")))
    power = F.regexp_replace(F.abs(exponent).cast("string"), r"^(\d)$", "0$1")
    # Digits before and after the point of a plain number of 1 and more.
    padded = F.rpad(digits, F.greatest(exponent + 1, F.length(digits)), F.lit("0"))
    fraction = F.coalesce(F.nullif(F.substring(padded, exponent + 2, F.length(padded)), F.lit("")), F.lit("0"))
    return (
        F.when(exponent < -4, F.concat(mantissa, F.lit("e-"), power))
        .when(exponent >= 16, F.concat(mantissa, F.lit("e+"), power))
        .when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
        .otherwise(F.concat(F.substring(padded, F.lit(1), exponent + 1), F.lit("."), fraction))
    )


def python_float_text(x: Column) -> Column:
    """A double as Python's repr writes it (0.0003, 1e-05, 100.0); null for null."""
    x = x.cast("double")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    plain = _let(F.abs(x), lambda a: _let(_number_parts(_shortest(a)), _python_style))
    return (
        F.when(F.isnan(x), F.lit("NaN"))
        .when(F.abs(x) == F.lit(float("inf")), F.concat(sign, F.lit("Infinity")))
        .when(x.isNotNull(), F.concat(sign, plain))
    )


def canonical_json(fields: dict[str, tuple[Column, str]]) -> Column:
    """One-line JSON with sorted keys, ', ' and ': ' separators.

    `fields` maps a name to (column, kind); kind is 'text', 'int', 'float' or 'bool'.
    """
    parts = []
    for name in sorted(fields):
        column, kind = fields[name]
        if kind == "text":
            quoted = F.regexp_replace(F.regexp_replace(column, r"\\", r"\\\\"), '"', r'\\"')
            value = F.concat(F.lit('"'), quoted, F.lit('"'))
        elif kind == "float":
            value = python_float_text(column)
        else:
            value = column.cast("string")
        parts.append(F.concat(F.lit(f'"{name}": '), F.coalesce(value, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def config_key(fields: dict[str, tuple[Column, str]]) -> Column:
    """First 16 hex digits of the sha256 of the canonical JSON."""
    return F.substring(F.sha2(canonical_json(fields), 256), 1, 16)
