"""Correlation, trend, collinearity and projection.

Each works on sums over all rows; only k x k numbers reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from doseframe.functions.potency import nan_to_null, present
from doseframe.operators.joins import hot_split_join
from doseframe.operators.ordering import exact_sample, running_before
from doseframe.session import staged


FEW_VALUES = 100_000  # rows of a rank table that are broadcast: some 10 MB at most


class _PairSums:
    """Sums over the rows where both columns of a pair are present, all in one aggregate.

    Columns are shifted by a value near their mean, so that the sums do not cancel. Plain sums run
    many times faster than one `corr` per pair, and columns without gaps share theirs.
    """

    def __init__(self, cols: Sequence[str], pairs: Sequence[tuple[str, str]], centre: dict[str, float], gaps: dict[str, int]):
        self.cols, self.pairs, self.centre, self.gaps = list(cols), list(pairs), centre, gaps

    @classmethod
    def measured(cls, vals: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]]) -> "_PairSums":
        """With means and gap counts from a first pass."""
        row = vals.agg(*[
            f.alias(f"{s}{i}") for i, c in enumerate(cols)
            for s, f in (("m", F.avg(c)), ("g", F.count_if(F.col(c).isNull())))
        ]).first()
        centre = {c: row[f"m{i}"] if row[f"m{i}"] is not None and math.isfinite(row[f"m{i}"]) else 0.0 for i, c in enumerate(cols)}
        return cls(cols, pairs, centre, {c: row[f"g{i}"] for i, c in enumerate(cols)})

    def _name(self, kind: str, *cols: str) -> str:
        return "_".join([kind, *[str(self.cols.index(c)) for c in cols]])

    def aggregate(self, vals: DataFrame) -> DataFrame:
        shifted = vals.select(*[(F.col(c) - F.lit(self.centre[c])).alias(c) for c in self.cols])
        aggs = {}
        for c in self.cols:
            aggs[self._name("n", c)] = F.count(c)
            aggs[self._name("s", c)] = F.sum(c)
            aggs[self._name("q", c)] = F.sum(F.col(c) * F.col(c))
        for x, y in self.pairs:
            if x != y:
                aggs[self._name("p", x, y)] = F.sum(F.col(x) * F.col(y))
            for a, b in ((x, y), (y, x)):
                if a != b and self.gaps[b]:
                    where_b = F.when(F.col(b).isNotNull(), F.col(a))
                    aggs[self._name("n", a, b)] = F.count(where_b)
                    aggs[self._name("s", a, b)] = F.sum(where_b)
                    aggs[self._name("q", a, b)] = F.sum(where_b * where_b)
        return shifted.agg(*[v.alias(k) for k, v in aggs.items()])

    def _one(self, kind: str, a: str, b: str) -> Column:
        return F.col(self._name(kind, a, b) if a != b and self.gaps[b] else self._name(kind, a))

    def pair_rows(self, vals: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
        """(x, y, n, mean_x, mean_y, xx, yy, xy, r) per pair: centred sums, and Pearson's r, which is
        null without two different values on both sides. The arithmetic runs on one row per pair."""
        def product(x: str, y: str) -> Column:
            return F.col(self._name("q", x) if x == y else self._name("p", *((x, y) if (x, y) in self.pairs else (y, x))))

        rows = self.aggregate(vals).select(F.inline(F.array(*[
            F.struct(
                F.lit(x).alias("x"), F.lit(y).alias("y"), self._one("n", x, y).alias("n"),
                self._one("s", x, y).alias("sx"), self._one("s", y, x).alias("sy"),
                self._one("q", x, y).alias("qx"), self._one("q", y, x).alias("qy"), product(x, y).alias("p"),
                F.lit(float(self.centre[x])).alias("cx"), F.lit(float(self.centre[y])).alias("cy"),
            ) for x, y in pairs
        ])))
        n = F.col("n")
        centred = rows.select(
            "x", "y", "n",
            (F.try_divide("sx", n) + F.col("cx")).alias("mean_x"), (F.try_divide("sy", n) + F.col("cy")).alias("mean_y"),
            (F.col("qx") - F.try_divide(F.col("sx") * F.col("sx"), n)).alias("xx"),
            (F.col("qy") - F.try_divide(F.col("sy") * F.col("sy"), n)).alias("yy"),
            (F.col("p") - F.try_divide(F.col("sx") * F.col("sy"), n)).alias("xy"),
        )
        r = F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy"))
        return centred.withColumn(
            "r", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
        )


def _values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[nan_to_null(c).alias(c) for c in cols])


def _pair_table(vals: DataFrame, pairs: Sequence[tuple[str, str]], centre: dict[str, float]) -> DataFrame:
    """(pair, n, xx, yy, xy): centred sums over the rows where both columns of a pair are present.

    Beyond some hundred sums one aggregate is no longer compiled; here a batch is a matrix, a pair a few products of
    its columns, and a task gives one row per pair.
    """
    names = sorted({c for p in pairs for c in p})
    at = {c: k for k, c in enumerate(names)}
    shift = np.array([centre[c] for c in names])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pairs), 6))
        for batch in batches:
            # A null becomes NaN.
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift[:, None]
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            whole, square = there.all(axis=1), x * x
            for k, (a, b) in enumerate((at[p], at[q]) for p, q in pairs):
                u, v = x[a], x[b]
                if whole[a] and whole[b]:
                    part = len(u), u.sum(), v.sum(), square[a].sum(), square[b].sum(), u @ v
                else:
                    both = (there[a] & there[b]).astype(float)
                    part = both.sum(), u @ both, v @ both, square[a] @ both, square[b] @ both, u @ v
                total[k] += part
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(pairs)), pa.int32()), *[pa.array(total[:, c]) for c in range(6)]], ["pair", "n", "sx", "sy", "qx", "qy", "p"]
        )

    found = vals.select(*names).mapInArrow(sums, "pair int, n double, sx double, sy double, qx double, qy double, p double")
    n = F.col("n")
    return found.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "qx", "qy", "p")]).select(
        "pair", "n", (F.col("qx") - F.try_divide(F.col("sx") * F.col("sx"), n)).alias("xx"),
        (F.col("qy") - F.try_divide(F.col("sy") * F.col("sy"), n)).alias("yy"),
        (F.col("p") - F.try_divide(F.col("sx") * F.col("sy"), n)).alias("xy"),
    )


def _both_orders(table: DataFrame, pairs: Sequence[tuple[str, str]], least: Column) -> DataFrame:
    """(x, y, r) of a `_pair_table`, a pair of different columns in both orders; r is null where a side's squares do
    not exceed `least`."""
    names = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs])
    r = F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy"))
    fit = (F.col("xx") > least) & (F.col("yy") > least) & ~F.isnan("xx") & ~F.isnan("yy")
    rows = table.select(F.get(names, F.col("pair")).alias("c"), F.when(fit, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).alias("r"))
    back = F.struct(F.col("c.y").alias("x"), F.col("c.x").alias("y"), F.col("r"))
    there = F.struct(F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("r"))
    return rows.select(F.inline(F.when(F.col("c.x") == F.col("c.y"), F.array(there)).otherwise(F.array(there, back))))


def pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x, y, r) over all column pairs, each on the rows where both are present; null without two different values."""
    cols = list(cols)
    vals = staged(_values(df, cols).select(*[F.col(c).cast("double").alias(c) for c in cols]), "correlated")
    means = vals.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centre = {c: m if m is not None and math.isfinite(m) else 0.0 for c, m in zip(cols, means)}
    pairs = list(combinations_with_replacement(cols, 2))
    return _both_orders(_pair_table(vals, pairs, centre), pairs, F.lit(0.0))


class _Ranks:
    """Average ranks of every column in one long table (column, value): among all present values and, for every column
    with gaps, among the rows in which that column is present, too."""

    def __init__(self, vals: DataFrame, cols: Sequence[str]):
        self.cols = list(cols)
        # Adding 0.0 makes -0.0 and 0.0 one value; the narrow columns are written once and read by every pass.
        self.vals = staged(vals.select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in cols]), "rank-values")
        found = self.vals.agg(F.count("*").alias("n"), *[
            f.alias(f"{s}{i}") for i, c in enumerate(cols)
            for s, f in (("gaps", F.count_if(F.col(c).isNull())), ("varies", F.min(c) < F.max(c)))
        ]).first()
        self.rows = found["n"]
        self.gaps = [i for i in range(len(cols)) if found[f"gaps{i}"]]
        self.varies = [bool(found[f"varies{i}"]) for i in range(len(cols))]

    def _long(self) -> DataFrame:
        cell = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(self.cols)])
        # Bit b tells that column b is present.
        bits = reduce(lambda a, b: a.bitwiseOR(b), [
            F.when(F.col(self.cols[i]).isNotNull(), F.lit(1 << b)).otherwise(F.lit(0)) for b, i in enumerate(self.gaps)
        ], F.lit(0)).cast("long")
        return self.vals.select(bits.alias("bits"), F.inline(cell)).where(F.col("v").isNotNull())

    def table(self) -> DataFrame:
        """Rows of r<i> for column i and r<i>_<j> for column i among the rows with column j.

        The ranks of a column come back by its values: by broadcast where it has few of them, else through a shuffle in
        which hot values are parted and rows without a value are spread.
        """
        names = ["n", *[f"n{i}" for i in self.gaps]]
        counts = staged(self._long().groupBy("c", "v").agg(F.count("*").alias("n"), *[
            F.count_if(F.col("bits").bitwiseAND(F.lit(1 << b)) != 0).alias(f"n{i}") for b, i in enumerate(self.gaps)
        ]), "value-counts")
        ranks = staged(running_before(counts, "c", "v", names).select(
            "c", "v", "n", *[(F.col(f"before_{m}") + (F.col(m) + 1) / 2.0).alias(f"r_{m}") for m in names]
        ), "ranks")
        distinct = {r["c"]: r["count"] for r in ranks.groupBy("c").count().collect()}
        out = self.vals
        for i, c in enumerate(self.cols):
            own = ranks.where(F.col("c") == i).select(
                F.col("v").alias(c), "n", *[F.col(f"r_{m}").alias(f"r{i}" + (f"_{m[1:]}" if m != "n" else "")) for m in names]
            )
            if distinct.get(i, 0) <= FEW_VALUES:
                out = out.join(F.broadcast(own.drop("n")), c, "left").drop(c)
            else:
                out = hot_split_join(out, own, c, "left", "n").drop(c)
        return out

    def correlations(self) -> DataFrame:
        """(x, y, r) of all pairs of different columns, both orders, from one pass over the ranks."""
        middle = (self.rows + 1) / 2.0
        places = list(combinations(range(len(self.cols)), 2))
        ranked = [(f"r{i}_{j}" if j in self.gaps else f"r{i}", f"r{j}_{i}" if i in self.gaps else f"r{j}") for i, j in places]
        table = _pair_table(self.table(), ranked, {c: middle for p in ranked for c in p})
        # Two different ranks among n give squares of n * (n - 1) / 4 at least: less than half of that is rounding.
        least = F.col("n") * (F.col("n") - 1) / 8.0
        return _both_orders(table, [(self.cols[i], self.cols[j]) for i, j in places], least)


def spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x, y, r): Pearson on average ranks, ranked anew on the rows where both are present.

    All columns are ranked together in one long table, and all pairs come from one pass; no plan per pair.
    """
    ranks = _Ranks(_values(df, cols), cols)
    itself = df.sparkSession.createDataFrame(
        [(c, c, 1.0 if varies else None) for c, varies in zip(ranks.cols, ranks.varies)], "x string, y string, r double"
    )
    return ranks.correlations().unionByName(itself) if len(ranks.cols) > 1 else itself


def strength(r: Column) -> Column:
    return F.when(F.abs(r) > 0.5, "SILNA").when(F.abs(r) > 0.3, "UMIARKOWANA").otherwise("SŁABA")


def target_correlations(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """(feature, r, strength, direction, label): features by absolute correlation with the target."""
    features = [c for c in cols if c != target]
    vals = _values(df, [*features, target])
    sums = _PairSums.measured(vals, [*features, target], [(c, target) for c in features])
    direction = F.when(F.col("r") > 0, "↑ dodatnia").otherwise("↓ ujemna")
    return (
        sums.pair_rows(vals, sums.pairs).select(F.col("x").alias("feature"), "r")
        .withColumn("strength", strength(F.col("r")))
        .withColumn("direction", direction)
        .withColumn("label", F.format_string("%+.3f", "r"))
        .orderBy(F.desc(F.abs("r")), "feature")
    )


def strongest(correlations: DataFrame, k: int) -> DataFrame:
    return correlations.orderBy(F.desc(F.abs("r")), "feature").limit(k)


def correlation_summary(correlations: DataFrame) -> DataFrame:
    """Strongest positive and negative feature and the number in each strength class."""
    r, a = F.col("r"), F.abs("r")
    return correlations.agg(
        F.max_by("feature", F.when(r > 0, r)).alias("strongest_positive"),
        F.max(F.when(r > 0, r)).alias("strongest_positive_r"),
        F.min_by("feature", F.when(r < 0, r)).alias("strongest_negative"),
        F.min(F.when(r < 0, r)).alias("strongest_negative_r"),
        F.count_if(a > 0.5).alias("strong"),
        F.count_if((a > 0.3) & (a <= 0.5)).alias("moderate"),
        F.count_if(a <= 0.3).alias("weak"),
    )


def trends(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """(feature, slope, intercept, low, high, n): least squares of the target on each feature,
    on all rows where both are present."""
    vals = _values(df, [*cols, target])
    sums = _PairSums.measured(vals, [*cols, target], [(c, target) for c in cols])
    spans = vals.agg(*[
        f(F.when(F.col(target).isNotNull(), F.col(c))).alias(f"{s}{i}")
        for i, c in enumerate(cols) for s, f in (("l", F.min), ("h", F.max))
    ]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("x"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")) for i, c in enumerate(cols)
    ])))
    slope = F.try_divide("xy", "xx")
    fits = sums.pair_rows(vals, sums.pairs).join(F.broadcast(spans), "x")  # one row per feature
    return fits.select(
        F.col("x").alias("feature"), slope.alias("slope"),
        (F.col("mean_y") - slope * F.col("mean_x")).alias("intercept"), "low", "high", "n",
    )


def trend_lines(fits: DataFrame, points: int = 100) -> DataFrame:
    """(feature, point, x, y): evenly spaced points of each trend line."""
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / F.lit(points - 1.0)
    return (
        fits.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x)
        .select("feature", F.col("point").cast("bigint").alias("point"), "x",
                (F.col("intercept") + F.col("slope") * F.col("x")).alias("y"))
    )


def scatter_sample(df: DataFrame, cols: Sequence[str], keys: Sequence[str], cap: int, seed: int = 42) -> DataFrame:
    """At most `cap` complete rows of the chosen columns, for a plot."""
    complete = df.where(reduce(lambda a, b: a & b, [present(c) for c in cols]))
    return exact_sample(complete, cap, keys, seed).select(*keys, *[c for c in cols if c not in keys])


def _inflation(unit: np.ndarray, i: int) -> float:
    """1 / (1 - R2) of column i on the others, infinite where they give it exactly."""
    if not np.isfinite(unit).all():
        return float("nan")
    others = np.arange(len(unit)) != i
    left = 1.0 - unit[i, others] @ np.linalg.pinv(unit[np.ix_(others, others)], rcond=1e-12, hermitian=True) @ unit[others, i]
    return float(1.0 / left) if left > 1e-12 else float("inf")


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, vif, label) without intercept, from one pass of cross-product sums; collinear columns are infinite."""
    cols = list(cols)
    vals = df.select(*[nan_to_null(c).alias(c) for c in cols]).na.drop()
    k = len(cols)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    sums = vals.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}") for i, j in cells]).first()
    gram = np.zeros((k, k))
    for i, j in cells:
        gram[i, j] = gram[j, i] = np.nan if sums[f"g{i}_{j}"] is None else sums[f"g{i}_{j}"]
    scale = np.sqrt(np.diag(gram))
    # Unit diagonal first: columns may differ by many orders of magnitude.
    unit = gram / np.outer(scale, scale)
    rows = [(c, _inflation(unit, i)) for i, c in enumerate(cols)]
    found = df.sparkSession.createDataFrame(rows, "feature string, vif double")
    label = F.when(F.col("vif") > 10, "strong").when(F.col("vif") > 5, "moderate").otherwise("none")
    return found.withColumn("label", label).orderBy(F.desc("vif"), "feature")


def vif_summary(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count_if(F.col("vif") > 10).alias("high"),
        F.count_if((F.col("vif") > 5) & (F.col("vif") <= 10)).alias("moderate"),
    )


def standardized(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as (x - mean) / population std; a constant column becomes 0."""
    stats = df.agg(F.struct(*[
        f(c).alias(f"{s}{i}") for i, c in enumerate(cols) for s, f in (("m", F.avg), ("s", F.stddev_pop))
    ]).alias("st")).scalar()
    return df.withColumns({
        c: F.when(stats.getField(f"s{i}") == 0, F.lit(0.0)).otherwise(
            F.try_divide(F.col(c) - stats.getField(f"m{i}"), stats.getField(f"s{i}")))
        for i, c in enumerate(cols)
    })


def pca_scores(df: DataFrame, cols: Sequence[str], label: str, keys: Sequence[str] = (), k: int = 2) -> DataFrame:
    """Keys, label, PCA1..PCAk and the explained share of each component.

    Rows with a null are dropped; the first largest loading of a component is positive.
    """
    cols = list(cols)
    others = [c for c in (*keys, label) if c not in cols]
    complete = df.select(*others, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop(subset=[*cols, label])
    # Fixed numbers from here on: the fit and the projection use the same ones.
    m = complete.agg(*[f(c).alias(f"{s}{i}") for i, c in enumerate(cols) for s, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = [(F.col(c) - m[f"m{i}"]) / (m[f"s{i}"] or 1.0) for i, c in enumerate(cols)]
    scaled = complete.select(*[e.alias(c) for e, c in zip(z, cols)])
    model = PCA(k=k, inputCol="v", outputCol="p").fit(VectorAssembler(inputCols=cols, outputCol="v").transform(scaled))
    loadings = model.pc.toArray().copy()
    for j in range(k):
        size = np.abs(loadings[:, j])
        lead = int(np.argmax(size >= size.max() * (1 - 1e-6)))
        loadings[:, j] *= np.sign(loadings[lead, j]) or 1.0
    scores = [
        reduce(lambda a, b: a + b, [e * F.lit(float(loadings[i, j])) for i, e in enumerate(z)]).alias(f"PCA{j + 1}")
        for j in range(k)
    ]
    shares = [F.lit(float(v)).alias(f"explained{j + 1}") for j, v in enumerate(model.explainedVariance.toArray())]
    return complete.select(*keys, label, *scores, *shares)
