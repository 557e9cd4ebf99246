"""Least squares on panel rows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.session import stored

ALIASED = 1e-11     # share of a regressor's variance below which the others explain it
MOST_LEVELS = 2_000     # dummies of one regression; their square matrix is solved on the driver

COEFFICIENTS = ("term string, estimate double, std_error double, t_value double, p_value double, "
                "n long, dof long, r2 double")


def ols(df: DataFrame, response: str, terms: Sequence[str], factors: Sequence[str] = ()
        ) -> DataFrame:
    """Linear regression with category dummies: one row per coefficient.

    Rows with a missing value in any variable are dropped. The reference level of a factor is its
    alphabetically first one. A regressor that the ones before it explain completely is aliased:
    its coefficient is NULL and it does not count as a parameter. Without degrees of freedom the
    errors are NULL, and without rows everything is.

    The rows are read once, into counts, means and covariances per combination of levels, which
    combine where the rows lie. From those come the sums per level and pair of levels; only they
    reach the driver, and more than ``MOST_LEVELS`` levels raise before they do (``absorbed_ols`` has
    no such limit and gives the terms' coefficients only). Generalised least
    squares without a correlation or variance structure has the same coefficients, so it is this
    function applied to demeaned regressors.
    """
    names, spark = [response, *terms], df.sparkSession
    rows = df.select(*[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(names)],
                     *[F.col(f).cast("string").alias(f"__f{i}") for i, f in enumerate(factors)]
                     ).dropna()
    groups = [f"__f{i}" for i in range(len(factors))]
    spots = range(len(names))
    pairs = list(itertools.combinations_with_replacement(spots, 2))
    cells = stored(rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("__n"), *[F.avg(f"__v{i}").alias(f"__m{i}") for i in spots],
        *[F.covar_pop(f"__v{i}", f"__v{j}").alias(f"__c{i}_{j}") for i, j in pairs]))
    n = F.col("__n")
    whole = cells.agg(F.sum(n).alias("n"), *[
        (F.sum(n * F.col(f"__m{i}")) / F.sum(n)).alias(f"m{i}") for i in spots],
        *[F.count_distinct(g).alias(f"levels{g}") for g in groups]).first()
    count = whole["n"] or 0
    levels = sum(whole[f"levels{g}"] for g in groups)
    if levels > MOST_LEVELS:
        raise ValueError(f"{levels} levels of {list(factors)}: more than {MOST_LEVELS}; absorbed_ols "
                         "takes them out without coefficients of their own")
    means = np.array([whole[f"m{i}"] or 0.0 for i in spots])
    off = [F.col(f"__m{i}") - F.lit(float(means[i])) for i in spots]
    sums = cells.agg(*[F.sum(n * (F.col(f"__c{i}_{j}") + off[i] * off[j])).alias(f"s{i}_{j}")
                       for i, j in pairs]).first()
    s = np.zeros((len(names), len(names)))
    for i, j in pairs:
        s[i, j] = s[j, i] = sums[f"s{i}_{j}"] or 0.0

    # dummies: shares as means, and products from the counts of levels and of pairs of levels
    shares, labels, cross = [], [], []
    for g, factor in zip(groups, factors):
        found = sorted(cells.groupBy(g).agg(F.sum(n).alias("n"), *[
            F.sum(n * off[i]).alias(f"o{i}") for i in spots]).collect(), key=lambda r: r[g])[1:]
        labels += [(g, r[g], f"{factor}_{r[g]}") for r in found]
        shares += [r["n"] for r in found]
        cross += [[r[f"o{i}"] for i in spots] for r in found]
    place = {(g, level): i for i, (g, level, _) in enumerate(labels)}
    shares = np.array(shares, dtype=float)
    both = np.diag(shares)
    for g, h in itertools.combinations(groups, 2):
        for r in cells.groupBy(g, h).agg(F.sum(n).alias("n")).collect():
            i, j = place.get((g, r[g])), place.get((h, r[h]))
            if i is not None and j is not None:
                both[i, j] = both[j, i] = r["n"]
    cross = np.array(cross, dtype=float).reshape(len(labels), len(names))
    s = np.block([[s, cross.T], [cross, both - np.outer(shares, shares) / max(count, 1)]])
    x_means = np.concatenate([means[1:], shares / max(count, 1)])
    shown = [*terms, *[label for _, _, label in labels]]
    return spark.createDataFrame(
        _coefficients(s, shown, count, 1, s[0, 0], (means[0], x_means)), COEFFICIENTS)


def _independent(s: np.ndarray) -> list[int]:
    """Positions of the regressors that the ones before do not explain, from centred products."""
    variance = np.diag(s)
    scale = np.sqrt(np.where(variance > 0, variance, 1.0))
    correlation = s / np.outer(scale, scale)
    kept: list[int] = []
    for i in np.flatnonzero(variance > 0):
        inner, cross = correlation[np.ix_(kept, kept)], correlation[i, kept]
        if not kept or 1 - cross @ np.linalg.solve(inner, cross) > ALIASED:
            kept.append(int(i))
    return kept


def _coefficients(s: np.ndarray, names: Sequence[str], n: int, absorbed: int, total: float,
                  means: tuple[float, np.ndarray] | None = None) -> list[tuple]:
    """Rows of ``COEFFICIENTS`` from centred products of response and regressors.

    ``absorbed`` counts the parameters taken out by centring. ``means`` of response and regressors
    add the intercept.
    """
    kept = _independent(s[1:, 1:])
    inverse = np.linalg.inv(s[1:, 1:][np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
    products = s[1:, 0][kept]
    beta = inverse @ products
    residual = s[0, 0] - beta @ products
    dof = n - absorbed - len(kept)
    variance = residual / dof if dof > 0 else None
    r2 = float(1 - residual / total) if total > 0 else None

    def row(name: str, estimate: float, spread: float) -> tuple:
        error = math.sqrt(max(variance * spread, 0.0)) if variance is not None else None
        t = float(estimate / error) if error else None
        p = _two_sided(t, dof) if t is not None else None
        return (name, float(estimate), error, t, p, n, dof, r2)

    found = {i: row(names[i], beta[k], inverse[k, k]) for k, i in enumerate(kept)}
    rows = [found.get(i, (name, None, None, None, None, n, dof, r2))
            for i, name in enumerate(names)]
    if means is not None and n:
        centre = means[1][kept]
        rows.append(row("(Intercept)", means[0] - beta @ centre, 1 / n + centre @ inverse @ centre))
    return rows


def _two_sided(t: float, dof: int) -> float:
    """Chance of a t value as far from 0: an incomplete beta integral, by continued fraction."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = (b, a, 1 - x) if swap else (a, b, x)
    c, d = 1.0, 1 / (1 - (p + q) * z / (p + 1))
    h = d
    for m in range(1, 500):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                     -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    found = front * h / p
    return 1 - found if swap else found


def within_moments(df: DataFrame, response: str, terms: Sequence[str], by: str) -> DataFrame:
    """Pooled within-group sums of squares and products, as one row.

    Removing the group means and regressing is the same as regressing with one dummy per group.
    The sums come from per-group covariances, which combine on the map side: no row is joined
    back to its group mean, and a group with a third of all rows is as good as any other.
    """
    names = [response, *terms]
    rows = df.select(by, *[F.col(v).cast("double").alias(v) for v in names]).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    per_group = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("__n"), F.avg(response).alias("__mean"),
        *[F.covar_pop(names[i], names[j]).alias(f"__c_{i}_{j}") for i, j in pairs])
    n = F.col("__n")
    return per_group.agg(
        F.sum(n).alias("n"), F.count(F.lit(1)).alias("groups"),
        (F.sum(n * F.col("__mean") * F.col("__mean"))
         - F.sum(n * F.col("__mean")) * F.sum(n * F.col("__mean")) / F.sum(n)).alias("between"),
        *[F.sum(n * F.col(f"__c_{i}_{j}")).alias(f"s_{i}_{j}") for i, j in pairs])


def within_slope(df: DataFrame, response: str, term: str, by: str, out: str = "slope"
                 ) -> DataFrame:
    """Slope of one regressor with the group dummies partialled out; stays a lazy plan."""
    m = within_moments(df, response, [term], by)
    return m.select((F.col("s_0_1") / F.col("s_1_1")).alias(out), "n", "groups")


def within_ols(df: DataFrame, response: str, terms: Sequence[str], by: str) -> DataFrame:
    """Regression with one factor absorbed: coefficient, standard error, t value, R2.

    Aliased regressors, missing degrees of freedom and empty input are treated as by ``ols``.
    """
    row = within_moments(df, response, terms, by).first()
    k = len(terms)
    s = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            s[i, j] = s[j, i] = row[f"s_{i}_{j}"] or 0.0
    rows = _coefficients(s, terms, int(row["n"] or 0), int(row["groups"]),
                         s[0, 0] + (row["between"] or 0.0))
    return df.sparkSession.createDataFrame(rows, COEFFICIENTS).drop("p_value")
