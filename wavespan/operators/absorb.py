"""Least squares with factors of any number of levels taken out.

The dummies of the factors are never written down. Rows become cells, one per combination of levels
met; the factor with the most levels goes by group means, and what the others explain beyond it is
found by conjugate gradients, whose every step is the same projection: spread level values over the
cells, take out the means of the first factor, add up by level. All variables step together.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.operators.regress import ALIASED, COEFFICIENTS, _coefficients
from wavespan.session import stored, unstore

TOLERANCE = 1e-9      # of the steps; the sums of products that they give are off by its square
MOST_STEPS = 2_000


def component_count(edges: DataFrame, a: str, b: str) -> int:
    """Number of connected parts of the graph that ``edges`` (two columns) spans.

    In each round a node moves to the least of itself and its neighbours, twice, where least goes by
    a hash, so that chains of moves are short; edges move along, until none joins different nodes.
    """
    def named(c: str):
        return F.concat(F.hex(F.xxhash64(c)), F.lit(":"), F.col(c))

    edges = stored(edges.select(named(a).alias("a"), named(b).alias("b")).distinct())
    parts = 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).toDF("node", "to"))
        twice = to.join(to.toDF("to", "end"), "to").select("node", "end")
        moved = edges.join(twice.toDF("a", "x"), "a").join(twice.toDF("b", "y"), "b").where("x <> y")
        moved = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                       .distinct())
        held = moved.select(F.explode(F.array("a", "b")).alias("end")).distinct()
        parts += twice.select("end").distinct().join(held, "end", "left_anti").count()
        unstore(edges, to)
        if not moved.take(1):
            unstore(moved)
            return parts
        edges = moved


def _sums(df: DataFrame, products: dict[str, object]) -> dict[str, float]:
    row = df.agg(*[F.sum(e).alias(name) for name, e in products.items()]).first()
    return {name: row[name] or 0.0 for name in products}


def _outer_project(cells: DataFrame, values: Sequence[str], first: str) -> DataFrame:
    """``cells`` with the weighted means of ``values`` by ``first`` taken out."""
    n = F.col("__n")
    means = cells.groupBy(first).agg(*[(F.sum(n * F.col(v)) / F.sum(n)).alias(f"__mean_{v}")
                                       for v in values])
    return cells.join(means, first).withColumns(
        {v: F.col(v) - F.col(f"__mean_{v}") for v in values}).drop(*[f"__mean_{v}" for v in values])


def _by_level(cells: DataFrame, values: Sequence[str], others: Sequence[str], *more) -> DataFrame:
    """(factor, level) with the weighted sums of ``values``."""
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("level"))
                                  for f in others])).alias("__e")
    rows = cells.select("__n", *values, entries)
    return rows.groupBy("__e.factor", "__e.level").agg(
        *[F.sum(F.col("__n") * F.col(v)).alias(v) for v in values], *more)


def absorbed_ols(df: DataFrame, response: str, terms: Sequence[str], factors: Sequence[str],
                 tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS) -> DataFrame:
    """Regression on ``terms`` beside one dummy per level of each factor: a row per term, the same
    as :func:`wavespan.operators.regress.ols` gives, for any number of levels.

    Rows with a missing value in any variable are dropped. A term that the factors explain, or the
    terms before it, is aliased: its coefficient is NULL. The absorbed parameters of one factor are
    its levels; of two, their levels less the connected parts of the graph of levels that meet; each
    further factor adds its levels less the parts of its graph with the first one, which may be too
    many by what three factors share. Of the levels only counts reach the driver. Steps that do not
    converge raise.
    """
    if not factors:
        raise ValueError("name at least one factor")
    names, spark = [response, *terms], df.sparkSession
    spots = range(len(names))
    pairs = list(itertools.combinations_with_replacement(spots, 2))
    groups = [f"__f{i}" for i in range(len(factors))]
    v = [f"__v{i}" for i in spots]
    n = F.col("__n")
    rows = df.select(*[F.col(x).cast("double").alias(v[i]) for i, x in enumerate(names)],
                     *[F.col(f).cast("string").alias(g) for f, g in zip(factors, groups)]).dropna()
    cells = stored(rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("__n"), *[F.avg(x).alias(x) for x in v],
        *[F.covar_pop(v[i], v[j]).alias(f"__c{i}_{j}") for i, j in pairs]))
    levels = cells.agg(*[F.count_distinct(g).alias(g) for g in groups]).first()
    groups.sort(key=lambda g: (-levels[g], g))
    first, others = groups[0], groups[1:]
    whole = _sums(cells, {"n": n, **{f"m{i}": n * F.col(v[i]) for i in spots}})
    count = int(whole["n"])
    centred = cells.withColumns({v[i]: F.col(v[i]) - F.lit(whole[f"m{i}"] / max(count, 1))
                                 for i in spots})

    def products(frame: DataFrame) -> np.ndarray:
        found = _sums(frame, {f"s{i}_{j}": n * (F.col(f"__c{i}_{j}") + F.col(v[i]) * F.col(v[j]))
                              for i, j in pairs})
        s = np.zeros((len(names), len(names)))
        for i, j in pairs:
            s[i, j] = s[j, i] = found[f"s{i}_{j}"]
        return s

    total = products(centred)
    within = stored(_outer_project(centred, v, first))
    s = products(within)
    absorbed = levels[first]
    if others and count:
        s -= _explained(within, v, first, others, tolerance, most_steps)
        absorbed += sum(levels[g] - component_count(
            cells.select(F.concat(F.lit("0:"), first).alias("a"), F.concat(F.lit("1:"), g).alias("b")),
            "a", "b") for g in others)
    gone = np.diag(s) <= ALIASED * np.diag(total)
    s[gone] = s[:, gone] = 0.0
    unstore(cells, within)
    return spark.createDataFrame(_coefficients(s, list(terms), count, absorbed, total[0, 0]),
                                 COEFFICIENTS)


def _explained(within: DataFrame, v: Sequence[str], first: str, others: Sequence[str],
               tolerance: float, most_steps: int) -> np.ndarray:
    """Products of the parts of the variables that ``others`` explain beyond ``first``.

    Solves S x = c for each variable: c its sums by level, S what the projection of level values
    sums to. Preconditioned by the rows of each level; c'x + x'(c - S x) is off by squares only.
    """
    spots = range(len(v))
    shape = stored(within.select(first, *others, "__n"))
    state = _by_level(within, v, others, F.sum("__n").alias("__size")).select(
        "factor", "level", "__size", *[F.col(v[i]).alias(f"c{i}") for i in spots],
        *[F.lit(0.0).alias(f"x{i}") for i in spots], *[F.col(v[i]).alias(f"r{i}") for i in spots],
        *[(F.col(v[i]) / F.col("__size")).alias(f"p{i}") for i in spots])
    kept = ["factor", "level", "__size", *[f"{a}{i}" for a in "cxrp" for i in spots]]
    state = stored(state)
    size = F.col("__size")
    rz = _sums(state, {f"z{i}": F.col(f"r{i}") ** 2 / size for i in spots})
    start = {i: rz[f"z{i}"] for i in spots}
    left = dict(start)
    for _ in range(most_steps):
        if all(left[i] <= tolerance ** 2 * start[i] for i in spots):
            break
        spread = shape
        for g in others:
            values = state.where(F.col("factor") == g).select(
                F.col("level").alias(g), *[F.col(f"p{i}").alias(f"{g}_p{i}") for i in spots])
            spread = spread.join(values, g)
        spread = spread.select(first, *others, "__n", *[
            sum((F.col(f"{g}_p{i}") for g in others), F.lit(0.0)).alias(f"q{i}") for i in spots])
        q = [f"q{i}" for i in spots]
        image = _by_level(_outer_project(spread, q, first), q, others)
        stepped = stored(state.join(image, ["factor", "level"]).select(*kept, *q))
        found = _sums(stepped, {
            **{f"pq{i}": F.col(f"p{i}") * F.col(f"q{i}") for i in spots},
            **{f"rz{i}": F.col(f"r{i}") ** 2 / size for i in spots},
            **{f"rq{i}": F.col(f"r{i}") * F.col(f"q{i}") / size for i in spots},
            **{f"qq{i}": F.col(f"q{i}") ** 2 / size for i in spots}})
        updates = {}
        for i in spots:
            done = left[i] <= tolerance ** 2 * start[i] or found[f"pq{i}"] <= 0
            a = 0.0 if done else found[f"rz{i}"] / found[f"pq{i}"]
            after = max(found[f"rz{i}"] - 2 * a * found[f"rq{i}"] + a * a * found[f"qq{i}"], 0.0)
            b = 0.0 if done or not found[f"rz{i}"] else after / found[f"rz{i}"]
            left[i] = 0.0 if done else after
            rest = F.col(f"r{i}") - F.lit(a) * F.col(f"q{i}")
            updates |= {f"x{i}": F.col(f"x{i}") + F.lit(a) * F.col(f"p{i}"), f"r{i}": rest,
                        f"p{i}": rest / size + F.lit(b) * F.col(f"p{i}")}
        before, state = state, stored(stepped.withColumns(updates).select(*kept))
        unstore(before, stepped)
    else:
        raise ArithmeticError(f"no convergence in {most_steps} steps")
    sums = _sums(state, {f"s{i}_{j}": F.col(f"c{i}") * F.col(f"x{j}") + F.col(f"x{i}") * F.col(f"r{j}")
                         for i in spots for j in spots})
    found = np.array([[sums[f"s{i}_{j}"] for j in spots] for i in spots])
    unstore(state, shape)
    return (found + found.T) / 2
