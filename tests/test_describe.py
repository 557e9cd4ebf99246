"""Tables, quantiles and regressions against numpy."""

import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from wavespan import session
from wavespan.operators import describe, regress

N = None


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(4000):       # one group holds most rows, and one value a third of them
        year = 1990 if i % 10 else 1991
        x = 7.0 if i % 3 == 0 else float(rng.lognormal(1, 1))
        rows.append((i % 300, year, x if i % 17 else None, float(rng.normal()), "ab"[i % 2]))
    return spark.createDataFrame(rows, "pid int, year int, x double, z double, g string").cache()


def test_exact_percentiles(sample):
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    out = describe.exact_percentiles(sample, "x", points, names=list("abcdefg"))
    pdf = sample.toPandas()
    for row in out.collect():
        data = pdf.x[pdf.year == row["year"]].dropna()
        assert np.allclose(row[1:], np.quantile(data, points), rtol=1e-12)
    assert out.count() == 2


def test_exact_percentiles_null_group_and_single_row(frame):
    df = frame("year int, x double", [(N, 1.0), (N, 2.0), (1, 5.0), (2, N)])
    out = describe.exact_percentiles(df, "x", [0.5])
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 5.0), (N, 1.5)]


def test_exact_percentiles_of_values_of_all_sizes(frame):
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.normal(size=300), 10.0 ** rng.uniform(-320, 308, 200),
                           -(10.0 ** rng.uniform(-320, 308, 200)), [0.0, -0.0, 5e-324, -5e-324],
                           1 + np.arange(40) * 2.0 ** -52])
    df = frame("year int, x double", [(1, float(x)) for x in data])
    points = [0.0, 0.01, 0.3, 0.5, 0.51, 0.77, 0.999, 1.0]
    row = describe.exact_percentiles(df, "x", points, names=list("abcdefgh")).first()
    ordered = np.sort(data)
    for p, got in zip(points, row[1:]):
        h = (len(data) - 1) * p
        a, b = ordered[int(h)], ordered[min(int(h) + 1, len(data) - 1)]
        assert np.isclose(got, a + (b - a) * (h - int(h)), rtol=1e-9, atol=0)


def test_missing_group_has_its_own_box_and_level(frame):
    df = frame("year int, x double", [(N, 1.0), (N, 2.0), (1, 5.0)])
    box = {r["year"]: (r["q1"], r["median"], r["n"]) for r in describe.box_by_year(df, "x").collect()}
    assert box == {N: (1.25, 1.5, 2), 1: (5.0, 5.0, 1)}
    level = {r["year"]: r["median_value"] for r in describe.level_by_year(df, "x").collect()}
    assert level == {N: 1.5, 1: 5.0}


def test_several_values_share_the_passes(frame, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(y), float(a), None if b > 2 else float(b)) for y, a, b in zip(
        rng.integers(0, 3, 900), rng.normal(size=900) * 1e9, rng.normal(size=900))]
    df = frame("year int, a double, b double", rows + [(None, -0.0, None)])
    written = []
    monkeypatch.setattr(describe, "stored", lambda x: written.append(x) or session.stored(x))
    out = {(r.year, r.variable): tuple(r)[2:] for r in describe.exact_percentiles(
        df, ["a", "b"], [0.1, 0.5], names=["low", "mid"]).collect()}
    assert len(written) <= 5      # the rows, and a table for each pass of both
    assert len(out) == 7 and out[None, "a"] == (0.0, 0.0)
    for y in range(3):
        for i, name in ((1, "a"), (2, "b")):
            values = [r[i] for r in rows if r[0] == y and r[i] is not None]
            assert out[y, name] == pytest.approx(np.quantile(values, [0.1, 0.5]), rel=1e-12)


def test_one_pass_where_cells_suffice(frame, monkeypatch):
    written = []
    monkeypatch.setattr(describe, "stored", lambda x: written.append(x) or session.stored(x))
    df = frame("year int, x double", [(i % 3, i % 11 / 4) for i in range(500)])
    medians = {r.year: r.p50 for r in describe.exact_percentiles(df, "x", [0.5]).collect()}
    assert medians == {y: np.median([i % 11 / 4 for i in range(500) if i % 3 == y]) for y in range(3)}
    assert len(written) == 2      # the rows and one pass


def test_box(sample):
    pdf = sample.toPandas()
    for row in describe.box_by_year(sample, "x").collect():
        data = pdf.x[pdf.year == row["year"]].dropna().to_numpy()
        q1, median, q3 = np.quantile(data, [0.25, 0.5, 0.75])
        near = (data >= q1 - 1.5 * (q3 - q1)) & (data <= q3 + 1.5 * (q3 - q1))
        assert np.allclose([row["q1"], row["median"], row["q3"]], [q1, median, q3])
        assert (row["whisker_low"], row["whisker_high"]) == (data[near].min(), data[near].max())
        assert (row["outliers"], row["n"]) == ((~near).sum(), len(data))


def test_level_by_year_counts_missing_rows(frame):
    df = frame("year int, x double", [(1, 1.0), (1, 2.0), (1, N), (2, N)])
    assert values(describe.level_by_year(df, "x"), "mean_value", "median_value", "n_rows",
                  order=["year"]) == [(1.5, 1.5, 3), (N, N, 1)]


def test_describe_ignores_missing(frame):
    df = frame("a int, b double", [(1, N), (2, 4.0), (N, 6.0)])
    out = describe.describe(df, ["a", "b"]).collect()
    assert [tuple(r)[:3] for r in out] == [("a", 2, 1.5), ("b", 2, 5.0)]
    assert np.allclose([r["sd"] for r in out], [0.5 ** 0.5, 2 ** 0.5])


def test_shares_long_and_crosstab(frame):
    df = frame("pid int, year int, emp_status int, f boolean, g boolean", [
        (1, 1, 1, True, False), (2, 1, 1, False, False), (3, 1, 2, True, True), (4, 2, 1, N, True)])
    shares = describe.share_by_year(df, ["f", "g"])
    assert values(shares, "f", "g", order=["year"]) == [(0.5, 0.0), (N, 1.0)]
    long = describe.to_long(shares, ["year"], ["f", "g"])
    assert long.columns == ["year", "variable", "value"] and long.count() == 4
    table = describe.crosstab(df, "f", "g", [False, True])
    assert values(table, "f", "g_false", "g_true", order=["f"]) == [(False, 1, 0), (True, 1, 1)]
    pairs = describe.crosstab_long(df, "f", "g").collect()
    assert sorted(map(tuple, pairs)) == [(False, False, 1), (True, False, 1), (True, True, 1)]
    with pytest.raises(Exception, match="not listed"):
        describe.crosstab(df, "f", "g", [True]).collect()


def test_distributions(frame):
    df = frame("pid int, year int, s int", [(1, 1, 1), (1, 2, 3), (2, 1, N), (2, 2, 2), (3, 1, 3)])
    assert [tuple(r) for r in describe.count_distribution(df, "s").collect()] == [(3, 2)]
    assert sorted(tuple(r) for r in describe.count_of_counts(df).collect()) == [(1, 1), (2, 2)]
    h = describe.histogram(df, "s", 0, 4, 2, by=["pid"])
    assert sorted(tuple(r) for r in h.collect()) == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1)]


def design_matrix(pdf, terms, factors):
    columns, names = [np.ones(len(pdf))], ["(Intercept)"]
    for t in terms:
        columns.append(pdf[t].to_numpy())
        names.append(t)
    for f in factors:
        for level in sorted(pdf[f].astype(str).unique())[1:]:
            columns.append((pdf[f].astype(str) == level).to_numpy(float))
            names.append(f"{f}_{level}")
    return np.column_stack(columns), names


def test_ols_matches_numpy(sample):
    df = sample.withColumn("y", 2 * F.col("z") - 0.5 * F.col("x") + F.hash("pid", "x") / 2e9)
    out = {r["term"]: r for r in regress.ols(df, "y", ["x", "z"], ["year", "g"]).collect()}
    pdf = df.toPandas().dropna()
    design, names = design_matrix(pdf, ["x", "z"], ["year", "g"])
    assert set(out) == set(names)
    beta, *_ = np.linalg.lstsq(design, pdf.y.to_numpy(), rcond=None)
    residual = pdf.y.to_numpy() - design @ beta
    dof = len(pdf) - design.shape[1]
    errors = np.sqrt(residual @ residual / dof * np.diag(np.linalg.inv(design.T @ design)))
    for name, b, e in zip(names, beta, errors):
        assert np.allclose([out[name]["estimate"], out[name]["std_error"]], [b, e], rtol=1e-6, atol=1e-9)
        assert out[name]["n"] == len(pdf) and out[name]["dof"] == dof
    r2 = 1 - residual @ residual / ((pdf.y - pdf.y.mean()) ** 2).sum()
    assert np.isclose(out["x"]["r2"], r2)


def test_absorbed_factor_gives_the_same_slopes(sample):
    df = sample.withColumn("y", 2 * F.col("z") - 0.5 * F.col("x") + F.hash("pid", "x") / 2e9)
    full = {r["term"]: r for r in regress.ols(df, "y", ["x", "z"], ["year"]).collect()}
    for r in regress.within_ols(df, "y", ["x", "z"], "year").collect():
        for c in ("estimate", "std_error", "t_value", "r2"):
            assert np.isclose(r[c], full[r["term"]][c], rtol=1e-6)
        assert (r["n"], r["dof"]) == (full[r["term"]]["n"], full[r["term"]]["dof"])
    one = regress.within_slope(df, "y", "z", "year").first()
    assert np.isclose(one["slope"], regress.within_ols(df, "y", ["z"], "year").first()["estimate"])


def test_aliased_regressors_have_no_coefficient(sample):
    df = (sample.withColumn("x2", F.col("x") * 2 - 1).withColumn("one", F.lit(3.0))
          .withColumn("y", F.col("x") + F.col("z") + F.hash("pid") / 2e9))
    out = {r["term"]: r for r in regress.ols(df, "y", ["one", "x", "x2", "z"], ["g"]).collect()}
    plain = {r["term"]: r for r in regress.ols(df, "y", ["x", "z"], ["g"]).collect()}
    assert out["x2"]["estimate"] is None and out["one"]["estimate"] is None
    for term, row in plain.items():
        for c in ("estimate", "std_error", "p_value", "dof", "r2"):
            assert np.isclose(out[term][c], row[c], rtol=1e-8, atol=1e-12)


def test_regressions_without_freedom_or_rows(frame):
    df = frame("g string, y double, x double", [("a", 1.0, 1.0), ("a", 3.0, 2.0), ("b", N, 3.0)])
    for fit in (regress.ols(df, "y", ["x"]), regress.within_ols(df, "y", ["x"], "g")):
        row = {r["term"]: r for r in fit.collect()}["x"]
        assert np.isclose(row["estimate"], 2.0) and row["dof"] == 0 and row["std_error"] is None
    for fit in (regress.ols(df.limit(0), "y", ["x"], ["g"]),
                regress.within_ols(df.limit(0), "y", ["x"], "g")):
        assert [(r["term"], r["estimate"], r["n"]) for r in fit.collect()] == [("x", N, 0)]


def test_absorbed_regression_leaves_out_explained_terms(sample):
    df = sample.withColumn("x2", 2 * F.col("x")).withColumn("y", F.col("x") + F.hash("pid") / 2e9)
    out = {r["term"]: r for r in regress.within_ols(df, "y", ["x", "x2", "z"], "year").collect()}
    plain = {r["term"]: r for r in regress.within_ols(df, "y", ["x", "z"], "year").collect()}
    assert out["x2"]["estimate"] is None
    assert np.isclose(out["x"]["estimate"], plain["x"]["estimate"])


def test_too_many_levels_raise(spark):
    df = spark.range(2100).select(F.col("id").alias("g"), F.rand(1).alias("y"), F.rand(2).alias("x"))
    with pytest.raises(ValueError, match="levels"):
        regress.ols(df, "y", ["x"], ["g"])
