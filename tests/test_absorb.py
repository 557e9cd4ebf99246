import numpy as np
import pytest

from wavespan.operators import absorb, regress

N = None


def dummies(columns):
    return np.column_stack([np.equal.outer(np.array(c), sorted(set(c))).astype(float) for c in columns])


def by_hand(y, x, columns):
    """Coefficients, errors and degrees of freedom from the written-out dummies."""
    d = dummies(columns)
    design = np.column_stack([x, d])
    rank = np.linalg.matrix_rank(design)
    beta = np.linalg.pinv(design) @ y
    q, _ = np.linalg.qr(d @ np.linalg.svd(d.T @ d)[0][:, :np.linalg.matrix_rank(d)])
    xr = x - q @ (q.T @ x)
    rest = y - design @ beta
    dof = len(y) - rank
    errors = np.sqrt(np.diag(np.linalg.inv(xr.T @ xr)) * (rest @ rest) / dof)
    return beta[:x.shape[1]], errors, dof


def frame_of(spark, y, x, columns):
    names = ["y", *[f"x{i}" for i in range(x.shape[1])], *[f"f{i}" for i in range(len(columns))]]
    kinds = ["double"] * (1 + x.shape[1]) + ["string"] * len(columns)
    rows = [(float(a), *map(float, b), *map(str, c)) for a, b, c in zip(y, x, zip(*columns))]
    return spark.createDataFrame(rows, ", ".join(f"{a} {b}" for a, b in zip(names, kinds)))


@pytest.mark.parametrize("factors", [1, 2])
def test_equals_written_out_dummies(spark, factors):
    rng = np.random.default_rng(factors)
    n = 400
    # two parts that share no level, one level with half of the rows
    part = rng.integers(0, 2, n)
    columns = [np.where(rng.random(n) < 0.5, 0, rng.integers(0, 30, n)) + 100 * part,
               rng.integers(0, 12, n) + 100 * part][:factors]
    x = rng.normal(size=(n, 2)) + columns[0][:, None] * [0.01, 0.0]
    y = x @ [2.0, -1.0] + np.sin(columns[-1]) * 5 + 1000 + rng.normal(size=n)
    beta, errors, dof = by_hand(y, x, columns)
    df = frame_of(spark, y, x, columns)
    found = {r.term: r for r in absorb.absorbed_ols(
        df, "y", ["x0", "x1"], [f"f{i}" for i in range(factors)]).collect()}
    for i in range(2):
        r = found[f"x{i}"]
        assert r.estimate == pytest.approx(beta[i], rel=1e-9) and r.dof == dof and r.n == n
        assert r.std_error == pytest.approx(errors[i], rel=1e-8)
    same = {r.term: r for r in regress.ols(df, "y", ["x0", "x1"], ["f0", "f1"][:factors]).collect()}
    assert found["x0"].r2 == pytest.approx(same["x0"].r2, rel=1e-9)
    assert found["x1"].std_error == pytest.approx(same["x1"].std_error, rel=1e-8)


def test_three_factors_and_a_term_that_they_explain(spark):
    rng = np.random.default_rng(7)
    n = 500
    columns = [rng.integers(0, k, n) for k in (25, 9, 4)]
    x = np.column_stack([rng.normal(size=n), 3.0 * columns[1] - columns[2]])
    y = 1.5 * x[:, 0] + columns[0] + rng.normal(size=n)
    beta, errors, dof = by_hand(y, x[:, :1], columns)
    found = {r.term: r for r in absorb.absorbed_ols(
        frame_of(spark, y, x, columns), "y", ["x0", "x1"], ["f0", "f1", "f2"]).collect()}
    assert found["x0"].estimate == pytest.approx(beta[0], rel=1e-9) and found["x0"].dof == dof
    assert found["x0"].std_error == pytest.approx(errors[0], rel=1e-8)
    assert found["x1"].estimate is N


def test_more_levels_than_dummies_could_be_written_out_for(spark):
    rng = np.random.default_rng(3)
    n, levels = 60_000, 5_000
    columns = [rng.integers(0, levels, n), rng.integers(0, levels, n)]
    effects = rng.normal(size=(2, levels))
    x = rng.normal(size=(n, 1)) + effects[0][columns[0]][:, None]
    y = 0.75 * x[:, 0] + effects[0][columns[0]] - 2 * effects[1][columns[1]]
    df = frame_of(spark, y, x, columns)
    with pytest.raises(ValueError, match="absorbed_ols"):
        regress.ols(df, "y", ["x0"], ["f0", "f1"])
    r = absorb.absorbed_ols(df, "y", ["x0"], ["f0", "f1"]).first()
    assert r.estimate == pytest.approx(0.75, abs=1e-9) and r.n == n
    assert r.dof == n - 1 - (2 * levels - 1)


def test_missing_values_and_empty_input(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", "p"), (N, 1.0, "a", "p"), (2.0, 3.0, N, "p")],
                               "y double, x double, f string, g string")
    r = absorb.absorbed_ols(df, "y", ["x"], ["f", "g"]).first()
    assert (r.n, r.estimate) == (1, N)
    r = absorb.absorbed_ols(df.limit(0), "y", ["x"], ["f", "g"]).first()
    assert (r.n, r.estimate) == (0, N)
    with pytest.raises(ValueError):
        absorb.absorbed_ols(df, "y", ["x"], [])


def test_component_count(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)]
    star = [("hub", f"leaf{i}") for i in range(50)]
    edges = spark.createDataFrame([*chain, *star, ("own", "own"), *chain[:3]], "a string, b string")
    assert absorb.component_count(edges, "a", "b") == 3
    assert absorb.component_count(edges.limit(0), "a", "b") == 0
