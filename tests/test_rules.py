import pytest

from wavespan.operators import dims, lookup, recode, rules

N = None


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), rules.SCHEMA)


def test_rules_in_order_by_kind_and_year(frame, table):
    df = frame("pid long, year int, relation int, a int, b int, x double, h double, w double, s string", [
        (1, 1975, 10, 1, 5, 24.0, 1.0, 2.0, "0"), (1, 1980, 20, 0, 6, 24.0, 1.0, 2.0, "x"),
        (1, 1990, 22, N, 7, N, N, 2.0, N), (1, N, 10, 1, 8, 12.0, 1.0, N, "y")])
    out = rules.apply_rules(df, table(
        (9, "x", "code", 1979, N, "2", "-1"), (1, "c", "era", N, 1979, "a", N),
        (2, "c", "era", 1980, 1989, "b", N), (3, "own", "role", N, N, "h", "w"),
        (4, "c", "code", N, N, "1", "100"), (5, "c", "code", N, N, "100", "7"),
        (6, "x", "unit", 1970, 1985, N, "12"), (7, "s", "code", N, N, "0", N),
        (8, "s", "code", 1990, 1990, N, "late")))
    assert out.columns == ["pid", "year", "relation", "x", "s", "c", "own"]
    assert sorted(map(tuple, out.drop("pid").collect()), key=str) == sorted([
        (1975, 10, 2.0, N, 7, 1.0), (1980, 20, -1.0, "x", 6, 2.0), (1990, 22, N, "late", N, 2.0),
        (N, 10, 12.0, "y", N, 1.0)], key=str)
    assert rules.apply_rules(df, table()).collect() == df.collect()


@pytest.mark.parametrize("row", [
    (1, "x", "guess", N, N, "1", N), (1, N, "code", N, N, "1", N), (N, "x", "code", N, N, "1", N),
    (1, "x", "unit", N, N, N, "0"), (1, "x", "era", N, N, N, N), (1, "x", "role", N, N, "h", N)])
def test_incomplete_rules_raise(table, row):
    with pytest.raises(ValueError):
        rules.rules(table(row))


def test_repeated_order_raises(table):
    with pytest.raises(ValueError, match="order"):
        rules.rules(table((1, "x", "code", N, N, "1", N), (1, "y", "code", N, N, "1", N)))


def test_conflict_report(table):
    report = rules.rule_conflicts(table(
        (1, "x", "code", N, 1980, "9", "0"), (2, "x", "code", 1975, N, "9", "1"),
        (3, "x", "code", 1981, N, "9", "0"), (4, "x", "code", N, N, "0", N),
        (5, "y", "code", N, N, N, N), (6, "y", "code", N, N, "3", "4"),
        (7, "e", "era", 1970, 1980, "a", N), (8, "e", "era", 1980, N, "b", N),
        (9, "e", "era", 1981, N, "b", N), (10, "u", "unit", 1, 5, N, "12"),
        (11, "u", "unit", 5, 9, N, "10"), (12, "u", "unit", 10, 11, N, "10")))
    found = {tuple(r) for r in report.collect()}
    assert found == {
        ("x", "code", 1, 2, 1975, 1980, "conflict"), ("x", "code", 2, 3, 1981, N, "conflict"),
        ("x", "code", 1, 4, N, 1980, "chained"), ("x", "code", 3, 4, 1981, N, "chained"),
        ("y", "code", 5, 6, N, N, "shadowed"), ("e", "era", 7, 8, 1980, 1980, "conflict"),
        ("e", "era", 8, 9, 1981, N, "repeated"), ("u", "unit", 10, 11, 5, 5, "conflict")}


def test_lookups_run_no_job_before_the_query(spark, frame):
    panel = frame("pid long, year long, wage double, code int", [(1, 1970, 2.0, 5), (2, N, 1.0, N)])
    index = frame("year int, value double", [(1970, 50.0), (1980, 100.0), (N, 1.0)])
    codes = frame("k string, v int, ord long", [("5", 50, 1), ("5", 51, 2), ("6", 60, 3)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "")
    df = recode.deflate(panel, index, "wage", "real", 1980)
    df = dims.harmonise_codes(df, "code", [(1960, 1980, codes, "k")], {"common": "v"})
    assert not tracker.getJobIdsForGroup("build")
    spark.sparkContext.setJobGroup("run", "")
    assert sorted((r.pid, r.real, r.common) for r in df.collect()) == [(1, 4.0, 51), (2, N, N)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_lookups_beyond_their_bound(frame):
    panel = frame("year int, wage double, code int", [(i, 1.0, i) for i in range(20)])
    index = frame("year int, value double", [(i, 1.0) for i in range(20)])
    with pytest.raises(Exception, match="more than 10 rows"):
        panel.join(lookup.bounded(index, 10), "year").collect()
    codes = frame("k string, v int, ord long", [(str(i), i, i) for i in range(20)])
    era = [(0, 20, codes, "k")]
    with pytest.raises(Exception, match="more than 10 rows"):
        dims.harmonise_codes(panel, "code", era, {"c": "v"}, most_codes=10).collect()
    whole = dims.harmonise_codes(panel, "code", era, {"c": "v"}, most_codes=None)
    assert sorted(r.c for r in whole.collect()) == list(range(20))
