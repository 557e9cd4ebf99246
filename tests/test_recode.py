"""Recodes, code tables and filters."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from wavespan.functions.na import is_one_of
from wavespan.operators import dims, filters, recode
from wavespan.operators.recode import Recode
from wavespan.plans import presets

N = None


def test_recode_rules_apply_in_order_and_by_era(frame):
    df = frame("pid int, year int, x int", [
        (1, 1975, 9), (1, 1976, 9), (1, 1977, 0), (1, 1978, 5), (1, 1979, N), (1, N, 9)])
    out = recode.recode(df, [Recode("x", (0,)), Recode("x", (9,), to=1, lo=1976),
                             Recode("x", N, lo=1978, hi=1978)])
    assert sorted(values(out, "year", "x"), key=str) == sorted(
        [(1975, 9), (1976, 1), (1977, N), (1978, N), (1979, N), (N, 9)], key=str)


def test_tenure_cleaning(frame):
    df = frame("pid int, year int, tenure int", [
        (1, 1970, 9), (1, 1975, 0), (1, 1976, 999), (1, 1977, 18), (1, 1978, 24), (1, 1993, 98),
        (1, 1994, 98), (1, 1995, 99), (1, 1996, 12)])
    assert values(presets.clean_tenure(df), "tenure") == [
        9.0, N, N, 1.5, N, 98 / 12, N, N, 12.0]


def test_role_collapse_and_blank(frame):
    df = frame("pid int, year int, relation int, h int, s int, u int", [
        (1, 1, 10, 1, 2, 3), (2, 1, 20, 1, 2, 3), (3, 1, 22, 1, N, 3), (4, 1, N, 1, 2, 3), (5, 1, 2, 1, 2, 3)])
    out = recode.role_blank(recode.role_collapse(df, {"x": ("h", "s")}), ["u"])
    assert values(out, "x", "u") == [(1, 3), (2, N), (N, N), (1, 3), (1, 3)]
    assert "h" not in out.columns and "s" not in out.columns


def test_era_coalesce_with_closed_era(frame):
    df = frame("pid int, year int, a int, b int", [(1, 2001, 1, 2), (1, 2003, 1, 2), (1, 2019, 1, 2)])
    out = recode.era_coalesce(df, {"x": ("a", "b", 2003)}, until=2017)
    assert values(out, "x") == [1, 2, 1] and out.columns == ["pid", "year", "x"]


def test_deflate(frame):
    df = frame("pid int, year int, w double", [(1, 1978, 10.0), (1, 1979, 10.0), (1, 1980, 10.0), (1, 1999, 1.0)])
    index = frame("year int, value double", [(1978, 50.0), (1979, 100.0), (1980, N)])
    assert values(recode.deflate(df, index, "w", "r", 1979), "r") == [20.0, 10.0, N, N]


def test_dummies_keep_missing(frame):
    df = frame("pid int, year int, x int", [(1, 1, 1), (1, 2, 5), (1, 3, N)])
    out = recode.dummy(recode.dummy(recode.flag_in(df, "f", "x", (1,)), "d", "x", 1), "e", "x", 1, True)
    assert values(out, "f", "d", "e") == [(1, 1, 0), (0, 0, 1), (0, N, N)]


def test_drop_matching_is_case_sensitive(frame):
    df = frame("`relation.head` int, xHead int, ySpouse int, z int", [(1, 2, 3, 4)])
    assert recode.drop_matching(df, "Head|Spouse", ["z"]).columns == ["relation.head"]
    assert recode.normalise_case(df).columns == ["RELATION.HEAD", "XHEAD", "YSPOUSE", "Z"]


@pytest.fixture(scope="module")
def crosswalk(frame):
    return frame("k string, k2 string, v int, ord int", [
        ("1", "7", 10, 0), ("1", "7", 20, 1), ("1", "8", 10, 2), ("2", "8", N, 3), ("x", "9", 5, 4),
        ("3", "9", 30, 5), ("3", "9", N, 6), (N, "9", 1, 7), ("4", "9", 0, 8)])


def test_last_match_counts_repeats_at_their_first_place(crosswalk):
    out = dims.last_match(crosswalk, ["k"], ["v"])
    assert sorted(map(tuple, out.collect())) == sorted(
        [("1", 20), ("2", N), ("3", N), ("4", 0), ("x", 5)], key=lambda r: r[0])


def test_last_match_tells_duplicates_by_unseen_columns(frame):
    table = frame("k int, v string, detail string, ord int",
                  [(1, "A", "x", 0), (1, "B", "y", 1), (1, "A", "z", 2)])
    assert [r["v"] for r in dims.last_match(table, ["k"], ["v"]).collect()] == ["B"]
    assert [r["v"] for r in dims.last_match(table, ["k"], ["v"], distinct_on=["detail"]).collect()
            ] == ["A"]


def test_harmonise_by_era(frame, crosswalk):
    df = frame("pid int, year int, code int", [
        (1, 1990, 1), (1, 1991, 2), (1, 1992, 9), (1, 1993, N), (1, 1994, 4), (1, 2002, 1),
        (1, 2003, 7), (1, 2004, 9)])
    out = dims.harmonise_codes(df, "code", [(1968, 2001, crosswalk, "k"), (2003, 2015, crosswalk, "k2")],
                               {"v": "v"}, zero_is_missing=["v"])
    assert values(out, "v") == [20, N, N, N, N, N, 20, N]
    assert [r["code"] for r in dims.unmatched_codes(out, "code", "v", lo=1968, hi=2001).collect()] == [2, 4, 9]


def test_code_joins(frame):
    df = frame("pid int, year int, code int", [(1, 1, 1), (1, 2, 5), (1, 3, N), (2, 1, 1)])
    codes = frame("k int, two string", [(1, "a"), (2, "b"), (3, "c")])
    left = dims.join_codes(df, codes, "code", "k")
    assert values(left, "pid", "code", "two") == [(1, 1, "a"), (1, 5, N), (1, N, N), (2, 1, "a")]
    right = dims.join_codes(df, codes, "code", "k", how="right").select("pid", "year", "code", "two")
    plain = df.join(codes, F.col("code") == F.col("k"), "right").select("pid", "year", "k", "two")
    assert sorted(map(tuple, right.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert [r["code"] for r in dims.code_difference(df, codes, "code", "k").collect()] == [5]


def test_exclude_persons_keeps_unknown_flags(frame):
    df = frame("pid int, year int, w double, g int", [
        (1, 1, 0.5, 5), (1, 2, 5.0, 5), (2, 1, N, N), (2, 2, 5.0, 5), (3, 1, 5.0, 1), (4, 1, 5.0, 5)])
    flags = {"low": (F.col("w") > 0) & (F.col("w") < 1), "gov": is_one_of("g", [1])}
    flagged = filters.person_flags(df, flags)
    assert values(flagged, "low") == [True, True, N, N, False, False]
    assert values(filters.exclude_persons(flagged, ["low", "gov"]), "pid") == [2, 2, 4]


def test_no_income_in_both_readings(frame):
    df = frame("pid int, year int, hours int, wage_real double, low_wage boolean", [
        (1, 1, 400, 5.0, False), (1, 2, N, 0.0, False), (2, 1, 501, N, N), (2, 2, 501, 2.0, N)])
    out = filters.work_flags(df)
    assert values(out, "short_hours", "no_income") == [(True, False), (N, True), (False, True), (False, False)]
    literal = filters.work_flags(df, semantics="as_coded")
    assert values(literal, "no_income") == [True, True, False, False]
    with pytest.raises(ValueError):
        filters.work_flags(df, semantics="other")


def test_designs(frame):
    df = frame("pid int, year int", [(1, 1995), (1, 1996), (1, 1997), (1, 1999), (2, 1995), (2, 1997),
                                     (2, 1999), (3, 1996)])
    waves = [1995, 1996, 1997, 1999]
    assert values(filters.design(df, balanced=waves), "pid") == [1] * 4
    assert values(filters.design(df, min_waves=3), "pid") == [1] * 4 + [2] * 3
    assert values(filters.design(df, min_consecutive=2), "pid") == [1] * 4
    assert values(filters.design(df, min_consecutive=2, waves=waves), "pid") == [1] * 4 + [2] * 3
    assert filters.design(df).count() == 8


def test_reliable_triples_and_censoring(frame):
    df = frame("pid int, year int, emp_status int, first_year int, occ_spell int, ind_spell int", [
        (1, 1, 1, 1981, 1, 1), (1, 2, 1, 1981, 2, 1), (1, 3, 1, 1981, N, 1), (2, 1, 1, 1979, 1, 1),
        (2, 2, N, 1979, 1, 1), (2, 3, 1, 1979, 1, 1), (3, 1, 1, 1990, N, 2)])
    assert values(filters.reliable_triples(df), "reliable") == [True] * 3 + [False] * 4
    assert values(filters.drop_left_censored(df), "pid", "year") == [(1, 2), (2, 1), (2, 2), (2, 3), (3, 1)]


def test_heads_by_era(frame):
    df = frame("pid int, year int, relation int, sequence int", [
        (1, 1968, 1, N), (2, 1982, 1, 1), (3, 1982, 10, 1), (4, 1983, 10, 20), (5, 1983, 10, 21),
        (6, 1983, 1, 1), (7, 1983, 10, 1)])
    assert values(filters.heads(df, "any"), "pid") == [1, 2, 4, 7]
    assert values(filters.heads(df, "current"), "pid") == [1, 2, 7]


def test_hot_person_is_reduced_before_the_shuffle(spark):
    raw = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("pid"),
        (1990 + F.col("id") % 5).cast("int").alias("year"), F.col("id").alias("k"),
        F.lit("unused").alias("text"))
    out = filters.one_row_per_wave(raw, ["k"]).select("pid", "year", "k")
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert "text" not in out._jdf.queryExecution().executedPlan().toString()
    expected = raw.groupBy("pid", "year").agg(F.min("k").alias("k"))
    assert out.exceptAll(expected).count() == 0 and expected.exceptAll(out).count() == 0
    assert out.filter("pid = 1").count() == 5
