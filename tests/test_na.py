"""Missing-value helpers on small frames."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from wavespan.functions import na

N = None


@pytest.fixture(scope="module")
def flags(frame):
    return frame("pid int, year int, p boolean, x double", [
        (1, 1, True, 1.0), (1, 2, N, 2.0), (1, 3, False, N), (1, 4, False, 4.0),
        (2, 1, False, 1.0), (2, 2, N, 1.0), (3, 1, False, 5.0), (3, 3, False, 6.0)])


def test_unknown_condition_gives_null_not_else(flags):
    out = flags.select("pid", "year", na.na_ifelse(F.col("p"), F.lit(1), F.lit(0)).alias("v"))
    assert values(out, "v") == [1, N, 0, 0, 0, N, 0, 0]


def test_membership_is_never_null(flags):
    out = flags.select("pid", "year", na.is_one_of("x", [1.0, 4.0]).alias("v"))
    assert values(out, "v") == [True, False, False, True, True, True, False, False]


def test_any_has_three_values_in_both_forms(flags):
    w = na.whole(na.person_window())
    wide = flags.select("pid", "year", na.na_any(F.col("p"), w).alias("v"))
    assert values(wide, "v") == [True] * 4 + [N] * 2 + [False] * 2
    grouped = flags.groupBy("pid").agg(na.na_any_agg(F.col("p")).alias("v"))
    assert values(grouped, "v") == [True, N, False]


def test_missing_addend_poisons_the_rest_of_the_sum(flags):
    w = na.running(na.person_window())
    out = flags.select("pid", "year", na.na_cumsum(F.col("x"), w).alias("v"))
    assert values(out, "v") == [1.0, 3.0, N, N, 1.0, 2.0, 5.0, 11.0]


def test_mean_with_a_missing_member_is_null(flags):
    w = na.whole(na.person_window())
    out = flags.select("pid", "year", na.na_mean(F.col("x"), w).alias("v"))
    assert values(out, "v") == [N] * 4 + [1.0] * 2 + [5.5] * 2


def test_subset_lag_sees_members_only_and_keeps_null_members(frame):
    df = frame("pid int, year int, m boolean, x double", [
        (1, 1, True, 1.0), (1, 2, False, 2.0), (1, 3, True, N), (1, 4, N, 9.0), (1, 5, True, 5.0)])
    w = na.person_window()
    out = df.select("pid", "year", na.subset_lag("x", F.col("m"), w).alias("v"))
    # the row after the NULL member sees NULL, not the value before it
    assert values(out, "v") == [N, 1.0, 1.0, N, N]


def test_subset_lag_equals_lag_on_the_filtered_rows(frame):
    df = frame("pid int, year int, m boolean, x double", [
        (p, y, (p * 7 + y * 3) % 4 != 0, float((p * 5 + y) % 6)) for p in range(6) for y in range(9)])
    w = na.person_window()
    ours = df.withColumn("v", na.subset_lag("x", F.col("m"), w)).filter("m").select("pid", "year", "v")
    filtered = df.filter("m").withColumn("v", F.lag("x").over(w)).select("pid", "year", "v")
    assert values(ours, "pid", "year", "v") == values(filtered, "pid", "year", "v")


def test_subset_min_of_nothing_is_null(flags):
    out = flags.select("pid", "year",
                       na.first_year_where(F.col("x") > 4, na.person_window()).alias("v"))
    assert values(out, "v") == [N] * 6 + [1, 1]


def test_subset_cumsum_ignores_outsiders(frame):
    df = frame("pid int, year int, m boolean, x double", [
        (1, 1, True, 1.0), (1, 2, False, N), (1, 3, True, 2.0), (1, 4, True, N), (1, 5, True, 1.0)])
    out = df.select("pid", "year", na.subset_cumsum(F.col("x"), F.col("m"), na.person_window())
                    .alias("v"))
    assert values(out, "v") == [1.0, 1.0, 3.0, N, N]


def test_value_at_a_missing_wave_is_null(flags):
    out = flags.select("pid", "year", na.value_at("x", 4, na.person_window()).alias("v"))
    assert values(out, "v") == [4.0] * 4 + [N] * 4


def test_null_keys_form_one_group(frame):
    df = frame("pid int, year int, x double", [(N, 1, 1.0), (N, 2, 2.0), (1, 1, 5.0)])
    out = df.select("year", na.na_mean(F.col("x"), na.whole(na.person_window())).alias("v"))
    assert sorted(r["v"] for r in out.collect()) == [1.5, 1.5, 5.0]


def test_text_to_number_never_throws(frame):
    texts = ["12", "n/a", N, "3.5", "", " 7 ", "-.5", "1e3", "1d", ".", "+4"]
    out = frame("a string", [(t,) for t in texts]).select(
        na.to_number("a").alias("v"), na.to_number("a", "int").alias("i"))
    assert [r["v"] for r in out.collect()] == [12.0, N, N, 3.5, N, 7.0, -0.5, 1000.0, N, N, 4.0]
    assert [r["i"] for r in out.collect()] == [12, N, N, N, N, 7, N, N, N, N, 4]


def test_first_valid_skips_zero_and_missing(frame):
    out = frame("a int, b int, c int", [(0, N, 3), (5, 1, 1), (N, 0, 0)]).select(
        na.first_valid(["a", "b", "c"]).alias("v"))
    assert [r["v"] for r in out.collect()] == [3, 5, N]
