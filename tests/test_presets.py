"""End-to-end presets on a synthetic survey, invariants, partition independence."""

from dataclasses import replace

import pytest
from conftest import values
from pyspark.sql import functions as F

from wavespan.operators import dims
from wavespan.plans import presets
from wavespan.sources.keys import WAVES

YEARS = [y for y in WAVES if y <= 2015]


def draw(stream, n):
    return F.pmod(F.xxhash64(F.lit(stream), "pid", "year"), F.lit(n)).cast("int")


@pytest.fixture(scope="module")
def survey(spark):
    people = spark.range(1, 401).withColumnRenamed("id", "pid")
    waves = people.select("pid", F.explode(F.array(*[F.lit(y) for y in YEARS])).alias("year"))
    born = F.pmod(F.xxhash64("pid"), F.lit(60)) + 1915
    panel = waves.withColumns({
        "relation": F.when(F.col("year") < 1983, 1).otherwise(10), "sex": F.lit(1),
        "race": F.when(F.col("pid") % 4 == 0, 2).otherwise(1), "region": 1 + draw("r", 6),
        "age": (F.col("year") - born).cast("int"), "grades": draw("g", 18),
        "emp_status": F.when(draw("e", 10) < 8, 1).when(draw("e", 10) < 9, 2),
        "hours": F.when(draw("h", 40) > 0, 300 + draw("h", 40) * 60),
        "wage": F.round(3 + draw("w", 900) / 50, 2),
        "tenure": F.when(F.col("year") < 1976, draw("t", 6)).when(F.col("year") < 1994, draw("t", 130))
                   .otherwise(draw("t", 20)).cast("double"),
        "work_exp": draw("x", 40).cast("double"), "union_covered": draw("u", 2),
        "married": draw("m", 6),
    }).filter(draw("in", 5) > 0)
    return panel.cache()


@pytest.fixture(scope="module")
def short_survey(survey):
    return survey.withColumns({
        "occ3": draw("o", 4) * 10, "ind3": draw("i", 3) * 10,
        "modality": F.when(F.col("pid") % 29 == 0, 2).otherwise(1),
        "government": F.when(F.col("pid") % 31 == 0, 1).otherwise(5)})


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame([(y, 30.0 + 2.5 * (y - 1960)) for y in range(1960, 2018)],
                                 "year int, value double")


@pytest.fixture(scope="module")
def careers(short_survey, index):
    return presets.careers(presets.select_sample_short(short_survey, index)).cache()


def test_short_sample(short_survey, index):
    out = presets.select_sample_short(short_survey, index)
    assert out.count() > 500
    assert out.filter("race <> 1 or age not between 18 and 64 or region > 4 or year > 1993").count() == 0
    assert out.filter("hours <= 500 or wage_real is null or wage_real < 1").count() == 0
    assert out.filter("ever_government or ever_self_employed or ever_farm_army").count() == 0
    # the literal reading keeps persons with an unknown low-wage flag only; the index has all years
    assert presets.select_sample_short(short_survey, index, "as_coded").count() == 0
    gap = index.filter("year <> 1985")
    literal = presets.select_sample_short(short_survey, gap, "as_coded")
    assert 0 < literal.count() < out.count()
    assert literal.filter("low_wage is not null").count() == 0


def test_education_prefers_the_latest_usable_report(frame):
    df = frame("pid int, year int, grades int", [
        (1, 1968, 8), (1, 1975, 12), (1, 1985, 0), (2, 1968, 0), (3, 1985, 16), (3, 1968, 9)])
    assert values(presets.pick_education(df), "education") == [12, 12, 12, None, 16, 16]


def test_spell_invariants(careers):
    from pyspark.sql import Window
    w = Window.partitionBy("pid").orderBy("year")
    for spell in ("occ_spell", "ind_spell", "occ_spell_24t", "ind_spell_24t"):
        falls = careers.withColumn("before", F.lag(spell).over(w)).filter(F.col(spell) < F.col("before"))
        assert falls.count() == 0
    assert careers.filter("change_t and not change_24t").count() == 0
    assert careers.filter("year > 1980 and occ_change and not occ_change_unc").count() == 0
    assert careers.filter("emp_tenure < 0 or occ_exp < 0").count() == 0


def test_deviations_sum_to_zero(careers):
    for x, by in (("instr_emp", "emp_spell"), ("instr_occ", "occ_spell"), ("instr_oj", "emp_spell"),
                  ("instr_ind_24t", "ind_spell_24t")):
        sums = careers.groupBy("pid", by).agg(F.abs(F.sum(x)).alias("s"))
        assert sums.filter("s > 1e-6").count() == 0
    assert careers.filter("instr_emp is null").count() == 0


def test_result_does_not_depend_on_partitions(spark, short_survey, index):
    columns = ["pid", "year", "emp_spell", "occ_mode", "emp_tenure", "ind_exp_24t", "work_total"]

    def run(partitions, cut):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            sample = presets.select_sample_short(short_survey, index)
            return values(presets.careers(sample, cut=cut), *columns)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)

    one = run("1", False)
    assert len(one) > 300 and one == run("50", False) == run("4", True)


def test_literal_chain_differs(short_survey, index, careers):
    sample = presets.select_sample_short(short_survey, index)
    literal = presets.careers(sample, semantics="as_coded")
    assert literal.count() > 0
    assert literal.agg(F.max("emp_spell_24t")).first()[0] == 1
    assert careers.agg(F.max("emp_spell_24t")).first()[0] > 1


def test_models_and_table(careers):
    preset = replace(presets.SHORT)
    for model in presets.MODELS_SHORT:
        fit = presets.wage_regression(careers, preset, model)
        terms = {r["term"] for r in fit.collect()}
        assert set(presets.MODELS_SHORT[model][0]) <= terms and "region_2" in terms
        assert "region_1" not in terms and "(Intercept)" in terms
    table = presets.descriptive_table(careers, preset)
    rows = {r["variable"]: r for r in table.collect()}
    assert len(rows) == 10 and rows["age"]["n"] > 0 and 18 <= rows["age"]["mean"] <= 64


def test_hierarchies(spark, careers):
    occ = spark.createDataFrame([(10, "1", "1"), (20, "2 o 3", "2"), (77, None, None)],
                                "occ3 int, occ2 string, occ1 string")
    ind = spark.createDataFrame([(10, "5", "1"), (20, "6", "1"), (88, "7", "2")],
                                "ind3 int, ind2 string, ind1 string")
    n = careers.count()
    left = presets.attach_hierarchies(careers, occ, ind)
    assert left.count() == n
    right = presets.attach_hierarchies(careers, occ, ind, "as_coded")
    matched = careers.filter("occ3 in (10, 20) and ind3 in (10, 20)").count()
    # unused occupations have no industry either, so the second join drops them again
    assert right.count() == matched + 1
    assert right.filter("pid is null").select("ind3").first()[0] == 88


@pytest.fixture(scope="module")
def long_survey(survey):
    return survey.withColumns({
        "occ3_early": draw("o", 4) * 10, "occ3_late": draw("o", 4) * 100,
        "ind3_early": draw("i", 3) * 10, "ind3_late": draw("i", 3) * 100,
        "modality_early": F.lit(1), "modality_late": F.when(F.col("pid") % 29 == 0, 3).otherwise(1),
        "government_early": F.lit(5),
        "government_late": F.when(F.col("pid") % 31 == 0, 1).otherwise(5)})


def test_long_preset(spark, long_survey, index):
    occ = spark.createDataFrame(
        [("10", "100", "1010", "A", 0), ("20", "200", "1020", "B", 1), ("30", "300", "6005", "C", 2),
         ("10", "100", "1011", "A", 3), ("x", None, "9", "D", 4)],
        "code_1970 string, code_2000 string, code_common string, one_digit string, ord int")
    ind = spark.createDataFrame(
        [("10", "100", "71", "A", 0), ("20", "200", "0", "B", 1)],
        "code_1970 string, code_2000 string, code_common string, one_digit string, ord int")
    occ = occ.withColumn("code_common", F.col("code_common").cast("int"))
    ind = ind.withColumn("code_common", F.col("code_common").cast("int"))
    literal = presets.select_sample_long(long_survey, index, occ, ind, "as_coded")
    assert literal.filter("occ_common = 6005").count() > 0      # only the raw code is tested
    occ_open = occ.withColumn("code_common", F.when(F.col("code_common") == 6005, 1030)
                              .otherwise(F.col("code_common")))
    sample = presets.select_sample_long(long_survey, index, occ_open, ind).cache()
    assert sample.filter("year > 2015 or occ3 = 0 or ind_common = 0").count() == 0
    assert sample.filter("occ3 in (10, 100) and occ_common <> 1011").count() == 0
    assert sample.filter("year = 2003 and occ3 < 100").count() == 0
    assert sample.filter("short_hours").count() > 0             # flags, not row drops
    assert sample.select("married").distinct().count() == 2
    careers = presets.careers(sample, presets.LONG).cache()
    late = careers.filter("year > 1998 and occ_change and occ_spell > 1")
    assert late.count() > 0
    fit = presets.wage_regression(careers, presets.LONG, "instruments")
    assert {"instr_occ_24t", "year_2015"} <= {r["term"] for r in fit.collect()}
    levels = presets.wage_rows(careers, presets.LONG, "levels")
    assert levels.agg(F.max("year")).first()[0] <= 1993
    assert presets.descriptive_table(careers, presets.LONG).count() == 10
    unmatched = dims.unmatched_codes(sample, "ind3", "ind_common", hi=2001)
    assert [r[0] for r in unmatched.collect()] == [20]
