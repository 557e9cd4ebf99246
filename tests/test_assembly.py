"""Panel assembly, sources and formats."""

import pytest
import synthetic
from conftest import values
from pyspark.sql import functions as F

from wavespan.operators import assemble, filters
from wavespan.plans import series
from wavespan.sources import files, fixed_width, keys
from wavespan.sources.fixed_width import Field

N = None
FAMILY = {1985: {"money": "Money85", "age": "age85"}, 1986: {"money": "Money86", "age": "age86"}}
PERSON = {1985: {"weight": "ER30497"}, 1986: {"weight": "ER30534"}}


@pytest.fixture(scope="module")
def waves(spark):
    index, first, second = synthetic.synthetic_panel(synthetic.person_numbers(spark, 40), seed=3,
                                                     attrition=0.25)
    return index.cache(), {1985: first.cache(), 1986: second.cache()}


def test_key_variables():
    k = keys.key_variables(1985)
    assert (k.interview, k.sequence, k.relation, k.head_code, k.family_interview) == (
        "ER30463", "ER30464", "ER30465", 10, "V11102")
    k = keys.key_variables(1968)
    assert (k.sequence, k.relation, k.head_code, k.family_interview) == (None, "ER30003", 1, "V3")
    assert len(keys.WAVES) == len({k.family_interview for k in map(keys.key_variables, keys.WAVES)}) == 40
    assert keys.key_variables(2017).relation == "ER34503"


def test_synthetic_waves(waves):
    index, fam = waves
    assert index.count() == 80
    assert index.filter("ER30463 > 0").count() == 40 == fam[1985].count()
    assert fam[1986].count() == index.filter("ER30498 > 0").count() < 80
    assert index.select("ER30002").distinct().count() == 80
    assert index.groupBy("smpls").count().filter("count <> 20").count() == 0
    both = fam[1985].join(fam[1986], F.col("V11102") == F.col("V12502"))
    assert both.filter("age86 <> age85 + 1").count() == 0
    assert both.filter("abs(Money86 - Money85 - 500) > 200").count() == 0


def test_all_members(waves):
    index, fam = waves
    panel = assemble.build_panel(fam, index, FAMILY, PERSON, design="all")
    assert panel.count() == fam[1985].count() + fam[1986].count()
    assert panel.filter("pid <> id1968 * 1000 + pernum").count() == 0
    assert panel.filter("weight is null").count() == 0


@pytest.mark.parametrize("which", ["any", "current"])
def test_heads_only_is_balanced_by_default(waves, which):
    index, fam = waves
    panel = assemble.build_panel(fam, index, FAMILY, PERSON, heads=which)
    limit = 20 if which == "any" else 1
    assert panel.filter(f"relation <> 10 or sequence > {limit}").count() == 0
    assert panel.groupBy("pid").count().filter("count <> 2").count() == 0
    everyone = assemble.build_panel(fam, index, FAMILY, PERSON, heads=which, design="all")
    assert everyone.count() >= panel.count() > 0


def test_one_wave_and_missing_variable(waves):
    index, fam = waves
    one = assemble.build_panel({1985: fam[1985]}, index, {1985: {"age": "age85"}})
    assert one.count() == 40
    request = {1985: {"weight": "ER30497"}, 1986: {"weight": N}}
    panel = assemble.build_panel(fam, index, FAMILY, request, design="all")
    assert panel.filter("year = 1986 and weight is not null").count() == 0
    assert panel.filter("year = 1985 and weight is null").count() == 0


def test_household_without_an_answer_is_dropped(frame):
    fam = {1985: frame("V11102 long, a double, b double", [(1, N, 1.0), (2, 2.0, N)])}
    index = frame("er30001 long, er30002 long, er30463 long, er30464 int, er30465 int", [
        (1, 1, 1, 1, 10), (2, 1, 2, 1, 10), (3, 1, 2, 2, 20), (4, 1, 0, 0, 0), (5, 1, N, N, N)])
    panel = assemble.build_panel(fam, index, {1985: {"a": "A", "b": "B"}}, design="all")
    assert values(panel, "pid", "a", "b") == [(2001, 2.0, N), (3001, 2.0, N)]
    # the first *requested* variable decides
    panel = assemble.build_panel(fam, index, {1985: {"c": N, "b": "b"}}, design="all")
    assert values(panel, "pid", "b", "c") == [(1001, 1.0, N)]


def test_wealth_supplement(frame, waves):
    index, fam = waves
    wealth = {1985: fam[1985].select(F.col("V11102").alias("S900"), F.lit(7.0).alias("S917"))
              .filter("S900 % 2 = 0")}
    long = assemble.wealth_waves(wealth, {1985: {"assets": "s917"}}, keys={1985: "S900"})
    assert long.columns == ["year", "interview", "assets"] and long.filter("assets <> 7").count() == 0
    assert assemble.wealth_waves({}, {1985: {"assets": "s917"}}, keys={1985: "S900"}) is None


def test_subsamples(waves):
    index, fam = waves
    sizes = {s: assemble.build_panel(fam, index, FAMILY, sample=s, design="all").count()
             for s in filters.SUBSAMPLES}
    whole = assemble.build_panel(fam, index, FAMILY, design="all").count()
    assert sum(sizes.values()) == whole and min(sizes.values()) > 0


def test_union_waves_fills_missing(frame):
    a, b = frame("pid int, x int", [(1, 5)]), frame("pid int, y int", [(1, 6)])
    assert sorted(map(tuple, assemble.union_waves([a, b]).select("pid", "x", "y").collect()),
                  key=str) == [(1, 5, N), (1, N, 6)]


@pytest.fixture(scope="module")
def crosswalk(frame):
    return frame("TEXT string, Y1968 string, Y1969 string, Y1970 string, ord long", [
        ("job", "V1", "V11", "V21", 0), ("wage", "V2", N, "V22", 1), ("V21", "V3", "V13", "V11", 2),
        ("age", "V4", "V14", "V24", 3)])


def test_variable_names(frame, crosswalk):
    names = frame("name string", [("V22",), ("V11",), ("V21",), ("nope",)])
    out = assemble.variable_names(names, crosswalk, [1968, 1969, 1999])
    rows = sorted(map(tuple, out.collect()), key=str)
    # V11 stands in Y1969 of row 0 and in Y1970 of row 2: the leftmost column counts
    # V21 stands in TEXT of row 2 and in Y1970 of row 0
    assert rows == sorted([("V22", 1968, "V2"), ("V22", 1969, N), ("V11", 1968, "V1"),
                           ("V11", 1969, "V11"), ("V21", 1968, "V3"), ("V21", 1969, "V13")], key=str)
    assert assemble.variable_names(names, crosswalk).count() == 9
    assert assemble.crosswalk_years(crosswalk) == [1968, 1969, 1970]


def test_spliced_series_later_step_wins(frame, crosswalk):
    spec = frame("name string, seed string, lo int, hi int, step int", [
        ("s", "V1", 1968, 1970, 0), ("s", "V24", 1969, 1969, 1), ("t", "V2", 1968, 1970, 0)])
    out = assemble.spliced_series(spec, crosswalk)
    assert values(out, "name", "year", "variable", order=("name", "year")) == [
        ("s", 1968, "V1"), ("s", 1969, "V14"), ("s", 1970, "V21"),
        ("t", 1968, "V2"), ("t", 1969, N), ("t", 1970, "V22")]


def test_pivot_and_request(frame):
    long = frame("year int, name string, variable string", [
        (1985, "a", "V1"), (1985, "b", "V2"), (1986, "a", "V3")])
    wide = assemble.pivot_request(long, ["a", "b"])
    assert values(wide, "year", "a", "b") == [(1985, "V1", "V2"), (1986, "V3", N)]
    assert assemble.request_from_long(long) == {1985: {"a": "V1", "b": "V2"}, 1986: {"a": "V3"}}


LAYOUT = [Field("id", 1, 4), Field("name", 5, 3, "string"), Field("pay", 10, 6, "double", decimals=2)]


def test_fixed_width(frame, spark, tmp_path):
    lines = frame("value string", [("  12ab     1234",), ("   x     .  ",), ("0007c   ",)])
    out = fixed_width.parse_fixed_width(lines, LAYOUT)
    assert list(map(tuple, out.collect())) == [(12, "ab", 12.34), (N, N, N), (7, "c", N)]
    data = frame("id long, name string, pay double", [(5, "xyz", 0.5), (N, N, N)])
    path = str(tmp_path / "lines")
    fixed_width.format_fixed_width(data, LAYOUT).write.text(path)
    again = fixed_width.read_fixed_width(spark, path, LAYOUT)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, data.collect()), key=str)


NAMED = [Field("name", 1, 7, "string"), Field("a", 8, 3), Field("b", 11, 3)]


def test_fixed_width_of_one_byte_and_of_several(spark, frame, tmp_path):
    lines = [("José", 12, 34), ("Ÿves€", 5, N), ("Zoë Ñu", 6, 789), (N, N, 1)]
    (tmp_path / "latin.txt").write_bytes(b"Jos\xe9    12 34\r\nZo\xeb \xd1u   6789\n\n")
    latin = fixed_width.read_fixed_width(spark, str(tmp_path / "latin.txt"), NAMED, "latin-1", "byte")
    assert set(map(tuple, latin.collect())) == {lines[0], lines[2], (N, N, N)}
    data = frame("name string, a long, b long", lines)
    for i, (charset, unit) in enumerate([("cp1252", "byte"), ("cp1252", "char"), ("UTF-8", "char"),
                                         ("iso8859-15", "byte")]):
        path = str(tmp_path / str(i))
        fixed_width.write_fixed_width(data, path, NAMED, charset, unit)
        assert sorted(map(tuple, fixed_width.read_fixed_width(spark, path, NAMED, charset, unit).collect()),
                      key=str) == sorted(lines, key=str)
    # a byte layout of UTF-8: the wide characters use up the width of their own field only
    wide = [Field("name", 1, 10, "string"), Field("a", 11, 3), Field("b", 14, 3)]
    path = str(tmp_path / "wide")
    fixed_width.write_fixed_width(data, path, wide, "UTF-8", "byte")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "wide").glob("part-*")))
    assert {len(x) for x in raw.splitlines()} == {16}
    assert sorted(map(tuple, fixed_width.read_fixed_width(spark, path, wide, "UTF-8", "byte").collect()),
                  key=str) == sorted(lines, key=str)


def test_fixed_width_refuses_what_it_cannot_read_or_write(spark, frame, tmp_path):
    (tmp_path / "latin.txt").write_bytes(b"Jos\xe9    12 34\n")
    with pytest.raises(Exception, match="UTF"):
        fixed_width.read_fixed_width(spark, str(tmp_path / "latin.txt"), NAMED).collect()
    with pytest.raises(ValueError, match="single bytes"):
        fixed_width.read_fixed_width(spark, str(tmp_path / "latin.txt"), NAMED, "utf-16")
    for row in (("far too long", 1, 2), ("x", 1234, 2), ("日", 1, 2)):
        with pytest.raises(Exception, match="too wide|not in"):
            fixed_width.format_fixed_width(frame("name string, a long, b long", [row]), NAMED,
                                           charset="latin-1", unit="byte").collect()


def test_file_order_over_files_and_blocks(spark, tmp_path):
    rows = [f"V{i},{'x' * (i % 50)}" for i in range(20_000)]
    one, three = tmp_path / "one", tmp_path / "three"
    one.mkdir()
    three.mkdir()
    (one / "a.csv").write_text("\n".join(["Y1968,LABEL", *rows]) + "\n")
    for name, part in (("a.csv", rows[:7]), ("b.csv", []), ("c.csv", rows[7:15_000]), ("d.csv", rows[15_000:])):
        (three / name).write_text("\n".join(["Y1968,LABEL", *part]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        found = [files.crosswalk(spark, str(path)).orderBy("ord").collect() for path in (one, three)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for got in found:
        assert [r.ord for r in got] == list(range(20_000))
        assert [r.Y1968 for r in got] == [f"V{i}" for i in range(20_000)]


def test_panel_round_trip_prunes_years(frame, spark, tmp_path):
    panel = frame("pid long, year int, x double", [(p, y, float(p)) for p in range(9)
                                                   for y in (1990, 1991, 1992)])
    path = str(tmp_path / "panel")
    files.write_panel(panel, path)
    back = files.read_panel(spark, path, [1991])
    assert back.count() == 9
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().executedPlan().toString() \
        or "PartitionFilters: [year" in back._jdf.queryExecution().executedPlan().toString()


def test_csv_sources(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("OCC,TWO,ONE\n1,12,1\n201,20 o 31,2 o 3\n999,,\n")
    codes = files.code_hierarchy(spark, str(tmp_path / "codes.csv"), "OCC", "TWO", "ONE")
    assert list(map(tuple, codes.collect())) == [(1, "12", "1"), (201, "20 o 31", "2 o 3"), (999, N, N)]
    (tmp_path / "cpi.csv").write_text("DATE,value\n1978-01-01,65.2\n1979-01-01,72.6\n1980-01-01,.\n")
    index = files.price_index(spark, str(tmp_path / "cpi.csv"))
    assert list(map(tuple, index.collect())) == [(1978, 65.2), (1979, 72.6), (1980, N)]
    (tmp_path / "x.csv").write_text("1970,2000,ACS 2010-\n1,10,100\nn/a,20,200\n")
    census = files.census_crosswalk(spark, str(tmp_path / "x.csv"),
                                    {"1970": "code_1970", "ACS 2010-": "code_common"})
    assert list(map(tuple, census.collect())) == [("1", "100", 0), ("n/a", "200", 1)]
    (tmp_path / "vars.csv").write_text("year,name,variable\n1985,age,V1\n")
    assert files.variable_list(spark, str(tmp_path / "vars.csv")).dtypes[0] == ("year", "int")
    files.write_table(codes, str(tmp_path / "out"))
    assert files._csv(spark, str(tmp_path / "out")).count() == 3


def landing_zone(spark, root, waves):
    index, fam = waves
    for y, df in fam.items():
        df.write.parquet(f"{root}/fam/year={y}")
    index.limit(1).write.parquet(f"{root}/ind2008")
    index.write.parquet(f"{root}/ind2009")


def test_landing_zone_takes_the_last_index(spark, tmp_path, waves):
    root = str(tmp_path)
    landing_zone(spark, root, waves)
    assert files.person_index(spark, root).count() == 80
    assert files.wealth_waves(spark, root, [1985]) == {}
    family = spark.createDataFrame([(y, n, f"{v}{y - 1900}") for y in (1985, 1986)
                                    for n, v in (("money", "money"), ("age", "AGE"))],
                                   "year int, name string, variable string")
    person = spark.createDataFrame([(1985, "weight", "er30497"), (1986, "weight", N)],
                                   "year int, name string, variable string")
    panel = series.core_heads_panel(spark, root, family, person)
    assert panel.count() > 0
    assert panel.filter("relation <> 10 or id1968 >= 3000 or sequence > 20").count() == 0
    with pytest.raises(FileNotFoundError):
        files.person_index(spark, root, "nothing*")


def test_declared_series(frame, spark, tmp_path):
    seeds = [r.seed for r in series.household_specification(spark).collect()]
    seeds += [r.seed for r in series.person_specification(spark).collect()]
    years = (1974, 1975, 1976)
    rows = []
    for i, seed in enumerate(dict.fromkeys(seeds)):
        person = seed.startswith("ER300")
        rows.append((seed, *[(f"ER3{i:02d}{y % 100}" if person else f"W{i}_{y}") for y in years], i))
    crosswalk = frame("SEED string, Y1974 string, Y1975 string, Y1976 string, ord long", rows)
    family, person = series.declared_requests(crosswalk, years)
    order = list(dict.fromkeys(seeds))
    assert family[1974]["tenure_head"] == f"W{order.index('V642')}_1974"
    assert family[1976]["tenure_head"] == f"W{order.index('V200')}_1976"
    assert family[1975]["occ3_early_spouse"] == f"W{order.index('V243_A')}_1975"
    assert person[1975]["sex"] == "ER32000"
    # a two-person household in each wave: the spouse gets the spouse columns
    root = str(tmp_path)
    for y in years:
        key = keys.key_variables(y).family_interview
        names = list(dict.fromkeys(v for v in family[y].values() if v))
        columns = [F.lit(1).cast("long").alias(key)] + [F.lit(float(i)).alias(v)
                                                       for i, v in enumerate(names)]
        spark.range(1).select(*columns).write.parquet(f"{root}/fam/year={y}")
    index = {"ER30001": 4, "ER32000": 1}
    people = []
    for number, relation in ((1, 1), (2, 20)):
        row = dict(index, ER30002=number)
        for y in years:
            k = keys.key_variables(y)
            row |= {k.interview: 1, k.sequence: number, k.relation: relation}
            row |= {v: 9 for v in person[y].values() if v and v != "ER32000"}
        people.append(row)
    columns = list(people[0])
    spark.createDataFrame([tuple(r[c] for c in columns) for r in people], columns
                          ).write.parquet(f"{root}/ind")
    panel = series.survey_panel(spark, root, crosswalk, years)
    assert panel.count() == 6
    assert not [c for c in panel.columns if c.endswith(("_head", "_spouse"))]
    for name in ("hours", "wage", "emp_status", "tenure", "occ3_early", "work_exp", "sex", "age"):
        assert name in panel.columns
    rows = values(panel.filter("year = 1975"), "hours", "tenure", "union_member")
    at = {n: float(list(dict.fromkeys(v for v in family[1975].values() if v)).index(v))
          for n, v in family[1975].items() if v}
    assert rows == [(at["hours_head"], at["tenure_head"], at["union_member_head"]),
                    (at["hours_spouse"], at["tenure_head"], N)]
    literal = series.role_pairs("as_coded")
    assert literal["ind3_job3"] == ("ind3_job3_head", "ind3_job1_spouse")
    assert len(series.role_pairs()) == 31
    assert {"occ3", "ind3"} <= set(series.short_columns(panel).columns)


def test_one_scan_of_all_waves_equals_a_scan_a_wave(frame, spark, tmp_path):
    root = str(tmp_path / "land")
    frame("V3 int, V10 int, V20 string", [(1, 5, "7"), (2, N, "8"), (3, 6, " x ")]).write.parquet(
        f"{root}/fam/year=1968")
    frame("v442 long, v10 long, V30 double", [(1, 2**40, 0.5), (4, 9, N)]).write.parquet(f"{root}/fam/year=1969")
    frame("V1102 int, V40 float", [(7, 1.5)]).write.parquet(f"{root}/fam/year=1970")
    request = {1968: {"pay": "V10", "other": "V20"}, 1969: {"pay": "V10", "other": "V30"},
               1970: {"pay": None, "other": "V40"}}
    years, types = [1968, 1969, 1970], {"other": "double"}
    scan = files.family_scan(spark, root, years)
    one = assemble.household_waves(scan, request, types=types)
    waves = assemble.household_waves(files.family_waves(spark, root, years), request, types=types)
    assert one.dtypes == waves.dtypes
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, waves.collect()), key=str)
    assert {(1968, 1, 5, 7.0), (1968, 3, 6, N), (1969, 1, 2**40, 0.5), (1969, 4, 9, N), (1970, 7, N, 1.5)} == \
        set(map(tuple, one.collect()))
    assert one._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    # text in one wave, numbers in another: no common table
    frame("V1802 int, V10 string", [(1, "a")]).write.parquet(f"{root}/fam/year=1971")
    assert files.family_scan(spark, root, [*years, 1971]) is None


def test_chain_over_buckets_of_persons_shuffles_nothing(frame, spark, tmp_path):
    from wavespan.operators import change, spells
    panel = frame("pid long, year int, tenure double, emp_status int",
                  [(p, 1980 + y, float((p * y) % 4), 1) for p in range(60) for y in range(6)])
    files.write_bucketed(panel, "bucketed_careers", 4, str(tmp_path / "bucketed"))
    try:
        def chain(df):
            return spells.employer_spells(change.job_change(df))
        stored = chain(spark.table("bucketed_careers"))
        assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, stored.collect())) == sorted(map(str, chain(panel).select(*stored.columns).collect()))
    finally:
        spark.sql("drop table bucketed_careers")
