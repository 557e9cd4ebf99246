"""Panel assembly: waves of household files plus a cross-wave person index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavespan.functions.na import to_number
from wavespan.operators import filters
from wavespan.operators.recode import normalise_case, person_id
from wavespan.sources.keys import HOUSEHOLD_ID, PERSON_NUMBER, WEALTH_KEYS, key_variables

Request = Mapping[int, Mapping[str, str | None]]   # year -> output name -> raw name or None


def request_from_long(mapping: DataFrame) -> dict[int, dict[str, str | None]]:
    """Request from a (year, name, variable) table. It is metadata: variables times waves."""
    request: dict[int, dict[str, str | None]] = {}
    for r in mapping.select("year", "name", "variable").orderBy("year", "name").collect():
        request.setdefault(r["year"], {})[r["name"]] = r["variable"]
    return request


def _outputs(request: Request) -> list[str]:
    return list(dict.fromkeys(name for names in request.values() for name in names))


def union_waves(waves: Sequence[DataFrame]) -> DataFrame:
    """Stack waves by column name; variables a wave lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), waves)


def common_type(kinds: Sequence[str]) -> str:
    """The type of a variable over all waves: of mixed ones the widest number, or text."""
    kinds = set(kinds)
    if len(kinds) <= 1:
        return next(iter(kinds), "double")
    if kinds <= {"tinyint", "smallint", "int", "bigint"}:
        return "bigint"
    if all(k in NUMBERS or k.startswith("decimal") for k in kinds):
        return "double"
    return "string"


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def output_types(waves: Mapping[int, DataFrame], request: Request,
                 types: Mapping[str, str] | None = None) -> dict[str, str]:
    """Type of each requested variable: the one asked for, or that of its sources."""
    found: dict[str, list[str]] = {}
    for year, names in request.items():
        kinds = {c.lower(): kind for c, kind in waves[year].dtypes}
        for out, raw in names.items():
            if raw is not None:
                found.setdefault(out, []).append(kinds[raw.lower()])
    return {out: (types or {}).get(out) or common_type(found.get(out, []))
            for out in _outputs(request)}


def converted(source: Column, kind: str, to: str) -> Column:
    """``source``, of type ``kind``, as ``to``; text that is no number becomes NULL."""
    if kind == "string" and (to in NUMBERS or to == "long"):
        return to_number(source, to)
    return source.cast(to)


def harmonise_wave(wave: DataFrame, year: int, names: Mapping[str, str | None], key: str,
                   outputs: Sequence[str], types: Mapping[str, str] | None = None) -> DataFrame:
    """Select and rename one wave's variables; requested but absent ones become NULL.

    A variable keeps the type of its source unless ``types`` asks for another.
    """
    lower = normalise_case(wave, upper=False)
    kinds, types = dict(lower.dtypes), types or {}
    columns = []
    for out in outputs:
        raw = names.get(out)
        if raw is None:
            column = F.lit(None).cast(types.get(out, "double"))
        else:
            kind = kinds[raw.lower()]
            column = converted(F.col(raw.lower()), kind, types.get(out, kind))
        columns.append(column.alias(out))
    interview = converted(F.col(key.lower()), kinds[key.lower()], "long")
    return lower.select(F.lit(year).alias("year"), interview.alias("interview"), *columns)


def household_scan(scan: DataFrame, request: Request, keys: Mapping[int, str] | None = None,
                   types: Mapping[str, str] | None = None) -> DataFrame:
    """:func:`household_waves` over one table of all waves, which has a column ``year``: one scan,
    whose every variable is picked from that of the row's wave."""
    lower = normalise_case(scan, upper=False)
    kinds = dict(lower.dtypes)

    def by_wave(sources: dict[int, str], to: str) -> Column:
        value = F.lit(None).cast(to)
        for year, raw in sources.items():
            value = F.when(F.col("year") == year, converted(F.col(raw), kinds[raw], to)).otherwise(value)
        return value

    columns, answered = [], F.lit(False)
    for out in _outputs(request):
        raws = {y: n[out].lower() for y, n in request.items() if n.get(out) is not None}
        kind = (types or {}).get(out) or common_type([kinds[r] for r in raws.values()])
        columns.append(by_wave(raws, kind).alias(out))
    interviews = {y: (keys[y] if keys else key_variables(y).family_interview).lower() for y in request}
    for year, names in request.items():
        first = next((out for out in names if names[out] is not None), None)
        given = F.lit(True) if first is None else F.col(first).isNotNull()
        answered = answered | ((F.col("year") == year) & given)
    rows = lower.filter(F.col("year").isin(*request)).select(
        F.col("year").cast("int").alias("year"), by_wave(interviews, "long").alias("interview"), *columns)
    return rows.filter(answered)


def household_waves(family: Mapping[int, DataFrame] | DataFrame, request: Request,
                    keys: Mapping[int, str] | None = None,
                    types: Mapping[str, str] | None = None) -> DataFrame:
    """All household waves in one long table, without the households that did not respond.

    A household that did not respond has no value in the first requested variable, in the order
    of the request, that its wave has. ``family`` maps years to waves, each with a schema of its
    own, or is one table of all waves.
    """
    if isinstance(family, DataFrame):
        return household_scan(family, request, keys, types)
    outputs = _outputs(request)
    types = output_types(family, request, types)
    waves = []
    for year, names in request.items():
        key = keys[year] if keys else key_variables(year).family_interview
        wave = harmonise_wave(family[year], year, names, key, outputs, types)
        answered = next((out for out in names if names[out] is not None), None)
        waves.append(wave if answered is None else wave.filter(F.col(answered).isNotNull()))
    return union_waves(waves)


def person_waves(index: DataFrame, years: Sequence[int], request: Request | None = None,
                 sample: str | None = None, heads: str | None = None,
                 types: Mapping[str, str] | None = None) -> DataFrame:
    """The wide person index as one row per person and wave, from a single scan.

    Persons without an interview in a wave (number 0 or missing) cannot belong to a household
    and are left out before anything is shuffled.
    """
    index = normalise_case(index, upper=True)
    request = {y: n for y, n in (request or {}).items() if y in years}
    outputs, kinds = _outputs(request), dict(index.dtypes)
    types = output_types({y: index for y in request}, request, types)

    def cell(raw: str | None, kind: str, name: str) -> Column:
        if raw is None:
            return F.lit(None).cast(kind).alias(name)
        return converted(F.col(raw.upper()), kinds[raw.upper()], kind).alias(name)

    waves = []
    for year in years:
        key = key_variables(year)
        names = request.get(year, {})
        waves.append(F.struct(
            F.lit(year).alias("year"),
            cell(key.interview, "long", "interview"),
            cell(key.sequence, "int", "sequence"),
            cell(key.relation, "int", "relation"),
            *[cell(names.get(out), types[out], out) for out in outputs],
        ))
    base = filters.subsample(
        index.withColumns({out: converted(F.col(c), kinds[c], "long") for out, c in (
            ("id1968", HOUSEHOLD_ID), ("pernum", PERSON_NUMBER))}), sample)
    long = base.select("id1968", "pernum", F.inline(F.array(*waves)))
    present = long.filter(F.col("interview") != 0)
    return person_id(filters.heads(present, heads))


def wealth_waves(wealth: Mapping[int, DataFrame], request: Request,
                 keys: Mapping[int, str] | None = None,
                 types: Mapping[str, str] | None = None) -> DataFrame | None:
    """Supplement waves in one long table; only the years that have one."""
    keys = keys or WEALTH_KEYS
    outputs = _outputs(request)
    request = {y: names for y, names in request.items() if y in wealth}
    types = output_types(wealth, request, types)
    waves = [harmonise_wave(wealth[y], y, names, keys[y], outputs, types)
             for y, names in request.items()]
    return union_waves(waves) if waves else None


def build_panel(family: Mapping[int, DataFrame] | DataFrame, index: DataFrame, family_request: Request,
                index_request: Request | None = None,
                wealth: Mapping[int, DataFrame] | None = None,
                wealth_request: Request | None = None, sample: str | None = None,
                heads: str | None = None, design: str | int | None = "balanced",
                types: Mapping[str, str] | None = None) -> DataFrame:
    """Person x wave panel from household waves, the person index and wealth supplements.

    ``heads`` is None, ``"any"`` or ``"current"``; ``design`` is ``"balanced"``, ``"all"`` or the
    minimum number of waves. The waves are stacked first and joined once on (year, interview),
    the wealth supplement at household level, before members multiply the rows. Households join
    by their measured size, or by sort-merge with skew splitting.
    """
    years = list(family_request)
    households = household_waves(family, family_request, types=types)
    if wealth and wealth_request:
        supplement = wealth_waves(wealth, wealth_request, types=types)
        if supplement is not None:
            households = households.join(supplement, ["year", "interview"], "left")
    members = person_waves(index, years, index_request, sample, heads, types)
    panel = households.join(members, ["year", "interview"], "inner")
    if design == "balanced":
        return filters.design(panel, balanced=years)
    if isinstance(design, int):
        return filters.design(panel, min_waves=design)
    if design in ("all", None):
        return panel
    raise ValueError("design must be 'balanced', 'all' or a number of waves")


def pivot_request(long: DataFrame, names: Sequence[str], year: str = "year", name: str = "name",
                  variable: str = "variable") -> DataFrame:
    """(year, name, variable) rows to one row per year with a column per name."""
    return long.groupBy(year).pivot(name, list(names)).agg(F.first(variable))


def crosswalk_years(crosswalk: DataFrame) -> list[int]:
    """Years covered by a crosswalk, from its ``Y<year>`` columns."""
    return sorted(int(c[1:]) for c in crosswalk.columns if c[:1] == "Y" and c[1:].isdigit())


def variable_names(names: DataFrame, crosswalk: DataFrame, years: Sequence[int] | None = None,
                   name: str = "name", order: str = "ord") -> DataFrame:
    """Names that requested variables carry in other years: (name, year, variable) rows.

    A name may be that of any year. If several concepts use it, the one in the leftmost column
    counts, then the first row. Years the crosswalk lacks are left out; a concept without a
    variable in a year gives NULL there. Unknown names give no rows.
    """
    columns = [c for c in crosswalk.columns if c != order]
    entries = F.array(*[F.struct(F.lit(i).alias("__pos"), F.col(c).cast("string").alias(name))
                        for i, c in enumerate(columns)])
    where = crosswalk.select(order, F.inline(entries)).filter(F.col(name).isNotNull())
    concept = (
        where.join(names.select(name).distinct(), name)
        .groupBy(name).agg(F.min_by(order, F.struct("__pos", order)).alias(order))
    )
    kept = [y for y in crosswalk_years(crosswalk) if years is None or y in set(years)]
    values = F.array(*[F.struct(F.lit(y).alias("year"), F.col(f"Y{y}").alias("variable"))
                       for y in kept])
    by_year = crosswalk.select(order, F.inline(values))
    return concept.join(by_year, order).select(name, "year", "variable")


def spliced_series(specification: DataFrame, crosswalk: DataFrame, order: str = "ord") -> DataFrame:
    """Request rows of series spliced from several variables by year range.

    ``specification`` has (name, seed, lo, hi, step) rows: in years ``lo..hi`` the series follows
    the concept of ``seed``; where ranges overlap the highest ``step`` wins.
    """
    seeds = specification.select(F.col("seed").alias("name"))
    found = variable_names(seeds, crosswalk, order=order).withColumnRenamed("name", "seed")
    rows = specification.join(found, "seed").filter(F.col("year").between(F.col("lo"), F.col("hi")))
    best = F.max_by(F.struct("variable"), F.col("step")).alias("__best")
    return rows.groupBy("name", "year").agg(best).select(
        "name", "year", F.col("__best.variable").alias("variable"))
