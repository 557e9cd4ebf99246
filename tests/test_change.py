"""Job and code changes on hand-computed histories."""

from conftest import values

from wavespan.operators import change
from wavespan.operators.change import ChangeRules

N = None
SCHEMA = "pid long, year int, tenure double"


def both(frame, rows, **kwargs):
    df = frame(SCHEMA, [(p, y, None if t is None else float(t)) for p, y, t in rows])
    out = change.job_change(df, **kwargs)
    return values(out, "change_t"), values(out, "change_24t")


def test_bracket_rules_first_code_two_only(frame):
    rows = [(1, 1968, 1), (1, 1969, 2), (1, 1970, 2), (1, 1971, 2), (1, 1972, 1),
            (2, 1970, 2), (2, 1971, 2), (3, 1970, 5), (3, 1971, 2), (4, 1970, 9), (4, 1971, 2)]
    t, _ = both(frame, rows)
    # person 1: entry code 1; code 2 after a flagged 1968; later 2s follow a short code
    # person 2: first wave with code 2; person 3: code 2 after a long code; person 4: after 9
    assert t == [True, True, False, False, True, True, False, False, True, False, False]


def test_code_two_in_a_first_wave_1969_stays_unknown(frame):
    # the 1969 rule asks for the previous flag; there is none, so the flag is unknown and the
    # later rules, which need a FALSE flag, cannot fire either
    rows = [(1, 1969, 2), (1, 1970, 2)]
    assert both(frame, rows)[0] == [False, False]
    assert both(frame, rows, semantics="as_coded")[0] == [False, True]


def test_bracket_rules_literal_flags_every_code_two(frame):
    rows = [(1, 1970, 2), (1, 1971, 2), (1, 1972, 3), (1, 1973, N)]
    assert both(frame, rows)[0] == [True, False, False, False]
    assert both(frame, rows, semantics="as_coded")[0] == [True, True, False, False]


def test_first_months_wave_uses_fifteen_months(frame):
    rows = [(1, 1975, 4), (1, 1976, 1.2), (2, 1975, 4), (2, 1976, 1.3)]
    assert both(frame, rows)[0] == [False, True, False, False]


def test_general_rule_compares_tenure_with_the_gap(frame):
    rows = [(1, 1980, 5), (1, 1981, 0.5), (1, 1984, 3.5), (1, 1987, 2.5), (1, 1988, N), (1, 1989, 1)]
    t, _ = both(frame, rows)
    assert t == [False, True, False, True, False, False]


def test_two_year_waves(frame):
    rows = [(1, 1997, 10), (1, 1999, 1.5), (1, 2001, 3.5), (1, 2003, 2.0)]
    t, t24 = both(frame, rows)
    assert t == [False, True, False, False]
    assert t24 == [False, True, False, True]       # 2.0 is more than two years below 3.5 + 2


def test_tolerant_rule_includes_the_strict_one(frame):
    rows = [(1, 1980, 5), (1, 1981, 9), (1, 1982, 10), (1, 1983, 0.5)]
    t, t24 = both(frame, rows)
    assert t == [False, False, False, True]
    assert t24 == [False, True, False, True]


def test_literal_tolerant_rule_mixes_subset_lag_with_full_gap(frame):
    # 1983 is the first eligible wave (its predecessor has no tenure in 1982 only for 1983+1)
    rows = [(1, 1980, 5), (1, 1981, 6), (1, 1982, N), (1, 1983, 20), (1, 1984, 21), (1, 1985, 2)]
    _, intended = both(frame, rows)
    _, literal = both(frame, rows, semantics="as_coded")
    # eligible waves: 1981, 1984, 1985. Literal lag of 1984 is the 1981 value, gap 1 year.
    assert intended == [False, False, False, False, False, True]
    assert literal == [False, False, False, False, True, True]


def test_single_wave_and_missing_tenure_mean_no_change(frame):
    assert both(frame, [(1, 1990, 0.1), (2, 1990, N)]) == ([False, False], [False, False])


def test_tolerance_is_a_parameter(frame):
    rows = [(1, 1990, 5), (1, 1991, 7)]
    assert both(frame, rows)[1] == [False, False]
    assert both(frame, rows, rules=ChangeRules(tolerance=0.5))[1] == [False, True]


def code_frame(frame, rows):
    return frame("pid long, year int, code int, change_t boolean", rows)


def test_code_change_skips_missing_codes_and_gates_late_waves(frame):
    df = code_frame(frame, [
        (1, 1978, 5, False), (1, 1979, N, False), (1, 1980, 6, False), (1, 1981, 7, False),
        (1, 1982, 8, True), (1, 1983, 0, True), (1, 1984, 8, True)])
    out = change.code_change(df, "code", {"gated": "change_t"}, out="unc")
    assert values(out, "unc") == [False, False, True, True, True, False, False]
    assert values(out, "gated") == [False, False, True, False, True, False, False]
    literal = change.code_change(df, "code", {}, out="unc", zero_is_missing=False)
    assert values(literal, "unc") == [False, False, True, True, True, True, True]


def test_gap_follows_real_waves(frame):
    df = frame("pid long, year int", [(1, 1995), (1, 1997), (1, 2001), (2, 1990)])
    assert values(change.wave_gap(df), "gap") == [N, 2, 4, N]
