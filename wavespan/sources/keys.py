"""Key variables of every wave."""

from __future__ import annotations

from dataclasses import dataclass

# Raw variable names and codes of the public-use survey files.
HOUSEHOLD_ID = "ER30001"
PERSON_NUMBER = "ER30002"
# Wave; interview number, sequence number and relation to the head in the person
# index; the head's relation code; interview number in the household file. The first wave has no
# sequence number; its place in the index holds the person number.
KEY_VARIABLES = [
    (1968, "ER30001", None, "ER30003", 1, "V3"),
    (1969, "ER30020", "ER30021", "ER30022", 1, "V442"),
    (1970, "ER30043", "ER30044", "ER30045", 1, "V1102"),
    (1971, "ER30067", "ER30068", "ER30069", 1, "V1802"),
    (1972, "ER30091", "ER30092", "ER30093", 1, "V2402"),
    (1973, "ER30117", "ER30118", "ER30119", 1, "V3002"),
    (1974, "ER30138", "ER30139", "ER30140", 1, "V3402"),
    (1975, "ER30160", "ER30161", "ER30162", 1, "V3802"),
    (1976, "ER30188", "ER30189", "ER30190", 1, "V4302"),
    (1977, "ER30217", "ER30218", "ER30219", 1, "V5202"),
    (1978, "ER30246", "ER30247", "ER30248", 1, "V5702"),
    (1979, "ER30283", "ER30284", "ER30285", 1, "V6302"),
    (1980, "ER30313", "ER30314", "ER30315", 1, "V6902"),
    (1981, "ER30343", "ER30344", "ER30345", 1, "V7502"),
    (1982, "ER30373", "ER30374", "ER30375", 1, "V8202"),
    (1983, "ER30399", "ER30400", "ER30401", 10, "V8802"),
    (1984, "ER30429", "ER30430", "ER30431", 10, "V10002"),
    (1985, "ER30463", "ER30464", "ER30465", 10, "V11102"),
    (1986, "ER30498", "ER30499", "ER30500", 10, "V12502"),
    (1987, "ER30535", "ER30536", "ER30537", 10, "V13702"),
    (1988, "ER30570", "ER30571", "ER30572", 10, "V14802"),
    (1989, "ER30606", "ER30607", "ER30608", 10, "V16302"),
    (1990, "ER30642", "ER30643", "ER30644", 10, "V17702"),
    (1991, "ER30689", "ER30690", "ER30691", 10, "V19002"),
    (1992, "ER30733", "ER30734", "ER30735", 10, "V20302"),
    (1993, "ER30806", "ER30807", "ER30808", 10, "V21602"),
    (1994, "ER33101", "ER33102", "ER33103", 10, "ER2002"),
    (1995, "ER33201", "ER33202", "ER33203", 10, "ER5002"),
    (1996, "ER33301", "ER33302", "ER33303", 10, "ER7002"),
    (1997, "ER33401", "ER33402", "ER33403", 10, "ER10002"),
    (1999, "ER33501", "ER33502", "ER33503", 10, "ER13002"),
    (2001, "ER33601", "ER33602", "ER33603", 10, "ER17002"),
    (2003, "ER33701", "ER33702", "ER33703", 10, "ER21002"),
    (2005, "ER33801", "ER33802", "ER33803", 10, "ER25002"),
    (2007, "ER33901", "ER33902", "ER33903", 10, "ER36002"),
    (2009, "ER34001", "ER34002", "ER34003", 10, "ER42002"),
    (2011, "ER34101", "ER34102", "ER34103", 10, "ER47302"),
    (2013, "ER34201", "ER34202", "ER34203", 10, "ER53002"),
    (2015, "ER34301", "ER34302", "ER34303", 10, "ER60002"),
    (2017, "ER34501", "ER34502", "ER34503", 10, "ER66002"),
]
# Interview number in the wealth supplement of a wave.
WEALTH_KEYS = {1984: "S101", 1989: "S201", 1994: "S301", 1999: "S401", 2001: "S501",
               2003: "S601", 2005: "S701", 2007: "S801"}
WAVES = [row[0] for row in KEY_VARIABLES]


@dataclass(frozen=True)
class WaveKeys:
    year: int
    interview: str
    sequence: str | None
    relation: str
    head_code: int
    family_interview: str


_BY_YEAR = {row[0]: WaveKeys(*row) for row in KEY_VARIABLES}


def key_variables(year: int) -> WaveKeys:
    """Key variables of a wave."""
    return _BY_YEAR[year]
