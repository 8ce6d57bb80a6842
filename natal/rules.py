"""Fixed values of the survey coding, kept as data.

Codes, labels and year cuts below must equal the published codebooks and the agreed rules,
so they are stated plainly. Long code lists (birthplaces) are files that the caller passes.
"""

from __future__ import annotations

from typing import NamedTuple

# Birthplace codes of the United States and its outlying areas.
US_BIRTHPLACES = (9900, 10000, 10500, 10750, 11000, 11500, 12090)

# Citizenship labels that mean citizen by birth.
CITIZEN_BY_BIRTH = ("Born in U.S", "Born in U.S. outlying", "Born abroad of American parents")

# Fixed value: label of respondents outside the voting universe.
NOT_IN_UNIVERSE = "Not in universe"

# Text that marks header rows inside the birthplace code list.
CODE_LIST_JUNK = ("NA", "Code")

# Corrections of entity names.
NAME_FIXES = {
    "Venezuala": "Venezuela",
    "Czechoslavakia": "Czechoslovakia",
    "England": "United Kingdom",
    "Wales": "United Kingdom",
    "Scotland": "United Kingdom",
    "Northern Ireland": "United Kingdom",
}

# Entities whose numeric code is set by hand.
CODE_OVERRIDES = {"Serbia": 345, "Serbia-Montenegro": 345, "Korea, DPR": 731}

# Aggregates that duplicate their successor states.
DROPPED_ENTITIES = ("Former Yugoslavia", "Former USSR")

# Fixed value: missing marker of the regime score.
REGIME_MISSING = -66

# Years in which one country's income is a false zero.
FALSE_ZERO_ENTITY = "United Arab Emirates"
FALSE_ZERO_YEARS = (1991, 1992)


class Splice(NamedTuple):
    """Years in which an entity speaks for its code; ``None`` leaves that end open."""

    entity: str
    keep_from: int | None
    keep_to: int | None
    code: int | None = None


# Successor states that share one code.
SPLICES = (
    Splice("Serbia", 2006, None, 345),
    Splice("Serbia-Montenegro", None, 2005, 345),
    Splice("USSR", None, 1991),
    Splice("Russia", 1992, None),
    Splice("Germany, West", None, 1989),
    Splice("Germany", 1990, None),
)

# Vote codes to a 0/1 outcome; larger codes carry no answer.
VOTE_OUTCOME = {1: 0.0, 2: 1.0}

# Bands, first one is the reference level.
AGE_BANDS = (("18-29", 18, 29), ("30-44", 30, 44), ("45-64", 45, 64), ("65+", 65, None))
EDUCATION_SETS = {
    "no_grad_high": (1, 4, 5, 6, 7, 8, 9),
    "grad_high": (10,),
    "some_college": (11,),
    "grad_college": (12, 13, 14, 15, 16, 17, 18),
}
INCOME_SETS = {
    "low": (100, 210, 300, 430, 470, 500, 600),
    "low_middle": (710, 720, 730, 740),
    "middle": (820, 830),
    "high_middle": (840, 841),
    "high": (842, 843),
}
AGE_LEVELS = tuple(label for label, _, _ in AGE_BANDS)
EDUCATION_LEVELS = tuple(EDUCATION_SETS)
INCOME_LEVELS = tuple(INCOME_SETS)
SURVEY_YEARS = ("2000", "2004", "2008", "2012", "2016")

# Averaging periods and the exposure window, in years.
CONTEMPORARY_PERIOD = (2000, 2016)
LAGGED_PERIOD = (1970, 1979)
INCOME_PANEL_YEARS = (1970, 2016)
PANEL_TRIM = (1899, 2016)
EXPOSURE_WINDOW = 20

# State codes and postal abbreviations.
STATE_ABBREVIATIONS = {
    1: "AL", 2: "AK", 4: "AZ", 5: "AR", 6: "CA", 8: "CO", 9: "CT", 10: "DE", 11: "DC", 12: "FL",
    13: "GA", 15: "HI", 16: "ID", 17: "IL", 18: "IN", 19: "IA", 20: "KS", 21: "KY", 22: "LA",
    23: "ME", 24: "MD", 25: "MA", 26: "MI", 27: "MN", 28: "MS", 29: "MO", 30: "MT", 31: "NE",
    32: "NV", 33: "NH", 34: "NJ", 35: "NM", 36: "NY", 37: "NC", 38: "ND", 39: "OH", 40: "OK",
    41: "OR", 42: "PA", 44: "RI", 45: "SC", 46: "SD", 47: "TN", 48: "TX", 49: "UT", 50: "VT",
    51: "VA", 53: "WA", 54: "WV", 55: "WI", 56: "WY",
}
