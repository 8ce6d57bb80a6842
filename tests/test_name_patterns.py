"""Names by patterns: every match is found, and few pairs are tried."""

import re

import pytest
from pyspark.sql import functions as F

from natal.operators import name_patterns as np_

PATTERNS = {
    "czech|czecho": 1, "^(east|west) germany$": 2, r"\bkorea\b(?!.*south)": 3, "united.?kingdom|england": 4, "^uk$": 4, "(?:new )?zealand": 5,
    "viet ?nam": 6, "c[oô]te": 7, "guinea": 8, "^guinea bissau": 9, "ab{2,}c": 10, "x+y": 11, "^(?:us|usa)$": 12, "(a|b)(c|d)(e|f)gh": 13,
}
NAMES = [
    "Czech Republic", "Czechoslovakia", "West-Germany", "west germany (old)", "Korea, North", "Korea, South", "United Kingdom", "England!", "UK", "Ukraine",
    "New Zealand", "zealand", "Viet Nam", "VIETNAM", "Côte d'Ivoire", "Cote d'Ivoire", "Guinea", "Guinea-Bissau", "Papua New Guinea", "abbbc", "abc", "xxxy", "USA",
    "u s", "acegh", "bdfgh", "", "  ", "x",
]


def key(name):
    return re.sub(r"[\W_]+", " ", name.lower()).strip()


def test_every_match_is_found(spark):
    df = spark.createDataFrame([(n,) for n in [*NAMES, *NAMES, None]], "country string")
    got = {(r[0], r[1]) for r in np_.pattern_matches(df, "country", PATTERNS).collect()}
    assert got == {(n, p) for n in NAMES for p in PATTERNS if re.search(p, key(n))}
    codes = {r["country"]: r["cowcode"] for r in np_.attach_code_by_pattern(df, "country", PATTERNS).collect()}
    for n in NAMES:
        fits = {c for p, c in PATTERNS.items() if re.search(p, key(n))}
        assert codes[n] == (fits.pop() if len(fits) == 1 else None), n
    assert codes[None] is None
    odd = {r[0]: r[1] for r in np_.ambiguous_names(df, "country", PATTERNS).collect()}
    assert odd == {"Guinea-Bissau": [8, 9]}


@pytest.mark.parametrize(
    "pattern, texts",
    [("abc", [["abc"]]), ("^abc$", [[" abc "]]), ("ab?cde", [["a", "cde"]]), ("ab|cd", [["ab"], ["cd"]]), ("(x|y)abc", [["", "abc"]]), ("(xx|yy)abc", [["xxabc"], ["yyabc"]]), ("ab+cd", [["ab", "cd"]]),
     ("a.b", [["a", "b"]]), ("[ab]cde", [["", "cde"]]), ("(?:abc)?", [["", ""]]), (r"\babc", [["abc"]])],
)
def test_certain_texts(pattern, texts):
    assert np_.certain_texts(pattern) == texts


def test_patterns_are_tried_on_few_names(spark):
    """400 patterns on 2,000 names: pairs that are tried are about as many as names, not their product."""
    words = [f"{a}{b}{c}land" for a in "bdfgklmnpr" for b in "aeiou" for c in "bdfgklmn"]
    patterns = {f"^{w}|{w} republic": i for i, w in enumerate(words)}
    index = np_.index_of(list(patterns))
    assert all(g is not None for _, g in index)
    df = spark.createDataFrame([(f"{w} {k}",) for w in words for k in ("republic", "isles", "x", "y", "z")], "country string")
    plan = np_.attach_code_by_pattern(df, "country", patterns)
    text = plan._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    got = plan.filter(F.col("cowcode").isNotNull()).count()
    assert got == df.count()
    assert np_.attach_code_by_pattern(df.limit(0), "country", patterns).count() == 0
