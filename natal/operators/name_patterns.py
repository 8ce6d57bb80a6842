"""Codes of names by patterns, through an inverted index instead of trying every pattern on every name.

Every way a pattern can match holds some letters for certain. The rarest three of them in a row (over
all patterns) become that way's entry in an index; names are cut into their runs of three, and a
pattern is tried only on names that share an entry. A pattern without three certain letters is
tried on all names; there are few names, as each different one is looked at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.operators.entity import name_key
from natal.operators.joins import literal_table, lookup_join

try:
    from re import _constants as _c
    from re import _parser
except ImportError:  # pragma: no cover - older interpreters
    import sre_constants as _c
    import sre_parse as _parser

GRAM = 3
#: More ways than this of matching one pattern are not spelled out; the pattern is tried on all names.
MOST_WAYS = 64
_KEY = "_natal_name"


def certain_texts(pattern: str) -> list[list[str]]:
    """For every way of matching: the texts that it holds for certain.

    Names are compared with a blank at both ends, so the ends of a name count as blanks.
    """
    return [["".join(part) for part in way] for way in _ways(_parser.parse(pattern))]


def _ways(parsed) -> list[list[list[str]]]:
    """Ways of a sequence; each is a list of runs of characters, a break between runs being unknown text."""
    ways: list[list[list[str]]] = [[[]]]
    for op, argument in parsed:
        if op is _c.LITERAL:
            options = [[[chr(argument)]]]
        elif op is _c.AT and argument in (_c.AT_BEGINNING, _c.AT_BEGINNING_STRING, _c.AT_END, _c.AT_END_STRING):
            options = [[[" "]]]
        elif op is _c.AT:
            options = [[[]]]
        elif op is _c.SUBPATTERN:
            options = _ways(argument[3])
        elif op is _c.BRANCH:
            options = [way for branch in argument[1] for way in _ways(branch)]
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and argument[0] >= 1:
            once = _ways(argument[2])
            options = once if argument[0] == argument[1] == 1 else [[*way, []] for way in once]
        else:  # a class of characters, something optional, an assertion: nothing certain
            options = [[[], []]]
        ways = [_joined(way, option) for way in ways for option in options]
        if len(ways) > MOST_WAYS:
            return [[[]]]
    return ways


def _joined(way: list[list[str]], option: list[list[str]]) -> list[list[str]]:
    return [*way[:-1], way[-1] + option[0], *option[1:]]


def index_of(patterns: Sequence[str]) -> list[tuple[int, str | None]]:
    """(number of the pattern, run of three) for every way; a run of ``None`` means all names."""
    runs = [[sorted({t[i : i + GRAM] for t in way for i in range(len(t) - GRAM + 1)}) for way in certain_texts(p)] for p in patterns]
    often = Counter(g for ways in runs for g in {g for way in ways for g in way})
    out = set()
    for number, ways in enumerate(runs):
        if not all(ways):
            out.add((number, None))
            continue
        out |= {(number, min(way, key=lambda g: (often[g], g))) for way in ways}
    return sorted(out, key=repr)


def pattern_matches(names: DataFrame, name: str, patterns: Mapping[str, int], code: str = "cowcode") -> DataFrame:
    """(``name``, pattern, code) for every different name and every pattern found in its comparable form."""
    spark, texts = names.sparkSession, list(patterns)
    for text in texts:
        re.compile(text)
    rules = literal_table(spark, {"_n": range(len(texts)), "pattern": texts, code: list(patterns.values())}, f"_n int, pattern string, {code} int")
    entries = index_of(texts)
    indexed = [(n, g) for n, g in entries if g is not None]
    anywhere = [n for n, g in entries if g is None]
    distinct = names.select(name).filter(F.col(name).isNotNull()).distinct().withColumn(_KEY, name_key(name))
    padded = F.concat(F.lit(" "), F.col(_KEY), F.lit(" "))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - GRAM + 1, F.lit(1))), lambda i: F.substring(padded, i, GRAM)))
    tried = distinct.withColumn("_gram", F.explode(grams))
    index = literal_table(spark, {"_n": [n for n, _ in indexed], "_gram": [g for _, g in indexed]}, "_n int, _gram string") if indexed else None
    pairs = [lookup_join(tried, index, ["_gram"], "inner").select(name, _KEY, "_n")] if indexed else []
    if anywhere:
        pairs.append(distinct.select(name, _KEY, F.explode(F.array(*[F.lit(n) for n in anywhere])).alias("_n")))
    found = pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1])
    checked = lookup_join(found.distinct(), rules, ["_n"], "inner")
    return checked.filter(F.expr(f"rlike(`{_KEY}`, pattern)")).select(name, "pattern", code)


def attach_code_by_pattern(df: DataFrame, name: str, patterns: Mapping[str, int], code: str = "cowcode") -> DataFrame:
    """Code of each row's name; null where no pattern fits or where those that fit disagree."""
    found = pattern_matches(df, name, patterns, code).groupBy(name).agg(F.min(code).alias(code), F.max(code).alias("_most"))
    lookup = found.filter(F.col(code) == F.col("_most")).drop("_most")
    return lookup_join(df.drop(code), lookup, [name], "left")


def ambiguous_names(df: DataFrame, name: str, patterns: Mapping[str, int], code: str = "cowcode") -> DataFrame:
    """Names whose patterns disagree, with their codes in rising order."""
    codes = pattern_matches(df, name, patterns, code).groupBy(name).agg(F.array_sort(F.collect_set(code)).alias("codes"))
    return codes.filter(F.size("codes") > 1)
