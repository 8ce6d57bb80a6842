"""Panels and exposure windows against brute force."""

import itertools

import pytest
from pyspark.sql import functions as F

from natal import rules
from natal.operators import exposure, joins, panel
from natal.rules import Splice


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def source(spark):
    data = [(1, 1990, 2.0), (1, 1991, float("nan")), (1, 1992, 6.0), (2, 1991, None), (3, 1980, 1.0), (None, 1991, 9.0)]
    return spark.createDataFrame(data, "cowcode int, year int, v double")


def test_period_mean(source):
    out = panel.period_mean(source, ["cowcode"], ["v"], 1990, 1999)
    assert rows(out) == [(1, 4.0), (2, None), (None, 9.0)]
    assert panel.period_mean(source, ["cowcode"], ["v"], 1990, 1999, lagged=True).columns == ["cowcode", "lagged_v_9099"]


def test_wide_to_annual(spark):
    wide = spark.createDataFrame([("A", 1.0, 3.0, None), ("B", None, None, 5.0)], "country string, `01/1990` double, `02/1990` double, `01/1991` double")
    long = panel.split_name(panel.wide_to_long(wide, ["country"], wide.columns[1:]), "name", ["month", "year"])
    assert long.count() == 6
    out = panel.annual_mean(long, ["country"], "value", "m")
    assert rows(out) == [("A", 1990, 2.0), ("A", 1991, None), ("B", 1990, None), ("B", 1991, 5.0)]


def test_splice_leaves_no_duplicates(spark):
    data = [(c, y, 345 if "Serbia" in c else 365 if c in ("USSR", "Russia") else 2) for c, y in itertools.product(
        ["Serbia", "Serbia-Montenegro", "USSR", "Russia", "Peru"], range(1985, 2010))]
    df = spark.createDataFrame(data, "country string, year int, cowcode int")
    assert panel.duplicate_keys(df, ["cowcode", "year"]).count() == 50
    out = panel.splice(df, rules.SPLICES)
    assert panel.duplicate_keys(out, ["cowcode", "year"]).count() == 0
    assert out.count() == 75
    assert out.filter("country = 'Serbia' and year < 2006").count() == 0
    assert panel.duplicate_rows(df, ["cowcode", "year"]).count() == 100


def test_splice_without_matching_rule(spark):
    df = spark.createDataFrame([("Peru", None, 135), ("Russia", None, 365)], "country string, year int, cowcode int")
    assert rows(panel.splice(df, [Splice("Russia", 1992, None)])) == [("Peru", None, 135)]


def test_keep_panel(spark):
    base = spark.createDataFrame([(1, 1990), (1, 1991)], "cowcode int, year int")
    other = spark.createDataFrame([(1, 1990, 5.0), (1, 1980, 4.0)], "cowcode int, year int, v double")
    assert rows(panel.keep_panel(base, other, ["cowcode", "year"])) == [(1, 1990, 5.0), (1, 1991, None)]


@pytest.fixture
def people(spark):
    data = [(10, 1, 1990), (11, 1, 2010), (12, 1, 2011), (13, 1, 1989), (14, 2, 1991), (15, None, 1991), (16, 4, 1991), (17, 1, None)]
    return spark.createDataFrame(data, "cpsidp int, cowcode int, arr int")


@pytest.fixture
def yearly(spark):
    data = [(1, y, float(y - 1985), None if y == 1991 else 1.0) for y in range(1990, 1996)]
    data += [(2, 1991, None, None), (None, 1991, 7.0, 7.0)]
    return spark.createDataFrame(data, "cowcode int, src_year int, v double, w double")


def brute(people, yearly, window):
    out = {}
    for p in people.collect():
        hit = [r for r in yearly.collect() if p["cowcode"] is not None and p["arr"] is not None
               and r["cowcode"] == p["cowcode"] and p["arr"] - window <= r["src_year"] <= p["arr"]]
        for r in hit:
            out.setdefault(p["cpsidp"], []).append((r["src_year"] - p["arr"], r["v"], r["w"]))
    def avg(xs):
        xs = [x for x in xs if x is not None]
        return sum(xs) / len(xs) if xs else None
    return sorted((k, min(h[0] for h in hits), avg([h[1] for h in hits]), avg([h[2] for h in hits]), len(hits)) for k, hits in out.items())


@pytest.mark.parametrize("window", [0, 3, 20])
@pytest.mark.parametrize("unique", [True, False])
def test_exposure_mean(people, yearly, window, unique):
    out = exposure.exposure_mean(people, yearly, "cpsidp", "cowcode", "arr", ["v", "w"], window, unique=unique)
    assert out.columns == ["cpsidp", "cowcode", "arr", "year_diff", "fuzzy_v", "fuzzy_w", "n_years"]
    got = sorted(map(tuple, out.select("cpsidp", "year_diff", "fuzzy_v", "fuzzy_w", "n_years").collect()))
    assert got == brute(people, yearly, window)


@pytest.mark.parametrize("room", [0, 64 * 1024 * 1024])
def test_window_edges(people, yearly, room, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", room)
    out = exposure.exposure_rows(people, yearly, "cowcode", "arr", 20)
    diffs = {r["cpsidp"]: sorted(x["year_diff"] for x in out.collect() if x["cpsidp"] == r["cpsidp"]) for r in out.collect()}
    assert diffs[10] == [0] and diffs[11] == [-20, -19, -18, -17, -16, -15] and diffs[12][0] == -20 and len(diffs[12]) == 5
    assert 13 not in diffs and 15 not in diffs and 16 not in diffs and 17 not in diffs
    brute_counts = {k: n for k, *_, n in brute(people, yearly, 20)}
    assert {k: len(v) for k, v in diffs.items()} == brute_counts


def test_repeated_respondents_pool(people, yearly):
    twice = people.unionByName(people.withColumn("arr", F.col("arr") + 1)).filter("cpsidp = 10")
    out = exposure.exposure_mean(twice, yearly, "cpsidp", "cowcode", "arr", ["v"], 3)
    # years 1990; 1990 and 1991 -> values 5, 5, 6
    assert rows(out.select("cpsidp", "fuzzy_v", "n_years")) == [(10, pytest.approx(16 / 3), 3)]


def test_duplicated_panel_rows_count_twice(people, yearly):
    doubled = yearly.unionByName(yearly.filter("src_year = 1990"))
    out = exposure.exposure_mean(people, doubled, "cpsidp", "cowcode", "arr", ["v"], 3, unique=True)
    assert {r["cpsidp"]: r["n_years"] for r in out.collect()}[10] == 2


@pytest.mark.parametrize("window", [0, 3, 20])
def test_exposure_first(people, yearly, window):
    out = exposure.exposure_first(people, yearly, "cowcode", "arr", window)
    got = {r.cpsidp: (r.year_diff, r.v) for r in out.collect()}
    values = {(r.cowcode, r.src_year): r.v for r in yearly.collect()}
    arr = {p.cpsidp: (p.cowcode, p.arr) for p in people.collect()}
    want = {k: d for k, d, *_ in brute(people, yearly, window)}
    assert got == {k: (d, values[arr[k][0], arr[k][1] + d]) for k, d in want.items()}


def test_exposure_first_leaves_respondents_in_place(people, yearly):
    out = exposure.exposure_first(people, yearly, "cowcode", "arr", 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    left = plan.split("LogicalRDD")[0] if "LogicalRDD" in plan else plan
    assert "Generate" not in left.split("InMemoryRelation")[0]


def test_splice_with_overlapping_rules_is_refused(spark):
    from natal.rules import Splice

    source = spark.createDataFrame([("A", 1992, 5)], "country string, year int, cowcode int")
    assert panel.splice(source, [Splice("A", None, 1990, 1), Splice("A", 1995, None, 1)]).count() == 0
    with pytest.raises(Exception, match="ranges overlap"):
        panel.splice(source, [Splice("A", None, 1995, 1), Splice("A", 1990, None, 1)]).collect()
