"""Validity intervals against plain loops, several ranges per entity, folded places."""

import random

import pytest
from pyspark.sql import functions as F

from natal.operators import intervals, panel
from natal.rules import Splice


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_interval_join_equals_plain_loops(spark):
    draw = random.Random(3)
    ranges = []
    for k in range(12):
        at = draw.randint(-400, 50)
        for n in range(draw.randint(1, 9)):
            low = at + draw.randint(0, 60)
            at = low + draw.choice([0, 1, 5, 200, 900])
            ranges.append((k, low, at, f"{k}-{n}"))
            at += 1
    ranges += [(20, None, 10, "open"), (20, 11, 12, "short"), (20, 13, None, "on"), (21, None, None, "all"), (22, 9, 3, "none")]
    points = [(draw.randint(0, 13), draw.randint(-900, 6000), i) for i in range(600)]
    points += [(20, y, 1000 + y) for y in (-5000, 10, 11, 12, 13, 9000)] + [(21, 5, 1), (22, 5, 2), (None, 5, 3), (0, None, 4), (20, None, 5)]
    df = spark.createDataFrame(points, "k int, y int, i int")
    table = spark.createDataFrame(ranges, "k int, low int, high int, name string")

    def found(k, y):
        fits = [r for r in ranges if k is not None and y is not None and r[0] == k and (r[1] is None or r[1] <= y) and (r[2] is None or y <= r[2])]
        return fits[0][1:] if fits else (None, None, None)

    want = [(k, y, i, *found(k, y)) for k, y, i in points]
    assert rows(intervals.interval_join(df, table, ["k"], "y", "low", "high")) == sorted(want, key=repr)
    inner = [w for w in want if w[5]]
    assert rows(intervals.interval_join(df, table, ["k"], "y", "low", "high", "inner")) == sorted(inner, key=repr) and inner


@pytest.mark.parametrize("second", [(1, 5, 9), (1, 10, 10), (1, None, 3), (1, 2, 3), (1, 8, None)])
def test_overlaps_are_refused(spark, second):
    table = spark.createDataFrame([(1, 1, 10), second], "k int, low int, high int")
    df = spark.createDataFrame([(1, 5)], "k int, y int")
    with pytest.raises(Exception, match="ranges overlap"):
        intervals.interval_join(df, table, ["k"], "y", "low", "high").collect()


def test_splice_with_several_ranges(spark):
    years = [(c, y, 1) for c in ("A", "B", "C") for y in range(1990, 2000)] + [(None, 1995, 2), ("A", None, 3)]
    df = spark.createDataFrame(years, "country string, year int, cowcode int")
    rules = [Splice("A", None, 1991, 10), Splice("A", 1994, 1995, 20), Splice("A", 1998, None), Splice("B", 1999, None, 30)]
    got = {(r["country"], r["year"]): r["cowcode"] for r in panel.splice(df, rules).collect()}
    a = {y: c for (k, y), c in got.items() if k == "A"}
    assert a == {1990: 10, 1991: 10, 1994: 20, 1995: 20, 1998: 1, 1999: 1}
    assert {y: c for (k, y), c in got.items() if k == "B"} == {1999: 30}
    assert sum(k == "C" for k, _ in got) == 10 and got[(None, 1995)] == 2
    with pytest.raises(Exception, match="ranges overlap"):
        panel.splice(df, [Splice("A", None, 1995), Splice("A", 1995, None)]).collect()


def test_folded_places(spark):
    data = [(1, "b", 2000, 1.0, None), (1, "a", 2000, 3.0, float("nan")), (1, "b", 2001, None, 4.0), (2, "c", 2000, 5.0, 6.0), (None, "d", 2000, 7.0, 8.0)]
    df = spark.createDataFrame(data, "cowcode int, name string, year int, v double, w double")
    got = panel.fold_places(df, ["v", "w"], ["name"])
    assert rows(got) == [(1, "a", 2000, 2.0, None), (1, "a", 2001, None, 4.0), (2, "c", 2000, 5.0, 6.0)]
    assert panel.duplicate_keys(got, ["cowcode", "year"]).count() == 0


@pytest.mark.parametrize("name", ["polity_panel", "vdem_panel", "wdi_panel", "maddison_panel", "icrg_panel"])
def test_panels_of_the_pipelines_have_one_row_per_code_and_year(spark, name):
    from natal.catalog import pipelines

    made = getattr(pipelines, name)(spark, "/root/testdata/sf0.01")
    assert panel.duplicate_keys(made, ["cowcode", "year"]).count() == 0
    codes = {r[0] for r in made.select("cowcode").distinct().collect()}
    assert {1, 2, 365} <= codes  # countries of several places are there


PIPELINES = ["pipeline_baseline", "pipeline_contemporaneous", "pipeline_lagged", "pipeline_exposure", "enrich_left_chain", "contemporaneous_table", "exposure_mean"]


def test_building_a_pipeline_starts_no_job_and_keeps_nothing(spark):
    from natal.catalog import QUERIES

    sc = spark.sparkContext
    before = set(sc._jsc.getPersistentRDDs().keySet())
    for name in PIPELINES:
        QUERIES[name](spark, "/root/testdata/sf0.001")  # schemas are read once
        sc.setJobGroup(f"build-{name}", name)
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(sc.statusTracker().getJobIdsForGroup(f"build-{name}")) == 0, name
        assert df.agg(F.count("*")).first()[0] >= 0
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert set(sc._jsc.getPersistentRDDs().keySet()) == before
