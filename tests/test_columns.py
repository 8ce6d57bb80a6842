"""Missing-value rules, recodes and names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from natal import rules
from natal.functions import columns as C
from natal.functions import names
from natal.operators import exposure, frame
from natal.operators.joins import literal_table
from natal.plans.tables import recodes


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


@pytest.fixture
def codes(spark):
    return spark.createDataFrame([(1, 9900), (2, 20000), (3, None)], "id int, fbpl int")


def test_exclusion_keeps_missing(codes):
    kept = codes.filter(C.not_in("fbpl", rules.US_BIRTHPLACES))
    assert sorted(values(kept, "id")) == [2, 3]
    assert values(codes.filter(C.in_set("fbpl", [9900])), "id") == [1]


def test_filter_drops_unknown(spark):
    df = spark.createDataFrame([("X", 1990), ("X", None), ("Y", None), ("X", 2010)], "c string, y int")
    kept = df.filter(C.unless((F.col("c") == "X") & (F.col("y") < 2006)))
    assert sorted(map(tuple, kept.collect()), key=str) == [("X", 2010), ("Y", None)]


def test_sentinels(spark):
    df = spark.createDataFrame([(-66,), (5,), (None,)], "p int")
    assert values(df, C.null_if("p", -66)) == [None, 5, None]
    df = spark.createDataFrame([("U", 1991, 0.0), ("U", 1993, 2.0), ("V", 1991, 3.0), (None, 1991, 4.0)], "c string, y int, v double")
    assert values(df, C.null_where("v", (F.col("c") == "U") & F.col("y").isin(1991, 1992))) == [None, 2.0, 3.0, None]


def test_if_else_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    assert values(df, C.if_else(F.col("x") > 0, F.lit("a"), F.lit("b"))) == ["a", "b", None]


def test_log_ratio_number(spark):
    df = spark.createDataFrame([(0.0, "Code"), (-1.0, "7"), (1.0, None)], "x double, t string")
    assert values(df, C.log("x")) == [None, None, 0.0]
    assert values(df, C.to_number("t", "int")) == [None, 7, None]
    assert values(df, C.ratio(F.lit(1.0), "x"))[0] is None


def test_mean_treats_nan_as_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", float("nan")), ("b", None)], "k string, v double")
    got = dict(map(tuple, df.groupBy("k").agg(C.mean("v")).collect()))
    assert got == {"a": 1.0, "b": None}
    assert C.nan_to_null(df).filter("v is null").count() == 3
    assert frame.complete_cases(df).count() == 1


def test_mean_of_logs_is_not_log_of_mean(spark):
    df = spark.createDataFrame([(1.0,), (100.0,), (0.0,)], "v double")
    row = df.agg(C.mean(C.log("v")).alias("a"), F.log(C.mean(F.nullif("v", F.lit(0.0)))).alias("b")).first()
    assert row["a"] == pytest.approx(2.302585, abs=1e-6) and row["b"] > row["a"]


def test_recodes(spark):
    rows = [(1, 17, 2, 999), (2, 18, 10, 600), (3, 65, 11, 841), (None, 64, 18, 842), (99, 29, 1, 730)]
    df = spark.createDataFrame(rows, "voted int, age int, educ99 int, faminc int").withColumns(recodes())
    got = [tuple(r)[4:] for r in df.collect()]
    assert got == [
        (0.0, None, None, None),
        (1.0, "18-29", "grad_high", "low"),
        (None, "65+", "some_college", "high_middle"),
        (None, "45-64", "grad_college", "high"),
        (None, "18-29", "no_grad_high", "low_middle"),
    ]


def test_levels(spark):
    df = spark.createDataFrame([("low",), ("high",), ("odd",), (None,)], "f string")
    assert values(df, C.in_levels("f", rules.INCOME_LEVELS)) == ["low", "high", None, None]
    assert values(df, C.level_rank("f", rules.INCOME_LEVELS)) == [1, 5, None, None]
    seen = {r["f"]: r["level"] for r in frame.observed_levels(df, "f", rules.INCOME_LEVELS).collect()}
    assert seen == {"low": 1, "high": 2}


def test_clean_names():
    assert names.clean_names(["YEAR", "year", "CPSIDP", "% Of GDP", "2nd col", "camelCase"]) == [
        "year", "year_2", "cpsidp", "percent_of_gdp", "x2nd_col", "camel_case",
    ]
    assert names.period_name("vdem_corrupt", 1970, 1979) == "lagged_vdem_corrupt_7079"


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, gdp_x int, gdp_y int")
    assert names.containing(df, "gdp") == ["gdp_x", "gdp_y"]
    assert names.positions(df, 2, 3) == ["gdp_x", "gdp_y"]
    assert names.first_then_rest(df, "gdp_y").columns == ["gdp_y", "a", "gdp_x"]


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (6.0, 4.0)], "x double, flat double")
    got = frame.standardize(df, ["x", "flat"])
    row = got.agg(F.avg("x_z"), F.stddev_samp("x_z"), F.count("flat_z")).first()
    assert row[0] == pytest.approx(0, abs=1e-12) and row[1] == pytest.approx(1) and row[2] == 0
    half = frame.standardize(df, ["x"], n_sd=2).agg(F.stddev_samp("x_z")).first()[0]
    assert half == pytest.approx(0.5)


def test_weighted_standardize_equals_repeated_rows(spark):
    df = spark.createDataFrame([(1.0, 2), (4.0, 3), (9.0, 1)], "x double, n int")
    long = df.withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    a = {r["x"]: r["x_z"] for r in frame.standardize(df, ["x"], weight="n").collect()}
    b = {r["x"]: r["x_z"] for r in frame.standardize(long, ["x"]).collect()}
    assert a == pytest.approx(b)


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([(2008, "v", 1.0), (2008, "n", 3.0), (2012, "v", 2.0)], "y int, s string, w double")
    out = frame.weighted_share(df, ["y"], "s", "w")
    assert {tuple(r) for r in out.select("y", "s", "pct").collect()} == {(2008, "v", 0.25), (2008, "n", 0.75), (2012, "v", 1.0)}
    assert {tuple(r) for r in frame.tabulate(df, "s").collect()} == {("v", 2, 2 / 3), ("n", 1, 1 / 3)}


def test_interval_is_type_seven(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4]], "g string, v double")
    row = frame.interval(df, ["g"], "v", width=0.5).first()
    assert (row["lower"], row["estimate"], row["upper"]) == (1.75, 2.5, 3.25)


def test_first_row(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, 5, "b"), (1, 5, "a"), (2, 7, None)], "k int, y int, v string")
    assert sorted(map(tuple, exposure.first_row(df, ["k"], ["y"]).collect())) == [(1, 5, "a"), (2, 7, None)]


def test_flag(spark):
    df = spark.createDataFrame([(0.1, 0.2), (-1.0, 1.0), (-2.0, -1.0), (None, 1.0)], "lo double, hi double")
    assert values(df, C.excludes_zero("lo", "hi")) == ["sig", "insig", "sig", None]


def test_literal_table_has_known_size(spark):
    df = literal_table(spark, {"a": [1, None], "b": ["x", "y"]}, "a int, b string")
    assert df.schema.simpleString() == "struct<a:int,b:string>" and df.count() == 2


def test_clean_names_never_collide():
    assert names.clean_names(["a", "a_2", "a"]) == ["a", "a_2", "a_3"]
    assert names.clean_names(["a", "a", "a_2", "a_2"]) == ["a", "a_3", "a_2", "a_2_2"]


def test_weighted_standardize_with_unknown_values(spark):
    df = spark.createDataFrame([(1.0, 2), (3.0, 2), (None, 50), (float("nan"), 7)], "x double, n int")
    out = {r.x: r.x_z for r in frame.standardize(df, ["x"], weight="n").collect() if r.x is not None and r.x == r.x}
    sd = np.std([1, 1, 3, 3], ddof=1)
    assert out == pytest.approx({1.0: -1 / sd, 3.0: 1 / sd})
