"""Lookup joins, with and without room to broadcast, and with a key that holds a third of the rows."""

import pytest
from pyspark.sql import functions as F

from natal.operators import joins


@pytest.fixture
def hot(spark):
    """3,000 rows; a third hold key 0, a third hold no key, identical copies included."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id") % 50 + 1)
    return spark.range(3000).select(key.cast("int").alias("k"), (F.col("id") % 700).alias("v"))


@pytest.fixture
def lookup(spark):
    return spark.range(0, 40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("w"))


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(hot, lookup, how):
    assert joins.heavy_keys(hot, ["k"], 8).count() >= 2
    salted = joins.salted_join(hot, lookup, ["k"], how, partitions=8)
    assert rows(salted) == rows(hot.join(lookup, "k", how))


def test_salting_spreads_the_heavy_key(hot):
    heavy = joins.heavy_keys(hot, ["k"], 8)
    splits = {r[0]: r[1] for r in heavy.collect()}
    hashes = {r["k"]: r["h"] for r in hot.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    assert splits[hashes[0]] >= 5 and splits[hashes[None]] >= 5


def test_copies_are_spread(spark, lookup):
    copies = spark.range(8000).repartition(8).select(F.lit(3).alias("k"), F.lit("same").alias("v"))
    salted = copies.withColumn("s", joins.split_number(copies.columns, F.lit(16)))
    assert salted.groupBy("s").count().agg(F.max("count")).first()[0] <= 4000
    assert joins.salted_join(copies, lookup, ["k"], "inner", partitions=8).count() == 8000


def test_no_heavy_keys(spark):
    assert joins.heavy_keys(spark.range(5000), ["id"], 8).count() == 0
    assert joins.heavy_keys(spark.range(0), ["id"], 8).count() == 0


@pytest.mark.parametrize("partitions", [31_250, 40_000, 100_000])
def test_heavy_keys_of_very_many_partitions(spark, partitions):
    """Keys beyond half a share are found, whatever the number of partitions."""
    rows = spark.range(1_200_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 20_000).alias("k"))
    found = {r[0]: r[1] for r in joins.heavy_keys(rows, ["k"], partitions).collect()}
    exact = rows.groupBy(F.xxhash64("k").alias("h")).count().filter(F.col("count") > 1_200_000 / (2 * partitions)).collect()
    assert {r["h"] for r in exact} <= set(found) and len(exact) > 19_000
    hot = rows.filter("k = -1").select(F.xxhash64("k")).first()[0]
    assert found[hot] == pytest.approx(2 * partitions / 3, rel=0.1)


def test_salted_join_of_very_many_partitions(hot, lookup):
    assert rows(joins.salted_join(hot, lookup, ["k"], partitions=100_000)) == rows(hot.join(lookup, "k", "left"))


def test_salted_join_with_repeated_right_keys(hot, lookup):
    twice = lookup.unionByName(lookup.withColumn("w", F.col("w") + 1))
    assert rows(joins.salted_join(hot, twice, ["k"], "left", partitions=8)) == rows(hot.join(twice, "k", "left"))


def test_lookup_join_falls_back(hot, lookup, monkeypatch):
    assert "BroadcastHashJoin" in plan(joins.lookup_join(hot, lookup, ["k"]))
    want = rows(joins.lookup_join(hot, lookup, ["k"]))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert rows(joins.lookup_join(hot, lookup, ["k"])) == want
    assert rows(joins.lookup_join(hot, lookup.filter("k < 30"), ["k"], "inner")) == rows(hot.join(lookup.filter("k < 30"), "k"))


def test_size_comes_from_the_plan(spark, hot, tmp_path):
    """Long texts count by the bytes of their file; an unknown relation is never taken for small."""
    texts = spark.range(200).select(F.col("id").cast("int").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4000).alias("t"))
    texts.write.option("compression", "none").parquet(str(tmp_path / "t"))
    long = spark.read.parquet(str(tmp_path / "t"))
    assert joins.source_bytes(long) > joins.SOURCE_BYTES and not joins.fits_broadcast(long, rows=200)
    assert not joins.fits_broadcast(spark.range(10).rdd.map(lambda r: (r[0], "x")).toDF(["k", "s"]))
    assert "BroadcastHashJoin" not in plan(joins.lookup_join(hot, long, ["k"]))
    small = spark.createDataFrame([(1, "a")], "k int, s string")
    assert joins.fits_broadcast(joins.literal_table(spark, {"k": [1], "s": ["a"]}, "k int, s string"))
    assert rows(joins.lookup_join(hot, small, ["k"])) == rows(hot.join(small, "k", "left"))
    assert not joins.fits_broadcast(long.select("k").groupBy("k").count(), grows=10)


def test_without_adaptive_execution_heavy_keys_are_split(spark, hot, lookup, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.lookup_join(hot, lookup, ["k"])
        assert "approx_top_k" in plan(joined) and rows(joined) == rows(hot.join(lookup, "k", "left"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_right_join_keeps_all_and_renames(spark, lookup):
    people = spark.createDataFrame([(1, 5), (2, 99), (3, None)], "id int, fbpl int")
    out = joins.keep_all_right(lookup, people, "k", "fbpl")
    assert rows(out.select("id", "k", "w")) == [(1, 5, 50), (2, 99, None), (3, None, None)]


def test_missing_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (0, "z")], "k int, r string")
    assert rows(joins.lookup_join(left, right, ["k"]).select("l", "r")) == [("a", "x"), ("b", None)]
    assert rows(joins.null_safe_join(left, right, ["k"]).select("l", "r")) == [("a", "x"), ("b", "y")]


def test_unmatched_and_unique(spark, lookup):
    people = spark.createDataFrame([(1,), (77,), (77,), (None,)], "k int")
    assert rows(joins.unmatched(people, lookup, ["k"])) == [(77, 2), (None, 1)]
    assert rows(joins.assert_unique(lookup, ["k"])) == rows(lookup)
    twice = joins.assert_unique(lookup.unionByName(lookup), ["k"])  # fails in the job that uses it
    with pytest.raises(Exception, match="keys .* repeat"):
        joins.lookup_join(people, twice, ["k"]).collect()


def test_enrich_keeps_row_count(hot, lookup):
    out = joins.enrich(hot, [lookup, lookup.withColumnRenamed("w", "w2")], "k")
    assert out.count() == hot.count() and out.columns == ["k", "v", "w", "w2"]


def test_null_safe_join_of_other_types(spark):
    import datetime as dt

    day, when = dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3)
    rows = [(day, when, True), (None, None, None), (day, when, False)]
    for c, k in (("d", 0), ("t", 1), ("b", 2)):
        left = spark.createDataFrame(rows, "d date, t timestamp, b boolean").select(c)
        right = spark.createDataFrame([(rows[0][k], 1), (None, 2)], f"{c} {left.dtypes[0][1]}, v int")
        got = joins.null_safe_join(left, right, [c]).collect()
        assert sorted((r[c] is None, r.v or 0) for r in got) == sorted((r[k] is None, 2 if r[k] is None else int(r[k] == rows[0][k])) for r in rows)
    odd = joins.null_safe_join(spark.createDataFrame([(0,), (7,)], "k int"), spark.createDataFrame([("x", 1), ("7", 2)], "k string, v int"), ["k"])
    assert sorted((r.k, r.v) for r in odd.collect() if r.v) == [(7, 2)]


def test_keep_panel_with_many_missing_codes(spark):
    from natal.operators.panel import keep_panel

    base = spark.range(9000).selectExpr("if(id % 3 = 0, null, int(id % 50)) AS cowcode", "int(1990 + id % 7) AS year")
    other = spark.range(350).selectExpr("int(id % 50) AS cowcode", "int(1990 + id % 7) AS year", "id AS v")
    assert keep_panel(base, other, ["cowcode", "year"]).count() == base.join(other, ["cowcode", "year"], "left").count()
