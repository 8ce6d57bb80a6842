"""Readers, writers and the fit store."""

import pytest
from pyspark.sql import functions as F

from natal.session import cut_lineage, scratch_path, shared_dir
from natal.sources import codebook, tables

BOOK = """<codeBook><dataDscr>
<var ID="YEAR" name="YEAR" dcml="0"><location StartPos="1" EndPos="4" width="4"/><labl>Year</labl><varFormat type="numeric"/></var>
<var ID="VOTED" name="VOTED" dcml="0"><location StartPos="5" EndPos="6" width="2"/>
<catgry><catValu>01</catValu><labl>Did not vote</labl></catgry><catgry><catValu>02</catValu><labl>Voted</labl></catgry>
<catgry><catValu>99</catValu><labl>Not in universe</labl></catgry><varFormat type="numeric"/></var>
<var ID="WT" name="WT" dcml="2"><location StartPos="7" EndPos="11" width="5"/><varFormat type="numeric"/></var>
<var ID="TAG" name="TAG" dcml="0"><location StartPos="12" EndPos="13" width="2"/><varFormat type="character"/></var>
</dataDscr></codeBook>"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "book.xml").write_text(BOOK)
    (tmp_path / "data.txt").write_text("20080200150ab\n20129901000  \n2016  00x00c \n")
    return tmp_path


def test_codebook(spark, files):
    layout, labels = codebook.read_codebook(spark, str(files / "book.xml"))
    assert layout.count() == 4
    assert {tuple(r) for r in labels.collect()} >= {("VOTED", "02", "Voted")}
    df = codebook.read_fixed_width(spark, str(files / "data.txt"), layout)
    assert df.schema.simpleString() == "struct<YEAR:int,VOTED:int,WT:double,TAG:string>"
    assert [tuple(r) for r in df.collect()] == [(2008, 2, 1.5, "ab"), (2012, 99, 10.0, None), (2016, None, None, "c")]
    labelled = codebook.with_label(df, labels, "VOTED")
    assert {r["VOTED"]: r["VOTED_factor"] for r in labelled.collect()} == {2: "Voted", 99: "Not in universe", None: None}
    some = codebook.read_fixed_width(spark, str(files / "data.txt"), layout, ["TAG", "YEAR"])
    assert some.columns == ["YEAR", "TAG"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 2.5), (2, "x,\"y\"", None), (3, "", float("nan"))], "a int, b string, c double")
    path = str(tmp_path / "out")
    tables.write_csv(df, path)
    back = {r["a"]: (r["b"], r["c"]) for r in tables.read_csv(spark, path, df.schema).collect()}
    assert back[1] == (None, 2.5) and back[2] == ('x,"y"', None) and back[3][1] is None
    assert dict(tables.read_csv(spark, path).dtypes) == {"a": "int", "b": "string", "c": "double"}


def test_levels(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id,age_re,v\n1,18-29,1\n2,17,2\n3,NA,x\n")
    levels = {"age_re": ["18-29", "30-44"]}
    for schema in ("id int, age_re string, v string", None):
        df = tables.read_levels(spark, str(tmp_path / "f.csv"), levels, schema)
        assert [r["age_re"] for r in df.orderBy("id").collect()] == ["18-29", None, None]
    years = tables.read_levels(spark, str(tmp_path / "f.csv"), {"id": ["1", "2"]})
    assert [r["id"] for r in years.collect()] == ["1", "2", None] and dict(years.dtypes)["v"] == "string"
    raw = tables.read_csv(spark, str(tmp_path / "f.csv"), "id int, age_re string, v string")
    assert [tuple(r) for r in tables.level_violations(raw, levels).collect()] == [("age_re", "17", 1)]


def test_wide_footer_and_panel(spark, tmp_path):
    (tmp_path / "w.csv").write_text("country,01/1990,02/1990\nA,1.5,NA\nB,2,3\nNA,NA,NA\n,,\n")
    schema = "country string, `01/1990` double, `02/1990` double"
    df = tables.read_wide(spark, str(tmp_path / "w.csv"), "country", schema)
    assert sorted(r["country"] for r in df.collect()) == ["A", "B"]
    spark.createDataFrame([("A", 1969, 1.0, 0), ("A", 1970, float("nan"), 0)], "c string, y int, g double, z int").write.parquet(str(tmp_path / "p"))
    out = tables.read_panel(spark, str(tmp_path / "p"), {"country": "c", "year": "y", "gdp": "g"}, (1970, 2016))
    assert [tuple(r) for r in out.collect()] == [("A", 1970, None)]
    plan = out._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(y), GreaterThanOrEqual(y,1970)" in plan and "ReadSchema: struct<c:string,y:int,g:double>" in plan


def test_store(spark, tmp_path):
    path, calls = str(tmp_path / "fit"), []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert tables.load_or_compute(spark, path, compute).count() == 3
    assert tables.load_or_compute(spark, path, compute).count() == 3
    assert len(calls) == 1


def test_store_passes_other_errors(spark, tmp_path):
    with pytest.raises(ZeroDivisionError):
        tables.load_or_compute(spark, str(tmp_path / "x"), lambda: 1 / 0)


def test_shared_dir_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named.rstrip("/")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    cut = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert cut.count() == 10 and "Range" not in cut._jdf.queryExecution().toString()


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    rows = [(1, 'The "X", Y', 2), (2, "line\nbreak", None), (3, None, 4), (4, "a,b", 5), (5, '"', 6)]
    df = spark.createDataFrame(rows, "id int, name string, n int")
    tables.write_csv(df, str(tmp_path / "out"))
    for schema in (df.schema, None):
        assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "out"), schema).collect())) == rows
    (tmp_path / "r.csv").write_text('id,name,n\n1,"The ""X"", Y",2\n2,"two\nlines",NA\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "r.csv")).collect()] == [(1, 'The "X", Y', 2), (2, "two\nlines", None)]


def test_half_written_store_is_written_again(spark, tmp_path):
    (tmp_path / "fit").mkdir()
    (tmp_path / "fit" / "part-0.parquet").write_text("cut off")
    for _ in range(2):
        assert tables.load_or_compute(spark, str(tmp_path / "fit"), lambda: spark.range(3)).count() == 3
