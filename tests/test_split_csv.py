"""CSV files with quoted line breaks, split between tasks, against the reader that takes a file whole."""

import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest

from natal.sources import split_csv, tables

SCHEMA = "id int, note string, value double, `odd name` string"


def text_of(rows, header=("id", "note", "value", "odd name"), end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue()


def rows(n, seed, longest=12):
    draw = random.Random(seed)
    parts = ["a", "word", ",", '"', '""', "\n", "\n\n", '",', '\n"', "é日", " "]
    return [
        [i, "".join(draw.choices(parts, k=draw.randint(0, longest))) + "x", draw.choice(["NA", "1.5", "2"]), draw.choice(["b", "NA", "c\nd"])]
        for i in range(n)
    ]


@pytest.fixture
def small(spark):
    """A session whose splits are small, so that a small file has many."""
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    session.conf.set("spark.sql.files.openCostInBytes", "1k")
    return session


def whole(spark, path, schema=SCHEMA):
    return spark.read.options(**tables.DIALECT).schema(schema).csv(path)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lines_compose_like_the_whole_text():
    lines = text_of(rows(300, 1)).split("\n")
    outside, inside = split_csv.transitions(pa.array(lines))
    states = split_csv._states(outside, inside, False)
    state = False
    for line, o, i, got in zip(lines, outside, inside, states):
        state = bool(i if state else o)
        assert state == got
    for start in (False, True):  # a composition of parts is the composition of the whole
        first = split_csv._states(outside[:70], inside[:70], start)[-1]
        assert (split_csv._states(outside[70:], inside[70:], first) == split_csv._states(outside, inside, start)[70:]).all()


@pytest.mark.parametrize(
    "line, outside, inside",
    [
        ("a,b", False, True), ('"a', True, False), ('a"', False, False), ('a,"b', True, False), ('a,"b"', False, False), ('5" pipe,b', False, False),
        ('""', False, True), ('"""', True, False), ('a,""b', False, True), ('"a""b', True, False), ('x","y', True, True), ('",', True, False), ("", False, True),
    ],
)
def test_states_of_lines(line, outside, inside):
    got = split_csv.transitions(pa.array([line]))
    assert (bool(got[0][0]), bool(got[1][0])) == (outside, inside)


@pytest.mark.parametrize("seed, longest, end", [(1, 12, "\n"), (2, 60, "\n"), (3, 3, "\r\n"), (4, 400, "\n")])
def test_equals_the_reader_of_whole_files(small, tmp_path, seed, longest, end):
    path = str(tmp_path / "f.csv")
    (tmp_path / "f.csv").write_bytes(text_of(rows(400, seed, longest), end=end).encode())
    assert split_csv.needs_split(small, path)
    got = tables.read_csv(small, path, SCHEMA)
    assert listed(got) == listed(whole(small, path)) and got.count() == 400
    assert split_csv._lines(small, path).rdd.getNumPartitions() > 3


def test_a_task_reads_many_ranges(small, tmp_path):
    path = str(tmp_path / "f.csv")
    (tmp_path / "f.csv").write_text(text_of(rows(12_000, 11, 60)))
    ranges = split_csv._lines(small, path).rdd.getNumPartitions()
    got = tables.read_csv(small, path, SCHEMA)
    assert ranges > 300 and 8 <= got.rdd.getNumPartitions() < ranges / 4
    assert listed(got) == listed(whole(small, path))


def test_long_fields_and_headers_cross_many_ranges(small, tmp_path):
    long = "line, with \"quotes\"\n" * 1500
    header = ("id", "note " + "of\nmany lines " * 400, "value", "odd\nname")
    data = [[1, long, "NA", "a"], [2, "b", "2.5", long], [3, "", "1", "NA"], [4, long, "NA", long]]
    (tmp_path / "f.csv").write_text(text_of(data, header))
    (tmp_path / "g.csv").write_text(text_of(rows(300, 7)))
    (tmp_path / "empty.csv").write_text("")
    got = listed(tables.read_csv(small, str(tmp_path), SCHEMA))
    assert got == listed(whole(small, str(tmp_path))) and len(got) == 304


def test_stray_and_open_quotes(small, tmp_path):
    body = '1,5" pipe,1.5,b\n2,"a\n""b""\n",2,c\n' * 300 + '3,"never closed\n4,x,1,b\n'
    (tmp_path / "f.csv").write_text("id,note,value,odd name\n" + body)
    got = listed(tables.read_csv(small, str(tmp_path / "f.csv"), SCHEMA))
    assert len(got) == 601 and got.count((1, '5" pipe', 1.5, "b")) == 300 and got.count((2, 'a\n"b"\n', 2.0, "c")) == 300
    assert got[-1][0] == 3


def test_types_are_inferred_from_all_ranges(small, tmp_path):
    data = [[i, f"t\n{i}", i / 2, f"{i}", i * 10**10, "2001-02-03", "true", "NA"] for i in range(500)] + [[500, "x", "NA", "late", 1, "NA", "false", "NA"]]
    header = ["a", "b", "c", "d", "e", "f", "g", "h"]
    (tmp_path / "f.csv").write_text(text_of(data, header))
    df = tables.read_csv(small, str(tmp_path / "f.csv"))
    assert dict(df.dtypes) == {"a": "int", "b": "string", "c": "double", "d": "string", "e": "bigint", "f": "date", "g": "boolean", "h": "string"}
    assert df.schema == small.read.options(**tables.DIALECT, inferSchema=True).csv(str(tmp_path / "f.csv")).schema
    levels = tables.read_levels(small, str(tmp_path / "f.csv"), {"d": ["7", "late"]})
    assert levels.filter("d is not null").count() == 2


def test_split_sizes_have_units(small):
    for text, size in (("1000", 1000), ("2k", 2048), ("128MB", 128 << 20), ("134217728b", 128 << 20)):
        small.conf.set("spark.sql.files.maxPartitionBytes", text)
        assert split_csv.split_bytes(small) == size
    small.conf.set("spark.sql.files.maxPartitionBytes", "2k")


def test_states_of_ranges_are_checked(small, tmp_path):
    functions = small.createDataFrame(
        [("f", 0, True, False), ("f", 10, False, True), ("f", 20, True, False), ("f", 30, True, True), ("f", 40, False, True), ("g", 0, False, True)],
        "file string, start bigint, from_outside boolean, from_inside boolean",
    )
    got = {(r["file"], r["start"]): (r["opens"], r["closes"]) for r in split_csv.range_states(functions).collect()}
    assert got == {
        ("f", 0): (False, True), ("f", 10): (True, True), ("f", 20): (True, False), ("f", 30): (False, True), ("f", 40): (True, True), ("g", 0): (False, False),
    }


def test_random_states():
    rng = np.random.default_rng(5)
    for _ in range(200):
        outside, inside = rng.integers(2, size=(2, rng.integers(1, 9))).astype(bool)
        start = bool(rng.integers(2))
        state, want = start, []
        for o, i in zip(outside, inside):
            state = bool(i if state else o)
            want.append(state)
        assert split_csv._states(outside, inside, start).tolist() == want
