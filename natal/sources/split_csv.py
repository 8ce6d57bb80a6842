"""Large CSV files with line breaks inside quoted fields, read by many tasks.

Where a line break ends a record depends on the quotes before it, back to the start of the file. A
prefix scan finds that out without reading the file in one piece:

1. Every byte range of a file (the splits of Spark's text source) is scanned by itself under both
   assumptions, that it starts outside or inside a quoted field. Its result is a function of two
   values, two bits per range. A line without a quote changes nothing, so only lines with one are
   looked at.
2. The functions are composed over the ranges of each file by windows over that small table, which
   gives the true state at the start of every range.
3. The ranges are read again. Lines are put together to records as they stream by, starting from
   the true state. Parts of a record that crosses a border between ranges meet in a small aggregate.
4. Records are parsed by Spark's own CSV expression.

A task reads many ranges one after the other, so that small ranges do not each cost the start of a task.
Within a task lines keep the order of the file, and both passes use the same splits; a range
whose state is missing raises an error. A quote opens a field only at its start; inside it quotes
are doubled; a quote anywhere else is a plain character. Lines end with \\n or \\r\\n. Line breaks inside
a field stay as they are. Empty lines are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from natal.operators.joins import BROADCAST_BYTES

#: A file goes by a hash of its path, which is checked to be its own.
FILE, START, LINE = "file", "start", "line"
#: A range is a few numbers; this many bytes are allowed for it when sizes are checked.
RANGE_BYTES = 64
#: Ranges that one task reads have about this many bytes together, or less, so that every core has some tasks.
TASK_BYTES = 16 << 20
TASKS_PER_CORE = 4
WHOLE, TAIL, THROUGH, HEAD = 0, 1, 2, 3
# One field that ends on its line, with the comma behind it; and a quoted field that does not end.
_FIELD = r'(?:[^",][^,]*|"(?:[^"]|"")*"(?:[^",][^,]*)?)?,'
_OPEN = r'"(?:[^"]|"")*'
#: Lines that begin outside a quoted field and end inside one.
OPENS = rf"^(?:{_FIELD})*{_OPEN}$"
#: Lines that begin inside a quoted field and end inside one, the same or a later one.
STAYS = rf'^(?:[^"]|"")*(?:"(?:[^",][^,]*)?,(?:{_FIELD})*{_OPEN})?$'


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the files, from their listing; no file is opened."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def needs_split(spark: SparkSession, path: str) -> bool:
    """Whether a file is larger than one split, so that reading it whole would be one long task."""
    largest = file_sizes(spark, path).agg(F.max("length")).first()[0] or 0
    return largest > split_bytes(spark)


def split_bytes(spark: SparkSession) -> int:
    """The session's bytes of a split, which may be written with a unit."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def read_tasks(spark: SparkSession, size: int) -> int:
    """Tasks that read files of ``size`` bytes together."""
    return max(-(-size // TASK_BYTES), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def _lines(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """(file, start, line), by at most ``tasks`` tasks, each of which takes its ranges one by one."""
    at = F.col("_metadata")
    # The line separator is fixed, so that \r stays with its line.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64(at["file_path"]).alias(FILE), at["file_block_start"].alias(START), F.col("value").alias(LINE)
    )
    return lines if tasks is None else lines.coalesce(tasks)


def transitions(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line ends inside a quoted field, when begun outside and when begun inside one."""
    def test(pattern):
        return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)

    return test(f"(?s){OPENS}"), test(f"(?s){STAYS}")


def _states(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """State after every line, from the state before the first: a composition of two-value functions.

    A line is constant, keeps the state or flips it, so the state after it is that of the last
    constant line (or the start), flipped as often as lines have flipped it since.
    """
    n = len(outside)
    constant, flips = outside == inside, outside & ~inside
    last = np.maximum.accumulate(np.where(constant, np.arange(n), -1))
    flipped = np.cumsum(flips)
    base = np.where(last >= 0, outside[np.maximum(last, 0)], start)
    since = flipped - np.where(last >= 0, flipped[np.maximum(last, 0)], 0)
    return base ^ (since % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Parts of a batch that come from one range."""
    if not batch.num_rows:
        return
    file, start = (batch.column(c).to_numpy() for c in (FILE, START))
    edges = np.flatnonzero(np.r_[True, (start[1:] != start[:-1]) | (file[1:] != file[:-1]), True])
    for a, b in zip(edges, edges[1:]):
        yield int(file[a]), int(start[a]), batch.slice(a, b - a)


def range_functions(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """(file, start, from_outside, from_inside): the state at the end of every range."""

    def run(batches):
        now, state = None, (False, True)
        for batch in batches:
            for file, start, part in _runs(batch):
                if (file, start) != now:
                    if now is not None:
                        yield _row(now, state)
                    now, state = (file, start), (False, True)
                outside, inside = transitions(part.column(LINE).filter(pc.match_substring(part.column(LINE), '"')))
                if len(outside):
                    state = tuple(bool(_states(outside, inside, s)[-1]) for s in state)
        if now is not None:
            yield _row(now, state)

    def _row(now, state):
        return pa.RecordBatch.from_pydict({FILE: [now[0]], START: [now[1]], "from_outside": [state[0]], "from_inside": [state[1]]})

    # Lines without a quote change nothing; an empty text stands for them, so that ranges stay known.
    marked = _lines(spark, path, tasks).withColumn(LINE, F.when(F.contains(LINE, F.lit('"')), F.col(LINE)).otherwise(""))
    return marked.mapInArrow(run, f"{FILE} bigint, {START} bigint, from_outside boolean, from_inside boolean")


def range_states(functions: DataFrame) -> DataFrame:
    """(file, start, opens, closes): whether each range begins and ends inside a quoted field.

    The same composition as within a range, over the ranges of a file.
    """
    before = Window.partitionBy(FILE).orderBy(START).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(FILE).orderBy(START).rowsBetween(Window.unboundedPreceding, 0)
    constant = F.col("from_outside") == F.col("from_inside")
    flips = F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int"))
    counted = functions.withColumn("flips", flips.over(upto))
    known = F.when(constant, F.struct("from_outside", "flips"))
    return (
        counted.withColumns({"last": F.last(known, ignorenulls=True).over(before), "flipped": F.coalesce(F.last("flips").over(before), F.lit(0))})
        .withColumn("base", F.coalesce(F.col("last.from_outside"), F.lit(False)))
        .withColumn("odd", (F.col("flipped") - F.coalesce(F.col("last.flips"), F.lit(0))) % 2 == 1)
        .withColumn("opens", F.col("base") != F.col("odd"))
        .withColumn("closes", F.when(F.col("opens"), F.col("from_inside")).otherwise(F.col("from_outside")))
        .select(FILE, START, "opens", "closes")
    )


class _Joiner:
    """Puts the lines of one range together to records."""

    def __init__(self, opens: bool, first_of_file: bool):
        self.state = opens  # inside a quoted field
        self.head = opens  # still in a record of an earlier range
        self.skip = first_of_file  # the header
        self.held: list[str] = []  # lines of a record that is not complete

    def add(self, lines: pa.Array) -> tuple[list[pa.Array], str | None]:
        """Complete records among ``lines``, and the end of the record that came in, if it is here."""
        quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
        if not quoted.any() and not self.state:
            records, head = [lines], None
        else:
            outside, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
            if quoted.any():
                outside[quoted], inside[quoted] = transitions(lines.filter(pa.array(quoted)))
            after = _states(outside, inside, self.state)
            self.state = bool(after[-1])
            records, head = self._joined(lines, np.flatnonzero(~after))
        if self.skip and records:
            records = [records[0].slice(1), *records[1:]]
            self.skip = False
        return records, head

    def _joined(self, lines: pa.Array, ends: np.ndarray) -> tuple[list[pa.Array], str | None]:
        head, out = None, []
        if not len(ends):
            self.held += lines.to_pylist()
            return out, head
        at = 0
        if self.held or self.head:
            first = "\n".join(self.held + lines.slice(0, int(ends[0]) + 1).to_pylist())
            self.held, at = [], 1
            if self.head:
                self.head, head = False, first
            else:
                out.append(pa.array([first], pa.large_string()))
        offsets = ends + 1 if at else np.r_[0, ends + 1]
        if len(offsets) > 1:
            inner = lines.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).cast(pa.large_string())
            if len(offsets) - 1 == len(inner):
                out.append(inner)  # every record is one line
            else:
                lists = pa.LargeListArray.from_arrays(pa.array(offsets - offsets[0], pa.int64()), inner)
                out.append(pc.binary_join(lists, pa.scalar("\n", pa.large_string())))
        rest = int(ends[-1]) + 1
        if rest < len(lines):
            self.held = lines.slice(rest).to_pylist()
        return out, head

    def finish(self) -> tuple[int, str] | None:
        """The part of a record that is still open at the end of the range."""
        if not self.held or self.skip:  # a header that goes on is no record
            return None
        return (THROUGH if self.head else TAIL), "\n".join(self.held)


_PARTS = f"{FILE} bigint, {START} bigint, part int, record string"


def _records(lines: DataFrame, wholes: bool, fragments: bool) -> DataFrame:
    """(file, start, part, record): whole records, or the parts of records that cross ranges."""

    def rows(now, part, records):
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, now[0])), pa.array(np.full(n, now[1])), pa.array(np.full(n, part, np.int32)), records.cast(pa.string())],
            [FILE, START, "part", "record"],
        )

    def end(now, joiner):
        left = joiner.finish()
        if fragments and left is not None:
            yield rows(now, left[0], pa.array([left[1]]))

    def run(batches):
        now = joiner = None
        for batch in batches:
            for file, start, part in _runs(batch):
                if (file, start) != now:
                    if now is not None:
                        yield from end(now, joiner)
                    now, joiner = (file, start), _Joiner(part.column("opens")[0].as_py(), start == 0)
                records, head = joiner.add(part.column(LINE))
                if wholes:
                    yield from (rows(now, WHOLE, r) for r in records if len(r))
                if fragments and head is not None:
                    yield rows(now, HEAD, pa.array([head]))
        if now is not None:
            yield from end(now, joiner)

    return lines.mapInArrow(run, _PARTS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the text of every record of some files, headers and empty lines left out."""
    names = file_sizes(spark, path).agg(
        F.count("*").alias("n"), F.count_distinct(F.xxhash64("path")).alias("hashes"), F.sum("length").alias("bytes")
    ).first()
    if names["n"] != names["hashes"]:
        raise ValueError("two paths share a hash; read the files in two parts")
    tasks = read_tasks(spark, names["bytes"] or 0)
    functions = range_functions(spark, path, tasks).persist()
    try:
        states = range_states(functions)
        found = states.agg(F.count("*").alias("n"), F.count_if(F.col("opens") | F.col("closes")).alias("inside")).first()
        if found["n"] * RANGE_BYTES > BROADCAST_BYTES:
            raise ValueError(f"{found['n']} ranges; raise spark.sql.files.maxPartitionBytes")
        # One row per range, kept as a small local table; at most BROADCAST_BYTES by the line above.
        held = spark.createDataFrame(states.toArrow())
    finally:
        functions.unpersist()
    known = F.when(F.col("opens").isNull(), F.raise_error(F.lit("the ranges of the files have changed"))).otherwise(F.col("opens"))
    lines = _lines(spark, path, tasks).join(F.broadcast(held.select(FILE, START, "opens")), [FILE, START], "left").withColumn("opens", known)
    records = _records(lines, wholes=True, fragments=False)
    if found["inside"]:
        touched = held.filter("opens or closes").select(FILE, START)
        parts = _records(lines.join(F.broadcast(touched), [FILE, START], "left_semi"), wholes=False, fragments=True)
        records = records.select("record").unionByName(crossing(parts))
    return records.select("record").filter(F.regexp_replace("record", "\r$", "") != "")


def crossing(parts: DataFrame) -> DataFrame:
    """Records that cross ranges, from their parts: a tail, whole ranges, and a head."""
    order = Window.partitionBy(FILE).orderBy(START, F.desc("part"))  # in one range the head comes before the tail
    number = F.count(F.when(F.col("part") == TAIL, 1)).over(order)
    pieces = F.array_sort(F.collect_list(F.struct(START, "record")))
    return (
        parts.withColumn("number", number)
        .groupBy(FILE, "number")
        .agg(F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"))
        .filter("number > 0")  # parts before any tail belong to a header that crosses ranges
        .select("record")
    )


def parsed(records: DataFrame, schema: T.StructType, dialect: dict) -> DataFrame:
    """Columns of the records."""
    options = {k: str(v) for k, v in dialect.items() if k not in ("header", "multiLine")}
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    return records.select(F.from_csv(F.regexp_replace("record", "\r$", ""), ddl, options).alias("_r")).select("_r.*")


def inferred(text: DataFrame) -> T.StructType:
    """Types that all values of the text columns fit: integer, bigint, double, date, timestamp, boolean, or text.

    One aggregate over all columns.
    """
    tests = {
        "int": lambda c: c.try_cast("int").isNotNull() & c.rlike(r"^\s*[+-]?\d+\s*$"),
        "bigint": lambda c: c.try_cast("bigint").isNotNull() & c.rlike(r"^\s*[+-]?\d+\s*$"),
        "double": lambda c: c.try_cast("double").isNotNull(),
        "date": lambda c: c.try_cast("date").isNotNull() & c.rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "timestamp": lambda c: c.try_cast("timestamp").isNotNull() & c.rlike(r"^\d{4}-\d{2}-\d{2}"),
        "boolean": lambda c: F.lower(c).isin("true", "false"),
    }

    def column(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.struct(F.count(c).alias("n"), *[F.count(F.when(t(c), 1)).alias(k) for k, t in tests.items()])

    row = text.agg(*[column(n).alias(f"c{i}") for i, n in enumerate(text.columns)]).first()
    kinds = [next((k for k in tests if r["n"] and r[k] == r["n"]), "string") for r in row]
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(text.columns, kinds)])
