"""Fill-in-middle forms of texts, as a pipeline of Arrow's compute functions over whole batches.

A text is cut into units; two cuts part them into prefix, middle and suffix, and the parts are put
in another order behind markers. Every step works on a batch at once: units are split into a list
array, flattened with the index of their text, numbered within it, filtered by the part that they
belong to, put back into lists, and each list is joined. Cuts and form hang on the id alone, so a
task that runs again gives the same rows.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, ``plain`` is
the text as it stands: an empty text, one that holds a marker, and a tenth of the rest.

Cases: null texts count as empty; a null id is hashed as an empty one; repeated rows give repeated
results; texts of any length are one batch by themselves; extra columns, whatever their names, are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from natal.llm.common import extended

#: A unit is a run of letters or any other code point.
UNIT = r"([A-Za-z]+|[^A-Za-z])"
MARKERS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, how many keep their form, and how many of the others put the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes of text that are worked on at a time; a longer text is a batch by itself.
BATCH_BYTES = 4 << 20
PLAIN, PSM, SPM = "plain", "psm", "spm"


def _separator(texts: pa.Array) -> str:
    """A code point that no text holds."""
    return next(c for c in map(chr, range(1, 0xD800)) if not pc.any(pc.match_substring(texts, c)).as_py())


def units(texts: pa.Array) -> pa.ListArray:
    """The units of every text, and behind them one empty string."""
    mark = _separator(texts)
    return pc.split_pattern(pc.replace_substring_regex(texts, UNIT, r"\1" + mark), mark)


def _remainder(a: pa.Array, b) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _joined(flat: pa.Array, chosen: pa.Array, counts: pa.Array) -> pa.Array:
    """The chosen units, ``counts`` of them for each text, joined text by text."""
    ends = pc.cumulative_sum(counts)
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, pc.filter(flat, chosen)), pa.scalar("", pa.large_string()))


def transform_batch(texts: pa.Array, draws: list[pa.Array]) -> dict[str, pa.Array]:
    """Columns of the result for some texts and their four drawn numbers."""
    texts = pc.coalesce(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    lists = units(texts)
    n = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    first = lists.offsets.slice(0, len(lists)).cast(pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(first, parent))

    cuts = [_remainder(h, pc.add(n, 1)) for h in draws[:2]]
    one, two = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    below, inside = pc.less(ordinal, pc.take(one, parent)), pc.less(ordinal, pc.take(two, parent))
    within = pc.less(ordinal, pc.take(n, parent))  # not the empty string at the end
    prefix = _joined(flat, below, one)
    middle = _joined(flat, pc.and_not(inside, below), pc.subtract(two, one))
    suffix = _joined(flat, pc.and_not(within, inside), pc.subtract(n, two))

    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_remainder(draws[2], 100), 100 - PLAIN_PERCENT))
    for marker in MARKERS:
        plain = pc.or_(plain, pc.match_substring(texts, marker))
    form = pc.if_else(plain, PLAIN, pc.if_else(pc.less(_remainder(draws[3], 100), SPM_PERCENT), SPM, PSM))
    p, s, m, none = (pa.scalar(x, pa.large_string()) for x in (*MARKERS, ""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    length = lambda part: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(part).cast(pa.int64()))
    return {
        "n": n,
        "form": form,
        "prefix_chars": length(prefix),
        "middle_chars": length(middle),
        "output": pc.if_else(plain, texts, pc.if_else(pc.equal(form, SPM), spm, psm)),
    }


def restore_batch(output: pa.Array, form: pa.Array) -> pa.Array:
    """The exact texts. A marker stands once in an output, as no text that holds one is changed."""
    output = output.cast(pa.large_string())
    rows = pa.array(np.arange(len(output)))
    order, found = [], []
    for kind in (PLAIN, PSM, SPM):
        chosen = pc.fill_null(pc.equal(form, kind), kind == PLAIN)
        held = pc.filter(output, chosen)
        order.append(pc.filter(rows, chosen))
        if kind == PLAIN or not len(held):
            found.append(held)
            continue
        first, second = (PREFIX, SUFFIX) if kind == PSM else (SUFFIX, PREFIX)
        head, middle = _halves(held, MIDDLE)
        one, two = _halves(head, second)
        one = _halves(one, first)[1]
        prefix, suffix = (one, two) if kind == PSM else (two, one)
        found.append(pc.binary_join_element_wise(prefix, middle, suffix, pa.scalar("", pa.large_string())))
    return pc.take(pa.concat_arrays(found), pc.array_sort_indices(pa.concat_arrays(order)))


def _halves(texts: pa.Array, marker: str) -> tuple[pa.Array, pa.Array]:
    parts = pc.split_pattern(texts, marker)
    return pc.list_element(parts, 0), pc.list_element(parts, 1)


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``BATCH_BYTES`` of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < len(size):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + BATCH_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def transform(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of (doc_id, text).

    The four numbers are the first groups of eight hexadecimal digits of the SHA-256 of
    ``seed:doc_id``.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"_h{k}") for k in range(4)]
    rows = docs.select("doc_id", "text", digest.alias("_digest")).select("doc_id", "text", *h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, "text"):
                made = transform_batch(part.column("text"), [part.column(f"_h{k}") for k in range(4)])
                columns = {"doc_id": part.column("doc_id")} | made
                columns["output"] = columns["output"].cast(pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(made: DataFrame) -> DataFrame:
    """``made`` with ``restored``: the text rebuilt from ``output`` and ``form``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, "output"):
                text = restore_batch(part.column("output"), part.column("form")).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "restored"])

    return made.mapInArrow(run, extended(made, tuple(made.columns), restored=StringType()))


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns: the forms of all texts, and digests of output and restored text."""
    return restored(transform(docs)).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
