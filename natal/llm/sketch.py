"""Threshold-scaled sketches of documents, in DataFrame functions only.

A sketch keeps every hash of a five-word shingle that falls below a fixed fraction of the hash
range. The choice depends on the hash alone, so the sketch of a union is the union of sketches,
and containment of a short document in a very long one is estimated without bias from the hashes
they share. A text whose shingles all lie above the threshold keeps its smallest hash instead,
which is still mergeable: of several such sketches the smallest hash is kept, and it goes as soon
as a hash below the threshold comes in.

Cases: null text counts as empty; a text with fewer than five words is one shingle; a text
without words has an empty sketch and the fingerprint "0"; likeness of two empty sketches is 1,
of an empty and a filled one 0. Null ids sort last; rows with one id are ordered by the hash of
their text; repeated rows follow each other; an empty table gives an empty result; texts of any
length are sketched whole; extra columns, also of clashing names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from natal.llm.common import written

SHINGLE = 5
#: One of so many shingle hashes is kept where the caller names no other fraction.
SCALE = 8
#: The same for tables with texts of a few words, which need half of theirs for an estimate.
SHORT_SCALE = 2
#: Different rows per bucket of neighbours, and the most buckets whose bounds a task holds (2 MB).
#: Beyond a product of 65 million rows buckets grow with the input, in step, and sort with spilling.
BUCKET = 1_000
MOST_BUCKETS = 65_536
#: Keys drawn per bucket to place the bounds.
DRAWN = 4
#: Equal rows are folded where more than one row in so many, and more than a bucket, are equal.
EQUAL = 4_096
_NEGATIVE = -(1 << 63)


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_sketch(df: DataFrame, text: str, into: str, size: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Add ``into``: sorted distinct shingle hashes below the threshold, or else the smallest hash.

    Each step is a column of its own, so none is worked out again for each shingle.
    """
    last = F.greatest(F.size("_words") - (size - 1), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("_words", i, size)))
    df = df.withColumn("_words", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    df = df.withColumn("_words", F.when(F.size("_words") > 0, runs).otherwise(F.col("_words")))
    df = df.withColumn("_words", F.array_distinct("_words"))
    return df.withColumn(into, kept(F.col("_words"), scale)).drop("_words")


def kept(hashes: Column, scale: int = SCALE) -> Column:
    """What a sketch keeps of the distinct hashes of a document (a column that is worked out)."""
    if scale == 1:
        return F.sort_array(hashes)
    limit = F.lit(_NEGATIVE + (1 << 64) // scale)
    below = F.sort_array(F.filter(hashes, lambda h: h < limit))
    return F.when(F.array_min(hashes) < limit, below).otherwise(F.slice(F.sort_array(hashes), 1, 1))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of a union of documents from their sketches."""
    return kept(F.array_union(a, b), scale)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller sketch's document that the other holds, 0 to 1."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise((F.size(a) == F.size(b)).cast("double"))


def as_text(hashes: Column) -> Column:
    """A fingerprint as text: hexadecimal hashes, "0" for none."""
    shown = F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ".")
    return F.when(F.size(hashes) > 0, shown).otherwise("0")


def place_of(key: Column, bounds: Column) -> Column:
    """How many of the sorted array ``bounds`` are ``key`` or less, by binary search."""
    powers = F.array(*[F.lit(1 << k) for k in reversed(range((MOST_BUCKETS * 2).bit_length()))])
    start = F.struct(F.lit(0).alias("found"), key.alias("key"), bounds.alias("bounds"))

    def step(at: Column, power: Column) -> Column:
        fits = F.get(at["bounds"], at["found"] + power - 1) <= at["key"]
        found = F.when(fits, at["found"] + power).otherwise(at["found"])
        return F.struct(found.alias("found"), at["key"].alias("key"), at["bounds"].alias("bounds"))

    return F.aggregate(powers, start, step)["found"]


def order_key() -> Column:
    """Falling ids, null last, then the hash of the text, as one value that rises."""
    down = F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("bigint"))
    return F.struct(F.col("doc_id").isNull().alias("missing"), down.alias("down"), F.col("tie").alias("tie"))


def bounds_of(keys: DataFrame, rows: int) -> Column:
    """Keys that part ``keys`` into even buckets, from a sample that hangs on the keys alone.

    Hashes of texts are part of the key, so missing ids or one id on very many rows are parted too.
    """
    wanted = max(1, min(MOST_BUCKETS, rows // BUCKET))
    share = min(1.0, DRAWN * wanted / max(1, rows))
    drawn = keys.filter(F.pmod(F.xxhash64(F.lit("bound"), "doc_id", "tie"), F.lit(1 << 40)) < int(share * (1 << 40)))
    found = drawn.agg(F.sort_array(F.collect_list(order_key())).alias("drawn"))
    return found.select(F.filter("drawn", lambda _, k: k % DRAWN == DRAWN - 1)).scalar()


def with_next(docs: DataFrame, keys: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """Each row of (doc_id, tie, ...) with ``next_<column>`` of its successor, cyclically.

    Rows move once, to the bucket of their place. The first row of each bucket also goes, as a
    guest, to the end of the bucket before it; the very first row goes to the end of the last.
    """
    bounds = bounds_of(keys, keys.count())
    bucket = place_of(F.col("key"), F.col("bounds"))
    # Per bucket the key of its first row: a row per bound and one more.
    firsts = keys.select(order_key().alias("key"), bounds.alias("bounds")).select("key", bucket.alias("bucket"))
    firsts = firsts.groupBy("bucket").agg(F.min("key").alias("first_key"))
    before = F.lag("bucket").over(Window.orderBy("bucket"))
    hosts = firsts.withColumn("host", F.coalesce(before, F.max("bucket").over(Window.partitionBy())))
    rows = docs.select("doc_id", *carried, order_key().alias("key"), bounds.alias("bounds"))
    rows = rows.withColumn("bucket", bucket).drop("bounds").join(F.broadcast(hosts), "bucket")
    stays = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guest"))
    goes = F.struct(F.col("host").alias("at"), F.lit(True).alias("guest"))
    seats = F.when(F.col("key") == F.col("first_key"), F.array(stays, goes)).otherwise(F.array(stays))
    rows = rows.select("doc_id", *carried, "key", F.explode(seats).alias("seat"))
    order = Window.partitionBy("seat.at").orderBy("seat.guest", "key")
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in carried]
    return rows.select("doc_id", *carried, *following, "seat").filter("not seat.guest").drop("seat")


def folded(docs: DataFrame, keys: DataFrame, rows: int) -> DataFrame | None:
    """``docs`` with ``copies``, very many equal rows as one; None where no row has so many.

    At most EQUAL keys can have so many rows each, so they can be broadcast.
    """
    many = keys.filter(F.col("n") > max(BUCKET, rows // EQUAL)).select("doc_id", "tie", F.lit(True).alias("many"))
    if many.isEmpty():
        return None
    same = docs["doc_id"].eqNullSafe(many["doc_id"]) & (docs["tie"] == many["tie"])
    marked = docs.join(F.broadcast(many), same, "left").select(docs["doc_id"], "text", docs["tie"], "many")
    few = marked.filter("many is null").select("doc_id", "text", "tie", F.lit(1).cast("bigint").alias("copies"))
    one = marked.filter("many").groupBy("doc_id", "tie").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return few.unionByName(one)


def unfolded(rows: DataFrame) -> DataFrame:
    """Each row ``copies`` times; many copies of a row are dealt to tasks by pieces of a bucket."""
    pieces = F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / BUCKET))
    rows = rows.withColumn("piece", F.explode(pieces)).repartition("doc_id", "edited_sha256", "piece")
    here = F.least(F.lit(BUCKET), F.col("copies") - F.col("piece") * BUCKET).cast("int")
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1), here))).drop("_", "piece", "copies")


def fingerprints(docs: DataFrame, size: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("tie", F.xxhash64("text"))
    # Ids and hashes only, one row for equal rows.
    keys = written(own.groupBy("doc_id", "tie").agg(F.count("*").alias("n")), "sketch-keys")
    fold = folded(own, keys, keys.agg(F.sum("n")).first()[0] or 0)
    if fold is None:
        rows = with_next(with_sketch(own, "text", "own", size, scale), keys, ("text", "own"))
        return compared(rows, size, scale).drop("copies")
    rows = with_next(with_sketch(fold, "text", "own", size, scale), keys, ("text", "own", "copies"))
    # All copies but the last are followed by their like.
    like = F.struct((F.col("copies") - 1).alias("copies"), F.col("text").alias("next_text"), F.col("own").alias("next_own"))
    last = F.struct(F.lit(1).cast("bigint").alias("copies"), "next_text", "next_own")
    rows = rows.withColumn("follows", F.explode(F.filter(F.array(like, last), lambda f: f["copies"] > 0)))
    return unfolded(compared(rows.select("doc_id", "text", "own", "follows.*"), size, scale))


def compared(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Edited texts, their sketches and the likenesses."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.col("next_text"), F.lit(1), half),
    )
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited", edited)
    return with_sketch(rows, "edited", "other", size, scale).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        containment(F.col("own"), F.col("other")).alias("near_edited"),
        containment(F.col("own"), F.col("next_own")).alias("near_next"),
        *[c for c in ("copies",) if c in rows.columns],
    )
