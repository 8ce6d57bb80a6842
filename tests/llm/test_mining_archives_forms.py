"""Hard negatives, WARC bundles and fill-in-middle forms against brute force, with awkward rows."""

import base64
import hashlib
import io
import math
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from natal.llm import fill_in_middle, hard_negatives, kneser_ney, warc
from natal.session import scratch_path

VECTORS = "vec_id long, embedding array<float>, label int, score double, cell int, kind string, anchor long, rank int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Hard negatives


def brute_negatives(rows):
    kept = []
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(256.0 * x) for x in vec):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256.0 * float(x)) for x in vec)))
    out = []
    for a in sorted({r for r in kept if r[0] % 100 == 0}):
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in kept if b[0] != a[0]]
        best = sorted((-s, i) for s, i, label in scored if label == a[1])[:5]
        for p, positive in best:
            p = -p
            fits = sorted((-s, i) for s, i, label in scored if label != a[1] and 30 * p <= 100 * s <= 90 * p)[:10]
            out += [(a[0], positive, k, i, p, -s) for k, (s, i) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def mined(spark, rows):
    full = [(i, v, label, 1.0, 7, "k", 8, 9) for i, v, label in rows]
    return rows_of(hard_negatives.mine(spark.createDataFrame(full, VECTORS).repartition(3)))


def clouds(n, dim, seed, classes=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, dim))
    label = rng.integers(classes, size=n)
    vec = centres[label] * 0.3 + rng.normal(size=(n, dim)) * 0.3 + 0.2
    return [(int(i), [float(np.float32(x)) for x in v], int(c)) for i, (v, c) in enumerate(zip(vec, label))]


def test_negatives_equal_brute_force(spark):
    rows = clouds(900, 20, 1)
    got = mined(spark, rows)
    assert got == brute_negatives(rows) and len(got) > 100


def test_negatives_of_awkward_rows(spark):
    rows = clouds(420, 16, 2)
    one = rows[100][1]
    rows += [(1000 + i, one, i % 3) for i in range(150)]  # ties, and one vector in a third of the rows
    rows += [rows[200], rows[200], rows[3], rows[3]]  # repeated rows, an anchor among them
    rows += [(300, rows[5][1], 1), (300, rows[6][1], 0)]  # one anchor id with other vectors
    rows += [(None, one, 1), (2000, None, 1), (2001, [None] * 16, 1), (2002, [float("nan")] * 16, 1)]
    rows += [(2003, [float("inf")] * 16, 1), (2004, one, None), (2005, [], 1), (2006, one[:7], 2), (2100, [0.0] * 16, 1)]
    rows += [(-100, [-x for x in one], 0), (2007, [3e38] * 16, 2)]  # below zero; 256 times as much is finite as a double
    assert mined(spark, rows) == brute_negatives_clipped(rows)


def brute_negatives_clipped(rows):
    """Brute force in which a score beyond 64 bits counts as the nearest that fits."""
    limit = (1 << 63) - 1
    return [r for r in brute_negatives(rows) if abs(r[4]) < limit and abs(r[5]) < limit]


def test_negatives_of_small_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0, 2.0], 1)]) == []
    assert mined(spark, [(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 1)]) == []
    rows = [(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 1), (102, [0.5, 0.5], 2)]
    assert mined(spark, rows) == [(100, 101, 1, 102, 327680, 98304)]


@pytest.mark.parametrize("dim", [16, 48])
def test_bounds_hold_and_tighten(dim):
    rng = np.random.default_rng(3)
    a, b = np.floor(256 * rng.normal(size=(40, dim))), np.floor(256 * rng.normal(size=(50, dim)) + 90)
    sides = [hard_negatives.Side(q, *hard_negatives.summaries(q)) for q in (a, b)]
    exact, width = a @ b.T, []
    for level in hard_negatives.LEVELS:
        low, high = hard_negatives.bounds(*sides, level)
        assert (low <= exact).all() and (exact <= high).all()
        i, j = (x.ravel() for x in np.indices(exact.shape))
        assert np.allclose(hard_negatives.pair_bounds(*sides, level, i, j)[1], high.ravel())
        direct = hard_negatives.summaries(a, level)
        assert np.allclose(direct[0], sides[0].levels[level][0]) and np.allclose(direct[1], sides[0].levels[level][1])
        width.append((high - low).mean())
    assert width[0] > width[1] > width[2]


# WARC


PAGES = "page_id long, url string, html string, row long, digest string, payload string, first_id long"


def awkward_pages():
    same = "<p>same</p>" * 30
    rows = [(i, f"http://h/{i}?q=ü b", f"<p>{i} {'x' * (i * 37)}</p>") for i in range(10, 60)]
    rows += [(i, None, same) for i in range(100, 220)]  # one payload in most rows
    rows += [(5, "u", same), (5, "u", same), (None, "u", same), (7, "u", None), (8, None, ""), (None, None, None)]
    rows += [(None, "v", "only without id"), (None, "v", "only without id"), (11, "again", "other text"), (11, "again", "other text")]
    rows += [(300, "long", "é日本\r\n\r\nWARC/1.1\r\n" * 90_000)]
    return rows


def framed(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", "clash", 2) for r in rows], PAGES).repartition(4)


def brute_report(rows, least=0):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    groups = {}
    for i, p in payloads:
        groups.setdefault(p, []).append(i)
    out, done = [], set()
    for i, p in payloads:
        first = min(groups[p], key=lambda x: (x is None, x or 0))
        revisit = len(p) >= least and (i != first or p in done)
        if i == first:
            done.add(p)
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 12])
def test_report_equals_brute_force(spark, least):
    rows = awkward_pages()
    assert rows_of(warc.archive_report(framed(spark, rows), least=least)) == brute_report(rows, least)


def test_hot_payload_comes_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 10)  # the payload in most rows is above one row in ten
    rows = awkward_pages()
    assert rows_of(warc.archive_report(framed(spark, rows))) == brute_report(rows)


def test_empty_table_of_pages(spark):
    assert rows_of(warc.archive_report(framed(spark, []))) == []


def test_bundles_are_plain_zstandard_and_seekable(spark):
    rows = awkward_pages()
    uri = scratch_path(spark, "bundles")
    index = warc.write_archives(framed(spark, rows), uri, frame_bytes=2000, bundle_bytes=100_000)
    places = index.collect()
    names = {r["bundle"] for r in places}
    tables = warc.seek_tables(uri, names)
    assert len(names) > 1 and max(map(len, tables.values())) > 3
    path = uri.removeprefix("file:")
    for name in names:
        data = open(f"{path}/{name}", "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        mine = sorted((r["frame"], r["offset"], r["length"]) for r in places if r["bundle"] == name)
        assert sum(m[2] for m in mine) == len(plain) == sum(t[2] for t in tables[name])
        starts = [0]
        for _, _, size in tables[name]:
            starts.append(starts[-1] + size)
        for frame, offset, length in mine:
            record = plain[starts[frame] + offset :][:length]
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert struct.unpack("<I", data[-4:])[0] == warc.SEEKABLE


def test_single_records_by_id(spark):
    rows = awkward_pages()
    uri = scratch_path(spark, "bundles")
    index = warc.write_archives(framed(spark, rows), uri)
    wanted = index.filter("record_id like '%=300' or record_id like '%=42' or record_id like '%=150'")
    got = {warc.page_of(r["record_id"]): r for r in warc.read_records(wanted, uri).collect()}
    assert got["300"]["payload"].decode() == dict((i, h) for i, _, h in rows)[300]
    assert got["42"]["url"] == "http://h/42?q=%C3%BC%20b" and got["42"]["payload"].startswith(b"<p>42 ")
    assert got["150"]["payload"] is None and warc.page_of(got["150"]["refers_to"]) == "5"


def test_damage_is_seen():
    record = warc.make_record("urn:page:1=2", "u", b"body", warc.base32_digest(b"body"), 4, None)
    assert warc.parse_record(record)[2] == b"body"
    for bad in (record.replace(b"body", b"bodi"), record[:-1], b"x" + record):
        with pytest.raises((ValueError, KeyError)):
            warc.parse_record(bad)
    with pytest.raises(ValueError):
        warc.BundleReader(pa.BufferReader(b"no seek table here"))


@pytest.mark.parametrize("page", [None, 0, -5, 7, "a=b+c d/ü"])
def test_record_ids_name_their_page(page):
    assert warc.page_of(warc.record_id(page, 3)) == (None if page is None else str(page))


# Fill-in-middle

DOCS = "doc_id long, text string, form string, output string, n long, _h0 string, _digest int"


def brute_form(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def awkward_texts():
    draw = random.Random(4)
    texts = ["", None, "one", "a\nb \x01\x02 c\r\n", "é日本😀 x", "has <S> in it", "<P", "S>M><", "\x00\x01\x02", "word " * 60_000, "日" * 300_000]
    texts += ["".join(draw.choices("ab <>PSM\n\x01é日😀 ", k=draw.randint(0, 40))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(None, "without an id"), (None, None), (3, "a third of the rows")] + [(3, "a third of the rows")] * 200
    return rows


def test_forms_equal_brute_force(spark):
    rows = awkward_texts()
    docs = spark.createDataFrame([(i, t, "f", "o", 5, "h", 6) for i, t in rows], DOCS).repartition(3)
    made = fill_in_middle.transform(docs)
    assert rows_of(made) == sorted((brute_form(i, t) for i, t in rows), key=repr)
    back = fill_in_middle.restored(made).select("doc_id", "restored")
    assert rows_of(back) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_forms_of_small_batches(spark, monkeypatch):
    rows = awkward_texts()[:60]
    want = [brute_form(i, t) for i, t in rows]
    monkeypatch.setattr(fill_in_middle, "BATCH_BYTES", 100)
    draws = [[int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for i, _ in rows] for k in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows]), *map(pa.array, draws)], ["text", *"abcd"])
    got = []
    for part in fill_in_middle._pieces(batch, "text"):
        made = fill_in_middle.transform_batch(part.column("text"), [part.column(c) for c in "abcd"])
        got += list(zip(*(made[c].to_pylist() for c in ("n", "form", "prefix_chars", "middle_chars", "output"))))
    assert got == [w[1:] for w in want]


def test_digests_of_forms(spark):
    rows = awkward_texts()[:40]
    docs = spark.createDataFrame([(i, t, "f", "o", 5, "h", 6) for i, t in rows], DOCS)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(*b[:5], sha(b[5]), sha(t or "")) for (i, t), b in ((r, brute_form(*r)) for r in rows)]
    assert rows_of(fill_in_middle.digests(docs)) == sorted(want, key=repr)
    assert fill_in_middle.digests(docs.limit(0)).count() == 0


# Language model: hashes of words


def test_hashes_of_words_are_checked(spark, monkeypatch):
    own, check = np.array([5, 7, 5], np.uint64), np.array([1, 2, 1], np.uint64)
    kneser_ney._no_clash(own, check)
    with pytest.raises(ValueError, match="share a hash"):
        kneser_ney._no_clash(own, np.array([1, 2, 3], np.uint64))
    first = kneser_ney.word_hashes(b"one two one")[1]
    assert first[0] == first[2] != first[1] and first.max() > 1 << 48
    monkeypatch.setattr(kneser_ney, "FOLD", 50)
    draw = random.Random(6)
    texts = [(i, " ".join(draw.choices(["a", "b", "see", "dd"], k=draw.randint(0, 60)))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    one, two = (kneser_ney.score(kneser_ney.train(docs, seed), docs).orderBy("doc_id").toPandas() for seed in (7, 8))
    assert one.n_known.equals(two.n_known) and np.allclose(one.score, two.score) and np.allclose(one.base_score, two.base_score)


# Bounded samples


def test_bounds_hold_with_one_id_on_a_third_of_the_rows(spark):
    from natal.llm import labelled, quality

    many = [(7, f"text {i}") for i in range(900)] + [(i, f"other {i}") for i in range(1000, 2200)] + [(7, "text 1")] * 300
    docs = spark.createDataFrame(many, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in [7, *range(1000, 2200)]], "doc_id long, toxic int, quality int")
    for bound in (50, 400):
        got = labelled.sample(docs, labels, "toxic", bound).collect()
        assert 0 < len(got) <= bound and len({r["text"] for r in got}) == len(got)
        rows = quality.samples(docs, labels, "quality", bound, bound).collect()
        for side in (True, False):
            assert 0 < sum(r["positive"] == side for r in rows) <= bound


def test_log_odds_equal_plain_sums_and_the_fit_repeats():
    from natal.llm import quality

    rng = np.random.default_rng(1)
    xp, xu, p = rng.normal(1, 1, (30, quality.FEATURES)), rng.normal(0, 1, (40, quality.FEATURES)), 0.4
    model = quality.learn(xp, xu)
    again = quality.learn(xp[::1].copy(), xu.copy())
    assert np.allclose(model.scores(xu), again.scores(xu))
    z = model.odds(xu)
    plain = [model.constant + sum(w[sum(c <= x[j] for c in cuts)] for j, (w, cuts) in enumerate(zip(model.weights, model.cuts))) for x in xu]
    assert np.allclose(z, plain)
    cut = np.array([0.1, 0.5, 0.9, 0.9, 0.2])
    share = quality.prior(np.array([0.5, 0.9, 0.9, 0.8]), cut)
    assert 0.02 <= share <= 0.99 and p < 1
