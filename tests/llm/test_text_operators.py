"""Text operators against brute force, with awkward rows: nulls, empty and long texts, repeats."""

import collections
import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from natal.llm import bpe, components, kneser_ney, labelled, multi_index, packing, quality, queries, simhash, sketch, token_rollup, toxicity
from natal.llm.common import tokenizer_path, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, fp string, ids int, label string"


def words(n, seed, letters="etaoinshr"):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(letters, k=draw.randint(1, 7))) for _ in range(n))


def awkward():
    base = words(120, 1)
    texts = [
        (1, base), (2, None), (3, ""), (4, " \t\n "), (5, words(9000, 2)), (6, base), (6, base), (7, base + " more"),
        (8, "one"), (9, "one two"), (10, "Ünïcödé ß 日本語 😀 é x"), (11, "A\nb\r\n  c   d"), (12, "x" * 20000),
        (None, words(40, 3)), (None, None), (13, words(50, 4)), (14, words(50, 4) + "."), (15, "<|endoftext|> a<|endoftext|>"),
    ]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1, "fp", 3, "y") for i, t in awkward()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(tokenizer_path())


# BPE


def test_codec_equals_library(library):
    codec, draw = bpe.Codec(tokenizer_path()), random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "<|endoftext|>", "1", "22", "é", "ß", " ", "\x1c", "\x85", "日本", "!", "..", "the",
             " \n", " ", "😀", "ve", "'ll", "<|endof", "A", "‍", "\r\n", "ԥ", "՘"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 9))) for _ in range(4000)]
    texts += ["a" * 5000, " " * 999, "x" + " " * 50 + "\n" * 50 + "y", "日本語" * 500, words(2000, 9), "".join(map(chr, range(1, 3000)))]
    for t in texts:
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want, t[:80]
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_forced_boundaries_cut_only_where_no_token_spans():
    codec = bpe.Codec(tokenizer_path())
    piece = "zqༀxé".encode()
    fragments = codec.forced(piece)
    assert b"".join(fragments) == piece and len(fragments) > 1
    for a, b in zip(fragments, fragments[1:]):
        assert not any(a[-1:] + b[:1] in token for token in codec.table)


def test_both_merge_loops_agree():
    codec, draw = bpe.Codec(tokenizer_path()), random.Random(6)
    for _ in range(300):
        ids = [codec.byte_ids[b] for b in "".join(draw.choices("thean ior", k=draw.randint(1, 60))).encode()]
        assert codec._merge_few(list(ids)) == codec._merge_many(list(ids))


def test_round_trip_query(docs, library):
    got = bpe.round_trip_digests(docs).collect()
    want = collections.Counter()
    for i, t in awkward():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_bpe_of_nothing(no_docs):
    assert bpe.round_trip_digests(no_docs).count() == 0


# Packing


def test_fullest_is_the_best_sum():
    draw = random.Random(7)
    for _ in range(60):
        counts = {draw.randint(1, 20): draw.randint(1, 3) for _ in range(4)}
        room = draw.randint(0, 40)
        chosen = packing.fullest(counts, room)
        sums = {sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*(range(c + 1) for c in counts.values()))}
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in chosen.items())


def test_plan_uses_every_length_once():
    draw = random.Random(8)
    histogram = collections.Counter(draw.randint(1, 100) for _ in range(3000))
    bins = packing.plan(histogram, 100)
    used = collections.Counter()
    for times, chosen in bins:
        assert sum(n * k for n, k in chosen.items()) <= 100
        used.update({n: times * k for n, k in chosen.items()})
    assert used == histogram
    room, opened = collections.Counter(), 0  # best-fit decreasing
    for n in sorted(histogram.elements(), reverse=True):
        best = min((r for r in room if r >= n and room[r]), default=None)
        opened += best is None
        if best is not None:
            room[best] -= 1
        room[(best or 100) - n] += 1
    assert sum(t for t, _ in bins) <= opened


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packed_pieces(docs, library, capacity):
    got = packing.pack(docs, capacity).toPandas()
    texts = collections.defaultdict(list)
    for i, t in awkward():
        texts[i].append(library.encode(t or "", add_special_tokens=False).ids + [2])
    assert got.length.sum() == sum(len(x) for v in texts.values() for x in v)
    for r in got.itertuples():
        key = None if pd.isna(r.doc_id) else int(r.doc_id)
        crcs = [zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in texts[key]]
        assert r.ids_crc32 in crcs
        assert r.piece == 0 or r.length == capacity
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
        assert g.length.sum() <= capacity
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / capacity) + 2


def test_nothing_to_pack(no_docs):
    assert packing.pack(no_docs).count() == 0


# Rollups


ROWS = "doc_id long, source string, lang string, tokenizer string, tokens long"


def test_rollup(spark, tmp_path):
    first = spark.createDataFrame([(1, "a", "en", "t", 5), (2, "a", None, "t", None), (3, None, "en", "t", 7), (3, None, "en", "t", 7)], ROWS)
    later = spark.createDataFrame([(1, "b", "en", "t", 6), (2, "a", None, "t", 3), (3, None, "en", "t", 7), (3, None, "en", "t", 7)], ROWS)
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    assert r.commit("1", token_rollup.inserts(first))
    assert not r.commit("1", token_rollup.inserts(first))
    (tmp_path / "r" / ".batch=9-half" / "data").mkdir(parents=True)  # left by a writer that died
    assert r.commit("2", token_rollup.revisions(first, later))
    want = {("b", "en", "t", 1, 6), ("a", None, "t", 1, 3), (None, "en", "t", 2, 14)}
    assert {tuple(x) for x in r.totals().collect()} == want
    assert r.compact() and not r.compact()
    assert len(r.committed()) == 1
    assert not r.commit("2", token_rollup.revisions(first, later))
    assert {tuple(x) for x in r.totals().collect()} == want
    assert r.commit("3", token_rollup.deletes(later.filter("doc_id = 1")))
    assert r.commit("4", token_rollup.inserts(later.limit(0)))
    assert r.compact() and not r.commit("1", token_rollup.inserts(first))
    assert {tuple(x) for x in r.totals().collect()} == want - {("b", "en", "t", 1, 6)}


def test_racing_writers_commit_once(spark, tmp_path):
    rows = token_rollup.inserts(spark.createDataFrame([(1, "a", "en", "t", 5)], ROWS))
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    for spare in (".one", ".two"):
        rows.write.parquet(str(tmp_path / "r" / spare / "data"))
    assert r._publish(".one", "batch=1") and not r._publish(".two", "batch=1")
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "t", 1, 5)]


def written_documents(spark, rows, folder):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


NOTICED = [
    (20, "a line of text here\nAll Rights Reserved by none\nand one more line", "en", "web"),
    (20, "a line of text here\nAll Rights Reserved by none\nand one more line", "en", "web"),
    (21, "licensed under nothing", "de", "web"),
    (22, "four words and more than that", None, None),
]


def test_rollup_of_token_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, t, "en", "s") for i, t in awkward()] + NOTICED
    folder = written_documents(spark, [(i, t, lang, source, 0, "clash", 1, "fp", 3, "y") for i, t, lang, source in rows], tmp_path)
    found = queries.token_counts_bpe(spark, folder)
    coder = Tokenizer.from_file(tokenizer_path())
    want = collections.defaultdict(lambda: [0, 0])
    for _, text, lang, source in rows:
        lines = [x for x in (text or "").split("\n") if not any(n in x.lower() for n in queries._NOTICES)]
        n = len(coder.encode("\n".join(lines), add_special_tokens=False).ids)
        if n >= 5:
            group = want[source and source.upper(), lang, queries.BPE_VERSION]
            group[0] += 1
            group[1] += n
    assert {tuple(r)[:3]: list(r)[3:] for r in found.collect()} == dict(want)
    assert (None, None, queries.BPE_VERSION) in want and ("WEB", "en", queries.BPE_VERSION) in want


def test_counts_equal_those_of_the_round_trip(spark, docs):
    counted = token_rollup.with_token_counts(docs, {"row": "text"})
    assert "text" not in counted.columns and counted.columns.count("row") == 1
    n = bpe.round_trip_digests(docs).agg(F.sum("n_tokens")).first()[0]
    assert counted.agg(F.sum("row")).first()[0] == n
    assert counted.filter("row is null").count() == docs.filter("text is null").count() > 0


def test_rollups_of_an_empty_table(spark, tmp_path):
    folder = written_documents(spark, [], tmp_path)
    for query in (queries.op4_token_counts, queries.token_counts_bpe):
        found = query(spark, folder)
        assert found.columns == ["source", "lang", "tokenizer", "documents", "tokens"] and found.count() == 0


# Labels, toxicity, quality


def labelled_docs(spark, n=900):
    """Every third text holds insults; every fifth is junk."""
    rows, labels = [], []
    for i in range(n):
        t, toxic, junk = words(30, 100 + i), int(i % 3 == 0), int(i % 5 == 0)
        if toxic:
            t = t.replace(" ", " zanko you ", 2) + f" vorp{i % 7}"
        if junk:
            t = " ".join(w + "$$$" for w in t.split())
        rows.append((i, t, "en", "s", len(t), "clash", 1, "fp", 3, "y"))
        labels.append((i, 1 - junk, toxic))
    rows += [(n + k, t, "en", "s", 0, "clash", 1, "fp", 3, "y") for k, t in enumerate(["", None, words(20000, 5)])]
    rows += [(None, None, None, None, None, None, None, None, None, None), rows[5], rows[5]]
    labels += [(None, 1, 1), (4, None, None), (10_000_000, 1, 1), (7, 1, 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def corpus(spark):
    return labelled_docs(spark)


def test_sample_leaves_held_out_rows_alone(corpus):
    d, labels = corpus
    d = d.withColumn("text", d["doc_id"].cast("string"))
    got = labelled.sample(d, labels, "toxic", 10_000).toPandas()
    ids = got.text.astype(int)
    assert len(ids) > 600 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert set(got.fold) == {0, 1, 2}
    assert labelled.sample(d, labels, "toxic", 50).select("text").distinct().count() <= 50


@pytest.mark.parametrize("operator,label,threshold", [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_scores_of_held_out_rows(corpus, operator, label, threshold):
    d, labels = corpus
    got = operator.score_documents(d, labels).toPandas()
    assert len(got) == d.count() and got.score.between(0, 1).all() and not got.score.isna().any()
    assert (got.predicted == (got.score >= threshold)).all()
    known = got.dropna(subset=["doc_id"])
    assert (known.held_out == [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in known.doc_id]).all()
    truth = labels.dropna().toPandas().drop_duplicates("doc_id").set_index("doc_id")[label]
    held = known[known.held_out & known.doc_id.isin(truth.index)]
    assert (held.predicted.to_numpy() == truth[held.doc_id].to_numpy()).mean() > 0.95


@pytest.mark.parametrize("operator,keep", [(toxicity, toxicity.clean), (quality, quality.good)])
def test_nothing_to_learn_or_to_score(corpus, no_docs, operator, keep):
    d, labels = corpus
    assert operator.score_documents(no_docs, labels).count() == 0
    none = operator.score_documents(d, labels.limit(0)).toPandas()
    assert len(none) == d.count() and (none.score == 0).all()
    assert keep(d, labels.limit(0)).columns == d.columns


def test_prior_is_near_the_truth():
    draw = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        plus, minus = draw.normal(2, 1, (4000, 1)), draw.normal(-2, 1, (4000, 1))
        web = np.where(draw.random((4000, 1)) < share, draw.normal(2, 1, (4000, 1)), minus)
        model = quality.learn(plus, web)
        assert abs(model.prior - share) < 0.06
        assert ((model.scores(np.array([[3.0], [-3.0]])) > 0.5) == [True, False]).all()


# Language model


def brute_model(texts):
    tokens = lambda x: [w.encode() for w in ascii_split(x)] + [None]
    c, b = collections.Counter(), collections.Counter()
    for x in texts:
        w = tokens(x)
        c.update(w)
        b.update(zip(["start", *w[:-1]], w))
    n, v = sum(c.values()), len(c)
    wide = collections.Counter(w for _, w in b)
    total, kinds = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (a, _), k in b.items():
        total[a] += k
        kinds[a][min(k, 3) - 1] += 1
    pd_, wd = (kneser_ney.discounts(*[collections.Counter(x.values())[k] for k in (1, 2, 3, 4)]) for x in (b, wide))
    cut = lambda k, d: max(k - (0, *d)[min(k, 3)], 0)
    freed = sum((0, *wd)[min(k, 3)] for k in wide.values()) / len(b)

    def score(x):
        w, out, base, known = tokens(x), 0.0, 0.0, 0
        for a, y in zip(["start", *w[:-1]], w):
            p = cut(wide[y], wd) / len(b) + freed / (v + 1)
            if total[a]:
                p = cut(b[a, y], pd_) / total[a] + sum(d * k for d, k in zip(pd_, kinds[a])) / total[a] * p
            out += math.log10(p)
            base += math.log10((c[y] + 1) / (n + v + 1))
            known += c[y] > 0
        return len(w), known, n, base, out

    return score


def ascii_split(x):
    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in x or "")
    for s in "\t\n\x0b\x0c\r":
        low = low.replace(s, " ")
    return [w for w in low.split(" ") if w]


def test_language_model(docs):
    got = {(r[0], r[2], round(r[6], 6)): r for r in kneser_ney.score_documents(docs).collect()}
    train = [t for i, t in awkward() if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    brute, want = brute_model(train), 0
    for i, t in awkward():
        n, known, total, base, own = brute(t)
        r = got[i, n, round(own, 6)]
        assert (r.n_known, r.train_tokens) == (known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(own, rel=1e-9)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
        want += 1
    assert want == docs.count()


def test_language_model_sums_to_one(spark):
    texts = [(k, words(300, k, "abc")) for k in range(6)]
    model = kneser_ney.train(spark.createDataFrame(texts, "doc_id long, text string"))
    seen = {w for _, t in texts for w in t.split()}
    total = 0.0
    for w in [*seen, "neverseen"]:
        one = model.score([f"a {w}".encode()])[3][0]
        total += 10 ** (one - model.score([b"a"])[3][0] + (end(model, "a") - end(model, w)))
    # The end token follows as well.
    assert total + 10 ** end(model, "a") == pytest.approx(1, abs=1e-9)


def end(model, word):
    """log10 p(end | word), from two texts that differ by it."""
    context, w = kneser_ney.word_hashes(word.encode())[1], np.array([kneser_ney.END], np.uint64)
    keys = np.unique(np.concatenate([context, w]))
    count, wide, freed = model.words(keys)
    i, j = np.searchsorted(keys, context)[0], np.searchsorted(keys, w)[0]
    p = max(wide[j] - (0, *model.word_discounts)[min(wide[j], 3)], 0) / model.pairs + model.freed / (model.distinct + 1)
    if count[i]:
        c = model.pair_counts(context, w)[0]
        p = max(c - (0, *model.pair_discounts)[min(c, 3)], 0) / count[i] + freed[i] / count[i] * p
    return math.log10(p)


def test_language_model_without_training(docs, no_docs):
    assert kneser_ney.score_documents(no_docs).count() == 0
    got = kneser_ney.score(kneser_ney.train(no_docs), docs).toPandas()
    assert len(got) == docs.count() and (got.score == 0).all()


# Vectors


def vectors(seed=3, dim=8):
    draw = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            center = draw.normal(size=dim)
            for _ in range(draw.integers(1, 14)):
                rows.append((i, (center + draw.normal(size=dim) * draw.choice([0.02, 0.15, 0.3])).tolist(), label))
                i += 1
    common = rows[0][1]
    rows += [(i + k, common, 0) for k in range(30)]
    i += 30
    rows += [
        (i, None, 0), (i + 1, [0.0] * dim, 0), (i + 2, [float("nan")] * dim, 0), (i + 3, [None] + [1.0] * (dim - 1), 0), (i + 4, common, None),
        (i + 5, [float("inf")] + [1.0] * (dim - 1), 0), (i + 6, [], 0), (i + 7, [3 * v for v in common], 0), (i + 8, common[:4], 0),
        (None, common, 0), (3, rows[3][1], 0), (i + 9, [1e-30 * v for v in common], 0), (i + 10, [-0.0] + common[1:], 1), (i + 11, [0.0] + common[1:], 1),
    ]
    return rows


def test_vectors_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "vec_id long, embedding array<double>, label int, id string, n int").repartition(4)
    for settings in ({}, {"block": 16}, {"recall": 1.0}):
        got = sorted(map(tuple, multi_index.near_duplicates(df, **settings).collect()), key=repr)
        fine = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
        links = collections.defaultdict(set)
        for a, b in itertools.combinations(fine, 2):
            (_, x, p), (_, y, q) = rows[a], rows[b]
            if p == q and len(x) == len(y):
                x, y = np.array(x) / max(map(abs, x)), np.array(y) / max(map(abs, y))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[a].add(b)
                    links[b].add(a)
        want = []
        for k, (i, _, _) in enumerate(rows):
            seen, todo = {k}, [k]
            while todo:
                for m in links[todo.pop()] - seen:
                    seen.add(m)
                    todo.append(m)
            root = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
            want.append((i, len(links[k]), root, i is not None and i == root))
        assert got == sorted(want, key=repr)


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert multi_index.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    only = multi_index.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [0.0], None)], schema))
    assert sorted(map(tuple, only.collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_of_the_index():
    draw = np.random.default_rng(4)
    x = multi_index._unit(draw.normal(size=(3000, 32)))
    index = multi_index.fit(x[:2000], 40_000)
    noise = draw.normal(size=x.shape)
    noise = multi_index._unit(noise - (noise * x).sum(1)[:, None] * x)
    y = 0.93 * x + (1 - 0.93**2) ** 0.5 * noise
    met = index.reaches(x, index.cells(y)) | index.reaches(y, index.cells(x))
    assert met.mean() > 0.99
    assert np.mean([len(v) for v in index.visits(x[:300])]) < len(index.first) * len(index.second) / 2


# SimHash


def simhash_texts():
    texts = [t for _, t in awkward()]
    long = words(400, 50).split()
    draw = random.Random(9)
    for _ in range(60):
        w = list(long)
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return [(None if k % 17 == 5 else k, t) for k, t in enumerate(texts)]


def brute_simhash(t):
    w = [x.encode() for x in ascii_split(t)]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [2048, 4])
def test_simhash_components(spark, monkeypatch, block):
    rows = simhash_texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string").repartition(4)
    links = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda p: links(p, block=block))
    monkeypatch.setattr(simhash, "FEW", 4)
    fp = [brute_simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = [(i, f"{fp[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)]
    assert sorted(map(repr, map(tuple, simhash.near_duplicate_report(df).collect()))) == sorted(map(repr, want))
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    groups = collections.Counter(find(k) for k in range(len(rows)))
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(groups)
    assert sorted(i for i in ids if i is not None) == sorted(least.values())


def test_grids_find_every_near_pair():
    draw = random.Random(10)
    masks = simhash.grids()
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), 3):
            b ^= 1 << bit
        ua, ub = simhash._unary(np.array([a, b], dtype=np.uint64))
        assert int(ua ^ ub).bit_count() <= 3
        assert any((int(ua) ^ int(ub)) & m & (1 << 64) - 1 == 0 for m in masks)


def test_no_texts_to_link(no_docs):
    assert simhash.near_duplicate_report(no_docs).count() == 0
    assert simhash.one_of_each(no_docs).count() == 0


def test_components(spark):
    draw = random.Random(11)
    pairs = [(k, k + 1) for k in range(0, 120)] + [(500, x) for x in range(501, 560)] + [(draw.randint(1000, 1200), draw.randint(1000, 1200)) for _ in range(150)]
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs + pairs[:9] + [(7, 7)], "a long, b long")).collect()))
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in pairs)}


# Sketches


def brute_sketch(text, size=sketch.SHINGLE):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", text.lower()) if x]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    out = set()
    for k in range(max(1, len(h) - size + 1) if h else 0):
        seed = 42
        for x in h[k : k + size]:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
        out.add(seed - (1 << 64) if seed >> 63 else seed)
    below = {x for x in out if x < -(1 << 63) + (1 << 64) // sketch.SCALE}
    return below or set(sorted(out)[:1])


def likeness(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else float(len(a) == len(b))


def sketched(rows, brute=brute_sketch):
    """Brute-force result rows of (doc_id, text) pairs."""
    tie = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64) * (h >> 63)
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    show = lambda s: ".".join(f"{x & (1 << 64) - 1:016x}" for x in sorted(s)) or "0"
    want = collections.Counter()
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = map(brute, (t, edited, after))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), likeness(a, b), likeness(a, c)] += 1
    return want


def test_sketches(spark):
    rows = [(i, t or "") for i, t in awkward() if i is not None] + [(k, words(40 + k % 30, k)) for k in range(100, 160)]
    df = spark.createDataFrame([(i, t, "clash", "x", 1) for i, t in rows], "doc_id long, text string, own string, key string, n int").repartition(5)
    assert collections.Counter(tuple(r) for r in sketch.fingerprints(df).collect()) == sketched(rows)


def test_sketches_with_a_third_of_null_ids_and_a_third_of_one_id(spark, monkeypatch):
    """Buckets stay even, and equal rows in mass are folded and dealt out again."""
    monkeypatch.setattr(sketch, "BUCKET", 20)
    rows = [(None, words(12, k)) for k in range(200)] + [(7, words(12, 300 + k)) for k in range(200)]
    rows += [(k * k * k, words(9, 600 + k)) for k in range(100)] + [(None, words(30, 1))] * 90 + [(9, words(8, 2))] * 61
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert collections.Counter(tuple(r) for r in sketch.fingerprints(df).collect()) == sketched(rows)
    keys = df.select("doc_id", F.xxhash64("text").alias("tie")).distinct()
    placed = keys.select(sketch.order_key().alias("key"), sketch.bounds_of(keys, keys.count()).alias("b"))
    sizes = [r[1] for r in placed.groupBy(sketch.place_of(F.col("key"), F.col("b"))).count().collect()]
    assert sum(sizes) == 502 and len(sizes) > 12 and max(sizes) <= 100


def test_sketch_edges(spark, docs, no_docs):
    assert sketch.fingerprints(no_docs).count() == 0
    assert sketch.fingerprints(docs).count() == docs.count()
    one = sketch.fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    far = spark.createDataFrame([(-(1 << 63), "a"), ((1 << 63) - 1, "b"), (0, "c")], "doc_id long, text string")
    assert sketch.fingerprints(far).count() == 3


def test_short_texts_are_estimated(spark, tmp_path):
    """The half that a short text keeps is seen in its edited text: against sketches of every hash."""
    df = spark.createDataFrame([(k, words(14 + k % 10, 2000 + k)) for k in range(300)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    both = (queries.op9_scaled_sketch(spark, str(tmp_path)), sketch.fingerprints(df, scale=1))
    got, true = (np.array([r.near_edited for r in out.orderBy("doc_id").collect()]) for out in both)
    assert (got[true >= 0.3] == 0).mean() < 0.1
    assert np.abs(got - true).mean() < 0.2


def test_sketches_merge(spark):
    a, b = words(60, 1), words(3, 2)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = sketch.with_sketch(sketch.with_sketch(df, "a", "sa"), "b", "sb")
    assert set(df.select(sketch.merged(df["sa"], df["sb"])).first()[0]) == (brute_sketch(a) | brute_sketch(b) if min(brute_sketch(b)) < -(1 << 62) - (1 << 61) else brute_sketch(a))


def test_written_table_is_read_with_its_schema(docs):
    again = written(docs, "t")
    assert again.schema == docs.schema and again.count() == docs.count()
