"""The pipeline's near-copy stage against brute force on five-word Jaccard similarity."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_text_operators import DOCS, ascii_split, awkward, words

import corpus_pipeline
from natal.llm import near_copies, simhash


def near_texts():
    """Copies on either side of 0.8, of long and short texts, with repeated lines and shared passages."""
    draw = random.Random(21)
    texts = [t for _, t in awkward()]
    for k in range(400):
        w = words([8, 12, 30, 100, 400][k // 4 % 5], 500 + k // 4).split() + (words(25, 3).split() if k // 4 % 2 else [])
        for at in draw.sample(range(len(w)), round(len(w) * draw.choice([0.01, 0.015, 0.02, 0.025]))):
            w[at] = "changed"
        texts.append(" ".join(w[: draw.choice([None, -1, -2])] + w[:6] * draw.choice([0, 0, 2])))
    return [(None if k % 17 == 5 else k, t) for k, t in enumerate(texts)]


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = ascii_split(t)
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    return [find(x) for x in range(len(rows))]


@pytest.mark.parametrize("block,small", [(256, near_copies.SMALL), (2, 0)])
def test_near_copies(spark, monkeypatch, block, small):
    rows = near_texts()
    group = brute_groups(rows)
    far = {tuple(sorted((a, b))) for a, b in itertools.combinations(range(len(rows)), 2) if group[a] == group[b] and (simhash.fingerprint(rows[a][1]) ^ simhash.fingerprint(rows[b][1])).bit_count() > 3}
    assert len(far) > 30
    monkeypatch.setattr(near_copies, "SMALL", small)
    classes = near_copies.near_classes
    monkeypatch.setattr(near_copies, "near_classes", lambda p, i: classes(p, i, block))
    df = spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1, "fp", 3, "y") for i, t in rows], DOCS).repartition(4)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, df, "")
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    least = collections.defaultdict(list)
    for g, (i, _) in zip(group, rows):
        least[g] += [i] if i is not None else []
    assert len(ids) == len(least)
    assert sorted(i for i in ids if i is not None) == sorted(min(v) for v in least.values() if v)


def test_grid_join_of_simhashes_finds_candidates(spark):
    """Without any band, the pairs that the grid join reaches are still compared and linked."""
    rows = []
    for k in range(40):
        w = words(400, 900 + k).split()
        rows += [(3 * k + n, " ".join(w[:50] + ["changed"] * n + w[50 + n :])) for n in range(3)]
    sets = {k: near_copies.shingle_set(t) for k, t in rows}
    prints = {k: simhash.simhash(simhash.shingle_hashes(t, 5)) for k, t in rows}
    near = set()
    for a, b in itertools.combinations(sets, 2):
        c = len(set(sets[a]) & set(sets[b]))
        if (prints[a] ^ prints[b]).bit_count() <= near_copies.NEAR and 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
            near.add((a, b))
    assert len(near) > 40 and any((prints[a] ^ prints[b]).bit_count() > 3 for a, b in near)
    df = spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1, "fp", 3, "y") for i, t in rows], DOCS)
    printed = near_copies._printed(df).withColumn("bands", F.array().cast("array<bigint>")).persist()
    doc_id = F.col("row.doc_id").cast("bigint")
    of = dict(near_copies.near_classes(printed, doc_id).select("key", "component").collect())
    key = dict(printed.select(doc_id, "key").collect())
    assert all(of[key[a]] == of[key[b]] for a, b in near)
    least = dict(zip(sets, brute_groups(rows)))
    assert all(least[a] == least[b] for a, b in itertools.combinations(sets, 2) if of[key[a]] == of[key[b]])
