import collections
import random
import re
import time
from itertools import combinations

import numpy as np
import pytest

from emberfield.llm import cluster, embed_dedup, line_dedup, ngram_join


def test_banding_meets_recall():
    for threshold, recall in ((0.8, 0.9999), (0.7, 0.99), (0.95, 0.999)):
        bands, rows = ngram_join.banding(threshold, recall)
        assert bands * rows <= ngram_join.MAX_HASHES and 1 - (1 - threshold**rows) ** bands >= recall


def grams(text):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def reached(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [256, 7])
def test_ngram_join_against_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(cluster.block_pairs, "__defaults__", (block,))
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randrange(60, 120))] for _ in range(12)]
    texts = ["", None, "one two", "One, two!", "three"]
    for b in base:  # groups of near and exact copies, some far enough to fall below the threshold
        for _ in range(r.randrange(1, 16)):
            copy = list(b)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    sets = [grams(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = reached(range(len(texts)), links)
    for x in ngram_join.ngram_join(docs_of(texts)).collect():
        i = x["doc_id"]
        assert x["n_links"] == sum(i in pair for pair in links), i
        assert x["class_id"] == group[i] and x["kept"] == (group[i] == i)


def test_keep_one_keeps_one_of_repeated_rows(docs_of):
    text = "the same words again and again in both of these rows"
    out = ngram_join.keep_one(docs_of([(1, text), (1, text), (2, text), (3, None), (4, None)])).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 3, 4]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["vertex"]: r["component"] for r in cluster.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 0 for i in range(50)} | {300: 300, 301: 300}
    assert got == want


@pytest.mark.parametrize("block", [256, 16])
def test_embeddings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cluster.block_pairs, "__defaults__", (block,))
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    m = np.concatenate([centres[rng.integers(0, 40, 500)] + 0.22 * rng.standard_normal((500, 16)), np.repeat(centres[:1], 30, axis=0)]).astype(np.float32)
    unit = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    group = reached(range(len(m)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    out = {r["vec_id"]: r for r in embed_dedup.near_duplicates(vectors).collect()}
    found = np.array([out[i]["n_links"] for i in range(len(m))])
    assert (found <= near.sum(axis=1)).all()
    assert found.sum() >= 0.99 * near.sum()
    if found.sum() == near.sum():
        assert all(out[i]["component_id"] == group[i] for i in range(len(m)))


def test_lines_by_definition(docs_of):
    shared = "this line is in three documents"
    rows = [(1, f"{shared}\nown one\n{shared}"), (2, f"  {shared.upper()} \nshort"), (3, f"a\n{shared}\nshort\n{shared}\t"), (4, "short\n\n"), (5, None)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs_of(rows)).collect()}
    assert out[1]["text"] == "own one" and out[1]["n_dropped"] == 2
    assert out[2]["text"] == "short" and out[3]["text"] == rows[2][1] and out[4]["text"] == rows[3][1]
    assert (out[5]["text"], out[5]["n_lines"], out[5]["n_dropped"]) == ("", 1, 0)


@pytest.mark.parametrize("hot", [100_000, 3])
def test_lines_against_the_definition(docs_of, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_DOCS", hot)
    monkeypatch.setattr(line_dedup.repeated_lines, "__defaults__", (*line_dedup.repeated_lines.__defaults__[:-1], hot))
    r = random.Random(8)
    pool = [f"  Line number {i} that is long enough " for i in range(30)] + ["short", "", " \t", "x" * 20, "é" * 20, "é" * 19]
    rows = [(i // 2 if i < 20 else i, "\n".join(r.choice(pool) for _ in range(r.randrange(12)))) for i in range(80)]
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")]
    docs = {}
    for i, t in rows:
        for k in keys(t):
            docs.setdefault(k, set()).add(i)
    gone = {k: max(d) for k, d in docs.items() if len(k) >= 20 and len(d) >= 3}
    want = sorted((i, "\n".join(x for x, k in zip(t.split("\n"), keys(t), strict=True) if gone.get(k, i) == i), t.count("\n") + 1) for i, t in rows)
    got = sorted((x["doc_id"], x["text"], x["n_lines"]) for x in line_dedup.dedup_lines(docs_of(rows)).collect())
    assert got == want


def test_a_document_of_very_many_repeated_lines(docs_of):
    text = "\n".join(f"this is line number {i} of a long list" for i in range(100_000))
    began = time.time()
    out = line_dedup.dedup_lines(docs_of([(1, text), (2, text), (3, text)])).collect()
    assert {r["doc_id"]: (len(r["text"]), r["n_dropped"]) for r in out} == {1: (0, 100_000), 2: (0, 100_000), 3: (len(text), 0)}
    assert time.time() - began < 60


def test_planted_pairs_just_above_the_threshold_are_found(spark):
    """Recall where it is hardest: 3,000 pairs at a cosine of 0.951 among 6,000 vectors of 64 dimensions."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.standard_normal(a.shape)
    off -= (off * a).sum(axis=1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * off
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    out = embed_dedup.near_duplicates(vectors).collect()
    found = sum(r["n_links"] for r in out) // 2
    assert found >= 0.99 * 3000
    assert all(r["component_id"] == r["vec_id"] % 3000 for r in out if r["n_links"])
    print("recall", found / 3000)


def test_large_leaves_are_split_and_no_link_is_lost(spark):
    """A small sample makes few, large leaves; a third of the vectors are near copies that no split can part."""
    rng = np.random.default_rng(12)
    a = rng.standard_normal((1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a + 0.04 * rng.standard_normal(a.shape)
    copies = a[0] + 0.001 * rng.standard_normal((1400, 32))
    m = np.concatenate([a, b, copies])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r for r in embed_dedup.near_duplicates(vectors, sample_rows=128, leaf_rows=100).collect()}
    found = np.array([out[i]["n_links"] for i in range(len(m))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.99 * near.sum()
    assert all(out[i]["component_id"] == out[i + 1500]["component_id"] for i in range(1500) if found[i] and near[i, i + 1500] and near[i].sum() == 1)

    model = embed_dedup.fit(unit[:128], trees=2)
    row, leaf = model.leaves(unit)
    lists = [leaf[row == i].tolist() for i in range(len(m))]
    placed = spark.createDataFrame([(i, 1, v.tolist(), lists[i]) for i, v in enumerate(m)], "uid long, size long, vector array<double>, leaves array<long>")
    before, after = (collections.Counter(k for r in d.collect() for k in r["leaves"]) for d in (placed, embed_dedup.split_further(placed, model, 0.95, 100)))
    assert max(before.values()) > 1500
    only = embed_dedup.split_further(placed.filter("uid < 3000"), model, 0.95, 100)
    sizes = collections.Counter(k for r in only.collect() for k in r["leaves"])
    assert max(sizes.values()) <= 150  # sizes are estimated on samples
    # the near copies stay together, in no more leaves than the first splits put them
    large = [n for n in after.values() if n > 200]
    assert 2 <= len(large) <= max(len(k) for k in lists[3000:]) and all(1400 <= n <= 2100 for n in large), large
    again = {r["uid"]: r["leaves"] for r in embed_dedup.split_further(placed, model, 0.95, 100).collect()}
    assert all(again[i] == sorted(again[i]) for i in again) and len(again) == len(m)
