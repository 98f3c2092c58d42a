"""Whitening, centroid clustering and url rules against plain definitions, and their odd inputs."""

import hashlib
import math
import random

import numpy as np
import pytest

from emberfield.llm import centroids, url_filter, whitening

VECTORS = "vec_id long, embedding array<double>, label int, x string, cluster string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "c", "k") for i, v in rows], VECTORS)


def odd(dims, seed=1, n=60):
    """Copies, ties, nulls, wrong lengths and huge entries among random vectors."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(0, 0.2, (n, dims)))]
    rows += [(7, rows[7][1]), (100, rows[3][1]), (None, rows[5][1]), (101, [0.0] * dims), (102, [-0.0] * dims)]
    bad = [None, [], [1.0], [math.nan] * dims, [math.inf] + [0.0] * (dims - 1), [None] + [0.0] * (dims - 1), [1e300] + [0.0] * (dims - 1)]
    return rows, [(200 + i, v) for i, v in enumerate(bad)]


def plain_clusters(rows, k, rounds, scale, seed):
    """The definition in Python integers: (vec_id, cluster, distance) per row and the centroids."""
    x = [[math.floor(scale * c) for c in v] for _, v in rows]
    key = [(i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for (i, _), v in zip(rows, x, strict=True)]
    centres = [x[i] for i in sorted(range(len(x)), key=lambda i: key[i])[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for v in x]
        for j in range(len(centres)):
            held = [v for v, o in zip(x, own, strict=True) if o == j]
            if held:
                centres[j] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for (i, _), v in zip(rows, x, strict=True)], centres


@pytest.mark.parametrize("far", [1.0, 1e9])
def test_clusters_are_the_definition(spark, far):
    good, bad = odd(6)
    good = [(i, [c * far for c in v]) for i, v in good]
    got = centroids.clusters(table(spark, good + bad), k=5, rounds=4, dims=6).collect()
    want, centres = plain_clusters(good, 5, 4, 1024, 3)
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=order) == sorted(((i, c, d if d < 2**63 else None) for i, c, d in want), key=order)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    assert all(r["centroid_sha256"] == digest[r["cluster"]] for r in got)
    total = sum(d for _, _, d in want)
    assert {r["inertia"] for r in got} == {total if total < 2**63 else None}


def test_clusters_ties_and_few_vectors(spark):
    same = centroids.clusters(table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])]), k=8, rounds=2, dims=2).collect()
    assert [(r["cluster"], r["distance"], r["cluster_inertia"]) for r in same] == [(0, 0, 0)] * 3
    assert centroids.clusters(table(spark, [(1, [1.0])]), dims=2).count() == 0
    with pytest.raises(ValueError, match="planes"):
        centroids.clusters(table(spark, []), k=100_000)


def test_tournament_zero_favours_the_smaller_number():
    contest = centroids.Tournament([[0, 0], [2, 0], [2, 2], [0, 0]])
    best, distance = contest.assign(np.array([[1, 0], [2, 1], [1, 1], [0, 0]]))
    assert best.tolist() == [0, 1, 0, 0] and distance.tolist() == [1, 1, 2, 0]


def test_whitening_is_the_definition(spark):
    good, bad = odd(6)
    got = whitening.whiten(table(spark, good + bad)).collect()
    x = np.array([[math.floor(256 * c) for c in v] for _, v in good])
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    values, basis = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(got) == 4 * len(good) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    exact = {tuple(v): sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, fit.sum(axis=0), strict=True)) for v in x.tolist()}
    assert sorted(r["deviation"] for r in got) == sorted(d for v in x.tolist() for d in [exact[tuple(v)]] * 4)
    for k in range(4):
        assert [r["explained"] for r in got if r["component"] == k + 1] == pytest.approx([values[k] / values.sum()] * len(good), rel=1e-9)
        want = (x - mean) @ basis[:, k] / math.sqrt(values[k])
        mine = {r["deviation"]: r["whitened"] for r in got if r["component"] == k + 1}
        sign = np.sign(mine[exact[tuple(x[0])]] * want[0])
        assert [mine[exact[tuple(v)]] for v in x.tolist()] == pytest.approx(list(sign * want), abs=1e-8)


def test_whitening_without_spread_and_empty(spark):
    flat = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in flat] == [(k, 1, 0, None, None, None) for _ in range(3) for k in (1, 2)]
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])).collect()
    assert {(r["component"], r["whitened"] is None, r["explained"]) for r in line} >= {(2, True, 0.0), (3, True, 0.0)}
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0


def test_exact_squares_in_limbs():
    rng = random.Random(2)
    for size in (10, 2**20, 2**45, 2**61):
        x = [[rng.randrange(-size, size) for _ in range(5)] for _ in range(20)]
        centre = whitening.Centre(20, [sum(c) for c in zip(*x, strict=True)])
        want = [sum((20 * a - s) ** 2 for a, s in zip(v, centre.sums, strict=True)) for v in x]
        assert centre.squares(np.array(x)) == want


@pytest.mark.parametrize(("dims", "rank"), [(1, 1), (2, 2), (9, 9), (9, 4), (40, 40)])
def test_eigen_against_the_dense_solver(dims, rank):
    rng = np.random.default_rng(dims)
    a = rng.standard_normal((80, rank)) @ rng.standard_normal((rank, dims))
    s = a.T @ a
    values, basis = whitening.eigen(s)
    assert len(values) == rank
    np.testing.assert_allclose(values, np.linalg.eigvalsh(s)[::-1][:rank], rtol=1e-9)
    np.testing.assert_allclose(basis.T @ basis, np.eye(rank), atol=1e-12)
    np.testing.assert_allclose(s @ basis, basis * values, atol=1e-9 * values[0])


def plain_rule(url, rules):
    rest = (url or "").partition("://")
    host = path = ""
    if rest[1]:
        cut = min([rest[2].find(c) for c in "/?#" if c in rest[2]], default=len(rest[2]))
        host = "".join(c.lower() if c.isascii() else c for c in rest[2][:cut])
        path = rest[2][cut:].split("?")[0].split("#")[0]
    fits = [(len(r), v == "allow", r, v) for v, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[2:] if fits else (None, None))


URLS = [
    "http://a.example.com/en/1", "https://WWW.Example.com/en/", "http://www.example.com/en", "http://x.net/es/", "http://net/fr/a?b#c", "http://net",
    "ftp://u@h.net:80/fr/x", "://net/es/", "a://b://net/es/", "no address", "", None, "http://example.org#x/y", "http://exÄmple.COM/\n/en/", "http://.com/", "http://com/?q=/en/",
]


@pytest.mark.parametrize("in_row", [200, 0])
def test_rules_are_the_definition(spark, in_row):
    rules = [*url_filter.RULES, ("block", "www.example.com/en"), ("block", "b.example.com/"), ("allow", "example.com/en/1")]
    pages = spark.createDataFrame([(i, u, None, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.rule_table(spark, rules), in_row=in_row).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain_rule(u, rules)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or "allow")


def test_aliases_inherit_block_unless_one_is_allowed(spark):
    def head(tags):
        return f"<!doctype html><html><head><title>a <link rel=canonical href='http://q.net/es/'></title>{tags}</head><body><link rel=canonical href='http://q.net/es/'></body>"

    rows = [
        (1, "http://a.org/1", head('<link href="http://b.org/1" rel="Canonical">')),
        (2, "http://b.org/1", head('<meta http-equiv=Refresh content="0; URL=\'http://c.net/es/9\'">')),  # c.net is no page of the table
        (3, "http://d.org/1?utm_source=feed#top", head("")),
        (4, "http://d.org/1", head("<base href='http://e.net/fr/'><link rel='canonical' href='2'>")),
        (5, "http://e.net/fr/2", None),
        (6, "http://f.org/", head('<link rel="canonical" href="http://e.com/x">')),
        (7, "http://g.org/", head('<link rel="canonical" href="http://f.org">')),
        (8, "http://h.org/", head("")),
        (9, "http://i.org/", head("<!-- <link rel=canonical href='http://q.net/es/'> --><script>'<link rel=canonical href=http://q.net/es/>'</script>")),
        (10, "http://j.org/", head("<link rel=canonical href='http://[bad'><link rel=canonical>")),
        (11, "http://g.org/", ""),
        (12, "http://k.net/es/", head('<link rel="canonical" href="http://f.org/">')),
        (13, "http://l.org/", head('<link rel="canonical" href="http://k.net/es/">')),
        (14, "http://m.org/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://m.org/", "http://a.org/1"), (None, "x"), ("y", None), ("no", "address")], "from_url string, to_url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, url_filter.rule_table(spark), redirects).collect()}
    # 12 is blocked by its own rule; 13, 7 and 11 are in the class of an allowed alias (e.com)
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "block", 13: "allow", 14: "block"}
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert url_filter.judge(pages, url_filter.rule_table(spark, [])).filter("verdict = 'block' or rule is not null").count() == 0
