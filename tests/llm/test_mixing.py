import math
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from emberfield.llm import mixing


@pytest.fixture(scope="module")
def sources(docs_of):
    rows = [(i, "w " * (5 + i % 7), f"s{min(9, i % 40)}") for i in range(2000)]
    return docs_of(rows)


def shares(docs):
    total = Counter()
    for r in docs.collect():
        total[r["source"]] += len(r["text"].split())
    return total


def test_default_mix_keeps_all_within_the_limit(sources):
    total = shares(sources)
    rows = mixing.mix(sources, passes=1.5, block_tokens=500).select("row.doc_id", "source", "n_tokens").collect()
    times = Counter(r["doc_id"] for r in rows)
    assert set(times) == set(range(2000)) and max(times.values()) <= 2
    got = Counter()
    for r in rows:
        got[r["source"]] += r["n_tokens"]
    passes = {s: got[s] / total[s] for s in total}
    assert min(passes.values()) == 1 and 1.4 < max(passes.values()) <= 1.5
    # weights are powers of the shares: passes fall with the size of the source, as one power
    low, high = min(total.values()), max(total.values())
    power = math.log(passes[min(total, key=total.get)]) / math.log(high / low)
    for s in total:
        assert abs(math.log(passes[s]) - power * math.log(high / total[s])) < 0.03


def test_budget_and_entropy(sources):
    total = shares(sources)
    budget = sum(total.values()) // 2
    rows = mixing.mix(sources, entropy=2.1, passes=None, budget=budget, block_tokens=300).select("row.doc_id", "source", "n_tokens").collect()
    got = Counter()
    for r in rows:
        got[r["source"]] += r["n_tokens"]
    assert abs(sum(got.values()) - budget) <= 12 * len(total) and sum(got.values()) <= budget + len(total)
    p = [v / sum(got.values()) for v in got.values()]
    assert abs(-sum(x * math.log(x) for x in p) - 2.1) < 0.01
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 2


def test_pass_is_a_permutation_of_blocks(sources):
    rows = mixing.mix(sources, passes=2.0, block_tokens=400).select("row.doc_id", "source", "pass", "block", "position.block_order").collect()
    of = defaultdict(set)
    for r in rows:
        of[r["source"], r["pass"], r["block"]].add(r["block_order"])
    assert all(len(v) == 1 for v in of.values())
    first = {k[2]: v for k, v in of.items() if k[:2] == ("s0", 1)}
    second = {k[2]: v for k, v in of.items() if k[:2] == ("s0", 2)}
    assert any(first[b] != second[b] for b in second)


def test_main_path_is_native(sources):
    plan = mixing.mix(sources)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_pipeline_stage_writes_rows_by_position(spark, sources):
    mixed = mixing.mix(sources).select("position", "row.doc_id").collect()
    rows = corpus_pipeline.mix_sources(spark, sources, "").collect()
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in sorted(mixed)]
