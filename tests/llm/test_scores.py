import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from emberfield.llm import quality, spans, toxicity


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_measures_against_definition(docs_of):
    r = random.Random(5)
    parts = ["a", "b", "é", "漢", " ", " ", "\n", "\n", "\t", " ", "#", "|", "c d e f g h i j "]
    texts = [None, *("".join(r.choice(parts) for _ in range(r.randrange(120))) for _ in range(400))]
    model = quality.Model(np.zeros(quality.FEATURES, dtype=np.float32), 0.0, 1.0, 0.0)
    for x in quality.quality(docs_of(texts), model).collect():
        want = measures(texts[x["doc_id"]] or "")
        assert tuple(x[m] for m in quality.MEASURES) == want
        assert x["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_slices_do_not_change_measures():
    texts = pa.array(["one two three " * 30, None, "", "x\ny\nx", "four " * 50])
    whole = [quality._hashed(d, a) for _, d, a in spans.slices(texts, 1 << 20)]
    parts = [quality._hashed(d, a) for _, d, a in spans.slices(texts, 10)]
    assert np.array_equal(np.concatenate([w[3] for w in whole]), np.concatenate([p[3] for p in parts]))
    assert [row for row, _, _ in spans.slices(texts, 10)] == [0, 1, 4] or len(list(spans.slices(texts, 10))) > 1


def corpus(n, seed):
    r = random.Random(seed)
    plain = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randrange(25, 80))]
        toxic, junk = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["nasty", "vileness", "vilest", "vilely"])
        if junk:
            words = [w + r.choice(["***", "$$$"]) for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if junk else 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(docs_of, labels_of):
    docs, labels = corpus(1500, 6)
    frame, known = docs_of(docs), labels_of(labels)
    rows = toxicity.toxicity(frame, toxicity.fit(frame, known)).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]][2] for r in held]) > 0.97

    fresh, fresh_labels = corpus(300, 7)
    model = quality.fit(frame, known)
    got = quality.quality(docs_of(fresh), model).collect()
    assert np.mean([r["kept"] == bool(fresh_labels[r["doc_id"]][1]) for r in got]) > 0.97
    brier = np.mean([(r["probability"] - fresh_labels[r["doc_id"]][1]) ** 2 for r in got])
    assert brier < 0.05


def test_held_out_labels_are_not_learned(docs_of, labels_of):
    docs, labels = corpus(300, 8)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    turned = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    frame = docs_of(docs)
    a, b = toxicity.fit(frame, labels_of(labels)), toxicity.fit(frame, labels_of(turned))
    assert a.bias == b.bias and np.array_equal(a.weight, b.weight)


def test_one_label_only(docs_of, labels_of):
    frame = docs_of(["some words here " * 10] * 3)
    known = labels_of([(0, 1, 0), (1, 1, 0), (2, 1, 0)])
    assert all(r["kept"] in (True, False) and r["probability"] == 1.0 for r in quality.quality(frame, quality.fit(frame, known)).collect())
    assert all(r["score"] < 0.7 for r in toxicity.toxicity(frame, toxicity.fit(frame, known)).collect())


def test_grams_of_few_toxic_rows_are_learned(docs_of, labels_of):
    r = random.Random(9)
    text = lambda toxic: " ".join([*(f"word{r.randrange(200)}" for _ in range(30)), *["vileness"] * toxic])
    docs = [(i, text(i % 9 == 0)) for i in range(90)]
    learned = sum(i % 9 == 0 and zlib.crc32(str(i).encode()) % 3 != 1 for i in range(90))
    assert 3 <= learned < 10
    model = toxicity.fit(docs_of(docs), labels_of([(i, 1, int(i % 9 == 0)) for i in range(90)]))
    fresh = docs_of([(i, text(i % 2)) for i in range(1000, 1040)])
    rows = toxicity.toxicity(fresh, model).collect()
    assert all((x["score"] > 0.5) == bool(x["doc_id"] % 2) for x in rows)


def test_ftrl_against_a_loop_per_coordinate():
    r = random.Random(6)
    rows = [(sorted(r.sample(range(12), r.randrange(1, 7))), r.randrange(2), r.choice([0.5, 1.0, 3.0])) for _ in range(400)]
    alpha, beta, l1, l2 = 0.7, 1.3, 0.4, 0.2
    fast = toxicity.Ftrl(12, alpha, beta, l1, l2)
    z, n = [0.0] * 13, [0.0] * 13

    def weight(i):
        a, b = (l1, l2) if i < 12 else (0.0, 0.0)
        if abs(z[i]) <= a:
            return 0.0
        return -(z[i] - math.copysign(a, z[i])) / ((beta + math.sqrt(n[i])) / alpha + b)

    for features, y, importance in rows:
        on = [*features, 12]  # the last is the bias
        w = {i: weight(i) for i in on}
        g = importance * (1 / (1 + math.exp(-sum(w.values()))) - y)
        for i in on:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
        fast.learn(np.array(on), y, importance)
    assert fast.weights(np.arange(13)) == pytest.approx([weight(i) for i in range(13)], abs=1e-12)


def test_sample_takes_one_row_per_id(docs_of, labels_of):
    docs = docs_of([(i % 7, f"text {i} of a document") for i in range(3000)])
    labels = labels_of([(i, i % 2, 0) for i in range(7)])
    rows = quality.labelled_rows(docs, labels, "quality", 5).collect()
    assert len(rows) == 5 and len({r["doc_id"] for r in rows}) == 5
    assert all(r["y"] == r["doc_id"] % 2 for r in rows)
