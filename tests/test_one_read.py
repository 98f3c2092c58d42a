"""Cuts in hash order, disks by running sums and fronts by blocks: results, and how much is read or moved."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield import scale
from emberfield.operators import raster, temporal
from emberfield.plans import planning


def md5_order(ids, seed):
    return sorted(ids, key=lambda i: hashlib.md5(f"{i}|{seed}".encode()).hexdigest())


def test_all_cuts_at_once(spark):
    df = spark.range(3000).withColumn("_h", scale.hash_order(["id"], 1))
    hashes = sorted(hashlib.md5(f"{i}|1".encode()).hexdigest() for i in range(3000))
    for digits, last in ((5, 4096), (1, 3)):
        cuts = scale.hash_cuts(df.select("_h"), [0, 1, 1500, 2999, 3000, 4000], digits, last)
        assert cuts == ["", hashes[0], hashes[1499], hashes[2998], hashes[2999], None]


@pytest.mark.parametrize("take", ["sample_rows", "sample_pixels", "split"])
def test_the_input_is_computed_once(spark, take):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(500).select(F.col("id").alias("px"), F.col("id").alias("py")).mapInArrow(count, "px long, py long")
    image = df.groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))  # a composite
    if take == "split":
        out = temporal.train_val_test_split(image, ["px"], seed=3).collect()
        assert {r["px"] for r in out if r["split"] == "train"} == set(md5_order(range(500), 3)[:400])
    elif take == "sample_rows":
        assert {r["px"] for r in temporal.sample_rows(image, ["px"], 77, 3).collect()} == set(md5_order(range(500), 3)[:77])
    else:
        assert raster.sample_pixels(image, 77).count() == 77
    assert seen.value == 500


@pytest.mark.parametrize("k", [1, 5, 17])
def test_disks_from_running_sums(spark, k):
    rng = np.random.default_rng(k)
    x, y = np.meshgrid(np.arange(-30, 40), np.arange(230, 290))  # across tile borders
    frame = pd.DataFrame({"px": x.ravel(), "py": y.ravel(), "elevation": rng.uniform(400, 900, x.size)})
    frame = frame.sample(frac=0.7, random_state=1)  # holes
    got = raster.terrain_tpi(spark.createDataFrame(frame), radius_m=100.0 * k).toPandas().set_index(["px", "py"])["tpi"]
    assert len(got) == len(frame)
    value = {(r.px, r.py): r.elevation for r in frame.itertuples()}
    disk = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if i * i + j * j <= k * k]
    for r in frame.sample(200, random_state=2).itertuples():
        around = [value[p] for i, j in disk if (p := (r.px + i, r.py + j)) in value]
        assert got[r.px, r.py] == pytest.approx(r.elevation - np.mean(around), abs=1e-9)


def test_disks_move_each_pixel_about_once(spark):
    dem = spark.range(512 * 512).select((F.col("id") % 512).alias("px"), F.floor(F.col("id") / 512).alias("py"), F.col("id").cast("double").alias("elevation"))
    plan = raster.terrain_tpi(dem, radius_m=1700.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "FlatMapGroupsInPandas" in plan.replace("FlatMapGroupsInArrow", "FlatMapGroupsInPandas")


@pytest.mark.parametrize(("dims", "block"), [(2, 50), (3, 64), (4, 4096)])
def test_front_by_blocks(spark, dims, block):
    rng = np.random.default_rng(dims)
    v = np.round(rng.uniform(0, 1, (3000, dims)), 3)
    front = np.abs(rng.normal(size=(600, dims)))
    front = np.round(1 - front / np.linalg.norm(front, axis=1, keepdims=True) * 0.9, 4)  # near a sphere: mostly undominated
    v = np.concatenate([v, front, front[:100]])
    names = [f"o{i}" for i in range(dims)]
    df = spark.createDataFrame(pd.DataFrame(v, columns=names).assign(plan_id=range(len(v))))
    got = {r["plan_id"] for r in planning.pareto_front(df, names, block_rows=block).collect()}
    want = {i for i, a in enumerate(v) if not ((v <= a).all(1) & (v < a).any(1)).any()}
    assert got == want


def test_few_blocks_of_a_large_front_meet(spark):
    # a million undominated vectors: on the line o0 + o1 = constant every one is on the front
    rows = 1_000_000
    df = spark.range(rows).select(F.col("id").cast("double").alias("o0"), (F.lit(float(rows)) - F.col("id")).alias("o1"))
    blocks = scale.cut_lineage(planning.front_blocks(df, ["o0", "o1"], rows, 4096))
    heads = {r["block"]: r["n"] for r in blocks.select("block", "n").collect()}
    assert sum(heads.values()) == rows and max(heads.values()) < 2 * 4096
    pairs = planning.meeting_blocks(blocks, 2).collect()
    copied = sum(heads[r["t"]] + heads[r["s"]] for r in pairs)
    assert copied < 40 * rows, copied / rows  # all pairs would copy each row about 250 times
