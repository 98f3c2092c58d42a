"""The helpers that spread large groups, forced onto small data, against brute force."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from emberfield import scale
from emberfield.operators import stats, temporal
from emberfield.plans import planning


def _hot(rng, n=900):
    """A third of the rows in one key, a third of the values equal."""
    key = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 6, n))
    v = rng.normal(0, 1, n)
    v[: n // 9] = 0.25
    return pd.DataFrame({"id": range(n), "k": key, "v": v, "w": rng.uniform(0, 1, n)})


def test_narrowed_percentiles_equal_numpy(spark):
    pdf = _hot(np.random.default_rng(3))
    df = spark.createDataFrame(pdf)
    wanted = {"m": ("v", 0.5), "q": ("v", 0.9), "w50": ("w", 0.5)}
    got = scale.exact_percentiles(df, ["k"], wanted, group_rows=60).toPandas().set_index("k").sort_index()
    for k, g in pdf.groupby("k"):
        assert np.isclose(got.loc[k, "m"], g.v.median()) and np.isclose(got.loc[k, "w50"], g.w.median())
        assert np.isclose(got.loc[k, "q"], g.v.quantile(0.9))
    one = scale.exact_percentiles(df, [], wanted, group_rows=60).first()
    assert np.isclose(one["m"], pdf.v.median()) and np.isclose(one["q"], pdf.v.quantile(0.9))


def test_row_numbers_of_a_key_across_partitions(spark):
    pdf = _hot(np.random.default_rng(4), 300)
    got = scale.number_rows(spark.createDataFrame(pdf), ["k"], ["v", "id"]).toPandas()
    want = pdf.sort_values(["v", "id"]).groupby("k").cumcount() + 1
    assert (got.set_index("id")["_rn"].sort_index() == want.sort_index()).all()


def test_split_series_gives_the_same_windows(spark):
    rng = np.random.default_rng(5)
    pdf = _hot(rng, 400).rename(columns={"k": "grid_id", "v": "lst_celsius", "w": "NDVI"})
    pdf["date"] = pdf["id"].sample(frac=1, random_state=1).to_numpy()
    df = spark.createDataFrame(pdf)
    plain = temporal.temporal_features(df).toPandas().set_index("id").sort_index()
    cut = temporal.temporal_features(df, group_rows=40).toPandas().set_index("id").sort_index()[plain.columns]
    assert len(cut) == len(plain) == 400
    pd.testing.assert_frame_equal(plain, cut, check_exact=False, rtol=1e-9, atol=1e-9)


def test_trend_needs_ten_values_and_lags_count_rows(spark):
    df = spark.createDataFrame([("g", i, float(2 * i)) for i in range(25)], "grid_id string, date int, lst_celsius double")
    rows = {r["date"]: r for r in temporal.temporal_features(df).collect()}
    assert rows[8]["lst_trend_5yr"] is None and abs(rows[9]["lst_trend_5yr"] - 2.0) < 1e-12
    assert rows[3]["lst_lag_1yr"] is None and rows[4]["lst_lag_1yr"] == 0.0 and rows[20]["lst_lag_5yr"] == 0.0


def test_hash_order_cut_takes_exactly_n(spark):
    df = spark.range(1000).withColumnRenamed("id", "cell_id")
    for n in (0, 1, 137, 1000, 5000):
        got = {r["cell_id"] for r in df.filter(scale.first_in_hash_order(df, ["cell_id"], 42, n)).collect()}
        order = sorted(range(1000), key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
        assert got == set(order[:n])


def test_split_is_a_partition_of_exact_sizes(spark):
    df = spark.range(1003).withColumn("c", F.col("id") % 3)
    got = temporal.train_val_test_split(df, ["id"]).groupBy("split").count().toPandas().set_index("split")["count"]
    assert got.to_dict() == {"train": 802, "val": 100, "test": 101}
    strat = temporal.train_val_test_split(df, ["id"], (0.8, 0.0, 0.2), stratify="c")
    share = strat.groupBy("c").agg(F.avg((F.col("split") == "train").cast("int")).alias("s")).toPandas()
    assert share["s"].between(0.79, 0.81).all()


def test_gini_with_a_split_group(spark):
    pdf = _hot(np.random.default_rng(6), 300)
    df = spark.createDataFrame(pdf)
    a = stats.gini(df, ["k"], F.col("w")).toPandas().set_index("k")["gini"].sort_index()
    b = stats.gini(df, ["k"], F.col("w"), group_rows=20).toPandas().set_index("k")["gini"].sort_index()
    assert np.allclose(a, b) and a.between(0, 1).all()
    zero = stats.gini(spark.createDataFrame([(1, 0.0), (1, 0.0)], "k int, w double"), ["k"], F.col("w"))
    assert zero.first()["gini"] == 0.0


def test_auc_matches_average_ranks(spark):
    rng = np.random.default_rng(8)
    y, s = rng.integers(0, 2, 400), np.round(rng.uniform(0, 1, 400), 2)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "predicted": (s > 0.5).astype(int), "score": s}))
    got = stats.classification_metrics(df).first()
    r = pd.Series(s).rank().to_numpy()
    p, n = y.sum(), (1 - y).sum()
    assert np.isclose(got["auc"], (r[y == 1].sum() - p * (p + 1) / 2) / (p * n))
    one = stats.classification_metrics(df.filter("label = 1")).first()
    assert one["auc"] == 0.0


def test_pareto_front_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    v = np.round(rng.uniform(0, 1, size=(300, 3)), 1)
    v[:100] = v[0]
    pdf = pd.DataFrame(v, columns=["a", "b", "c"])
    pdf["plan_id"] = range(300)
    for block in (4096, 10):
        got = {r["plan_id"] for r in planning.pareto_front(spark.createDataFrame(pdf), ["a", "b", "c"], block_rows=block).collect()}
        want = {i for i in range(300) if not ((v <= v[i]).all(1) & (v < v[i]).any(1)).any()}
        assert got == want


def test_repaired_plans_fit_the_budget(spark):
    rows = [(p, str(w), (p + w) % 5, 0.1 * ((p * w) % 11)) for p in range(20) for w in range(30)]
    plan = spark.createDataFrame(rows, "plan_id long, ward_id string, intervention_type int, frac double")
    fixed = planning.repair_budget(plan, 1e7).withColumn("frac", F.col("frac_repaired"))
    cost = planning.plan_costs(fixed.drop("cost")).groupBy("plan_id").agg(F.sum("cost").alias("c")).agg(F.max("c")).first()[0]
    assert cost <= 1e7 * (1 + 1e-9)


def _counting(spark, df):
    """The same rows, and a counter of how many of them were ever computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


def test_percentiles_of_large_groups_read_the_rows_twice(spark):
    pdf = _hot(np.random.default_rng(13))
    ps = {f"p{i}": (c, i / 10) for i, c in enumerate("vwvwvwvwvwv")}
    df, seen = _counting(spark, spark.createDataFrame(pdf))
    got = scale.exact_percentiles(df, [], ps, group_rows=60, known_group_rows=900).first()
    assert all(np.isclose(got[n], pdf[c].quantile(p)) for n, (c, p) in ps.items())
    assert seen.value == 2 * 900


def test_kept_sketches_save_a_pass_and_never_change_results(spark):
    pdf = _hot(np.random.default_rng(14))
    base = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("k") != 5, F.col("v")))
    pdf.loc[pdf.k == 5, "v"] = np.nan
    wanted = {"m": ("v", 0.5), "top": ("v", 1.0), "low": ("w", 0.0), "q": ("w", 0.37)}
    parts = [scale.quantile_sketches(base.filter(f"id % 3 = {i}"), ["k"], ["v", "w"], k=64) for i in range(3)]
    good = scale.cut_lineage(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    shifted = scale.cut_lineage(scale.quantile_sketches(base.withColumns({"v": F.col("v") + 9, "w": F.col("w") - 9}), ["k"], ["v", "w"]))
    foreign = good.withColumn("k", F.when(F.col("k") == 3, 77).otherwise(F.col("k")))
    for kept in (good, shifted, foreign, good.filter("_c = 'w'")):
        df, seen = _counting(spark, base)
        got = scale.exact_percentiles(df, ["k"], wanted, group_rows=60, sketches=kept, k=64).toPandas().set_index("k").sort_index()
        assert len(got) == pdf.k.nunique()
        for k, g in pdf.groupby("k"):
            for n, (c, p) in wanted.items():
                assert np.isclose(got.loc[k, n], g[c].quantile(p), equal_nan=True), (k, n)
        if kept is good:  # the ordinary groups are read once by the direct aggregate, the large ones once as well
            assert seen.value == 2 * 900
    one = scale.exact_percentiles(base, [], wanted, group_rows=60, sketches=scale.quantile_sketches(base, [], ["v", "w"])).first()
    assert np.isclose(one["m"], pdf.v.median()) and np.isclose(one["q"], pdf.w.quantile(0.37))
    empty = scale.exact_percentiles(base.limit(0), [], wanted, known_group_rows=10**9).first()
    assert empty["m"] is None and empty["q"] is None
