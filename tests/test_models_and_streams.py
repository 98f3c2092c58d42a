"""Fits that end by themselves, and streams that are closed."""

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from emberfield.models import trees
from emberfield.streaming import observations


def test_held_rows_end_the_fit(spark):
    rng = np.random.default_rng(21)
    x = rng.uniform(0, 1, (600, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(cell_id=range(600))
    pdf["lst_celsius"] = 30 + 5 * (x[:, 0] > 0.5) + rng.normal(0, 0.3, 600)
    df = spark.createDataFrame(pdf)
    params = trees.TreeParams(rounds=12, depth=2, rate=0.5, bins=16, row_share=1.0, column_share=1.0)
    every, _, _ = trees.train_lst(df, ["cell_id"], ["a", "b", "c"], params=params)
    assert every.stage.getNumTrees == 12
    ended, predictions, metrics = trees.train_lst(
        df, ["cell_id"], ["a", "b", "c"], params=trees.TreeParams(**{**params.__dict__, "stop_tol": 0.05})
    )
    assert 1 <= ended.stage.getNumTrees < 12
    assert {r["split"]: r["rows"] for r in metrics.collect()} == {"val": 60, "test": 60}
    assert min(r["r2"] for r in metrics.collect()) > 0.8
    # medians and trees come from the training rows alone: held rows only end the fit
    parts = trees.train_val_test_split(df, ["cell_id"]).filter("split = 'train'").toPandas()
    assert all(np.isclose(ended.medians[c], parts[c].median()) for c in "abc")


def test_dated_histories_train_both_models(spark):
    rows = [(g, i, float(25 + i % 4 + 20 * (g == 7 and i % 2 == 0)), 0.1 * g) for g in range(8) for i in range(30)]
    df = spark.createDataFrame(rows, "grid_id long, date int, lst_celsius double, NDVI double").withColumn("cell_id", F.col("grid_id") * 100 + F.col("date"))
    ready = trees.prepare_future(df)
    assert ready.filter("hotspot_label = 1").count() == 15
    params = trees.TreeParams(rounds=6, depth=2, bins=16, rate=0.3, stop_tol=0.01)
    reg, cls, scored = trees.train_future(ready, ["cell_id"], ["NDVI", "lst_lag_1yr", "lst_lag_2yr", "lst_trend_5yr"], params)
    got = {r["hotspot_label"]: r["n"] for r in scored.groupBy("hotspot_label").agg(F.count("predicted_lst").alias("n")).collect()}
    assert got == {0: 45, 1: 3} and cls.majority is None and reg.stage.getNumTrees <= 6


def _runs(spark, tmp_path, parts):
    """Windows after each part has landed and been processed by one checkpoint, and the rows left in state."""
    landed, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "event_id long, grid_id string, ts timestamp, lst_celsius double"
    seen = []
    for part in parts:
        rows = part if hasattr(part, "write") else spark.createDataFrame(part, schema)
        rows.write.mode("append").parquet(landed)
        stream = observations.windowed_observations(spark.readStream.schema(rows.schema).parquet(landed))
        progress = observations.run_available(stream, out, state)
        kept = [op["numRowsTotal"] for op in progress[-1]["stateOperators"]]
        seen.append((spark.read.schema(stream.schema).parquet(out).collect(), kept))
    return seen


def test_closing_row_writes_every_window_and_empties_the_state(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 5, 1, h, m)
    first = [(1, "a", at(1, 5), 30.0), (2, "a", at(1, 50), 34.0), (3, "b", at(5, 10), 40.0), (3, "b", at(5, 10), 40.0)]
    second = [(4, "a", at(6, 30), 20.0), (1, "a", at(6, 40), 10.0), (5, "b", at(9, 59), 50.0), (6, "c", at(2, 0), 99.0)]
    schema = spark.createDataFrame(first, "event_id long, grid_id string, ts timestamp, lst_celsius double").schema
    end = observations.closing_row(spark, schema, at(9, 59))
    (one, _), (two, open_rows), (three, closed) = _runs(spark, tmp_path, [first, second, end])
    key = lambda rows: sorted((r["grid_id"], r["window_start"].hour, r["n"], r["max_value"]) for r in rows)
    assert key(one) == [("a", 1, 2, 34.0)]
    # an id is remembered only for the lateness: event 1 comes again five hours later and counts; event 6 is late
    assert key(two) == [("a", 1, 2, 34.0), ("a", 6, 2, 20.0), ("b", 5, 1, 40.0)]
    assert key(three) == [("a", 1, 2, 34.0), ("a", 6, 2, 20.0), ("b", 5, 1, 40.0), ("b", 9, 1, 50.0)]
    assert open_rows == [1, 3]  # watermark 7:59: the window of 9:59, and the ids of 6:30, 6:40 and 9:59
    assert closed == [1, 1]  # only the closing row's own window and id stay


def test_future_rows_are_made_once_and_narrow(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n = F.col("id")
    rows = spark.range(200).select(n.alias("cell_id"), (n % 40).cast("double").alias("lst_celsius"), (n % 40 == 39).cast("int").alias("hotspot_label"))
    rows = rows.withColumns({"a": (F.col("cell_id") % 7) / F.lit(7.0), **{f"unused{i}": F.col("cell_id") * i for i in range(20)}})
    rows = rows.mapInArrow(count, rows.schema)
    split, medians, given, fits = trees.train_val_test_split, trees.fit_medians, [], []
    monkeypatch.setattr(trees, "train_val_test_split", lambda df, *a, **k: given.append(df.columns) or split(df, *a, **k))
    monkeypatch.setattr(trees, "fit_medians", lambda df, cols: fits.append(cols) or medians(df, cols))
    params = trees.TreeParams(rounds=1, depth=1, bins=8)
    reg, cls, scored = trees.train_future(rows, ["cell_id"], ["a"], params)
    assert scored.count() == 40 and scored.filter("hotspot_label = 1").count() == 1
    assert cls.medians == reg.medians and cls.medians.keys() == {"a"}
    assert seen.value == 200 and fits == [["a"]]
    assert given == [["cell_id", "lst_celsius", "hotspot_label", "a"]]
    given.clear()
    trees.train_lst(rows, ["cell_id"], ["a"], params=params)
    assert set(given[0]) == {"cell_id", "lst_celsius", "a"}
