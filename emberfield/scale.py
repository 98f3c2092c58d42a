"""Helpers that keep work spread over the cluster whatever the key distribution.

Four recurring needs are met here, so that no operator has to gather an unbounded group in one task:

* exact percentiles (globally, or per key with some keys holding a large share of all rows),
* exact row numbers inside a key that spans many partitions,
* series windows over a key too long for one task,
* exact "first n rows in hash order" cuts for samples and splits.
"""

from __future__ import annotations

import atexit
import bisect
import math
import os
import tempfile
import zipfile
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows a single group may bring to one task before it is split up.
GROUP_ROWS = 2_000_000
# Rows of a narrow (numeric) table that may be shipped to every executor.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder. Without one, a local session makes its own; a cluster must name one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="emberfield-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages restart from shared files, not from the lost executor's work."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Put this package on the workers' path, once a session, wherever the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_emberfield_shipped", False):
        return
    top = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="emberfield-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(f.name)  # served by the driver to every executor
    atexit.register(lambda: os.path.exists(f.name) and os.remove(f.name))
    sc._emberfield_shipped = True


def work_partitions(spark: SparkSession) -> int:
    """Partitions for stages that compute much on few bytes, where coalescing by size would starve the cores."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after the row count is known to be under the limit; otherwise a plain shuffle join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def as_large(df: DataFrame) -> DataFrame:
    """A table whose rows follow the input, for a join: sorted and merged, never sent to every executor. Spark's size
    estimates of derived rows start from the pruned file and may be far too small."""
    return df.hint("merge")


def scalar_struct(df: DataFrame, aggs: Mapping[str, Column]) -> Column:
    """Global aggregates as one scalar subquery: no cross join and no single-partition window."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggs.items()]).alias("g")).scalar()


# --------------------------------------------------------------------------------------------------
# percentiles
# --------------------------------------------------------------------------------------------------


# Size of a quantile sketch (bytes grow with it); its brackets leave about SLACK / k^0.9 of the rows on either side.
SKETCH_K = 4096
SLACK = 4.0


def quantile_sketches(df: DataFrame, keys: Sequence[str], cols: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """Mergeable quantile sketches to keep beside a table: one row per key and column (``_c``, ``_n``, ``_s``).

    Sketches of a table's parts (days, say) are appended as the parts land; ``exact_percentiles`` merges whatever rows of
    a key it is given. They only say where to look, so outdated or foreign sketches cost time and change no result.
    """
    rows = _long(df, list(keys), cols).filter(F.col("_v").isNotNull())
    return rows.groupBy(*keys, "_c").agg(F.count("_v").alias("_n"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("_s"))


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    group_rows: int = GROUP_ROWS,
    known_group_rows: int | None = None,
    sketches: DataFrame | None = None,
    k: int = SKETCH_K,
) -> DataFrame:
    """Exact interpolated percentiles: one row per key with a column per ``wanted`` (name -> (column, p)).

    Spark's ``percentile`` holds every distinct value of a group in one task. That is right for ordinary
    groups; groups above ``group_rows`` are instead narrowed to a small value bracket and read off there.
    ``known_group_rows`` is a bound on the group size that the caller already knows (saves the counting job).
    ``sketches`` are kept ones of the same keys and columns: they give sizes and brackets without a pass.
    """
    keys = list(keys)
    cols = sorted({c for c, _ in wanted.values()})
    budget = max(1, group_rows // max(1, len(cols)))
    if sketches is not None:
        sketches = sketches.filter(F.col("_c").isin(cols))

    def direct(part: DataFrame) -> DataFrame:
        aggs = [F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in wanted.items()]
        return part.groupBy(*keys).agg(*aggs) if keys else part.agg(*aggs)

    def sizes() -> DataFrame:
        if sketches is None:
            return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        return sketches.groupBy(*keys, "_c").agg(F.sum("_n").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("_n"))

    if known_group_rows is not None:
        peak = known_group_rows
    elif keys or sketches is not None:
        peak = sizes().agg(F.max("_n")).first()[0] or 0
    else:
        peak = df.count()
    if peak <= budget:
        return direct(df)
    if not keys:
        return _narrowed(df, [], wanted, k, sketches)
    hot = cut_lineage(sizes().filter(F.col("_n") > budget).drop("_n"))
    hot = ship_if_small(hot)
    return direct(df.join(hot, keys, "left_anti")).unionByName(
        _narrowed(df.join(hot, keys, "left_semi"), keys, wanted, k, sketches)
    )


def _long(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, _c, _v): one row per row and column."""
    pairs = [F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in cols]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("_s")).select(*keys, "_s._c", "_s._v")


def _brackets(merged: DataFrame, gk: list[str], wanted: Mapping[str, tuple[str, float]], k: int) -> DataFrame:
    """(keys, _c, _at): an array of (p, lo, hi) for each percentile wanted of the column; null bounds are open."""
    slack = SLACK / k**0.9
    quantile = lambda r: F.kll_sketch_get_quantile_double("_s", F.lit(r))
    open_end = F.lit(None).cast("double")
    every = F.array(*[
        F.struct(
            F.lit(c).alias("c"), F.lit(p).alias("p"),
            (open_end if p <= slack else quantile(p - slack)).alias("lo"),
            (open_end if p >= 1 - slack else quantile(p + slack)).alias("hi"),
        )
        for c, p in sorted(set(wanted.values()))
    ])
    mine = F.filter(every, lambda b: b["c"] == F.col("_c"))
    return merged.select(*gk, F.transform(mine, lambda b: F.struct(b["p"], b["lo"], b["hi"])).alias("_at"))


def _narrowed(
    df: DataFrame, keys: list[str], wanted: Mapping[str, tuple[str, float]], k: int, sketches: DataFrame | None
) -> DataFrame:
    """Percentiles of very large groups, all of them in two passes over the rows, or one where sketches are kept.

    Merged sketches give every percentile a bracket of values. One pass counts the rows below and above each bracket
    and the copies of each value inside (partial sums), so ranks are exact whatever the sketches said; a rank outside
    its bracket has another pass without bounds. Running counts over ranges of the kept values find the range that
    holds the rank, and only its values are put in order.
    """
    gk = [*keys, "_c"]
    cols = sorted({c for c, _ in wanted.values()})
    long = _long(df, keys, cols)
    if sketches is None:
        sketches = quantile_sketches(df, keys, cols, k)
    merged = sketches.groupBy(*gk).agg(F.kll_merge_agg_double("_s").alias("_s"))
    brackets = ship_if_small(cut_lineage(_brackets(merged, gk, wanted, k)))
    open_end = F.lit(None).cast("double")
    ends = {c: sorted({p for d, p in wanted.values() if d == c}) for c in cols}
    anywhere = F.array(*[F.struct(F.lit(c).alias("c"), F.array(*[F.lit(p) for p in ps]).alias("ps")) for c, ps in ends.items()])
    mine = F.filter(anywhere, lambda b: b["c"] == F.col("_c"))[0]["ps"]
    unbounded = F.transform(mine, lambda p: F.struct(p.alias("p"), open_end.alias("lo"), open_end.alias("hi")))

    def counted(rows: DataFrame) -> DataFrame:
        """(keys, _c, _p, _side, _v, _m): side -1 below, 0 inside with its value, 1 above, 2 null."""
        v, lo, hi = F.col("_v"), F.col("_b.lo"), F.col("_b.hi")
        side = F.when(v.isNull(), 2).when(v < lo, -1).when(v > hi, 1).otherwise(0)
        met = rows.withColumn("_b", F.explode("_at")).select(*gk, F.col("_b.p").alias("_p"), side.alias("_side"), "_v")
        inside = F.when(F.col("_side") == 0, F.col("_v"))
        return cut_lineage(met.groupBy(*gk, "_p", "_side", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_m")))

    def ranked(held: DataFrame) -> DataFrame:
        """(keys, _c, _p, _n, _below, _held, _pos): where the wanted ranks are."""
        total = lambda which: F.coalesce(F.sum(F.when(which, F.col("_m"))), F.lit(0))
        side = F.col("_side")
        tally = held.groupBy(*gk, "_p").agg(
            total(side < 2).alias("_n"), total(side == -1).alias("_below"), total(side == 0).alias("_held")
        )
        return cut_lineage(tally.withColumn("_pos", F.col("_p") * (F.col("_n") - 1)))

    near = long.join(brackets, gk, "left").withColumn("_at", F.coalesce("_at", unbounded))
    held = counted(near)
    ranks = ranked(held)
    first, last = F.floor("_pos"), F.ceil("_pos")
    missed = (F.col("_n") > 0) & ((first < F.col("_below")) | (last >= F.col("_below") + F.col("_held")))
    lost = ranks.filter(missed).select(*gk, "_p")
    again = lost.count()
    if again:
        everywhere = F.collect_list(F.struct(F.col("_p").alias("p"), open_end.alias("lo"), open_end.alias("hi")))
        whole = lost.groupBy(*gk).agg(everywhere.alias("_at"))
        lost = ship_if_small(lost, again)
        held = held.join(lost, [*gk, "_p"], "left_anti").unionByName(counted(long.join(ship_if_small(whole, again), gk)))
        ranks = ranked(held)

    # the range of kept values that holds the rank, by running counts over ranges
    kept = held.filter("_side = 0").repartitionByRange(*gk, "_p", "_v")
    kept = cut_lineage(kept.select(*gk, "_p", "_v", "_m", F.spark_partition_id().alias("_part")))
    spans = kept.groupBy(*gk, "_p", "_part").agg(F.sum("_m").alias("_w"))
    earlier = Window.partitionBy(*gk, "_p").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_below") + F.coalesce(F.sum("_w").over(earlier), F.lit(0))
    spans = spans.join(ranks.drop("_held"), [*gk, "_p"]).withColumn("_before", before)
    holds = lambda rank: (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_w"))
    spans = cut_lineage(spans.filter(holds(first) | holds(last)).drop("_w", "_below"))
    w = Window.partitionBy(*gk, "_p", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = kept.join(ship_if_small(spans), [*gk, "_p", "_part"]).withColumn("_upto", F.col("_before") + F.sum("_m").over(w))
    pick = here.groupBy(*gk, "_p", "_pos").agg(
        F.min(F.when(F.col("_upto") > first, F.col("_v"))).alias("_a"), F.min(F.when(F.col("_upto") > last, F.col("_v"))).alias("_b")
    )
    value = F.when(first == last, F.col("_a")).otherwise((last - F.col("_pos")) * F.col("_a") + (F.col("_pos") - first) * F.col("_b"))
    aggs = [F.max(F.when((F.col("_c") == c) & (F.col("_p") == p), value)).alias(n) for n, (c, p) in wanted.items()]
    if not keys:
        return pick.agg(*aggs)
    # a key whose values are all null still has a row, as with the direct aggregate
    return ranks.select(*keys).distinct().join(pick.groupBy(*keys).agg(*aggs), keys, "left").select(*keys, *wanted)


# --------------------------------------------------------------------------------------------------
# order inside large keys
# --------------------------------------------------------------------------------------------------


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_rn") -> DataFrame:
    """1-based row number inside each key, exact also when one key spans many partitions.

    One range shuffle on (keys, order); the offset of a partition inside its key comes from a table with one
    row per (key, partition).
    """
    keys, order = list(keys), list(order)
    placed = cut_lineage(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    spans = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_m"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_m").over(earlier), F.lit(0))).drop("_m")
    return (
        placed.join(spans, [*keys, "_part"])
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
        .drop("_at", "_part", "_first", "_before")
    )


def split_series(
    df: DataFrame, key: str, order: Sequence[str], back: int, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Add ``_chunk`` and ``_warm`` so that windows over (key, _chunk) looking at most ``back`` rows back are exact.

    Keys within ``group_rows`` stay in one chunk. Longer keys are cut into chunks of ``group_rows`` rows; each
    chunk also receives the last ``back`` rows of the chunk before it, marked ``_warm`` for the caller to drop.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    plain = {"_chunk": F.lit(0).cast("long"), "_warm": F.lit(False)}
    peak = sizes.agg(F.max("_n")).first()[0] or 0
    if peak <= group_rows:
        return df.withColumns(plain)
    hot = ship_if_small(cut_lineage(sizes.filter(F.col("_n") > group_rows).drop("_n")))
    size = max(group_rows, back)
    numbered = cut_lineage(number_rows(df.join(hot, key, "left_semi"), [key], order))
    slot = F.col("_rn") - 1
    home = numbered.withColumns({"_chunk": F.floor(slot / size), "_warm": F.lit(False)})
    ahead = numbered.filter(slot % size >= size - back).withColumns(
        {"_chunk": F.floor(slot / size) + 1, "_warm": F.lit(True)}
    )
    return (
        df.join(hot, key, "left_anti")
        .withColumns(plain)
        .unionByName(home.drop("_rn"))
        .unionByName(ahead.drop("_rn"))
    )


# --------------------------------------------------------------------------------------------------
# hash order
# --------------------------------------------------------------------------------------------------


def hash_order(ids: Sequence[str], seed: int) -> Column:
    """Seeded, machine-independent order key of a row: the hex md5 of its id columns and the seed."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def hash_cuts(hashes: DataFrame, counts: Sequence[int], digits: int = 5, last_rows: int = 4096) -> list[str | None]:
    """For each n of ``counts`` the n-th hash in order, of the column ``_h`` of hex hashes; None if there are no more than
    n rows ("" for n = 0).

    Radix selection for all cuts at once: one aggregate counts the rows of 16^digits prefixes, and what remains of each
    cut is looked for among the rows of its prefix alone, until these are few.
    """
    found: list[str | None] = ["" if n <= 0 else None for n in counts]
    todo = {i: ("", n) for i, n in enumerate(counts) if n > 0}
    while todo:
        inside = [p for p, _ in todo.values()]
        width = len(inside[0]) + digits
        here = hashes if width == digits else hashes.filter(F.substring("_h", 1, width - digits).isin(inside))
        table = here.groupBy(F.substring("_h", 1, width).alias("b")).agg(F.count(F.lit(1)).alias("m")).toArrow().sort_by("b")
        names, sizes = table["b"].to_pylist(), table["m"].to_numpy()
        few, later = {}, {}
        for i, (prefix, n) in todo.items():
            first, last = bisect.bisect_left(names, prefix), bisect.bisect_left(names, prefix + "g")
            upto = sizes[first:last].cumsum()
            at = int(upto.searchsorted(n))
            if at == len(upto):
                continue  # fewer than n rows
            left = n - int(upto[at] - sizes[first + at])
            (few if sizes[first + at] <= last_rows or width >= 30 else later)[i] = (names[first + at], left)
        for i, (prefix, left) in few.items():
            ends = hashes.filter(F.col("_h").startswith(prefix)).orderBy("_h").limit(left)
            found[i] = ends.agg(F.max("_h")).first()[0]
        todo = later
    return found


def in_hash_order(df: DataFrame, ids: Sequence[str], seed: int, counts: Sequence[int]) -> tuple[DataFrame, list[Column]]:
    """The table, written once, and for each n of ``counts`` a predicate true for exactly its first ``n`` rows in hash
    order (ids unique). The input is computed once however many cuts there are, and never sorted."""
    held = cut_lineage(df.withColumn("_h", hash_order(ids, seed)))
    cuts = hash_cuts(held.select("_h"), counts)
    return held, [F.lit(True) if c is None else F.col("_h") <= F.lit(c) for c in cuts]


def first_in_hash_order(df: DataFrame, ids: Sequence[str], seed: int, n: int) -> Column:
    """Predicate on ``df`` itself true for exactly the first ``n`` rows in hash order (ids unique)."""
    h = hash_order(ids, seed)
    cut = hash_cuts(df.select(h.alias("_h")), [n])[0]
    return F.lit(True) if cut is None else h <= F.lit(cut)


def hash_uniform(cols: Sequence[Column | str], salt: str) -> Column:
    """Reproducible uniform number in [0, 1) from the columns and a salt (52 bits of an md5)."""
    text = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols], F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def split_sizes(total: int, parts: Sequence[float]) -> list[int]:
    """Row counts of consecutive parts; the last takes the remainder."""
    sizes = [math.floor(total * p + 1e-9) for p in parts[:-1]]
    return [*sizes, total - sum(sizes)]
