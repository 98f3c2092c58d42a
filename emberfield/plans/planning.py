"""Budgeted intervention plans: rows of (plan_id, ward_id, intervention_type, frac)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield import schema as S
from emberfield.functions.bands import clip
from emberfield.functions.scalars import intervention_color, intervention_label, lookup
from emberfield.operators.actions import Model, delta_t
from emberfield.operators.stats import gini
from emberfield.scale import as_large, cut_lineage, hash_uniform, ship_if_small, ship_package, work_partitions


def clean_types(plan: DataFrame) -> DataFrame:
    """Intervention types rounded half to even and kept within 0 to 4."""
    return plan.withColumn(
        "intervention_type", clip(F.bround(F.col("intervention_type").cast("double"), 0), 0.0, 4.0).cast("int")
    )


def ward_deltas(wards: DataFrame, model: Model) -> DataFrame:
    """Temperature drop per (ward, type), computed once per ward instead of once per plan and ward.

    Also carries area, population (null as 1) and vulnerability (null as 0.5).
    """
    typed = wards.withColumn("intervention_type", F.explode(F.array(*[F.lit(t) for t in S.INTERVENTION_TYPES])))
    out = delta_t(typed, model, F.col("intervention_type"))
    # five rows per ward, used several times below: kept, so that the cells are read once
    return cut_lineage(
        out.select(
            "ward_id", "intervention_type", "delta_T", "area_m2",
            F.coalesce("pop_density", F.lit(1.0)).alias("population"), F.coalesce("HVI", F.lit(0.5)).alias("hvi"),
        )
    )


def plan_costs(plan: DataFrame, area: Column | float = 10_000.0) -> DataFrame:
    """Add ``cost`` = unit cost x treated area."""
    area = area if isinstance(area, Column) else F.lit(float(area))
    return plan.withColumn("cost", lookup("intervention_type", S.PLAN_COSTS) * area * F.col("frac"))


def repair_budget(plan: DataFrame, budget: float = S.PLAN_BUDGET, area: Column | float = 10_000.0) -> DataFrame:
    """Scale all fractions of a plan that exceeds the budget; adds ``frac_repaired``.

    Plan totals are aggregated and joined back, so a plan of any length is summed in parts.
    """
    priced = plan_costs(plan, area)
    totals = as_large(priced.groupBy("plan_id").agg(F.sum("cost").alias("_total")))
    scaled = F.when(F.col("_total") > budget, F.col("frac") * (F.lit(float(budget)) / F.col("_total"))).otherwise(
        F.col("frac")
    )
    return priced.join(totals, "plan_id").withColumn("frac_repaired", clip(scaled, 0.0, 1.0)).drop("_total")


def _with_deltas(plan: DataFrame, deltas: DataFrame) -> DataFrame:
    """Plan rows beside the temperature drop of their ward and type; a row without one stops the job."""
    known = ship_if_small(deltas.withColumn("_known", F.lit(True)))
    both = plan.join(known, ["ward_id", "intervention_type"], "left")
    unknown = F.concat(F.lit("no temperature drop for ward "), F.coalesce(F.col("ward_id").cast("string"), F.lit("null")))
    return both.filter(F.when(F.col("_known"), True).otherwise(F.raise_error(unknown).cast("boolean"))).drop("_known")


def score_plans(plan: DataFrame, deltas: DataFrame, budget: float = S.PLAN_BUDGET) -> DataFrame:
    """Fitness and its parts per plan, after budget repair."""
    joined = _with_deltas(plan, deltas)
    fixed = repair_budget(joined, budget, F.col("area_m2"))
    f = F.col("frac_repaired")
    cooling = F.col("delta_T") * f
    cost = lookup("intervention_type", S.PLAN_COSTS) * F.col("area_m2") * f
    parts = fixed.groupBy("plan_id").agg(
        F.avg(cooling).alias("mean_delta_C"),
        F.sum(cooling * F.col("population")).alias("population_benefit"),
        F.sum(cooling * F.col("hvi")).alias("equity_benefit"),
        F.sum(cost).alias("total_cost_inr"),
        F.count(F.lit(1)).alias("_n"),
    )
    fitness = (
        F.lit(0.40) * F.col("mean_delta_C") + F.lit(0.25) * F.col("population_benefit") / F.col("_n")
        + F.lit(0.25) * F.col("equity_benefit") / F.col("_n")
        + F.lit(0.10) * (F.lit(1.0) - F.col("total_cost_inr") / F.lit(max(budget, 1.0)))
    )
    return parts.withColumn("fitness", fitness).drop("_n")


def plan_objectives(plan: DataFrame, deltas: DataFrame, budget: float = S.PLAN_BUDGET) -> DataFrame:
    """Four objectives to minimise (cooling and benefit negated, cost, inequality) and the budget excess."""
    joined = _with_deltas(clean_types(plan).withColumn("frac", clip("frac", 0.0, 1.0)), deltas)
    treated = F.col("area_m2") * F.col("frac")
    sums = joined.groupBy("plan_id").agg(
        (-F.sum(F.col("delta_T") * treated)).alias("neg_cooling"),
        (-F.sum(F.col("delta_T") * F.col("population") * F.col("frac"))).alias("neg_benefit"),
        F.sum(lookup("intervention_type", S.PLAN_COSTS) * treated).alias("total_cost"),
    )
    fair = gini(joined, ["plan_id"], F.col("frac") * (F.col("intervention_type") > 0).cast("double"), "inequality")
    return sums.join(fair, "plan_id").withColumn("excess", F.col("total_cost") - F.lit(float(budget)))


# --------------------------------------------------------------------------------------------------
# pareto front
# --------------------------------------------------------------------------------------------------


def _dominated(targets: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """For each target row: some source is nowhere worse and somewhere better."""
    out = np.zeros(len(targets), dtype=bool)
    for i in range(0, len(targets), 256):
        t = targets[i : i + 256, None, :]
        out[i : i + 256] = ((sources[None] <= t).all(2) & (sources[None] < t).any(2)).any(1)
    return out


def front_blocks(vectors: DataFrame, objs: Sequence[str], rows: int, block_rows: int) -> DataFrame:
    """The vectors as blocks of neighbours, one row each: ``block``, ``n``, corners ``lo`` and ``hi``, ``points``.

    Every objective is cut at its quantiles, so that a block is a cell of a grid that follows the data; a cell of more
    than ``block_rows`` vectors is dealt out by hash.
    """
    wanted = -(-rows // block_rows)
    cuts = max(1, round(wanted ** (1 / len(objs)))) if wanted > 1 else 1
    placed = vectors
    if cuts > 1:
        steps = [i / cuts for i in range(1, cuts)]
        bounds = vectors.agg(*[F.percentile_approx(c, steps).alias(c) for c in objs]).first()
        bins = [sum((F.col(c) > F.lit(v)).cast("int") for v in sorted(set(bounds[c]))) for c in objs]
    else:
        bins = [F.lit(0) for _ in objs]
    placed = vectors.withColumn("_cell", F.array(*bins))
    if wanted > 1:
        parts = placed.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("long").alias("_parts"))
        placed = placed.join(F.broadcast(parts), "_cell")  # at most cuts ^ objectives rows, about rows / block_rows
        placed = placed.withColumn("_part", F.pmod(F.xxhash64(*objs), F.col("_parts")))
    else:
        placed = placed.withColumn("_part", F.lit(0).cast("long"))
    packed = placed.groupBy("_cell", "_part").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(c) for c in objs]).alias("lo"), F.array(*[F.max(c) for c in objs]).alias("hi"),
        *[F.collect_list(c).alias(c) for c in objs],
    )
    return packed.withColumn("block", F.monotonically_increasing_id()).drop("_cell", "_part")


def meeting_blocks(blocks: DataFrame, dims: int) -> DataFrame:
    """(t, s) of the blocks in which a vector of s can dominate one of t: s begins nowhere beyond t's end, and they are not
    a pair of which one corner box lies beyond the other's. Only corners are compared here, no vectors."""
    heads = cut_lineage(blocks.select("block", "lo", "hi"))
    t = heads.select(F.col("block").alias("t"), F.col("hi").alias("_hi"))
    s = heads.select(F.col("block").alias("s"), F.col("lo").alias("_lo"))
    possible = [F.col("_lo")[i] <= F.col("_hi")[i] for i in range(dims)]
    return t.join(F.broadcast(s), reduce(lambda a, b: a & b, possible)).select("t", "s")


def pareto_front(
    plans: DataFrame, objectives: Sequence[str], feasible: Column | None = None, block_rows: int = 4096
) -> DataFrame:
    """Feasible plans that no other feasible plan dominates. A null objective stops the job: it cannot be compared.

    1. Equal objective vectors are merged, so copies cost nothing.
    2. Every task drops what its own rows dominate (dominance is transitive, so nothing is lost).
    3. Survivors are packed into blocks of neighbours; only blocks whose corners allow dominance meet, one bounded pair of
       blocks at a time, and there only the vectors within the other block's reach are compared.
    """
    objs = list(objectives)
    ship_package(plans.sparkSession)
    for c in objs:
        known = F.col(c).isNotNull()
        plans = plans.filter(F.when(known, True).otherwise(F.raise_error(F.lit(f"null objective {c}")).cast("boolean")))
    rows = cut_lineage(plans if feasible is None else plans.filter(feasible))
    vectors = rows.select(*[F.col(c).cast("double").alias(c) for c in objs]).distinct()
    schema = ", ".join(f"{c} double" for c in objs)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.empty((0, len(objs)))
        for pdf in batches:
            v = pdf[objs].to_numpy(float)
            v = v[~_dominated(v, best)] if len(best) else v
            slices = [v[i : i + block_rows] for i in range(0, len(v), block_rows)]
            v = np.concatenate([s[~_dominated(s, s)] for s in slices]) if slices else v
            yield pd.DataFrame(v, columns=objs)
            pool = np.concatenate([best, v])
            best = pool[np.argsort(pool.sum(1), kind="stable")[:512]]

    def beaten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[i]
                t, s = (np.column_stack([row[f"{side}_{c}"] for c in objs]) for side in "ts")
                s = s[(s <= t.max(axis=0)).all(axis=1)]
                if len(s):
                    t = t[(t >= s.min(axis=0)).all(axis=1)]
                yield pd.DataFrame(t[_dominated(t, s)] if len(s) else t[:0], columns=objs)

    kept = cut_lineage(vectors.mapInPandas(local, schema))
    count = kept.count()
    blocks = cut_lineage(front_blocks(kept, objs, count, block_rows))
    side = lambda k: blocks.select(F.col("block").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in objs])
    met = meeting_blocks(blocks, len(objs)).repartition(work_partitions(plans.sparkSession), "t", "s").join(side("t"), "t").join(side("s"), "s")
    lost = met.drop("t", "s").mapInPandas(beaten, schema).distinct()
    front = kept.join(lost, objs, "left_anti")
    return rows.join(front, objs, "left_semi").select(*plans.columns)


# --------------------------------------------------------------------------------------------------
# candidates and output
# --------------------------------------------------------------------------------------------------


def generate_plans(wards: DataFrame, n: int, seed: int = 42, chunk: int = 10_000) -> DataFrame:
    """``n`` random candidate plans over the wards: type 0-4 and fraction in [0, 1), reproducible on any cluster.

    Wards are multiplied in two steps (chunks, then plans of a chunk), spread out in between.
    """
    chunks = (
        wards.select("ward_id")
        .distinct()
        .withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // chunk))))
        .repartition("ward_id", "_c")
    )
    first = F.col("_c") * F.lit(chunk)
    last = F.least(first + F.lit(chunk), F.lit(n)) - F.lit(1)
    rows = chunks.withColumn("plan_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return rows.select(
        "plan_id", "ward_id",
        F.floor(hash_uniform(["plan_id", "ward_id"], f"{seed}:type") * F.lit(5.0)).cast("int").alias("intervention_type"),
        hash_uniform(["plan_id", "ward_id"], f"{seed}:frac").alias("frac"),
    )


def best_plan(plan: DataFrame, scores: DataFrame) -> DataFrame:
    """Ward rows of the plan with the highest fitness (lowest id on a tie)."""
    best = scores.agg(
        F.min(F.struct((-F.round("fitness", 9)).alias("f"), "plan_id"))["plan_id"].alias("plan_id")
    ).scalar()
    return plan.filter(F.col("plan_id") == best).select(
        "plan_id", "ward_id", "intervention_type", intervention_label("intervention_type").alias("intervention_label"),
        F.col("frac").alias("intervention_frac"),
    )


def plan_map(wards: DataFrame, plan: DataFrame) -> DataFrame:
    """Wards with their planned action; a ward without one gets type 0. Keys are compared as text."""
    p = plan.withColumn("ward_id", F.col("ward_id").cast("string"))
    out = wards.withColumn("ward_id", F.col("ward_id").cast("string")).join(p, "ward_id", "left")
    out = out.withColumn("intervention_type", F.coalesce(F.col("intervention_type"), F.lit(0)).cast("int"))
    return out.withColumns(
        {
            "intervention_label": intervention_label("intervention_type"),
            "map_color": intervention_color("intervention_type"),
        }
    )
