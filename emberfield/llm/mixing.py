"""Mixing sources to target weights, in DataFrame operations only.

Temperature mixing gives a source of token share s the weight s^a / sum(s^a). The exponent a is bisected to meet a
target entropy or a limit on repetition. A source's documents are dealt into blocks by hash; each pass over a source
is a permutation of its blocks, and the last, partial pass ends where the source's token budget does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.scale import cut_lineage, ship_if_small

MAX_PASSES = 2.0
# Tokens of a block; the number of blocks follows the size of the source.
BLOCK_TOKENS = 1_000_000
# Exponents tried at once: each round of one small job narrows the bracket by this factor, like so many halvings.
SECTIONS = 64
ROUNDS = 8
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Words of a text as its token count; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _bisect(shares: DataFrame, measure, target: float, low: float, high: float) -> float:
    """The exponent in [low, high] at which the rising ``measure(exponent)`` of all shares reaches ``target``."""
    for _ in range(ROUNDS):
        tried = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        got = shares.agg(*[measure(a).alias(f"m{k}") for k, a in enumerate(tried)]).first()
        reached = next((k for k, v in enumerate(got) if v is not None and v >= target), None)
        if reached is None:
            return high
        if reached == 0:
            return low
        low, high = tried[reached - 1], tried[reached]
    return high


def exponent(shares: DataFrame, entropy: float | None = None, passes: float | None = None) -> float:
    """The exponent for a target entropy (nats) of the weights, or the least one whose passes keep to the limit.

    ``shares`` has a positive column ``share`` and sums to one. A smaller exponent is a flatter mix. Only the sums of
    a job over the sources come to the driver. A target that no exponent in [0, 1] meets gives the nearest end.
    """
    log = F.log("share")

    def less_entropy(a: float) -> Column:
        total = F.sum(F.exp(log * a))
        return F.sum(F.exp(log * a) * log * a) / total - F.log(total)

    def fewer_passes(a: float) -> Column:
        # the largest source has one pass; the smallest, by its share, the most
        return -F.max(log * (a - 1)) + F.min(log * (a - 1))

    if entropy is not None:
        return _bisect(shares, less_entropy, -entropy, 0.0, 1.0)
    return _bisect(shares, fewer_passes, -math.log(passes or MAX_PASSES), 0.0, 1.0)


def plan(narrow: DataFrame, entropy: float | None = None, passes: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per source (source, n_tokens, weight, budget, passes, blocks and where its last pass ends).

    ``narrow`` has source, n_tokens and h, the document's hash. Without a budget it is the least that takes every
    source through at least one whole pass, so nothing is left out.
    """
    sizes = cut_lineage(narrow.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens")))
    whole = sizes.filter("n_tokens > 0")
    all_tokens = whole.agg(F.sum("n_tokens")).first()[0]
    if all_tokens is None:
        return sizes.select("source", "n_tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(1).cast("long").alias("passes"), F.lit(1).cast("long").alias("blocks"), *[F.lit(None).cast("long").alias(c) for c in ("cut_block", "cut_order", "cut_h")])
    shares = whole.withColumn("share", F.col("n_tokens") / F.lit(float(all_tokens)))
    a = exponent(shares, entropy, passes)
    total, scale = shares.agg(F.sum(F.pow("share", F.lit(a))), F.max(F.pow("share", F.lit(1 - a)))).first()
    wanted = F.lit(float(budget)) if budget is not None else F.lit(all_tokens * scale * total)
    weight = F.pow(F.col("n_tokens") / F.lit(float(all_tokens)), F.lit(a)) / total
    # a budget within a token of whole passes is those passes
    tokens_of = F.floor(weight * wanted + 0.5).cast("long")
    rows = sizes.withColumn("weight", F.when(F.col("n_tokens") > 0, weight).otherwise(0.0))
    rows = rows.withColumn("budget", F.when(F.col("n_tokens") > 0, tokens_of).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("passes", F.when(F.col("n_tokens") > 0, F.floor(F.col("budget") / F.greatest("n_tokens", F.lit(1)))).otherwise(F.lit(1)).cast("long"))
    rows = rows.withColumn("blocks", F.ceil(F.greatest(F.col("n_tokens"), F.lit(1)) / F.lit(block_tokens)).cast("long"))
    rows = cut_lineage(rows)

    placed = with_plan(narrow, rows).select("source", "n_tokens", "h", "blocks", "passes", rest())
    placed = placed.select("source", "n_tokens", "h", "rest", block().alias("block"), order("passes").alias("order"))
    blocks = placed.groupBy("source", "block", "order", "rest").agg(F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1))
    ends = blocks.withColumn("before", F.coalesce(before, F.lit(0))).filter("before <= rest and before + n_tokens > rest")
    ends = cut_lineage(ends.groupBy("source").agg(F.min(F.struct("order", "block", (F.col("rest") - F.col("before")).alias("left"))).alias("e")))
    inner = placed.join(ship_if_small(ends.select(F.col("source").alias("_s"), F.col("e.block").alias("_b"), F.col("e.left").alias("left"))), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    inner = inner.groupBy("source", "left", "h").agg(F.sum("n_tokens").alias("n_tokens"))
    upto = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h"))
    last = inner.withColumn("upto", upto).filter("upto <= left").groupBy("source").agg(F.max("h").alias("cut_h"))
    last = last.withColumnRenamed("source", "_s")
    ends = ends.select("source", F.col("e.block").alias("cut_block"), F.col("e.order").alias("cut_order"))
    ends = ends.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_t"), "cut_block", "cut_order", "cut_h")
    return cut_lineage(rows.join(ends, F.col("source").eqNullSafe(F.col("_t")), "left").drop("_t"))


def block() -> Column:
    return F.pmod(F.col("h"), F.col("blocks"))


def order(turn: str | Column) -> Column:
    """Where a block stands in the permutation of a pass."""
    return F.xxhash64(F.lit(3), F.col("source"), block(), F.col(turn) if isinstance(turn, str) else turn)


def rest() -> Column:
    return (F.col("budget") - F.col("passes") * F.col("n_tokens_all")).alias("rest")


def with_plan(rows: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """Each document beside its source's plan; the plan is broadcast only while it has few rows."""
    small = plan_rows.withColumnsRenamed({"source": "_source", "n_tokens": "n_tokens_all"})
    return rows.join(ship_if_small(small), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, entropy: float | None = None, passes: float | None = MAX_PASSES, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The chosen rows (whole, as ``row``) with source, n_tokens, pass, block and position.

    By default every document comes at least once and no source more than ``passes`` times; with a ``budget`` of
    tokens the sources share it by weight, large ones then in part. A row appears once for each pass that has it, and
    ``position`` (a hash of source, block and pass, then of the document) orders a shuffled reading. Documents of no
    tokens, such as null and empty texts, go with their block at no cost. A null source is a source. Rows with equal doc_id and text
    are chosen alike, all or none; an empty table gives an empty table. Documents are read twice (to count, to
    choose) and never shuffled while the sources' plan is small.
    """
    h = F.xxhash64(F.col(f"row.{doc_id}"), F.col(f"row.{text}"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.select("row", F.col(f"row.{source}").cast("string").alias("source"), tokens(F.col(f"row.{text}").cast("string")).alias("n_tokens"), h.alias("h"))
    narrow = cut_lineage(rows.select("source", "n_tokens", "h"))
    chosen = with_plan(rows, plan(narrow, entropy, passes, budget, block_tokens))
    partial_order = order("passes")
    partial = (partial_order < F.col("cut_order")) | ((block() == F.col("cut_block")) & (F.col("h") <= F.col("cut_h")))
    turns = F.col("passes") + F.coalesce(partial, F.lit(False)).cast("long")
    out = chosen.withColumn("_turns", turns).filter("_turns > 0").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_turns"))))
    return out.select("row", "source", "n_tokens", "pass", block().alias("block"), F.struct("pass", order(F.col("pass") - 1).alias("block_order"), F.xxhash64("h", "pass").alias("doc_order")).alias("position"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of a mix by position: pass after pass, each a permutation of blocks; one range of positions per task."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, pass, block, block_order, doc_order of every row of the default mix."""
    out = mix(docs.select("doc_id", "text", "source"))
    return out.select("row.doc_id", "source", "n_tokens", "pass", "block", "position.block_order", "position.doc_order")
