"""What several operators need from the cluster: shared folders, whole groups in blocks and
connected components without a driver-side graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.scale import cut_lineage, shared_dir, ship_package

# Rows of one group that are compared with each other at once.
BLOCK_ROWS = 256


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared scratch folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def numbered(rows: DataFrame) -> DataFrame:
    """The rows as (uid, row), written once to the shared folder so that a row's number never changes."""
    folder = shared_path(rows.sparkSession, "numbered")
    rows.select(F.monotonically_increasing_id().alias("uid"), F.struct(*rows.columns).alias("row")).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(work, schema)


def map_column(spark: SparkSession, work: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], kind: str) -> Callable[..., Column]:
    """A function of one column whose values alone go to Python, in Arrow batches."""
    ship_package(spark)
    return F.arrow_udf(work, kind)


def block_pairs(rows: DataFrame, sizes: DataFrame, key: str, item: str, block: int = BLOCK_ROWS) -> DataFrame:
    """Deal each group's rows out so that every pair of them meets in exactly one small cell.

    ``rows`` has the group ``key``, an ``item`` id and any payload; ``sizes`` has ``key`` and its row count ``n``. A
    group of n rows is cut into ceil(n / block) parts by a hash of the item; a cell holds two parts (or one with
    itself), so its size is bounded whatever the group's, and the cells of a large group spread over the cluster.
    Adds ``_cell`` (two part numbers) and ``_part`` (the row's own). Rows are copied once per part of their group.
    """
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = (
        rows.join(sizes.select(key, parts.alias("_parts")), key)
        .withColumn("_part", F.pmod(F.xxhash64(item, F.lit(7)), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    )
    low, high = F.least("_part", "_other"), F.greatest("_part", "_other")
    return dealt.withColumn("_cell", F.struct(low.alias("a"), high.alias("b"))).drop("_parts", "_other")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys, whole, from batches that are sorted by the keys (flat integer columns)."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        changed = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        changed[0] = last is not None and tuple(c[0] for c in columns) != last
        cuts = np.flatnonzero(changed)
        start = 0
        for cut in cuts:
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


CELL = ["key", "a", "b"]


def cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each cell's rows together and in one task, a task holding many cells."""
    flat = rows.select("key", F.col("_cell.a").alias("a"), F.col("_cell.b").alias("b"), F.col("_part").alias("part"), *columns)
    return flat.repartition(*CELL).sortWithinPartitions(*CELL)


def earlier(keys: list[np.ndarray], key: int) -> list[np.ndarray]:
    """Of each row's groups, in their common order, those before the group ``key``."""
    return [k[: int(np.flatnonzero(k == key)[0])] for k in keys]


def open_pairs(earlier: list[np.ndarray]) -> np.ndarray:
    """Square mask of the pairs that share no earlier group, which therefore belong to this one."""
    n = len(earlier)
    if n == 2:
        return np.full((2, 2), not np.intersect1d(*earlier).size)
    values, place = np.unique(np.concatenate(earlier), return_inverse=True)
    has = np.zeros((n, len(values)), dtype=np.float32)
    has[np.repeat(np.arange(n), [len(e) for e in earlier]), place] = 1
    has = has[:, has.sum(axis=0) > 1]
    return has @ has.T < 0.5


def cell_pairs(part: np.ndarray, a: int, b: int) -> np.ndarray:
    """Square mask of a cell's own pairs, each once: inside one part, or across two."""
    if a == b:
        return np.triu(np.ones((len(part), len(part)), dtype=bool), 1)
    return (part == a)[:, None] & (part == b)[None, :]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (pairs of indices below n) of the links a[i]-b[i]: each vertex points to its tree's least one."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): the least vertex reachable over the links, for every vertex that has one.

    Each round lets every vertex join its neighbour of least hash (drawn anew each round), contracts the joined
    vertices and drops repeated links, so a constant share of the vertices goes per round, whatever the shape. The
    rounds' maps, which shrink geometrically, are then composed from the last back. Nothing but row counts reaches
    the driver; each round is written to the shared checkpoint folder.
    """
    edge = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    maps: list[DataFrame] = []
    turn = 0
    while not edge.isEmpty():
        both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = both.groupBy(F.col("a").alias("v")).agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(F.xxhash64("v", F.lit(turn)).alias("h"), F.col("v").alias("to"))
        moved = cut_lineage(moved.select("v", F.least("m", own)["to"].alias("to")))
        maps.append(moved)
        edge = cut_lineage(
            edge.join(moved.withColumnsRenamed({"v": "a", "to": "ta"}), "a")
            .join(moved.withColumnsRenamed({"v": "b", "to": "tb"}), "b")
            .filter("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        turn += 1
    if not maps:
        return edge.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    whole = maps.pop()
    while maps:
        later = whole.select(F.col("v").alias("to"), F.col("to").alias("then"))
        whole = maps.pop().join(later, "to", "left").select("v", F.coalesce("then", "to").alias("to"))
    whole = cut_lineage(whole)
    least = whole.groupBy("to").agg(F.min("v").alias("component"))
    return whole.join(least, "to").select(F.col("v").alias("vertex"), "component")
