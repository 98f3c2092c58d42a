"""Near duplicates of embeddings with a forest of random-projection trees.

Trees of random splits, fitted on a bounded sample, send every vector to the leaves it falls into; a vector close to
a split goes to both sides. Leaves that hold too many of the table's vectors are split further, from samples of their
own and in the tasks, as long as that parts them. Vectors are compared within leaves, whatever the leaf's size, in
bounded cells; a pair that shares several leaves is compared for the count in the first of them. Cells return counts
and spanning links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.llm.cluster import CELL, block_pairs, cell_pairs, cells, column, components, earlier, forest, map_arrow, numbered, open_pairs, runs
from emberfield.scale import cut_lineage, ship_if_small

THRESHOLD = 0.95
TREES = 6
# The forest is fitted on at most so many vectors, those of least hash; a leaf has about so many of them.
SAMPLE_ROWS = 32_768
SAMPLE_LEAF = 16
# Leaves of more vectors are split further: so many levels a round, on about so many sample vectors of each leaf, at the
# quantile that leaves the fewest pairs (not through a group of near copies). A node is split if at most this share of
# its pairs is left. A round costs some ten jobs, so leaves whose pairs are compared in less time stay.
LEAF_ROWS = 8192
SPLIT_LEVELS = 5
SPLIT_SAMPLE = 1024
SPLIT_AT = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
SPLIT_PAIRS = 0.75
ROUNDS = 7
# Leaves whose middles (31 numbers each) may be sent to every task: 8 MB.
FITTED_ROWS = 32_768


@dataclass
class Forest:
    """Complete binary trees in heap order: a random direction and a middle value for each inner node."""

    dims: int
    depth: int
    margin: float
    directions: np.ndarray  # trees x nodes x dims
    middles: np.ndarray  # trees x nodes

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors, each in one or more leaves of every tree; ordered by row, then leaf."""
        rows, found = [], []
        for tree in range(len(self.middles)):
            row = np.arange(len(unit))
            node = np.zeros(len(unit), dtype=np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", unit[row], self.directions[tree, node]) - self.middles[tree, node]
                left, right = side < self.margin, side >= -self.margin
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            rows.append(row)
            found.append(node + tree * (2 << self.depth))
        row, leaf = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def _margin(threshold: float, dims: int) -> float:
    return 0.5 * math.sqrt(2 - 2 * threshold) / math.sqrt(dims)


def _directions(trees: int, nodes: int, dims: int, seed: int | list[int]) -> np.ndarray:
    found = np.random.default_rng(seed).standard_normal((trees, nodes, dims))
    return found / np.linalg.norm(found, axis=2, keepdims=True)


def fit(sample: np.ndarray, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = SAMPLE_LEAF, seed: int = 5) -> Forest:
    """Random directions with the sample's median as the middle of each node.

    The margin on either side is half the deviation that two vectors at the threshold have along a random direction,
    so they part at a node only if they lie a full deviation apart.
    """
    rows, dims = sample.shape
    depth = max(0, int(math.log2(max(1, rows / leaf))))
    margin = _margin(threshold, dims)
    nodes = (1 << depth) - 1
    directions = _directions(trees, max(1, nodes), dims, seed)
    middles = np.zeros((trees, max(1, nodes)))
    for tree in range(trees):
        held = {0: np.arange(rows)}
        for node in range(nodes):
            own = held.pop(node)
            side = sample[own] @ directions[tree, node]
            middles[tree, node] = np.median(side) if len(own) else 0.0
            held[2 * node + 1], held[2 * node + 2] = own[side < middles[tree, node]], own[side >= middles[tree, node]]
    return Forest(dims, depth, margin, directions, middles)


def comparable(vector: Column) -> Column:
    """Not null, and only finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dims)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _assign(model: Forest):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                vectors = part.column(2)
                size = np.diff(np.asarray(vectors.offsets))
                lists: list = [None] * len(vectors)
                fits = np.flatnonzero(size == model.dims)
                if len(fits):
                    row, leaf = model.leaves(_unit(_matrix(vectors.take(pa.array(fits)), model.dims)))
                    cuts = np.searchsorted(row, np.arange(len(fits) + 1))
                    for k, i in enumerate(fits):
                        lists[i] = leaf[cuts[k] : cuts[k + 1]]
                for i in np.flatnonzero(size != model.dims):  # other lengths: one leaf for each
                    lists[i] = np.array([-int(size[i])])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), vectors, pa.array(lists, pa.list_(pa.int64()))], ["uid", "size", "vector", "leaves"])

    return work


@dataclass
class Splits:
    """One round of further splits: the directions of a tree's nodes are the same in all its leaves, the middles aren't."""

    margin: float
    width: int  # leaf numbers of one tree
    directions: np.ndarray  # trees x nodes x dims
    leaf_rows: int

    def tree(self, keys: np.ndarray) -> np.ndarray:
        return np.clip(keys // self.width, 0, len(self.directions) - 1)

    def fit(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, middles) of the leaves that can be split, from sample rows (key, n, vector) sorted by key; a node that
        stays whole has no number as its middle."""
        nodes, dims = self.directions.shape[1:]
        for leaf in runs(batches, ["key"]):
            key, n = int(leaf["key"][0].as_py()), int(leaf["n"][0].as_py())
            m = _unit(_matrix(leaf["vector"].combine_chunks(), dims))
            directions = self.directions[self.tree(np.array([key]))[0]]
            middles = np.full(nodes, np.nan)
            held = {0: np.arange(len(m))}
            for node in range(nodes):
                own = held.pop(node, None)
                if own is None or len(own) < 16 or len(own) * n <= self.leaf_rows * len(m):
                    continue
                side = m[own] @ directions[node]
                best = None
                for middle in np.quantile(side, SPLIT_AT):
                    left, right = side < middle + self.margin, side >= middle - self.margin
                    pairs = (float(left.sum()) ** 2 + float(right.sum()) ** 2) / float(len(own)) ** 2
                    if pairs <= SPLIT_PAIRS and (best is None or pairs < best[0]):
                        best = pairs, middle, left, right
                if best is None:
                    continue
                _, middles[node], left, right = best
                held[2 * node + 1], held[2 * node + 2] = own[left], own[right]
            if not math.isnan(middles[0]):
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([middles])], ["key", "middles"])

    def assign(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(uid, key) of (uid, key, vector, middles): a vector's nodes below its leaf."""
        nodes, dims = self.directions.shape[1:]
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                uid, key = np.asarray(part.column(0)), np.asarray(part.column(1))
                unit, middles = _unit(_matrix(part.column(2), dims)), _matrix(part.column(3), nodes)
                tree = self.tree(key)
                row, node = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
                done = []
                for _ in range(SPLIT_LEVELS):
                    middle = middles[row, node]
                    ends = np.isnan(middle)
                    done.append((row[ends], node[ends]))
                    row, node, middle = row[~ends], node[~ends], middle[~ends]
                    side = np.einsum("ij,ij->i", unit[row], self.directions[tree[row], node]) - middle
                    left, right = side < self.margin, side >= -self.margin
                    row = np.concatenate([row[left], row[right]])
                    node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
                row, node = (np.concatenate(c) for c in zip(*done, (row, node), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(key[row] * _below() + node)], ["uid", "key"])


def _below() -> int:
    """Numbers of the nodes that a round may put in a leaf's place."""
    return 2 << SPLIT_LEVELS


def split_further(placed: DataFrame, model: Forest, threshold: float, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``placed`` (uid, size, vector, leaves) with leaves of at most about ``leaf_rows`` vectors, near copies apart.

    A round takes the leaves that are too large, fits a small tree to a sample of each (in the task that has the
    sample), and sends their vectors down; only leaf numbers are shuffled, then the vectors once by uid. A leaf that
    ended above a round's last level is not tried again. What can't be split is compared whole, in cells.
    """
    trees, width = len(model.middles), 2 << model.depth
    for turn in range(ROUNDS):
        found = placed.select("uid", "vector", F.explode("leaves").alias("key"))
        # later on, only nodes of the last level can be split; those that ended above it can't
        open_ = F.col("key") >= 0 if not turn else F.pmod("key", F.lit(_below())) >= (1 << SPLIT_LEVELS) - 1
        counted = found.filter(open_).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        large = cut_lineage(counted.filter(F.col("n") > leaf_rows))
        many = large.count()
        if not many:
            return placed
        splits = Splits(model.margin, width, _directions(trees, (1 << SPLIT_LEVELS) - 1, model.dims, [7, turn]), leaf_rows)
        share = F.pmod(F.xxhash64("uid", F.lit(11 + turn)), F.lit(1 << 31)) * F.col("n") < F.lit(SPLIT_SAMPLE << 31)
        sample = found.join(ship_if_small(large, many), "key").filter(share).select("key", "n", "vector")
        sample = sample.repartition("key").sortWithinPartitions("key")
        fitted = cut_lineage(map_arrow(sample, splits.fit, "key long, middles array<double>"))
        several = fitted.count()
        if not several:
            return placed
        fitted_small = ship_if_small(fitted, several, FITTED_ROWS)
        down = map_arrow(found.join(fitted_small, "key").select("uid", "key", "vector", "middles"), splits.assign, "uid long, key long")
        rest = found.select("uid", "key").join(ship_if_small(fitted.select("key"), several), "key", "left_anti")
        leaves = down.unionByName(rest.select("uid", (F.col("key") * F.lit(_below())).alias("key")))
        leaves = leaves.groupBy("uid").agg(F.sort_array(F.collect_list("key")).alias("leaves"))  # a row's leaves, by tree
        placed = cut_lineage(placed.drop("leaves").join(leaves, "uid").select("uid", "size", "vector", "leaves"))
        width *= _below()
    return placed


def _compare(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, CELL):
            key, a, b = (int(cell[c][0].as_py()) for c in CELL)
            n = cell.num_rows
            if n < 2:
                continue
            vectors = cell["vector"].combine_chunks()
            m = _matrix(vectors, len(vectors[0]))
            m /= np.abs(m).max(axis=1, keepdims=True)
            norm = np.sqrt((m * m).sum(axis=1))
            linked = ((m @ m.T) / (norm[:, None] * norm[None, :]) >= threshold) & cell_pairs(column(cell, "part"), a, b)
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            met = np.unique(np.concatenate([i, j]))
            leaves = column(cell, "leaves")
            first = open_pairs(earlier([np.asarray(leaves[k]) for k in met], key))
            own = first[np.searchsorted(met, i), np.searchsorted(met, j)]
            i, j = i[own], j[own]
            if not len(i):
                continue
            uid, size = column(cell, "uid"), column(cell, "size")
            rows = np.bincount(i, weights=size[j], minlength=n) + np.bincount(j, weights=size[i], minlength=n)
            met = np.flatnonzero(rows)
            child, root = forest(i, j, n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([uid[met], uid[child]])),
                    pa.array(np.concatenate([np.full(len(met), -1), uid[root]])),
                    pa.array(np.concatenate([rows[met].astype(np.int64), np.zeros(len(child), dtype=np.int64)])),
                ],
                ["uid", "other", "rows"],
            )

    return work


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", trees: int = TREES, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with a cosine of at least the threshold (in double precision) are linked where a leaf holds both; none
    below it are. ``n_links``: other vectors linked directly; ``component_id``: least vec_id reachable over links,
    its own included; ``kept``: vec_id = component_id. Equal vectors are one class from the start, so copies cost
    no pairs. Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors
    of different lengths do not link. Repeated rows are vectors of their own; a null vec_id counts after all others
    and, alone, has a null component_id and is kept. An empty table gives an empty table.
    """
    rows = numbered(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")))
    rows = rows.select("uid", "row.vec_id", "row.vector")
    plain = rows.filter(comparable(F.col("vector"))).select("uid", "vec_id", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    plain = cut_lineage(plain)
    classes = cut_lineage(plain.groupBy("h1", "h2").agg(F.min("uid").alias("uid"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size")))
    leaders = rows.select("uid", "vector").join(classes.select("uid", "size"), "uid").select("uid", "size", "vector")
    leaders = cut_lineage(leaders)

    usual = leaders.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if usual is None:
        found = None
    else:
        sample = leaders.filter(F.size("vector") == usual["dims"]).orderBy(F.xxhash64("uid"), "uid").limit(sample_rows).select("vector").toArrow()
        model = fit(_unit(_matrix(sample["vector"].combine_chunks(), usual["dims"])), threshold, trees)
        kind = leaders.schema["vector"].dataType.simpleString()
        placed = cut_lineage(map_arrow(leaders, _assign(model), f"uid long, size long, vector {kind}, leaves array<long>"))
        placed = split_further(placed, model, threshold, leaf_rows)
        leaves = placed.select("uid", F.explode("leaves").alias("key"))
        sizes = leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        dealt = block_pairs(leaves, sizes, "key", "uid").join(placed, "uid")
        found = cut_lineage(map_arrow(cells(dealt, ["uid", "size", "vector", "leaves"]), _compare(threshold), "uid long, other long, rows long"))

    if found is None:
        state = classes.select("h1", "h2", "size", F.lit(0).cast("long").alias("rows"), "least")
    else:
        degrees = found.filter("other < 0").groupBy("uid").agg(F.sum("rows").alias("rows"))
        parts = components(found.filter("other >= 0"), "uid", "other").withColumnsRenamed({"vertex": "uid"})
        state = classes.join(degrees, "uid", "left").join(parts, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
        state = cut_lineage(state)
        least = state.groupBy("component").agg(F.min("least").alias("whole"))
        state = state.join(least, "component").select("h1", "h2", "size", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("whole").alias("least"))
    linked = plain.select("uid", "h1", "h2").join(cut_lineage(state), ["h1", "h2"])
    out = rows.select("uid", "vec_id").join(linked, "uid", "left")
    component = F.when(F.col("size").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select(
        "vec_id",
        F.coalesce(F.col("size") - 1 + F.col("rows"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


EMBED_DEDUP_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, to_id) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM r JOIN l ON r.to_id = l.a),
c AS (SELECT vec_id, MIN(to_id) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, COUNT(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""
