"""Centroid clustering of embeddings in exact integers, assigned by a tournament of bisectors.

For every two centroids i < j the plane between them is kept as an integer normal 2 (c_j - c_i) and a threshold
|c_j|^2 - |c_i|^2. A vector's champion starts as centroid 0 and meets each later centroid once: the sign of one linear
form says which of the two is nearer, and zero keeps the smaller number. Only the winner's distance is worked out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.llm.cluster import map_arrow
from emberfield.llm.integers import TOTAL, exact_total, matrices, scaled, written

CLUSTERS = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SEED = 3
# Bytes that the planes of all centroid pairs may take in each worker.
PLANE_BYTES = 128 << 20
# Entries up to this size keep every sum below within 64 bits (for up to 64 dimensions); larger ones use Python integers.
NARROW = 2**27


class Tournament:
    """The planes between all pairs of centroids, and the assignment by them."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, dtype=object)
        self.narrow = not self.centroids.size or int(np.abs(self.centroids).max()) <= NARROW and self.centroids.shape[1] <= 64
        if self.narrow:
            self.centroids = self.centroids.astype(np.int64)
        self.normals, self.thresholds = self._planes(self.centroids)

    @staticmethod
    def _planes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = (c * c).sum(axis=1)
        return 2 * (c[None, :, :] - c[:, None, :]), square[None, :] - square[:, None]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row."""
        narrow = self.narrow and (not x.size or int(np.abs(x).max()) <= NARROW)
        x = x.astype(np.int64 if narrow else object)
        best = np.zeros(len(x), dtype=np.int64)
        for rival in range(1, len(self.centroids)):
            form = (x * self.normals[best, rival]).sum(axis=1)
            best[form > self.thresholds[best, rival]] = rival
        apart = x - self.centroids[best]
        return best, (apart * apart).sum(axis=1)


def _sums(contest: Tournament):
    """Each task's count and componentwise sums of the vectors of every cluster, as (cluster, dim, total); dim -1 counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = contest.centroids.shape
        totals = [[0] * (dims + 1) for _ in range(k)]
        for _, x in matrices(batches):
            best, _ = contest.assign(x)
            wide = np.abs(x).max() > NARROW
            for c in np.unique(best):
                own = x[best == c]
                sums = (own.astype(object) if wide else own).sum(axis=0)
                totals[c] = [t + int(s) for t, s in zip(totals[c], [len(own), *sums], strict=True)]
        found = [c for c in range(k) if totals[c][0]]
        keys = {"cluster": [c for c in found for _ in range(dims + 1)], "dim": [*range(-1, dims)] * len(found)}
        yield exact_total(keys, [t for c in found for t in totals[c]])

    return work


def _assigned(contest: Tournament):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches):
            best, distance = contest.assign(x)
            fits = [int(d) if d < 2**63 else None for d in distance] if distance.dtype == object else distance
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    return work


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` finite components, each of which becomes floor(scale * component). Centroids
    start as the ``k`` kept vectors of least sha256 of ``<seed>:<vec_id>``; each round assigns every vector to its
    nearest centroid (smaller number on ties) and moves each centroid that has vectors to their floored mean. All of
    it is exact: sums are decimals, distances whole numbers.

    Null and empty vectors, other lengths, null, non-finite and unscalable components (2^62 and more) are left out.
    Repeated rows are vectors of their own, also as first centroids (equal centroids: the smaller number takes all); a
    null vec_id is clustered but comes last as a first centroid, ties by vector. Fewer than ``k`` kept vectors make
    fewer clusters, none an empty table. A distance or inertia beyond a long is null. The planes of all pairs go to
    every worker, so k * k * dims is limited (PLANE_BYTES) and a larger k is refused.
    """
    spark = vectors.sparkSession
    if 8 * k * k * dims > PLANE_BYTES:
        raise ValueError(f"{k} centroids of {dims} dimensions make more than {PLANE_BYTES} bytes of planes")
    rows = written(scaled(vectors, scale, vec_id, vector).filter(F.size("x") == dims), "clusters")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [r["x"] for r in rows.orderBy(order.asc_nulls_last(), "x").limit(k).collect()]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        sums = map_arrow(rows.select("x"), _sums(Tournament(centroids)), f"cluster int, dim int, total {TOTAL}")
        # k * (dims + 1) numbers reach the driver
        total = {(r["cluster"], r["dim"]): int(r["total"]) for r in sums.groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect()}
        centroids = [[total[c, d] // total[c, -1] for d in range(dims)] if (c, -1) in total else old for c, old in enumerate(centroids)]
    placed = written(map_arrow(rows, _assigned(Tournament(centroids)), "vec_id long, cluster int, distance long"), "clusters-placed")
    whole = F.sum(F.col("distance").cast(TOTAL))
    held = placed.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), whole).alias("inertia")).collect()
    inertia = {r["cluster"]: r["inertia"] for r in held}
    over_all = None if None in inertia.values() else sum(inertia.values())

    def as_long(v: object) -> int | None:
        return int(v) if v is not None and v < 2**63 else None

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = [(c, as_long(inertia.get(c)), as_long(over_all), digest) for c, digest in enumerate(digests)]
    summary = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(summary), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """SQL twin: every round spelled out as one aggregate over all (vector, centroid) distances."""
    start = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
e AS MATERIALIZED (SELECT rid, d, x[d] AS x FROM v, (SELECT unnest(generate_series(1, {dims})) AS d)),
s AS (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c FROM v QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT s.c, e.d, e.x FROM s JOIN e USING (rid))"""
    parts = [start]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, c, dist FROM (
    SELECT e.rid, k.c, SUM((e.x - k.x) * (e.x - k.x)) AS dist FROM e JOIN c{r} k USING (d) GROUP BY e.rid, k.c)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, c) = 1)""")
        if r < rounds:
            parts.append(f"""
m{r} AS (
  SELECT a.c, e.d, (SUM(e.x) - ((SUM(e.x) % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*) AS x
  FROM a{r} a JOIN e USING (rid) GROUP BY a.c, e.d),
c{r + 1} AS MATERIALIZED (SELECT k.c, k.d, COALESCE(m{r}.x, k.x) AS x FROM c{r} k LEFT JOIN m{r} ON k.c = m{r}.c AND k.d = m{r}.d)""")
    parts.append(f"""
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS digest FROM c{rounds} GROUP BY c)""")
    return ",".join(parts) + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.dist AS BIGINT) AS distance,
  CAST(SUM(a.dist) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(SUM(a.dist) OVER () AS BIGINT) AS inertia, h.digest AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN h ON h.c = a.c"""
