"""Embeddings as exact integer vectors, and totals over them that no overflow can touch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.llm.cluster import shared_path

# Rows that a task works on at once.
SLICE_ROWS = 4096
# Scaled entries at or above this don't fit a long with room to spare; they count as non-finite.
LARGEST = float(2**62)
TOTAL = "decimal(38,0)"


def scalable(vector: Column, scale: int) -> Column:
    """Not null, and every entry finite and, scaled, within a long."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * F.lit(float(scale))) < F.lit(LARGEST), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fits, F.lit(False))


def scaled(vectors: DataFrame, scale: int, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x) of the vectors that can be scaled: x = floor(scale * entry), as longs."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    whole = F.transform("vector", lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    return rows.filter(scalable(F.col("vector"), scale)).select("vec_id", whole.alias("x"))


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder; later passes read them from there."""
    folder = shared_path(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def matrices(batches: Iterable[pa.RecordBatch], name: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their integer matrix) in slices of bounded size; all vectors have one length."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            lists = part.column(part.schema.get_field_index(name))
            yield part, np.asarray(lists.flatten()).reshape(part.num_rows, -1)


def exact_total(columns: dict[str, list[int]], totals: list[int]) -> pa.RecordBatch:
    """Key columns and Python integers as rows of a ``decimal(38,0)`` column ``total``."""
    keys = [pa.array(v, pa.int32()) for v in columns.values()]
    return pa.RecordBatch.from_arrays([*keys, pa.array([Decimal(int(t)) for t in totals], pa.decimal128(38, 0))], [*columns, "total"])
