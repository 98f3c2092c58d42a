"""N-gram Jaccard join: MinHash bands find the pairs, full n-gram sets decide them.

Documents with the same set of word 5-grams are one class from the start. Class representatives meet where they share
a band hash. A group of representatives is compared in bounded cells; a pair that shares several bands is compared
once, in the largest of its groups. Cells return counts and spanning links, never pairs, so a group of n near copies
costs n rows per cell and not n^2. No group, component or fingerprint list reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.llm import spans
from emberfield.llm.cluster import CELL, block_pairs, cell_pairs, cells, column, components, earlier, forest, map_arrow, numbered, open_pairs, runs
from emberfield.scale import cut_lineage

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold shares a band with at least the target probability.

    Of the shapes with at most ``most`` hashes in all, the one with the most rows a band, which has the fewest
    chance meetings.
    """
    found = (1, 1)
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows))))
        if bands * rows <= most:
            found = (bands, rows)
    return found


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted set of hashed word n-grams of each row; a row of fewer words has one, of all its words."""
    data = spans.LOWER[data]
    starts, ends, rows = spans.words(data, at, spans.LETTERS)
    hashes = spans.hash_spans(data, starts, ends)
    first, grams = spans.windows(hashes, rows, tuple(range(size)))
    cuts = np.searchsorted(rows[first], np.arange(len(at)))
    words = np.searchsorted(rows, np.arange(len(at)))
    for i in range(len(at) - 1):
        own = np.sort(grams[cuts[i] : cuts[i + 1]])
        if len(own):
            yield own[np.append(True, own[1:] != own[:-1])]
        elif words[i + 1] > words[i]:
            few = hashes[words[i] : words[i + 1]]
            yield spans.mix((few * spans.random_words(len(few), 3)).sum(keepdims=True) + np.uint64(len(few)))
        else:
            yield own


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers of the whole set."""
    return tuple(int(x) for x in np.array([spans.mix(grams).sum(), spans.mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum()], dtype=np.uint64).view(np.int64))


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band hashes of a set."""
    factors = spans.random_words(bands * rows, 11) | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(grams), 4096):
        np.minimum(least, (factors[:, None] * grams[None, start : start + 4096]).min(axis=1), out=least)
    parts = spans.mix(least).reshape(bands, rows) * (spans.random_words(rows, 13) | np.uint64(1))
    return spans.mix(parts.sum(axis=1) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """uid, doc_id, f1, f2, bands of every row; f1 is null for rows without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in spans.slices(batch.column(2)):
                n = len(at) - 1
                prints, signs = [], []
                for grams in shingle_sets(data, at):
                    prints.append(fingerprint(grams) if len(grams) else (None, None))
                    signs.append(signature(grams, bands, rows) if len(grams) else np.empty(0, dtype=np.int64))
                cuts = np.append(0, np.cumsum([len(s) for s in signs])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(signs)))
                columns = [pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), *columns, lists], ["uid", "doc_id", "f1", "f2", "bands"])

    return map_arrow(docs.select("uid", "doc_id", "text"), work, "uid long, doc_id long, f1 long, f2 long, bands array<long>")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all pairs of sets."""
    n = len(sets)
    if n == 2:
        both = np.sort(np.concatenate(sets))
        return np.full((2, 2), int((both[1:] == both[:-1]).sum()))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    same = flat[1:] == flat[:-1]
    shared = np.append(same, False) | np.append(False, same)
    flat, owner = flat[shared], owner[shared]
    at = np.cumsum(np.append(False, flat[1:] != flat[:-1])) if len(flat) else np.empty(0, dtype=np.int64)
    out = np.zeros((n, n), dtype=np.float32)
    width = 4096
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        i, j = np.searchsorted(at, [start, start + width])
        has = np.zeros((n, width), dtype=np.float32)
        has[owner[i:j], at[i:j] - start] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, uid) of the rows that have a pair of their own in the group."""
    for cell in runs(batches, CELL):
        key, a, b = (int(cell[c][0].as_py()) for c in CELL)
        uid, keys = column(cell, "uid"), [np.asarray(k) for k in column(cell, "keys")]
        if len(uid) < 2:
            continue
        mine = open_pairs(earlier(keys, key)) & cell_pairs(column(cell, "part"), a, b)
        met = np.flatnonzero(mine.any(axis=0) | mine.any(axis=1))
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), key)), pa.array(uid[met])], ["key", "uid"])


def _verify(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, CELL):
            key, a, b = (int(cell[c][0].as_py()) for c in CELL)
            uid, size = column(cell, "uid"), column(cell, "size")
            if len(uid) < 2:
                continue
            mine = open_pairs(earlier([np.asarray(k) for k in column(cell, "keys")], key)) & cell_pairs(column(cell, "part"), a, b)
            sets = [np.asarray(s) for s in column(cell, "grams")]
            common = _overlaps(sets)
            count = np.array([len(s) for s in sets])
            linked = mine & (common >= threshold * (count[:, None] + count[None, :] - common) - 1e-9)
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            n = len(uid)
            texts = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            rows = np.bincount(i, weights=size[j], minlength=n) + np.bincount(j, weights=size[i], minlength=n)
            met = np.flatnonzero(texts)
            child, root = forest(i, j, n)
            none, zero = np.full(len(met), -1), np.zeros(len(child), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([uid[met], uid[child]])),
                    pa.array(np.concatenate([none, uid[root]])),
                    pa.array(np.concatenate([texts[met], zero])),
                    pa.array(np.concatenate([rows[met].astype(np.int64), zero])),
                ],
                ["uid", "other", "texts", "rows"],
            )

    return work


def link(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """uid, doc_id, class_id, copy_of, n_links, n_texts, kept of every row of ``docs`` (uid, doc_id, text).

    ``uid`` is a number of its own for each row, the same whenever the rows are computed.
    """
    bands, rows = banding(threshold, recall)
    signed = cut_lineage(_signed(docs, bands, rows))
    classes = signed.filter("f1 is not null").groupBy("f1", "f2").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).getField("uid").alias("first_uid"))
    classes = cut_lineage(classes)
    leaders = signed.select("uid", "doc_id", "bands").join(classes.select("uid", "size", "f1", "f2"), "uid")
    leaders = cut_lineage(leaders)

    exploded = leaders.select("uid", F.explode("bands").alias("key"))
    groups = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.min("uid").alias("lo")).filter("n > 1")
    # groups with the same members are one
    kept = cut_lineage(groups.groupBy("n", "x", "lo").agg(F.min("key").alias("key")).select("key", "n"))
    members = exploded.join(kept, "key")
    order = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "key"))), lambda s: s["key"])
    members = cut_lineage(members.groupBy("uid").agg(order.alias("keys")))  # at most one entry a band
    dealt = block_pairs(members.select("uid", "keys", F.explode("keys").alias("key")), kept, "key", "uid")
    needed = map_arrow(cells(dealt, ["uid", "keys"]), _needed, "key long, uid long").distinct()
    needed = cut_lineage(needed)

    wanted = needed.select("uid").distinct().join(leaders.select("uid", "doc_id", "size"), "uid")
    sets = _sets(docs.select("uid", "text").join(wanted.select("uid", "size"), "uid"))
    sizes = needed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    dealt = block_pairs(needed, sizes, "key", "uid").join(members, "uid").join(sets, "uid")
    found = map_arrow(cells(dealt, ["uid", "keys", "size", "grams"]), _verify(threshold), "uid long, other long, texts long, rows long")
    found = cut_lineage(found)

    degrees = found.filter("other < 0").groupBy("uid").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))
    parts = components(found.filter("other >= 0"), "uid", "other").withColumnsRenamed({"vertex": "uid"})
    state = classes.join(degrees, "uid", "left").join(parts, "uid", "left")
    state = state.select("f1", "f2", "copy_of", "size", "first_uid", F.coalesce("component", "uid").alias("component"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("rows", F.lit(0)).alias("rows"))
    state = cut_lineage(state)
    least = state.groupBy("component").agg(F.min(F.struct(F.col("copy_of").isNull().alias("no"), "copy_of", "first_uid")).alias("m"))
    state = state.join(least, "component").select("f1", "f2", "copy_of", "size", "texts", "rows", F.col("m.copy_of").alias("class_id"), F.col("m.first_uid").alias("keeper"))
    out = signed.select("uid", "doc_id", "f1", "f2").join(cut_lineage(state), ["f1", "f2"], "left")
    alone = F.col("f1").isNull()
    return out.select(
        "uid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce(F.col("size") - 1 + F.col("rows"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
        (alone | (F.col("uid") == F.col("keeper"))).alias("kept"),
    )


def _sets(rows: DataFrame) -> DataFrame:
    """uid, size, grams of (uid, text, size)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in spans.slices(batch.column(2)):
                n = len(at) - 1
                sets = list(shingle_sets(data, at))
                cuts = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), lists], ["uid", "size", "grams"])

    return map_arrow(rows.select("uid", "size", "text"), work, "uid long, size long, grams array<long>")


def _plain(rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return rows.select("uid", F.col("row")[doc_id].cast("long").alias("doc_id"), F.col("row")[text].cast("string").alias("text"))


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, copy_of, n_links, n_texts, kept.

    Words are runs of letters and digits, A-Z lower-cased. Two documents are linked if the Jaccard similarity of
    their sets of word 5-grams is at least the threshold (a text of one to four words has one gram, itself).
    ``class_id``: least doc_id of those reachable over links; ``copy_of``: least doc_id with the very same set;
    ``n_links``: other documents linked directly, copies included; ``n_texts``: other different sets linked;
    ``kept``: the one document that stands for its class. Null texts and texts without words link with nothing.
    Repeated rows count as copies, also with the same doc_id; null doc_ids come after all others and have a null
    class_id where nothing else is in the class. An empty table gives an empty table.
    """
    return link(_plain(numbered(docs.select(doc_id, text)), doc_id, text), threshold, recall).drop("uid")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stand for their class; all columns as they were."""
    rows = numbered(docs)
    kept = link(_plain(rows), threshold, recall).filter("kept").select("uid")
    return rows.join(kept, "uid", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])


# Brute force over all pairs of documents that share a gram, for tables whose doc_id is unique and not null.
NGRAM_JOIN_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-/:-`{-\\x7F]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
s AS (SELECT DISTINCT doc_id, g FROM g),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (
  SELECT p.a, p.b, p.c = x.n AND p.c = y.n AS same FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE p.c >= 0.8 * (x.n + y.n - p.c) - 1e-9),
o AS (SELECT d.doc_id, LEAST(d.doc_id, COALESCE(MIN(l.b), d.doc_id)) AS copy_of FROM documents d LEFT JOIN l ON l.a = d.doc_id AND l.same GROUP BY d.doc_id),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.to_id = l.a),
c AS (SELECT doc_id, MIN(to_id) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT l.a, COUNT(*) AS n_links, COUNT(DISTINCT CASE WHEN NOT l.same THEN o.copy_of END) AS n_texts FROM l JOIN o ON o.doc_id = l.b GROUP BY l.a)
SELECT c.doc_id, c.class_id, o.copy_of, CAST(COALESCE(k.n_links, 0) AS BIGINT) AS n_links, CAST(COALESCE(k.n_texts, 0) AS BIGINT) AS n_texts,
       c.doc_id = c.class_id AS kept
FROM c JOIN o ON o.doc_id = c.doc_id LEFT JOIN k ON k.a = c.doc_id
"""
