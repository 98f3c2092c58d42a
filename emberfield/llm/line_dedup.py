"""Exact line deduplication over all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.scale import BROADCAST_ROWS, cut_lineage

MIN_CHARS = 20
MIN_DOCS = 3
# Lines of more documents than that are not gathered by their key.
HOT_DOCS = 100_000
# The ASCII white space that is stripped, the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _text_key(text: Column) -> list[Column]:
    """128 bits of a text: rows of one document with equal texts lose equal lines."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_docs: int = HOT_DOCS) -> DataFrame:
    """(doc, t1, t2, gone): for each text that loses lines, the positions of these in ascending order.

    Lines are exploded with their positions and hashed; texts stay where they are. Documents per hash are counted with
    partial sums. Lines of more than ``hot_docs`` documents, which can't be many, find their lines by broadcast (once
    their number is known), so that no task gets all lines of one key.
    """
    whole = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the text's key is a column before lines are exploded, not worked out for each of them
    whole = whole.select("doc", "text", *_text_key(F.col("text")))
    held = whole.select("doc", "t1", "t2", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    held = held.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    held = cut_lineage(held.select("doc", "t1", "t2", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")))
    found = held.select("doc", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper"))
    found = cut_lineage(found.filter(F.col("docs") >= min_docs))
    hot = found.filter(F.col("docs") > hot_docs)
    key, other = ["h1", "h2"], ~F.col("doc").eqNullSafe(F.col("keeper"))
    if 0 < hot.count() <= BROADCAST_ROWS:
        lost = held.join(F.broadcast(hot), key).filter(other).select("doc", "t1", "t2", "at")
        rest = held.join(F.broadcast(hot.select(*key)), key, "left_anti").join(found.filter(F.col("docs") <= hot_docs), key).filter(other)
        lost = lost.unionByName(rest.select("doc", "t1", "t2", "at"))
    else:
        lost = held.join(found, key).filter(other)
    return lost.groupBy("doc", "t1", "t2").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def without_positions(lines: Column, gone: Column) -> Column:
    """The array without the elements at the (ascending, 0-based) positions.

    The runs between the positions become one array of flags, so no element is looked up; the lines stand outside all
    lambdas, which would split the text anew for every element.
    """
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    flags = F.flatten(F.zip_with(starts, ends, lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a), F.array(F.lit(False)))))
    return F.filter(F.zip_with(lines, flags, lambda x, stays: F.when(stays, x)), lambda x: x.isNotNull())


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """The rows with ``text`` shortened, and with ``counts`` also ``n_lines`` (before) and ``n_dropped`` (replaced if there).

    A key of at least ``min_chars`` code points found in ``min_docs`` documents or more stays only in the largest
    doc_id holding it, with all its lines there. The other lines are joined by \\n in their order. Null text counts as
    one empty line and becomes empty text. Rows with the same doc_id are one document; a null doc_id is a document
    below all others. An empty table gives an empty table. Work grows with the lines, also in one document of very many.
    """
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    lost = repeated_lines(docs, doc_id, text, min_chars, min_docs)
    whole = docs.select(F.struct(*names).alias("_row"), F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    whole = whole.select("*", *[c.alias(f"_{k}") for k, c in zip(("t1", "t2"), _text_key(F.col("_text")), strict=True)])
    both = whole.join(lost, whole["_doc"].eqNullSafe(lost["doc"]) & (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left")
    lines = _lines(F.col("_text"))
    # a text without repeated lines stays as it is
    kept = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(without_positions(lines, F.col("gone")), "\n"))
    breaks = F.char_length("_text") - F.char_length(F.translate("_text", "\n", ""))
    added = [(breaks + 1).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")] if counts else []
    return both.select(*[kept.alias(c) if c == text else F.col("_row")[c].alias(c) for c in names], *added)


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the kept text in UTF-8, lowercase hex)."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINE_DEDUP_SQL = """
WITH d AS (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents),
k AS (
  SELECT doc_id, lines,
         list_transform(lines, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys
  FROM d),
e AS (SELECT DISTINCT doc_id, unnest(keys) AS key FROM k),
f AS (SELECT key, MAX(doc_id) AS keeper FROM e WHERE length(key) >= 20 GROUP BY key HAVING COUNT(*) >= 3),
l AS (SELECT e.doc_id, list(e.key) AS gone FROM e JOIN f USING (key) WHERE e.doc_id <> f.keeper GROUP BY e.doc_id),
r AS (
  SELECT k.doc_id, len(lines) AS n,
         list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(COALESCE(gone, []), keys[i])), lambda i: lines[i]) AS kept
  FROM k LEFT JOIN l ON k.doc_id IS NOT DISTINCT FROM l.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(n - len(kept) AS BIGINT) AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM r
"""
