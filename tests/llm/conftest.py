import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts (ids count from 0) or from (doc_id, text[, source]) tuples."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame([Row(doc_id=i, quality=q, toxic=t) for i, q, t in rows], "doc_id long, quality int, toxic int")

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named as the operators' own."""
    words = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    long_line = "a line that many documents of this table share"
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "src0", 0),
        (None, "a text without any id at all but with enough words to count", None, "src1", 3),
        (None, None, None, None, None),
        (3, words, "en", "src0", len(words)),
        (4, f"{long_line}\nfirst", "en", "src0", 1),
        (5, f"  {long_line.upper()}  \nsecond\n", "en", "src1", 1),
        (6, f"{long_line}\nthird", "en", None, 1),
        (6, f"{long_line}\nthird", "en", None, 1),
        (7, "é ß 漢字 🙂 <|endoftext|> \x00\x01   end", "de", "src2", 1),
        (8, " \n\t \r\n ", "de", "src2", 1),
    ]
    extra = ["uid", "row", "key", "h", "h1", "f1", "size", "n", "ids", "n_lines", "n_dropped", "drop", "doc", "score", "pass", "block", "blocks", "left", "vertex", "_row", "_text", "_score", "a", "b", "part"]
    schema = DOCS + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)
