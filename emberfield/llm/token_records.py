"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

A file is a run of frames, in ascending document order; files follow each other by their part number:

    length   8 bytes, little endian: bytes of the payload
    check    4 bytes: masked CRC-32 of the length bytes
    payload  document id (8 bytes, signed), flags (1: the id is null), bytes per id (2 or 4), then the ids
    check    4 bytes: masked CRC-32 of the payload
    end      one byte 0x0A, the record end that the writer sets

A check c is stored as rotate_right(c, 15) + 0xA282EAD8 (mod 2^32), so that a checksum inside checked data is no
checksum of it. Spark's own text writer puts the frames down, byte for byte, so writing needs no file system but
Spark's, commits each task's file at once and survives lost executors.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.llm.bpe import TEXT_BYTES, WordEncoder, byte_letters
from emberfield.llm.cluster import map_arrow, shared_path
from emberfield.llm.spans import slices
from emberfield.scale import work_partitions

END_ID = 0
# Bytes of text a file's task takes. The number of files follows the input; past MANY_FILES files grow first, as far as
# one can still be read as one value.
FILE_TEXT_BYTES, LARGEST_FILE_TEXT_BYTES, MANY_FILES = 24 << 20, 256 << 20, 20_000
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<qBB")
INDEX = "file int, doc_id long, offset long, length long, n_tokens long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record without its end byte."""
    payload = BODY.pack(doc_id or 0, doc_id is None, ids.itemsize) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def parse(data: bytes, offset: int = 0) -> tuple[int | None, np.ndarray, int]:
    """(document id, ids, offset after the record) of the record at ``offset``; ValueError if a check fails."""
    length, check = HEAD.unpack_from(data, offset)
    if masked_crc(bytes(data[offset : offset + 8])) != check:
        raise ValueError(f"broken record length at byte {offset}")
    start, stop = offset + HEAD.size, offset + HEAD.size + length
    payload = bytes(data[start:stop])
    if len(payload) != length or masked_crc(payload) != struct.unpack_from("<I", data, stop)[0]:
        raise ValueError(f"broken record at byte {offset}")
    doc_id, null, size = BODY.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, dtype=f"<u{size}", offset=BODY.size), stop + 5


class LibraryEncoder:
    """The tokenizers library's byte-level BPE, asked once for each distinct word of the texts in hand.

    Texts are cut into pieces and words as the library cuts them (see ``WordEncoder``).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it may use
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self._model = library.model
        self.dtype = np.dtype("<u2" if library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self._letters = dict(enumerate(byte_letters()))
        specials = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self._encoder = WordEncoder(self._merged, specials, self.dtype)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        tokenize = self._model.tokenize
        # all words at once in the vocabulary's letters; no text has the byte that parts them
        shown = b"\xff".join([w.encode() for w in words]).decode("latin-1")
        ids: list[int] = []
        sizes: list[int] = []
        for word in shown.translate(self._letters).split(self._letters[255]):
            found = tokenize(word)
            sizes.append(len(found))
            ids += [t.id for t in found]
        return np.array(ids, dtype=self.dtype), sizes


    def encode(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        return self._encoder.encode(texts)

    def forget(self) -> None:
        """Give back what is remembered of earlier texts."""
        self._encoder.forget()


_loaded: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = LibraryEncoder(path)
    return _loaded[path]


def write_records(docs: DataFrame, path: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode every text, append ``end_id`` and write the records in ascending document order under ``folder``.

    One range shuffle on the id orders the documents; each range is one file. Null ids come first, equal ids follow
    the order of their texts; null and empty texts have the end id alone. An empty table writes no records.
    """
    frame_of = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = frame_of.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = min(max(FILE_TEXT_BYTES, size // MANY_FILES), LARGEST_FILE_TEXT_BYTES)
    files = max(work_partitions(docs.sparkSession), -(-size // each))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = library_encoder(path)
        end = np.array([end_id], dtype=model.dtype)
        for batch in batches:
            for start, _, at in slices(batch.column(1), TEXT_BYTES):
                rows = batch.slice(start, len(at) - 1)
                out = [frame(d, np.concatenate([x, end])) for d, x in zip(rows.column(0).to_pylist(), model.encode(rows.column(1)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    ordered = frame_of.repartitionByRange(files, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    map_arrow(ordered, work, "value binary").select(F.col("value").cast("string")).write.text(folder)


def index_records(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back, check every record and list them: file, doc_id, offset, length, n_tokens, ids_crc32.

    ``ids_crc32`` is the CRC-32 of the ids as little-endian unsigned 32-bit integers. A broken record raises.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    numbered = files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                rows: list[tuple] = []
                offset = 0
                while offset < len(data):
                    doc_id, ids, after = parse(data, offset)
                    rows.append((number, doc_id, offset, after - offset, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    offset = after
                columns = [pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
                if rows:
                    yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "offset", "length", "n_tokens", "ids_crc32"])

    return map_arrow(numbered, work, INDEX)


def write_index(spark: SparkSession, folder: str, index: str) -> DataFrame:
    """Write the offset index of the record files as a table of its own, with each record's first position.

    ``start`` counts the ids of all records before it: a running sum inside each file, plus the files before (a
    table with one row per file, summed up in file order).
    """
    from pyspark.sql import Window

    index_records(spark, folder).write.parquet(f"{index}/records")
    records = spark.read.schema(INDEX).parquet(f"{index}/records")
    files = records.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    # one row per file: the only window without a key runs over the list of files
    before = files.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("offset")) - F.col("n_tokens")
    return records.withColumn("_in", inside).join(before, "file").withColumn("start", F.col("_base") + F.col("_in")).drop("_base", "_in")


def read_records(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>) of the records that ``index`` lists, in any order: each file's rows are read by offset."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    content = files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")
    wanted = index.groupBy("file").agg(F.collect_list("offset").alias("offsets"))  # bounded by a file's records

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offsets, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = memoryview(data.as_buffer())
                for start in range(0, len(offsets), 500):
                    found = [parse(view, o)[:2] for o in offsets[start : start + 500]]
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x.tolist() for _, x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(wanted.join(content, "file").select("offsets", "content"), work, "doc_id long, ids array<int>")


def token_records(docs: DataFrame, path: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write, read back and report per document: doc_id, start, n_tokens, ids_crc32 (and file, offset, length).

    One row per input row. Null and empty texts have one token, the end id. Equal doc_ids follow each other in the
    order of their texts, so repeated rows get successive starts; null doc_ids come first. An empty table: no rows.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-records")
    write_records(docs, path, f"{folder}/data", doc_id, text)
    out = write_index(spark, f"{folder}/data", f"{folder}/index")
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")
