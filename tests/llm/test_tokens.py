import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberfield.llm import bpe, token_records

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "<|endoftext|>", "a", "aaaa", " the", "'s", "'S", " ", "\x1c", "\x85", "​", "　", "word", "Ünï", "漢字", "🙂", "12", ",", ".\n", "\t"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    return ["", *("".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(3000))]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pair_index_equals_library(texts, library):
    model = bpe.PairIndexBpe(PATH)
    for text, ids in zip(texts, model.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)
        assert model.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_every_character_class(library):
    texts = [f"a{c}b {c}{c} 1" for c in map(chr, range(0x3100)) if not 0xD800 <= ord(c) < 0xE000]
    for text, ids in zip(texts, bpe.bpe(PATH).encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgetting_words_changes_nothing(texts, monkeypatch):
    whole = [x.tolist() for x in bpe.PairIndexBpe(PATH).encode(texts)]
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 5_000)
    monkeypatch.setattr(bpe, "TEXT_BYTES", 500)
    for encoder in (bpe.PairIndexBpe(PATH), token_records.LibraryEncoder(PATH)):
        assert [x.tolist() for x in encoder.encode(texts)] == whole
        assert [x.tolist() for i in range(0, len(texts), 10) for x in encoder.encode(texts[i : i + 10])] == whole
        encoder.forget()
        assert [x.tolist() for x in encoder.encode(texts[:50])] == whole[:50]


def test_memory_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 50_000)
    encoder = token_records.LibraryEncoder(PATH)
    for i in range(40):
        list(encoder.encode([" ".join(f"w{i}x{j}" for j in range(20))]))
        assert encoder._encoder._held <= 50_000
        assert len(encoder._encoder._known) * bpe.WORD_COST <= 60_000


def test_digests(docs_of, library):
    texts = ["Hello  world", None, "", "a <|endoftext|> b"]
    for r in bpe.token_digests(docs_of(texts), PATH).collect():
        text = texts[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_frame_round_trip_and_damage(docs_of):
    ids = np.array([5, 40_000, 0], dtype="<u2")
    data = token_records.frame(-7, ids) + b"\n" + token_records.frame(None, ids[:0]) + b"\n"
    doc, got, after = token_records.parse(data)
    assert (doc, got.tolist()) == (-7, [5, 40_000, 0])
    assert token_records.parse(data, after)[0] is None and token_records.parse(data, after)[2] == len(data)
    for at in range(after - 1):
        with pytest.raises(ValueError):
            token_records.parse(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_records_in_order_and_shuffled_reads(spark, docs_of, library, tmp_path):
    r = random.Random(1)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randrange(30)))) for i in r.sample(range(10_000), 300)]
    out = token_records.token_records(docs_of(rows), PATH, str(tmp_path / "t")).collect()
    start = 0
    found = {x["doc_id"]: x for x in out}
    ids_of = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    for i, _ in sorted(rows):
        want = ids_of[i]
        assert (found[i]["start"], found[i]["n_tokens"]) == (start, len(want))
        assert found[i]["ids_crc32"] == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        start += len(want)
    index = spark.read.schema(token_records.INDEX).parquet(str(tmp_path / "t/index/records"))
    some = token_records.read_records(spark, str(tmp_path / "t/data"), index.filter("doc_id % 3 = 0")).collect()
    assert {x["doc_id"]: x["ids"] for x in some} == {i: v for i, v in ids_of.items() if i % 3 == 0}


def test_encode_decode_documents_keep_columns(docs_of):
    docs = docs_of(["x  y\n", None, "é"])
    coded = bpe.encode_documents(docs, PATH)
    assert coded.columns == [*docs.columns, "ids"]
    back = bpe.decode_documents(coded, PATH)
    assert sorted(r["text"] for r in back.collect()) == ["", "x  y\n", "é"]
