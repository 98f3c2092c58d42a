"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task collects the distinct word pieces of a run of documents, lays their bytes out in one array and maps every
adjacent pair to all its positions. Active merge ranks are then applied in ascending order, each to all its positions
at once; the pairs a merge creates enter the lists of their own ranks. Documents are put together from the pieces'
ids. Text is only ever cut where the vocabulary's pattern cuts too, so whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.llm.cluster import map_arrow, map_column
from emberfield.llm.spans import slices

# The pattern and special token of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Bounds of what a worker holds: bytes of the texts in hand (a longer text makes a slice of its own), and of the words
# whose ids are remembered, each of which takes about WORD_COST bytes beside its own.
TEXT_BYTES = 4_000_000
MEMORY_BYTES, WORD_COST = 64_000_000, 160
# Texts in which a space stands before white space or at the end; for Arrow's expressions, so in RE2's terms.
ODD = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\p{Z}]|$)"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def distinct(places: np.ndarray) -> np.ndarray:
    """Ascending, each once."""
    places = np.sort(places)
    return places[np.append(True, places[1:] != places[:-1])] if len(places) else places


class Pieces:
    """How a text falls into pieces that are encoded on their own: cut before each space that a non-space follows.

    The pattern always cuts there, whatever stands around it, and a piece alone is cut as it is inside its text.
    """

    def __init__(self, pattern: str = PATTERN):
        self.words = regex.compile(pattern)
        self._cut = regex.compile(r" (?=\S)")
        self._odd = regex.compile(r" (?:[\s\x1c-\x1f]|$)")

    def of(self, text: str) -> list[str]:
        """All pieces but the first lack the space that they begin with."""
        return text.split(" ") if self._odd.search(text) is None else self._cut.split(text)


class WordEncoder:
    """Texts to ids, word by word: each distinct word of a slice of texts is encoded once and remembered for a while.

    Arrow cuts the texts into pieces and numbers the distinct ones; only these are cut into words. The ids of the words
    that are remembered lie in one flat array, from which every text's ids are gathered. ``words`` gives the ids of new
    words, one after the other, and their numbers of ids.
    """

    def __init__(self, words: Callable[[list[str]], tuple[np.ndarray, Sequence[int]]], specials: dict[str, int], dtype: np.dtype, share: float = 1.0):
        self._words, self._dtype, self._specials, self._share = words, dtype, specials, share
        self._special = regex.compile("|".join(regex.escape(t) for t in sorted(specials, key=len, reverse=True))) if specials else None
        self._cut = Pieces()
        self.forget()

    def forget(self) -> None:
        """Remember the special tokens alone."""
        self._known = {t: i for i, t in enumerate(self._specials)}
        self._flat = np.array(list(self._specials.values()), dtype=self._dtype)
        self._ends = np.arange(len(self._specials) + 1)
        self._held = 0

    def _around(self, piece: str) -> list[str]:
        """The words of a piece that may hold special tokens; what stands between those is cut on its own."""
        find = self._cut.words.findall
        if self._special is None or self._special.search(piece) is None:
            return find(piece)
        out: list[str] = []
        start = 0
        for m in self._special.finditer(piece):
            out += [*find(piece[start : m.start()]), m.group()]
            start = m.end()
        return out + find(piece[start:])

    def _codes(self, words: list[str]) -> np.ndarray:
        """The places of the words in what is remembered; all of that goes first where it would pass the bound."""
        distinct_words = set(words)
        new = list(distinct_words.difference(self._known))
        if new:
            cost = len(new) * WORD_COST + sum(map(len, new))
            if self._held and self._held + cost > MEMORY_BYTES * self._share:
                self.forget()
                new = list(distinct_words.difference(self._known))
                cost = len(new) * WORD_COST + sum(map(len, new))
            ids, sizes = self._words(new)
            self._known.update(zip(new, range(len(self._known), len(self._known) + len(new)), strict=True))
            self._flat = np.concatenate([self._flat, ids])
            self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(sizes)])
            self._held += cost
        return np.fromiter(map(self._known.__getitem__, words), dtype=np.int64, count=len(words))

    def encode(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null is empty."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        for row, _, at in slices(column, TEXT_BYTES):
            yield from self._slice(column.slice(row, len(at) - 1).cast(pa.large_string()).fill_null(""))

    def _slice(self, column: pa.LargeStringArray) -> list[np.ndarray]:
        lists = pc.split_pattern(column, " ")
        odd = np.asarray(pc.match_substring_regex(column, ODD))
        if odd.any():
            lists = _replaced(lists, odd, [self._cut.of(t) for t in column.filter(pa.array(odd)).to_pylist()])
        at = np.asarray(lists.offsets).astype(np.int64)
        at -= at[0]
        coded = lists.flatten().dictionary_encode()
        codes, names = np.array(coded.indices), coded.dictionary
        # a text's first piece has no space before it, so it is another piece than the same letters further on
        heads, place = np.unique(codes[at[:-1]], return_inverse=True)
        codes[at[:-1]] = len(names) + place
        inner = np.zeros(len(names), dtype=bool)
        rest = np.ones(len(codes), dtype=bool)
        rest[at[:-1]] = False
        inner[codes[rest]] = True
        special = np.zeros(len(names), dtype=bool)
        if self._special is not None:
            special = np.asarray(pc.match_substring_regex(names, "|".join(map(re.escape, self._specials))))
        plain, marked = np.flatnonzero(inner & ~special), np.flatnonzero(inner & special)
        words: list[str] = []
        count = np.zeros(len(names) + len(heads), dtype=np.int64)  # words of each piece
        if len(plain):
            # set side by side the pieces are cut into the same words as alone, all in one call
            own = names.take(pa.array(plain))
            words = self._cut.words.findall(" " + " ".join(own.to_pylist()))
            ends = np.cumsum(np.asarray(pc.utf8_length(own)).astype(np.int64) + 1)
            places = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
            count[plain] = np.diff(np.searchsorted(places, ends, side="right"), prepend=0)
        alone = [self._around(" " + p) for p in names.take(pa.array(marked)).to_pylist()] + [self._around(p) for p in names.take(pa.array(heads)).to_pylist()]
        order = np.concatenate([plain, marked, len(names) + np.arange(len(heads))])
        count[order[len(plain) :]] = [len(w) for w in alone]
        known = self._codes([*words, *chain.from_iterable(alone)])
        flat, ends = gather(self._flat, self._ends[known], np.diff(self._ends)[known])
        cuts = ends[np.concatenate([[0], np.cumsum(count[order])])]
        start, size = np.zeros(len(count), dtype=np.int64), np.zeros(len(count), dtype=np.int64)
        start[order], size[order] = cuts[:-1], np.diff(cuts)
        ids, ends = gather(flat, start[codes], size[codes])
        return np.split(ids, ends[at[1:-1]])


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start : start + size] side by side, and the place where each begins (and the last one ends)."""
    ends = np.concatenate([[0], np.cumsum(size)])
    narrow = np.int32 if max(ends[-1], len(flat)) < 2**31 else np.int64
    return flat[np.repeat((start - ends[:-1]).astype(narrow), size) + np.arange(ends[-1], dtype=narrow)], ends


def _replaced(lists: pa.LargeListArray, where: np.ndarray, values: list[list[str]]) -> pa.LargeListArray:
    """The lists with some of them replaced."""
    other = pa.array(values, lists.type)
    index = np.arange(len(lists))
    index[where] = len(lists) + np.arange(len(values))
    return pa.concat_arrays([lists, other]).take(pa.array(index))


class PairIndexBpe:
    """Encoder and decoder of a byte-level BPE vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(back[c] for c in token)
        for token, i in self.specials.items():
            tokens[i] = token.encode()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.text_of = _Joined(tokens)
        self.digits_of = _Joined([b"%d," % i for i in range(size)])
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.left, self.right = left.tolist(), right.tolist()
        pairs = (left << 32) | right
        self._order = np.argsort(pairs, kind="stable")
        self._pairs = pairs[self._order]
        self._encoder = WordEncoder(self.merge, self.specials, self.dtype, 0.5)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, -1 where there is none."""
        pairs = (left << 32) | right
        at = np.minimum(np.searchsorted(self._pairs, pairs), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pairs, self._order[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the (non-empty) words and their numbers: the pair occurrence index over all of them at once."""
        coded = [w.encode() for w in words]
        raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        ends = np.cumsum(sizes)
        n = len(raw)
        ids = self.first[raw]
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        after[ends - 1] = n  # n stands for "none", at either end of a word
        before[ends - sizes] = n
        alive = np.ones(n, dtype=bool)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Put the pairs that start at these places into the lists of their ranks."""
            places = places[after[places] < n]
            rank = self.ranks(ids[places], ids[after[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            if not len(rank):
                return
            cuts = (np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist()
            start = 0
            for r, stop in zip(rank[[0, *cuts]].tolist(), [*cuts, len(rank)], strict=True):
                if r in lists:
                    lists[r].append(places[start:stop])
                else:
                    lists[r] = [places[start:stop]]
                    heapq.heappush(active, r)
                start = stop

        enter(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            parts = lists.pop(rank)
            at = parts[0]
            if len(parts) > 1:
                at = distinct(np.concatenate(parts))
            a, b = self.left[rank], self.right[rank]
            at = at[alive[at] & (ids[at] == a) & (after[at] < n)]
            at = at[ids[after[at]] == b]
            if a == b and len(at) > 1:  # in a run of overlapping pairs every second one counts, from the left
                opens = np.append(True, after[at[:-1]] != at[1:])
                index = np.arange(len(at))
                at = at[(index - np.maximum.accumulate(np.where(opens, index, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            alive[gone] = False
            ids[at] = self.made[rank]
            then = after[gone]
            after[at] = then
            inner = then < n
            before[then[inner]] = at[inner]
            prior = before[at]
            enter(distinct(np.concatenate([at, prior[prior < n]])))
        return ids[alive].astype(self.dtype), np.add.reduceat(alive, ends - sizes, dtype=np.int64)

    def encode(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        return self._encoder.encode(texts)

    def forget(self) -> None:
        """Give back what is remembered of earlier texts."""
        self._encoder.forget()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.text_of(ids)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens kept; bytes that are no UTF-8 become U+FFFD."""
        return self.text_of(ids).decode("utf-8", "replace")


class _Joined:
    """Joins the byte strings of a table by index, as one gather."""

    def __init__(self, parts: list[bytes]):
        self.data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, ids: np.ndarray) -> bytes:
        out = []
        for i in range(0, len(ids), 1 << 17):
            part = ids[i : i + (1 << 17)]
            size = self.size[part]
            shift = self.start[part] - (np.cumsum(size) - size)
            out.append(self.data[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(out)


_loaded: dict[str, PairIndexBpe] = {}


def bpe(path: str) -> PairIndexBpe:
    """The worker's one encoder of a vocabulary file."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = PairIndexBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with a column ``ids`` (array<int>) added; a column of that name is replaced. Null text has no ids.

    Only the text goes to Python; the rows stay where they are.
    """

    def work(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = bpe(path)
        for column in texts:
            values = list(model.encode(column))
            at = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, dtype=model.dtype), *values]).astype(np.int32)))
        model.forget()  # the worker may go on with tasks of other stages

    return docs.withColumn(ids, map_column(docs.sparkSession, work, "array<int>")(F.col(text).cast("string")))


def decode_documents(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the text of ``ids`` in column ``text``. Null ids give empty text."""

    def work(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = bpe(path)
        for column in lists:
            yield pa.array([model.decode(np.asarray(x.values if x.is_valid else [], dtype=np.int64)) for x in column], pa.string())

    return rows.withColumn(text, map_column(rows.sparkSession, work, "string")(F.col(ids)))


def token_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode the ids again, and report both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row per input row. Null and empty text: 0 tokens and the digests of the empty string. Repeated rows give
    repeated results; a null doc_id stays null; other columns are not read. No shuffle: the documents' tasks do all.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            counts, digits, decoded = [], [], []
            for ids in model.encode(batch.column(1)):
                counts.append(len(ids))
                digits.append(hashlib.sha256(memoryview(model.digits_of(ids))[:-1]).hexdigest())
                decoded.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digits, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        model.forget()  # the worker may go on with tasks of other stages

    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(frame, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
