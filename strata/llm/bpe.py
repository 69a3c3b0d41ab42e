"""Byte-level BPE encoding and decoding (operator 2), and its on-Spark drivers.

A text is cut into pieces at every space that a non-space follows.  The
pre-tokenizer's pattern starts a new token exactly there (a run of white space
gives its last space to the word behind it), so pieces encode independently and
a bounded cache of pieces serves all texts of a worker.

Within a short word the parts' boundaries and the ranks of adjacent pairs stand
in two contiguous lists: find the smallest rank, delete the boundary behind it,
refresh the two neighbouring ranks, repeat.  Words beyond ``SHORT`` bytes use a
heap over a linked list, as the scan would be quadratic there.

Null text counts as empty and has no ids.  Special tokens' strings in a text
become their ids, as the reference tokenizers library has it by default.
Merges of one rank go from left to right.  Repeated rows and null doc_ids get a
result row each, equal texts equal ids; an empty table gives an empty result;
columns besides doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import released

SHORT = 128
CACHE = 400_000
NEVER = 1 << 60

# Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = regex.compile(r" (?=\S)")
_UNEVEN = regex.compile(r" (?:\s|$)")


def byte_letters() -> dict[int, str]:
    """Byte -> printable character: visible Latin-1 stands for itself, the rest follows from U+0100."""
    own = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def split_pieces(text: str) -> list[str]:
    """Pieces whose encodings add up to the text's; all but the first lack their leading space."""
    return _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")


class ByteBPE:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, back = spec["model"]["vocab"], {c: b for b, c in byte_letters().items()}
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.first = [vocab[c] for _, c in sorted(byte_letters().items())]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []  # by rank
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocab[a], vocab[b]] = len(self.merged)
            self.merged.append(vocab[a + b])
        self.words = regex.compile(PIECE)
        self.path, self.library = path, None
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.decimal = [str(i) for i in range(size)]
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        return self._scan(word) if len(word) <= SHORT else self._heap(word)

    def _scan(self, word: bytes) -> list[int]:
        rank, first = self.rank.get, self.first
        parts = [first[b] for b in word]
        ranks = [rank(p, NEVER) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            parts[at] = new = self.merged[best]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], new), NEVER)
            if at < len(ranks):
                ranks[at] = rank((new, parts[at + 1]), NEVER)
        return parts

    def _heap(self, word: bytes) -> list[int]:
        rank, ids, n = self.rank, [self.first[b] for b in word], len(word)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(queue)

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (p := (ids[i], ids[right[i]])) in rank:
                heapq.heappush(queue, (rank[p], i, *p))

        while queue:
            best, i, a, b = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the parts has changed since
            ids[i], ids[j] = self.merged[best], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [i for i in ids if i >= 0]

    def piece(self, piece: str) -> tuple[int, ...]:
        out: list[int] = []
        for word in self.words.findall(piece) if piece.isascii() else self.cut(piece):
            out += self.merge(word.encode())
        return tuple(out)

    def cut(self, piece: str) -> list[str]:
        """Pre-tokens; for characters newer than Python's Unicode tables the library's own tables decide."""
        if all(unicodedata.category(c) != "Cn" for c in piece):
            return self.words.findall(piece)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [piece[a:b] for _, (a, b) in self.library.pre_tokenize_str(piece)]

    def _plain(self, text: str) -> list[int]:
        if not text:
            return []
        first, *rest = split_pieces(text)
        ids, cache = list(self.piece(first)), self.cache
        for p in rest:
            got = cache.get(p)
            if got is None:
                if len(cache) >= CACHE:
                    cache.clear()
                got = self.piece(" " + p)
                if len(p) <= SHORT:
                    cache[p] = got
            ids += got
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        ids: list[int] = []
        for i, part in enumerate(self.cut_special.split(text)):
            ids += [self.special[part]] if i % 2 else self._plain(part)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The tokenizer of a file, once per process."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_column(text, path: str):
    """Column of id lists (array<int>) for a text column."""

    @F.arrow_udf("array<int>")
    @released
    def encode(texts: pa.Array) -> pa.Array:
        # One text's ids at a time: as Python lists, those of a batch would fill the memory.
        bpe = load(path)
        rows = [np.array(bpe.encode(t.as_py()), np.int32) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else [], pa.int32()))

    return encode(text)


def decode_column(ids, path: str):
    """Column of texts for a column of id lists; null ids give an empty text."""

    @F.arrow_udf("string")
    @released
    def decode(rows: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([bpe.decode(r.values.to_numpy().tolist() if r.is_valid else ()) for r in rows], pa.string())

    return decode(ids)


def token_count_column(text, path: str):
    """Column of token counts."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([len(bpe.encode(t)) for t in texts.to_pylist()], pa.int64())

    return count(text)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document.

    Encodes and decodes within one Python step, so that id lists never travel.
    One row per input row, repeated rows included; a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            count, encoded, decoded = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                count.append(len(ids))
                encoded.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
