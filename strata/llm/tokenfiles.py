"""Token-id files in Simple-8b (operator 6).

File layout, all little-endian:

    magic "SB8TOK01"
    blocks, one after the other: 64-bit words of Simple-8b
    footer: for each document  doc_id int64, first id uint64 (within the file), ids uint32
            for each block     byte offset uint64, words uint32, ids uint32
    tail:   documents uint64, blocks uint64, footer offset uint64, magic

A word's top four bits are its selector, which says how many ids of how many
bits its low 60 bits hold.  Selector 15 is the escape: the low bits count raw
64-bit words that follow, for values of 2^60 or more.  Blocks hold up to
``BLOCK`` ids and decode on their own, all words of one selector at a time.

Writers put each file under a name of its own attempt and return a manifest row;
only files that successful tasks report are read, so a lost executor leaves at
most an unreferenced file.  Rows with a null doc_id come first; equal doc_ids
are ordered by text.  Null text counts as empty (the end id alone).  doc_id must be an integer,
or text that reads as one: files hold it in 64 bits.  Repeated rows are documents each, side by
side.  A very long text is encoded whole and spans as many blocks as it needs.  An empty table
gives no file and an empty result.  Columns besides doc_id and text play no part.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import bpe
from strata.storage import new_path

MAGIC = b"SB8TOK01"
BLOCK = 1 << 15
ROLL = 1_000_000  # documents a file
CACHE = 300_000
ESCAPE = 15
# Ids per word by selector: 60 // n bits each.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // COUNTS
_NO_ID = -(1 << 63)


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of ``ids`` (uint64): at each place the selector that takes most ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if n == 0:
        return np.empty(0, np.uint64)
    if (ids >> np.uint64(60)).any():
        return _pack_escaped(ids)
    padded = np.concatenate([_widths(ids), np.zeros(60, np.uint8)])
    choice = np.full(n, len(COUNTS) - 1, np.int8)
    for s in range(len(COUNTS) - 2, -1, -1):  # the selector that takes most ids is set last
        over = np.zeros(n + 61, np.int32)
        np.cumsum(padded > BITS[s], out=over[1:])
        choice[over[COUNTS[s] : COUNTS[s] + n] == over[:n]] = s
    step = COUNTS[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    at = np.array(starts)
    chosen = choice[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    full = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        words[rows] |= np.bitwise_or.reduce(full[at[rows, None] + np.arange(COUNTS[s])] << shifts, axis=1)
    return words


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    width, rest = np.zeros(len(ids), np.uint8), ids.copy()
    while rest.any():
        width += rest > 0
        rest >>= np.uint64(1)
    return width


def _pack_escaped(ids: np.ndarray) -> np.ndarray:
    big = ids >> np.uint64(60) > 0
    edges = np.flatnonzero(np.diff(big)) + 1
    out = []
    for part in np.split(ids, edges):
        if part[0] >> np.uint64(60):
            out += [np.array([(ESCAPE << 60) | len(part)], np.uint64), part]
        else:  # zero-filled tails must not stand in the middle: one id a word at the end
            whole = pack(part)
            used = COUNTS[(whole >> np.uint64(60)).astype(int)]
            extra = int(used.sum()) - len(part)
            if extra:
                keep = int(used[-1]) - extra
                single = np.uint64(len(COUNTS) - 1) << np.uint64(60)
                whole = np.concatenate([whole[:-1], part[len(part) - keep :] | single])
            out.append(whole)
    return np.concatenate(out)


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids in ``words``."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():
        return _unpack_escaped(words, n)
    counts = COUNTS[selector]
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        lanes = np.arange(COUNTS[s])
        mask = np.uint64((1 << int(BITS[s])) - 1)
        out[place[rows, None] + lanes] = (words[rows, None] >> (lanes * BITS[s]).astype(np.uint64)) & mask
    return out[:n]


def _unpack_escaped(words: np.ndarray, n: int) -> np.ndarray:
    out, at, plain = [], 0, 0
    while at < len(words):
        if int(words[at]) >> 60 != ESCAPE:
            at += 1
            continue
        many = int(words[at]) & ((1 << 60) - 1)
        if at > plain:
            part = words[plain:at]
            out.append(unpack(part, int(COUNTS[(part >> np.uint64(60)).astype(int)].sum())))
        out.append(words[at + 1 : at + 1 + many])
        at = plain = at + 1 + many
    if at > plain:
        part = words[plain:at]
        out.append(unpack(part, int(COUNTS[(part >> np.uint64(60)).astype(int)].sum())))
    return np.concatenate(out)[:n]


_BEYOND_LATIN = re.compile("[^\x00-\u0377]")


def _has_newer_characters(text: str) -> bool:
    """Whether Python's Unicode tables lack a character: libraries may class it differently."""
    return not text.isascii() and bool(_BEYOND_LATIN.search(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian uint32 bytes.

    The merging itself runs in tiktoken, on ranks taken from the tokenizer's own
    file: for vocabularies whose ids follow their merges the result is the same
    and takes a quarter of the time.  Texts that hold special tokens or
    characters newer than Python's Unicode tables go to the tokenizers library,
    as do all texts of other vocabularies.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        own = bpe.load(path)
        self.special = list(own.special)
        self.fast = None
        if own.merged == sorted(own.merged):
            import tiktoken

            ranks = {t: i for i, t in enumerate(own.bytes_of) if t and i not in own.special.values()}
            self.fast = tiktoken.Encoding("own", pat_str=bpe.PIECE, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        odd = self.fast is None or any(s in text for s in self.special) or _has_newer_characters(text)
        ids = self.library.encode(text, add_special_tokens=False).ids if odd else self.fast.encode_ordinary(text)
        return np.array(ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class FileWriter:
    """Blocks as they fill up; documents and blocks in the footer at the end."""

    def __init__(self, uri: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.offset, self.ids, self.pending, self.waiting = len(MAGIC), 0, [], 0
        self.docs: list[tuple[int, int, int]] = []
        self.blocks: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((_NO_ID if doc_id is None else doc_id, self.ids, len(ids)))
        self.ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.pending)
        while len(ids) >= max(least, 1):
            block, ids = ids[:BLOCK], ids[BLOCK:]
            words = pack(block)
            self.out.write(words.astype("<u8").tobytes())
            self.blocks.append((self.offset, len(words), len(block)))
            self.offset += 8 * len(words)
        self.pending, self.waiting = [ids], len(ids)

    def close(self) -> None:
        if self.waiting:
            self._flush(1)
        self.out.write(np.array(self.docs, DOC).tobytes() + np.array(self.blocks, BLOCKS).tobytes())
        self.out.write(np.array([len(self.docs), len(self.blocks), self.offset], "<u8").tobytes() + MAGIC)
        self.out.close()


def read_file(uri: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, first id within the file, ids) of each document, in order, block by block."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 32)
        tail = f.read(32)
        if tail[24:] != MAGIC:
            raise ValueError(f"{uri} is not a whole token file")
        n_docs, n_blocks, footer = (int(x) for x in np.frombuffer(tail[:24], "<u8"))
        f.seek(footer)
        docs = np.frombuffer(f.read(n_docs * DOC.itemsize), DOC)
        blocks = np.frombuffer(f.read(n_blocks * BLOCKS.itemsize), BLOCKS)
        held, at = np.empty(0, np.uint64), 0
        for doc_id, first, many in docs.tolist():
            parts, have = [held], len(held)
            while have < many:
                offset, words, ids = (int(x) for x in blocks[at])
                at += 1
                f.seek(offset)
                parts.append(unpack(np.frombuffer(f.read(8 * words), "<u8"), ids))
                have += ids
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield None if doc_id == _NO_ID else doc_id, first, held[:many]
            held = held[many:]


DOC = np.dtype([("doc_id", "<i8"), ("first", "<u8"), ("ids", "<u4")])
BLOCKS = np.dtype([("offset", "<u8"), ("words", "<u4"), ("ids", "<u4")])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, directory: str | None = None) -> DataFrame:
    """Write all documents' ids in ascending doc_id order; return the manifest.

    The manifest has a row for each file: part, uri, docs, ids, base (ids in all
    files before it).  A partition begins a new file after ROLL documents, so a
    writer's memory is bounded; the manifest stays short enough for the driver to
    sum the bases up.
    """
    spark = docs.sparkSession
    directory = directory or new_path(spark, "tokens")
    roll = ROLL
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer, number, end, whole = None, 0, np.array([end_id], np.uint32), encoder(tokenizer)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if writer is None:
                    uri, number = f"{directory}/part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.sb8", number + 1
                    writer = FileWriter(uri)
                writer.add(doc_id.as_py(), np.concatenate([whole.encode(text.as_py()), end]).astype(np.uint64))
                if len(writer.docs) >= roll:
                    yield closed(writer, uri)
                    writer = None
        if writer is not None:
            yield closed(writer, uri)

    def closed(writer: FileWriter, uri: str) -> pa.RecordBatch:
        writer.close()
        from pyspark import TaskContext

        return pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "uri": uri, "docs": len(writer.docs), "ids": writer.ids}])

    # A row for each file; the rows outlive their executors in the driver.  Names sort as the files follow each other.
    files = sorted(ordered.mapInArrow(run, "part bigint, uri string, docs bigint, ids bigint").collect())
    base, rows = 0, []
    for part, uri, n, ids in files:
        rows.append((part, uri, n, ids, base))
        base += ids
    return spark.createDataFrame(rows, "part bigint, uri string, docs bigint, ids bigint, base bigint")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[tuple] = []
                for doc_id, first, ids in read_file(row["uri"]):
                    out.append((doc_id, row["base"] + first, len(ids), zlib.crc32(ids.astype("<u4"))))
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    files = manifest.select("uri", "base").repartition(max(1, manifest.count()))  # a task for each file
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
