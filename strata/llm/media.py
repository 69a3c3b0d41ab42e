"""Media columns as baseline JPEG (operator 8).

A payload of 64-byte units is stored losslessly as the quantised coefficients of
8x8 luminance blocks: byte b is the amplitude of category 8 whose eight bits are
b, so every byte has a coefficient and none is zero.  Tables hold the one-bit
code for that category; a restart marker follows each block, which resets the DC
prediction and aligns the next block.  Quantisation is by one throughout.

The decoder reads any baseline sequential JPEG: it parses the markers, cuts the
scan at its restart markers and Huffman-decodes all intervals of a batch in
lockstep, one symbol of each at a time, in numpy.  DC terms alone give a
thumbnail of one pixel a block; its hash and the dimensions are the features.

Null text counts as empty and is stored as one unit of zeros.  A long text is coded
and decoded in slices of blocks.  Repeated rows and null doc_ids get a result row
each, equal texts equal bytes; an empty table gives an empty result; columns
besides doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Amplitude bits of every stored coefficient.
CATEGORY = 8
BATCH_BYTES = 2 << 20
SLICE = 1 << 14  # blocks or restart intervals in work at a time


def zigzag() -> np.ndarray:
    """Natural index of each coefficient in scan order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


def pad(data: bytes) -> bytes:
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan_of(payload: bytes, begin: int, end: int, many: int) -> bytes:
    """Coded blocks ``begin`` to ``end`` of ``many``; blocks that the payload does not reach are zeros."""
    blocks = np.zeros((end - begin, 64), np.uint8)
    blocks[: len(payload) // 64] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    # Each coefficient is the code 0 and its eight bits: 72 bytes a block.
    bits = np.zeros((len(blocks), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(-1, 64, 8)
    coded = np.packbits(bits.reshape(len(blocks), 576), axis=1)
    # Room for stuffing after 0xFF and for the restart marker behind each block but the last.
    out = np.zeros((len(blocks), 146), np.uint8)
    out[:, 0:144:2] = coded
    out[:, 144] = 0xFF
    out[:, 145] = 0xD0 + np.arange(begin, end) % 8
    keep = np.ones((len(blocks), 146), bool)
    keep[:, 1:144:2] = coded == 0xFF
    if end == many:
        keep[-1, 144:] = False
    return out[keep].tobytes()


def encode(payload: bytes) -> bytes:
    """A JPEG that holds ``payload`` (a positive multiple of 64 bytes); a comment gives its units."""
    units = len(payload) // 64
    wide = math.isqrt(units - 1) + 1
    high = -(-units // wide)
    many = wide * high
    parts = [_scan_of(payload[64 * at : 64 * (at + SLICE)], at, min(many, at + SLICE), many) for at in range(0, many, SLICE)]
    table = bytes([1] + [0] * 15) + bytes([CATEGORY])
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0" + bytes([1, 1, 0, 0, 1, 0, 1, 0, 0])),
            _segment(0xFE, b"units " + str(units).encode()),
            _segment(0xDB, bytes([0]) + bytes([1] * 64)),
            _segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, bytes([0x00]) + table + bytes([0x10]) + table),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
            *parts,
            b"\xff\xd9",
        ]
    )


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)  # 0x00-0x03 DC, 0x10-0x13 AC
    restart: int = 0
    comment: bytes = b""
    scan: list[Component] = field(default_factory=list)
    data: bytes = b""

    @property
    def mcu(self) -> tuple[int, int]:
        """MCUs across and down."""
        if len(self.scan) == 1:
            c = self.scan[0]
            h, v = max(x.h for x in self.components), max(x.v for x in self.components)
            return -(-(-(-self.width * c.h // h)) // 8), -(-(-(-self.height * c.v // v)) // 8)
        h, v = max(x.h for x in self.components), max(x.v for x in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def layout(self) -> list[Component]:
        """The component of each block of an MCU."""
        return self.scan if len(self.scan) == 1 else [c for c in self.scan for _ in range(c.h * c.v)]


def parse(jpeg: bytes) -> Picture:
    """Markers up to the entropy-coded data of the first scan."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    out, at = Picture(), 2
    while at < len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        while jpeg[at] == 0xFF:
            at += 1
        marker = jpeg[at]
        size = struct.unpack_from(">H", jpeg, at + 1)[0]
        body, at = jpeg[at + 3 : at + 1 + size], at + 1 + size
        if marker == 0xDB:
            while body:
                wide, many = body[0] >> 4, 64 * (1 + (body[0] >> 4))
                out.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + many], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + many :]
        elif marker == 0xC4:
            while body:
                many = 16 + sum(body[1:17])
                out.huffman[body[0]] = bytes(body[1 : 1 + many])
                body = body[1 + many :]
        elif marker in (0xC0, 0xC1):
            out.height, out.width, many = struct.unpack_from(">xHHB", body)
            out.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(many)]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline sequential coding is supported")
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            out.comment = bytes(body)
        elif marker == 0xDA:
            for i in range(body[0]):
                c = next(c for c in out.components if c.ident == body[1 + 2 * i])
                c.dc, c.ac = body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15
                out.scan.append(c)
            out.data = jpeg[at:]
            return out
        elif marker == 0xD9:
            break
    raise ValueError("no scan")


_tables: dict[bytes, np.ndarray] = {}


def lookup(spec: bytes) -> np.ndarray:
    """By the next 16 bits: code length * 256 + symbol; 0 where no code begins so."""
    if spec not in _tables:
        table, code, at = np.zeros(1 << 16, np.int32), 0, 16
        for size in range(1, 17):
            for _ in range(spec[size - 1]):
                lo = code << (16 - size)
                table[lo : lo + (1 << (16 - size))] = size * 256 + spec[at]
                code, at = code + 1, at + 1
            code <<= 1
        if len(_tables) > 64:
            _tables.clear()
        _tables[spec] = table
    return _tables[spec]


def intervals(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unstuffed bytes of a scan with each restart interval's first and last position."""
    raw = np.frombuffer(data, np.uint8)
    full = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[full + 1]
    end = full[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    stop = int(end[0]) if len(end) else len(raw)
    within = full < stop
    full, after = full[within], after[within]
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    gone = np.sort(np.concatenate([full[after == 0] + 1, marks, marks + 1]))
    gone = gone[gone < stop]
    keep = np.ones(stop, bool)
    keep[gone] = False
    edges = np.concatenate([[0], marks - np.searchsorted(gone, marks), [stop - len(gone)]])
    return raw[:stop][keep], edges[:-1], edges[1:]


def decode_scans(pictures: list[Picture]) -> list[list[np.ndarray]]:
    """Quantised coefficients in scan order, by picture and block of the MCU: (MCUs, 64) each.

    Works on the restart intervals of all pictures, a slice of them at once.
    """
    chunks, begin, owner, mcus, base, at = [], [], [], [], [], 0
    for k, p in enumerate(pictures):
        data, first, last = intervals(p.data)
        across, down = p.mcu
        total = across * down
        each = p.restart or total
        if len(first) < -(-total // each):
            raise ValueError("restart intervals are missing")
        many = -(-total // each)
        chunks += [data, np.zeros(8, np.uint8)]
        begin.append((first[:many] + at) * 8)
        at += len(data) + 8
        owner.append(np.full(many, k))
        starts = np.arange(many) * each
        base.append(starts)
        mcus.append(np.minimum(each, total - starts))
    stream = np.concatenate([*chunks, np.zeros(8, np.uint8)])
    places, owners, runs, bases = (np.concatenate(x) for x in (begin, owner, mcus, base))
    specs: dict[bytes, int] = {}
    depth = max(len(p.layout()) for p in pictures)
    dc, ac, comp = (np.zeros((len(pictures), depth), np.int64) for _ in range(3))
    for k, p in enumerate(pictures):
        for b, c in enumerate(p.layout()):
            dc[k, b] = specs.setdefault(p.huffman[c.dc], len(specs))
            ac[k, b] = specs.setdefault(p.huffman[c.ac], len(specs))
            comp[k, b] = p.scan.index(c)
    tables = np.concatenate([lookup(s) for s in specs])
    size = np.array([len(p.layout()) for p in pictures])
    out = [[np.zeros((p.mcu[0] * p.mcu[1], 64), np.int16) for _ in p.layout()] for p in pictures]
    flat = np.cumsum([0, *(o.size for blocks in out for o in blocks)])
    whole = np.zeros(flat[-1], np.int16)
    offset, at = np.zeros((len(pictures), depth), np.int64), 0
    for k, blocks in enumerate(out):
        for b in range(len(blocks)):
            offset[k, b] = flat[at]
            at += 1
    def peek(pos: np.ndarray) -> np.ndarray:
        """16 bits from each position on."""
        return ((words[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32)) & np.uint32(0xFFFF)).astype(np.int64)

    def symbol(pos: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = tables[(table << 16) + peek(pos)]
        if not got.all():
            raise ValueError("bits that are no Huffman code")
        return got & 255, got >> 8

    def amplitude(pos: np.ndarray, bits: np.ndarray) -> np.ndarray:
        raw = peek(pos) >> (16 - bits)
        return np.where((bits > 0) & (raw < (1 << np.maximum(bits - 1, 0))), raw - (1 << bits) + 1, raw)

    for lo in range(0, len(owners), SLICE):
        owner, mcus, base = owners[lo : lo + SLICE], runs[lo : lo + SLICE], bases[lo : lo + SLICE]
        first = int(places[lo] >> 3)
        last = int(places[lo + SLICE] >> 3) + 8 if lo + SLICE < len(places) else len(stream)
        own = stream[first:last].astype(np.uint32)
        words = (own[:-3] << 24) | (own[1:-2] << 16) | (own[2:-1] << 8) | own[3:]  # 32 bits from each byte on
        place = places[lo : lo + SLICE] - 8 * first
        prediction = np.zeros((len(owner), 1 + int(comp.max())), np.int64)
        for m in range(int(mcus.max())):
            for b in range(depth):
                live = np.flatnonzero((mcus > m) & (size[owner] > b))
                if not len(live):
                    continue
                who, pos = owner[live], place[live]
                target = offset[who, b] + 64 * (base[live] + m)
                bits, used = symbol(pos, dc[who, b])
                pos = pos + used
                seat = comp[who, b]
                prediction[live, seat] += amplitude(pos, bits)
                whole[target] = prediction[live, seat]
                pos += bits
                table, k = ac[who, b], np.ones(len(live), np.int64)
                left = np.arange(len(live))  # blocks with coefficients to come
                every = True
                while len(left):
                    p, kk = (pos, k) if every else (pos[left], k[left])
                    code, used = symbol(p, table if every else table[left])
                    run, bits = code >> 4, code & 15
                    p = p + used
                    ends = (bits == 0) & (run != 15)
                    kk = kk + run
                    value = bits > 0
                    if value.all():
                        whole[(target if every else target[left]) + kk] = amplitude(p, bits)
                    else:
                        rows = left[value]
                        whole[target[rows] + kk[value]] = amplitude(p[value], bits[value])
                    p += bits
                    kk = np.where(ends, 64, kk + 1)
                    if every:
                        pos, k = p, kk
                    else:
                        pos[left], k[left] = p, kk
                    more = kk < 64
                    if not more.all():
                        left, every = left[more], False
                place[live] = pos
    return [[whole[flat[i] : flat[i + 1]].reshape(-1, 64) for i in range(a, a + len(blocks))] for a, blocks in zip(np.cumsum([0, *(len(o) for o in out)]), out)]


def decode(jpegs: list[bytes]) -> list[tuple[Picture, np.ndarray, np.ndarray]]:
    """For each JPEG: its markers, the luminance blocks' coefficients and the DC thumbnail (uint8)."""
    pictures = [parse(j) for j in jpegs]
    found = []
    for p, blocks in zip(pictures, decode_scans(pictures)):
        c = p.scan[0]
        across, down = p.mcu
        quant = p.quant[c.quant][0]
        h, v = (1, 1) if len(p.scan) == 1 else (c.h, c.v)
        grid = np.stack([b[:, 0] for b in blocks[: h * v]], axis=1).astype(np.int64)
        grid = grid.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        thumb = np.clip(np.round(grid * quant / 8 + 128), 0, 255).astype(np.uint8)
        found.append((p, blocks[0], thumb[: -(-p.height // 8), : -(-p.width // 8)]))
    return found


def payload_of(picture: Picture, blocks: np.ndarray) -> bytes:
    """The bytes that ``encode`` stored."""
    units = int(picture.comment.split()[1])
    values = blocks[:units]
    return (values.astype(np.uint8) - (values < 0)).astype(np.uint8, copy=False).tobytes()  # a negative v stands for v + 255


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 reduction of the thumbnail are brighter than their mean."""
    rows = np.arange(8) * thumb.shape[0] // 8
    columns = np.arange(8) * thumb.shape[1] // 8
    sums = np.pad(thumb.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    r1 = np.maximum(rows + 1, (np.arange(8) + 1) * thumb.shape[0] // 8)
    c1 = np.maximum(columns + 1, (np.arange(8) + 1) * thumb.shape[1] // 8)
    area = (r1 - rows)[:, None] * (c1 - columns)[None, :]
    cells = (sums[r1][:, c1] - sums[rows][:, c1] - sums[r1][:, columns] + sums[rows][:, columns]) / area
    return np.packbits(cells > cells.mean()).tobytes().hex()


def feature(picture: Picture, thumb: np.ndarray) -> str:
    digest = hashlib.sha256(thumb.tobytes()).hexdigest()[:16]
    return f"jpeg:{picture.width}x{picture.height}:thumb={thumb.shape[1]}x{thumb.shape[0]}:ahash={average_hash(thumb)}:sha={digest}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id and ``media``: each document's text as a JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [encode(pad(t or b"")) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, media binary")


def thumbnails(media: DataFrame) -> DataFrame:
    """doc_id, width, height, thumb_width, thumb_height, thumb (bytes, row by row) and thumb_hash of baseline JPEGs.

    A null or broken file gives nulls beside its doc_id.
    """
    names = ["doc_id", "width", "height", "thumb_width", "thumb_height", "thumb", "thumb_hash"]

    def one(jpeg: bytes | None) -> tuple:
        try:
            picture, _, thumb = decode([jpeg])[0]
        except (ValueError, TypeError, IndexError, KeyError, StopIteration, struct.error):
            return (None,) * 6
        return picture.width, picture.height, thumb.shape[1], thumb.shape[0], thumb.tobytes(), average_hash(thumb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(one(j) for j in batch.column(1).to_pylist()))) or [()] * 6
            kinds = [pa.int32()] * 4 + [pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds))], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, width int, height int, thumb_width int, thumb_height int, thumb binary, thumb_hash string")


def digests(docs: DataFrame) -> DataFrame:
    """Sizes, digests and features of every document, its payload read back from the stored JPEG."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def group(texts: list[bytes]) -> Iterator[tuple]:
        media = [encode(pad(t)) for t in texts]
        for text, jpeg, (picture, blocks, thumb) in zip(texts, media, decode(media)):
            back = payload_of(picture, blocks)
            yield len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(jpeg), hashlib.sha256(jpeg).hexdigest(), feature(picture, thumb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, some, held = [], [], 0
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                some.append(text or b"")
                held += len(some[-1])
                if held >= BATCH_BYTES:
                    rows += group(some)
                    some, held = [], 0
            if some:
                rows += group(some)
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
