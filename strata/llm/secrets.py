"""Secret scans (operator 7).

One Aho-Corasick pass over a lower-cased copy finds keywords; regular
expressions run only where a keyword begins, anchored there.  Hexadecimal and
base-58 findings have no keyword: runs of their letters of the least length are
sought, and a base-58 run counts only with the length, first letter and checksum
of a key.
Tokens of formats that embed a checksum become findings of their own where the
checksum is right, and raise the confidence of what they overlap.

Kinds in the base: assign, access, hex.  Kinds the method adds: checked (prefix,
random part and base-62 CRC-32), wif (base58 with a double SHA-256 checksum).
Offsets are code points, ends exclusive.  Null text counts as empty.
Repeated rows and null doc_ids get a result row each, equal texts equal findings; of
kinds that begin at one place the first listed comes first.  An empty table gives
an empty result; columns besides doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "checked", "wif")
LEAST = {"assign": 6, "access": 20, "hex": 24}

# The shapes of the base findings and of checksummed tokens.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:ghp|gho|ghu|ghs|ghr)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])|npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
WIF = re.compile(r"[1-9A-HJ-NP-Za-km-z]{51,}+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
}
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def crc_base62(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def wif_is_valid(key: str) -> bool:
    value = 0
    for c in key:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return len(raw) in (37, 38) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _automaton():
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


class Scanner:
    def __init__(self) -> None:
        self.keywords = _automaton()

    def scan(self, text: str | None) -> list[tuple[str, int, int, bool]]:
        """(kind, start, end, validated), by start and then kind."""
        if not text:
            return []
        lower = text.lower()
        if len(lower) != len(text):
            lower = text.translate(_ASCII_LOWER)
        found, ends = [], {"assign": 0, "access": 0, "checked": 0}
        for last, (kind, size) in self.keywords.iter(lower):
            start = last + 1 - size
            if start < ends[kind]:
                continue
            hit = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}[kind].match(text, start)
            if hit is None:
                continue
            if kind == "checked":
                body, check = (g for g in hit.groups() if g is not None)
                if crc_base62(body) != check:
                    continue
            ends[kind] = hit.end()
            if kind != "checked" and len(hit[2] if kind == "assign" else hit[0]) < LEAST[kind]:
                continue
            found.append((kind, start, hit.end(), kind == "checked"))
        found += [("hex", m.start(), m.end(), False) for m in HEX.finditer(text)]
        found += [("wif", m.start(), m.end(), True) for m in WIF.finditer(text) if m.end() - m.start() <= 52 and text[m.start()] in "5KL9c" and wif_is_valid(m[0])]
        sure = [(a, b) for _, a, b, ok in found if ok]
        if sure:
            found = [(k, a, b, ok or any(a < y and x < b for x, y in sure)) for k, a, b, ok in found]
        return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def _join(found: list[tuple[str, int, int, bool]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)


def findings(text: str) -> Column:
    """Column of arrays of (kind, start, end, validated) for a text column."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("validated", pa.bool_())]))

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,validated:boolean>>")
    def run(texts: pa.Array) -> pa.Array:
        scanner, names = Scanner(), ("kind", "start", "end", "validated")
        return pa.array([[dict(zip(names, f)) for f in scanner.scan(t)] for t in texts.to_pylist()], kind)

    return run(text)


def masked(text: str) -> Column:
    """The text with every finding replaced by its kind in brackets; overlapping findings go together."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        scanner = Scanner()
        return pa.array([_mask(t, scanner.scan(t)) for t in texts.to_pylist()], pa.string())

    return run(text)


def _mask(text: str | None, found: list[tuple[str, int, int, bool]]) -> str | None:
    out, at = [], 0
    for kind, start, end, _ in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = scanner.scan(text)
                base = [f for f in found if f[0] in BASE_KINDS]
                counts = [sum(f[0] == k for f in base) for k in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(found)))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
