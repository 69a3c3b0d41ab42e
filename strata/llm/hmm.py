"""Hidden Markov language model (operator 9).

Words (A-Z lower-cased, cut at ASCII white space) and one end per text are the
tokens.  A token belongs to one of a fixed number of symbols, by its letters
alone.  The model draws a chain of latent states, from each state a symbol, and
from each symbol a token in proportion to its training count plus one, with one
more share for all tokens never seen.  Every text thus has an exact probability.

1. Documents are encoded in chunks: a chunk has its own dictionary, and texts
   become sequences of numbers in it.
2. Dictionaries meet in buckets by word, where training counts are summed and
   sent back to the chunks.  A word counts once for each chunk there, however
   many documents hold it.  Beyond ``FAN`` chunks sums are made in levels, so no
   task ever holds one bucket's words of all chunks.
3. Baum-Welch: each chunk sums expected counts over its training texts, groups
   of partitions add them, the driver re-estimates.  Every training text counts
   whole in each round; rounds go on until one gains no more than ``TOLERANCE``
   of the log likelihood.  All texts of a chunk step together; beyond
   ``BATCH_TOKENS`` they go through the recursions in segments, the later ones
   first.
4. A scaled forward recursion in double precision gives each text's likelihood.

Held-out texts (crc32 of the doc_id as text, modulo 7, is 2) lend nothing.  Null
text counts as empty: its only token is the end.  Rows with a null doc_id train.
Repeated rows count and are scored each; equal texts score alike.  An empty table
gives an empty result; without training texts the model is its priors.  Columns
besides doc_id and text play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import release_memory
from strata.llm.quality_classifier import held_out
from strata.storage import materialize

STATES = 8
SHORT_SYMBOLS = 1024
LONG_SYMBOLS = 3071
END = SHORT_SYMBOLS + LONG_SYMBOLS
SYMBOLS = END + 1
CHUNK_BYTES = 8 << 20
BATCH_TOKENS = 3_000_000  # whose state chances are held at once, in single precision
STEP_TOKENS = 60_000  # in work at a time
SCALE_EVERY = 4
TOLERANCE = 1e-4  # of the log likelihood of all training texts
PRIOR = 200.0
FAN = 256  # chunks, or sums of chunks, whose words of one bucket a task sees


def symbol_of(word: bytes) -> int:
    """Short words by all their letters, longer ones by their two first and two last bytes."""
    if len(word) <= 3:
        return zlib.crc32(word) % SHORT_SYMBOLS if word else END
    return SHORT_SYMBOLS + zlib.crc32(word[:2] + b" " + word[-2:]) % LONG_SYMBOLS


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def symbols_of(words: pa.Array) -> np.ndarray:
    """``symbol_of`` for an array of words."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    begin, size = offsets[:-1], np.diff(offsets)
    out, crc = np.full(len(words), END, np.uint16), lambda state, byte: _CRC[(state ^ byte) & 0xFF] ^ (state >> np.uint32(8))
    for n in (1, 2, 3, 4):
        own = np.flatnonzero(size >= 4 if n == 4 else size == n)
        first, state = begin[own], np.full(len(own), 0xFFFFFFFF, np.uint32)
        if n < 4:
            letters = [data[first + i] for i in range(n)]
        else:
            last = first + size[own]
            letters = [data[first], data[first + 1], np.uint32(32), data[last - 2], data[last - 1]]
        for byte in letters:
            state = crc(state, byte)
        state = ~state
        out[own] = state % SHORT_SYMBOLS if n < 4 else SHORT_SYMBOLS + state % LONG_SYMBOLS
    return out


class Chunk:
    """Texts as numbers in a dictionary of their own; number 0 is the end."""

    def __init__(self) -> None:
        self.doc_ids: list = []
        self.held: list[bool] = []
        self.lengths: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.bytes = 0

    def add(self, doc_ids: list, held: list[bool], texts: pa.Array, size: int) -> None:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        flat, offsets = lists.flatten().cast(pa.binary()), np.asarray(lists.offsets)
        real = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty word
        before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        self.lengths.append(np.diff(before[offsets - offsets[0]]))
        self.words.append(flat.filter(real))
        self.doc_ids += doc_ids
        self.held += held
        self.bytes += size

    def row(self, chunk: int, buckets: int) -> dict:
        coded = pa.chunked_array(self.words, pa.binary()).combine_chunks().dictionary_encode()
        lengths = np.concatenate(self.lengths).astype(np.int32) + 1
        tokens, ends = np.zeros(int(lengths.sum()), np.int32), np.cumsum(lengths) - 1
        real = np.ones(len(tokens), bool)
        real[ends] = False
        tokens[real] = coded.indices.to_numpy() + 1
        words = pa.concat_arrays([pa.array([b""], pa.binary()), coded.dictionary])
        names = words.to_pylist()
        train = np.repeat(~np.array(self.held), lengths)
        counts = np.bincount(tokens[train], minlength=len(names))
        bucket = np.fromiter(map(zlib.crc32, names), np.uint32, len(names)) % buckets
        order = np.argsort(bucket, kind="stable").astype(np.int32)
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        parts = [
            {"bucket": b, "words": b"\n".join(map(names.__getitem__, own.tolist())), "places": own.tobytes(), "counts": counts[own].astype(np.int32).tobytes()}
            for b in range(buckets)
            if len(own := order[edges[b] : edges[b + 1]])
        ]
        return {
            "chunk": chunk,
            "doc_ids": self.doc_ids,
            "held": self.held,
            "lengths": lengths.tobytes(),
            "tokens": tokens.tobytes(),
            "symbols": symbols_of(words).tobytes(),
            "parts": parts,
        }


def encode(docs: DataFrame, buckets: int) -> DataFrame:
    """The table of chunks, written once."""
    kind = docs.schema["doc_id"].dataType
    ddl = (
        f"chunk bigint, doc_ids array<{kind.simpleString()}>, held array<boolean>, lengths binary, tokens binary, symbols binary, "
        "parts array<struct<bucket:int,words:binary,places:binary,counts:binary>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, chunk, kind = TaskContext.get().partitionId() << 24, Chunk(), None

        def row() -> pa.RecordBatch:
            part = pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("places", pa.binary()), ("counts", pa.binary())])
            fields = [("chunk", pa.int64()), ("doc_ids", pa.list_(kind)), ("held", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("tokens", pa.binary()), ("symbols", pa.binary()), ("parts", pa.list_(part))]
            return pa.RecordBatch.from_pylist([chunk.row(number, buckets)], pa.schema(fields))

        for batch in batches:
            kind = batch.schema.field(0).type
            sizes = np.cumsum(pc.binary_length(batch.column(2).fill_null("")).to_numpy())
            at = 0
            while at < batch.num_rows:
                room = CHUNK_BYTES - chunk.bytes + (sizes[at - 1] if at else 0)
                end = min(batch.num_rows, int(np.searchsorted(sizes, room)) + 1)
                own = batch.slice(at, end - at)
                chunk.add(own.column(0).to_pylist(), own.column(1).to_pylist(), own.column(2), int(sizes[end - 1] - (sizes[at - 1] if at else 0)))
                at = end
                if chunk.bytes >= CHUNK_BYTES:
                    yield row()
                    number, chunk = number + 1, Chunk()
                    release_memory()
        if chunk.doc_ids:
            yield row()
        chunk = Chunk()
        release_memory()

    given = docs.select("doc_id", held_out(F.col("doc_id"), 7).alias("held"), "text")
    return materialize(given.mapInArrow(run, ddl), "chunks")


_TOTALS = "array<struct<symbol:int,tokens:bigint,kinds:bigint>>"


def _sum_of(table: pa.Table, kind: type) -> dict[bytes, int]:
    """Counts of each word over the rows of a table."""
    total: dict[bytes, int] = {}
    for words, counts in zip(table.column("words"), table.column("counts")):
        for w, c in zip(words.as_py().split(b"\n"), np.frombuffer(counts.as_py(), kind).tolist()):
            total[w] = total.get(w, 0) + c
    return total


def _looked_up(words: pa.ChunkedArray, total: dict[bytes, int]) -> pa.Array:
    own = (w.as_py().split(b"\n") for w in words)
    return pa.array([np.fromiter(map(total.__getitem__, ws), np.int64, len(ws)).tobytes() for ws in own], pa.binary())


def _by_symbol(total: dict[bytes, int]) -> list[dict]:
    """Tokens and distinct words of each symbol."""
    seen = [(symbol_of(w), c) for w, c in total.items() if c]
    symbols = np.array([s for s, _ in seen], np.int64)
    tokens = np.bincount(symbols, [c for _, c in seen], SYMBOLS).astype(np.int64)
    kinds = np.bincount(symbols, minlength=SYMBOLS)
    return [{"symbol": s, "tokens": int(tokens[s]), "kinds": int(kinds[s])} for s in np.flatnonzero(kinds).tolist()]


def _totals_column(first: list[dict], many: int) -> pa.Array:
    entry = pa.list_(pa.struct([("symbol", pa.int32()), ("tokens", pa.int64()), ("kinds", pa.int64())]))
    return pa.array([first, *[[]] * (many - 1)], entry)


def count_words(chunks: DataFrame) -> DataFrame:
    """(chunk, places, counts, totals): training counts over all chunks; one row of each bucket has totals by symbol.

    A task sees one bucket's words of at most about FAN chunks at a time.  Up to FAN
    chunks a single step sums and looks up; beyond, sets of chunks are summed, then sets
    of sets until a bucket is one, and each set of chunks looks its words up in that sum.
    """
    parts = chunks.select("chunk", F.explode("parts").alias("p")).select("chunk", "p.*")
    many = -(-chunks.count() // FAN)
    if many > 1:
        return _count_in_levels(parts, many)

    def run(table: pa.Table) -> pa.Table:
        total = _sum_of(table, np.int32)
        back = _looked_up(table.column("words"), total)
        return pa.table({"chunk": table.column("chunk"), "places": table.column("places"), "counts": back, "totals": _totals_column(_by_symbol(total), len(back))})

    return materialize(parts.groupBy("bucket").applyInArrow(run, f"chunk bigint, places binary, counts binary, totals {_TOTALS}"), "word-counts")


def _count_in_levels(parts: DataFrame, many: int) -> DataFrame:
    def merge(table: pa.Table) -> pa.Table:
        total = _sum_of(table, np.int64)
        words, counts = b"\n".join(total), np.fromiter(total.values(), np.int64, len(total)).tobytes()
        row = {"bucket": table.column("bucket")[0].as_py(), "set": table.column("set")[0].as_py(), "words": words, "counts": counts}
        return pa.Table.from_pylist([row], pa.schema([("bucket", pa.int32()), ("set", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]))

    def widen(table: pa.Table) -> pa.Table:
        wide = [np.frombuffer(c.as_py(), np.int32).astype(np.int64).tobytes() for c in table.column("counts")]
        return merge(table.set_column(table.schema.get_field_index("counts"), "counts", pa.array(wide, pa.binary())))

    def look_up(table: pa.Table) -> pa.Table:
        own = pc.is_valid(table.column("chunk"))
        total, rows = _sum_of(table.filter(pc.invert(own)), np.int64), table.filter(own)
        back = _looked_up(rows.column("words"), total)
        return pa.table({"chunk": rows.column("chunk"), "places": rows.column("places"), "counts": back, "totals": _totals_column([], len(back)) if len(back) else pa.array([], _totals_column([], 1).type)})

    def tell(table: pa.Table) -> pa.Table:
        total = _sum_of(table, np.int64)
        return pa.table({"totals": _totals_column(_by_symbol(total), 1)})

    ddl = "bucket int, set bigint, words binary, counts binary"
    placed = parts.withColumn("set", F.pmod(F.xxhash64("chunk"), F.lit(many)))
    sums, left = materialize(placed.select("bucket", "set", "words", "counts").groupBy("bucket", "set").applyInArrow(widen, ddl), "word-sums"), many
    while left > 1:
        left = -(-left // FAN)
        merged = sums.withColumn("set", F.pmod("set", F.lit(left))).groupBy("bucket", "set").applyInArrow(merge, ddl)
        sums = materialize(merged, "word-sums")
    given = sums.select(F.lit(None).cast("bigint").alias("chunk"), "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(many - 1).cast("bigint"))).alias("set"), "words", F.lit(None).cast("binary").alias("places"), "counts")
    asked = placed.select("chunk", "bucket", "set", "words", "places", F.lit(None).cast("binary").alias("counts"))
    found = asked.unionByName(given).groupBy("bucket", "set").applyInArrow(look_up, f"chunk bigint, places binary, counts binary, totals {_TOTALS}")
    told = sums.groupBy("bucket").applyInArrow(tell, f"totals {_TOTALS}")
    none = [F.lit(None).cast(c).alias(n) for n, c in (("chunk", "bigint"), ("places", "binary"), ("counts", "binary"))]
    return materialize(found.unionByName(told.select(*none, "totals")), "word-counts")


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (states, symbols)


@dataclass(frozen=True)
class Tables:
    """A model for the recursions.  Emissions are relative to their mean over states, which keeps a few steps in range unscaled."""

    start: np.ndarray
    move: np.ndarray
    back: np.ndarray
    emit: np.ndarray  # (symbols, states)
    mean: np.ndarray  # log10, (symbols)

    @classmethod
    def of(cls, hmm: Hmm, kind: type) -> Tables:
        mean = hmm.emit.mean(axis=0)
        move, emit = hmm.move.astype(kind), (hmm.emit / mean).T
        return cls(hmm.start.astype(kind), move, np.ascontiguousarray(move.T), np.ascontiguousarray(emit, dtype=kind), np.log10(mean))


class Batch:
    """Sequences in step: longest first, laid out by time."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.active = len(lengths) - np.searchsorted(self.lengths[::-1], np.arange(self.lengths[0]), "right")
        self.offsets = np.concatenate([[0], np.cumsum(self.active)])
        self.symbols = np.empty(int(self.offsets[-1]), sequences[0].dtype)
        for rank, i in enumerate(self.order.tolist()):
            self.symbols[self.offsets[: lengths[i]] + rank] = sequences[i]

    def spans(self, tokens: int | None = None, begin: int = 0, end: int | None = None) -> list[tuple[int, int]]:
        """Runs of the steps of at most so many tokens (BATCH_TOKENS), but for a single step that is more."""
        out, end = [], len(self.active) if end is None else end
        while begin < end:
            stop = int(np.searchsorted(self.offsets, self.offsets[begin] + (tokens or BATCH_TOKENS), "right")) - 1
            out.append((begin, min(end, max(begin + 1, stop))))
            begin = out[-1][1]
        return out

    def forward(self, model: Tables, span: tuple[int, int], a: np.ndarray | None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """State chances of a span, and the scales of every SCALE_EVERY-th step; ``a`` has the chances before it."""
        begin, end = span
        first, active, ones = self.offsets[begin], self.active[begin:end].tolist(), np.ones(len(model.start), model.start.dtype)
        chances, scales, o = model.emit.take(self.symbols[first : self.offsets[end]], axis=0), {}, 0
        room = np.empty((active[0], len(ones)), ones.dtype)
        for t, n in enumerate(active, begin):
            own = chances[o : o + n]
            if a is None:
                own *= model.start
            else:
                own *= np.matmul(a[:n], model.move, out=room[:n])
            if t % SCALE_EVERY == 0:
                scales[t] = own @ ones
                own /= scales[t][:, None]
            a, o = own, o + n
        return chances, scales

    def _ending(self, chances: np.ndarray, span: tuple[int, int]) -> tuple[slice, np.ndarray]:
        """Ranks of sequences that end in a span, and the sums of their last chances."""
        begin, end = span
        ranks = np.arange(self.active[end] if end < len(self.active) else 0, self.active[begin])
        last = self.offsets[self.lengths[ranks] - 1] + ranks - self.offsets[begin]
        return slice(ranks[0], ranks[-1] + 1) if len(ranks) else slice(0, 0), chances[last].sum(axis=1)

    def likelihoods(self, hmm: Hmm) -> np.ndarray:
        """log10 likelihood of each sequence, in the order given."""
        found, a, model = np.zeros(len(self.order)), None, Tables.of(hmm, np.float64)
        for span in self.spans(STEP_TOKENS):
            chances, scales = self.forward(model, span, a)
            a = chances[-self.active[span[1] - 1] :].copy()
            for c in scales.values():
                found[: len(c)] += np.log10(c)
            ranks, sums = self._ending(chances, span)
            found[ranks] += np.log10(sums)
            mean = model.mean[self.symbols[self.offsets[span[0]] : self.offsets[span[1]]]]
            owner = np.arange(len(mean)) - np.repeat(self.offsets[span[0] : span[1]] - self.offsets[span[0]], self.active[span[0] : span[1]])
            found += np.bincount(owner, mean, len(found))
        out = np.empty(len(self.order))
        out[self.order] = found
        return out

    def expected(self, hmm: Hmm) -> np.ndarray:
        """Expected counts: starts, moves and emissions, one after the other."""
        return self.expected_and_likelihood(hmm)[0]

    def expected_and_likelihood(self, hmm: Hmm) -> tuple[np.ndarray, float]:
        """Expected counts, and the log10 likelihood of all sequences together."""
        model = Tables.of(hmm, np.float32)
        k, spans, before, likely = len(model.start), self.spans(), [None], 0.0
        for span in spans[:-1]:
            before.append(self.forward(model, span, before[-1])[0][-self.active[span[1] - 1] :].copy())
        moves, emits, b = np.zeros((k, k)), np.zeros((k, SYMBOLS)), np.empty((int(self.active[0]), k), model.start.dtype)
        for span, a in zip(reversed(spans), reversed(before)):
            first = self.offsets[span[0]]
            alpha, scales = self.forward(model, span, a)
            ranks, sums = self._ending(alpha, span)
            b[ranks] = 1
            likely += sum(float(np.log10(c).sum(dtype=np.float64)) for c in scales.values()) + float(np.log10(sums).sum(dtype=np.float64))
            for begin, end in reversed(self.spans(STEP_TOKENS, *span)):
                lo, hi = self.offsets[begin], self.offsets[end]
                symbols, active, o = self.symbols[lo:hi], self.active[begin:end].tolist(), int(hi - lo)
                likely += float(model.mean[symbols].sum())
                after = model.emit.take(symbols, axis=0)
                seen = np.empty_like(after)
                for t in range(end - 1, begin - 1, -1):
                    n = active[t - begin]
                    o -= n
                    own, bn = after[o : o + n], b[:n]
                    seen[o : o + n] = bn
                    own *= bn
                    if t in scales:
                        own /= scales[t][:, None]
                    np.matmul(own, model.back, out=bn)
                # Each token's chances sum to one, whatever single precision has lost on the way.
                seen *= alpha[lo - first : hi - first]
                share = 1 / seen.sum(axis=1, keepdims=True)
                seen *= share
                after *= share
                if begin > span[0]:
                    moves += alpha[self._previous(begin, end) - first].T @ after
                else:
                    own = self.active[begin]
                    moves += alpha[self._previous(begin + 1, end) - first].T @ after[own:]
                    if a is not None:
                        moves += a[:own].T @ after[:own]
                emits += np.stack([np.bincount(symbols, x, SYMBOLS) for x in np.ascontiguousarray(seen.T)])
        starts = seen[: self.active[0]].sum(axis=0, dtype=np.float64)  # the first steps come last
        return np.concatenate([starts, (moves * model.move).ravel(), emits.ravel()]), likely

    def _previous(self, begin: int, end: int) -> np.ndarray:
        """Places of the tokens before those of some steps, all of them after the first step."""
        return np.arange(self.offsets[begin], self.offsets[end]) - np.repeat(self.active[begin - 1 : end - 1], self.active[begin:end])


def _sequences(row: dict) -> list[np.ndarray]:
    tokens, lengths = np.frombuffer(row["tokens"], np.int32), np.frombuffer(row["lengths"], np.int32)
    symbols = np.frombuffer(row["symbols"], np.uint16)[tokens]
    return np.split(symbols, np.cumsum(lengths)[:-1])


def expected_counts(chunks: DataFrame, hmm: Hmm) -> tuple[np.ndarray, float]:
    """Expected counts over all training texts, and their log10 likelihood."""
    size = STATES + STATES**2 + STATES * SYMBOLS + 1  # the likelihood comes last

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                train = [s for s, held in zip(_sequences(row), row["held"]) if not held]
                if train:
                    counts, likely = Batch(train).expected_and_likelihood(hmm)
                    total[:-1] += counts
                    total[-1] += likely
                del row, train
                release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in table.column("total"))
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    needed = chunks.select("held", "lengths", "tokens", "symbols")
    sums = needed.mapInArrow(part, "part bigint, total binary")
    groups = max(1, int(needed.rdd.getNumPartitions() ** 0.5))
    found = sums.groupBy(F.pmod("part", F.lit(groups)).alias("set")).applyInArrow(add, "total binary").collect()
    total = sum((np.frombuffer(r.total) for r in found), np.zeros(size))
    return total[:-1], float(total[-1])


def estimate(counts: np.ndarray, background: np.ndarray) -> Hmm:
    """Model from expected counts, each row with a prior: even for states, the corpus' shares for symbols."""
    k = STATES
    start, move, emit = counts[:k] + 1.0, counts[k : k + k * k].reshape(k, k) + 1.0, counts[k + k * k :].reshape(k, SYMBOLS) + PRIOR * background
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def first_guess(background: np.ndarray, seed: int = 11) -> Hmm:
    """States that keep to themselves, each with the corpus' symbols in shares of its own."""
    rng = np.random.default_rng(seed)
    emit = background * rng.gamma(2.0, 0.5, (STATES, SYMBOLS))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    return Hmm(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=1, keepdims=True))


def train(chunks: DataFrame, background: np.ndarray) -> Hmm:
    hmm, before = first_guess(background), None
    while True:
        counts, likely = expected_counts(chunks, hmm)
        hmm = estimate(counts, background)
        if before is not None and likely - before <= TOLERANCE * abs(likely):
            return hmm
        before = likely


def buckets_for(docs: DataFrame) -> int:
    """Buckets of words: four for each partition of the input, up to 4096: a bucket of FAN chunks is then half a megabyte."""
    return min(4096, max(16, 4 * docs.rdd.getNumPartitions()))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = encode(docs, buckets_for(docs))
    counted = count_words(chunks)
    totals = counted.select(F.explode("totals").alias("t")).groupBy("t.symbol").agg(F.sum("t.tokens").alias("tokens"), F.sum("t.kinds").alias("kinds"))
    tokens, kinds = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
    for s, n, v in totals.collect():  # at most SYMBOLS rows
        tokens[s], kinds[s] = n, v
    all_tokens, all_kinds = int(tokens.sum()), int(kinds.sum())
    hmm = train(chunks, (tokens + 1) / (all_tokens + SYMBOLS))
    share = tokens + kinds + 1.0
    share[END] = tokens[END] + 1.0  # the end is the only token of its symbol
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.drop_columns(["doc_ids"]).to_pylist()[0]
                symbols, ids = np.frombuffer(row["symbols"], np.uint16), np.frombuffer(row["tokens"], np.int32)
                lengths = np.frombuffer(row["lengths"], np.int32)
                count = np.zeros(len(symbols), np.int64)
                for p in row["found"]:
                    count[np.frombuffer(p["places"], np.int32)] = np.frombuffer(p["counts"], np.int64)
                begins = np.cumsum(lengths) - lengths
                per_doc = lambda values: np.add.reduceat(values[ids], begins)
                base = per_doc(np.log10((count + 1) / (all_tokens + all_kinds + 1)))
                own = per_doc(np.log10((count + 1) / share[symbols]))
                chain = Batch(_sequences(row)).likelihoods(hmm)
                known = per_doc((count > 0).astype(np.int64))
                arrays = [one.column("doc_ids").flatten(), pa.array(row["held"], pa.bool_()), pa.array(lengths.astype(np.int64)), pa.array(known)]
                arrays += [pa.array(np.full(len(lengths), all_tokens, np.int64)), pa.array(base), pa.array(own + chain)]
                yield pa.RecordBatch.from_arrays(arrays, names)
                release_memory()

    back = counted.where("chunk is not null").groupBy(F.col("chunk").alias("of")).agg(F.collect_list(F.struct("places", "counts")).alias("found"))
    joined = chunks.select("chunk", "doc_ids", "held", "lengths", "tokens", "symbols").join(back, F.col("chunk") == F.col("of"))
    joined = joined.select("doc_ids", "held", "lengths", "tokens", "symbols", "found")
    return joined.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
