"""Personal data by bootstrapped contextual extraction (operator 4), in DataFrame functions only.

Regular expressions find the base kinds: email, ip, card, phone.  They seed a
graph of lexical patterns and instances.  Instances are runs of one to four
words that look like identifiers, shorn of marks at their edges.  Patterns are
what stands around an instance and what it looks like: the two words before, the
word before or after (alone, together, or with the shape), and the shape, its
digits and letters made alike.

A pattern's confidence in a kind is the shrunken mean of its instances' scores
for that kind, an instance's score the noisy-or of the confident patterns it has;
base findings stay at one.  Rounds of this let new instances vouch for new
patterns.  Identifiers clear of all base findings that have a confident pattern
become findings of kind ``context``; those that overlap become one.

Patterns and instances are aggregated to one edge each before any join, so a
phrase that a third of the documents share is one pattern.  Arrays grow in blocks
of about the square root of their size, as every append copies one: a text of n
identifiers takes n ** 1.5 steps, not n ** 2.

Offsets are code points, ends exclusive.  Null text counts as empty and has no
findings.  Repeated rows and null doc_ids get a result row each; equal texts get
equal findings; repeats of a value count once for a pattern.  Ties need no order:
a pattern counts or does not.  An empty table gives an empty result.  Columns
besides doc_id and text, whatever their names, play no part and are kept by
``redact``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.storage import materialize

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  Possessive runs and look-behinds only keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
SPACE = r"\x20\x09-\x0D"
MARKED = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"  # a word with a digit or an at-sign
EDGES = "\"'`.,;:!?()[]{}<>|*#$&=-_/\\"

MOST_WORDS = 4
SIZE = (5, 64)  # of an identifier
NEAR = 32  # of a word beside an identifier, so many characters count, the nearest ones
LEAST_SUPPORT = 5
LEAST_CONFIDENCE = 0.8
ROUNDS = 3
_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_SEEN = "array<struct<start:bigint,end:bigint,value:string,kind:string,patterns:array<string>>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Array of what ``combine`` makes, from zero, of the numbers up to each one."""

    def of(v: Column) -> Column:
        many = F.greatest(F.size(v), F.lit(1))
        width = F.ceil(F.sqrt(many)).cast("int")

        def block(state: Column, start: Column) -> Column:
            grown = F.aggregate(F.slice(v, start, width), F.array(state["last"]), lambda done, x: F.concat(done, F.array(combine(F.element_at(done, -1), x))))
            return _let(grown, lambda g: F.struct(F.element_at(g, -1).alias("last"), F.concat(state["parts"], F.array(F.slice(g, F.lit(2), width))).alias("parts")))

        first = F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast("array<array<bigint>>").alias("parts"))
        return F.aggregate(F.sequence(F.lit(1), many, width), first, block, lambda s: F.flatten(s["parts"]))

    return _let(values, of)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right counts doubled."""
    reverse = F.reverse(digits)
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def value(i: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _valid_card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))


BASE = {
    "email": (EMAIL, "@", lambda v: F.lit(True)),
    "ip": (IP, r"[0-9]\.[0-9]", lambda v: v.rlike(IP_PARTS)),
    "card": (CARD, r"[0-9]", _valid_card),
    "phone": (PHONE, r"\+[0-9]", lambda v: F.length(_digits(v)).between(9, 15)),
}


def _hits(text: Column, pattern: str) -> Column:
    """Array of (hit, before, after, start, end): each match of a pattern with what stands between it and its neighbours."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def place(b: Column) -> Column:
        sizes = F.zip_with(b["gaps"], b["hits"], lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("bigint"))
        return _let(_scan(sizes, lambda x, y: x + y), lambda ends: F.transform(b["hits"], lambda h, i: one(b, ends, h, i)))

    def one(b: Column, ends: Column, h: Column, i: Column) -> Column:
        end = F.get(ends, i)
        return F.struct(h.alias("hit"), F.get(b["gaps"], i).alias("before"), F.get(b["gaps"], i + 1).alias("after"), (end - F.length(h)).alias("start"), end.alias("end"))

    return _let(both, place)


def matches(text: Column, kind: str) -> Column:
    """Array of (kind, start, end) of one base kind, in order."""
    pattern, hint, valid = BASE[kind]
    good = F.filter(_hits(text, pattern), lambda x: valid(x["hit"]))
    spans = F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.when(text.rlike(hint), spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def kind_of(value: Column) -> Column:
    """The base kind that all of a value is; null if none."""
    whole = lambda k: value.rlike(f"^(?:{BASE[k][0]})$") & BASE[k][2](value)
    out = F.when(whole(KINDS[0]), KINDS[0])
    for k in KINDS[1:]:
        out = out.when(whole(k), k)
    return out


def shape_of(value: Column) -> Column:
    """Digits as 9, runs of letters as a letter."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Z]+", "A"), "[a-z]+", "a")


def patterns_of(value: Column, before: Column, after: Column) -> Column:
    """Patterns of an identifier between two stretches of text."""
    word = rf"([^{SPACE}]{{1,{NEAR}}})"
    near, far = F.right(before, F.lit(3 * NEAR)), F.left(after, F.lit(3 * NEAR))
    around = F.struct(
        shape_of(value).alias("shape"),
        F.lower(F.regexp_extract(near, rf"{word}[{SPACE}]*$", 1)).alias("l1"),
        F.lower(F.regexp_extract(near, rf"{word}[{SPACE}]+[^{SPACE}]{{1,{NEAR}}}[{SPACE}]*$", 1)).alias("l2"),
        F.lower(F.regexp_extract(far, rf"^[{SPACE}]*{word}", 1)).alias("r1"),
    )

    def of(a: Column) -> Column:
        some = lambda needs, *parts: F.when(needs, F.concat_ws(" ", *parts))
        left, right, two = a["l1"] != "", a["r1"] != "", a["l2"] != ""
        found = F.array(
            F.concat_ws(" ", F.lit("shape"), a["shape"]),
            some(left, F.lit("before"), a["l1"]),
            some(right, F.lit("after"), a["r1"]),
            some(left & two, F.lit("before2"), a["l2"], a["l1"]),
            some(left & right, F.lit("between"), a["l1"], a["r1"]),
            some(left, F.lit("before+shape"), a["l1"], a["shape"]),
            some(right, F.lit("after+shape"), a["r1"], a["shape"]),
        )
        return F.filter(found, lambda p: p.isNotNull())

    return _let(around, of)


def _runs(text: Column) -> Column:
    """Array of (start, end, value, before, after) of runs of words that look like identifiers."""

    def windows(words: Column) -> Column:
        def ending(x: Column, i: Column) -> Column:
            def of(k: Column) -> Column:
                part = F.slice(words, i + 1, k)
                close = (F.size(part) == k) & F.forall(F.slice(part, 2, MOST_WORDS), lambda y: y["before"] == " ")
                raw = F.array_join(F.transform(part, lambda y: y["hit"]), " ")
                return F.when(close, F.struct(raw.alias("raw"), x["start"].alias("at"), x["before"].alias("before"), F.element_at(part, -1)["after"].alias("after")))

            return F.transform(F.sequence(F.lit(1), F.lit(MOST_WORDS)), of)

        return F.filter(F.flatten(F.transform(words, ending)), lambda w: w.isNotNull())

    def shorn(w: Column) -> Column:
        left = F.ltrim(w["raw"], F.lit(EDGES))
        start, core = w["at"] + F.length(w["raw"]) - F.length(left), F.rtrim(left, F.lit(EDGES))
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"), w["before"].alias("before"), w["after"].alias("after"))

    def like(w: Column) -> Column:
        return F.length(w["value"]).between(*SIZE) & ((F.length(_digits(w["value"])) >= 4) | w["value"].contains("@"))

    return F.filter(F.transform(_let(_hits(text, MARKED), windows), shorn), like)


def candidates(text: Column, base: Column) -> Column:
    """Array of (start, end, value, kind, patterns): the seeds, by kind, and with no kind what lies clear of all base findings.

    Findings and runs are sorted together so that one pass tells how far the
    findings that begin before a run's end reach.
    """

    def meet(runs: Column) -> Column:
        found = F.transform(base, lambda b: F.struct((2 * b["start"]).alias("place"), b["end"].alias("reach"), F.lit(-1).alias("run")))
        asked = F.transform(runs, lambda r, i: F.struct((2 * r["end"] - 1).alias("place"), F.lit(0).cast("bigint").alias("reach"), i.alias("run")))
        return _let(F.array_sort(F.concat(found, asked)), lambda order: told(runs, order))

    def told(runs: Column, order: Column) -> Column:
        reach = _scan(F.transform(order, lambda o: o["reach"]), F.greatest)
        each = F.filter(F.zip_with(order, reach, lambda o, r: F.struct(o["run"].alias("run"), r.alias("reach"))), lambda o: o["run"] >= 0)
        return F.filter(F.transform(each, lambda o: _let(F.get(runs, o["run"]), lambda r: seen(r, o["reach"] > r["start"]))), lambda w: w.isNotNull())

    def seen(r: Column, touches: Column) -> Column:
        kind = F.when(touches, kind_of(r["value"]))
        out = F.struct(r["start"].alias("start"), r["end"].alias("end"), r["value"].alias("value"), kind.alias("kind"), patterns_of(r["value"], r["before"], r["after"]).alias("patterns"))
        return _let(out, lambda w: F.when(~touches | w["kind"].isNotNull(), w))

    return F.when(text.rlike("[0-9@]"), _let(_runs(text), meet).cast(_SEEN)).otherwise(F.array().cast(_SEEN))


def _base(text: Column) -> Column:
    return F.concat(*(matches(text, k) for k in KINDS))


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` with _base (all base spans) and _seen (candidates), written once without the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    based = docs.select(*keep, text.alias("_text"), _base(text).alias("_base"))
    return materialize(based.select(*keep, "_base", candidates(F.col("_text"), F.col("_base")).alias("_seen")), "identifiers")


def confident_patterns(scanned: DataFrame, support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern) rows whose confidence and support for some kind suffice after the rounds."""
    words = scanned.select(F.explode("_seen").alias("w")).select("w.value", "w.kind", F.explode("w.patterns").alias("pattern"))
    edges = words.groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    # A pattern's support is at most its number of instances.
    often = edges.groupBy(F.col("pattern").alias("often")).agg(F.count("*").alias("n")).where(F.col("n") >= support)
    edges = materialize(edges.join(often, F.col("pattern") == F.col("often")).select("pattern", "value", "kind", "n"), "pattern-edges")
    seeds = edges.where("kind is not null").select(F.col("value").alias("of"), F.col("kind").alias("as"), F.lit(1.0).alias("score")).distinct()
    scores, plain = seeds, edges.where("kind is null").select("pattern", "value")
    for i in range(rounds):
        sums = edges.select("pattern", "value", "n").join(scores, F.col("value") == F.col("of")).groupBy("pattern", "n", "as").agg(F.sum("score").alias("support"))
        sure = sums.where((F.col("support") >= support) & (F.col("support") / (F.col("n") + 1) >= confidence))
        if i == rounds - 1:
            return sure.select("pattern").distinct()
        vote = sure.select(F.col("pattern").alias("sure"), "as", F.log(1 - F.least(F.col("support") / (F.col("n") + 1), F.lit(0.999))).alias("doubt"))
        rated = plain.join(vote, F.col("pattern") == F.col("sure")).groupBy(F.col("value").alias("of"), "as").agg((1 - F.exp(F.sum("doubt"))).alias("score"))
        scores = materialize(seeds.union(rated).groupBy("of", "as").agg(F.max("score").alias("score")), "instance-scores")
    raise ValueError("at least one round is needed")


def _discovered(scanned: DataFrame, key: str, **limits) -> DataFrame:
    """(_at, _context): by key, the spans that confident patterns discover."""
    patterns = confident_patterns(scanned, **limits).select(F.col("pattern").alias("sure"))
    words = scanned.select(F.col(key).alias("_at"), F.explode("_seen").alias("w")).where("w.kind is null").select("_at", "w.start", "w.end", F.explode("w.patterns").alias("pattern"))
    hits = words.join(patterns, F.col("pattern") == F.col("sure"), "left_semi").select("_at", "start", "end").distinct()
    ordered = Window.partitionBy("_at").orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("opens", F.when(reach > F.col("start"), 0).otherwise(1))
    merged = hits.withColumn("group", F.sum("opens").over(ordered)).groupBy("_at", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    span = F.struct(F.lit("context").alias("kind"), "start", "end")
    return merged.groupBy("_at").agg(F.sort_array(F.collect_list(span)).cast(_SPAN).alias("_context"))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and spans of every document."""
    row, none = "_row", F.array().cast(_SPAN)
    scanned = scan(docs.select("doc_id", "text", F.monotonically_increasing_id().alias(row)), "doc_id", row)
    # Only rows that have candidates take part in the join.
    open_ones = F.exists("_seen", lambda w: w["kind"].isNull())
    joined = scanned.where(open_ones).select("doc_id", row, "_base").join(_discovered(scanned, row, **limits), F.col(row) == F.col("_at"), "left")
    rows = scanned.where(~open_ones).select("doc_id", "_base", none.alias("_context")).union(joined.select("doc_id", "_base", F.coalesce("_context", none)))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(_text_of(F.col("_base")), 256).alias("base_sha256"),
        _text_of(F.concat("_base", "_context")).alias("spans"),
    )


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first, or longer, names all.

    The text is cut for blocks of spans first, so that no cut runs through all of it.
    """

    def cut(sorted_spans: Column) -> Column:
        return _let(_scan(F.transform(sorted_spans, lambda s: s["end"]), F.greatest), lambda reach: joined(sorted_spans, reach))

    def joined(given: Column, reach: Column) -> Column:
        placed = F.transform(given, lambda s, i: F.struct(F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(reach, i - 1)).alias("from"), s["start"].alias("to"), F.upper(s["kind"]).alias("label")))
        rest = F.substring(text, (F.element_at(reach, -1) + 1).cast("int"), F.length(text))
        return F.concat(_let(F.filter(placed, lambda p: p["from"] <= p["to"]), blocks), rest)

    def blocks(pieces: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(1), F.size(pieces), width), lambda s: _let(F.slice(pieces, s, width), block)), "")

    def block(own: Column) -> Column:
        first, last = F.element_at(own, 1)["from"], F.element_at(own, -1)["to"]

        def piece(part: Column, p: Column) -> Column:
            gap = F.substring(part, (p["from"] - first + 1).cast("int"), (p["to"] - p["from"]).cast("int"))
            return F.concat(gap, F.lit("["), p["label"], F.lit("]"))

        return _let(F.substring(text, (first + 1).cast("int"), (last - first).cast("int")), lambda part: F.array_join(F.transform(own, lambda p: piece(part, p)), ""))

    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.when(F.size(spans) > 0, _let(in_order, cut)).otherwise(text)


def redact(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by its kind in brackets; null text stays null.

    Texts are not stored with what the scan sees in them.  A text's digest finds
    its findings again, and only texts with a digit or an at-sign, which all
    findings have, are digested and moved.
    """
    names, key, none = docs.columns, "_strata_text_key", F.array().cast(_SPAN)
    marked = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    keyed = docs.where(marked).withColumn(key, F.sha2("text", 256))
    found = _discovered(scan(keyed.select("text", key), key), key, **limits).select(F.col("_at").alias("_strata_at"), F.col("_context").alias("_strata_context"))
    rows = keyed.join(found, F.col(key) == F.col("_strata_at"), "left")
    spans = F.concat(_base(F.col("text")), F.coalesce("_strata_context", none))
    clean = rows.select(*(replaced(F.col("text"), spans).alias(c) if c == "text" else c for c in names))
    return docs.where(~marked).unionByName(clean)
