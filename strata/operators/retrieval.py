"""Lexical retrieval: chunks, weights, relevance, diversity, neighbours, checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import paths, text, vocab
from strata.functions.text import words
from strata.operators import ranges
from strata.operators.graph import KEY
from strata.storage import materialize

#: Line ends besides \n that split a text, and a last empty line that does not count.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

# The weights of the relevance score.
WEIGHTS = {"phrase": 0.07, "content": 0.16, "file": 0.03, "freq": 0.02, "role": 0.06, "symbol": 0.19, "definition": 0.12, "module": 0.20, "anchor": 0.15}
INTENT_WEIGHT = 0.14
INTENT_SCORES = {"architecture": (1.0, 0.4, 0.6), "implementation": (1.0, 0.2, 0.6), "symbol": (1.0, 0.4, 0.6), "concept": (0.5, 0.5, 0.5)}
DIVERSITY = 0.75


def lines(content: Column) -> Column:
    found = F.split(content, LINE_ENDS, -1)
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def chunks(files: DataFrame, size: int = 50) -> DataFrame:
    """(file, extension, start_line, end_line, content): fixed windows of lines; blank files give none.

    Further columns of ``files`` besides path and content are kept.
    """
    rest = [c for c in files.columns if c not in ("path", "content")]
    some = files.where(~F.coalesce("content", F.lit("")).rlike(r"\A\s*\z")).select(*rest, "path", lines(F.col("content")).alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(size))
    opened = some.select(*rest, "path", "lines", F.explode(starts).alias("start_line"))
    end = F.least(F.col("start_line") + size - 1, F.size("lines"))
    return opened.select(
        *rest,
        F.col("path").alias("file"),
        paths.suffix(F.col("path")).alias("extension"),
        "start_line",
        end.alias("end_line"),
        F.array_join(F.slice("lines", F.col("start_line"), F.lit(size)), "\n").alias("content"),
    )


def token_weights(rows: DataFrame) -> DataFrame:
    """(token, documents, idf) over content and file; rows without tokens do not count.  idf is ln((N+1)/(df+1))+1.

    Rows are counted as the holders of an empty token, so that texts are read once.
    """
    tokens = F.array_distinct(text.retrieval_tokens(F.concat_ws(" ", "content", "file")))
    held = text.let(tokens, lambda t: F.when(F.size(t) > 0, F.concat(F.array(F.lit("")), t)))
    counted = rows.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("documents"))
    counted = materialize(counted, "token-frequencies")
    frequency, total = counted.where("token != ''"), counted.where("token = ''").select(F.col("documents").alias("n"))  # a single row
    return frequency.crossJoin(F.broadcast(total)).select("token", "documents", (F.log((F.col("n") + 1) / (F.col("documents") + 1)) + 1).alias("idf"))


def _share(part: Column, whole: int) -> Column:
    return part / float(whole) if whole else F.lit(0.0)


def _symbol_names(symbols: Column) -> Column:
    return F.concat(F.coalesce(symbols["classes"], F.array()), F.coalesce(symbols["functions"], F.array()))


def _possible(rows: DataFrame, *wanted: list[str]) -> DataFrame:
    """Rows that may share a word with a question: every token is a stretch of lower-case text, or an alias of one."""
    needles = {w for words_ in wanted for w in words_}
    needles |= {k for k, aliases in vocab.CONCEPT_ALIASES.items() if needles & set(aliases)}
    if not needles:
        return rows.where(F.lit(False))
    found = F.lit(False)
    for w in sorted(needles):
        found = found | F.lower("content").contains(w) | F.lower("file").contains(w)
    return rows.where(found | F.col("symbols").isNotNull() if "symbols" in rows.columns else found)


def score(rows: DataFrame, query: str, idf: dict[str, float] | None = None) -> DataFrame:
    """``rows`` of chunks with retrieval_score for a query; rows that share nothing with it are dropped.

    Rows whose letters hold none of the words that could count are passed over
    before any is cut into tokens; the tokens of the others are written, as
    every term of the score reads them, and so is the result.

    ``idf`` holds weights of the query's tokens; one stands for those it lacks.
    A ``symbols`` column (classes and functions with name and lines) is used if there is one.
    """
    spark = rows.sparkSession
    asked = spark.range(1).select(text.retrieval_tokens(F.lit(query)).alias("q"), text.anchors(F.lit(query)).alias("a"), text.query_intent(F.lit(query)).alias("i")).first()
    ordered, anchors, intent = list(asked.q), list(asked.a), asked.i
    q = list(dict.fromkeys(ordered))
    related = list(spark.range(1).select(text.concepts(words(q)).alias("c")).first().c) if q else []
    weight = {t: (1.0 if idf is None else idf.get(t, 1.0)) for t in q}
    in_c = lambda t: F.array_contains("_c", t).cast("double")
    total = sum(weight.values())
    zero = F.lit(0.0)
    content = sum((in_c(t) * w for t, w in weight.items()), zero) / total if total else zero
    freq = F.least(F.size(F.filter("_c", lambda x: x.isin(q))) / 10.0, F.lit(1.0)) if q else zero
    in_file = _share(F.size(F.array_intersect(text.retrieval_tokens(F.col("file")), words(q))), len(q))
    phrase = F.array_join("_c", " ").contains(" ".join(ordered)).cast("double") if ordered else zero
    module = F.least(F.lit(1.0), _share(F.size(F.array_intersect("_m", words(related))), len(related)))
    if "symbols" in rows.columns:
        every = _symbol_names(F.col("symbols"))
        names = text.concepts(text.retrieval_tokens(F.array_join(F.transform(every, lambda s: s["name"]), " ")))
        match = lambda s: F.arrays_overlap(text.concepts(text.retrieval_tokens(s["name"])), words(q)) & s["start_line"].between(F.col("start_line"), F.col("end_line"))
        starts = F.exists(every, match) if q else F.lit(False)
    else:
        names, starts = words([]), F.lit(False)
    symbol = F.least(F.lit(1.0), _share(F.size(F.array_intersect("_s", words(q))), len(q)) + F.when(F.col("_starts"), 0.5).otherwise(0.0))
    definition = F.when(F.col("_starts"), 1.0).otherwise(0.0) if intent == "symbol" else zero

    def hit(column: str) -> Column:
        return _share(F.size(F.array_intersect(F.array_distinct(column), words(anchors))), len(anchors))

    anchor = (
        F.when(hit("_m") > 0, F.least(F.lit(1.0), 0.85 + 0.15 * hit("_m")))
        .when(hit("_s") > 0, F.least(F.lit(0.85), 0.65 + 0.20 * hit("_s")))
        .when(hit("_c") > 0, F.least(F.lit(0.45), 0.25 + 0.20 * hit("_c")))
        .otherwise(0.0)
    )
    prepared = _possible(rows, q, related, anchors).withColumns({"_c": text.retrieval_tokens(F.col("content")), "_m": text.module_tokens(F.col("file")), "_s": names, "_starts": starts, "_role": paths.retrieval_role(F.col("file"))})
    prepared = materialize(prepared, "tokens")
    role = F.when(F.col("_role") == "production", 1.0).when(F.col("_role") == "test", 0.0).otherwise(0.5)
    parts = {"phrase": phrase, "content": content, "file": in_file, "freq": freq, "symbol": symbol, "definition": definition, "module": module, "anchor": anchor}
    some = sum(parts.values(), zero) > 0
    base = F.round(sum((F.lit(WEIGHTS[k]) * v for k, v in parts.items()), F.lit(WEIGHTS["role"]) * role), 6)
    production, test, other = INTENT_SCORES[intent]
    suits = F.when(F.col("_role") == "production", production).when(F.col("_role") == "test", test).otherwise(other)
    is_anchor = F.arrays_overlap("_m", words(anchors)) | F.arrays_overlap("_s", words(anchors)) if anchors else F.lit(False)
    scored = prepared.where(some).withColumn("_base", base).where("_base > 0")
    scored = scored.withColumn("retrieval_score", F.round(F.col("_base") + (suits - 0.5) * INTENT_WEIGHT, 6)).withColumn("is_primary", is_anchor).withColumn("role", F.col("_role"))
    return materialize(scored.drop("_c", "_m", "_s", "_starts", "_role", "_base"), "scored")


def keep_strong(scored: DataFrame, intent: str) -> DataFrame:
    """Primary rows; where there are any, others only from production files and near the best primary score."""
    best = scored.agg(F.max(F.when(F.col("is_primary"), F.col("retrieval_score"))).alias("best"))  # a single row
    rows = scored.crossJoin(F.broadcast(best))
    near = (F.col("role") == "production") & (F.col("retrieval_score") >= F.greatest(F.lit(0.58), 0.78 * F.col("best")))
    keep = F.col("best").isNull() | F.col("is_primary") | near
    if intent == "implementation":
        keep = keep & (F.col("best").isNull() | (F.col("role") != "test"))
    return rows.where(keep).withColumn("retrieval_role", F.when(F.col("is_primary") | F.col("best").isNull(), "primary").otherwise("supporting")).drop("best")


def order_of(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("retrieval_score"), "file", "start_line")


def candidates(scored: DataFrame, k: int) -> DataFrame:
    """The best 4k rows, in order."""
    return order_of(scored).limit(4 * k)


def diverse(rows: DataFrame, k: int, weight: float = DIVERSITY) -> DataFrame:
    """k rows of at most a few dozen candidates by maximal marginal relevance.

    Each step takes the largest (weighted score less weighted likeness to what
    is taken, score, file, start line); the result is in retrieval order.
    ``rows`` must be bounded, as ``candidates`` gives them.
    """
    marked = rows.withColumn("_tokens", F.array_distinct(text.retrieval_tokens(F.concat_ws(" ", "content", "file"))))
    schema = rows.schema

    return order_of(marked.withColumn("_pool", F.lit(0)).groupBy("_pool").applyInPandas(_mmr(k, weight, schema.names), schema))


def _mmr(k: int, weight: float, names: list[str]):
    def run(pool: pd.DataFrame) -> pd.DataFrame:
        tokens = [frozenset(t) for t in pool["_tokens"]]
        scores, keys = pool["retrieval_score"].tolist(), list(zip(pool["retrieval_score"], pool["file"], pool["start_line"]))
        left, taken, likeness = set(range(len(pool))), [], [0.0] * len(pool)
        while left and len(taken) < k:
            for i in left if taken else ():
                a, b = tokens[taken[-1]], tokens[i]
                likeness[i] = max(likeness[i], len(a & b) / len(a | b) if a and b else 0.0)
            best = max(left, key=lambda i: (weight * scores[i] - (1 - weight) * likeness[i] if taken else scores[i], *keys[i]))
            taken.append(best)
            left.discard(best)
        return pool.iloc[taken][names]

    return run


def retrieve(rows: DataFrame, query: str, k: int = 5, idf: dict[str, float] | None = None) -> DataFrame:
    """The k rows for a query: scored, cut to the strong ones, made diverse."""
    intent = rows.sparkSession.range(1).select(text.query_intent(F.lit(query))).first()[0]
    return diverse(candidates(keep_strong(score(rows, query, idf), intent), k), k)


def neighbours(retrieved: DataFrame, rows: DataFrame, distance: int = 1) -> DataFrame:
    """Retrieved chunks and those up to ``distance`` places away in their files, at half their score.

    ``retrieved`` has file, start_line and retrieval_score; a chunk keeps its best standing.
    """
    place = F.row_number().over(Window.partitionBy("file").orderBy("start_line", "end_line"))
    files = retrieved.select("file").distinct()
    placed = rows.join(files, "file", "left_semi").select("file", "start_line", "end_line", place.alias("place"))
    own = retrieved.select("file", "start_line", "retrieval_score").join(placed, ["file", "start_line"]).select("file", F.col("place").alias("at"), "retrieval_score")
    near = placed.join(own, "file").where(F.abs(F.col("place") - F.col("at")) <= distance)
    is_own = F.col("place") == F.col("at")
    value = F.when(is_own, F.col("retrieval_score")).otherwise(F.round(0.5 * F.col("retrieval_score"), 6))
    best = near.groupBy("file", "start_line", "end_line").agg(F.max(F.struct(is_own.alias("own"), value.alias("score"))).alias("best"))
    return best.select("file", "start_line", "end_line", F.col("best.score").alias("retrieval_score"), F.when(F.col("best.own"), "retrieved").otherwise("neighbor").alias("context_role"))


def contained(evidence: DataFrame, rows: DataFrame) -> DataFrame:
    """Evidence whose line range lies within a chunk of the same file."""
    return ranges.within(evidence, rows)


def overlapping(evidence: DataFrame, rows: DataFrame) -> DataFrame:
    """(evidence columns, chunk_start, chunk_end) of chunks that an evidence range meets; without lines the file is enough."""
    c = rows.select(paths.backslashed(F.col("file")).alias("_file"), F.col("start_line").alias("chunk_start"), F.col("end_line").alias("chunk_end"))
    named = evidence.withColumn("_own", paths.backslashed(F.col("file")))
    whole = F.col("start_line").isNull() | F.col("end_line").isNull()
    met = ranges.meeting(named.where(~whole), c, ("_own", "start_line", "end_line"), ("_file", "chunk_start", "chunk_end"))
    lineless = named.where(whole).join(c, F.col("_own") == F.col("_file"))
    return met.unionByName(lineless).drop("_file", "_own").distinct()


def attach_symbols(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks with the classes and functions whose lines they meet; symbols has file, kind, name, start_line, end_line.

    Where both have a repo_id, files of different repositories are different files.
    """
    keys = [KEY] if KEY in rows.columns and KEY in symbols.columns else []
    own = F.struct(*keys, "file")
    s = symbols.select(own.alias("_file"), "kind", "name", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    met = ranges.meeting(rows.select(*keys, "file", own.alias("_own"), "start_line", "end_line"), s, ("_own", "start_line", "end_line"), ("_file", "s", "e"))
    item = F.struct(F.col("s").alias("start_line"), "name", F.col("e").alias("end_line"))
    names = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item))), lambda x: F.struct(x["name"].alias("name"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line")))
    grouped = met.groupBy(*keys, "file", "start_line").agg(F.struct(names("class").alias("classes"), names("function").alias("functions")).alias("symbols"))
    return rows.join(grouped, [*keys, "file", "start_line"], "left")


def evaluation(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(query, precision, recall, hit_rate) of found against expected (query, file) rows."""
    f = found.groupBy("query").agg(F.collect_set("file").alias("found"))
    e = expected.groupBy("query").agg(F.collect_set("file").alias("expected"))
    none = F.array().cast("array<string>")
    both = e.join(f, "query", "left").select("query", "expected", F.coalesce("found", none).alias("found"))
    hits = F.size(F.array_intersect("found", "expected"))
    return both.select("query", F.when(F.size("found") > 0, hits / F.size("found")).otherwise(0.0).alias("precision"), (hits / F.size("expected")).alias("recall"), (hits > 0).cast("double").alias("hit_rate"))
