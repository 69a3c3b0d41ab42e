"""Queries on chunks, retrieval, questions, claims and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import paths, text, vocab
from strata.operators import claims as claim_ops
from strata.operators import evidence, retrieval, selection
from strata.queries import tables as t
from strata.queries.structure import _with
from strata.queries.tables import sql, tokens_sql
from strata.sources import pyast
from strata.streaming import admission

QUESTION = "class idiot clown worthless trash"
K = 5
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.chunks(t.files(spark, sf), t.CHUNK_LINES)


# --- chunks and tokens ---------------------------------------------------------------


@query(sql("SELECT file, start_line, end_line, length(content) AS chars, md5(content) AS digest FROM chunks", "chunks"))
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf)
    return c.select("file", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("digest"))


@query(sql(f"SELECT doc_id, len(tok) AS tokens, len(list_distinct(tok)) AS distinct_tokens, md5(array_to_string(tok, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS tok FROM documents)"))
def tokenize_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = t.read(spark, sf, "documents").select("doc_id", text.retrieval_tokens(F.col("text")).alias("tok"))
    return d.select("doc_id", F.size("tok").cast("bigint").alias("tokens"), F.size(F.array_distinct("tok")).cast("bigint").alias("distinct_tokens"), F.md5(F.array_join("tok", " ")).alias("digest"))


_IDF = f"""tk AS (SELECT list_distinct({tokens_sql("content || ' ' || file")}) AS tok FROM chunks),
    n AS (SELECT count(*) AS n FROM tk WHERE len(tok) > 0),
    idf AS (SELECT token, count(*) AS documents, ln((any_value(n) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest(tok) AS token FROM tk), n GROUP BY token)"""


@query(_with("SELECT token, documents, round(idf, 6) AS idf FROM idf", _IDF, "chunks"))
def idf_weights(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.token_weights(_chunks(spark, sf)).select("token", "documents", F.round("idf", 6).alias("idf"))


def _values(words: list[str]) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_INTENT = (
    f"CASE WHEN len(tok) = 0 THEN 'concept' WHEN list_has_any(tok, {_values(vocab.SYMBOL_WORDS)}) THEN 'symbol' WHEN list_has_any(tok, {_values(vocab.ARCHITECTURE_WORDS)}) THEN 'architecture' "
    f"WHEN list_has_any(tok, {_values(vocab.IMPLEMENTATION_WORDS)}) THEN 'implementation' WHEN len(list_distinct(tok)) = 1 THEN 'symbol' ELSE 'concept' END"
)


@query(sql(f"SELECT conv_id, turn, {_INTENT} AS intent FROM (SELECT conv_id, turn, {tokens_sql('query')} AS tok FROM questions)", "questions"))
def query_intent(spark: SparkSession, sf: str) -> DataFrame:
    return t.questions(spark, sf).select("conv_id", "turn", text.query_intent(F.col("query")).alias("intent"))


# --- relevance -----------------------------------------------------------------------

_Q = QUESTION.split()
_HIT = lambda words, c: f"len(list_intersect({_values(words)}, {c}))"
_ROLE = (
    "CASE WHEN len(list_filter(string_split(lower(file), '/'), lambda p: p = 'test' OR p LIKE 'test\\_%' ESCAPE '\\' OR p LIKE '%\\_test.py' ESCAPE '\\')) > 0 THEN 'test' "
    "WHEN list_has_any(string_split(lower(file), '/'), ['src', 'lib', 'app']) THEN 'production' ELSE 'neutral' END"
)
_N = float(len(_Q))
_SCORE = f"""tok AS (SELECT file, start_line, end_line, {tokens_sql('content')} AS c, {tokens_sql('file')} AS f, {tokens_sql("regexp_replace(split_part(file, '/', -1), '.py$', '')")} AS m, {_ROLE} AS role FROM chunks),
    sc AS (SELECT *, (contains(array_to_string(c, ' '), '{QUESTION}'))::INT::DOUBLE AS s_phrase, {_HIT(_Q, 'list_distinct(c)')} / {_N}::DOUBLE AS s_content, {_HIT(_Q, 'list_distinct(f)')} / {_N}::DOUBLE AS s_file,
        least(len(list_filter(c, lambda x: list_contains({_values(_Q)}, x))) / 10.0::DOUBLE, 1.0) AS s_freq, least(1.0, {_HIT(_Q, 'list_distinct(m)')} / {_N}::DOUBLE) AS s_module,
        CASE WHEN {_HIT(_Q, 'list_distinct(m)')} > 0 THEN least(1.0, 0.85 + 0.15 * ({_HIT(_Q, 'list_distinct(m)')} / {_N}::DOUBLE)) WHEN {_HIT(_Q, 'list_distinct(c)')} > 0 THEN least(0.45, 0.25 + 0.20 * ({_HIT(_Q, 'list_distinct(c)')} / {_N}::DOUBLE)) ELSE 0.0 END AS s_anchor,
        CASE role WHEN 'production' THEN 1.0 WHEN 'test' THEN 0.0 ELSE 0.5 END AS s_role FROM tok),
    ba AS (SELECT *, round((0.06 * s_role + 0.07 * s_phrase + 0.16 * s_content + 0.03 * s_file + 0.02 * s_freq + 0.20 * s_module + 0.15 * s_anchor)::DOUBLE, 6) AS base FROM sc WHERE s_phrase + s_content + s_file + s_freq + s_module + s_anchor > 0),
    scored AS (SELECT file, start_line, end_line, role, len(list_intersect({_values(_Q)}, list_distinct(m))) > 0 AS is_primary,
        round((base + (CASE role WHEN 'production' THEN 1.0 WHEN 'test' THEN 0.4 ELSE 0.6 END - 0.5) * 0.14)::DOUBLE, 6) AS retrieval_score FROM ba WHERE base > 0)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.score(_chunks(spark, sf), QUESTION)


@query(_with("SELECT file, start_line, retrieval_score, role FROM scored", _SCORE, "chunks"))
def score_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("file", F.col("start_line").cast("bigint").alias("start_line"), "retrieval_score", "role")


_STRONG = """best AS (SELECT max(CASE WHEN is_primary THEN retrieval_score END) AS b FROM scored),
    strong AS (SELECT scored.* FROM scored, best WHERE b IS NULL OR is_primary OR (role = 'production' AND retrieval_score >= greatest(0.58, 0.78 * b))),
    top AS (SELECT * FROM strong ORDER BY retrieval_score DESC, file, start_line LIMIT 20)"""


def _top(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.candidates(retrieval.keep_strong(_scored(spark, sf), "symbol"), K)


@query(_with("SELECT file, start_line, retrieval_score FROM top", _SCORE + ", " + _STRONG, "chunks"))
def retrieve_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf).select("file", F.col("start_line").cast("bigint").alias("start_line"), "retrieval_score")


@query()
def mmr_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.diverse(_top(spark, sf), K).select("file", F.col("start_line").cast("bigint").alias("start_line"), "retrieval_score", "retrieval_role")


@query(
    _with(
        """SELECT file, start_line, end_line, retrieval_score, CASE WHEN own THEN 'retrieved' ELSE 'neighbor' END AS context_role FROM (
        SELECT p.file, p.start_line, p.end_line, o.place = p.place AS own, CASE WHEN o.place = p.place THEN o.retrieval_score ELSE round(0.5 * o.retrieval_score, 6) END AS retrieval_score,
        row_number() OVER (PARTITION BY p.file, p.start_line ORDER BY o.place = p.place DESC, o.retrieval_score DESC) AS r
        FROM placed p JOIN (SELECT placed.file, place, retrieval_score FROM top JOIN placed USING (file, start_line)) o ON p.file = o.file AND abs(p.place - o.place) <= 1) WHERE r = 1""",
        _SCORE + ", " + _STRONG + ", placed AS (SELECT file, start_line, end_line, row_number() OVER (PARTITION BY file ORDER BY start_line, end_line) AS place FROM chunks)",
        "chunks",
    )
)
def neighbor_expansion(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.neighbours(_top(spark, sf), _chunks(spark, sf))
    return found.select("file", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "retrieval_score", "context_role")


@query(
    _with(
        """SELECT a.file AS file_a, b.file AS file_b, a.start_line AS line_a, b.start_line AS line_b, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS likeness
        FROM w a JOIN w b ON (a.file, a.start_line) < (b.file, b.start_line)""",
        _SCORE + ", " + _STRONG + f", w AS (SELECT file, start_line, list_distinct({tokens_sql("content || ' ' || file")}) AS w FROM top JOIN chunks USING (file, start_line))",
        "chunks",
    )
)
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Likeness of the pairs among at most 4k candidates."""
    top = _top(spark, sf).select("file", "start_line", text.retrieval_tokens(F.concat_ws(" ", "content", "file")).alias("w"))
    a, b = (top.select(*(F.col(c).alias(f"{c}_{x}") for c in ("file", "start_line", "w"))) for x in "ab")
    pairs = a.crossJoin(F.broadcast(b)).where(F.struct("file_a", "start_line_a") < F.struct("file_b", "start_line_b"))
    return pairs.select("file_a", "file_b", F.col("start_line_a").cast("bigint").alias("line_a"), F.col("start_line_b").cast("bigint").alias("line_b"), F.round(text.jaccard(F.col("w_a"), F.col("w_b")), 6).alias("likeness"))


_EVIDENCE = "ev AS (SELECT path AS file, doc_id % 12 + 1 AS start_line, doc_id % 12 + 1 + doc_id % 7 AS end_line FROM files)"


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("doc_id") % 12 + 1
    return t.files(spark, sf).select(F.col("path").alias("file"), start.alias("start_line"), (start + F.col("doc_id") % 7).alias("end_line"))


@query(_with("SELECT file, start_line, end_line FROM ev WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.file = ev.file AND ev.start_line >= c.start_line AND ev.end_line <= c.end_line)", _EVIDENCE, "files", "chunks"))
def evidence_containment(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.contained(_evidence(spark, sf), _chunks(spark, sf))


@query(
    _with(
        "SELECT DISTINCT ev.file, ev.start_line, ev.end_line, c.start_line AS chunk_start, c.end_line AS chunk_end FROM ev JOIN chunks c ON lower(c.file) = lower(ev.file) AND ev.start_line <= c.end_line AND c.start_line <= ev.end_line",
        _EVIDENCE, "files", "chunks",
    )
)
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.overlapping(_evidence(spark, sf), _chunks(spark, sf))
    return found.select("file", "start_line", "end_line", F.col("chunk_start").cast("bigint").alias("chunk_start"), F.col("chunk_end").cast("bigint").alias("chunk_end"))


@query(
    _with(
        """SELECT 'toxic' AS query, h::DOUBLE / nf AS precision, h::DOUBLE / ne AS recall, (h > 0)::INT::DOUBLE AS hit_rate FROM
        (SELECT (SELECT count(DISTINCT file) FROM top) AS nf, (SELECT count(*) FROM ex) AS ne, (SELECT count(DISTINCT file) FROM top WHERE file IN (SELECT file FROM ex)) AS h)""",
        _SCORE + ", " + _STRONG + ", ex AS (SELECT DISTINCT path AS file FROM files JOIN labels USING (doc_id) WHERE toxic = 1)", "chunks", "files",
    )
)
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    toxic = t.read(spark, sf, "labels").where("toxic = 1").select("doc_id")
    expected = t.files(spark, sf).join(toxic, "doc_id").select(F.lit("toxic").alias("query"), F.col("path").alias("file"))
    return retrieval.evaluation(_top(spark, sf).select(F.lit("toxic").alias("query"), "file"), expected)


# --- questions -----------------------------------------------------------------------

_PLAIN = "regexp_replace(lower(query), '[^a-z0-9_-]+', ' ', 'g')"


@query(sql(f"SELECT conv_id, turn FROM questions WHERE regexp_matches({_PLAIN}, '{text.SENSITIVE}')", "questions"))
def sensitive_requests(spark: SparkSession, sf: str) -> DataFrame:
    return t.questions(spark, sf).where(text.is_sensitive_request(F.col("query"))).select("conv_id", "turn")


_LETTERS = "regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')"


def _any(c: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in phrases) + ")"


@query(sql(f"SELECT conv_id, turn FROM questions WHERE {_any(_LETTERS, vocab.IDENTITY_SCOPES)} AND {_any(_LETTERS, vocab.IDENTITY_TERMS)}", "questions"))
def identity_questions(spark: SparkSession, sf: str) -> DataFrame:
    return t.questions(spark, sf).where(text.is_identity_question(F.col("query"))).select("conv_id", "turn")


@query(
    sql(
        f"SELECT conv_id, turn, {_any('lower(query)', vocab.GLOBAL_ARCHITECTURE_PHRASES)} OR regexp_matches(lower(query), '{text.EXACT_COUNT}') AS is_global, regexp_matches(lower(query), '{text.EXPLANATORY}') AS explanatory FROM questions",
        "questions",
    )
)
def question_kinds(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("query")
    return t.questions(spark, sf).select("conv_id", "turn", text.is_global_architecture_query(q).alias("is_global"), text.is_explanatory(q).alias("explanatory"))


# --- claims --------------------------------------------------------------------------


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return claim_ops.claims_of(t.answers(spark, sf))


@query(sql("SELECT answer_id, position, claim FROM claims", "claims"))
def decompose_claims(spark: SparkSession, sf: str) -> DataFrame:
    return _claims(spark, sf)


_VERIFY_STOPS = ",".join(f"'{w}'" for w in vocab.VERIFIER_STOP_WORDS)


def _verifier_sql(c: str) -> str:
    found = f"list_filter(regexp_extract_all(lower(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z_][a-z0-9_]*'), lambda t: t NOT IN ({_VERIFY_STOPS}))"
    return (
        f"list_distinct(flatten(list_transform({found}, lambda t: CASE WHEN t LIKE '%ies' AND len(t) > 4 THEN [t, left(t, -3) || 'y'] WHEN t LIKE '%ses' AND len(t) > 4 THEN [t, left(t, -2)] "
        "WHEN t LIKE '%s' AND len(t) > 3 THEN [t, left(t, -1)] ELSE [t] END)))"
    )


_OVERLAP = f"""ov AS (SELECT answer_id, position, CASE WHEN len(a) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(a), 6) END AS ratio FROM
    (SELECT c.answer_id, position, {_verifier_sql('claim')} AS a, {_verifier_sql('p.text')} AS b FROM claims c JOIN conversations p ON p.conv_id = c.answer_id // 1000 AND p.turn = c.answer_id % 1000 - 1))"""


def _overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Each claim against the turn before its answer."""
    before = t.read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("answer_id"), text.verifier_tokens(F.col("text")).alias("b"))
    joined = _claims(spark, sf).withColumn("a", text.verifier_tokens(F.col("claim"))).join(before, "answer_id")
    return joined.select("answer_id", "position", F.round(text.overlap_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(_with("SELECT * FROM ov", _OVERLAP, "claims"))
def claim_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _overlap(spark, sf)


_JUDGED = ", judged AS (SELECT answer_id, CASE WHEN ratio >= 0.5 THEN 'fact' WHEN ratio > 0.1 THEN 'inference' ELSE 'unknown' END AS status, CASE WHEN ratio > 0 THEN 1 ELSE 0 END AS evidence_n FROM ov)"


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    o = _overlap(spark, sf)
    decision = F.when(F.col("ratio") >= 0.5, "supported").when(F.col("ratio") > 0.1, "partially_supported").otherwise("unsupported")
    return o.select("answer_id", claim_ops.status_of(decision).alias("status"), F.when(F.col("ratio") > 0, 1).otherwise(0).alias("evidence_n"))


@query(
    _with(
        """SELECT answer_id, n AS claim_count, s AS supported_claims, n - s AS unsupported_claims, round(s::DOUBLE / n, 4) AS coverage FROM
        (SELECT answer_id, count(*) AS n, count(*) FILTER (status <> 'unknown' AND evidence_n > 0) AS s FROM judged GROUP BY answer_id)""",
        _OVERLAP + _JUDGED, "claims",
    )
)
def claim_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return claim_ops.coverage(_judged(spark, sf), "answer_id")


@query(
    _with(
        "SELECT answer_id, CASE WHEN bool_and(status = 'unknown') THEN 'unknown' WHEN bool_or(status IN ('unknown', 'inference')) THEN 'inference' ELSE 'fact' END AS answer_status FROM judged GROUP BY answer_id",
        _OVERLAP + _JUDGED, "claims",
    )
)
def answer_status_fold(spark: SparkSession, sf: str) -> DataFrame:
    return claim_ops.fold_status(_judged(spark, sf), "answer_id")


@query(
    sql(
        """SELECT repo_id, claim, CASE WHEN said IS NULL THEN NULL WHEN said = real THEN 'supported' ELSE 'unsupported' END AS decision FROM (
        SELECT repo_id, 'Module ' || module_name || ' has ' || (outgoing_count + total_connections % 2) || ' outgoing dependencies.' AS claim, outgoing_count + total_connections % 2 AS said, outgoing_count AS real FROM mods
        UNION ALL SELECT repo_id, module_name || ' has ' || incoming_count || ' incoming dependency.', incoming_count, incoming_count FROM mods
        UNION ALL SELECT repo_id, module_name || ' is large.', NULL, NULL FROM mods)""",
        "mods",
    )
)
def verify_numeric_claims(spark: SparkSession, sf: str) -> DataFrame:
    m = t.Repository(spark, sf).modules
    s = lambda c: F.col(c).cast("string")
    wrong = (F.col("outgoing_count") + F.col("total_connections") % 2).cast("string")
    made = m.select("repo_id", F.explode(F.array(
        F.concat(F.lit("Module "), "module_name", F.lit(" has "), wrong, F.lit(" outgoing dependencies.")),
        F.concat("module_name", F.lit(" has "), s("incoming_count"), F.lit(" incoming dependency.")),
        F.concat("module_name", F.lit(" is large.")),
    )).alias("claim"))
    return claim_ops.verify_counts(made, m).select("repo_id", "claim", "decision")


# --- sources and requests ------------------------------------------------------------


def _python_files(spark: SparkSession, sf: str) -> DataFrame:
    """A small source file for each part, some of which do not parse."""
    p = t.read(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    body = F.concat(
        F.lit("import os\nfrom pkg.sub import a"), key, F.when(F.col("p_partkey") % 4 == 1, "\nimport json").otherwise("\n"), F.lit("\nclass C"), key, F.lit(":\n    def run(self):\n        return eval('1')\n\nasync def f"), key,
        F.lit("():\n    pass\n"), F.when(F.col("p_partkey") % 10 == 3, "def broken(:\n").otherwise("api_key = 'abc'\n"),
    )
    return p.select(F.concat(F.lit("z"), F.col("p_size").cast("string")).alias("repo_id"), F.concat(F.lit("src/m"), key, F.lit(".py")).alias("path"), body.alias("content"))


@query("SELECT 'src/m' || p_partkey || '.py' AS file, CASE WHEN p_partkey % 4 = 1 THEN 'json,os,pkg.sub' ELSE 'os,pkg.sub' END AS imports, 'f' || p_partkey || ',run' AS functions, 'C' || p_partkey AS classes FROM part WHERE p_partkey % 10 <> 3")
def python_structure(spark: SparkSession, sf: str) -> DataFrame:
    s = pyast.structure(pyast.facts(_python_files(spark, sf)))
    return s.select("file", *(F.array_join(c, ",").alias(c) for c in ("imports", "functions", "classes")))


@query(
    """SELECT 'src/m' || p_partkey || '.py' AS file, 1 AS start_line, 'C' || p_partkey AS classes, '' AS functions FROM part WHERE p_partkey % 10 <> 3
    UNION ALL SELECT 'src/m' || p_partkey || '.py', 5, 'C' || p_partkey, 'run,f' || p_partkey FROM part WHERE p_partkey % 10 <> 3
    UNION ALL SELECT 'src/m' || p_partkey || '.py', 9, '', 'f' || p_partkey FROM part WHERE p_partkey % 10 <> 3"""
)
def chunk_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of four-line chunks of the generated sources; chunks without any are left out."""
    f = _python_files(spark, sf)
    rows = retrieval.attach_symbols(retrieval.chunks(f, 4), pyast.symbols(pyast.facts(f))).where("symbols is not null")
    names = lambda k: F.array_join(F.transform(F.col("symbols")[k], lambda x: x["name"]), ",")
    return rows.select("file", F.col("start_line").cast("bigint").alias("start_line"), names("classes").alias("classes"), names("functions").alias("functions"))


@query()
def rate_limiter(spark: SparkSession, sf: str) -> DataFrame:
    e = t.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("client"), "ts", F.col("event_id").alias("request_id"))
    return admission.admit(e, limit=5, window_s=86_400)


@query("SELECT date_trunc('hour', ts) AS window_start, user_id::VARCHAR AS client, count(*) AS requests FROM events GROUP BY ALL")
def windowed_requests(spark: SparkSession, sf: str) -> DataFrame:
    e = t.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("client"), "ts", F.col("event_id").alias("request_id"))
    return admission.windowed_counts(e)


@query(
    r"""SELECT url, regexp_matches(url, '^https://[^/?#]*github\.com(/|$)') AND false AS clone_ok, CASE WHEN length(url) <= 42 THEN url ELSE '…' || right(url, 41) END AS short,
    lower(regexp_extract(split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1), '[^.](\.[^.]+)$', 1)) AS suffix FROM pages"""
)
def url_projection(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    bare = F.regexp_replace(u, r"[?#].*$", "")
    return t.read(spark, sf, "pages").select("url", paths.valid_clone_url(u).alias("clone_ok"), paths.ellipsis_middle(u).alias("short"), paths.suffix(bare).alias("suffix"))


@query()
def diverse_code_evidence(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf).withColumn("pos", F.col("doc_id") * 1000 + F.col("start_line")).withColumn("symbol_names", F.lit(""))
    return evidence.diverse_code(c, "idiot clown").select("file", F.col("start_line").cast("bigint").alias("start_line"), "score", "again")


_CONTEXT = f"CASE WHEN {_any('lower(query)', selection.ARCHITECTURE_CONTEXT)} THEN 'architecture' WHEN {_any('lower(query)', selection.IMPLEMENTATION_CONTEXT)} THEN 'implementation' WHEN {_any('lower(query)', selection.SYMBOL_CONTEXT)} THEN 'symbol' ELSE 'general' END"


@query(sql(f"SELECT conv_id, turn, {_CONTEXT} AS intent FROM questions", "questions"))
def context_intent(spark: SparkSession, sf: str) -> DataFrame:
    return t.questions(spark, sf).select("conv_id", "turn", selection.context_intent(F.col("query")).alias("intent"))


@query(_with("SELECT answer_id, sum(evidence_n)::BIGINT AS \"references\", round(100.0::DOUBLE * count(*) FILTER (status <> 'unknown' AND evidence_n > 0) / count(*))::BIGINT AS coverage_percent FROM judged GROUP BY answer_id", _OVERLAP + _JUDGED, "claims"))
def evidence_references(spark: SparkSession, sf: str) -> DataFrame:
    return selection.evidence_references(_judged(spark, sf))


@query(_with("SELECT file, start_line, end_line FROM chunks WHERE (file, start_line) NOT IN (SELECT (file, start_line) FROM top)", _SCORE + ", " + _STRONG, "chunks"))
def unused_chunks(spark: SparkSession, sf: str) -> DataFrame:
    left = selection.unused_chunks(_chunks(spark, sf), _top(spark, sf))
    return left.select("file", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


@query("SELECT 'z' || p_size AS repo_id, count(*) AS files, sum(CASE WHEN p_partkey % 4 = 1 THEN 3 ELSE 2 END)::BIGINT AS imports, 2 * count(*) AS functions, count(*) AS classes FROM part WHERE p_partkey % 10 <> 3 GROUP BY p_size")
def structure_totals(spark: SparkSession, sf: str) -> DataFrame:
    return selection.structure_totals(pyast.structure(pyast.facts(_python_files(spark, sf))))
