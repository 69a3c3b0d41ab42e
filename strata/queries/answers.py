"""Queries on verification, evidence, contracts, sequential choices and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import paths, text, vocab
from strata.operators import claims as claim_ops
from strata.operators import evidence, retrieval, selection
from strata.plans import qa as plans
from strata.plans import service
from strata.queries import prose, qa, structure
from strata.queries import tables as t
from strata.queries.structure import _with
from strata.queries.tables import Repository, sql, tokens_sql
from strata.sources import pyast

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return add


_say = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
_FACTS = structure._SIGNALS + ", " + structure._OVERVIEW + ", " + qa._GRAPH
_ON = (*structure._ON, "pairs")


# --- claims against facts ------------------------------------------------------------

#: Claims and their decisions, rule by rule.
_CLAIMED = [
    ("'The repository contains ' || python_files || ' Python files.'", "'supported'"),
    ("'There are ' || (total_files + 1) || ' total files.'", "'unsupported'"),
    ("'The ' || n || ' production modules have ' || architecture_edge_count || ' dependency edges.'", "'supported'"),
    ("'The ' || n || ' production modules have ' || (architecture_edge_count + 1) || ' dependency edges.'", "'unsupported'"),
    ("'The most connected module is ' || t || ' with ' || tv || ' connections.'", "'supported'"),
    ("'The most connected module is nobody.here with ' || tv || ' connections.'", "'unsupported'"),
    ("l[1] || ' has the fewest dependency connections.'", "CASE WHEN len(l) = 1 THEN 'supported' ELSE 'unsupported' END"),
    ("array_to_string(l, ', ') || ' have the fewest dependency connections, ' || lv || ' connections each.'", "'supported'"),
    ("o || ' has the most outgoing dependencies.'", "'supported'"),
    ("i || ' has the most incoming dependencies, ' || (iv + 1) || ' incoming dependencies.'", "'unsupported'"),
]
_OF_MODULES = [
    ("module_name || ' belongs to the source layer.'", "'supported'"),
    ("module_name || ' belongs to the test layer.'", "'unsupported'"),
    ("module_name || ' has ' || total_connections || ' total connections.'", "'supported'"),
    ("module_name || ' is a module of some kind.'", "NULL"),
]


@query(
    _with(
        "SELECT DISTINCT repo_id, claim, decision FROM (" + " UNION ALL ".join([f"SELECT repo_id, {c} AS claim, {d} AS decision FROM f" for c, d in _CLAIMED] + [f"SELECT repo_id, {c}, {d} FROM mods" for c, d in _OF_MODULES]) + ")",
        _FACTS, *_ON,
    )
)
def verify_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Right and wrong claims on counts, edges, rankings, ties, layers and connections."""
    r = Repository(spark, sf)
    f = plans.module_facts(r.modules, r.pairs).join(r.overview, "repo_id")
    top, out, into = (lambda by: F.col(f"top_{by}.module_name"))("total_connections"), F.col("top_outgoing_count"), F.col("top_incoming_count")
    made = F.array(
        _say("The repository contains ", F.col("python_files"), " Python files."),
        _say("There are ", F.col("total_files") + 1, " total files."),
        _say("The ", F.col("node_count"), " production modules have ", F.col("edge_count"), " dependency edges."),
        _say("The ", F.col("node_count"), " production modules have ", F.col("edge_count") + 1, " dependency edges."),
        _say("The most connected module is ", top, " with ", F.col("top_total_connections.n"), " connections."),
        _say("The most connected module is nobody.here with ", F.col("top_total_connections.n"), " connections."),
        _say(F.col("least_names")[0], " has the fewest dependency connections."),
        _say(F.array_join("least_names", ", "), " have the fewest dependency connections, ", F.col("least"), " connections each."),
        _say(out["module_name"], " has the most outgoing dependencies."),
        _say(into["module_name"], " has the most incoming dependencies, ", into["n"] + 1, " incoming dependencies."),
    )
    name = F.col("module_name")
    of_modules = F.array(_say(name, " belongs to the source layer."), _say(name, " belongs to the test layer."), _say(name, " has ", F.col("total_connections"), " total connections."), _say(name, " is a module of some kind."))
    said = f.select("repo_id", F.explode(made).alias("claim")).union(r.modules.select("repo_id", F.explode(of_modules).alias("claim")))
    return claim_ops.verify_facts(said, r.modules, r.overview)


# --- evidence ------------------------------------------------------------------------


@query(
    _with(
        """SELECT repo_id, count(*) AS node_count, sum(outgoing_count)::BIGINT AS edge_count, count(*) FILTER (total_connections = 0) AS isolated_node_count, string_agg(module_name, ',' ORDER BY a) FILTER (a <= 5) AS top_connected,
        string_agg(module_name, ',' ORDER BY b) FILTER (b <= 5) AS top_outgoing, string_agg(module_name, ',' ORDER BY c) FILTER (c <= 5) AS top_incoming FROM r GROUP BY repo_id""",
        """r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY total_connections DESC, module_name) AS a, row_number() OVER (PARTITION BY repo_id ORDER BY outgoing_count DESC, module_name) AS b,
        row_number() OVER (PARTITION BY repo_id ORDER BY incoming_count DESC, module_name) AS c FROM cmods)""",
        "cmods",
    )
)
def graph_evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = evidence.graph_evidence(Repository(spark, sf, "customer").modules)
    return e.select("repo_id", "node_count", "edge_count", "isolated_node_count", *(F.array_join(c, ",").alias(c) for c in ("top_connected", "top_outgoing", "top_incoming")))


_SUPPORT = """placed AS (SELECT file, start_line, end_line, row_number() OVER (PARTITION BY file ORDER BY start_line, end_line) AS place FROM chunks),
    mine AS (SELECT placed.file, place, retrieval_score FROM top JOIN placed USING (file, start_line)),
    near AS (SELECT p.file, p.start_line, p.end_line, max(round(0.5 * o.retrieval_score, 6)) AS retrieval_score FROM placed p JOIN mine o ON p.file = o.file AND abs(p.place - o.place) = 1
        WHERE NOT EXISTS (SELECT 1 FROM mine x WHERE x.file = p.file AND x.place = p.place) GROUP BY ALL)"""


@query(
    _with(
        """SELECT 'code' AS evidence_type, file, start_line, end_line, NULL AS metadata_key, NULL AS value, NULL AS module_name, retrieval_score, 'primary' AS retrieval_role, 'retrieved' AS context_role FROM top JOIN chunks USING (file, start_line, end_line)
        UNION ALL SELECT 'code', file, start_line, end_line, NULL, NULL, NULL, retrieval_score, 'supporting', 'neighbor' FROM near
        UNION ALL SELECT 'repository_metadata', NULL, NULL, NULL, 'python_files', python_files, NULL, NULL, NULL, NULL FROM ov
        UNION ALL SELECT 'architecture', file, NULL, NULL, NULL, NULL, module_name, NULL, 'architecture', 'architecture' FROM met WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY exact DESC, shared DESC, total_connections DESC, module_name) <= 5""",
        ", ".join((prose._SCORE, prose._STRONG, _SUPPORT, structure._SIGNALS, structure._OVERVIEW, structure._LOOKUP)), "chunks", *_ON,
    )
)
def evidence_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieved chunks, their neighbours, a count and modules, each in its role."""
    r, chunks = Repository(spark, sf), prose._chunks(spark, sf)
    top = prose._top(spark, sf)
    near = retrieval.neighbours(top, chunks).where("context_role = 'neighbor'")
    modules = service.architecture_evidence("pkg1.s1 dependencies", r.modules)
    pool = evidence.evidence_pool(top, near, service.matching_facts("How many Python files", r.overview), modules)
    lines = (F.col(c).cast("bigint").alias(c) for c in ("start_line", "end_line"))
    return pool.select("evidence_type", "file", *lines, "metadata_key", "value", "module_name", "retrieval_score", "retrieval_role", "context_role")


@query(
    _with(
        """SELECT 'code' AS evidence_type, file, start_line, end_line, NULL AS metadata_key, NULL AS label, NULL AS value, NULL AS module_name FROM top JOIN chunks USING (file, start_line, end_line)
        UNION ALL SELECT 'metadata', NULL, NULL, NULL, 'python_files', 'Python files', python_files, NULL FROM ov
        UNION ALL SELECT 'architecture', file, NULL, NULL, NULL, NULL, NULL, module_name FROM mods WHERE total_connections = 20""",
        ", ".join((prose._SCORE, prose._STRONG, structure._SIGNALS, structure._OVERVIEW)), "chunks", *_ON,
    )
)
def public_evidence(spark: SparkSession, sf: str) -> DataFrame:
    r = Repository(spark, sf)
    out = evidence.public_evidence(prose._top(spark, sf), service.matching_facts("How many Python files", r.overview), r.modules.where("total_connections = 20"))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("start_line", "end_line")})


@query(
    sql(
        """SELECT repo_id, file, coalesce(a.total_connections, b.total_connections) AS total_connections, a.total_connections IS NOT NULL AS first FROM (SELECT repo_id, file, total_connections FROM mods WHERE outgoing_count > incoming_count) a
        FULL JOIN (SELECT repo_id, file, -total_connections AS total_connections FROM mods WHERE total_connections % 2 = 0) b USING (repo_id, file)""",
        "mods",
    )
)
def merged_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Of two sets of modules that overlap, rows of the first win."""
    m = Repository(spark, sf).modules
    first = m.where("outgoing_count > incoming_count").select("repo_id", "file", "total_connections", F.lit(True).alias("first"))
    second = m.where("total_connections % 2 = 0").select("repo_id", "file", (-F.col("total_connections")).alias("total_connections"), F.lit(False).alias("first"))
    return evidence.merge_authoritative(first, second, "repo_id", "file")


_EVIDENCE_OK = "CASE WHEN doc_id % 3 = 0 THEN (doc_id % 4) >= 1 AND (doc_id % 5) >= (doc_id % 4) WHEN doc_id % 3 = 1 THEN doc_id % 7 <> 0 ELSE false END"


@query(f"SELECT doc_id, {_EVIDENCE_OK} AS valid FROM documents")
def reference_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Code references with lines in and out of order, modules with and without a name, and another kind."""
    d, i = t.read(spark, sf, "documents"), F.col("doc_id")
    e = d.select(
        "doc_id", F.when(i % 3 == 0, "code").when(i % 3 == 1, "architecture").otherwise("hearsay").alias("evidence_type"), F.lit("src/a.py").alias("file"),
        (i % 4).alias("start_line"), (i % 5).alias("end_line"), F.when(i % 7 == 0, "  ").otherwise("pkg.a").alias("module_name"),
    )
    return e.select("doc_id", evidence.is_valid_reference(e).alias("valid"))


@query("SELECT conv_id, turn, trim(text, chr(32)) <> '' AND turn % 5 < 4 AS valid FROM conversations")
def claim_contracts(spark: SparkSession, sf: str) -> DataFrame:
    c = t.read(spark, sf, "conversations")
    known = F.element_at(F.array(*map(F.lit, [*selection.STATUSES, "guess"])), (F.col("turn") % 5 + 1).cast("int"))
    rows = c.select("conv_id", "turn", "text", known.alias("status"))
    return rows.select("conv_id", "turn", selection.is_valid_claim(rows).alias("valid"))


# --- choices made one after the other ------------------------------------------------

_MMR_STEPS = ",\n".join(
    ["s1 AS (SELECT i FROM cand ORDER BY score DESC, file DESC, start_line DESC LIMIT 1)"]
    + [
        f"""s{n} AS (SELECT i FROM s{n - 1} UNION ALL SELECT i FROM (SELECT c.i FROM cand c LEFT JOIN (SELECT a, max(likeness) AS m FROM likely JOIN s{n - 1} ON b = s{n - 1}.i GROUP BY a) k ON k.a = c.i
        WHERE c.i NOT IN (SELECT i FROM s{n - 1}) ORDER BY 0.75::DOUBLE * c.score - 0.25::DOUBLE * coalesce(k.m, 0) DESC, c.score DESC, c.file DESC, c.start_line DESC LIMIT 1))"""
        for n in range(2, prose.K + 1)
    ]
)

ORACLE["mmr_top_k"] = _with(
    f"SELECT file, start_line, score AS retrieval_score, CASE WHEN is_primary OR b IS NULL THEN 'primary' ELSE 'supporting' END AS retrieval_role FROM cand JOIN s{prose.K} USING (i), best",
    ", ".join((prose._SCORE, prose._STRONG))
    + f""", cand AS (SELECT row_number() OVER (ORDER BY retrieval_score DESC, top.file, top.start_line) AS i, top.file, top.start_line, is_primary, retrieval_score AS score, list_distinct({tokens_sql("content || ' ' || top.file")}) AS w FROM top JOIN chunks USING (file, start_line)),
    likely AS (SELECT x.i AS a, y.i AS b, CASE WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 0.0 ELSE len(list_intersect(x.w, y.w))::DOUBLE / len(list_distinct(list_concat(x.w, y.w))) END AS likeness FROM cand x, cand y WHERE x.i <> y.i),
    {_MMR_STEPS}""",
    "chunks",
)

ORACLE["rate_limiter"] = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS client, ts, event_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    run AS (SELECT client, ts, request_id, rn, true AS admitted, [ts] AS log FROM e WHERE rn = 1
    UNION ALL SELECT client, ts, request_id, rn, len(kept) < 5, CASE WHEN len(kept) < 5 THEN list_append(kept, ts) ELSE kept END FROM
    (SELECT e.*, list_filter(run.log, lambda x: x > e.ts - INTERVAL 1 DAY) AS kept FROM run JOIN e ON e.client = run.client AND e.rn = run.rn + 1))
    SELECT client, ts, request_id, admitted FROM run"""

_SELECTOR_STOPS = ",".join(f"'{w}'" for w in vocab.SELECTOR_STOP_WORDS)


def _selector_sql(c: str) -> str:
    """Selector tokens: identifiers cut at case changes, and their parts."""
    cut = f"regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    fine = f"lambda x: len(x) > 1 AND x NOT IN ({_SELECTOR_STOPS})"
    found = f"list_filter(list_transform(regexp_extract_all({cut}, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: trim(lower(x), '_')), {fine})"
    return f"list_distinct(flatten(list_transform({found}, lambda x: list_concat([x], list_filter(string_split(x, '_'), {fine})))))"


_CODE_SCORE = f"""hits AS (SELECT file, start_line, doc_id * 1000 + start_line AS pos, 2 * (list_has_any(c, ['idiot', 'idiots']))::BIGINT + 2 * (list_has_any(c, ['clown', 'clowns']))::BIGINT AS content_hits,
    (list_contains(p, 'src7'))::BIGINT * n7 AS file_hits FROM (SELECT file, start_line, doc_id, {_selector_sql('content')} AS c, {_selector_sql('file')} AS p, 2 AS n7 FROM chunks))"""

ORACLE["diverse_code_evidence"] = _with(
    "SELECT file, start_line, content_hits AS score, (r > 1)::BIGINT AS again FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY content_hits DESC, pos) AS r FROM hits WHERE content_hits > 0) ORDER BY r > 1, content_hits DESC, pos LIMIT 6",
    _CODE_SCORE, "chunks",
)


def _chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return prose._chunks(spark, sf).withColumn("pos", F.col("doc_id") * 1000 + F.col("start_line")).withColumn("symbol_names", F.lit("")).withColumn("retrieval_score", F.lit(0.0))


@query(
    _with(
        "SELECT file, start_line, content_hits + 5 * file_hits AS context_score FROM hits WHERE file_hits > 0 ORDER BY content_hits DESC, pos LIMIT 6",
        _CODE_SCORE, "chunks",
    )
)
def structural_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of one source's files come first, those with more of the words at the head."""
    found = evidence.structural_first(_chunk_rows(spark, sf), "idiot clown src7", 6)
    return found.select("file", F.col("start_line").cast("bigint").alias("start_line"), "context_score")


_EVIDENT = "ev AS (SELECT conv_id, turn AS pos, text FROM conversations)"


@query(
    _with(
        """SELECT key, claim, rank, pos, ratio FROM (SELECT *, row_number() OVER (PARTITION BY key, claim ORDER BY ratio DESC, pos) AS rank FROM
        (SELECT key, claim, pos, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS ratio FROM said JOIN told USING (key)) WHERE ratio > 0) WHERE rank <= 3""",
        f"said AS (SELECT DISTINCT answer_id // 1000 AS key, claim, {prose._verifier_sql('claim')} AS a FROM claims), told AS (SELECT conv_id AS key, turn AS pos, {prose._verifier_sql('text')} AS b FROM conversations WHERE role = 'user')",
        "claims",
    )
)
def best_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The three turns of the asker with most of each claim's words."""
    said = prose._claims(spark, sf).select(F.expr("answer_id div 1000").alias("key"), "claim").distinct()
    told = t.read(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    return claim_ops.best_evidence(said, told, 3)


# --- names, replies and settings -----------------------------------------------------


@query(
    """SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN true WHEN page_id % 5 = 1 THEN page_id % 2 = 0 ELSE false END AS clone_ok, page_id % 3 <> 2 AS name_ok FROM
    (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://github.com/org' || page_id || '/repo' WHEN 1 THEN 'https://github.com/org/deep/tree' || page_id || CASE WHEN page_id % 2 = 0 THEN '.git' ELSE '' END WHEN 2 THEN 'http://github.com/org/repo' ELSE url END AS url FROM pages)"""
)
def clone_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses that may and may not be cloned, and names a clone may and may not have."""
    p, i = t.read(spark, sf, "pages"), F.col("page_id")
    s = i.cast("string")
    url = (
        F.when(i % 5 == 0, F.concat(F.lit("https://github.com/org"), s, F.lit("/repo")))
        .when(i % 5 == 1, F.concat(F.lit("https://github.com/org/deep/tree"), s, F.when(i % 2 == 0, ".git").otherwise("")))
        .when(i % 5 == 2, "http://github.com/org/repo")
        .otherwise(F.col("url"))
    )
    name = F.when(i % 3 == 0, F.concat(F.lit("repo-"), s)).when(i % 3 == 1, "a.b_c").otherwise(F.when(i % 2 == 0, "..").otherwise("no/slash"))
    return p.select("page_id", url.alias("url"), paths.valid_clone_url(url).alias("clone_ok"), paths.valid_repository_name(name).alias("name_ok"))


@query(
    """SELECT part AS name, string_agg(upper(left(w, 1)) || substr(w, 2), ' ' ORDER BY n) AS label, CASE WHEN length(part) <= 23 THEN part ELSE left(part, 22) || '…' END AS short FROM
    (SELECT DISTINCT replace(p_name, ' ', '_') || '_x_' || p_size AS part FROM part) p, LATERAL (SELECT unnest(string_split(replace(part, '_', ' '), ' ')) AS w, unnest(range(len(string_split(replace(part, '_', ' '), ' ')))) AS n) GROUP BY part"""
)
def title_labels(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("_x_"), F.col("p_size").cast("string"))
    return t.read(spark, sf, "part").select(name.alias("name")).distinct().select("name", text.title_label(F.col("name")).alias("label"), paths.ellipsis_tail(F.col("name")).alias("short"))


_REPLIES = ['{"decision": "%s", "n": %d}', 'Here it is:\n```json\n{"decision": "%s", "n": %d}\n```', 'I think {"decision": "%s", "n": %d} fits', "%s without %d braces {"]
_WORDS = ["yes", "Partial", "no", "supported ", "who knows"]


@query(
    """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_id END AS n, ['supported', 'partially_supported', 'unsupported', 'supported', 'unsupported'][event_id % 5 + 1] AS decision,
    CASE WHEN event_id % 3 = 0 THEN event_id % 100 ELSE 7 END AS setting FROM events"""
)
def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Verifiers' replies with a JSON object somewhere or none, decisions in other words, and settings with a fallback."""
    i = F.col("event_id")
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (i % 5 + 1).cast("int"))
    raw = F.element_at(F.array(*(F.format_string(f, word, i) for f in _REPLIES)), (i % 4 + 1).cast("int"))
    rows = t.read(spark, sf, "events").select("event_id", raw.alias("raw"), word.alias("word"), F.when(i % 3 == 0, F.concat(F.lit(" "), (i % 100).cast("string"))).when(i % 3 == 1, "many").alias("setting"))
    n = F.get_json_object(text.json_object(F.col("raw")), "$.n").cast("bigint")
    return rows.select("event_id", n.alias("n"), text.decision(F.col("word")).alias("decision"), text.int_or(F.col("setting"), 7).cast("bigint").alias("setting"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'It is ' || event_type WHEN 1 THEN 'Unknown: ' || event_type WHEN 2 THEN 'The ' || event_type ELSE 'unknown' END AS answer, event_id % 2 = 1 AS unknown FROM events"""
)
def unwrapped_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers plain, in JSON under one of its keys, and fenced; some say that they do not know."""
    i, e = F.col("event_id"), F.col("event_type")
    raw = (
        F.when(i % 4 == 0, F.concat(F.lit('{"answer": "It is '), e, F.lit('"}')))
        .when(i % 4 == 1, F.concat(F.lit("Unknown: "), e))
        .when(i % 4 == 2, F.concat(F.lit('```json\n{"response": "The '), e, F.lit('"}\n```')))
        .otherwise("  unknown ")
    )
    rows = t.read(spark, sf, "events").select("event_id", text.unwrap_answer(raw).alias("answer"))
    return rows.select("event_id", "answer", text.is_unknown_answer(F.col("answer")).alias("unknown"))


_TERMS = [*vocab.CONCEPT_ALIASES, *(a for v in vocab.SELECTOR_ALIASES.values() for a in v), "queries", "classes", "glass", "is"]
_alias_sql = lambda table: "CASE w " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(a) for a in v)}]" for k, v in table.items()) + " ELSE [] END"


@query(
    f"""SELECT w AS term, array_to_string(list_sort(list_distinct(list_concat([w], {_alias_sql(vocab.CONCEPT_ALIASES)}))), ',') AS concepts,
    array_to_string(list_sort(list_distinct(list_concat(CASE WHEN len(w) > 3 AND w LIKE '%ies' THEN [w, left(w, -3) || 'y'] WHEN len(w) > 3 AND w LIKE '%ses' THEN [w, left(w, -2)] WHEN len(w) > 3 AND w LIKE '%s' THEN [w, left(w, -1)]
    WHEN len(w) > 2 THEN [w, w || 's'] ELSE [w] END, {_alias_sql(vocab.SELECTOR_ALIASES)}))), ',') AS forms, n FROM
    (SELECT list_extract([{', '.join(repr(x) for x in _TERMS)}], event_id % {len(_TERMS)} + 1) AS w, count(*) AS n FROM events GROUP BY 1)"""
)
def term_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts and forms of the terms that have any."""
    w = F.element_at(F.array(*map(F.lit, _TERMS)), (F.col("event_id") % len(_TERMS) + 1).cast("int"))
    rows = t.read(spark, sf, "events").groupBy(w.alias("term")).agg(F.count("*").alias("n"))
    sorted_ = lambda c: F.array_join(F.array_sort(c), ",")
    one = F.array("term")
    return rows.select("term", sorted_(text.concepts(one)).alias("concepts"), sorted_(text.selector_forms(one)).alias("forms"), "n")


@query(
    _with(
        """SELECT file, start_line, context_role, row_number() OVER (ORDER BY own DESC, score DESC, file, start_line) AS place FROM (SELECT file, start_line, 1 AS own, 'retrieved' AS context_role, retrieval_score AS score FROM top
        UNION ALL SELECT file, start_line, 0, 'neighbor', retrieval_score FROM near)""",
        ", ".join((prose._SCORE, prose._STRONG, _SUPPORT)), "chunks",
    )
)
def expanded_order(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieved chunks before their neighbours, at most three times as many as were retrieved, with their places."""
    rows = retrieval.neighbours(prose._top(spark, sf), prose._chunks(spark, sf))
    return selection.expanded_places(rows).select("file", F.col("start_line").cast("bigint").alias("start_line"), "context_role", "place")


@query(_with("SELECT string_agg('[' || n || '] ' || file || ':' || start_line || '-' || end_line || chr(10) || content, chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT top.*, content, row_number() OVER (ORDER BY retrieval_score DESC, file, start_line) AS n FROM top JOIN chunks USING (file, start_line)) WHERE n <= 5", prose._SCORE + ", " + prose._STRONG, "chunks"))
def numbered_context(spark: SparkSession, sf: str) -> DataFrame:
    best = retrieval.order_of(prose._top(spark, sf)).limit(5)
    rank = F.row_number().over(Window.orderBy(F.desc("retrieval_score"), "file", "start_line"))  # five rows
    return selection.context_text(best.withColumn("rank", rank))


# --- the score's symbol, definition and weight terms ---------------------------------

ASKED = "class c7 run"
WEIGHTS = {"c7": 3.0, "run": 2.0}  # the third word has the weight one

_SYMBOL_SCORE = f"""parts AS (SELECT 'src/m' || p_partkey || '.py' AS file, p_partkey AS k, p_partkey % 10 <> 3 AS fine, unnest([1, 5, 9]) AS start_line,
        unnest(['import os' || chr(10) || 'from pkg.sub import a' || p_partkey || chr(10) || CASE WHEN p_partkey % 4 = 1 THEN 'import json' ELSE '' END || chr(10) || 'class C' || p_partkey || ':',
                '    def run(self):' || chr(10) || '        return eval(''1'')' || chr(10) || chr(10) || 'async def f' || p_partkey || '():', '    pass' || chr(10) || CASE WHEN p_partkey % 10 = 3 THEN 'def broken(:' ELSE 'api_key = ''abc''' END]) AS content FROM part),
    seen AS (SELECT file, start_line, {tokens_sql('content')} AS c, CASE WHEN NOT fine THEN [] WHEN start_line = 1 THEN ['c' || k] WHEN start_line = 5 THEN ['c' || k, 'run', 'f' || k] ELSE ['f' || k] END AS s,
        fine AND (start_line = 5 OR (start_line = 1 AND k = 7)) AS starts FROM parts),
    hit AS (SELECT *, len(list_intersect(['class', 'c7', 'run'], list_distinct(c))) / 3.0::DOUBLE AS hc, len(list_intersect(['class', 'c7', 'run'], s)) / 3.0::DOUBLE AS hs FROM seen),
    term AS (SELECT *, (contains(array_to_string(c, ' '), '{ASKED}'))::INT::DOUBLE AS phrase, ((list_contains(c, 'class'))::INT * 1.0 + (list_contains(c, 'c7'))::INT * 3.0 + (list_contains(c, 'run'))::INT * 2.0)::DOUBLE / 6.0 AS body,
        least(len(list_filter(c, lambda x: list_contains(['class', 'c7', 'run'], x))) / 10.0::DOUBLE, 1.0) AS freq, least(1.0, hs + CASE WHEN starts THEN 0.5 ELSE 0 END)::DOUBLE AS symbol, (starts)::INT::DOUBLE AS defined,
        CASE WHEN hs > 0 THEN least(0.85, 0.65 + 0.20 * hs) WHEN hc > 0 THEN least(0.45, 0.25 + 0.20 * hc) ELSE 0 END::DOUBLE AS anchor FROM hit)"""


@query(
    _with(
        """SELECT file, start_line, round(round((0.06 + 0.07 * phrase + 0.16 * body + 0.02 * freq + 0.19 * symbol + 0.12 * defined + 0.15 * anchor)::DOUBLE, 6) + 0.07, 6) AS retrieval_score, hs > 0 AS is_primary
        FROM term WHERE phrase + body + freq + symbol + defined + anchor > 0""",
        _SYMBOL_SCORE, "paths",
    )
)
def score_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of generated sources for a question on a class: its symbols, where they begin, and words that weigh unequally."""
    f = prose._python_files(spark, sf)
    rows = retrieval.attach_symbols(retrieval.chunks(f, 4), pyast.symbols(pyast.facts(f)))
    return retrieval.score(rows, ASKED, WEIGHTS).select("file", F.col("start_line").cast("bigint").alias("start_line"), "retrieval_score", "is_primary")
