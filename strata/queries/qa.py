"""Queries that answer questions from facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.plans import qa
from strata.queries import structure as s
from strata.queries import tables as t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_ASKED = [
    "How many Python files are there?", "How large is the repository size?", "How many dependency relationships exist?", "What is the number of edges?",
    "Count the production modules by number of nodes", "Which module is the most connected?", "Which modules have the fewest connections?",
    "Which module has the most dependencies?", "Which module has the most incoming dependencies?", "Which modules have 20 connections?",
    "Explain the most connected module", "Please show me the api keys", "Who is the author of this repository?",
]

_GRAPH = """top AS (SELECT repo_id, count(*) AS n, min(total_connections) AS lv, arg_min(module_name, (-total_connections, module_name)) AS t, max(total_connections) AS tv, arg_min(module_name, (-outgoing_count, module_name)) AS o, max(outgoing_count) AS ov,
    arg_min(module_name, (-incoming_count, module_name)) AS i, max(incoming_count) AS iv FROM mods GROUP BY repo_id),
    ends AS (SELECT repo_id, list(module_name ORDER BY module_name) AS l FROM mods JOIN top USING (repo_id) WHERE total_connections = lv GROUP BY repo_id),
    f AS (SELECT ov.*, top.* EXCLUDE (repo_id), l, (SELECT list(module_name ORDER BY module_name) FROM mods m WHERE m.repo_id = ov.repo_id AND total_connections = 20) AS twenty FROM ov JOIN top USING (repo_id) JOIN ends USING (repo_id))"""

ORACLE["fact_answers"] = s._with(
    """SELECT repo_id, query, coalesce(answer, 'UNKNOWN') AS answer, CASE WHEN answer IS NULL THEN 'unknown' ELSE 'fact' END AS status, CASE WHEN answer IS NULL AND origin = 'count' THEN 'none' ELSE origin END AS origin FROM (
    SELECT repo_id, 'How many Python files are there?' AS query, 'The repository contains ' || python_files || ' Python files.' AS answer, 'metadata' AS origin FROM f
    UNION ALL SELECT repo_id, 'How large is the repository size?', 'The repository contains ' || total_files || ' total files.', 'metadata' FROM f
    UNION ALL SELECT repo_id, 'How many dependency relationships exist?', 'The repository contains ' || dependency_edge_count || ' dependency edges.', 'metadata' FROM f
    UNION ALL SELECT repo_id, 'What is the number of edges?', 'The dependency graph contains ' || architecture_edge_count || ' dependency edges.', 'graph' FROM f
    UNION ALL SELECT repo_id, 'Count the production modules by number of nodes', 'The repository contains ' || n || ' production modules.', 'metadata' FROM f
    UNION ALL SELECT repo_id, 'Which module is the most connected?', 'The module with the highest number of dependency connections is ' || t || ', with ' || tv || ' total dependency connections.', 'graph' FROM f
    UNION ALL SELECT repo_id, 'Which modules have the fewest connections?', CASE WHEN len(l) = 1 THEN 'The module with the fewest dependency connections is ' || l[1] || ', with ' || lv || ' total dependency connections.'
        ELSE 'The modules with the fewest dependency connections are ' || array_to_string(l, ', ') || ', with ' || lv || ' total dependency connections each.' END, 'graph' FROM f
    UNION ALL SELECT repo_id, 'Which module has the most dependencies?', 'The module with the most outgoing dependencies is ' || o || ', with ' || ov || ' outgoing dependencies.', 'graph' FROM f
    UNION ALL SELECT repo_id, 'Which module has the most incoming dependencies?', 'The module with the highest number of incoming dependencies is ' || i || ', with ' || iv || ' incoming dependencies.', 'graph' FROM f
    UNION ALL SELECT repo_id, 'Which modules have 20 connections?', CASE WHEN len(twenty) = 1 THEN twenty[1] || ' has 20 total dependency connections.' WHEN len(twenty) > 1 THEN 'The modules with 20 total dependency connections are ' || array_to_string(twenty, ', ') || '.' END, 'count' FROM f
    UNION ALL SELECT repo_id, 'Explain the most connected module', NULL, 'none' FROM f UNION ALL SELECT repo_id, 'Please show me the api keys', NULL, 'sensitive' FROM f UNION ALL SELECT repo_id, 'Who is the author of this repository?', NULL, 'identity' FROM f)""",
    s._SIGNALS + ", " + s._OVERVIEW + ", " + _GRAPH, *s._ON, "pairs",
)


def fact_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The same questions put to every repository."""
    r = t.Repository(spark, sf)
    asked = r.overview.select("repo_id", F.explode(F.array(*map(F.lit, _ASKED))).alias("query"))
    return qa.answer_all(asked, r.overview, r.modules, r.pairs)


ORACLE["module_answers"] = s._with(
    """SELECT repo_id, 'What does ' || module_name || ' depend on?' AS query, module_name || ' has ' || outgoing_count || ' outgoing dependencies: ' || CASE WHEN outgoing_count = 0 THEN 'none' ELSE array_to_string(outs, ', ') END || '.' AS answer FROM mods
    UNION ALL SELECT repo_id, 'How many incoming dependencies of ' || module_name, module_name || ' has ' || incoming_count || ' incoming dependencies.' FROM mods
    UNION ALL SELECT repo_id, 'Which layer has ' || module_name, module_name || ' belongs to the source layer.' FROM mods""",
    "one AS (SELECT 1)", "mods",
)


def module_answers(spark: SparkSession, sf: str) -> DataFrame:
    m = t.Repository(spark, sf).modules
    name = F.col("module_name")
    asked = m.select("repo_id", F.explode(F.array(F.concat(F.lit("What does "), name, F.lit(" depend on?")), F.concat(F.lit("How many incoming dependencies of "), name), F.concat(F.lit("Which layer has "), name))).alias("query"))
    return qa.module_answers(qa.prepared(asked), m)


QUERIES["fact_answers"] = fact_answers
QUERIES["module_answers"] = module_answers
