"""Queries on files, graphs, layers, risks and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import paths
from strata.operators import drift, evidence, graph, layers, risk, selection
from strata.queries import tables as t
from strata.queries.tables import Repository, sql
from strata.sources import files as source_files
from strata.sources import udtf

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _with(body: str, extra: str, *names: str) -> str:
    base = sql("", *names).rstrip()
    return f"{base},\n{extra}\n{body}"


_joined = lambda c: F.array_join(c, ",")

# --- edges and modules ---------------------------------------------------------------


@query(
    sql(
        "SELECT repo_id, node, sum(i)::BIGINT AS incoming, sum(o)::BIGINT AS outgoing, sum(i + o)::BIGINT AS total FROM (SELECT repo_id, source AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT repo_id, target, 1, 0 FROM edges) GROUP BY repo_id, node",
        "edges",
    )
)
def edge_degree_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(Repository(spark, sf, once=("lines", "edges")).edges)


@query(sql("SELECT repo_id, count(*) AS total_edges, count(DISTINCT source) AS files_with_dependencies, count(DISTINCT target) AS files_depended_on FROM edges GROUP BY repo_id", "edges"))
def edge_totals(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_summary(Repository(spark, sf, once=("lines", "edges")).edges)


@query(sql("SELECT repo_id, file, module_name, array_to_string(outs, ',') AS outs, array_to_string(ins, ',') AS ins, outgoing_count, incoming_count, total_connections FROM mods", "mods"))
def module_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    m = Repository(spark, sf, once=("edges", "modules")).modules
    return m.select("repo_id", "file", "module_name", _joined("outgoing_dependencies").alias("outs"), _joined("incoming_dependencies").alias("ins"), "outgoing_count", "incoming_count", "total_connections")


_DEGREE = """deg AS (SELECT p.repo_id, p.file AS id, count(e.f) AS degree FROM cprod p LEFT JOIN (SELECT repo_id, source AS f FROM cpairs UNION ALL SELECT repo_id, target FROM cpairs) e
    ON e.repo_id = p.repo_id AND e.f = p.file GROUP BY p.repo_id, p.file),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY degree DESC, id) AS rank FROM deg)"""


@query(
    _with(
        """SELECT repo_id, count(*) AS node_count, sum(degree)::BIGINT // 2 AS edge_count, count(*) FILTER (degree = 0) AS isolated_node_count,
        coalesce(string_agg(id, ',' ORDER BY id) FILTER (degree = 0), '') AS isolated_nodes, string_agg(id, ',' ORDER BY rank) FILTER (rank <= 5) AS top_connected_nodes FROM ranked GROUP BY repo_id""",
        _DEGREE, "cprod", "cpairs",
    )
)
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = Repository(spark, sf, "customer", once=("edges",)).modules
    g = graph.graph_summary(graph.graph_nodes(m), graph.graph_edges(m))
    return g.select("repo_id", "node_count", "edge_count", "isolated_node_count", _joined("isolated_nodes").alias("isolated_nodes"), _joined("top_connected_nodes").alias("top_connected_nodes"))


@query(_with("SELECT repo_id, id FROM deg WHERE degree = 0", _DEGREE, "cprod", "cpairs"))
def isolated_nodes(spark: SparkSession, sf: str) -> DataFrame:
    m = Repository(spark, sf, "customer", once=("edges",)).modules
    return graph.isolated(graph.graph_nodes(m), graph.graph_edges(m)).select("repo_id", "id")


@query(_with("SELECT repo_id, rank, id, degree FROM ranked WHERE rank <= 5", _DEGREE, "cprod", "cpairs"))
def top_connected(spark: SparkSession, sf: str) -> DataFrame:
    m = Repository(spark, sf, "customer", once=("edges",)).modules
    return graph.top_connected(graph.graph_nodes(m), graph.graph_edges(m))


_REACH = """hop AS (SELECT DISTINCT repo_id, source AS a, target AS b FROM cedges),
    reach AS (SELECT * FROM hop UNION SELECT r.repo_id, r.a, h.b FROM reach r JOIN hop h ON r.repo_id = h.repo_id AND r.b = h.a),
    both_ways AS (SELECT x.* FROM reach x JOIN reach y ON x.repo_id = y.repo_id AND x.a = y.b AND x.b = y.a),
    member AS (SELECT repo_id, a AS node, min(b) AS component FROM both_ways GROUP BY repo_id, a)"""


@query(_with("SELECT repo_id, node, component FROM member", _REACH, "cedges"))
def scc_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return graph.on_cycle(Repository(spark, sf, "customer", once=("lines",)).calls).select("repo_id", "node", "component")


@query(_with("SELECT repo_id, node, component FROM member", _REACH.replace("cedges", "edges"), "edges"))
def scc_distributed(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of nations by joins over the cluster, as for repositories too large for a task."""
    return graph.on_cycle(Repository(spark, sf, once=("lines",)).calls, 0).select("repo_id", "node", "component")


@query(
    _with(
        """SELECT repo_id, 'circular_dependency' AS signal, 'high' AS severity, 'Circular dependency detected across ' || count(*) || ' production modules: ' || string_agg(node, ', ' ORDER BY node) || '.' AS text
        FROM member GROUP BY repo_id, component HAVING count(*) >= 2""",
        _REACH, "cedges",
    )
)
def circular_claims(spark: SparkSession, sf: str) -> DataFrame:
    found = risk.circular_dependencies(Repository(spark, sf, "customer", once=("lines",)).calls)
    return risk.risk_claims(risk.union_signals(found)).select("repo_id", "signal", "severity", "text")


@query(
    _with(
        """SELECT DISTINCT r.repo_id, p.target AS id, 'outgoing' AS direction FROM ranked r JOIN cpairs p ON p.repo_id = r.repo_id AND p.source = r.id WHERE rank = 1
        UNION SELECT DISTINCT r.repo_id, p.source, 'incoming' FROM ranked r JOIN cpairs p ON p.repo_id = r.repo_id AND p.target = r.id WHERE rank = 1""",
        _DEGREE, "cprod", "cpairs",
    )
)
def one_hop_impact(spark: SparkSession, sf: str) -> DataFrame:
    r = Repository(spark, sf, "customer")
    top = graph.top_connected(graph.graph_nodes(r.modules), graph.graph_edges(r.modules), 1)
    return graph.neighbourhood(r.pairs, top.select("repo_id", "id")).select("repo_id", "id", "direction")


def _module_map(c: str) -> str:
    return f"""mm AS (SELECT repo_id, module_name, arg_max(file, (rank, file)) AS file FROM (
    SELECT repo_id, {t.module_sql('path')} AS module_name, path AS file, 0 AS rank FROM {c}sup WHERE path LIKE '%.py'
    UNION ALL SELECT repo_id, regexp_replace(split_part(path, '/', -1), '\\.py$', ''), max(path), 1 FROM {c}sup WHERE path LIKE '%.py' GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY repo_id, module_name)"""


@query(_with("SELECT repo_id, module_name, file FROM mm", _module_map(""), "sup"))
def module_map_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return graph.module_map(Repository(spark, sf, once=("lines",)).files)


def _imports(edges: DataFrame) -> DataFrame:
    """Statements that may give the edges, some more than once: plain, from a package, and relative ones."""
    name = paths.module_name(F.col("target"))
    package, own = F.regexp_replace(name, r"\.?[^.]*$", ""), F.regexp_extract(name, r"([^.]*)$", 1)
    way = F.substring("import", F.lit(2), F.length("import")).cast("bigint") % 3
    rows = edges.where(F.col("source").endswith(".py") & F.col("target").endswith(".py")).select("repo_id", "source", name.alias("n"), package.alias("p"), own.alias("o"), way.alias("w"))
    return rows.select(
        "repo_id", "source", F.when(F.col("w") == 0, "import").otherwise("from").alias("kind"), F.when(F.col("w") == 1, F.col("p")).alias("module"),
        F.when(F.col("w") == 2, 1).otherwise(0).alias("level"), F.array(F.when(F.col("w") == 0, F.col("n")).otherwise(F.col("o"))).alias("aliases"),
    )


def _resolution(c: str) -> str:
    return _with(
        "SELECT DISTINCT repo_id, source, file AS target, module_name AS import FROM cand JOIN mm USING (repo_id, module_name) WHERE source <> file",
        _module_map(c)
        + f""", st AS (SELECT repo_id, source, {t.module_sql('source')} AS sn, {t.module_sql('target')} AS n, substr(import, 2)::BIGINT % 3 AS w FROM {c}edges WHERE source LIKE '%.py' AND target LIKE '%.py'),
        cand AS (SELECT repo_id, source, n AS module_name FROM st WHERE w = 0
                 UNION ALL SELECT repo_id, source, regexp_replace(n, '\\.?[^.]*$', '') FROM st WHERE w = 1 AND contains(n, '.')
                 UNION ALL SELECT repo_id, source, n FROM st WHERE w = 1 AND contains(n, '.')
                 UNION ALL SELECT repo_id, source, CASE WHEN contains(sn, '.') THEN regexp_replace(sn, '\\.[^.]*$', '') || '.' ELSE '' END || regexp_extract(n, '([^.]*)$', 1) FROM st WHERE w = 2)""",
        f"{c}edges", f"{c}sup",
    )


@query(_resolution("c"))
def import_resolution(spark: SparkSession, sf: str) -> DataFrame:
    r = Repository(spark, sf, "customer", once=("edges",))
    return graph.resolve(graph.imported_names(_imports(r.edges).distinct()), graph.module_map(r.files)).select("repo_id", "source", "target", "import")


@query(_resolution(""))
def parsed_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Imports of nations' files, parsed from their sources by the table function in SQL, and resolved."""
    r, names = Repository(spark, sf, once=("edges", "files")), F.array_join("aliases", ", ")
    said = F.when(F.col("kind") == "import", F.concat(F.lit("import "), names)).otherwise(F.concat(F.lit("from "), F.repeat(F.lit("."), F.col("level")), F.coalesce("module", F.lit("")), F.lit(" import "), names))
    lines = _imports(r.edges).where("kind = 'import' or level > 0 or module != ''").select("repo_id", "source", said.alias("line"))
    sources = lines.groupBy("repo_id", F.col("source").alias("path")).agg(F.array_join(F.sort_array(F.collect_set("line")), "\n").alias("content"))
    udtf.register(spark)
    found = spark.sql("SELECT s.repo_id, s.path AS source, f.kind, f.module, f.level, f.aliases FROM {sources} s, LATERAL python_facts(s.content) f WHERE f.kind IN ('import', 'from')", sources=sources)
    return graph.resolve(graph.imported_names(found), graph.module_map(r.files)).select("repo_id", "source", "target", "import")


# --- files and layers ----------------------------------------------------------------


@query(sql(f"SELECT repo_id, path AS file, {t.layer_sql('path')} AS layer FROM sup UNION ALL SELECT repo_id, path, {t.layer_sql('path')} FROM files", "sup", "files"))
def layer_classify(spark: SparkSession, sf: str) -> DataFrame:
    docs = layers.classify(t.files(spark, sf).select("repo_id", "path"))
    return Repository(spark, sf).layers.unionByName(docs).select("repo_id", "file", "layer")


@query(sql(f"SELECT repo_id, {t.layer_sql('path')} AS layer, count(*) AS files FROM files GROUP BY ALL", "files"))
def layer_summary(spark: SparkSession, sf: str) -> DataFrame:
    return layers.summary(layers.classify(t.files(spark, sf)))


@query(sql(f"SELECT repo_id, layer, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY repo_id), 2) AS percentage FROM (SELECT repo_id, {t.layer_sql('path')} AS layer, count(*) AS n FROM files GROUP BY ALL)", "files"))
def layer_percentages(spark: SparkSession, sf: str) -> DataFrame:
    return layers.percentages(layers.classify(t.files(spark, sf)))


@query(sql("SELECT repo_id, count(*) AS total_files, count(*) FILTER (path LIKE '%.py') AS python_files FROM sup GROUP BY repo_id", "sup"))
def repository_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return source_files.metadata(Repository(spark, sf, once=("lines", "files")).files)


@query(sql("SELECT repo_id, path FROM sup WHERE path LIKE '%.py'", "sup"))
def relevant_files(spark: SparkSession, sf: str) -> DataFrame:
    return source_files.relevant(Repository(spark, sf, once=("lines", "files")).files).select("repo_id", "path")


_TREE = """tree AS (SELECT repo_id, path, parent, name, depth, bool_or(is_dir) AS is_dir FROM (SELECT repo_id, array_to_string(p[1:n], '/') AS path, array_to_string(p[1:n - 1], '/') AS parent, p[n] AS name, n AS depth, n < len(p) AS is_dir
    FROM (SELECT repo_id, string_split(path, '/') AS p, unnest(range(1, 1 + len(string_split(path, '/')))) AS n FROM sup)) GROUP BY ALL)"""


@query(_with("SELECT * FROM tree", _TREE, "sup"))
def file_tree_rows(spark: SparkSession, sf: str) -> DataFrame:
    return source_files.tree(Repository(spark, sf, once=("lines", "files")).files)


@query(_with("SELECT repo_id, parent, is_dir, name, repeat(' ', 2 * (depth - 1)) || name AS line FROM tree", _TREE, "sup"))
def printed_tree(spark: SparkSession, sf: str) -> DataFrame:
    return source_files.printed_tree(source_files.tree(Repository(spark, sf, once=("lines", "files")).files)).select("repo_id", "parent", "is_dir", "name", "line")


@query(sql(f"SELECT repo_id, path, CASE WHEN {t.layer_sql('path')} = 'test' THEN 'test' ELSE 'production' END AS code_class FROM sup WHERE path LIKE '%.py'", "sup"))
def code_classes(spark: SparkSession, sf: str) -> DataFrame:
    return source_files.relevant(Repository(spark, sf, once=("lines", "files")).files).select("repo_id", "path", paths.code_class(F.col("path")).alias("code_class"))


# --- risks ---------------------------------------------------------------------------

_HOT = """hot AS (SELECT repo_id, file, module_name, total_connections AS connection_count, incoming_count, outgoing_count,
    CASE WHEN total_connections >= 25 THEN 'critical' WHEN total_connections >= 15 THEN 'high' ELSE 'medium' END AS severity,
    'This module has ' || total_connections || ' dependency connections (' || incoming_count || ' incoming and ' || outgoing_count || ' outgoing). High connectivity may indicate that the module is highly coupled with other production modules.' AS reason
    FROM mods WHERE total_connections >= 8)"""
_ALLOWED = "allowed(a, b) AS (VALUES ('source','configuration'),('source','documentation'),('source','source'),('test','configuration'),('test','documentation'),('test','source'),('test','test'),('configuration','configuration'),('configuration','documentation'),('documentation','documentation'),('other','configuration'),('other','documentation'),('other','other'),('other','source'),('other','test'))"
_VIOLATIONS = f"viol AS (SELECT repo_id, source, target, import, source_layer, target_layer FROM (SELECT *, {t.layer_sql('source')} AS source_layer, {t.layer_sql('target')} AS target_layer FROM edges) WHERE (source_layer, target_layer) NOT IN (SELECT (a, b) FROM allowed))"
_UNTESTED = """wanted AS (SELECT repo_id, file, unnest(['tests/test_' || regexp_replace(split_part(file, '/', -1), '\\.py$', '') || '.py', 'tests/test_' || split_part(file, '/', 2) || '_' || regexp_replace(split_part(file, '/', -1), '\\.py$', '') || '.py',
    'tests/test_' || split_part(file, '/', 2) || '.py']) AS candidate FROM prod),
    untested AS (SELECT repo_id, file FROM prod WHERE (repo_id, file) NOT IN (SELECT (w.repo_id, w.file) FROM wanted w JOIN sup s ON s.repo_id = w.repo_id AND lower(s.path) = w.candidate))"""


@query(_with("SELECT * FROM hot", _HOT, "mods"))
def hotspot_signals(spark: SparkSession, sf: str) -> DataFrame:
    return risk.hotspots(Repository(spark, sf, once=("edges", "modules")).modules).select("repo_id", "file", "module_name", "connection_count", "incoming_count", "outgoing_count", "severity", "reason")


@query(_with("SELECT * FROM viol", _ALLOWED + ", " + _VIOLATIONS, "edges"))
def layer_violations(spark: SparkSession, sf: str) -> DataFrame:
    r = Repository(spark, sf)
    return risk.layer_violations(r.edges, r.layers).select("repo_id", "source", "target", "import", "source_layer", "target_layer")


@query(_with("SELECT repo_id, file FROM untested", _UNTESTED, "prod", "sup"))
def missing_test_counterpart(spark: SparkSession, sf: str) -> DataFrame:
    r = Repository(spark, sf)
    return risk.missing_test_counterparts(r.production, r.files).select("repo_id", "file")


_REFERRED = "SELECT repo_id, file, module_name FROM cmods WHERE (repo_id, file) NOT IN (SELECT (repo_id, target) FROM cedges WHERE source LIKE 'tests/%')"


def _references(r: Repository) -> DataFrame:
    return r.edges.where(F.col("source").startswith("tests/")).select("repo_id", F.col("target").alias("file"), paths.module_name(F.col("target")).alias("module_name"))


@query(sql(_REFERRED, "cmods", "cedges"))
def unreferenced_modules(spark: SparkSession, sf: str) -> DataFrame:
    r = Repository(spark, sf, "customer")
    return risk.unreferenced(r.modules, _references(r)).select("repo_id", "file", "module_name")


@query(sql(f"SELECT repo_id, module_name, 'Production module ' || module_name || ' (' || file || ') has no detected test reference.' AS text FROM ({_REFERRED})", "cmods", "cedges"))
def unreferenced_by_name(spark: SparkSession, sf: str) -> DataFrame:
    r = Repository(spark, sf, "customer")
    found = risk.unreferenced(r.modules, _references(r), "module_name")
    return found.select("repo_id", "module_name", risk.claim_text(found).alias("text"))


_SIGNALS = (
    ", ".join((_HOT, _ALLOWED, _VIOLATIONS, _UNTESTED))
    + """, signals AS (SELECT repo_id, 'architecture' AS category, 'high_connectivity' AS signal, severity, module_name || ' has ' || connection_count || ' dependency connections. ' || reason AS text FROM hot
    UNION ALL SELECT repo_id, 'architecture', 'layer_violation', 'medium', 'Architecture layer violation detected: ' || source || ' (' || source_layer || ') depends on ' || target || ' (' || target_layer || ').' FROM viol
    UNION ALL SELECT repo_id, 'testing', 'missing_test_counterpart', 'medium', 'Production module ' || file || ' has no detected test counterpart.' FROM untested)"""
)
_ON = ("mods", "edges", "sup", "prod")


@query(_with("SELECT repo_id, upper(severity) AS severity, count(*) AS signals FROM signals GROUP BY ALL", _SIGNALS, *_ON))
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return risk.severity_counts(Repository(spark, sf).signals)


@query(_with("SELECT repo_id, CASE WHEN severity IN ('high', 'critical') THEN 'HIGH' ELSE upper(severity) END AS severity, count(*) AS signals FROM signals GROUP BY ALL", _SIGNALS, *_ON))
def overview_severities(spark: SparkSession, sf: str) -> DataFrame:
    return Repository(spark, sf).signals.groupBy("repo_id", risk.overview_severity(F.col("severity")).alias("severity")).agg(F.count("*").alias("signals"))


@query(_with("SELECT repo_id, category, count(*) AS signals, count(*) FILTER (severity IN ('high', 'critical')) AS high_risk FROM signals GROUP BY ALL", _SIGNALS, *_ON))
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return risk.category_counts(Repository(spark, sf).signals)


@query(_with("SELECT category, severity, count(*) AS signals FROM signals GROUP BY ROLLUP (category, severity)", _SIGNALS, *_ON))
def category_severity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return risk.category_severity_rollup(Repository(spark, sf).signals)


@query(_with("SELECT repo_id, category, signal, severity, text FROM signals", _SIGNALS, *_ON))
def risk_claims(spark: SparkSession, sf: str) -> DataFrame:
    return risk.risk_claims(Repository(spark, sf).signals).select("repo_id", "category", "signal", "severity", "text")


@query(_with("SELECT repo_id, count(*) AS signal_count, count(text) AS claim_count, round(count(text)::DOUBLE / count(*), 4) AS coverage FROM signals GROUP BY repo_id", _SIGNALS, *_ON))
def risk_report(spark: SparkSession, sf: str) -> DataFrame:
    return risk.risk_report(Repository(spark, sf).signals)


_SECRETS = """secrets AS (SELECT repo_id, path AS file, 'auth_' || unnest(regexp_extract_all(content, '(token|password) *= *"?([0-9a-z]+)', 1)) AS name, unnest(regexp_extract_all(content, '(token|password) *= *"?([0-9a-z]+)', 2)) AS v FROM files),
    exposed AS (SELECT repo_id, file, name FROM secrets WHERE v NOT IN ('dummy', 'example', 'secret', 'test') AND NOT (list_has_any(string_split(lower(file), '/'), ['test', 'tests'])
    OR lower(split_part(file, '/', -1)) LIKE 'test\\_%' ESCAPE '\\' OR lower(split_part(file, '/', -1)) LIKE '%\\_test.py' ESCAPE '\\' OR contains(lower(split_part(file, '/', -1)), 'example')))"""


def _assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Assignments in documents' texts."""
    shape = r'(token|password) *= *"?([0-9a-z]+)'
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(shape), F.lit(1)).alias("n"), F.regexp_extract_all("content", F.lit(shape), F.lit(2)).alias("v"))
    rows = t.files(spark, sf).select("repo_id", F.col("path").alias("file"), F.explode(both).alias("x"))
    return rows.select("repo_id", "file", F.lit(1).alias("line"), F.concat(F.lit("auth_"), F.col("x.n")).alias("name"), F.col("x.v").alias("value"))


@query(_with("SELECT repo_id, file, name FROM exposed", _SECRETS, "files"))
def hardcoded_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in one of the languages are test files, which the detector passes over."""
    return risk.hardcoded_secrets(_assignments(spark, sf)).select("repo_id", "file", "name")


@query("SELECT 'src/u' || user_id || '.py' AS file, event_id AS line, CASE event_type WHEN 'error' THEN 'eval' ELSE 'exec' END AS function FROM events WHERE event_type IN ('error', 'signup')")
def dynamic_exec(spark: SparkSession, sf: str) -> DataFrame:
    return risk.dynamic_execution(_calls(spark, sf)).select("file", "line", "function")


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    e = t.read(spark, sf, "events")
    name = F.when(F.col("event_type") == "error", "eval").when(F.col("event_type") == "signup", "exec").otherwise("print")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo_id"), F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("file"), F.col("event_id").alias("line"), name.alias("function"))


@query(sql("SELECT repo_id, file, module_name FROM mods WHERE total_connections % 2 = 0", "mods"))
def missing_docs(spark: SparkSession, sf: str) -> DataFrame:
    m = Repository(spark, sf).modules.withColumn("has_docstring", F.col("total_connections") % 2 == 1)
    return risk.missing_documentation(m).select("repo_id", "file", "module_name")


_LOST = f"lost AS (SELECT DISTINCT repo_id, source AS file, {t.module_sql('target')} || '_x' AS module FROM edges WHERE substr(import, 2)::BIGINT % 4 = 0)"


def _import_records(r: Repository) -> DataFrame:
    lost = F.substring("import", F.lit(2), F.length("import")).cast("bigint") % 4 == 0
    name = F.when(lost, F.concat(paths.module_name(F.col("target")), F.lit("_x"))).otherwise(paths.module_name(F.col("target")))
    return r.edges.select("repo_id", F.col("source").alias("file"), name.alias("imported_module"), F.lit(True).alias("is_internal"), (~lost).alias("is_resolved")).distinct()


@query(_with("SELECT * FROM lost", _LOST, "edges"))
def unresolved_imports(spark: SparkSession, sf: str) -> DataFrame:
    return risk.unresolved_imports(_import_records(Repository(spark, sf))).select("repo_id", "file", "module")


@query(
    _with(
        """SELECT repo_id, 'security' AS category, 'possible_hardcoded_secret' AS signal, 'high' AS severity, 'Possible hardcoded secret detected in ' || file || '.' AS text FROM exposed
        UNION ALL SELECT 'u' || user_id, 'security', 'dynamic_code_execution', 'high', 'Dynamic code execution detected in src/u' || user_id || '.py within function ' || CASE event_type WHEN 'error' THEN 'eval' ELSE 'exec' END || '.' FROM events WHERE event_type IN ('error', 'signup')
        UNION ALL SELECT repo_id, 'documentation', 'missing_module_documentation', 'medium', 'Production module ' || module_name || ' (' || file || ') has no detected module documentation.' FROM mods WHERE total_connections % 2 = 0
        UNION ALL SELECT repo_id, 'dependency', 'unresolved_internal_import', 'medium', 'Unresolved internal dependency detected for module ' || module || '.' FROM lost
        UNION ALL SELECT repo_id, 'testing', 'missing_test_counterpart', 'medium', 'Production module ' || file || ' has no detected test counterpart.' FROM untested""",
        ", ".join((_SECRETS, _LOST, _UNTESTED)), "files", "mods", "edges", "prod", "sup",
    )
)
def detector_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of the detectors that read sources, in one relation."""
    r = Repository(spark, sf)
    m = r.modules.withColumn("has_docstring", F.col("total_connections") % 2 == 1)
    found = risk.union_signals(
        risk.hardcoded_secrets(_assignments(spark, sf)), risk.dynamic_execution(_calls(spark, sf)), risk.missing_documentation(m),
        risk.unresolved_imports(_import_records(r)), risk.missing_test_counterparts(r.production, r.files),
    )
    return risk.risk_claims(risk.normalise(found)).select("repo_id", "category", "signal", "severity", "text")


@query(
    _with(
        """SELECT 'security' AS surface, repo_id, signal, file, line, NULL AS module_name FROM (SELECT DISTINCT repo_id, 'possible_hardcoded_secret' AS signal, file, 1::BIGINT AS line FROM exposed)
        UNION ALL SELECT 'security', 'u' || user_id, 'dynamic_code_execution', 'src/u' || user_id || '.py', event_id, NULL FROM events WHERE event_type IN ('error', 'signup')
        UNION ALL SELECT 'testing', repo_id, 'missing_test_counterpart', file, NULL, replace(regexp_replace(regexp_replace(file, '\\.py$', ''), '^src/', ''), '/', '.') FROM untested""",
        _SECRETS + ", " + _UNTESTED, "files", "prod", "sup",
    )
)
def risk_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    """Security and testing signals without repeats; every signal comes twice."""
    r = Repository(spark, sf)
    found = risk.union_signals(risk.hardcoded_secrets(_assignments(spark, sf)), risk.dynamic_execution(_calls(spark, sf)), risk.missing_test_counterparts(r.production, r.files))
    twice = found.union(found).withColumn("line", F.col("line").cast("bigint"))
    parts = [risk.surface(twice, kind).select(F.lit(kind).alias("surface"), "repo_id", "signal", "file", "line", F.col("module_name") if kind == "testing" else F.lit(None).cast("string").alias("module_name")) for kind in ("security", "testing")]
    return parts[0].union(parts[1])


# --- drift ---------------------------------------------------------------------------

_DRIFT = """a AS (SELECT * FROM snapmods WHERE was), b AS (SELECT * FROM snapmods WHERE NOT was),
    md AS (SELECT repo_id, file, CASE WHEN a.was IS NULL THEN 'added' WHEN b.was IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (repo_id, file)),
    dd AS (SELECT repo_id, file, array_to_string(list_sort(list_filter(b.deps, lambda x: NOT list_contains(a.deps, x))), ',') AS added, array_to_string(list_sort(list_filter(a.deps, lambda x: NOT list_contains(b.deps, x))), ',') AS removed FROM a JOIN b USING (repo_id, file) WHERE list_sort(a.deps) <> list_sort(b.deps)),
    ld AS (SELECT repo_id, file, a.layer AS baseline_layer, b.layer AS current_layer FROM a JOIN b USING (repo_id, file) WHERE a.layer <> b.layer)"""


@query(_with("SELECT * FROM md", _DRIFT, "snapmods"))
def drift_modules(spark: SparkSession, sf: str) -> DataFrame:
    return drift.module_drift(*t.snapshot_modules(spark, sf))


@query(_with("SELECT * FROM dd", _DRIFT, "snapmods"))
def drift_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return drift.dependency_drift(*t.snapshot_modules(spark, sf)).select("repo_id", "file", _joined("added").alias("added"), _joined("removed").alias("removed"))


@query(_with("SELECT * FROM ld", _DRIFT, "snapmods"))
def drift_layers(spark: SparkSession, sf: str) -> DataFrame:
    return drift.layer_drift(*t.snapshot_modules(spark, sf))


@query(_with("SELECT repo_id, 'architecture_drift' AS signal, 'medium' AS severity, 'Architecture drift detected: production module ' || file || ' was removed between snapshots.' AS text FROM md WHERE change = 'removed'", _DRIFT, "snapmods"))
def drift_claims(spark: SparkSession, sf: str) -> DataFrame:
    found = risk.removed_modules(drift.module_drift(*t.snapshot_modules(spark, sf)))
    return risk.risk_claims(risk.union_signals(found)).select("repo_id", "signal", "severity", "text")


_s = lambda n: f"CASE WHEN {n} = 1 THEN ' module' ELSE ' modules' END"


@query(
    _with(
        f"""SELECT repo_id, added, removed, unchanged, c AS changed_dependencies, l AS changed_layers, added + removed + c + l > 0 AS has_drift, 'ready' AS status,
        CASE WHEN added + removed + c + l = 0 THEN 'No architecture drift detected.' ELSE (added + removed) || {_s('added + removed')} || ' changed (' || added || {_s('added')} || ' added, ' || removed || {_s('removed')}
        || ' removed), ' || c || {_s('c')} || ' have dependency changes, and ' || l || {_s('l')} || ' have layer changes.' END AS summary
        FROM (SELECT repo_id, added, removed, unchanged, coalesce(c, 0) AS c, coalesce(l, 0) AS l FROM
        (SELECT repo_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged FROM md GROUP BY repo_id)
        LEFT JOIN (SELECT repo_id, count(*) AS c FROM dd GROUP BY repo_id) USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) AS l FROM ld GROUP BY repo_id) USING (repo_id))""",
        _DRIFT, "snapmods",
    )
)
def drift_summary(spark: SparkSession, sf: str) -> DataFrame:
    return drift.report(*t.snapshot_modules(spark, sf))


@query(
    """SELECT r AS repo_id, max(CASE WHEN age = 2 THEN p END) AS baseline, CASE WHEN max(CASE WHEN age = 2 THEN p END) IS NOT NULL THEN max(CASE WHEN age = 1 THEN p END) END AS current FROM
    (SELECT r, p, row_number() OVER (PARTITION BY r ORDER BY ts DESC, p DESC) AS age FROM (SELECT DISTINCT 'c' || (o_custkey % 97) AS r, 'snaps/snapshot_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.json' AS p, date_trunc('second', o_orderdate) AS ts FROM orders)) WHERE age <= 2 GROUP BY r"""
)
def snapshot_pair(spark: SparkSession, sf: str) -> DataFrame:
    o = t.read(spark, sf, "orders")
    name = F.concat(F.lit("snaps/snapshot_"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.lit(".json"))
    return drift.pair(o.select(F.concat(F.lit("c"), (F.col("o_custkey") % 97).cast("string")).alias("repo_id"), name.alias("path")).distinct())


# --- facts ---------------------------------------------------------------------------


@query(
    sql(
        " UNION ALL ".join(
            f"SELECT repo_id, '{k}' AS kind, row_number() OVER (PARTITION BY repo_id ORDER BY {c} DESC, module_name) AS rank, module_name, {c} AS value FROM mods"
            for k, c in (("total", "total_connections"), ("outgoing", "outgoing_count"), ("incoming", "incoming_count"))
        ),
        "mods",
    )
)
def module_ranking(spark: SparkSession, sf: str) -> DataFrame:
    m = Repository(spark, sf).modules
    kinds = {"total": "total_connections", "outgoing": "outgoing_count", "incoming": "incoming_count"}
    parts = [evidence.ranked_facts(m, by).select("repo_id", F.lit(k).alias("kind"), "rank", "module_name", "value") for k, by in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(sql("SELECT repo_id, module_name, total_connections FROM cmods m WHERE total_connections = (SELECT min(total_connections) FROM cmods x WHERE x.repo_id = m.repo_id)", "cmods"))
def rank_extrema_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.least_connected(Repository(spark, sf, "customer").modules)


@query(sql("SELECT repo_id, module_name, total_connections FROM cmods WHERE total_connections = 4", "cmods"))
def exact_count_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.with_connections(Repository(spark, sf, "customer").modules, 4)


_OVERVIEW = "ov AS (SELECT repo_id, total_files, python_files, python_files AS relevant_file_count, coalesce(production_module_count, 0) AS production_module_count, coalesce(dependency_edge_count, 0) AS dependency_edge_count, coalesce(architecture_edge_count, 0) AS architecture_edge_count, coalesce(risk_signal_count, 0) AS risk_signal_count FROM (SELECT repo_id, count(*) AS total_files, count(*) FILTER (path LIKE '%.py') AS python_files FROM sup GROUP BY repo_id)" + "".join(
    f" LEFT JOIN (SELECT repo_id, count(*) AS {n} FROM {r} GROUP BY repo_id) USING (repo_id)" for n, r in (("production_module_count", "mods"), ("dependency_edge_count", "edges"), ("architecture_edge_count", "pairs"), ("risk_signal_count", "signals"))
) + ")"


@query(_with("SELECT * FROM ov", _SIGNALS + ", " + _OVERVIEW, *_ON, "pairs"))
def repository_overview(spark: SparkSession, sf: str) -> DataFrame:
    return Repository(spark, sf).overview


@query(
    _with(
        "SELECT repo_id, k AS metadata_key, label, v AS value, 'The repository contains ' || v || ' ' || label || '.' AS content FROM ("
        + " UNION ALL ".join(
            f"SELECT repo_id, '{k}' AS k, '{label}' AS label, {k} AS v FROM ov"
            for k, label in (("total_files", "total files"), ("python_files", "Python files"), ("relevant_file_count", "relevant files"), ("production_module_count", "production modules"), ("dependency_edge_count", "dependency edges"), ("architecture_edge_count", "architecture edges"), ("risk_signal_count", "risk signals"))
        )
        + ")",
        _SIGNALS + ", " + _OVERVIEW, *_ON, "pairs",
    )
)
def metadata_facts(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.metadata_facts(Repository(spark, sf).overview)


_LOOKUP = """own AS (SELECT *, list_transform(list_filter(string_split(translate(lower(module_name || ' ' || file), './_', '   '), ' '), lambda x: x <> ''), lambda x: CASE WHEN x LIKE '%s' AND len(x) > 3 THEN left(x, -1) ELSE x END) AS tok FROM mods),
    met AS (SELECT *, len(list_intersect(list_distinct(tok), ['pkg1', 's1', 'dependencie'])) AS shared, (contains('pkg1.s1 dependencies', module_name))::BIGINT AS exact FROM own)"""


@query(_with("SELECT repo_id, module_name, file, total_connections, exact, shared FROM met WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY exact DESC, shared DESC, total_connections DESC, module_name) <= 5", _LOOKUP, "mods"))
def architecture_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.lookup_modules(Repository(spark, sf).modules, "pkg1.s1 dependencies").select("repo_id", "module_name", "file", "total_connections", "exact", "shared")


# --- displays ------------------------------------------------------------------------


@query(sql("SELECT m.repo_id, m.module_name, coalesce(n.module_name, d) AS dependency FROM (SELECT repo_id, module_name, unnest(outs) AS d FROM mods) m LEFT JOIN mods n ON n.repo_id = m.repo_id AND n.file = d", "mods"))
def dependency_labels(spark: SparkSession, sf: str) -> DataFrame:
    return selection.dependency_labels(Repository(spark, sf).modules)


_SEARCHED = {"all": "contains(lower(source), 'pkg1') OR contains(lower(target), 'pkg1') OR contains(lower(import), 'pkg1')", "incoming": "contains(lower(target), 'pkg1')", "outgoing": "contains(lower(source), 'pkg1')"}


@query(sql(" UNION ALL ".join(f"SELECT '{d}' AS direction, repo_id, source, target, import FROM edges WHERE {w}" for d, w in _SEARCHED.items()), "edges"))
def edge_search(spark: SparkSession, sf: str) -> DataFrame:
    e = Repository(spark, sf).edges
    parts = [selection.search_edges(e, "PKG1", d).select(F.lit(d).alias("direction"), "repo_id", "source", "target", "import") for d in _SEARCHED]
    return parts[0].union(parts[1]).union(parts[2])


@query(sql("SELECT repo_id, module_name, total_connections FROM mods QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY total_connections DESC, module_name) <= 8", "mods"))
def top_modules(spark: SparkSession, sf: str) -> DataFrame:
    return selection.top_modules(Repository(spark, sf).modules)


@query(sql("SELECT repo_id, file, row_number() OVER (PARTITION BY repo_id ORDER BY 'source', total_connections DESC, file) AS place FROM mods", "mods"))
def radial_order(spark: SparkSession, sf: str) -> DataFrame:
    return selection.radial_order(Repository(spark, sf).modules)


@query(
    _with(
        "SELECT repo_id, (total_files > 0)::BIGINT + (production_module_count > 100)::BIGINT + (dependency_edge_count > 0)::BIGINT + (architecture_edge_count > 1000)::BIGINT + (risk_signal_count > 0)::BIGINT AS present, 5::BIGINT AS total FROM ov",
        _SIGNALS + ", " + _OVERVIEW, *_ON, "pairs",
    )
)
def artifact_scores(spark: SparkSession, sf: str) -> DataFrame:
    o = Repository(spark, sf).overview
    there = {"metadata": F.col("total_files") > 0, "production_modules": F.col("production_module_count") > 100, "layers": F.col("dependency_edge_count") > 0, "graph": F.col("architecture_edge_count") > 1000, "risks": F.col("risk_signal_count") > 0}
    return selection.artifact_score(o.select("repo_id", *(c.alias(n) for n, c in there.items())))
