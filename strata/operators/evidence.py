"""Evidence from modules, metadata and code: facts, lookups, selection, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import text, vocab
from strata.functions.text import words
from strata.operators.graph import KEY
from strata.storage import materialize


def ranked_facts(modules: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """(repo_id, rank, module_name, value) by total_connections, outgoing_count or incoming_count, names breaking ties."""
    order = Window.partitionBy(KEY).orderBy(F.desc(by), "module_name")
    ranked = modules.select(KEY, F.row_number().over(order).cast("bigint").alias("rank"), "module_name", F.col(by).alias("value"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def least_connected(modules: DataFrame) -> DataFrame:
    """All modules at the least total, so ties are kept."""
    low = modules.groupBy(KEY).agg(F.min("total_connections").alias("low"))
    return modules.join(low, KEY).where("total_connections = low").select(KEY, "module_name", "total_connections")


def with_connections(modules: DataFrame, n: int) -> DataFrame:
    return modules.where(F.col("total_connections") == n).select(KEY, "module_name", "total_connections")


def lookup_modules(modules: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Each repository's k modules whose words meet the query's: by exact name, shared words, connections and name."""
    asked = text.architecture_tokens(F.lit(query))
    own = text.architecture_tokens(F.concat_ws(" ", "module_name", "file"))
    shared = F.size(F.array_intersect(asked, own)).cast("bigint")
    exact = F.lit(query.lower()).contains(F.lower("module_name")).cast("bigint")
    found = modules.select(KEY, "module_name", "file", "total_connections", exact.alias("exact"), shared.alias("shared")).where("shared > 0")
    order = Window.partitionBy(KEY).orderBy(F.desc("exact"), F.desc("shared"), F.desc("total_connections"), "module_name")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def overview(files: DataFrame, edges: DataFrame, modules: DataFrame, module_edges: DataFrame, signals: DataFrame) -> DataFrame:
    """One row a repository with the seven counts of its artifacts."""
    from strata.functions import paths

    counts = files.groupBy(KEY).agg(
        F.count("*").alias("total_files"), F.count_if(paths.suffix(F.col("path")) == ".py").alias("python_files"), F.count_if(paths.is_relevant(F.col("path"))).alias("relevant_file_count")
    )
    more = {"production_module_count": modules, "dependency_edge_count": edges, "architecture_edge_count": module_edges, "risk_signal_count": signals}
    for name, df in more.items():
        counts = counts.join(df.groupBy(KEY).agg(F.count("*").alias(name)), KEY, "left")
    return counts.select(KEY, "total_files", "python_files", "relevant_file_count", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in more))


def metadata_facts(counts: DataFrame) -> DataFrame:
    """(repo_id, metadata_key, label, value, content) rows of the counts that are there and not negative."""
    entries = F.array(*(F.struct(F.lit(k).alias("metadata_key"), F.lit(label).alias("label"), F.col(k).cast("bigint").alias("value")) for k, (label, _) in vocab.METADATA_SPECS.items()))
    rows = counts.select(KEY, F.explode(entries).alias("e")).select(KEY, "e.*").where("value >= 0")
    return rows.withColumn("content", F.concat(F.lit("The repository contains "), F.col("value").cast("string"), F.lit(" "), F.col("label"), F.lit(".")))


def metadata_keys(query: Column) -> Column:
    """Array of the metadata keys whose words a query has."""
    asked = text.metadata_tokens(query)
    has = lambda alternatives: F.exists(F.array(*(words(a.split()) for a in alternatives)), lambda a: F.size(F.array_except(a, asked)) == 0)
    return F.filter(F.array(*(F.when(has(a), F.lit(k)) for k, (_, a) in vocab.METADATA_SPECS.items())), lambda k: k.isNotNull())


def unique_metadata_key(query: Column) -> Column:
    """The only key that matches, or null."""
    keys = metadata_keys(query)
    return F.when(F.size(keys) == 1, keys[0])


def is_valid_reference(e: DataFrame) -> Column:
    """Whether evidence keeps its contract: code needs a file and lines in order, architecture a module."""
    lines = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))
    code = (F.col("evidence_type") == "code") & (F.btrim("file") != "") & lines
    architecture = (F.col("evidence_type") == "architecture") & (F.btrim("module_name") != "")
    return F.coalesce(code, F.lit(False)) | F.coalesce(architecture, F.lit(False))


def context_score(query_tokens: Column, content: Column, file: Column, symbols: Column) -> tuple[Column, Column, Column, Column]:
    """Shared words with content, file and symbols, and content + 5 file + 3 symbol."""
    hits = [F.size(F.array_intersect(query_tokens, text.selector_forms(text.selector_tokens(c)))) for c in (content, file, symbols)]
    return (*hits, hits[0] + 5 * hits[1] + 3 * hits[2])


def _possible(chunks: DataFrame, asked: list[str]) -> DataFrame:
    """Chunks that may share a word's form with the asked ones, by their letters alone, before any is cut into tokens.

    A token is a stretch of lower-case text; what has an asked form is that form, with or without further letters, or
    all but its last letter (plurals in -ies, or the form's own -s), or a word with that alias.
    """
    needles = {n for a in asked for n in (a, a[:-1]) if n} | {k for k, aliases in vocab.SELECTOR_ALIASES.items() if set(asked) & set(aliases)}
    # What holds a needle's beginning is looked for once.
    needles = sorted(n for n in needles if not any(n != m and m in n for m in needles))
    found = F.lit(False)
    for column in ("content", "file", "symbol_names"):
        low = F.lower(column)
        for n in needles:
            found = found | low.contains(n)
    return chunks.where(found)


def _asked_forms(spark: SparkSession, query: str) -> list[str]:
    return list(spark.range(1).select(text.selector_forms(text.selector_tokens(F.lit(query))).alias("a")).first().a)


def diverse_code(chunks: DataFrame, query: str, k: int = 6) -> DataFrame:
    """Code evidence for a claim: best chunk of each file first, then the rest, at most k.

    Chunks that share words with the query in their file or symbols come alone
    where there are any.  ``chunks`` has file, start_line, content, symbol_names and pos.
    """
    forms = _asked_forms(chunks.sparkSession, query)
    chunks, asked = _possible(chunks, forms), words(forms)
    content, in_file, symbol, _ = context_score(asked, F.col("content"), F.col("file"), F.col("symbol_names"))
    scored = chunks.select("file", "start_line", "pos", content.alias("content_hits"), in_file.alias("file_hits"), symbol.alias("symbol_hits"))
    scored = scored.withColumn("score", (F.col("content_hits") + 8 * F.col("file_hits") + 5 * F.col("symbol_hits")).cast("bigint")).where("score > 0")
    scored = materialize(scored, "code-hits")  # read twice, so that texts are scored once
    structural = (F.col("file_hits") + F.col("symbol_hits")) > 0
    any_structural = scored.agg(F.bool_or(structural).alias("some"))  # a single row
    kept = scored.crossJoin(F.broadcast(any_structural)).where(structural | ~F.coalesce("some", F.lit(False)))
    within = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "pos", "start_line"))
    ranked = kept.withColumn("again", (within > 1).cast("int"))
    return ranked.orderBy("again", F.desc("score"), "pos", "file", "start_line").limit(k).select("file", "start_line", "score", F.col("again").cast("bigint").alias("again"))


def structural_first(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """Code for an answer's context, in order: symbol hits, file hits, their numbers, content hits, score, retrieval score.

    Chunks that only share words of their content count where none shares its
    file's or a symbol's.  ``chunks`` has file, start_line, content, symbol_names,
    retrieval_score and pos, which breaks ties.
    """
    forms = _asked_forms(chunks.sparkSession, query)
    chunks, asked = _possible(chunks, forms), words(forms)
    content, in_file, symbol, score = context_score(asked, F.col("content"), F.col("file"), F.col("symbol_names"))
    scored = chunks.withColumns({"_c": content, "_f": in_file, "_s": symbol, "context_score": score.cast("bigint")}).where("context_score > 0")
    scored = materialize(scored, "code-hits")
    structural = (F.col("_f") + F.col("_s")) > 0
    # One row: whether any chunk is structural.
    some = scored.agg(F.coalesce(F.bool_or(structural), F.lit(False)).alias("_some"))
    kept = scored.crossJoin(F.broadcast(some)).where(structural | ~F.col("_some"))
    order = [(F.col("_s") > 0).cast("int"), (F.col("_f") > 0).cast("int"), F.col("_s"), F.col("_f"), F.col("_c"), F.col("context_score"), F.coalesce("retrieval_score", F.lit(0.0))]
    return kept.orderBy(*(c.desc() for c in order), "pos").limit(k).drop("_c", "_f", "_s", "_some")


def graph_evidence(modules: DataFrame, k: int = 5) -> DataFrame:
    """One graph_summary row a repository, ranked anew from its modules: counts and the k first names each way."""
    ranked, kinds = modules, {"total_connections": "top_connected", "outgoing_count": "top_outgoing", "incoming_count": "top_incoming"}
    for by in kinds:
        ranked = ranked.withColumn(f"_{by}", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(by), "module_name")))
    names = lambda by: F.transform(F.sort_array(F.collect_list(F.when(F.col(f"_{by}") <= k, F.struct(f"_{by}", "module_name")))), lambda x: x["module_name"])
    return ranked.groupBy(KEY).agg(
        F.lit("graph_summary").alias("evidence_subtype"), F.lit("repository").alias("module_name"), F.lit("repository-analysis").alias("file"),
        F.count("*").alias("node_count"), F.sum("outgoing_count").alias("edge_count"), F.count_if(F.col("total_connections") == 0).alias("isolated_node_count"),
        *(names(by).alias(to) for by, to in kinds.items()),
    )


def module_evidence(modules: DataFrame) -> DataFrame:
    """Modules as evidence: what they are and depend on, in a sentence."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("none")
    content = F.concat(
        "module_name", F.lit(" belongs to the "), "layer", F.lit(" layer. Outgoing dependencies: "), listed("outgoing_dependencies"),
        F.lit(". Incoming dependencies: "), listed("incoming_dependencies"), F.lit("."),
    )
    return modules.select(KEY, F.lit("module_dependencies").alias("evidence_subtype"), "module_name", "file", content.alias("content"), "outgoing_count", "incoming_count", "total_connections")


def evidence_pool(primary: DataFrame, supporting: DataFrame, metadata: DataFrame, architecture: DataFrame) -> DataFrame:
    """All evidence that claims may rest on, in one relation: retrieved code, its neighbours, counts, modules or the graph."""
    code = lambda df, role, context: df.select(
        F.lit("code").alias("evidence_type"), "file", "start_line", "end_line", *(["content"] if "content" in df.columns else []), "retrieval_score", F.lit(role).alias("retrieval_role"), F.lit(context).alias("context_role")
    )
    facts = metadata.select(F.lit("repository_metadata").alias("evidence_type"), "metadata_key", "label", "value")
    named = [c for c in ("evidence_subtype", "module_name", "file", "content", "node_count", "edge_count", "total_connections") if c in architecture.columns]
    graph = architecture.select(F.lit("architecture").alias("evidence_type"), *named, F.lit("architecture").alias("retrieval_role"), F.lit("architecture").alias("context_role"))
    parts = [code(primary, "primary", "retrieved"), code(supporting, "supporting", "neighbor"), facts, graph]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def public_evidence(code: DataFrame, metadata: DataFrame, architecture: DataFrame) -> DataFrame:
    """What an answer shows of its evidence."""
    c = code.select(F.lit("code").alias("evidence_type"), "file", "start_line", "end_line")
    m = metadata.select(F.lit("metadata").alias("evidence_type"), "metadata_key", "label", "value")
    a = architecture.select(F.lit("architecture").alias("evidence_type"), "module_name", "file")
    return c.unionByName(m, allowMissingColumns=True).unionByName(a, allowMissingColumns=True)


def merge_authoritative(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """Union without repeats by ``keys``; rows of ``first`` win."""
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_from")]
    one = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_from").alias("r")) if rest else both.select(*keys).distinct()
    return one.select(*keys, *(F.col("r")[c].alias(c) for c in rest))
