"""Risk detectors, their normal form, and the claims and reports made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import paths, vocab
from strata.operators.graph import KEY, cycles

HOTSPOT = 8


def severity(connections: Column) -> Column:
    return F.when(connections >= 25, "critical").when(connections >= 15, "high").otherwise("medium")


def severity_rank(text: Column) -> Column:
    """4 for critical down to 1, by what the upper-cased text contains."""
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.when(up.contains("CRITICAL"), 4).when(up.contains("HIGH"), 3).when(up.contains("MEDIUM") | up.contains("MODERATE"), 2).otherwise(1)


def severity_label(text: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), severity_rank(text))


def overview_severity(text: Column) -> Column:
    """The overview counts critical signals among the high ones."""
    return F.when(severity_rank(text) >= 3, "HIGH").otherwise(severity_label(text))


def _signal(df: DataFrame, category: str, signal: str, level: Column | None, *more: Column) -> DataFrame:
    head = [F.col(KEY), F.lit(category).alias("category"), F.lit(signal).alias("signal"), F.lit("possible_risk").alias("status")]
    return df.select(*head, (F.lit(None).cast("string") if level is None else level).alias("severity"), *more)


def hotspots(modules: DataFrame, least: int = HOTSPOT) -> DataFrame:
    """high_connectivity: modules with many connections."""
    n = F.col("total_connections")
    reason = F.format_string(
        "This module has %d dependency connections (%d incoming and %d outgoing). "
        "High connectivity may indicate that the module is highly coupled with other production modules.",
        n, F.col("incoming_count"), F.col("outgoing_count"),
    )
    return _signal(
        modules.where(n >= least), "architecture", "high_connectivity", severity(n), F.col("file"), F.col("module_name"),
        n.alias("connection_count"), F.col("incoming_count"), F.col("outgoing_count"), reason.alias("reason"),
    )


def circular_dependencies(edges: DataFrame) -> DataFrame:
    found = cycles(edges)
    return _signal(found, "architecture", "circular_dependency", F.lit("high"), F.col("cycle"), F.col("members").alias("connection_count"))


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """One signal for each edge triple whose layers may not meet; ends of unknown layer are passed over."""
    a = layers.select(KEY, F.col("file").alias("source"), F.col("layer").alias("source_layer"))
    b = layers.select(KEY, F.col("file").alias("target"), F.col("layer").alias("target_layer"))
    joined = edges.join(a, [KEY, "source"]).join(b, [KEY, "target"])
    allowed = reduce(lambda x, y: x | y, ((F.col("source_layer") == k) & F.col("target_layer").isin(v) for k, v in vocab.ALLOWED_LAYERS.items()))
    known = F.col("source_layer").isin(list(vocab.ALLOWED_LAYERS))
    return _signal(joined.where(known & ~allowed), "architecture", "layer_violation", F.lit("medium"), *(F.col(c) for c in ("source", "target", "import", "source_layer", "target_layer")))


def missing_test_counterparts(production: DataFrame, files: DataFrame) -> DataFrame:
    """Production files none of whose candidate test paths exist."""
    there = files.select(KEY, F.lower(paths.posix(F.col("path"))).alias("candidate")).distinct()
    wanted = production.select(KEY, "file", F.explode(paths.test_candidates(F.col("file"))).alias("candidate"))
    met = wanted.join(there, [KEY, "candidate"], "left_semi").select(KEY, "file").distinct()
    left = production.join(met, [KEY, "file"], "left_anti")
    return _signal(left, "testing", "missing_test_counterpart", F.lit("medium"), F.col("file"), paths.module_name(F.col("file")).alias("module_name"))


def removed_modules(drift: DataFrame) -> DataFrame:
    """architecture_drift signals for rows of a module drift with change 'removed'."""
    return _signal(drift.where("change = 'removed'"), "architecture", "architecture_drift", F.lit("medium"), F.col("file"), F.lit("removed_module").alias("drift_type"))


def unreferenced(modules: DataFrame, references: DataFrame, on: str = "file") -> DataFrame:
    """Production modules that no test refers to, by file or by module_name."""
    left = modules.join(references.select(KEY, on).distinct(), [KEY, on], "left_anti")
    return _signal(left, "testing", "unreferenced_production_module", F.lit("medium"), F.col("file"), F.col("module_name"))


def unresolved_imports(records: DataFrame) -> DataFrame:
    bad = records.where(F.col("is_internal") & ~F.col("is_resolved") & (F.btrim("imported_module") != ""))
    return _signal(bad, "dependency", "unresolved_internal_import", F.lit("medium"), F.col("file"), F.col("imported_module").alias("module"))


def is_test_or_example(path: Column) -> Column:
    low = F.lower(path)
    name = paths.file_name(low)
    return F.arrays_overlap(paths.parts(low), F.array(F.lit("test"), F.lit("tests"))) | name.startswith("test_") | name.endswith("_test.py") | name.contains("example")


def hardcoded_secrets(assignments: DataFrame) -> DataFrame:
    """Values assigned to names that hint at secrets, outside tests and examples, unless they are placeholders."""
    name = F.lower(F.btrim("name"))
    hinted = reduce(lambda a, b: a | b, (name.contains(h) for h in vocab.SECRET_HINTS))
    placeholder = F.lower(F.btrim("value")).isin(vocab.PLACEHOLDERS)
    bad = assignments.where(hinted & ~placeholder & ~is_test_or_example(F.col("file")))
    return _signal(bad, "security", "possible_hardcoded_secret", F.lit("high"), F.col("file"), F.col("line"), F.col("name"))


def dynamic_execution(calls: DataFrame) -> DataFrame:
    return _signal(calls.where(F.col("function").isin("eval", "exec")), "security", "dynamic_code_execution", F.lit("high"), F.col("file"), F.col("line"), F.col("function"))


def missing_documentation(modules: DataFrame) -> DataFrame:
    return _signal(modules.where(~F.col("has_docstring")), "documentation", "missing_module_documentation", F.lit("medium"), F.col("file"), F.col("module_name"))


def union_signals(*signals: DataFrame) -> DataFrame:
    """All signals with all columns, ``seq`` telling the detector's place in order."""
    numbered = [s.withColumn("seq", F.lit(i)) for i, s in enumerate(signals)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def normalise(signals: DataFrame) -> DataFrame:
    defaults = {"category": "unknown", "signal": "unknown_risk", "severity": "medium", "status": "possible_risk"}
    return signals.withColumns({c: F.coalesce(F.col(c), F.lit(d)) if c in signals.columns else F.lit(d) for c, d in defaults.items()})


def claim_text(s: DataFrame) -> Column:
    """Sentence for a normalised signal; null for signals without a template or with missing parts."""
    has = lambda c: F.col(c).cast("string") if c in s.columns else F.lit(None).cast("string")
    cycle = F.col("cycle") if "cycle" in s.columns else F.array().cast("array<string>")
    say = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    within = F.coalesce(say(" within function ", F.nullif(F.col("function"), F.lit(""))), F.lit("")) if "function" in s.columns else F.lit("")
    named = say("Production module ", has("module_name"), " (", has("file"), ")")
    templates = {
        "high_connectivity": say(has("module_name"), " has ", has("connection_count"), " dependency connections. ", has("reason")),
        "circular_dependency": F.when(
            F.size(cycle) >= 2, say("Circular dependency detected across ", F.size(cycle).cast("string"), " production modules: ", F.array_join(cycle, ", "), ".")
        ),
        "layer_violation": say("Architecture layer violation detected: ", has("source"), " (", has("source_layer"), ") depends on ", has("target"), " (", has("target_layer"), ")."),
        "architecture_drift": say("Architecture drift detected: production module ", has("file"), " was removed between snapshots."),
        "missing_test_counterpart": say("Production module ", has("file"), " has no detected test counterpart."),
        "unreferenced_production_module": say(named, " has no detected test reference."),
        "unresolved_internal_import": say("Unresolved internal dependency detected for module ", has("module"), "."),
        "possible_hardcoded_secret": say("Possible hardcoded secret detected in ", has("file"), "."),
        "dynamic_code_execution": say("Dynamic code execution detected in ", has("file"), within, "."),
        "missing_module_documentation": say(named, " has no detected module documentation."),
    }
    out = F.lit(None).cast("string")
    for name, text in templates.items():
        out = F.when(F.col("signal") == name, text).otherwise(out)
    return out


def risk_claims(signals: DataFrame) -> DataFrame:
    """Claims of normalised signals whose status is possible_risk and whose template applies."""
    s = normalise(signals)
    return s.where("status = 'possible_risk'").select(KEY, "category", "signal", "severity", "status", claim_text(s).alias("text")).where("text is not null")


def risk_report(signals: DataFrame) -> DataFrame:
    """signal_count, claim_count and coverage (claims over signals, four places)."""
    s = normalise(signals)
    rows = s.select(KEY, claim_text(s).isNotNull().cast("bigint").alias("claimed"))
    out = rows.groupBy(KEY).agg(F.count("*").alias("signal_count"), F.sum("claimed").alias("claim_count"))
    return out.withColumn("coverage", F.round(F.col("claim_count") / F.col("signal_count"), 4))


def severity_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy(KEY, severity_label(F.col("severity")).alias("severity")).agg(F.count("*").alias("signals"))


def category_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy(KEY, "category").agg(F.count("*").alias("signals"), F.sum((severity_rank(F.col("severity")) >= 3).cast("bigint")).alias("high_risk"))


def category_severity_rollup(signals: DataFrame) -> DataFrame:
    """Counts by category and severity with subtotals; grand totals have nulls."""
    return signals.rollup("category", "severity").agg(F.count("*").alias("signals"))


def surface(signals: DataFrame, kind: str) -> DataFrame:
    """Security signals, or testing ones (by category or by name), without repeats."""
    if kind == "security":
        return signals.where("category = 'security'").dropDuplicates([KEY, "signal", "file", "line"])
    return signals.where((F.col("category") == "testing") | F.lower("signal").contains("test")).dropDuplicates([KEY, "signal", "file", "module_name"])
