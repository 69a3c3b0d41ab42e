"""What a question retrieves from a repository, and how claims are verified against it.

Retrieval is distributed; what it returns is bounded by k and comes to the
driver, where the ladder of provider calls runs: each call depends on the last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strata.functions import text
from strata.operators import claims as claim_ops
from strata.operators import evidence, retrieval, selection
from strata.operators.graph import KEY

POOL = (
    "pos int, evidence_type string, evidence_subtype string, file string, start_line int, end_line int, content string, module_name string, metadata_key string, label string, "
    "value bigint, retrieval_score double, retrieval_role string, context_role string, symbol_names string, node_count bigint, edge_count bigint, total_connections bigint"
)
_NAMES = [c.split()[0] for c in POOL.split(", ")]
SUPPORTED = ("supported", "partially_supported")


def with_symbols(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the names of their symbols as one string."""
    if "symbols" not in chunks.columns:
        return chunks.withColumn("symbol_names", F.lit(""))
    both = F.concat(*(F.coalesce(F.col("symbols")[k], F.array()) for k in ("classes", "functions")))
    return chunks.withColumn("symbol_names", F.coalesce(F.array_join(F.transform(both, lambda s: s["name"]), " "), F.lit("")))


def graph_summary_evidence(modules: DataFrame) -> DataFrame:
    """The graph of each repository as one row of evidence."""
    told = F.concat(
        F.lit("The graph has "), F.col("node_count").cast("string"), F.lit(" production modules and "), F.col("edge_count").cast("string"), F.lit(" dependency edges. Most connected: "),
        F.array_join("top_connected", ", "), F.lit(". Most outgoing: "), F.array_join("top_outgoing", ", "), F.lit(". Most incoming: "), F.array_join("top_incoming", ", "), F.lit("."),
    )
    return evidence.graph_evidence(modules).withColumn("content", told)


def architecture_evidence(query: str, modules: DataFrame, k: int = 5) -> DataFrame:
    """The graph's summary for questions on the whole of it, else the k modules that meet the question best; one or k rows a repository."""
    is_global = modules.sparkSession.range(1).select(text.is_global_architecture_query(F.lit(query))).first()[0]
    if is_global:
        return graph_summary_evidence(modules)
    met = evidence.lookup_modules(modules, query, k).select(KEY, "file")
    return evidence.module_evidence(modules.join(met, [KEY, "file"], "left_semi"))


@dataclass
class Retrieved:
    primary: DataFrame
    supporting: DataFrame
    architecture: DataFrame | None


def retrieve_repository_evidence(query: str, chunks: DataFrame, modules: DataFrame | None = None, k: int = 5, distance: int = 1) -> Retrieved:
    """The k best chunks, their neighbours, and architecture evidence where the question is on architecture."""
    primary = retrieval.retrieve(chunks, query, k)
    near = retrieval.neighbours(primary, chunks, distance).where("context_role = 'neighbor'").select("file", "start_line", "retrieval_score")
    supporting = chunks.join(near, ["file", "start_line"])
    intent = chunks.sparkSession.range(1).select(text.query_intent(F.lit(query))).first()[0]
    return Retrieved(primary, supporting, architecture_evidence(query, modules, k) if intent == "architecture" and modules is not None else None)


def matching_facts(query: str, counts: DataFrame) -> DataFrame:
    """The repository's counts that a question names."""
    facts = evidence.metadata_facts(counts)
    return facts.where(F.array_contains(evidence.metadata_keys(F.lit(query)), F.col("metadata_key")))


def pool_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(c) for c in _NAMES) for r in rows], POOL)


def collect_pool(query: str, chunks: DataFrame, modules: DataFrame, counts: DataFrame, k: int = 5) -> list[dict]:
    """Code, neighbours, counts and architecture for a question, in this order, as rows with a position.

    Architecture is asked for whatever the question's intent seems to be: its
    facts outrank the rest, and a paraphrase must not lose them.
    """
    found = retrieve_repository_evidence(query, with_symbols(chunks), None, k)
    pool = evidence.evidence_pool(found.primary, found.supporting, matching_facts(query, counts), architecture_evidence(query, modules, max(k, 5)))
    names = with_symbols(found.primary).select("file", "start_line", "symbol_names").union(with_symbols(found.supporting).select("file", "start_line", "symbol_names"))
    symbols = {(r.file, r.start_line): r.symbol_names for r in names.collect()}
    order = {"code": 0, "repository_metadata": 2, "architecture": 3}
    rows = [r.asDict() for r in pool.collect()]
    rows.sort(key=lambda r: (order[r["evidence_type"]] + (r["context_role"] == "neighbor"), -(r["retrieval_score"] or 0.0), r["file"] or "", r["start_line"] or 0, r["metadata_key"] or ""))
    return [r | {"pos": i, "symbol_names": symbols.get((r["file"], r["start_line"]), "")} for i, r in enumerate(rows)]


def reference(item: dict | Row) -> str:
    if item["evidence_type"] == "code":
        return f"{item['file']}:{item['start_line']}-{item['end_line']}"
    return item["metadata_key"] or item["module_name"]


def blocks(items: list[dict]) -> str:
    """Numbered blocks of evidence."""
    return "\n\n".join(f"[{i}] {reference(e)}\n{e['content'] or ''}" for i, e in enumerate(items, 1))


@dataclass
class Verifier:
    """Verification of a question's claims: facts first, then the provider over smaller and smaller evidence.

    Nothing that the claim shares no word with reaches the provider; errors and
    replies without a decision count as unsupported.
    """

    spark: SparkSession
    repo_id: str
    pool: list[dict]
    chunks: DataFrame
    modules: DataFrame
    counts: DataFrame
    provider: Callable[[str], str]
    ratios: dict[tuple[str, int], float] = field(default_factory=dict)

    def by_facts(self, claims: list[str]) -> dict[str, str]:
        """Decisions that the counts, the graph or its modules settle."""
        said = self.spark.createDataFrame([(self.repo_id, c) for c in claims], f"{KEY} string, claim string")
        return {r.claim: r.decision for r in claim_ops.verify_facts(said, self.modules, self.counts).collect() if r.decision}

    def measure(self, claims: list[str], items: list[dict]) -> None:
        """How much of each claim's words each item has, in one pass."""
        said = self.spark.createDataFrame([(0, c) for c in claims], "key int, claim string")
        told = self.spark.createDataFrame([(0, e["pos"], e["content"] or "") for e in items], "key int, pos int, content string")
        self.ratios |= {(r.claim, r.pos): r.ratio for r in claim_ops.overlaps(said, told).collect()}

    def _decision(self, prompt: str) -> str:
        try:
            raw = self.provider(prompt)
        except Exception:  # noqa: BLE001  checks fail closed
            return "unsupported"
        given = F.coalesce(F.get_json_object(text.json_object(F.lit(raw)), "$.decision"), F.lit(raw))
        return self.spark.range(1).select(text.decision(given)).first()[0]

    def once(self, claim: str, items: list[dict]) -> str:
        """One verification: the six items with most of the claim's words, and where they do not support it the first three again."""
        relevant = sorted((e for e in items if self.ratios.get((claim, e["pos"]))), key=lambda e: -self.ratios[claim, e["pos"]])[:6]
        if not relevant:
            return "unsupported"
        first = self._decision(f"Is the claim supported by the evidence? Reply supported, partially_supported or unsupported.\n\nClaim: {claim}\n\nEvidence:\n{blocks(relevant)}")
        if first != "unsupported":
            return first
        return self._decision(f"Look again at the strongest evidence only. Is the claim supported by it?\n\nClaim: {claim}\n\nEvidence:\n{blocks(relevant[:3])}")

    def candidates(self, claim: str) -> list[dict]:
        chosen = {r.pos for r in selection.claim_evidence(pool_of(self.spark, self.pool), claim).select("pos").collect()} if self.pool else set()
        return [e for e in self.pool if e["pos"] in chosen] or self.pool

    def targeted(self, claim: str, known: list[dict]) -> list[dict]:
        """Chunks of the repository outside the evidence that fit the claim."""
        used = self.spark.createDataFrame([(e["file"], e["start_line"], e["end_line"]) for e in known if e["evidence_type"] == "code"], "file string, start_line int, end_line int")
        left = with_symbols(selection.unused_chunks(self.chunks, used)).withColumn("pos", F.lit(0))  # ties go by file and line
        best = evidence.diverse_code(left, claim).select("file", "start_line", "score", "again")
        found = left.join(F.broadcast(best), ["file", "start_line"]).orderBy("again", F.desc("score"), "file", "start_line")  # at most six
        items = [{"pos": -1 - i, "evidence_type": "code", "file": r.file, "start_line": r.start_line, "end_line": r.end_line, "content": r.content} for i, r in enumerate(found.collect())]
        if items:
            self.measure([claim], items)
        return items

    def ladder(self, claim: str, items: list[dict]) -> tuple[str, list[dict]]:
        """Decision and the evidence it rests on: the whole set, each item, the first two and three, then what a scan of all chunks finds."""
        tries = [items, *([e] for e in items), *(items[:n] for n in (2, 3) if len(items) >= n)]
        for some in tries:
            decision = self.once(claim, some)
            if decision != "unsupported":
                return decision, some
        further = self.targeted(claim, items)
        decision = self.once(claim, further) if further else "unsupported"
        return decision, further if decision != "unsupported" else []

    def verify(self, claims: list[str]) -> dict[str, tuple[str, list[dict]]]:
        """For each claim its decision and evidence."""
        distinct = list(dict.fromkeys(claims))
        settled = self.by_facts(distinct)
        rest = [c for c in distinct if c not in settled]
        if rest and self.pool:
            self.measure(rest, self.pool)
        out = {}
        for c in distinct:
            items = self.candidates(c)
            out[c] = (settled[c], items) if c in settled else self.ladder(c, items)
        return out
