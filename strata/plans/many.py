"""A table of questions answered end to end, in a number of jobs that does not grow with the questions.

Each step of ``qa.ask`` as a relation: gates and facts, retrieval through the index, the
pool of evidence, the focused context, one or two prompts, claims, the verification
ladder, status and coverage.  Answers are those of asking one by one, if the provider's
replies depend on nothing but the prompt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text
from strata.operators import claims as claim_ops
from strata.operators import evidence, ladder, selection
from strata.operators import index as inverted
from strata.operators.graph import KEY
from strata.plans import qa, service
from strata.storage import materialize

POOL = [c.split()[0] for c in service.POOL.split(", ") if not c.startswith("pos ")]
Q = ["question", KEY]


def _told(df: DataFrame, kind: str, **more: Column) -> DataFrame:
    """``df`` with all columns of evidence, null where it has none."""
    given = {c: F.col(c) for c in df.columns} | {"evidence_type": F.lit(kind)} | more
    types = dict(c.split() for c in service.POOL.split(", "))
    return df.select(*Q, *(given.get(c, F.lit(None)).cast(types[c]).alias(c) for c in POOL))


def _code(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieved chunks and their neighbours in the same file, each in its best standing."""
    place = F.row_number().over(Window.partitionBy(KEY, "file").orderBy("start_line", "end_line"))
    files = found.select(KEY, "file").distinct()
    placed = materialize(chunks.join(files, [KEY, "file"], "left_semi").withColumn("place", place), "placed-chunks")
    own = found.select(*Q, "file", "start_line", "retrieval_score").join(placed.select(KEY, "file", "start_line", F.col("place").alias("at")), [KEY, "file", "start_line"])
    near = own.withColumn("place", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)))
    is_own = F.col("place") == F.col("at")
    score = F.when(is_own, F.col("retrieval_score")).otherwise(F.round(0.5 * F.col("retrieval_score"), 6))
    best = near.groupBy(*Q, "file", "place").agg(F.max(F.struct(is_own.alias("own"), score.alias("score"))).alias("best"))
    rows = best.join(placed, [KEY, "file", "place"])
    role = lambda a, b: F.when(F.col("best.own"), a).otherwise(b)
    return _told(rows, "code", retrieval_score=F.col("best.score"), retrieval_role=role("primary", "supporting"), context_role=role("retrieved", "neighbor"))


def _modules(asked: DataFrame, modules: DataFrame, k: int) -> DataFrame:
    """The graph's summary for questions on the whole of it, else the k modules that share most words with the question."""
    whole = text.is_global_architecture_query(F.col("query"))
    graph = service.graph_summary_evidence(modules)
    summary = asked.where(whole).select(*Q).join(graph, KEY)
    words = lambda c: F.explode(text.architecture_tokens(c)).alias("word")
    own = modules.select(KEY, "file", "module_name", "total_connections", words(F.concat_ws(" ", "module_name", "file")))
    met = asked.where(~whole).select(*Q, "query", words(F.col("query"))).join(own, [KEY, "word"]).groupBy(*Q, "query", "file", "module_name", "total_connections").agg(F.count("*").alias("shared"))
    exact = F.lower("query").contains(F.lower("module_name")).cast("bigint")
    rank = F.row_number().over(Window.partitionBy(*Q).orderBy(exact.desc(), F.desc("shared"), F.desc("total_connections"), "module_name"))
    first = met.withColumn("rank", rank).where(F.col("rank") <= k).select(*Q, "file")
    named = first.join(evidence.module_evidence(modules), [KEY, "file"])
    role = {"retrieval_role": F.lit("architecture"), "context_role": F.lit("architecture")}
    return _told(summary, "architecture", **role).unionByName(_told(named, "architecture", **role))


def pools(asked: DataFrame, index: inverted.Index, chunks: DataFrame, counts: DataFrame, modules: DataFrame, k: int = 5) -> DataFrame:
    """(question, repo_id, pos and the columns of evidence): what each question may rest on, in order."""
    found = materialize(inverted.retrieve_many(index, asked, k, weighted=False).join(asked.select(*Q), "question"), "retrieved")
    keys = asked.select(*Q, F.explode(evidence.metadata_keys(F.col("query"))).alias("metadata_key"))
    facts = keys.join(evidence.metadata_facts(counts).drop("content"), [KEY, "metadata_key"])
    parts = [_code(found, service.with_symbols(chunks)), _told(facts, "repository_metadata"), _modules(asked, modules, max(k, 5))]
    rows = reduce(DataFrame.unionByName, parts)
    kind = F.when(F.col("evidence_type") == "code", F.when(F.col("context_role") == "neighbor", 1).otherwise(0)).when(F.col("evidence_type") == "repository_metadata", 2).otherwise(3)
    order = [kind, -F.coalesce("retrieval_score", F.lit(0.0)), F.coalesce("file", F.lit("")), F.coalesce("start_line", F.lit(0)), F.coalesce("metadata_key", F.lit(""))]
    pos = F.row_number().over(Window.partitionBy(*Q).orderBy(*order)) - 1
    return materialize(rows.withColumn("pos", pos.cast("bigint")), "pools")


def _listed(rows: DataFrame, *order: str) -> DataFrame:
    """(question, items): rows with reference and content as a list, in order."""
    item = F.struct(*order, ladder.reference().alias("reference"), F.coalesce("content", F.lit("")).alias("content"))
    return rows.groupBy("question").agg(F.array_sort(F.collect_list(item)).alias("items"))


def contexts(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """(question, query, focused, whole): numbered blocks of what the provider sees first, and of the whole pool."""
    intent = selection.context_intent(F.col("query"))
    words = text.selector_forms(text.selector_tokens(F.col("query")))
    rows = pool.join(asked.select("question", intent.alias("intent"), words.alias("asked")), "question")
    content, in_file, symbol, score = evidence.context_score(F.col("asked"), F.col("content"), F.col("file"), F.col("symbol_names"))
    rows = materialize(rows.withColumns({"_c": content, "_f": in_file, "_s": symbol, "_v": score}), "context-scores")
    few, mine = F.col("intent").isin("implementation", "symbol"), Window.partitionBy("question")
    best = rows.where("evidence_type = 'code' and context_role = 'retrieved' and _v > 0").withColumn("structural", F.col("_f") + F.col("_s") > 0)
    best = best.withColumn("some", F.bool_or("structural").over(mine)).where(F.col("structural") | ~F.col("some"))
    keys = [(F.col("_s") > 0).cast("int"), (F.col("_f") > 0).cast("int"), F.col("_s"), F.col("_f"), F.col("_c"), F.col("_v"), F.coalesce("retrieval_score", F.lit(0.0))]
    best = best.withColumn("place", F.row_number().over(mine.orderBy(*(c.desc() for c in keys), "pos"))).where(F.col("place") <= F.when(few, 3).otherwise(4)).withColumn("part", F.lit(0))
    more = rows.where("evidence_type = 'code' and context_role = 'neighbor'").where(~few)
    more = more.withColumn("place", F.row_number().over(mine.orderBy(keys[0].desc(), keys[1].desc(), F.desc("_v"), "pos"))).where("place <= 2").withColumn("part", F.lit(1))
    chosen = best.drop("structural", "some").unionByName(more)
    code = rows.where("evidence_type = 'code'").join(chosen.select("question").distinct(), "question", "left_anti")
    first = code.withColumn("place", F.row_number().over(mine.orderBy("pos"))).where("place <= 3").withColumn("part", F.lit(2))
    graph = rows.where("evidence_type = 'architecture' and intent = 'architecture'")
    graph = graph.withColumn("place", F.row_number().over(mine.orderBy("pos"))).where("place <= 4").withColumn("part", F.lit(3))
    focused = _listed(reduce(DataFrame.unionByName, (chosen, first, graph)), "part", "place").select("question", ladder.blocks(F.col("items")).alias("focused"))
    whole = _listed(pool, "pos").select("question", ladder.blocks(F.col("items")).alias("whole"))
    return asked.select(*Q, "query").join(whole, "question").join(focused, "question", "left").withColumn("focused", F.coalesce("focused", F.lit("")))


def _prompt(context: str) -> Column:
    return F.concat(F.lit("Answer only from the evidence.\n\nQuestion: "), "query", F.lit("\n\nEvidence:\n"), context, F.lit("\n\nReply UNKNOWN if the evidence does not tell."))


AGAIN = "\n\nThe evidence was chosen for this question; say what it does tell."


def answer_many(
    questions: DataFrame, index: inverted.Index, chunks: DataFrame, counts: DataFrame, modules: DataFrame, module_edges: DataFrame, reply: ladder.Reply, k: int = 5
) -> DataFrame:
    """question, repo_id, query, answer, status, origin, claim_count, supported_claims and coverage of each (question, repo_id, query).

    ``question`` must be unique; ``index`` is the scoped one of ``chunks``, which have a repo_id.  ``reply`` gives a column of replies for one of prompts.
    """
    asked = materialize(questions.select(*Q, "query"), "questions")
    facts = materialize(asked.join(qa.answer_all(asked, counts, modules, module_edges), [KEY, "query"]), "fact-answers")
    settled = facts.where("status = 'fact' or origin in ('sensitive', 'identity')")
    left = materialize(facts.join(settled.select("question"), "question", "left_anti").select(*Q, "query"), "open-questions")
    pool = pools(left, index, chunks, counts, modules, k)
    read = lambda raw: text.unwrap_answer(F.coalesce(raw, F.lit(qa.UNKNOWN)))
    said = contexts(left, pool).withColumn("first", read(reply(_prompt("focused"))))
    said = said.withColumn("again", reply(F.when(text.is_unknown_answer(F.col("first")), F.concat(_prompt("whole"), F.lit(AGAIN)))))
    said = said.withColumn("answer", F.when(text.is_unknown_answer(F.col("first")), read(F.col("again"))).otherwise(F.col("first")))
    said = materialize(said.select(*Q, "query", "answer", text.is_unknown_answer(F.col("answer")).alias("unknown"), claim_ops.decompose(F.col("answer")).alias("claims")), "replies")
    claims = materialize(said.where("not unknown").select(F.col("question").alias("key"), KEY, F.posexplode("claims").alias("place", "claim")), "claims")
    known = claim_ops.verify_facts(claims.select(KEY, "claim"), modules, counts)
    known = claims.select("key", KEY, "claim").distinct().join(known, [KEY, "claim"]).select("key", "claim", "decision")
    decided = ladder.verify_ladder(claims, pool.withColumnRenamed("question", "key").drop(KEY), service.with_symbols(chunks), reply, known)
    judged = claims.join(ladder.claims_with_status(decided), ["key", "claim"])
    told = claim_ops.fold_status(judged, "key").join(claim_ops.coverage(judged, "key"), "key").withColumnRenamed("key", "question")
    replied = said.join(told, "question", "left").select(
        *Q, "query", F.coalesce(F.nullif("answer", F.lit("")), F.lit(qa.UNKNOWN)).alias("answer"), F.coalesce("answer_status", F.lit("unknown")).alias("status"),
        F.lit("provider").alias("origin"), "claim_count", "supported_claims", "coverage",
    )
    one = F.when(F.col("status") == "fact", 1).otherwise(0)
    by_fact = settled.select(*Q, "query", "answer", "status", "origin", one.alias("claim_count"), one.alias("supported_claims"), one.cast("double").alias("coverage"))
    lone = left.join(said.select("question"), "question", "left_anti")
    nothing = lone.select(*Q, "query", F.lit(qa.UNKNOWN).alias("answer"), F.lit("unknown").alias("status"), F.lit("none").alias("origin"), F.lit(0).alias("claim_count"), F.lit(0).alias("supported_claims"), F.lit(0.0).alias("coverage"))
    out = reduce(DataFrame.unionByName, (by_fact, replied, nothing))
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("claim_count", "supported_claims")}
    return out.withColumns({**zero, "coverage": F.coalesce("coverage", F.lit(0.0))})
