"""Tokenizers, normalisers and predicates over prose and code.

There are several tokenizers on purpose: retrieval, verification, evidence
selection, metadata and architecture lookups each read text in their own way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions import vocab
from strata.functions.paths import posix


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _alias_map(table: dict[str, list[str]]) -> Column:
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), words(v))))


def _expand(tokens: Column, table: dict[str, list[str]]) -> Column:
    """Tokens and their aliases, without repeats."""
    aliases = _alias_map(table)
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(aliases, t), words([]))))))


def retrieval_tokens(text: Column) -> Column:
    """Identifiers in order, each followed by its parts between underscores; stop words are left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))
    both = F.transform(found, lambda t: F.when(t.contains("_"), F.concat(F.array(t), F.filter(F.split(t, "_"), lambda p: p != ""))).otherwise(F.array(t)))
    return F.filter(F.flatten(both), lambda t: ~t.isin(vocab.RETRIEVAL_STOP_WORDS))


def concepts(tokens: Column) -> Column:
    return _expand(tokens, vocab.CONCEPT_ALIASES)


def anchors(query: Column) -> Column:
    """Concepts of the words that say what a question is about."""
    return concepts(F.filter(retrieval_tokens(query), lambda t: ~t.isin(vocab.GENERIC_QUERY_WORDS)))


def module_tokens(path: Column) -> Column:
    last = F.regexp_replace(F.element_at(F.split(posix(path), "/"), -1), r"\.py$", "")
    return concepts(retrieval_tokens(last))


def verifier_tokens(text: Column) -> Column:
    """Distinct words with a singular form beside plural ones."""
    split = F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))
    found = F.filter(F.regexp_extract_all(split, F.lit("[a-z_][a-z0-9_]*"), F.lit(0)), lambda t: ~t.isin(vocab.VERIFIER_STOP_WORDS))

    def forms(t: Column) -> Column:
        cut = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
        return (
            F.when(t.endswith("ies") & (F.length(t) > 4), F.array(t, F.concat(cut(3), F.lit("y"))))
            .when(t.endswith("ses") & (F.length(t) > 4), F.array(t, cut(2)))
            .when(t.endswith("s") & (F.length(t) > 3), F.array(t, cut(1)))
            .otherwise(F.array(t))
        )

    return F.array_distinct(F.flatten(F.transform(found, forms)))


def selector_tokens(text: Column) -> Column:
    """Distinct words and their parts, cut at case changes as well."""
    split = F.regexp_replace(F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " "), "(?<=[A-Z])(?=[A-Z][a-z])", " ")
    found = F.transform(F.regexp_extract_all(split, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), lambda t: F.btrim(F.lower(t), F.lit("_")))
    fine = lambda t: (F.length(t) > 1) & ~t.isin(vocab.SELECTOR_STOP_WORDS)
    found = F.filter(found, fine)
    return F.array_distinct(F.flatten(F.transform(found, lambda t: F.concat(F.array(t), F.filter(F.split(t, "_"), fine)))))


def selector_forms(tokens: Column) -> Column:
    """Tokens with a singular or plural and their aliases."""
    aliases = _alias_map(vocab.SELECTOR_ALIASES)

    def forms(t: Column) -> Column:
        cut = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
        long = F.length(t) > 3
        other = (
            F.when(long & t.endswith("ies"), F.array(t, F.concat(cut(3), F.lit("y"))))
            .when(long & t.endswith("ses"), F.array(t, cut(2)))
            .when(long & t.endswith("s"), F.array(t, cut(1)))
            .when(F.length(t) > 2, F.array(t, F.concat(t, F.lit("s"))))
            .otherwise(F.array(t))
        )
        return F.concat(other, F.coalesce(F.try_element_at(aliases, t), words([])))

    return F.array_distinct(F.flatten(F.transform(tokens, forms)))


def metadata_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def architecture_tokens(text: Column) -> Column:
    """Distinct words between dots, slashes, underscores and spaces, singular where long enough."""
    flat = F.btrim(F.regexp_replace(F.translate(posix(F.lower(text)), "./_", "   "), r"\s+", " "))
    found = F.filter(F.split(flat, " "), lambda t: t != "")
    return F.array_distinct(F.transform(found, lambda t: F.when(t.endswith("s") & (F.length(t) > 3), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)))


def normal_claim(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9_.]+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two token sets; zero where either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    either_empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(either_empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap_ratio(claim: Column, chunk: Column) -> Column:
    """Share of the claim's tokens that the chunk has."""
    return F.when(F.size(claim) == 0, 0.0).otherwise(F.size(F.array_intersect(claim, chunk)) / F.size(claim))


def query_intent(query: Column) -> Column:
    tokens = retrieval_tokens(query)
    has = lambda values: F.arrays_overlap(tokens, words(values))
    return (
        F.when(F.size(tokens) == 0, "concept")
        .when(has(vocab.SYMBOL_WORDS), "symbol")
        .when(has(vocab.ARCHITECTURE_WORDS), "architecture")
        .when(has(vocab.IMPLEMENTATION_WORDS), "implementation")
        .when(F.size(F.array_distinct(tokens)) == 1, "symbol")
        .otherwise("concept")
    )


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9_-]+", " ")


SENSITIVE = (
    "\\b(?:{v})\\b.{{0,60}}\\b(?:{n})\\b|\\b(?:{n})\\b.{{0,60}}\\b(?:{v})\\b".format(v="|".join(vocab.DISCLOSURE_VERBS), n="|".join(vocab.SECRET_NOUNS))
)


def is_sensitive_request(query: Column) -> Column:
    """A disclosure verb within sixty characters of a secret noun, in either order."""
    return F.coalesce(_plain(query).rlike(SENSITIVE), F.lit(False))


def _contains_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def is_identity_question(query: Column) -> Column:
    low = F.regexp_replace(F.lower(query), "[^a-z0-9]+", " ")
    return F.coalesce(_contains_any(low, vocab.IDENTITY_SCOPES) & _contains_any(low, vocab.IDENTITY_TERMS), F.lit(False))


EXACT_COUNT = r"\b(?:which|what) modules?\b.*\b\d+ (?:dependency )?connections?\b"
EXPLANATORY = r"\bwhy\b|\bexplain\b|\bhow (?:does|do|is|are)\b|\breason\b"


def is_global_architecture_query(query: Column) -> Column:
    low = F.lower(query)
    return F.coalesce(_contains_any(low, vocab.GLOBAL_ARCHITECTURE_PHRASES) | low.rlike(EXACT_COUNT), F.lit(False))


def is_explanatory(query: Column) -> Column:
    return F.coalesce(F.lower(query).rlike(EXPLANATORY), F.lit(False))


def is_unknown_answer(answer: Column) -> Column:
    return F.coalesce(F.lower(F.btrim(answer)).rlike(r"^unknown(?:$|:| -| —)"), F.lit(True))


def unwrap_answer(raw: Column) -> Column:
    """Text of an answer that may come fenced or as a JSON object."""
    body = F.btrim(F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), raw))
    keyed = F.coalesce(*(F.get_json_object(body, f"$.{k}") for k in ("response", "answer", "assistant", "explanation")))
    return F.btrim(F.when(body.startswith("{"), F.coalesce(keyed, body)).otherwise(body))


def json_object(raw: Column) -> Column:
    """The first JSON object in a text: whole, fenced, or between the outermost braces; null if none parses."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.btrim(c).startswith("{"), F.btrim(c))
    return F.coalesce(ok(raw), ok(fenced), ok(braces))


def decision(raw: Column) -> Column:
    aliases = F.create_map(*(F.lit(x) for kv in vocab.DECISIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(aliases, F.lower(F.btrim(raw))), F.lit("unsupported"))


def title_label(name: Column) -> Column:
    """Underscores as spaces, each word's first letter upper-case."""
    return F.array_join(F.transform(F.split(F.translate(name, "_", " "), " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " ")


def int_or(value: Column, default: int) -> Column:
    return F.coalesce(F.btrim(value).try_cast("int"), F.lit(default))
