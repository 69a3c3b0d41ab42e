"""The Python parser as a table function: ``FROM sources s, LATERAL python_facts(s.content) f``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strata.sources.pyast import _FIELDS, FACTS, facts_of


class PythonFacts:
    """A row for each fact of a source, as ``pyast.facts`` has them; a null source is an empty one."""

    def eval(self, source: str) -> Iterator[tuple]:
        for fact in facts_of(source):
            yield tuple(fact.get(f) for f in _FIELDS)


def register(spark: SparkSession, name: str = "python_facts") -> None:
    """Rows go as tuples: with Arrow each call, a source's few facts, would make a table of its own."""
    spark.udtf.register(name, F.udtf(PythonFacts, returnType=FACTS))
