"""detection as a table function, for users of SQL.

``register`` makes a pack a function of the session: ``SELECT d.id, e.* FROM docs AS d, LATERAL detect_entities(d.text) AS e`` gives a row for
each entity (start, stop, value, entity_type), those that allocation accepts, as ``detect.scan_with_python`` does with the same strategy. Rows
go to Python in Arrow batches; patterns are compiled once a task. A text in which nothing is found has no rows. Spark
(4.1) loses such documents with LEFT JOIN LATERAL too, for any Python table function; join the documents with what was found to keep them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from cloakwork.operators import detect as D
from cloakwork.sources.rules import Rule

COLUMNS = "start int, stop int, value string, entity_type string"


def accepted(candidates: list[dict], strategy: str) -> list[dict]:
    """R1, R2 in Python: by priority, each candidate that overlaps none taken; taken ones are kept in order and looked up by halving."""
    order = (lambda c: (c["start"] - c["end"], c["start"], c["ord"])) if strategy == "longest" else (lambda c: (c["ord"], c["start"]))
    starts: list[int] = []
    taken: list[dict] = []
    for c in sorted(candidates, key=order):
        at = bisect_left(starts, c["end"])  # those before it begin before the candidate's end; only the last can reach into it
        if at == 0 or taken[at - 1]["end"] <= c["start"]:
            starts.insert(at, c["start"])
            taken.insert(at, c)
    return taken


def register(spark: SparkSession, rules: list[Rule], name: str = "detect_entities", strategy: str = "longest") -> None:
    """Registers the rules as a table function of one argument, the text."""
    rules = list(rules)

    class Detect:
        def __init__(self) -> None:
            self.compiled = [(r.entity_type, r.python(), D.required(r.python())) for r in rules]
            self.checks = D.python_validators()

        def eval(self, text: str) -> Iterator[tuple]:
            for c in accepted(D.find_with_python(text, self.compiled, self.checks), strategy) if text else ():
                yield c["start"], c["end"], c["value"], c["entity_type"]

    spark.udtf.register(name, udtf(Detect, returnType=COLUMNS, useArrow=True))
