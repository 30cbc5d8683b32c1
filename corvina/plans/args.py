"""The query language: a question, then ``-o`` for any term instead of all, ``-n N`` results, ``-x N`` (read, without effect)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvina.operators.parse import strip


class Operator(Enum):
    AND = 1
    OR = 2


@dataclass(frozen=True)
class QueryArgs:
    query: str
    boolean_operator: Operator = Operator.AND
    results_count: int = 10
    relevant_documents_count: int = 1000

    def validate(self) -> QueryArgs:
        if not self.query:
            raise ValueError("the query is empty")
        return self


def parse_args(args: str | Sequence[str | None], validate: bool = True) -> QueryArgs:
    """From a line, or from a program's arguments (the first, its name, is skipped). The question ends at the first hyphen."""
    line = args if isinstance(args, str) else " ".join(a or "" for a in args[1:])
    counts = {}
    for name, flag in (("results_count", "-n"), ("relevant_documents_count", "-x")):
        if m := re.search(rf"{flag} (\d+)", line):
            counts[name] = int(m[1])
    out = QueryArgs(line.partition("-")[0].strip(), Operator.OR if "-o" in line else Operator.AND, **counts)
    return out.validate() if validate else out


def parse_lines(line: Column) -> Column:
    """A struct of query, operator, n, x for a column of lines: what ``parse_args`` reads from each, unvalidated. A null line is empty."""
    given = F.coalesce(line, F.lit(""))
    count = lambda flag, default: F.coalesce(F.regexp_extract(given, rf"-{flag} (\d+)", 1).try_cast("int"), F.lit(default))
    return F.struct(strip(F.substring_index(given, "-", 1)).alias("query"), F.when(given.contains("-o"), "OR").otherwise("AND").alias("operator"), count("n", 10).alias("n"), count("x", 1000).alias("x"))
