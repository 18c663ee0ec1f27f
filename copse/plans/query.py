"""Complex queries: one or two patterns and an operation over their witnesses."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from copse.operators import witness
from copse.plans.pattern import Pattern, parse_pattern
from copse.plans.planner import match

#: Operations, whether they take a second pattern, and how many positions.
OPERATIONS = {"SEL": (False, 0), "CP": (True, 0), "TJ": (True, 2), "NJ": (True, 2), "SRT": (False, 1), "GRP": (False, 1)}


@dataclass(frozen=True)
class Query:
    first: Pattern
    second: Pattern | None = None
    operation: str = "SEL"
    positions: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if self.operation not in OPERATIONS:
            raise ValueError(f"unknown operation {self.operation}")
        two, n = OPERATIONS[self.operation]
        if two and self.second is None:
            raise ValueError(f"{self.operation} takes two patterns")
        if len(self.positions) != n:
            raise ValueError(f"{self.operation} takes {n} positions")
        for pattern, i in zip((self.first, self.second if two else None), self.positions, strict=False):
            if pattern is not None and not 1 <= i <= len(pattern.tags):
                raise ValueError(f"position {i} is not among the {len(pattern.tags)} bound nodes")


def parse_query(text: str, patterns, width: int | None = 5) -> Query:
    """Lines `ptree_1: name`, optional `ptree_2: name` and `operation: OP [i [j]]`; `buf_size: ...` is accepted and has no effect.

    patterns: a folder with name.txt files, or a function from a name to a pattern's text.
    """
    lines = dict(x.split(":", 1) for x in text.splitlines() if ":" in x)
    fields = {k.strip().lower(): v.strip() for k, v in lines.items()}
    if "ptree_1" not in fields:
        raise ValueError("a query names its first pattern")
    load = patterns if callable(patterns) else lambda name: (Path(patterns) / f"{name}.txt").read_text()
    get = lambda k: parse_pattern(load(fields[k]), width) if fields.get(k) else None
    op, *args = fields.get("operation", "SEL").split() or ["SEL"]
    return Query(get("ptree_1"), get("ptree_2"), op, tuple(map(int, args)))


def execute(nodes: DataFrame, query: Query, strategy: str = "equi", reverse: bool = False) -> DataFrame:
    one = match(nodes, query.first, strategy, reverse)
    if query.operation == "SEL":
        return one
    if query.operation == "SRT":
        return witness.sort(one, *query.positions)
    if query.operation == "GRP":
        return witness.group(one, *query.positions)
    two = match(nodes, query.second, strategy, reverse)
    return {"CP": witness.product, "TJ": witness.tag_join, "NJ": witness.node_join}[query.operation](one, two, *query.positions)
