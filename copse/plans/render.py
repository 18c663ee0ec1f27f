"""Witness trees as text, for looking at some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

from copse.operators.witness import width


def tree(row: Row, prefix: str = "", n: int | None = None) -> list[tuple[int, int, str, int | None]]:
    """(start, end, tag, parent's start) of a witness's nodes in document order."""
    n = n or sum(c.startswith(f"{prefix}tag_") for c in row.__fields__)
    nodes = sorted({(row[f"{prefix}start_{k}"], row[f"{prefix}end_{k}"], row[f"{prefix}tag_{k}"]) for k in range(1, n + 1)})
    out, stack = [], []
    for start, end, tag in nodes:
        while stack and stack[-1][1] < end:
            stack.pop()
        out.append((start, end, tag, stack[-1][0] if stack else None))
        stack.append((start, end))
    return out


def text(row: Row, prefix: str = "", indent: int = 0, last_first: bool = False) -> str:
    """A line a node, indented by depth; last_first lists later siblings before earlier ones."""
    nodes = tree(row, prefix)
    below: dict[int | None, list] = {}
    for n in nodes:
        below.setdefault(n[3], []).append(n)
    lines: list[str] = []

    def show(parent: int | None, depth: int) -> None:
        for start, end, tag, _ in reversed(below.get(parent, [])) if last_first else below.get(parent, []):
            lines.append(f"{' ' * (indent + 2 * depth)}--{tag} [{start}, {end}]")
            show(start, depth + 1)

    show(None, 0)
    return "\n".join(lines)


def show(witnesses: DataFrame, limit: int = 20, last_first: bool = False) -> str:
    """Some witnesses (of SEL, SRT or GRP, or pairs of CP, TJ and NJ) as trees."""
    parts = []
    for row in witnesses.limit(limit).collect():
        if "root" in row.__fields__:
            parts.append("\n".join([f"--{row['root']}", text(row, "left_", 2, last_first), text(row, "right_", 2, last_first)]))
        else:
            parts.append(text(row, "", 0, last_first))
    return "\n\n".join(parts)


def counted(witnesses: DataFrame) -> str:
    return f"{witnesses.count()} records of {width(witnesses) or 'joined'} nodes"
