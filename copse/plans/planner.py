"""Pattern trees as chains of structural joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.operators.structural import holds, levels_of, named, structural_join, usual
from copse.plans.pattern import Pattern, Rule


def tag_counts(nodes: DataFrame, tags: tuple[str, ...]) -> dict[str, int]:
    """How many nodes the tags of a pattern have; * has all. One small aggregate, bounded by the pattern."""
    found = {r["tag"]: r["n"] for r in nodes.filter(F.col("tag").isin(*tags)).groupBy("tag").agg(F.count("*").alias("n")).collect()}
    return {t: nodes.count() if t == "*" else found.get(t, 0) for t in dict.fromkeys(tags)}


def selective(pattern: Pattern, counts: dict[str, int]) -> list[Rule]:
    """Rules in an order that begins at the rarest tag and always takes the rule with the rarest new one."""
    left = list(pattern.rules)
    bound = {min(range(1, len(pattern.tags) + 1), key=lambda i: (counts[pattern.tags[i - 1]], i))}
    out = []
    while left:
        at = [r for r in left if r.upper in bound or r.lower in bound]
        new = lambda r: [counts[pattern.tags[i - 1]] for i in (r.upper, r.lower) if i not in bound] or [-1]
        best = min(at, key=lambda r: (new(r)[0], r.upper, r.lower))
        out.append(best)
        left.remove(best)
        bound |= {best.upper, best.lower}
    return out


def match(nodes: DataFrame, pattern: Pattern, strategy: str = "equi", reverse: bool = False, counts: dict[str, int] | None = None, stitch: bool = False) -> DataFrame:
    """SEL: the witness table of a pattern.

    Rules are joined in breadth-first order, or by selectivity if the tags' counts are given; the columns are in binding
    order either way. A rule between two bound nodes is a filter. stitch joins the pairs of each rule on the shared node
    instead of growing the twig node by node. strategy: as of structural_join(), or auto for the usual one of the table.
    """
    if strategy == "auto":
        strategy = usual(nodes)
    rules = selective(pattern, counts) if counts else pattern.ordered(reverse)
    side = lambda i: named(nodes, i, pattern.tags[i - 1])
    levels = lambda r: levels_of(nodes, pattern.tags[r.upper - 1]) if strategy == "equi" and r.axis == "AD" else None
    start = rules[0].upper if rules else 1
    if counts and rules:
        start = next(i for i in (rules[0].upper, rules[0].lower) if counts[pattern.tags[i - 1]] == min(counts[pattern.tags[j - 1]] for j in (rules[0].upper, rules[0].lower)))
    out, bound = side(start), {start}
    for r in rules:
        if {r.upper, r.lower} <= bound:
            out = out.filter(holds(r.upper, r.lower, r.axis))
            continue
        new = r.lower if r.upper in bound else r.upper
        old = r.upper + r.lower - new
        if stitch:
            found = structural_join(side(r.upper), side(r.lower), r.upper, r.lower, r.axis, strategy, levels=levels(r))
            again = found.select(F.col(f"doc_{old}").alias("_doc"), F.col(f"start_{old}").alias("_start"), *[c for c in found.columns if c.endswith(f"_{new}")])
            out = out.join(again, (F.col(f"doc_{old}") == F.col("_doc")) & (F.col(f"start_{old}") == F.col("_start"))).drop("_doc", "_start")
        else:
            out = structural_join(out, side(new), r.upper, r.lower, r.axis, strategy, levels=levels(r))
        bound.add(new)
    columns = [F.col(f"{p}_{n}").alias(f"{p}_{k}") for k, n in enumerate(pattern.binding(reverse), 1) for p in ("start", "end", "level", "tag")]
    return out.select(F.col(f"doc_{start}").alias("doc_id"), *columns)
