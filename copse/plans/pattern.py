"""Pattern trees: tags, and parent-child or ancestor-descendant rules between them."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    upper: int
    lower: int
    axis: str


@dataclass(frozen=True)
class Pattern:
    """Nodes are told apart by index, from 1, so tags may repeat; the tag * is any tag."""

    tags: tuple[str, ...]
    rules: tuple[Rule, ...]

    def __post_init__(self) -> None:
        for r in self.rules:
            if r.axis not in ("PC", "AD"):
                raise ValueError(f"rule {r.upper} {r.lower}: {r.axis} is neither PC nor AD")
            if not (1 <= r.upper <= len(self.tags) and 1 <= r.lower <= len(self.tags)) or r.upper == r.lower:
                raise ValueError(f"rule {r.upper} {r.lower} names no two of the {len(self.tags)} nodes")
        if self.rules:
            rest = self.connected()
            if rest != set(range(1, len(self.tags) + 1)):
                raise ValueError(f"nodes {sorted(set(range(1, len(self.tags) + 1)) - rest)} are not connected to the first rule")
        elif len(self.tags) != 1:
            raise ValueError("several nodes need rules")

    def connected(self) -> set[int]:
        seen, queue = {self.rules[0].upper}, [self.rules[0].upper]
        while queue:
            n = queue.pop()
            for r in self.rules:
                for m in {r.upper, r.lower} - {n} if n in (r.upper, r.lower) else ():
                    if m not in seen:
                        seen.add(m)
                        queue.append(m)
        return seen

    def ordered(self, reverse: bool = False) -> list[Rule]:
        """Rules breadth-first from the upper node of the first one (of the last one, if reversed)."""
        rules = list(reversed(self.rules)) if reverse else list(self.rules)
        if not rules:
            return []
        out: list[Rule] = []
        seen, queue = {rules[0].upper}, deque([rules[0].upper])
        while queue:
            at = queue.popleft()
            for r in rules:
                if r not in out and at in (r.upper, r.lower):
                    out.append(r)
                    for n in (r.upper, r.lower):
                        if n not in seen:
                            seen.add(n)
                            queue.append(n)
        return out

    def binding(self, reverse: bool = False) -> list[int]:
        """Pattern nodes in the order in which the rules bind them: the order of witness columns."""
        bound = list(dict.fromkeys(n for r in self.ordered(reverse) for n in (r.upper, r.lower)))
        return bound or [1]

    def position(self, node: int, reverse: bool = False) -> int:
        return self.binding(reverse).index(node) + 1


def parse_pattern(text: str, width: int | None = 5) -> Pattern:
    """The number of nodes, their tags, then triples `i j PC|AD`, all parted by white space; tags are cut to width."""
    words = text.split()
    if not words or not words[0].isdigit():
        raise ValueError("a pattern begins with its number of nodes")
    n = int(words[0])
    tags, rest = words[1 : n + 1], words[n + 1 :]
    if len(tags) < n or len(rest) % 3:
        raise ValueError("a pattern has a tag for each node, and rules of three words")
    return Pattern(tuple(t[:width] for t in tags), tuple(Rule(int(a), int(b), x) for a, b, x in zip(*[iter(rest)] * 3, strict=True)))
