"""The declared join graph: aliases, paths and their disambiguation."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from plumbline.errors import Refusal
from plumbline.model import FANNING, Join, Source


@dataclass(frozen=True)
class Edge:
    """A join from the relation known as ``origin`` to the one known as ``alias``."""

    origin: str
    join: Join

    @property
    def alias(self) -> str:
        return self.join.alias

    @property
    def fans(self) -> bool:
        return self.join.relationship in FANNING


def alias_tree(owner: str, sources: dict[str, Source]) -> dict[str, str]:
    """Every alias that can be reached from the owner, breadth first, and the source it stands for."""
    found, queue = {owner: owner}, deque([owner])
    while queue:
        for join in sources[found[queue.popleft()]].joins:
            if join.to in sources and join.alias not in found:
                found[join.alias] = join.to
                queue.append(join.alias)
    return found


def simple_paths(owner: str, target: str, sources: dict[str, Source], tree: dict[str, str]) -> list[tuple[Edge, ...]]:
    """All ways from the owner to the target that meet no alias twice."""
    found: list[tuple[Edge, ...]] = []

    def go(at: str, way: tuple[Edge, ...], met: frozenset[str]) -> None:
        for join in sources[tree[at]].joins:
            if join.alias in met or join.alias not in tree or tree[join.alias] != join.to:
                continue
            step = (*way, Edge(at, join))
            if join.alias == target:
                found.append(step)
            else:
                go(join.alias, step, met | {join.alias})

    go(owner, (), frozenset([owner]))
    return found


def plan(owner: str, targets: set[str], sources: dict[str, Source], via: tuple[str, ...] = ()) -> list[Edge]:
    """The joins that bring the targets in, each once, in an order that works."""
    tree, edges = alias_tree(owner, sources), []
    joined = {owner}
    for target in sorted(targets):
        if target in joined:
            continue
        ways = simple_paths(owner, target, sources, tree) if target in tree else []
        if not ways:
            raise Refusal("unreachable", f"no declared joins lead from {owner} to {target}")
        if len(ways) > 1:
            shown = [" > ".join(e.alias for e in way) for way in ways]
            if via:
                ways = [w for w in ways if tuple(e.alias for e in w)[: len(via)] == via]
                if not ways:
                    raise Refusal("unreachable", f"no way from {owner} to {target} goes via {' > '.join(via)}", shown)
            if len(ways) > 1:
                raise Refusal("ambiguous_join_path", f"{len(ways)} ways lead from {owner} to {target}; say which with via", shown)
        for edge in ways[0]:
            if edge.alias not in joined:
                edges.append(edge)
                joined.add(edge.alias)
    return edges


def reachable_dimensions(owner: str, sources: dict[str, Source]) -> list[str]:
    """Names of the dimensions an owner can be grouped by, with the alias where the bare name isn't unique."""
    at: dict[str, list[str]] = {}
    for alias, name in alias_tree(owner, sources).items():
        for d in sources[name].dimensions:
            at.setdefault(d.name, []).append(alias)
    out = set()
    for name, aliases in at.items():
        out |= {name} if len(aliases) == 1 or owner in aliases else set()
        out |= {f"{a}.{name}" for a in aliases if a != owner} if len(aliases) > 1 else set()
    return sorted(out)
