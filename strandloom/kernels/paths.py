"""Constrained path search, and the transitive reduction that uses it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import isqrt


@dataclass
class Graph:
    """Edges by id: (u, v, is_contig, d, std, bw); contig of node n is n // 2."""

    edges: dict[int, list]
    near: dict[int, list[int]] = field(default_factory=dict)

    def __post_init__(self):
        for i in sorted(self.edges):
            u, v = self.edges[i][:2]
            self.near.setdefault(u, []).append(i)
            self.near.setdefault(v, []).append(i)

    def other(self, i: int, u: int) -> int:
        a, b = self.edges[i][:2]
        return b if a == u else a

    def drop(self, i: int) -> None:
        u, v = self.edges.pop(i)[:2]
        self.near[u].remove(i)
        self.near[v].remove(i)


def alternates(kinds: list[bool]) -> bool:
    """Contig and mate edges take turns."""
    return all(a != b for a, b in zip(kinds, kinds[1:]))


def measure(g: Graph, path: list[int]) -> tuple[int, int]:
    """Length and deviation of a path of edge ids."""
    return sum(g.edges[i][3] for i in path), isqrt(sum(g.edges[i][4] ** 2 for i in path))


def search(g: Graph, source: int, target: int, bd: int, std: int, may_enter: Callable[[int], bool], supports: Callable[[list[int]], bool], most_iterations: int, most_paths: int, most_nodes: int = 80, tolerance: int = 4, skip: int | None = None) -> list[tuple[list[int], list[int]]]:
    """Simple alternating paths (nodes, edge ids) from source to target with a length near bd, depth first, last pushed first."""
    stack, out, turns = [([source], [])], [], 0
    while stack:
        nodes, path = stack.pop()
        turns += 1
        if turns > most_iterations:
            break
        plen, pvar = measure(g, path)
        near = abs(plen - bd) <= tolerance * max(std, pvar)
        if nodes[-1] == target:
            if len(nodes) >= 4 and near:
                out.append((nodes, path))
                if len(out) >= most_paths:
                    break
            continue
        if (plen > bd and not near) or len(nodes) > most_nodes:
            continue
        for i in g.near.get(nodes[-1], ()):
            v = g.other(i, nodes[-1])
            if i == skip or v in nodes or not (v == target or may_enter(v)):
                continue
            kinds = [g.edges[x][2] for x in (*path[-1:], i)]
            if not alternates(kinds) or not supports([i]):
                continue
            stack.append(([*nodes, v], [*path, i]))
    return out


def reduce_component(edges: dict[int, list], wanted: list[int], reads: dict[int, dict[int, int]], blocked: set[int], config) -> tuple[dict[int, int], list[tuple[int, int, int, int]]]:
    """Transitive reduction of one biconnected component.

    edges: id -> [u, v, is_contig, bd, std, bw]; reads: edge id -> {read: hits}, contig edges included; blocked: short and repeat
    nodes. Returns the mate edges' weights that changed and the reduced edges (id, plen, pvar, path weight). Edges are tried by distance; what one
    changes holds for the next.
    """

    def parts(i):
        needed = [r for r, h in reads.get(i, {}).items() if h > config.read_hits]
        return (lambda path: all(r in reads.get(x, ()) for x in path for r in needed)), (lambda x: sum(reads.get(x, {}).get(r, 0) for r in needed))

    return _reduced(edges, wanted, parts, blocked, config)


def reduce_supported(edges: dict[int, list], parts: dict[int, dict[int, int]], blocked: set[int], config) -> tuple[dict[int, int], list[tuple[int, int, int, int]]]:
    """reduce_component() of the edges in `parts`, where these say which edges carry the reads that an edge needs, itself included, and with how many hits."""
    return _reduced(edges, list(parts), lambda i: ((lambda path: all(x in parts[i] for x in path)), parts[i].__getitem__), blocked, config)


def _reduced(edges, wanted, parts, blocked, config):
    g, changed, reduced = Graph({i: list(e) for i, e in edges.items()}), {}, []
    for i in sorted(wanted, key=lambda i: (edges[i][3], i)):
        u, v, _, bd, std, bw = g.edges[i]
        supports, hits = parts(i)
        few = config.few_paths if bd >= config.lme else config.many_paths
        found = search(g, u, v, bd, std, lambda n: n not in blocked, supports, config.mit, few, config.max_path_nodes, config.tolerance, skip=i)
        best = None
        for nodes, path in found:
            weight = sum(map(hits, path))
            if best is None or weight >= best[0]:
                best = (weight, path)
        if best is None:
            continue
        for x in best[1]:
            if not g.edges[x][2]:
                g.edges[x][5] += bw
                changed[x] = g.edges[x][5]
        plen, pvar = measure(g, best[1])
        reduced.append((i, plen, pvar, best[0]))
        changed.pop(i, None)
        g.drop(i)
    return changed, reduced
