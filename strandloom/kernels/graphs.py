"""Biconnected components and maximum-weight matching."""

from __future__ import annotations

from heapq import heappop, heappush


def biconnected(edges: list[tuple[int, int]]) -> list[int]:
    """A component number for each edge, by a depth-first search without recursion (Hopcroft and Tarjan)."""
    near: dict[int, list[tuple[int, int]]] = {}
    for i, (u, v) in enumerate(edges):
        near.setdefault(u, []).append((v, i))
        near.setdefault(v, []).append((u, i))
    found, low, label, clock, comp = {}, {}, [-1] * len(edges), 0, 0
    for root in sorted(near):
        if root in found:
            continue
        found[root] = low[root] = clock
        clock += 1
        walk, held = [(root, -1, iter(near[root]))], []
        while walk:
            u, via, rest = walk[-1]
            for v, i in rest:
                if i == via:
                    continue
                if v not in found:
                    held.append(i)
                    found[v] = low[v] = clock
                    clock += 1
                    walk.append((v, i, iter(near[v])))
                    break
                if found[v] < found[u]:
                    held.append(i)
                    low[u] = min(low[u], found[v])
            else:
                walk.pop()
                if walk:
                    p = walk[-1][0]
                    low[p] = min(low[p], low[u])
                    if low[u] >= found[p]:
                        while True:
                            i = held.pop()
                            label[i] = comp
                            if i == via:
                                break
                        comp += 1
    return label


class _Matcher:
    """A matching that grows by one vertex at a time and stays of maximum weight (Edmonds' weighted blossoms, primal-dual).

    Vertices have duals y >= 0, blossoms z >= 0; an edge inside the graph has y[u] + y[v] + (z of the blossoms around both) >= its weight, matched
    edges and those inside blossoms exactly so, and a vertex without a mate has y = 0. A new vertex gets the least dual that keeps this; while
    that is above 0 a tree of alternating paths is grown from it until the dual of some vertex in the tree reaches 0, which then stays
    alone, or the tree meets a vertex that is alone. Only vertices and edges of the tree are looked at.

    During a search the duals of outer (S) blossoms fall and those of inner (T) ones rise by one common amount, `gone`. What is stored for them is
    the amount at which the dual would be 0 (S: y + gone, z / 2 - gone; T: the other way round), so the point at which something happens is
    fixed when it is found, and one heap holds all that is to come: a stale entry is known by its slack.

    Weights are doubled, so all duals are whole numbers.
    """

    def __init__(self, n: int, edges: list[tuple[int, int, int]]):
        self.near: list[dict[int, int]] = [{} for _ in range(n)]
        for u, v, w in edges:
            if 2 * w > self.near[u].get(v, 0):
                self.near[u][v] = self.near[v][u] = 2 * w
        self.mate, self.y, self.there = [-1] * n, [0] * n, [False] * n
        # Blossoms: ids below n are vertices. kids[0] holds the base; links[i] is an edge from kids[i] to kids[i + 1].
        self.n, self.up, self.base, self.z = n, [-1] * n, list(range(n)), [0] * n
        self.kids: list[list[int]] = [[] for _ in range(n)]
        self.links: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.top = list(range(n))
        self.side: dict[int, int] = {}  # of the outermost blossoms in the tree: 1 is S, -1 is T
        self.via: dict[int, tuple[int, int]] = {}  # the edge through which a T blossom was reached, from S
        self.heap: list[tuple[int, int, int, int]] = []
        self.gone = 0

    def leaves(self, b: int) -> list[int]:
        out, stack = [], [b]
        while stack:
            x = stack.pop()
            if x < self.n:
                out.append(x)
            else:
                stack += self.kids[x]
        return out

    def slack(self, u: int, v: int, gone: int) -> int:
        s, t = self.side.get(self.top[u], 0), self.side.get(self.top[v], 0)
        return self.y[u] + self.y[v] - self.near[u][v] - (s + t) * gone

    def put_side(self, b: int, side: int) -> None:
        """Changes an outermost blossom's side; 0 is outside the tree. What follows from it goes to the heap."""
        gone, old = self.gone, self.side.get(b, 0)
        if old == side:
            return
        turn = (side - old) * gone
        if side:
            self.side[b] = side
        else:
            del self.side[b]
        inside = self.leaves(b)
        for v in inside:
            self.y[v] += turn
        if b >= self.n:
            self.z[b] -= 2 * turn
            if side < 0:
                heappush(self.heap, (self.z[b] // 2, 3, b, 0))
        for v in inside if side >= 0 else ():
            if side:
                heappush(self.heap, (self.y[v], 0, v, 0))
            for u in self.near[v]:
                if not self.there[u] or (c := self.top[u]) == b:
                    continue
                other = self.side.get(c, 0)
                if side and other == 0:
                    heappush(self.heap, (self.slack(v, u, gone) + gone, 1, v, u))
                elif side and other > 0:
                    heappush(self.heap, (self.slack(v, u, gone) // 2 + gone, 2, v, u))
                elif not side and other > 0:
                    heappush(self.heap, (self.slack(u, v, gone) + gone, 1, u, v))

    def rebase(self, b: int, v: int) -> None:
        """Matches inside b so that all but v have a mate in b."""
        todo = [(b, v)]
        while todo:
            b, v = todo.pop()
            if b < self.n:
                continue
            c = v
            while self.up[c] != b:
                c = self.up[c]
            i = self.kids[b].index(c)
            self.kids[b] = kids = self.kids[b][i:] + self.kids[b][:i]
            self.links[b] = links = self.links[b][i:] + self.links[b][:i]
            self.base[b] = v
            todo.append((c, v))
            for j in range(1, len(kids), 2):
                p, q = links[j]
                self.mate[p], self.mate[q] = q, p
                todo += [(kids[j], p), (kids[j + 1], q)]

    def augment(self, v: int, partner: int) -> None:
        """Gives S vertex v a new partner (-1: none), and those up the tree the partners that this frees."""
        while True:
            b = self.top[v]
            old = self.mate[self.base[b]]
            self.rebase(b, v)
            self.mate[v] = partner
            if old < 0:
                return
            t = self.top[old]
            x, end = self.via[t]
            self.rebase(t, end)
            self.mate[end] = x
            v, partner = x, end

    def way(self, v: int) -> tuple[list[int], list[tuple[int, int]]]:
        """The blossoms from v's to the root's, and the edge from each to the next."""
        b = self.top[v]
        blossoms, edges = [b], []
        while (m := self.mate[self.base[b]]) >= 0:
            t = self.top[m]
            x, end = self.via[t]
            edges += [(self.base[b], m), (end, x)]
            b = self.top[x]
            blossoms += [t, b]
        return blossoms, edges

    def shrink(self, u: int, v: int) -> None:
        """The odd cycle that edge u-v closes becomes an S blossom."""
        (one, e1), (two, e2) = self.way(u), self.way(v)
        i, j = len(one), len(two)
        while i and j and one[i - 1] == two[j - 1]:
            i, j = i - 1, j - 1
        # one[i] and two[j] are the same blossom: where the ways meet.
        kids = [one[i], *one[:i][::-1], *two[:j]]
        links = [(q, p) for p, q in e1[:i][::-1]] + [(u, v)] + e2[:j]
        b = len(self.up)
        root = kids[0]
        for k in kids:
            if self.side[k] < 0:
                self.put_side(k, 1)
        for k in kids:
            if k >= self.n:
                self.z[k] += 2 * self.gone
            del self.side[k]
            self.via.pop(k, None)
            self.up[k] = b
        self.up.append(-1)
        self.base.append(self.base[root])
        self.kids.append(kids)
        self.links.append(links)
        self.z.append(-2 * self.gone)
        self.side[b] = 1
        for x in self.leaves(b):
            self.top[x] = b

    def expand(self, b: int) -> None:
        """A T blossom whose dual is 0 falls apart; the way through it stays in the tree."""
        kids, links, edge = self.kids[b], self.links[b], self.via.pop(b)
        del self.side[b]
        c = edge[1]
        while self.up[c] != b:
            c = self.up[c]
        i, m = kids.index(c), len(kids)
        for k in kids:
            self.up[k] = -1
            # Their vertices still hold the T side's amounts.
            self.side[k] = -1
            if k >= self.n:
                self.z[k] += 2 * self.gone
            for x in self.leaves(k):
                self.top[x] = k
        order = [*range(i, m), 0] if i % 2 else list(range(i, -1, -1))
        on_way = [kids[k] for k in order]
        for at, k in enumerate(order):
            if at % 2 == 0:
                if at:
                    p = order[at - 1]
                    edge = links[p] if p < k or k == 0 and p == m - 1 else links[k][::-1]
                self.via[kids[k]] = edge
                if kids[k] >= self.n:
                    heappush(self.heap, (self.z[kids[k]] // 2, 3, kids[k], 0))
        for k in kids:
            if k not in on_way:
                self.put_side(k, 0)
        for k in on_way[1::2]:
            self.put_side(k, 1)
        self.kids[b], self.links[b], self.z[b] = [], [], 0

    def add(self, r: int) -> None:
        self.there[r] = True
        self.y[r] = max(0, max((w - self.y[u] for u, w in self.near[r].items() if self.there[u]), default=0))
        if not self.y[r]:
            return
        self.gone, self.heap = 0, []
        self.put_side(r, 1)
        while not self._step():
            pass
        for b in list(self.side):
            turn = self.side[b] * self.gone
            for v in self.leaves(b):
                self.y[v] -= turn
            if b >= self.n:
                self.z[b] += 2 * turn
        self.side.clear()
        self.via.clear()

    def _step(self) -> bool:
        """What happens next; whether it ends the search."""
        at, kind, a, b = heappop(self.heap)
        if kind == 0:
            if self.side.get(self.top[a]) != 1 or self.y[a] != at:
                return False
            self.gone = at
            self.augment(a, -1)
            return True
        if kind == 3:
            if self.side.get(a) != -1 or self.up[a] >= 0 or self.z[a] != 2 * at:
                return False
            self.gone = at
            self.expand(a)
            return False
        s, t = self.side.get(self.top[a], 0), self.side.get(self.top[b], 0)
        if s != 1 or t != kind - 1 or self.top[a] == self.top[b] or self.slack(a, b, at):
            return False
        self.gone = at
        if kind == 2:
            self.shrink(a, b)
            return False
        c = self.top[b]
        m = self.mate[self.base[c]]
        if m < 0:
            self.augment(a, b)
            self.rebase(c, b)
            self.mate[b] = a
            return True
        self.via[c] = (a, b)
        self.put_side(c, -1)
        self.put_side(self.top[m], 1)
        return False


def matching_with_duals(edges: list[tuple[int, int, int]]) -> tuple[list[int], dict[int, int], list[tuple[list[int], int]]]:
    """(indices of a matching of maximum weight, duals of the vertices, blossoms with a dual: vertices and dual), for positive integer weights in any graph.

    The duals prove it: for every edge, y of both ends and z of the blossoms around both come to twice its weight at least, and all y with
    (vertices - 1) / 2 times z of every blossom come to twice the matching's weight. n searches of O(m log m) heap steps in the worst case.
    """
    names = sorted({x for u, v, _ in edges for x in (u, v)})
    at = {x: i for i, x in enumerate(names)}
    best: dict[tuple[int, int], int] = {}
    for i, (u, v, w) in enumerate(edges):
        key = (min(at[u], at[v]), max(at[u], at[v]))
        if w > 0 and u != v and (key not in best or w > edges[best[key]][2]):
            best[key] = i
    g = _Matcher(len(names), [(*key, edges[i][2]) for key, i in best.items()])
    for v in range(len(names)):
        g.add(v)
    blossoms = [([names[x] for x in g.leaves(b)], g.z[b]) for b in range(g.n, len(g.up)) if g.kids[b] and g.z[b]]
    return sorted(best[u, v] for u, v in enumerate(g.mate) if v > u), {x: g.y[i] for i, x in enumerate(names)}, blossoms


def max_weight_matching(edges: list[tuple[int, int, int]]) -> list[int]:
    """Indices of a matching of maximum weight (positive integers) in any graph."""
    return matching_with_duals(edges)[0]


def greedy_matching(edges: list[tuple[int, int, int]]) -> list[int]:
    """Edges by weight, ties by ends, each taken if both its ends are free."""
    used, out = set(), []
    for i in sorted(range(len(edges)), key=lambda i: (-edges[i][2], edges[i][0], edges[i][1])):
        u, v, _ = edges[i]
        if u not in used and v not in used:
            used |= {u, v}
            out.append(i)
    return sorted(out)
