"""Community detection by modularity (Louvain) on weighted undirected graphs."""

from __future__ import annotations

import random
from collections import defaultdict


def modularity(edges: list[tuple], community: dict, total: float | None = None) -> float:
    """Weighted modularity; a self loop counts once in the total and twice in its node's degree."""
    m = total if total is not None else sum(w for _, _, w in edges)
    if not m:
        return 0.0
    inside, degree = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        if community[a] == community[b]:
            inside[community[a]] += w
        degree[community[a]] += w
        degree[community[b]] += w
    return sum(inside[c] / m - (degree[c] / (2 * m)) ** 2 for c in degree)


def louvain(nodes: list, edges: list[tuple], seed: int | None = 42, total: float | None = None, threshold: float = 1e-7) -> dict:
    """Community of each node.  ``total`` is the whole graph's weight if these edges are one component of it.

    Nodes are visited in an order shuffled by the seed from the sorted one; weights must not be negative.
    """
    order = {v: i for i, v in enumerate(sorted(nodes))}
    near: list[dict[int, float]] = [defaultdict(float) for _ in order]
    loops = [0.0] * len(order)
    for a, b, w in edges:
        i, j = order[a], order[b]
        if i == j:
            loops[i] += w
        else:
            near[i][j] += w
            near[j][i] += w
    m = total if total is not None else sum(w for _, _, w in edges)
    member = list(range(len(order)))  # of the original nodes
    if not m:
        return {v: i for v, i in order.items()}
    rng = random.Random(seed)
    while True:
        n = len(near)
        degree = [sum(near[i].values()) + 2 * loops[i] for i in range(n)]
        community, weight = list(range(n)), degree[:]
        visit = list(range(n))
        rng.shuffle(visit)
        moved, any_move = True, False
        while moved:
            moved = False
            for i in visit:
                to: dict[int, float] = defaultdict(float)
                for j, w in near[i].items():
                    to[community[j]] += w
                own = community[i]
                weight[own] -= degree[i]
                stay = to.get(own, 0.0) / m - weight[own] * degree[i] / (2 * m * m)
                best, gain = own, stay + threshold * 1e-3
                for c, w in sorted(to.items()):
                    g = w / m - weight[c] * degree[i] / (2 * m * m)
                    if g > gain:
                        best, gain = c, g
                weight[best] += degree[i]
                if best != own:
                    community[i], moved, any_move = best, True, True
        if not any_move:
            break
        names = {c: k for k, c in enumerate(dict.fromkeys(community))}
        member = [names[community[x]] for x in member]
        new: list[dict[int, float]] = [defaultdict(float) for _ in names]
        new_loops = [0.0] * len(names)
        for i in range(n):
            a = names[community[i]]
            new_loops[a] += loops[i]
            for j, w in near[i].items():
                b = names[community[j]]
                if a == b:
                    new_loops[a] += w / 2
                else:
                    new[a][b] += w
        near, loops = new, new_loops
    names = {c: k for k, c in enumerate(dict.fromkeys(member))}
    return {v: names[member[i]] for v, i in order.items()}
