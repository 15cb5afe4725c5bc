"""Single-machine reference answers for small fixtures."""

from __future__ import annotations

import numpy as np


def core_distances(x: np.ndarray, k: int) -> np.ndarray:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return np.sort(d, axis=1)[:, min(k, len(x) - 1)]


def mst(x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int, int]]:
    """Kruskal over all pairs of the mutual reachability graph, ties by ids."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = core_distances(x, k)
    w = np.maximum(np.maximum(core[:, None], core[None]), d)
    pairs = sorted(
        (w[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(x)) for j in range(i + 1, len(x))
    )
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    chosen = []
    for weight, a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[ra] = rb
            chosen.append((weight, a, b))
    return chosen


def density_labels(x: np.ndarray, ids: np.ndarray, m: int, k: int) -> dict[int, int]:
    """Labels by the textbook recursion: dendrogram, condensed tree, excess of mass."""
    n = len(x)
    if n < 2:
        return {int(i): -1 for i in ids}
    members = {int(i): [int(i)] for i in ids}
    node_of = {int(i): int(i) for i in ids}
    children, height = {}, {}
    fresh = max(node_of) + 1
    for weight, a, b in mst(x, ids, k):
        left, right = node_of[int(a)], node_of[int(b)]
        children[fresh], height[fresh] = (left, right), max(weight, 1e-9)
        members[fresh] = members[left] + members[right]
        for i in members[fresh]:
            node_of[i] = fresh
        fresh += 1
    top = fresh - 1
    clusters = {0: {"birth": 0.0, "kids": [], "rows": []}}

    def walk(node, cluster):
        stack = [(node, cluster)]
        while stack:
            node, c = stack.pop()
            if node not in children:
                raise AssertionError("a single point is never walked")
            lam = 1.0 / height[node]
            big = [kid for kid in children[node] if len(members[kid]) >= m]
            if len(big) == 2:
                for kid in big:
                    name = len(clusters)
                    clusters[name] = {"birth": lam, "kids": [], "rows": []}
                    clusters[c]["kids"].append((name, lam, len(members[kid])))
                    start(kid, name, stack)
            else:
                for kid in children[node]:
                    if kid in big:
                        stack.append((kid, c))
                    else:
                        clusters[c]["rows"] += [(i, lam) for i in members[kid]]

    def start(kid, name, stack):
        stack.append((kid, name))

    if n >= m:
        walk(top, 0)
    stability = {
        c: sum(lam - v["birth"] for _, lam in v["rows"]) + sum((lam - v["birth"]) * s for _, lam, s in v["kids"])
        for c, v in clusters.items()
    }
    chosen, value = {}, {}
    for c in sorted(clusters, reverse=True):
        below = sum(value[k2] for k2, _, _ in clusters[c]["kids"])
        chosen[c] = c != 0 and not below > stability[c]
        value[c] = stability[c] if chosen[c] else below
    labels = {int(i): -1 for i in ids}

    def collect(c):
        rows = [i for i, _ in clusters[c]["rows"]]
        for kid, _, _ in clusters[c]["kids"]:
            rows += collect(kid)
        return rows

    found, stack = [], [0]
    while stack:
        c = stack.pop()
        if chosen[c]:
            found.append(collect(c))
        else:
            stack += [k2 for k2, _, _ in clusters[c]["kids"]]
    for number, rows in enumerate(sorted(found, key=min)):
        for i in rows:
            labels[i] = number
    return labels
