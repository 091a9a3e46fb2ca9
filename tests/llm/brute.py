"""Plain computations that the operators are held against."""

from collections import defaultdict


def classes(nodes, links):
    """node -> least node that links lead to."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def groups(pairs):
    out = defaultdict(set)
    for key, value in pairs:
        out[key].add(value)
    return out
