"""Low links, which need one task with a whole component."""

from __future__ import annotations


def low_links(edges: list[tuple]) -> tuple[list[tuple], list]:
    """Bridges (a < b) and articulation points, by an iterative depth-first search."""
    adj: dict = {}
    for i, (a, b) in enumerate(edges):
        adj.setdefault(a, []).append((b, i))
        adj.setdefault(b, []).append((a, i))
    num, low, br, art, n = {}, {}, [], set(), 0
    for root in sorted(adj):
        if root in num:
            continue
        num[root] = low[root] = n
        n += 1
        stack, roots = [(root, -1, iter(adj[root]))], 0
        while stack:
            v, via, it = stack[-1]
            for w, i in it:
                if i == via:
                    continue
                if w in num:
                    low[v] = min(low[v], num[w])
                else:
                    num[w] = low[w] = n
                    n += 1
                    stack.append((w, i, iter(adj[w])))
                    break
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] > num[u]:
                        br.append((min(u, v), max(u, v)))
                    if u == root:
                        roots += 1
                    elif low[v] >= num[u]:
                        art.add(u)
        if roots > 1:
            art.add(root)
    return sorted(br), sorted(art)
