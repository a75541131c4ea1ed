import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph as G
from lodestar.operators.graph_local import low_links


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(4)
    pairs = sorted({tuple(sorted(rnd.sample(range(24), 2))) for _ in range(48)})
    return pairs, G.cut(G.undirected(spark.createDataFrame(pairs, "a long, b long")))


def adjacency(pairs):
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    return adj


def test_triangles_and_chains(graph):
    pairs, e = graph
    adj = adjacency(pairs)
    nodes = sorted(adj)
    assert sorted(tuple(r) for r in G.triangles(e).collect()) == [t for t in itertools.combinations(nodes, 3) if all(y in adj[x] for x, y in itertools.combinations(t, 2))]
    want = [t for t in itertools.combinations(nodes, 4) if t[1] in adj[t[0]] and t[2] in adj[t[1]] and t[3] in adj[t[2]] and t[2] not in adj[t[0]] and t[3] not in adj[t[0]] and t[3] not in adj[t[1]]]
    assert sorted(tuple(r) for r in G.chains(e).collect()) == want


def test_core_and_components(graph):
    pairs, e = graph
    adj = adjacency(pairs)
    left = {k: set(v) for k, v in adj.items()}
    while bad := [k for k, v in left.items() if len(v) < 3]:
        for k in bad:
            for x in left.pop(k):
                left.get(x, set()).discard(k)
    assert sorted(r.node for r in G.k_core(e, 3).collect()) == sorted(left)
    seen = {}
    for s in sorted(adj):
        if s not in seen:
            stack = [s]
            while stack:
                v = stack.pop()
                if v not in seen:
                    seen[v] = s
                    stack += adj[v]
    assert {r.node: r.component for r in G.components(e).collect()} == seen


def test_bridges_by_removal(graph):
    pairs, _ = graph

    def parts(ps, nodes):
        adj, seen, n = adjacency(ps), set(), 0
        for s in nodes:
            if s not in seen:
                n += 1
                stack = [s]
                while stack:
                    v = stack.pop()
                    if v not in seen:
                        seen.add(v)
                        stack += adj.get(v, ())
        return n

    nodes = {x for p in pairs for x in p}
    br, art = low_links(pairs)
    assert br == [p for p in pairs if parts([q for q in pairs if q != p], nodes) > parts(pairs, nodes)]
    assert art == sorted(v for v in nodes if parts([q for q in pairs if v not in q], nodes - {v}) > parts(pairs, nodes))


def test_betweenness_by_all_shortest_paths(spark, graph):
    pairs, e = graph
    adj = adjacency(pairs)
    want = dict.fromkeys(adj, 0.0)
    for s in adj:
        for t in adj:
            paths, level = [], [[s]]
            while level and not paths and s != t:
                level = [[*p, n] for p in level for n in adj[p[-1]] if n not in p]
                paths = [p for p in level if p[-1] == t]
            for p in paths:
                for v in p[1:-1]:
                    want[v] += 1 / len(paths)
    got = {r.node: r.score for r in G.betweenness(e, e.select(F.col("src").alias("source")).distinct()).collect()}
    assert got == pytest.approx(want)


def test_betweenness_of_a_path(spark):
    e = G.undirected(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"))
    got = {r.node: r.score / 2 for r in G.betweenness(e, e.select(F.col("src").alias("source")).distinct()).collect()}
    assert got == {1: 0, 2: 2, 3: 2, 4: 0}


def test_hops_and_evidence(spark):
    e = G.undirected(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a long, b long"))
    got = {(r.source, r.node): r.hops for r in G.hops(e, spark.createDataFrame([(1,)], "source long"), 3).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3}
    p = G.evidence_paths(e.withColumn("w", F.lit(0.5)), spark.createDataFrame([(1,)], "source long"), spark.createDataFrame([(3,)], "target long")).first()
    assert list(p.path) == [1, 2, 3] and p.score == 0.25 and p.hops == 2


def test_label_propagation_and_rank(spark):
    e = G.undirected(spark.createDataFrame([(1, 2), (1, 3), (2, 3), (10, 11), (10, 12), (11, 12)], "a long, b long"))
    lab = {r.node: r.label for r in G.label_propagation(e, 6).collect()}
    assert len({lab[1], lab[2], lab[3]} & {lab[10], lab[11], lab[12]}) == 0
    assert all(r.rank == pytest.approx(1.0) for r in G.pagerank(e, 6).collect())


def test_fast_rp_repeats(spark):
    e = G.cut(G.undirected(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")))
    a, b = ({r.node: list(r.embedding) for r in G.fast_rp(e, 8).collect()} for _ in range(2))
    assert a == b and all(len(v) == 8 for v in a.values())
