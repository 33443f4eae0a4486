"""Levels, cycles and components of graphs against plain Python, and the number of rounds."""

import random

import pytest

from millrace.operators import graph


def plain(n, edges):
    """Levels by longest distance and components by reachability."""
    outs = {}
    for a, b in edges:
        outs.setdefault(a, set()).add(b)
    reach = {}
    for v in range(n):
        seen, todo = set(), [v]
        while todo:
            for w in outs.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        reach[v] = seen
    ends = {v for e in edges for v in e}
    bad = {v for v in ends if any(u in reach[u] and (v == u or v in reach[u]) for u in ends)}
    level = {}

    def depth(v):
        if v not in level:
            level[v] = max((depth(a) + 1 for a, b in edges if b == v), default=0)
        return level[v]

    levels = {v: depth(v) for v in range(n) if v not in bad}
    component = {v: min([w for w in reach[v] if v in reach[w]] + [v]) for v in ends}
    return levels, {(c, sum(x == c for x in component.values()), c in reach[c]) for c in component.values()}


def frames(spark, graphs):
    edges = [(g, a, b) for g, (_, es) in enumerate(graphs) for a, b in es]
    nodes = [(g, v) for g, (n, _) in enumerate(graphs) for v in range(n)]
    return spark.createDataFrame(nodes, "graph long, node long"), spark.createDataFrame(edges, "graph long, src long, dst long")


def test_random_graphs(spark):
    dice = random.Random(4)
    graphs = [(9, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (6, 6), (7, 8)]), (6, [(k, (k + 1) % 6) for k in range(6)])]
    graphs += [(7, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 1), (0, 5), (5, 6), (6, 4)]), (3, []), (5, [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)])]
    for _ in range(20):
        n = dice.randrange(2, 14)
        graphs.append((n, [(dice.randrange(n), dice.randrange(n)) for _ in range(dice.randrange(1, n + 4))]))
    nodes, edges = frames(spark, graphs)
    edges = edges.unionByName(edges.limit(5))
    levels, found = {}, {}
    for r in graph.topological_levels(nodes, edges).collect():
        assert r.node not in levels.setdefault(r.graph, {})
        levels[r.graph][r.node] = r.level
    levels = {g: {v: level for v, level in own.items() if level is not None} for g, own in levels.items()}
    for r in graph.components(edges).collect():
        found.setdefault(r.graph, set()).add((r.component, r.nodes, r.is_cycle))
    for g, (n, es) in enumerate(graphs):
        want = plain(n, es)
        assert (levels.get(g, {}), found.get(g, set())) == want, (g, es)
    unplaced = {(r.graph, r.node) for r in graph.cyclic_nodes(edges).collect()}
    assert unplaced == {(g, v) for g, (n, es) in enumerate(graphs) for v in range(n) if v not in plain(n, es)[0]}


@pytest.mark.parametrize("closed", [False, True])
def test_a_long_chain_takes_few_rounds(spark, closed):
    n = 10_000
    edges = spark.range(n if closed else n - 1).selectExpr("1L as graph", "id as src", f"(id + 1) % {n} as dst")
    short = graph.shortened(edges)
    assert short.rounds <= 15
    if closed:
        row = graph.components(edges).collect()
        assert [tuple(r) for r in row] == [(1, 0, n, True)]
    else:
        levels = graph.topological_levels(spark.range(n).selectExpr("1L as graph", "id as node"), edges)
        assert graph._peeled(short.edges)[1] <= 3
        assert levels.where("node <> level").count() == 0 and levels.count() == n


def test_no_edges(spark):
    nodes, edges = frames(spark, [(3, [])])
    assert graph.components(edges).count() == graph.cyclic_nodes(edges).count() == 0
    assert {r.level for r in graph.topological_levels(nodes, edges).collect()} == {0}


def test_no_round_sends_a_table_through_the_driver(spark, monkeypatch):
    plans, written = [], graph._written

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(graph, "_written", lambda df, *args: written(plan(df), *args))
    nodes, edges = frames(spark, [(6, [(0, 1), (1, 2), (2, 0), (0, 2), (2, 3), (3, 4), (4, 5)]), (3, [(0, 1), (1, 2), (0, 2)])])
    for found in (graph.cyclic_nodes(edges), graph.components(edges), graph.topological_levels(nodes, edges)):
        plan(found)
    assert any("SortMergeJoin" in text for text in plans)
    assert not [text for text in plans if "Broadcast" in text]
