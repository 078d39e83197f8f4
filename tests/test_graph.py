import random
import time

from vantage.operators import graph

EDGE = "src_repo string, src_id string, dst_repo string, dst_id string, scope string, kind string"


def depth_first(edges, sources, max_nodes=8, per_source=50, total=500):
    """Chains in preorder, by plain recursion with early stops."""
    out = []
    for s in sources:
        own = []

        def walk(path, scopes):
            for dst, scope, _ in edges.get(path[-1], []):
                if len(own) >= per_source:
                    return
                if dst in path:
                    continue
                p, c = [*path, dst], [*scopes, scope]
                if "cross" in c:
                    own.append((s, p, c))
                if len(p) < max_nodes:
                    walk(p, c)

        walk([s], ["source"])
        out += own[:per_source]
    return out[:total]


def random_graph(rng, nodes, degree):
    ids = [(f"r{i % 3}", f"n{i:02d}") for i in range(nodes)]
    rows = []
    for a in ids:
        for _ in range(rng.randint(0, degree)):
            b = rng.choice(ids)
            rows.append((*a, *b, "call" if a[0] == b[0] else "cross", rng.choice(["x", "y"])))
    return ids, rows


def adjacency(rows):
    out = {}
    for a1, a2, b1, b2, scope, kind in sorted(rows, key=lambda r: (r[0], r[1], r[4], r[2], r[3], r[5])):
        out.setdefault((a1, a2), []).append(((b1, b2), scope, kind))
    return out


def test_chains_equal_depth_first_search(spark):
    for seed, (n, degree, caps) in enumerate([(12, 2, (8, 50, 500)), (20, 4, (6, 7, 40)), (30, 5, (5, 50, 500)), (9, 3, (8, 3, 1000))]):
        ids, rows = random_graph(random.Random(seed), n, degree)
        sources = sorted(ids[::2])
        want = depth_first(adjacency(rows), sources, *caps)
        got = graph.chains(graph.numbered(spark.createDataFrame(rows, EDGE)), spark.createDataFrame(sources, "repo string, node_id string"), *caps).orderBy("place").collect()
        assert [((r.source_repo, r.source_id), [tuple(x) for x in r.path], list(r.scopes)) for r in got] == want
        assert len(want) > 5


def test_reach_equals_search(spark):
    ids, rows = random_graph(random.Random(9), 60, 2)
    edges, start = adjacency(rows), ids[:3]
    seen, todo = set(start), list(start)
    while todo:
        for d, _, _ in edges.get(todo.pop(), []):
            if d not in seen:
                seen.add(d)
                todo.append(d)
    got = graph.reachable(spark.createDataFrame(rows, EDGE), spark.createDataFrame(start, "repo string, node_id string"))
    assert {tuple(r) for r in got.collect()} == seen


def test_exposure(spark):
    calls = spark.createDataFrame([("backend", "b1", "b2")], "repo string, source_id string, target_id string")
    cross = spark.createDataFrame([("frontend", "f1", "backend", "b1", "http"), ("frontend", "", "backend", "", "http")], "client_repo string, client_node_id string, server_repo string, server_node_id string, link_type string")
    sources = spark.createDataFrame([("frontend", "f1"), ("frontend", "")], "repo string, node_id string")
    names = spark.createDataFrame([("frontend", "f1", "fetch"), ("backend", "b1", "handle")], "repo string, node_id string, name string")
    s = graph.exposure(calls, cross, sources, names)
    assert [tuple(r) for r in s["reachable"].collect()] == [("backend", "b1", "handle"), ("backend", "b2", ""), ("frontend", "f1", "fetch")]
    assert [[x.node_id for x in r.path] for r in s["chains"].orderBy("place").collect()] == [["f1", "b1"], ["f1", "b1", "b2"]]
    alone = graph.exposure(calls.limit(0), cross.limit(0), spark.createDataFrame([("backend", "b1")], "repo string, node_id string"), names)
    assert alone["reachable"].count() == 1 and alone["chains"].count() == 0


def test_subgraph_and_statistics(spark):
    n = spark.createDataFrame([("r", f"n{i}", "function") for i in range(5)], "repo string, node_id string, kind string")
    e = spark.createDataFrame([("r", "n0", "n1", "calls"), ("r", "n1", "n2", "calls"), ("r", "n3", "n3", "calls"), ("r", "n1", "ext", "calls"), ("r", "n0", "n4", "inherits")], "repo string, source_id string, target_id string, kind string")
    start = spark.createDataFrame([("r", "n1")], "repo string, node_id string")
    kept, links = graph.subgraph(n, e, start)
    assert {r.node_id for r in kept.collect()} == {"n0", "n1", "n2"} and links.count() == 4
    assert graph.subgraph(n, e, start.limit(0))[0].count() == 0
    s = graph.statistics(n, e).first()
    assert (s.total_nodes, s.functions, s.total_edges, s.call_edges, s.inherit_edges) == (5, 5, 5, 4, 1)
    assert {r.node_id for r in graph.roots(n, e).collect()} == {"n0", "n4"}
    assert {(r.source_id, r.target_id) for r in graph.valid_calls(n, e).collect()} == {("n0", "n1"), ("n1", "n2"), ("n3", "n3")}


def test_chains_cost_nothing_without_a_crossing(spark):
    """Fully joined layers hold 335,922 open paths; none is walked where no cross edge can be reached."""
    layers = [[f"n{k}_{i}" for i in range(6 if k else 1)] for k in range(8)]
    calls = [("r", a, b) for k in range(7) for a in layers[k] for b in layers[k + 1]]
    edges = spark.createDataFrame([(r, a, r, b, "call", "") for r, a, b in calls], "src_repo string, src_id string, dst_repo string, dst_id string, scope string, kind string")
    start = spark.createDataFrame([("r", "n0_0")], "repo string, node_id string")
    began = time.perf_counter()
    assert graph.chains(graph.numbered(edges), start).collect() == []
    assert time.perf_counter() - began < 30
    # a cross edge at the last layer is seven steps away: paths of eight nodes end before it, a shorter way is found
    far = edges.unionByName(spark.createDataFrame([("r", "n7_0", "s", "x", "cross", "http"), ("r", "n1_3", "s", "y", "cross", "http")], edges.schema))
    found = graph.chains(graph.numbered(far), start).collect()
    assert [[n.node_id for n in r.path] for r in found] == [["n0_0", "n1_3", "y"]]
