"""Graph operators: reachability, induced subgraphs, statistics, and bounded chains of calls across repositories.

Graphs are DataFrames: nodes (repo, node_id, ...) and edges. Iterations keep their state in the shared folder; only
counts and emptiness tests reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage import model as M
from vantage.runtime import discard, settled

CALLABLE = ("function", "method")


def reachable(edges: DataFrame, sources: DataFrame, hops: int = 3) -> DataFrame:
    """(repo, node_id) reached from ``sources`` along ``edges`` (src_repo, src_id, dst_repo, dst_id), sources included.

    Semi-naive: a round follows ``hops`` steps from what the round before found first, so a step's join never sees
    more than the frontier. Sources need not be nodes of the graph.
    """
    steps = edges.select("src_repo", "src_id", "dst_repo", "dst_id").where("src_id <> '' and dst_id <> ''").distinct()
    steps = settled(steps)
    seen = settled(sources.select("repo", "node_id").where("node_id <> ''").distinct())
    front, parts = seen, [seen]
    while not front.isEmpty():
        found, at = None, front
        for _ in range(hops):
            on = (F.col("repo") == F.col("src_repo")) & (F.col("node_id") == F.col("src_id"))
            at = at.join(steps, on).select(F.col("dst_repo").alias("repo"), F.col("dst_id").alias("node_id")).distinct()
            found = at if found is None else found.unionByName(at)
        front = settled(found.distinct().join(seen, ["repo", "node_id"], "left_anti"))
        parts.append(front)
        seen = seen.unionByName(front)
        if len(parts) > 8:  # many short rounds: one table instead of a long union
            seen = settled(seen)
            discard(*parts[:-1])
            parts = [seen, front]
    return seen


def reachable_undirected(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """(repo, node_id) reached from ``start`` over calls in both directions; only known nodes are walked to.

    ``edges`` are (repo, source_id, target_id, kind); start ids are kept even where they are no nodes.
    """
    calls = edges.where("kind = 'calls'").select("repo", "source_id", "target_id")
    both = calls.unionByName(calls.select("repo", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))
    known = both.join(nodes.select("repo", F.col("node_id").alias("target_id")).distinct(), ["repo", "target_id"], "left_semi")
    return reachable(known.select(F.col("repo").alias("src_repo"), F.col("source_id").alias("src_id"), F.col("repo").alias("dst_repo"), F.col("target_id").alias("dst_id")), start)


def subgraph(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes reached from ``start`` without regard to direction, and every edge with an end among them."""
    inside = reachable_undirected(nodes, edges, start)
    kept = nodes.join(inside, ["repo", "node_id"], "left_semi")
    ends = inside.withColumn("hit", F.lit(True))
    a = ends.select(F.col("repo").alias("r1"), F.col("node_id").alias("n1"), F.col("hit").alias("h1"))
    b = ends.select(F.col("repo").alias("r2"), F.col("node_id").alias("n2"), F.col("hit").alias("h2"))
    marked = edges.join(a, (F.col("repo") == F.col("r1")) & (F.col("source_id") == F.col("n1")), "left").join(b, (F.col("repo") == F.col("r2")) & (F.col("target_id") == F.col("n2")), "left")
    return kept, marked.where("h1 or h2").select(edges.columns)


def keep_marks(marks: DataFrame, inside: DataFrame, key: str = "node_id") -> DataFrame:
    """Annotations or entry points of nodes that are inside."""
    return marks.join(inside.select("repo", F.col("node_id").alias(key)), ["repo", key], "left_semi")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts by kind."""
    n = nodes.agg(
        F.count("*").alias("total_nodes"),
        *(F.count_if(F.col("kind") == k).alias(name) for k, name in (("function", "functions"), ("method", "methods"), ("class", "classes"), ("module", "modules"))),
    )
    e = edges.agg(
        F.count("*").alias("total_edges"),
        *(F.count_if(F.col("kind") == k).alias(name) for k, name in (("calls", "call_edges"), ("inherits", "inherit_edges"), ("contains", "contain_edges"))),
    )
    return n.crossJoin(e)  # a row by a row


def valid_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct calls whose ends are both functions or methods."""
    own = nodes.where(F.col("kind").isin(*CALLABLE)).select("repo", "node_id").distinct()
    calls = edges.where("kind = 'calls'").select("repo", "source_id", "target_id").distinct()
    calls = calls.join(own.withColumnRenamed("node_id", "source_id"), ["repo", "source_id"], "left_semi")
    return calls.join(own.withColumnRenamed("node_id", "target_id"), ["repo", "target_id"], "left_semi").select("repo", "source_id", "target_id")


def callers(edges: DataFrame) -> DataFrame:
    """Distinct callers and callees of every id that takes part in a call."""
    calls = edges.where("kind = 'calls'")
    into = calls.groupBy("repo", F.col("target_id").alias("node_id")).agg(F.count_distinct("source_id").alias("callers"))
    out = calls.groupBy("repo", F.col("source_id").alias("node_id")).agg(F.count_distinct("target_id").alias("callees"))
    zero = F.lit(0).cast("long")
    return into.join(out, ["repo", "node_id"], "full").select("repo", "node_id", F.coalesce("callers", zero).alias("callers"), F.coalesce("callees", zero).alias("callees"))


def roots(nodes: DataFrame, edges: DataFrame, skip: F.Column | None = None) -> DataFrame:
    """Functions and methods that no known node calls; one that calls itself is called. ``skip`` marks nodes left out."""
    own = nodes.where(F.col("kind").isin(*CALLABLE))
    own = own.where(~skip) if skip is not None else own
    known = edges.where("kind = 'calls'").join(nodes.select("repo", F.col("node_id").alias("target_id")).distinct(), ["repo", "target_id"], "left_semi")
    return own.join(known.select("repo", F.col("target_id").alias("node_id")).distinct(), ["repo", "node_id"], "left_anti").select(nodes.columns)


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge targets that are no nodes, with how many edges point there."""
    return edges.join(nodes.select("repo", F.col("node_id").alias("target_id")).distinct(), ["repo", "target_id"], "left_anti").groupBy("repo", "target_id").agg(F.count("*").alias("edges"))


def numbered(edges: DataFrame) -> DataFrame:
    """Adds ``ord``, an edge's place among its source's: calls before cross links, by target, then kind.

    A source's edges are sorted together, so the window's groups are as large as the largest out-degree.
    """
    w = Window.partitionBy("src_repo", "src_id").orderBy("scope", "dst_repo", "dst_id", "kind")
    return edges.withColumn("ord", F.row_number().over(w))


def chains(edges: DataFrame, sources: DataFrame, max_nodes: int = M.MAX_CHAIN_NODES, per_source: int = M.MAX_CHAINS_PER_SOURCE, total: int = M.MAX_CHAINS) -> DataFrame:
    """Chains from sources that cross repositories: (source_repo, source_id, path, scopes, ords, place).

    ``edges`` are numbered (src_repo, src_id, dst_repo, dst_id, scope 'call' or 'cross', ord). A chain is a path without
    repeated nodes that has crossed; it is one at every node from there on, up to ``max_nodes`` nodes. Depth-first
    preorder is the lexicographic order of edge places, prefixes first, so the first ``per_source`` chains of a source
    and the first ``total`` in source order are found by rank. A round adds one node to the longest paths and drops those
    that ``per_source`` chains already precede: nothing after them can count. The exact limits are the result's own.
    A path that hasn't crossed goes on only while a cross edge is near enough, by a backward search from the cross edges
    before, so a graph without any costs nothing. Sources are walked in order, in growing batches, until ``total`` chains
    stand. A source's open paths are ranked together: at most ``per_source`` times its nodes' out-degrees.
    """
    steps = settled(edges.where("src_id <> '' and dst_id <> ''").select("src_repo", "src_id", "dst_repo", "dst_id", "scope", "ord"))
    need = settled(_steps_to_cross(steps, max_nodes - 1))
    ahead = need.select(F.col("repo").alias("dst_repo"), F.col("node_id").alias("dst_id"), "need")
    steps = settled(steps.join(ahead, ["dst_repo", "dst_id"], "left"))
    left = sources.where("node_id <> ''").select("repo", "node_id").distinct().join(need, ["repo", "node_id"]).select("repo", "node_id")
    found, size = None, total
    while True:
        batch = settled(left.orderBy("repo", "node_id").limit(size))
        rows = _walk(steps, batch, max_nodes, per_source)
        found = rows if found is None else found.unionByName(rows)
        if batch.count() < size or found.limit(total).count() == total:
            break
        left, size = left.join(batch, ["repo", "node_id"], "left_anti"), 4 * size
    # at most per_source rows a source are left, and only the first ``total`` of them are ranked together
    first = found.orderBy("source_repo", "source_id", "ords").limit(total)
    return first.withColumn("place", F.row_number().over(Window.orderBy("source_repo", "source_id", "ords")))


def _steps_to_cross(steps: DataFrame, most: int) -> DataFrame:
    """(repo, node_id, need): how many steps a path must take from a node to have crossed, where ``most`` are enough."""
    at = steps.select(F.col("src_repo").alias("repo"), F.col("src_id").alias("node_id"), "dst_repo", "dst_id", "scope")
    front = settled(at.where("scope = 'cross'").select("repo", "node_id").distinct().withColumn("need", F.lit(1)))
    found = front
    for n in range(2, most + 1):
        if front.isEmpty():
            break
        on = front.select(F.col("repo").alias("dst_repo"), F.col("node_id").alias("dst_id"))
        back = at.join(on, ["dst_repo", "dst_id"], "left_semi").select("repo", "node_id").distinct()
        front = settled(back.join(found, ["repo", "node_id"], "left_anti").withColumn("need", F.lit(n)))
        found = found.unionByName(front)
    return found


def _walk(steps: DataFrame, start: DataFrame, max_nodes: int, per_source: int) -> DataFrame:
    """The first ``per_source`` chains of each source: (source_repo, source_id, path, scopes, ords)."""
    here = F.struct(F.col("repo"), F.col("node_id"))
    state = start.select(F.col("repo").alias("source_repo"), F.col("node_id").alias("source_id"), "repo", "node_id", F.array(here).alias("path"), F.array(F.lit("source")).alias("scopes"), F.array().cast("array<int>").alias("ords"), F.lit(False).alias("crossed"))
    before = Window.partitionBy("source_repo", "source_id").orderBy("ords").rowsBetween(Window.unboundedPreceding, 0)
    on = (F.col("repo") == F.col("src_repo")) & (F.col("node_id") == F.col("src_id"))
    there = F.struct(F.col("dst_repo").alias("repo"), F.col("dst_id").alias("node_id"))
    for level in range(1, max_nodes):
        front = state.where(F.size("path") == level)
        crossed = F.col("crossed") | (F.col("scope") == "cross")
        # a path of level + 1 nodes that hasn't crossed needs room for the steps that it still has to take
        nxt = front.join(steps, on).where(~F.array_contains("path", there) & (crossed | (F.col("need") <= max_nodes - 1 - level)))
        nxt = nxt.select("source_repo", "source_id", F.col("dst_repo").alias("repo"), F.col("dst_id").alias("node_id"), F.concat("path", F.array(there)).alias("path"), F.concat("scopes", F.array("scope")).alias("scopes"), F.concat("ords", F.array("ord")).alias("ords"), crossed.alias("crossed"))
        # chains so far and open paths in preorder; what comes after per_source chains can't lead to one that counts
        every = state.where("crossed").unionByName(nxt).withColumn("chains", F.sum(F.col("crossed").cast("int")).over(before))
        last, state = state, settled(every.where((F.col("chains") < per_source) | (F.col("crossed") & (F.col("chains") == per_source))).drop("chains"))
        discard(last)
        if state.where(F.size("path") == level + 1).isEmpty():
            break
    return state.where("crossed").select("source_repo", "source_id", "path", "scopes", "ords")


def exposure(call_edges: DataFrame, cross_edges: DataFrame, sources: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """Sources, reachable nodes and chains, each with node names (empty where unknown).

    ``call_edges`` (repo, source_id, target_id); ``cross_edges`` (client_repo, client_node_id, server_repo,
    server_node_id, link_type); ``sources`` and ``names`` (repo, node_id[, name]). Cross links without both ids don't count.
    """
    calls = call_edges.select(F.col("repo").alias("src_repo"), F.col("source_id").alias("src_id"), F.col("repo").alias("dst_repo"), F.col("target_id").alias("dst_id"), F.lit("call").alias("scope"), F.lit("").alias("kind"))
    cross = cross_edges.select(F.col("client_repo").alias("src_repo"), F.col("client_node_id").alias("src_id"), F.col("server_repo").alias("dst_repo"), F.col("server_node_id").alias("dst_id"), F.lit("cross").alias("scope"), F.col("link_type").alias("kind"))
    edges = calls.unionByName(cross).where("src_id <> '' and dst_id <> ''")
    known = names.groupBy("repo", "node_id").agg(F.min("name").alias("name"))

    def named(df: DataFrame) -> DataFrame:
        return df.join(known, ["repo", "node_id"], "left").withColumn("name", F.coalesce("name", F.lit("")))

    own = sources.select("repo", "node_id").where("node_id <> ''").distinct()
    return {"sources": named(own), "reachable": named(reachable(edges, own)).orderBy("repo", "node_id"), "chains": chains(numbered(edges), own)}
