"""The whole analysis: code graphs and source text of repositories to entry points, links, reachability and chains."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage import model as M
from vantage.operators import extract, graph, link, resolve
from vantage.port import Judge, confirm_new, describe
from vantage.runtime import settled
from vantage.sinks import render
from vantage.sources import versions as V
from vantage.sources.config import Project


@dataclass
class Result:
    """Relations of an analysis; all are lazy but written where they are used again."""

    project: Project
    nodes: DataFrame
    edges: DataFrame
    entries: DataFrame
    endpoints: DataFrame
    links: DataFrame
    surface: dict[str, DataFrame]


def scan(nodes: DataFrame, edges: DataFrame, lines: DataFrame, languages: DataFrame, judge: Judge | None = None) -> DataFrame:
    """Entry points of all repositories with their code, language and descriptor.

    ``languages`` (repo, language) chooses each repository's rules; there are as many languages as rule tables.
    """
    spark = nodes.sparkSession
    rules = M.rules_frame(spark)
    found = None
    for language in sorted({r.language for r in languages.select("language").distinct().collect()}):
        own = languages.where(F.col("language") == language).select("repo")
        part = lambda df, own=own: df.join(F.broadcast(own), "repo", "left_semi")
        e = extract.entry_points(part(nodes), part(edges), part(lines), rules.where(F.col("language") == language)).withColumn("language", F.lit(language))
        found = e if found is None else found.unionByName(e)
    found = settled(found)
    code = extract.bodies(nodes.join(found.select("repo", "node_id"), ["repo", "node_id"], "left_semi"), lines)
    return settled(describe(found.join(code.withColumnRenamed("body", "code"), ["repo", "node_id"], "left"), judge))


def analyse(project: Project, nodes: DataFrame, edges: DataFrame, lines: DataFrame, judge: Judge | None = None, auto: bool = False, bidirectional: bool = True, entries: DataFrame | None = None, earlier: DataFrame | None = None) -> Result:
    """Everything about a project. ``entries`` may come from an earlier scan (with descriptors).

    ``earlier`` are links that a judge confirmed for another version; candidates that they hold aren't judged again.
    """
    from vantage.operators.interfaces import endpoint_rows

    spark = nodes.sparkSession
    repos, declared = project.repos_frame(spark), project.links_frame(spark)
    if entries is None:
        entries = scan(nodes, edges, lines, repos.select(F.col("name").alias("repo"), "language"), judge)
    endpoints = settled(endpoint_rows(entries))
    if project.links_authoritative and project.links and not auto:
        links = link.authoritative_links(declared, endpoints)
    else:
        found = link.auto_links(repos, endpoints, lines, bidirectional) if auto or not project.links else link.find_links(declared, endpoints, lines, bidirectional)
        links = confirm_new(settled(found), judge, earlier).drop("pattern_ord", "pattern")
    links = settled(_bound(links, nodes, entries))
    servers = entries.where(F.col("descriptor.interface_role").isin("server", "both")).select("repo", "node_id")
    names = nodes.select("repo", "node_id", "name").unionByName(entries.select("repo", "node_id", F.col("function_name").alias("name")))
    cross = links.select(F.col("from_repo").alias("client_repo"), "client_node_id", F.col("to_repo").alias("server_repo"), "server_node_id", "link_type")
    surface = graph.exposure(graph.valid_calls(nodes, edges), cross, servers, names)
    return Result(project, nodes, edges, entries, endpoints, links, surface)


def _bound(links: DataFrame, nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Links whose client has no node get the node around its line: from the graph, or from entry points without one."""
    spot = links.withColumn("client_repo", F.col("from_repo"))
    with_graph = nodes.select(F.col("repo").alias("client_repo")).distinct()
    by = lambda df, file: df.select(F.col("repo").alias("client_repo"), F.col(file).alias("file"), "node_id", "start_line", "end_line")
    renamed = lambda df: df.withColumnsRenamed({"site_file": "client_file", "site_line": "client_line"})
    a = renamed(resolve.enclosing(spot, by(nodes, "file"), ["client_repo"], "client_file", "client_line"))
    loose = spot.join(with_graph, "client_repo", "left_anti")
    b = renamed(resolve.enclosing(loose, by(entries, "file_path"), ["client_repo"], "client_file", "client_line"))
    names = nodes.select("repo", "node_id", "name").unionByName(entries.select("repo", "node_id", F.col("function_name").alias("name"))).groupBy("repo", "node_id").agg(F.min("name").alias("name"))
    return resolve.fill_clients(spot, a, b, names).drop("client_repo")


def rescan(snapshots: V.Snapshots, repo: str, version: str, nodes: DataFrame, edges: DataFrame, lines: DataFrame, language: str, judge: Judge | None = None, folder: str | None = None) -> DataFrame:
    """Entry points of a repository's version: read where they are known; else only new entry points are described.

    An entry point is known by file, function and lines. With a ``folder``, its checkpoint is written before anything is
    judged and again afterwards, so that a run that breaks off in between can go on from it.
    """
    spark = nodes.sparkSession
    if (done := snapshots.load("repo", repo, version)) is not None:
        return done
    languages = spark.createDataFrame([(repo, language)], "repo string, language string")
    old = snapshots.previous("repo", repo, version)
    found = scan(nodes, edges, lines, languages, None)
    if judge is not None:
        fresh = found.drop("descriptor")
        checkpoint(fresh.withColumn("descriptor", F.lit(None).cast(M.DESCRIPTOR)), repo, language, folder)
    if judge is not None and old is None:
        found = describe(fresh, judge)
    elif judge is not None:
        key = ["file_path", "function_name", "start_line", "end_line"]
        known = old.select(*key, "descriptor").groupBy(*key).agg(F.max("descriptor").alias("descriptor"))
        kept = fresh.join(known, key)
        found = kept.unionByName(describe(settled(fresh.join(known, key, "left_anti")), judge).select(kept.columns))
    snapshots.save("repo", repo, version, found)
    done = snapshots.load("repo", repo, version)
    checkpoint(done, repo, language, folder)
    return done


def checkpoint(entries: DataFrame, repo: str, language: str, folder: str | None) -> str | None:
    """A repository's entry points as JSON in ``folder``/repos; nothing without a folder."""
    return render.checkpoint_json(entries, repo, language, os.path.join(folder, "repos", f"{repo}_entry_points.json")) if folder else None


def earlier_links(snapshots: V.Snapshots, project: Project, versions: dict[str, str]) -> DataFrame | None:
    """The project's links of the newest other set of versions, or None."""
    return snapshots.previous("links", project.project, V.links_digest(versions))


def save_links(snapshots: V.Snapshots, project: Project, versions: dict[str, str], links: DataFrame) -> None:
    """Keep a project's links under the hash of its repositories' versions."""
    snapshots.save("links", project.project, V.links_digest(versions), links)


def call_graph(nodes: DataFrame, edges: DataFrame, entries: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, statistics); with entry points, of what they reach and are reached from."""
    if entries is not None:
        nodes, edges = graph.subgraph(nodes, edges, entries.select("repo", "node_id"))
    return nodes, edges, graph.statistics(nodes, edges)


def save(result: Result, folder: str, form: str = "svg") -> dict[str, str]:
    """Checkpoints by repository, links, the drawn graph, and the whole result as Parquet."""
    spark: SparkSession = result.nodes.sparkSession
    out = {}
    for r in result.project.repos:
        own = result.entries.where(F.col("repo") == r.name)
        out[r.name] = render.checkpoint_json(own, r.name, r.language, os.path.join(folder, "repos", f"{r.name}_entry_points.json"), r.role, r.path)
    out["cross_edges"] = render.rows_json(result.links, os.path.join(folder, "cross_edges.json"))
    c = result.surface["chains"]
    named = c.select("source_repo", "source_id", F.to_json("path").alias("path"), F.array_join("scopes", " ").alias("scopes"))
    surface = {"sources": [x.asDict() for x in result.surface["sources"].orderBy("repo", "node_id").toLocalIterator()], "reachable": [x.asDict() for x in result.surface["reachable"].toLocalIterator()], "chains": [x.asDict() for x in named.collect()]}
    edges = [x.asDict() for x in result.links.toLocalIterator()]
    files = {x.node_id: x.file_path for x in result.endpoints.select("node_id", "file_path").toLocalIterator()}
    model = render.project_model(result.project, result.entries, edges, surface)
    out |= render.project_graph(model, folder, form, files)
    out["scan"] = render._write(os.path.join(folder, "project_scan.json"), render.json.dumps({**model, "edges": edges}, ensure_ascii=False, indent=2))
    result.entries.write.mode("overwrite").partitionBy("repo").parquet(os.path.join(folder, "entries.parquet"))
    spark.catalog.clearCache()
    return out
