"""Commands: scan, graph-from-json, call-graph, project, render-threagile, export-threagile.

Code graphs come as Parquet folders (--nodes, --edges, --lines) or, for Python sources, are read from a folder.
"""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage import model as M
from vantage.plans import engine
from vantage.port import Judge
from vantage.runtime import session, settled
from vantage.sinks import render
from vantage.sources import config as C
from vantage.sources import files, parse
from vantage.sources import versions as V

log = logging.getLogger("vantage")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vantage")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, out: str | None = None) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        s.add_argument("--output-dir", default=out, required=out is None)
        return s

    def judged(s: argparse.ArgumentParser) -> None:
        s.add_argument("--judge", help="module:name of a callable from prompts to answers; without one, results are offline")
        s.add_argument("--no-llm", action="store_true", help="judge nothing, even where --judge is given")

    def graph_source(s: argparse.ArgumentParser) -> None:
        s.add_argument("--project-path")
        s.add_argument("--language", default="auto")
        for n in ("nodes", "edges", "lines"):
            s.add_argument(f"--{n}", help="a Parquet folder")

    s = add("scan", "./scan_output")
    graph_source(s)
    judged(s)
    s.add_argument("--html-report", action="store_true")
    s.add_argument("--graph", action="store_true")
    s.add_argument("--graph-format", choices=["svg", "cert", "both"], default="svg")
    s = add("graph-from-json")
    s.add_argument("--entrypoints-json", required=True)
    s.add_argument("--project-name", default="Project")
    s.add_argument("--language", default="python")
    s.add_argument("--graph-format", choices=["svg", "cert", "both"], default="svg")
    s = add("call-graph", "./call_graph_output")
    graph_source(s)
    s.add_argument("--filter-by-exposure", action="store_true")
    s.add_argument("--format", choices=["svg", "cert", "stats"], default="svg")
    s = add("project", "./project_output")
    s.add_argument("--config")
    graph_source(s)
    judged(s)
    s.add_argument("--config-format", choices=["json", "threagile"], default="json")
    s.add_argument("--graph-format", choices=["svg", "cert", "both"], default="svg")
    s.add_argument("--auto-links", action="store_true")
    s.add_argument("--entrypoints-dir")
    s.add_argument("--from-scan")
    s.add_argument("--no-cache", action="store_true")
    s = add("render-threagile", "./threagile_render")
    s.add_argument("--config", required=True)
    s.add_argument("--graph-format", choices=["svg", "cert", "both"], default="both")
    s = sub.add_parser("export-threagile")
    s.add_argument("--config", required=True)
    s.add_argument("--output", required=True)
    return p


def _read(spark: SparkSession, args: argparse.Namespace, repos: list[C.Repo]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and lines from tables, or from the repositories' Python sources."""
    if args.nodes:
        return spark.read.parquet(args.nodes), spark.read.parquet(args.edges), spark.read.parquet(args.lines)
    lines = None
    for r in repos:
        own = files.read_lines(spark, r.path, r.name, r.language)
        lines = own if lines is None else lines.unionByName(own)
    lines = settled(lines)
    text = lines.where(F.col("file").endswith(".py")).groupBy("repo", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    nodes, edges = parse.parse(text)
    return settled(nodes), settled(edges), lines


def _one(args: argparse.Namespace) -> C.Repo:
    path = os.path.abspath(args.project_path or ".")
    language = C.detect_language(path) if args.language == "auto" else M.normalize_language(args.language)
    return C.Repo(os.path.basename(path) or "project", path, language)


def _judge(args: argparse.Namespace) -> Judge | None:
    """The callable that --judge names; it has to be importable on the executors too."""
    if args.no_llm or not args.judge:
        return None
    module, _, name = args.judge.partition(":")
    return getattr(importlib.import_module(module), name)


def _scan(spark: SparkSession, args: argparse.Namespace) -> None:
    repo = _one(args)
    nodes, edges, lines = _read(spark, args, [repo])
    entries = engine.scan(nodes, edges, lines, nodes.select("repo").distinct().withColumn("language", F.lit(repo.language)), _judge(args))
    out = args.output_dir
    log.info(render.entry_points_json(entries, repo.name, repo.language, os.path.join(out, "entry_points.json")))
    if args.html_report:
        log.info(render.html_report(entries, os.path.join(out, "entry_points_report.html"), repo.name, repo.language))
    if args.graph:
        log.info(render.exposure_graph(entries, out, repo.name, repo.language, args.graph_format))


def entries_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Entry points of a scan's JSON file."""
    data = V.read_json(path)
    if data is None:
        raise FileNotFoundError(path)
    rows = []
    for key, e in (data.get("entry_points") or {}).items():
        raw = e.get("external_input_sources") or e.get("external_sources") or []
        sources = [(str(s.get("name", "")), int(s.get("line_number", 0)), str(s.get("file", "")), s.get("entry_point_type")) for s in raw]
        rows.append(("", key, str(e.get("function_name", "?")), str(e.get("file_path", "")), int(e.get("start_line", 0)), int(e.get("end_line", 0)), str(e.get("entry_point_type", "unknown")), sources, bool(e.get("is_root_function", False)), str(e.get("confidence", "high")), "", ""))
    return spark.createDataFrame(rows, M.ENTRY_POINTS)


def _graph_from_json(spark: SparkSession, args: argparse.Namespace) -> None:
    log.info(render.exposure_graph(entries_from_json(spark, args.entrypoints_json), args.output_dir, args.project_name, args.language, args.graph_format))


def _call_graph(spark: SparkSession, args: argparse.Namespace) -> None:
    repo = _one(args)
    nodes, edges, lines = _read(spark, args, [repo])
    entries = engine.scan(nodes, edges, lines, nodes.select("repo").distinct().withColumn("language", F.lit(repo.language))) if args.filter_by_exposure else None
    kept, links, stats = engine.call_graph(nodes, edges, entries)
    out = lambda name: os.path.join(args.output_dir, name)
    C._write(out("call_graph_stats.json"), json.dumps(stats.first().asDict(), indent=2))
    if args.format == "cert":
        C._write(out("call_graph.json"), json.dumps(render.call_graph_model(kept, links), ensure_ascii=False))
    elif args.format == "svg":
        C._write(out("call_graph.mmd"), render.mermaid(links))


def _project(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.from_scan:
        model = V.read_json(args.from_scan)
        if model is None:
            raise FileNotFoundError(args.from_scan)
        log.info(render.project_graph(model, args.output_dir, args.graph_format))
        return
    architecture = None
    if args.config:
        project = C.load_any(args.config)
    else:
        project = C.auto_project(args.project_path or ".", authoritative=args.config_format == "threagile")
        name = "architecture.yaml" if args.config_format == "threagile" else "project.json"
        architecture = C.save_project(project, os.path.join(args.output_dir, name), args.config_format)
    nodes, edges, lines = _read(spark, args, project.repos)
    entries = V.load_checkpoints(spark, {r.name: V.checkpoint_path(args.entrypoints_dir, r.name) for r in project.repos}) if args.entrypoints_dir else None
    judge, store, versions = _judge(args), None, {}
    if entries is None and not args.no_cache and not args.nodes:
        store = V.Snapshots(spark, os.path.join(args.output_dir, "cache"))
        versions = {r.name: V.version(r.path) for r in project.repos}
        for r in project.repos:
            part = lambda df, r=r: df.where(F.col("repo") == r.name)
            own = engine.rescan(store, r.name, versions[r.name], part(nodes), part(edges), part(lines), r.language, judge, args.output_dir)
            entries = own if entries is None else entries.unionByName(own)
    earlier = engine.earlier_links(store, project, versions) if store else None
    result = engine.analyse(project, nodes, edges, lines, judge, auto=args.auto_links, entries=entries, earlier=earlier)
    if store:
        engine.save_links(store, project, versions, result.links)
    log.info(engine.save(result, args.output_dir, args.graph_format))
    if architecture and args.config_format == "threagile":
        found = result.links.select("from_repo", "to_repo", "link_type").distinct().orderBy("from_repo", "to_repo", "link_type")
        C.add_flows(architecture, [tuple(r) for r in found.toLocalIterator()])


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    if args.command == "render-threagile":
        log.info(render.topology(C.load_architecture(args.config), args.output_dir, args.graph_format))
    elif args.command == "export-threagile":
        log.info(C.save_architecture(C.load_project(args.config), args.output))
    else:
        commands = {"scan": _scan, "graph-from-json": _graph_from_json, "call-graph": _call_graph, "project": _project}
        commands[args.command](session(), args)


if __name__ == "__main__":
    main()
