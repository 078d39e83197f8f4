"""Entry points of a repository: functions that outside input reaches.

A call's target is matched against the API rules by its whole name, by its last dotted segment, or by the first rule
that it contains; a function's text by every rule that it contains. Rule order decides, so rules carry ``ord``. Rule
tables have at most a few hundred rows and are broadcast. Sources found by calls come in order of callee, then those
found in the text in order of rule; the first gives the entry point's type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage import model as M
from vantage.functions.text import api_short_name, is_test_or_example
from vantage.operators.graph import CALLABLE, roots
from vantage.runtime import settled


def match_names(callees: DataFrame, rules: DataFrame, name: str = "callee") -> DataFrame:
    """Adds api_type and api_name to rows whose ``name`` matches a rule; others are dropped.

    The type is that of the best match (whole name, last segment, first rule contained); the name is the first rule
    contained, or else the last segment before any bracket.
    """
    c = F.col(name)
    contained = c.contains(F.col("api_name"))
    rank = F.when(c == F.col("api_name"), 0).when(api_short_name(c) == F.col("api_name"), 1).when(contained, 2)
    distinct = callees.select(name).distinct()
    joined = distinct.crossJoin(F.broadcast(rules.select("ord", F.col("api_name"), F.col("api_type")))).where(contained)
    best = joined.groupBy(name).agg(F.min_by("api_type", F.struct(rank, F.col("ord"))).alias("api_type"), F.min_by("api_name", "ord").alias("api_name"))
    return callees.join(best, name)


def text_sources(bodies: DataFrame, rules: DataFrame, body: str = "body") -> DataFrame:
    """A row for every rule whose name a text contains: the rows' columns but the text, with ord, api_name, api_type."""
    keep = [c for c in bodies.columns if c != body]
    return bodies.crossJoin(F.broadcast(rules.select("ord", "api_name", "api_type"))).where(F.col(body).contains(F.col("api_name"))).select(*keep, "ord", "api_name", "api_type")


def bodies(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(repo, node_id, body): a node's own source lines, joined by newlines; nodes without any have no row."""
    own = nodes.select("repo", "node_id", "file", "start_line", "end_line")
    hit = own.join(lines, ["repo", "file"]).where((F.col("line_no") >= F.greatest(F.col("start_line"), F.lit(1))) & (F.col("line_no") <= F.col("end_line")))
    return hit.groupBy("repo", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))


def sources(nodes: DataFrame, edges: DataFrame, lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, node_id, sources): every function's or method's outside sources, in order; without any, no row."""
    own = nodes.where(F.col("kind").isin(*CALLABLE)).select("repo", "node_id", "file", "start_line", "end_line")
    calls = edges.where("kind = 'calls'").select("repo", F.col("source_id").alias("node_id"), F.col("target_id").alias("callee")).distinct()
    calls = settled(calls.join(own.select("repo", "node_id", "file", "start_line"), ["repo", "node_id"]))
    direct = match_names(calls, rules).select("repo", "node_id", "callee", "api_name", F.col("start_line").alias("line"), "file", "api_type")
    rest = calls.join(direct.select("callee").distinct(), "callee", "left_anti")
    target = nodes.select("repo", F.col("node_id").alias("callee"), F.col("name").alias("callee_name"), F.col("start_line").alias("callee_line"))
    named = match_names(rest.join(target, ["repo", "callee"]), rules, "callee_name")
    named = named.select("repo", "node_id", "callee", F.col("callee_name").alias("api_name"), F.col("callee_line").alias("line"), "file", "api_type")
    graph = settled(direct.unionByName(named))
    text = text_sources(bodies(own, lines), rules).join(own.select("repo", "node_id", "start_line", "file"), ["repo", "node_id"])
    fresh = text.join(graph.select("repo", "node_id", "api_name").distinct(), ["repo", "node_id", "api_name"], "left_anti")
    one = graph.select("repo", "node_id", F.lit(0).alias("pass"), F.col("callee").alias("first"), F.lit(0).alias("ord"), "api_name", "line", "file", "api_type")
    two = fresh.select("repo", "node_id", F.lit(1).alias("pass"), F.lit("").alias("first"), "ord", "api_name", F.col("start_line").alias("line"), "file", "api_type")
    entry = F.struct("pass", "first", "ord", F.struct(F.col("api_name").alias("name"), F.col("line").alias("line_number"), F.col("file").alias("file"), F.col("api_type").alias("entry_point_type")).alias("s"))
    # a function has at most a few hundred rules' worth of sources and as many callees as its text names
    return one.unionByName(two).groupBy("repo", "node_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["s"]).alias("sources"))


def entry_points(nodes: DataFrame, edges: DataFrame, lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Entry points with their sources and type; tests and examples are left out.

    A function that nothing calls, that has parameters or is a main, and that has sources or is a main, is a root entry
    point; any other function with sources is one that isn't a root.
    """
    skip = is_test_or_example(F.col("file"))
    own = nodes.where(F.col("kind").isin(*CALLABLE) & ~skip)
    is_main = F.col("name").isin(*M.MAIN_NAMES)
    top = roots(nodes, edges, skip).select("repo", "node_id").withColumn("no_caller", F.lit(True))
    made = own.join(sources(nodes, edges, lines, rules), ["repo", "node_id"], "left").join(top, ["repo", "node_id"], "left")
    has = F.size(F.coalesce("sources", F.array().cast(made.schema["sources"].dataType))) > 0
    root = F.coalesce("no_caller", F.lit(False)) & ((F.size(F.coalesce("parameters", F.array().cast("array<string>"))) > 0) | is_main) & (has | is_main)
    kept = made.withColumn("is_root_function", root).where(F.col("is_root_function") | has)
    kind = F.when(has, F.col("sources")[0]["entry_point_type"]).when(is_main, "main_function").otherwise("unknown")
    return kept.select("repo", "node_id", F.col("name").alias("function_name"), F.col("file").alias("file_path"), "start_line", "end_line", kind.alias("entry_point_type"), F.coalesce("sources", F.array().cast(made.schema["sources"].dataType)).alias("external_sources"), "is_root_function", F.lit("high").alias("confidence"), F.lit("").alias("external_data_description"), F.lit("").alias("explanation"))


def find_lines(lines: DataFrame, patterns: DataFrame, cap: int | None = M.MAX_MATCHES) -> DataFrame:
    """(repo, file, line_no, line, pattern): the first ``cap`` lines of a file that hold a pattern, case aside.

    ``patterns`` has (pattern) and, where a search is meant for one repository, (repo); it must be small enough to
    broadcast, which callers check. A cap limits hits by (file, pattern), as the feature asks.
    """
    from vantage.functions.text import line_matches

    p = patterns.distinct()
    hit = lines.join(F.broadcast(p), "repo") if "repo" in p.columns else lines.crossJoin(F.broadcast(p))
    hit = hit.where(line_matches(F.col("line"), F.col("pattern"))).select("repo", "file", "line_no", "line", "pattern")
    if cap is None:
        return hit
    w = Window.partitionBy("repo", "file", "pattern").orderBy("line_no")
    return hit.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn")
