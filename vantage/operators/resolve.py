"""Places in source text resolved to the nodes, entry points and modules that enclose them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.functions.text import normal_path


def enclosing(sites: DataFrame, nodes: DataFrame, key: list[str], site_file: str = "file", site_line: str = "line", node_file: str = "file", node_id: str = "node_id") -> DataFrame:
    """Distinct (key..., file, line) sites with the node of least span that holds the line; ties go to the least id.

    Files are joined by their normal form; sites in no node keep a null. ``key`` are columns that both sides share. The
    join's residual is the interval; what is kept of a site while it aggregates is one candidate.
    """
    spot = sites.select(*key, F.col(site_file).alias("site_file"), F.col(site_line).alias("site_line")).distinct().withColumn("_f", normal_path(F.col("site_file")))
    span = nodes.select(*key, normal_path(F.col(node_file)).alias("_f"), F.col(node_id).alias("_id"), "start_line", "end_line")
    hit = spot.join(span, [*key, "_f"]).where((F.col("start_line") <= F.col("site_line")) & (F.col("site_line") <= F.col("end_line")))
    best = hit.groupBy(*key, "site_file", "site_line").agg(F.min_by("_id", F.struct(F.col("end_line") - F.col("start_line"), F.col("_id"))).alias("found"))
    return spot.drop("_f").join(best, [*key, "site_file", "site_line"], "left")


def fill_clients(edges: DataFrame, from_graph: DataFrame, from_entries: DataFrame, names: DataFrame) -> DataFrame:
    """Edges whose client has no node get the enclosing node, from the graph where there is one, else from entry points."""
    key = ["client_repo", "client_file", "client_line"]
    a = from_graph.select(*key, F.col("found").alias("_g"))
    b = from_entries.select(*key, F.col("found").alias("_e"))
    out = edges.join(a, key, "left").join(b, key, "left")
    out = out.withColumn("client_node_id", F.when(F.col("client_node_id") != "", F.col("client_node_id")).otherwise(F.coalesce("_g", "_e", F.lit("")))).drop("_g", "_e")
    known = names.select(F.col("repo").alias("client_repo"), F.col("node_id").alias("client_node_id"), F.col("name").alias("_n"))
    return out.join(known, ["client_repo", "client_node_id"], "left").withColumn("client_function_name", F.when(F.col("client_function_name") != "", F.col("client_function_name")).otherwise(F.coalesce("_n", F.lit("")))).drop("_n")


def deepest_module(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo, file, module): the longest module path that a file lies under; empty where none is.

    ``modules`` is (repo, base, module). A file is joined on its own folders, so the join is by equality.
    """
    f = files.select("repo", "file").distinct().withColumn("_f", normal_path(F.col("file")))
    parts = F.split("_f", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = f.withColumn("_up", F.explode(ups))
    m = modules.where("module <> ''").select("repo", "module", normal_path(F.concat_ws("/", "base", F.rtrim("module", F.lit("/")))).alias("_up"))
    best = folders.join(m, ["repo", "_up"]).groupBy("repo", "file").agg(F.max_by("module", F.struct(F.length("module"), F.col("module"))).alias("module"))
    return f.drop("_f").join(best, ["repo", "file"], "left").withColumn("module", F.coalesce("module", F.lit("")))
