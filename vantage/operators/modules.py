"""Modules, subsystems, report groups and layout of entry points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.text import module_of_path, subsystem_of
from vantage.runtime import running


def entry_types(sources: str = "external_sources", own: str = "entry_point_type") -> Column:
    """The types of an entry point's sources, or its own where they have none."""
    types = F.array_distinct(F.filter(F.transform(F.col(sources), lambda s: s["entry_point_type"]), lambda t: F.coalesce(t, F.lit("")) != ""))
    return F.when(F.size(types) > 0, types).otherwise(F.array(F.coalesce(own, F.lit("unknown"))))


def modules(entries: DataFrame, *by: str) -> DataFrame:
    """(by..., module, entry_points, types, first_file): types sorted and distinct, first_file that of the least node_id."""
    typed = entries.withColumn("module", module_of_path(F.col("file_path"))).withColumn("_t", entry_types())
    count = typed.groupBy(*by, "module").agg(F.count("*").alias("entry_points"), F.min_by("file_path", "node_id").alias("first_file"))
    types = typed.select(*by, "module", F.explode("_t").alias("t")).distinct().groupBy(*by, "module").agg(F.array_sort(F.collect_list("t")).alias("types"))
    return count.join(types, [*by, "module"])


def subsystems(mods: DataFrame, *by: str) -> DataFrame:
    """(by..., subsystem, modules, is_group): modules by first token; a group of one is the module itself."""
    grouped = mods.groupBy(*by, subsystem_of(F.col("module")).alias("token")).agg(F.count("*").alias("modules"), F.min("module").alias("only"))
    return grouped.select(*by, F.when(F.col("modules") == 1, F.col("only")).otherwise(F.col("token")).alias("subsystem"), "modules", (F.col("modules") > 1).alias("is_group"))


def report_rows(entries: DataFrame) -> DataFrame:
    """A row for every source with a type, and one of its own type for an entry point without sources."""
    s = entries.select("*", F.explode_outer("external_sources").alias("s"))
    kind = F.when(F.col("s").isNull(), F.col("entry_point_type")).otherwise(F.col("s.entry_point_type"))
    return s.withColumn("type", kind).where("type is not null and type <> ''").select("type", "node_id", "function_name", "file_path", "start_line", F.coalesce("s.name", F.lit("")).alias("source_name"), F.coalesce("s.line_number", "start_line").alias("source_line"))


def report_by_type(rows: DataFrame) -> DataFrame:
    """(type, n), most first, then by name."""
    return rows.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def report_totals(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: types, entry points, sources."""
    return rows.agg(F.count_distinct("type").alias("type_count"), F.count("*").alias("source_count")).crossJoin(entries.agg(F.count("*").alias("ep_count")))


def grid(items: DataFrame, order: list[str], width: float, height: float, left: float = 0, top: float = 0, by: list[str] | None = None) -> DataFrame:
    """Adds key (from 1), row, col, x, y: a square grid filled row by row, one for each group. For the few items of a drawing."""
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    cols = F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*").over(own)))).cast("long")
    placed = items.withColumn("key", F.row_number().over(own.orderBy(*order)).cast("long")).withColumn("_cols", cols)
    placed = placed.withColumn("row", F.expr("(key - 1) div _cols")).withColumn("col", (F.col("key") - 1) % F.col("_cols"))
    return placed.withColumn("x", left + F.col("col") * width).withColumn("y", top + F.col("row") * height).drop("_cols")


def next_free(items: DataFrame, by: list[str], order: list[str], wish: str, pitch: float, out: str = "y") -> DataFrame:
    """Adds ``out``: from the highest wish down, each item's wish, or the place right below the item before if that is lower.

    Items of a group are ``pitch`` high. With the k-th item's place held against k places of a full column, "below all
    before" is a running maximum, so nothing is placed one by one. For the few items of a drawing.
    """
    w = Window.partitionBy(*by).orderBy(wish, *order)
    slack = items.withColumn("_k", F.row_number().over(w) - 1).withColumn("_slack", F.col(wish) - F.col("_k") * F.lit(float(pitch)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return slack.withColumn(out, F.col("_k") * F.lit(float(pitch)) + F.max("_slack").over(upto)).drop("_k", "_slack")


def stacked(items: DataFrame, order: list[str], height: Column, gap: float, top: float) -> DataFrame:
    """Adds y: each item below the ones before it. For the few items of a drawing."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("y", F.lit(top) + F.coalesce(F.sum(height + F.lit(gap)).over(w), F.lit(0)))


def keys(items: DataFrame, order: list[str], first: int = 1, step: int = 1) -> DataFrame:
    """Adds dense surrogate keys in order: from ``first`` by ``step`` (groups count down from -1). Ranges are numbered apart."""
    placed = running(items, order, "_at")
    return placed.withColumn("key", (F.lit(first) + F.lit(step) * F.col("_at")).cast("long")).drop("_at")


def module_links(edges: DataFrame, keys_: DataFrame) -> DataFrame:
    """Edges between modules by their keys; edges with an unknown end or within a module are left out.

    ``edges`` (from_repo, from_module, to_repo, to_module); ``keys_`` (repo, module, key).
    """
    a = keys_.select(F.col("repo").alias("from_repo"), F.col("module").alias("from_module"), F.col("key").alias("src"))
    b = keys_.select(F.col("repo").alias("to_repo"), F.col("module").alias("to_module"), F.col("key").alias("dst"))
    return edges.join(a, ["from_repo", "from_module"]).join(b, ["to_repo", "to_module"]).where("src <> dst")
