"""Versions, hashes, reuse of earlier results, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.runtime import running


def listing_hash(files: DataFrame, *by: str) -> DataFrame:
    """(by..., version): SHA-256 over each group's sorted (path, size), each ended by a zero character.

    A group's listing becomes one string, as the digest asks; paths and sizes only, never contents.
    """
    entry = F.transform(F.array_sort(F.collect_list(F.struct("rel", "size"))), lambda x: F.concat(x["rel"], F.lit("\0"), x["size"].cast("string"), F.lit("\0")))
    return files.groupBy(*by).agg(F.sha2(F.array_join(entry, "").cast("binary"), 256).alias("version"))


def links_hash(versions: DataFrame, repo: str = "repo", version: str = "version") -> DataFrame:
    """One row: SHA-256 over sorted repo=version, each ended by a zero character."""
    item = F.concat(repo, F.lit("="), version, F.lit("\0"))
    return versions.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "").cast("binary"), 256).alias("links_hash"))


def repo_version(commit: Column, exists: Column, listing: Column) -> Column:
    """The commit, else the listing's hash, else the mark of a folder that isn't there."""
    return F.coalesce(F.when(commit != "", commit), F.when(~exists, F.lit("no-files")), listing)


def previous_version(snapshots: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """For each current (key, version): the newest snapshot of another version; ties go to the greater version."""
    c = current.select(*key, F.col("version").alias("now"))
    other = snapshots.join(c, key).where(F.col("version") != F.col("now"))
    return other.groupBy(*key, "now").agg(F.max_by("version", F.struct("mtime", "version")).alias("previous"))


def reuse(new: DataFrame, old: DataFrame, key: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """New rows whose key an old row has, with its values; and those that must be worked out. Of equal old keys the last counts.

    A key with a null matches nothing, so its row is worked out again.
    """
    w = Window.partitionBy(*key).orderBy(*(F.desc_nulls_last(v) for v in values))
    last = old.select(*key, *values).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return new.join(last, key), new.join(last, key, "left_anti")


def upsert_flows(flows: DataFrame, edges: DataFrame, protocol: Column) -> DataFrame:
    """Flows with those that edges add: (id, source, target, protocol). Existing ones stay; new ids go on from their number.

    ``flows`` (id, source, target, protocol); ``edges`` (from_repo, to_repo, link_type) in order of ``ord``.
    """
    key = ["source", "target", "protocol"]
    seen = flows.select(*key).distinct()
    made = edges.select(F.col("from_repo").alias("source"), F.col("to_repo").alias("target"), protocol.alias("protocol"), "ord")
    fresh = made.groupBy(*key).agg(F.min("ord").alias("ord")).join(seen, key, "left_anti")
    n = flows.select(*key).distinct().agg(F.count("*").alias("n"))
    numbered = running(fresh, ["ord", *key], "_at").crossJoin(F.broadcast(n)).withColumn("id", F.concat(F.lit("flow-"), (F.col("n") + F.col("_at") + 1).cast("string")))  # n: one row
    return flows.select("id", *key).unionByName(numbered.select("id", *key))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
