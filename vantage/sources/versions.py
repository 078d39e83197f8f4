"""Versions of repositories, and snapshots of results by version."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage import model as M


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="ignore") as f:
            return f.read()
    except OSError:
        return ""


def git_folder(repo: str) -> str | None:
    """The repository's git folder, through the pointer file of a submodule where there is one."""
    git = os.path.join(repo, ".git")
    if os.path.isdir(git):
        return git
    for line in _read(git).splitlines():
        if line.strip().startswith("gitdir:"):
            return os.path.normpath(os.path.join(repo, line.split(":", 1)[1].strip()))
    return None


def commit(repo: str) -> str | None:
    """The commit that HEAD names: by a loose ref, a packed ref, or itself when it is one (7 characters or more)."""
    git = git_folder(repo)
    head = _read(os.path.join(git, "HEAD")).strip() if git else ""
    if not head.startswith("ref:"):
        return head if len(head) >= 7 else None
    ref = head.split(":", 1)[1].strip()
    if loose := _read(os.path.join(git, ref)).strip():
        return loose
    return next((p[0] for p in map(str.split, _read(os.path.join(git, "packed-refs")).splitlines()) if len(p) == 2 and p[1] == ref), None)


def listing_digest(files: list[tuple[str, int]]) -> str:
    """SHA-256 over sorted (path, size), as ``operators.incremental.listing_hash`` computes it for tables."""
    return hashlib.sha256("".join(f"{rel}\0{size}\0" for rel, size in sorted(files)).encode()).hexdigest()


def version(repo: str) -> str:
    """The commit, else the digest of the file list, else the mark of a folder that isn't there."""
    if found := commit(repo):
        return found
    if not os.path.isdir(repo):
        return "no-files"
    files = []
    for at, dirs, names in os.walk(repo):
        dirs[:] = [d for d in dirs if d not in M.EXCLUDED_DIRS]
        for n in names:
            path = os.path.join(at, n)
            if os.path.isfile(path):
                files.append((os.path.relpath(path, repo).replace(os.sep, "/"), os.path.getsize(path)))
    return listing_digest(files)


def links_digest(versions: dict[str, str]) -> str:
    return hashlib.sha256("".join(f"{k}={v}\0" for k, v in sorted(versions.items())).encode()).hexdigest()


def parse_kind(kind: F.Column, known: tuple[str, ...]) -> F.Column:
    """A kind, or null where it isn't one."""
    return F.when(kind.isin(*known), kind)


NODE_KINDS, EDGE_KINDS = ("function", "method", "class", "module"), ("calls", "inherits", "contains", "type_uses")
_GRAPH = "language string, nodes array<struct<id: string, name: string, kind: string, file: string, start_line: int, end_line: int>>, edges array<struct<source_id: string, target_id: string, kind: string>>"


def dump_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a snapshot keeps of a graph."""
    return nodes.select("repo", F.col("node_id").alias("id"), "name", "kind", "file", "start_line", "end_line"), edges.select("repo", "source_id", "target_id", "kind")


def load_graph(docs: DataFrame, column: str = "graph") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graphs in JSON text by ``repo``: unknown kinds are null, of repeated ids the last counts."""
    g = docs.select("repo", F.from_json(column, _GRAPH).alias("g"))
    n = g.select("repo", F.posexplode("g.nodes").alias("p", "n")).where("n is not null")
    last = n.groupBy("repo", F.coalesce("n.id", F.lit("")).alias("node_id")).agg(F.max_by("n", "p").alias("n"))
    text = lambda c: F.coalesce(c, F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0))
    nodes = last.select("repo", "node_id", text("n.name").alias("name"), parse_kind(F.col("n.kind"), NODE_KINDS).alias("kind"), text("n.file").alias("file"), zero("n.start_line").alias("start_line"), zero("n.end_line").alias("end_line"))
    e = g.select("repo", F.explode("g.edges").alias("e")).where("e is not null")
    return nodes, e.select("repo", text("e.source_id").alias("source_id"), text("e.target_id").alias("target_id"), parse_kind(F.col("e.kind"), EDGE_KINDS).alias("kind"))


class Snapshots:
    """Results by key and version, as Parquet partitions that are written once.

    A snapshot is written beside its place and its arrival is one row of the index, so a reader sees all of it or none.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _index(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("kind string, key string, version string, path string, at timestamp").parquet(f"{self.root}/index")
        except AnalysisException:
            return None

    def save(self, kind: str, key: str, version_: str, rows: DataFrame) -> str:
        path = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.spark.range(1).select(F.lit(kind).alias("kind"), F.lit(key).alias("key"), F.lit(version_).alias("version"), F.lit(path).alias("path"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.root}/index")
        return path

    def _find(self, where: F.Column) -> DataFrame | None:
        index = self._index()
        row = index.where(where).orderBy(F.desc("at"), F.desc("path")).first() if index is not None else None
        return self.spark.read.parquet(row.path) if row else None

    def load(self, kind: str, key: str, version_: str) -> DataFrame | None:
        """The snapshot of a version, or None."""
        return self._find((F.col("kind") == kind) & (F.col("key") == key) & (F.col("version") == version_))

    def previous(self, kind: str, key: str, version_: str) -> DataFrame | None:
        """The newest snapshot of another version, or None."""
        return self._find((F.col("kind") == kind) & (F.col("key") == key) & (F.col("version") != version_))

    def current(self) -> dict[str, str]:
        """The last saved version of every repository."""
        index = self._index()
        if index is None:
            return {}
        return {r.key: r.version for r in index.where("kind = 'repo'").groupBy("key").agg(F.max_by("version", "at").alias("version")).collect()}


def load_checkpoints(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Entry points and descriptors of per-repository JSON checkpoints; a missing file is an error.

    A checkpoint from before validation has no descriptors; they are null then. Sources may go by either of their names.
    """
    missing = [p for p in paths.values() if not os.path.isfile(p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    from vantage.model import DESCRIPTOR, SOURCE

    entry = f"struct<function_name: string, file_path: string, start_line: int, end_line: int, entry_point_type: string, external_input_sources: array<{SOURCE}>, external_sources: array<{SOURCE}>, is_root_function: boolean, confidence: string, external_data_description: string, explanation: string>"
    schema = f"entry_points map<string, {entry}>, interfaces map<string, {DESCRIPTOR}>"
    sources = F.coalesce("e.external_input_sources", "e.external_sources", F.array().cast(f"array<{SOURCE}>")).alias("external_sources")
    out = None
    for repo, path in paths.items():
        d = spark.read.schema(schema).option("multiLine", True).json(path)
        e = d.select(F.explode("entry_points").alias("node_id", "e"), "interfaces")
        rows = e.select(F.lit(repo).alias("repo"), "node_id", *(f"e.{c}" for c in ("function_name", "file_path", "start_line", "end_line", "entry_point_type")), sources, *(f"e.{c}" for c in ("is_root_function", "confidence", "external_data_description", "explanation")), F.try_element_at("interfaces", "node_id").alias("descriptor"))
        out = rows if out is None else out.unionByName(rows)
    return out


def checkpoint_path(folder: str, repo: str) -> str:
    """Where a repository's checkpoint is: in the folder's repos/, or in the folder itself."""
    name = f"{repo}_entry_points.json"
    inner = os.path.join(folder, "repos", name)
    return inner if os.path.isfile(inner) else os.path.join(folder, name)


def read_json(path: str) -> dict | None:
    """A JSON object, or None where there is none to read."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        return None
    return data if isinstance(data, dict) else None
