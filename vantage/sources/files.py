"""Source text from files: listings and lines through Spark's own readers, on any file system it knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage import model as M
from vantage.functions.text import file_name


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, rel, size, mtime) of all files below ``root``; contents aren't read."""
    base = root.rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(base)
    marker = F.lit("/" + base.split("://")[-1].removeprefix("file:").lstrip("/") + "/")
    start = F.position(marker, F.col("path"))
    rel = F.substring(F.col("path"), start + F.length(marker), F.length("path"))
    return f.select("path", rel.alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def kept(files: DataFrame, language: str = "", rel: str = "rel") -> DataFrame:
    """Without excluded folders and marked file names; of a known language only its extensions."""
    folders = F.split(F.col(rel), "/")
    inside = F.slice(folders, 1, F.size(folders) - 1)
    name = F.lower(file_name(F.col(rel)))
    out = files.where(~F.exists(inside, lambda d: d.isin(*M.EXCLUDED_DIRS)))
    for marker in M.EXCLUDED_FILE_MARKERS:
        out = out.where(~name.contains(marker))
    ends = M.LANGUAGE_EXTENSIONS.get(language, ())
    if ends:
        hit = F.lit(False)
        for e in ends:
            hit = hit | name.endswith(e)
        out = out.where(hit)
    return out


def capped(files: DataFrame, n: int = M.MAX_FILES) -> DataFrame:
    """The first ``n`` files of each repository by path: a limit that results are defined by."""
    w = Window.partitionBy("repo").orderBy("path")
    return files.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def depth(rel: str = "rel") -> F.Column:
    """Folders between the root and a file."""
    return F.size(F.split(F.col(rel), "/")) - 1


def languages(files: DataFrame) -> DataFrame:
    """(repo, language) of (repo, rel): by marker files in order, then marker suffixes, then the commonest extension.

    Of equally common ones C++ wins, then the one of the least path. Files below the marker depth and in excluded
    folders don't count; without any sign the language is empty.
    """
    folders = F.split("rel", "/")
    own = files.where(~F.exists(F.slice(folders, 1, F.size(folders) - 1), lambda d: d.isin(*M.EXCLUDED_DIRS))).where(depth() <= M.MARKER_DEPTH)
    name = file_name(F.col("rel"))
    mark = F.lit(None).cast("struct<rank: int, language: string>")
    signs = [(name == m, lang) for m, lang in M.MARKER_FILES] + [(F.col("rel").endswith(s), lang) for s, lang in M.MARKER_SUFFIXES]
    for rank, (hit, lang) in reversed(list(enumerate(signs))):
        mark = F.when(hit, F.struct(F.lit(rank).alias("rank"), F.lit(lang).alias("language"))).otherwise(mark)
    ext = F.create_map(*[F.lit(x) for pair in M.MAJORITY_EXTENSIONS.items() for x in pair])
    kind = F.when(name.contains("."), F.try_element_at(ext, F.lower(F.substring_index(name, ".", -1))))
    marked = own.select("repo", "rel", mark.alias("mark"), kind.alias("kind"))
    best = marked.groupBy("repo").agg(F.min("mark")["language"].alias("by_mark"))
    first = marked.where("kind is not null").groupBy("repo", "kind").agg(F.count("*").alias("n"), F.min("rel").alias("first"))
    order = F.struct(-F.col("n"), F.when(F.col("kind") == "cpp", 0).otherwise(1), F.col("first"))
    most = first.groupBy("repo").agg(F.min_by("kind", order).alias("by_count"))
    return best.join(most, "repo", "left").select("repo", F.coalesce("by_mark", "by_count", F.lit("")).alias("language"))


def repositories(dirs: DataFrame, max_depth: int = M.GIT_DEPTH) -> DataFrame:
    """(path, role, owner) of folders (path, has_git): topmost marked ones are repositories, marked ones below them modules.

    Hidden and excluded folders, and what lies in them, don't count. A folder is joined on its own ancestors.
    """
    parts = F.split("path", "/")
    seen = dirs.where(~F.exists(parts, lambda d: d.isin(*M.EXCLUDED_DIRS) | d.startswith("."))).where("has_git")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    marked = seen.select(F.col("path").alias("up")).distinct()
    over = seen.select("path", F.explode(ups).alias("up")).join(marked, "up")
    top = over.groupBy("path").agg(F.min_by("up", F.length("up")).alias("owner"))
    below = F.size(parts) - F.size(F.split("owner", "/"))
    out = top.withColumn("role", F.when(F.col("path") == F.col("owner"), "repository").otherwise("module"))
    return out.where(F.when(F.col("role") == "repository", F.size(parts) <= max_depth).otherwise(below <= max_depth)).select("path", "role", "owner")


def read_lines(spark: SparkSession, root: str, repo: str, language: str = "", max_files: int = M.MAX_FILES) -> DataFrame:
    """(repo, file, line_no, line) of a repository's source files; invalid UTF-8 is dropped.

    Files are chosen by name before any is opened; a file's lines are numbered from 1.
    """
    base = root.rstrip("/")
    names = capped(kept(listing(spark, base), language).select(F.lit(repo).alias("repo"), "path", "rel"), max_files)
    body = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "content")
    text = F.regexp_replace(F.expr("make_valid_utf8(CAST(content AS STRING))"), "\uFFFD", "")
    lines = body.join(names, "path", "left_semi").select("path", F.posexplode(F.split(text, "\r?\n")).alias("p", "line"))
    return lines.select(F.lit(repo).alias("repo"), F.regexp_replace("path", "^file:/+", "/").alias("file"), (F.col("p") + 1).alias("line_no"), "line")
