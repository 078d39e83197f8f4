"""A code graph of Python sources, file by file, by the standard library's parser.

Other languages' graphs come as tables of nodes and edges. Call targets are known functions of the repository where
the called name is unique in the file or the repository, and the call's dotted text otherwise.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FOUND = "repo string, what string, node_id string, name string, kind string, file string, start_line int, end_line int, parameters array<string>, target string"


def _walk(tree: ast.AST, repo: str, file: str) -> list[tuple]:
    rows: list[tuple] = [(repo, "node", f"{file}:", file.rsplit("/", 1)[-1], "module", file, 1, max((getattr(n, "end_lineno", 1) or 1 for n in ast.walk(tree)), default=1), [], None)]

    def visit(node: ast.AST, owner: str, scope: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{scope}.{child.name}" if scope else child.name
                own = f"{file}:{name}"
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                args = [] if is_class else [a.arg for a in (*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs)]
                rows.append((repo, "node", own, child.name, kind, file, child.lineno, child.end_lineno, args, None))
                rows.append((repo, "contains", owner, None, None, file, None, None, None, own))
                for base in getattr(child, "bases", []):
                    rows.append((repo, "inherits", own, None, None, file, None, None, None, ast.unparse(base)))
                visit(child, own, name, is_class)
            else:
                if isinstance(child, ast.Call):
                    rows.append((repo, "calls", owner, None, None, file, None, None, None, ast.unparse(child.func)))
                visit(child, owner, scope, in_class)

    visit(tree, f"{file}:", "", False)
    return rows


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (repo, file, content); files that don't parse have no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows: list[tuple] = []
            for repo, file, content in pdf.itertuples(index=False):
                try:
                    rows += _walk(ast.parse(content or ""), repo, file)
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _FOUND.split(", ")])

    from vantage.runtime import settled

    found = settled(files.select("repo", "file", "content").mapInPandas(run, _FOUND))
    nodes = found.where("what = 'node'").select("repo", "node_id", "name", "kind", "file", "start_line", "end_line", "parameters")
    raw = found.where("what <> 'node'").select("repo", F.col("node_id").alias("source_id"), F.col("target").alias("raw"), F.col("what").alias("kind"), "file")
    named = nodes.where("kind in ('function', 'method', 'class')")
    short = F.substring_index("raw", ".", -1)
    here = named.groupBy("repo", "file", F.col("name").alias("n1")).agg(F.min("node_id").alias("id1"), F.count("*").alias("c1")).where("c1 = 1").withColumnsRenamed({"repo": "r1", "file": "f1"})
    any_ = named.groupBy("repo", F.col("name").alias("n2")).agg(F.min("node_id").alias("id2"), F.count("*").alias("c2")).where("c2 = 1").withColumnsRenamed({"repo": "r2"})
    plain = (F.col("raw") == short) | F.col("raw").startswith("self.")
    e = raw.withColumn("s", short).join(here, (F.col("repo") == F.col("r1")) & (F.col("file") == F.col("f1")) & (F.col("s") == F.col("n1")) & plain, "left")
    e = e.join(any_, (F.col("repo") == F.col("r2")) & (F.col("s") == F.col("n2")) & plain, "left")
    return nodes, e.select("repo", "source_id", F.when(F.col("kind") == "contains", F.col("raw")).otherwise(F.coalesce("id1", "id2", "raw")).alias("target_id"), "kind")
