"""The port for an external judge of texts, such as a language model. Nothing here opens a connection.

A judge is a picklable callable from a list of prompts to as many answers, None where it has none. Without one, every
caller has an offline result. Equal prompts are asked once; answers are written before they are used, so none is asked
again when an executor is lost.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage import model as M
from vantage.operators import incremental, interfaces
from vantage.runtime import settled

Judge = Callable[[list[str]], list[str | None]]
ATTEMPTS, PAUSE_SECONDS = 5, 2.0


def ask(prompts: DataFrame, judge: Judge, column: str = "prompt", attempts: int = ATTEMPTS, pause: float = PAUSE_SECONDS) -> DataFrame:
    """Adds ``response``; null where every attempt failed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = pdf["prompt"].tolist()
            answers: list[str | None] = [None] * len(texts)
            for n in range(attempts):
                todo = [i for i, a in enumerate(answers) if a is None]
                if not todo:
                    break
                if n:
                    time.sleep(pause)
                try:
                    for i, a in zip(todo, judge([texts[i] for i in todo]), strict=True):
                        answers[i] = a
                except Exception:  # a judge may fail in any way; the next attempt, or no answer, follows
                    continue
            yield pd.DataFrame({"prompt": texts, "response": answers})

    once = prompts.select(F.col(column).alias("prompt")).distinct()
    said = settled(once.mapInPandas(run, "prompt string, response string"))
    return prompts.join(said.withColumnRenamed("prompt", column), column, "left")


def entry_prompt(name: Column, kind: Column, code: Column) -> Column:
    """One entry point as a numbered item of a batch's prompt."""
    return F.concat_ws("\n", F.concat(F.lit("function: "), name), F.concat(F.lit("input: "), kind), F.lit("code:"), F.coalesce(code, F.lit("")))


_ASK_ENTRIES = 'For each numbered item tell whether it is an entry point, and its interface, as JSON {"results": [{"index", "is_entry_point", "entry_point_confidence", "interface_role", "interface_kind", "signature", "signature_aliases", "explanation"}]}.\n\n'
_ASK_LINKS = 'For each numbered item tell whether the client uses the server interface, as JSON {"results": [{"index", "is_match", "confidence"}]}.\n\n'
_ASK_TYPES = 'Group the outside interfaces that are one, as JSON {"results": [{"index", "interface_kind"}]} with the type that stands for each item.\n\n'


def _batched(items: DataFrame, by: str, text: str, intro: str, judge: Judge) -> DataFrame:
    """(by, response): a prompt for each batch of numbered items, at most a few rows each."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", F.col(text).alias("t")))), lambda x: F.concat(x["index"].cast("string"), F.lit(". "), x["t"])), "\n\n")
    return ask(items.groupBy(by).agg(F.concat(F.lit(intro), listed).alias("prompt")), judge).drop("prompt")


def describe(entries: DataFrame, judge: Judge | None = None, batch: int = M.ENTRY_BATCH) -> DataFrame:
    """Entries (with code and language) and their ``descriptor``: the judge's, or the offline one where it gave none."""
    offline = interfaces.fallback_descriptor(F.col("entry_point_type"), F.col("code"), F.col("language"), F.col("function_name"))
    if judge is None:
        return entries.withColumn("descriptor", offline)
    item = entries.withColumn("_file", F.concat_ws(":", "repo", "file_path"))
    numbered = interfaces.batches_by_file(item.select("repo", "node_id", "_file"), batch, "_file", "node_id")
    from pyspark.sql import Window

    numbered = settled(numbered.withColumn("index", F.row_number().over(Window.partitionBy("batch").orderBy("_file", "node_id")) - 1))
    texts = numbered.join(entries, ["repo", "node_id"]).select("batch", "index", entry_prompt(F.col("function_name"), F.col("entry_point_type"), F.col("code")).alias("t"))
    said = _batched(texts, "batch", "t", _ASK_ENTRIES, judge)
    key = numbered.select("batch", "index", F.to_json(F.struct("repo", "node_id")).alias("node_id"))
    d = interfaces.descriptors(key, said)
    known = d.select(F.get_json_object("node_id", "$.repo").alias("repo"), F.get_json_object("node_id", "$.node_id").alias("node_id"), F.struct(*[c for c in d.columns if c not in ("batch", "node_id")]).alias("descriptor"))
    return interfaces.with_descriptors(entries, known, offline)


GROUP = ["link_type", "server_repo", "server_signature", "client_repo", "client_file"]


def confirm(edges: DataFrame, judge: Judge | None = None, n: int = M.LINK_BATCH) -> DataFrame:
    """Candidate links that the judge doesn't reject; without a judge, or an answer, all as they are.

    Candidates with the same ends, signature and file are judged once, and the answer counts for all of them.
    """
    if judge is None:
        return edges
    keyed = edges.withColumns({"server_repo": F.col("to_repo"), "client_repo": F.col("from_repo")})
    groups = keyed.groupBy(*GROUP).agg(F.min("client_snippet").alias("snippet"))
    numbered = settled(interfaces.chunks(groups, GROUP, n))
    text = F.concat_ws(" | ", *GROUP, "snippet")
    said = _batched(numbered.select("chunk", "index", text.alias("t")), "chunk", "t", _ASK_LINKS, judge)
    d = interfaces.decisions(said, "chunk")
    decided = numbered.join(d, ["chunk", "index"]).select(*GROUP, "is_match", F.col("confidence").alias("new_confidence"))
    return interfaces.spread(keyed, GROUP, decided, F.col("confidence")).select(edges.columns)


KNOWN = ["link_type", "to_repo", "server_signature", "from_repo", "client_file", "client_line"]


def confirm_new(edges: DataFrame, judge: Judge | None = None, earlier: DataFrame | None = None, n: int = M.LINK_BATCH) -> DataFrame:
    """``confirm`` that asks only about candidates which no earlier link has by ``KNOWN``.

    The others stay with that link's confidence; both parts are returned. Links that were rejected are no earlier
    links, so they are judged again.
    """
    if judge is None or earlier is None:
        return confirm(edges, judge, n)
    own = edges.withColumnRenamed("confidence", "_own")
    kept, rest = incremental.reuse(own, earlier, KNOWN, ["confidence"])
    asked = confirm(settled(rest.withColumnRenamed("_own", "confidence")), judge, n)
    return kept.select(edges.columns).unionByName(asked.select(edges.columns))


def representatives(modules: DataFrame, judge: Judge | None = None) -> DataFrame:
    """(module, type, representative) for modules of two types or more; without a judge a type stands for itself."""
    each = modules.where(F.size("types") > 1).select("module", F.posexplode("types").alias("index", "type"))
    if judge is None:
        return each.select("module", "type", F.col("type").alias("representative"))
    said = _batched(each.select("module", "index", F.col("type").alias("t")), "module", "t", _ASK_TYPES, judge)
    a = interfaces.answers(said).select("module", "index", F.col("interface_kind").alias("representative"))
    return each.join(a, ["module", "index"], "left").select("module", "type", F.coalesce("representative", "type").alias("representative"))
