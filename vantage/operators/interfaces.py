"""Interfaces of entry points: the offline descriptor, answers parsed from JSON, batching, collapsing, EXT types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage import model as M
from vantage.functions.text import empty_strings, lookup, url_literals
from vantage.runtime import running

ROLES = ("server", "client", "both", "none")


def _descriptor(role: Column, kind: Column, signature: Column, aliases: Column, why: str) -> Column:
    return F.struct(F.lit(True).alias("is_entry_point"), F.lit("medium").alias("entry_point_confidence"), role.alias("interface_role"), kind.alias("interface_kind"), signature.alias("signature"), aliases.alias("signature_aliases"), F.lit(why).alias("explanation"))


def fallback_descriptor(entry_type: Column, code: Column, language: Column, name: Column) -> Column:
    """What static marks tell of an interface: exported or imported native functions, URL literals, else the entry type."""
    code, name = F.coalesce(code, F.lit("")), F.coalesce(name, F.lit(""))
    paths = url_literals(code)
    has = name != ""
    export = has & language.isin("c", "cpp") & (code.contains("extern") | code.contains("dllexport"))
    imported = has & (language == "c_sharp") & code.contains("DllImport")
    kinds, roles = ({k: v[i] for k, v in M.FALLBACK_INTERFACE.items()} for i in (0, 1))
    none = F.lit("none")
    return (
        F.when(F.coalesce(export, F.lit(False)), _descriptor(F.lit("server"), F.lit("ffi"), name, F.array(name), "exported native function"))
        .when(F.coalesce(imported, F.lit(False)), _descriptor(F.lit("both"), F.lit("pinvoke"), name, F.array(name), "imported native function"))
        .when(F.size(paths) > 0, _descriptor(F.lit("both"), F.lit("http"), paths[0], F.slice(paths, 2, F.greatest(F.size(paths) - 1, F.lit(0))), "URL literal"))
        .otherwise(_descriptor(lookup(roles, entry_type, none), lookup(kinds, entry_type, none), F.lit(""), empty_strings(), "entry point type"))
    )


_ANSWER = "struct<results: array<string>>"
_ITEM = "struct<index: string, is_entry_point: boolean, entry_point_confidence: string, interface_role: string, interface_kind: string, signature: string, signature_aliases: array<string>, explanation: string, is_match: boolean, confidence: string>"


def answers(responses: DataFrame, text: str = "response") -> DataFrame:
    """A row for every item of the results that a response's JSON object holds, with its place; other columns stay.

    The object is the widest span of braces around "results"; responses without a readable one give no row, nor do
    items that aren't objects or lack an index.
    """
    span = F.regexp_extract(F.coalesce(text, F.lit("")), r'(?s)\{.*"results".*\}', 0)
    keep = [c for c in responses.columns if c != text]
    items = responses.withColumn("_r", F.from_json(span, _ANSWER)["results"]).select(*keep, F.posexplode("_r").alias("place", "_i"))
    read = items.withColumn("_x", F.from_json("_i", _ITEM)).where(F.col("_i").startswith("{") & F.get_json_object("_i", "$.index").isNotNull())
    return read.select(*keep, "place", "_x.*").withColumn("index", F.col("index").try_cast("int")).where("index is not null")


def descriptors(items: DataFrame, responses: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, node_id, descriptor...) for the items (batch, index, node_id) that a response answers; the last answer counts."""
    a = answers(responses)
    joined = items.join(a, [batch, "index"])
    last = Window.partitionBy(batch, "index").orderBy(F.desc("place"))
    one = joined.withColumn("rn", F.row_number().over(last)).where("rn = 1")
    role = F.lower(F.trim(F.coalesce("interface_role", F.lit("none"))))
    return one.select(
        batch,
        "node_id",
        F.coalesce("is_entry_point", F.lit(True)).alias("is_entry_point"),
        F.coalesce("entry_point_confidence", F.lit("high")).alias("entry_point_confidence"),
        F.when(role.isin(*ROLES), role).otherwise("none").alias("interface_role"),
        F.lower(F.trim(F.coalesce("interface_kind", F.lit("none")))).alias("interface_kind"),
        F.trim(F.coalesce("signature", F.lit(""))).alias("signature"),
        F.coalesce("signature_aliases", empty_strings()).alias("signature_aliases"),
        F.coalesce("explanation", F.lit("")).alias("explanation"),
    )


def decisions(responses: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, index, is_match, confidence) of link answers: the last counts; an unknown confidence is medium."""
    a = answers(responses)
    last = Window.partitionBy(batch, "index").orderBy(F.desc("place"))
    low = F.lower(F.trim("confidence"))
    one = a.withColumn("rn", F.row_number().over(last)).where("rn = 1")
    return one.select(batch, "index", F.coalesce("is_match", F.lit(False)).alias("is_match"), F.when(low.isin("high", "medium", "low"), low).otherwise("medium").alias("confidence"))


def with_descriptors(entries: DataFrame, known: DataFrame, fallback: Column) -> DataFrame:
    """Entries with the descriptor known for them, or the fallback."""
    return entries.join(known.select("repo", "node_id", "descriptor"), ["repo", "node_id"], "left").withColumn("descriptor", F.coalesce("descriptor", fallback))


def endpoint_rows(entries: DataFrame) -> DataFrame:
    """Entries with a ``descriptor`` that are entry points and have an interface, as endpoints."""
    d = F.col("descriptor")
    has = d["is_entry_point"] & (d["interface_role"] != "none") & (d["interface_kind"] != "none") & (d["interface_kind"] != "")
    return entries.where(has).select("repo", "node_id", "function_name", "file_path", "start_line", "entry_point_type", d["interface_kind"].alias("interface_kind"), d["interface_role"].alias("interface_role"), d["signature"].alias("signature"), d["signature_aliases"].alias("signature_aliases"))


def batches_by_file(items: DataFrame, n: int = M.ENTRY_BATCH, file: str = "file", ord_: str = "ord") -> DataFrame:
    """Adds batch (from 1): whole chunks of a file in file order; what is left of files is pooled and flushed when full.

    A pooled batch comes right after the file that fills it; the last, unfilled one comes at the end. What is left of
    files, and the batches, are numbered by ranges, so no task ranks them all.
    """
    own = Window.partitionBy(file)
    r = items.withColumn("_rn", F.row_number().over(own.orderBy(ord_))).withColumn("_c", F.count("*").over(own))
    whole = F.col("_rn") <= F.col("_c") - F.col("_c") % n
    full = r.where(whole).select(*items.columns, F.struct(F.lit(0).alias("last"), F.col(file).alias("f"), F.lit(0).alias("pooled"), F.expr(f"CAST((_rn - 1) div {n} AS BIGINT)").alias("chunk")).alias("_b"))
    tail = running(r.where(~whole), [file, "_rn"], "_at").withColumn("_t", F.expr(f"_at div {n}")).drop("_at")
    by = Window.partitionBy("_t")
    tail = tail.withColumn("_close", F.max(file).over(by)).withColumn("_size", F.count("*").over(by))
    pooled = tail.select(*items.columns, F.struct(F.when(F.col("_size") < n, 1).otherwise(0).alias("last"), F.when(F.col("_size") < n, F.lit("")).otherwise(F.col("_close")).alias("f"), F.lit(1).alias("pooled"), F.col("_t").cast("long").alias("chunk")).alias("_b"))
    every = full.unionByName(pooled)
    ids = running(every.select("_b").distinct(), ["_b"], "_at").select("_b", (F.col("_at") + 1).alias("batch"))
    return every.join(ids, "_b").drop("_b")


def chunks(items: DataFrame, order: list[str], n: int = M.LINK_BATCH) -> DataFrame:
    """Adds chunk (from 0) and index (from 0) of fixed-size chunks in order."""
    return running(items, order, "_at").withColumn("chunk", F.expr(f"CAST(_at div {n} AS BIGINT)")).withColumn("index", (F.col("_at") % n).cast("int")).drop("_at")


def spread(items: DataFrame, groups: list[str], decided: DataFrame, default: Column) -> DataFrame:
    """One decision a group, back on all its members: rejected groups go, undecided ones stay with the default confidence.

    ``decided`` is (groups..., is_match, new_confidence).
    """
    out = items.join(decided, groups, "left").where("is_match is null or is_match")
    return out.withColumn("confidence", F.coalesce(F.when(F.col("is_match"), F.col("new_confidence")), default)).drop("is_match", "new_confidence")


def remap_types(modules: DataFrame, mapping: DataFrame, types: str = "types") -> DataFrame:
    """Types replaced by their representatives, distinct and sorted; those without one stay. ``mapping`` (module, type, representative)."""
    e = modules.select("module", F.explode(types).alias("type")).join(mapping, ["module", "type"], "left").select("module", F.coalesce("representative", "type").alias("t")).distinct()
    return modules.drop(types).join(e.groupBy("module").agg(F.array_sort(F.collect_list("t")).alias(types)), "module", "left")
