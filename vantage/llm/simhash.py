"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most three bits, one half differs in
at most one bit. Each half is therefore indexed under its exact value and under its 32 values with one bit deleted
(one-wildcard variants); equal keys are brought together and verified exactly. A key that very many different
fingerprints share is cut again in the half not yet used (16, then 8 bits, by the same argument), until fewer than
``RUN`` can share it: no pair is dropped and no group is expanded into all its pairs, only into a spanning forest.

Texts without words have fingerprint zero; null texts count as empty. Equal fingerprints are one node, whose least
doc_id represents it. Null doc_ids are kept and never become a component's id unless they are alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.llm.common import components, discard, map_batches, unused, written

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: A run of equal keys longer than this is cut further instead of compared directly.
RUN = 2048


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of all word shingles (ASCII case folded, ASCII white space): a bit is set if in over half the hashes."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the memory of long texts
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the signed 64-bit view of each document's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def _half(h: int) -> F.Column:
    """Half h of fp, 0 the low one."""
    return F.expr(f"(shiftrightunsigned(fp, {32 * h}) & 4294967295L)")


def _bit(n: int) -> F.Column:
    return F.expr(f"shiftrightunsigned(outer, {n}) & 1L")


def _variants(value: str, bits: int) -> str:
    """SQL: the exact value (position ``bits``) and the values with each bit deleted, tagged by position."""
    return f"concat(array(shiftleft(CAST({bits} AS BIGINT), {bits}) | {value}), transform(sequence(0, {bits - 1}), i -> shiftleft(CAST(i AS BIGINT), {bits}) | ({value} & ~shiftleft(1L, i))))"


def _near(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints that share a key."""
    if len(fps) == 2:
        return [(0, 1)] if int(np.bitwise_count(fps[0] ^ fps[1])) <= distance else []
    left, found = np.arange(len(fps)), []
    todo: list[int] = []
    while len(left) or todo:
        if not todo:
            todo, left = [int(left[0])], left[1:]
        i = todo.pop()
        near = np.bitwise_count(fps[left] ^ fps[i]) <= distance
        if near.any():
            found += [(i, int(j)) for j in left[near]]
            todo += left[near].tolist()
            left = left[~near]
    return found


def _links(keyed: DataFrame, distance: int, last: bool) -> DataFrame:
    """Links (a, b) within runs of equal ``key``; rows of runs over RUN come back as (fp, key, null) to be cut further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        names, held_k, held_f = ["a", "b", "key"], [], []
        long_key = None  # the key of a run already known to be long, whose rows pass straight on

        def out(a: np.ndarray, b: np.ndarray, key: np.ndarray | None) -> pa.RecordBatch:
            nulls = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), nulls if b is None else pa.array(b, pa.int64()), nulls if key is None else pa.array(key, pa.int64())], names)

        def close(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole runs."""
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            u = fps.view(np.uint64)
            two = starts[sizes == 2]
            near = np.bitwise_count(u[two] ^ u[two + 1]) <= distance
            pairs = set(zip(fps[two[near]].tolist(), fps[two[near] + 1].tolist(), strict=True))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if n > RUN and not last:
                    yield out(fps[s : s + n], None, keys[s : s + n])
                else:
                    own = fps[s : s + n]
                    pairs.update((int(own[i]), int(own[j])) for i, j in _near(u[s : s + n], distance))
            new = {(min(p), max(p)) for p in pairs} - seen
            if len(seen) > 500_000:
                seen.clear()
            seen.update(new)
            if new:
                a, b = np.array(sorted(new), np.int64).T
                yield out(a, b, None)

        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            if long_key is not None:
                n = int(np.searchsorted(k != long_key, True)) if k[-1] != long_key else len(k)
                if n:
                    yield out(f[:n], None, k[:n])
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                long_key = None
            held_k.append(k)
            held_f.append(f)
            if sum(map(len, held_k)) < 1 << 16:
                continue
            k, f = np.concatenate(held_k), np.concatenate(held_f)
            cut = int(np.searchsorted(k, k[-1]))  # sorted by key: the last run may go on
            if cut:
                yield from close(k[:cut], f[:cut])
            held_k, held_f = [k[cut:]], [f[cut:]]
            if len(held_k[0]) > RUN and not last:
                yield out(held_f[0], None, held_k[0])
                long_key, held_k, held_f = int(k[-1]), [], []
        if held_k:
            yield from close(np.concatenate(held_k), np.concatenate(held_f))

    return keyed.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, key long")


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect all different fingerprints ``fp`` at most ``distance`` bits apart as those links would."""
    if distance > 3:
        raise ValueError("two halves with one wildcard cover distances up to 3")
    halves = [fps.select("fp", F.explode(F.expr(_variants("v", 32))).alias("var")) for fps in (fps.withColumn("v", _half(h)) for h in (0, 1))]
    # level 1: half h under one of its variants; the other half is still unused
    level = halves[0].withColumn("key", F.col("var")).unionByName(halves[1].withColumn("key", F.col("var") + F.lit(1 << 40)))
    found = written(_links(level, distance, False), "links")
    links, used = found.where("key is null").select("a", "b"), [found]
    for bits in (16, 8):
        hot = found.where("key is not null").select(F.col("a").alias("fp"), F.col("key").alias("outer"))
        if hot.isEmpty():
            break
        # bit 40 of a key: of which half it is; bit 41, from level 2 on: of which quarter of the other half
        hot = hot.withColumn("rest", F.when(_bit(40) == 0, _half(1)).otherwise(_half(0)))
        if bits == 8:
            hot = hot.withColumn("rest", F.when(_bit(41) == 0, F.shiftright("rest", 16)).otherwise(F.col("rest").bitwiseAND(F.lit(0xFFFF))))
        parts = None
        for q in (0, 1):
            cut = hot.withColumn("v", F.expr(f"shiftright(rest, {bits * q}) & {(1 << bits) - 1}L"))
            cut = cut.select("fp", "outer", F.explode(F.expr(_variants("v", bits))).alias("sub"), F.lit(q).alias("q"))
            parts = cut if parts is None else parts.unionByName(cut)
        mixed = F.xxhash64("outer", "sub", "q").bitwiseAND(F.lit(~(3 << 40)))
        keyed = parts.select("fp", mixed.bitwiseOR(F.shiftleft(_bit(40), 40)).bitwiseOR(F.shiftleft(F.col("q").cast("long"), 41)).alias("key"))
        found = written(_links(keyed, distance, bits == 8), "links")
        used.append(found)
        links = links.unionByName(found.where("key is null").select("a", "b"))
    every = written(links.distinct(), "links")
    discard(*used)
    return every


def roots(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) of different fingerprints: the root names the component that the links join."""
    links = near_links(fps, distance)
    found = components(links)
    discard(links)
    return fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document: 16 hex digits and the least doc_id reachable by links."""
    prints = written(with_fingerprints(docs, id_col, text_col), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    by_node = nodes.join(roots(nodes.select("fp"), distance), "fp")
    least = by_node.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_print = by_node.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near-duplicates, with all columns of ``docs``: a row of its least doc_id.

    Rows are told apart by a number of their own, never by their id, so unlike texts stay whatever ids they share or
    lack. Null ids come after all others; of rows with equal ids any one stays. Columns may have any names.
    """
    row, fp = unused("_row", docs), unused("_fp", docs)
    at, names = docs.columns.index(text_col), docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x) for x in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], [*names, fp])

    marked = written(map_batches(docs, run, schema).withColumn(row, F.monotonically_increasing_id()), "simhash")
    own = marked.select(F.col(row).alias("row"), F.col(fp).alias("fp"), F.col(id_col).cast("long").alias("doc_id"))
    # one row stands for each fingerprint; the order of a struct puts rows with an id first
    nodes = written(own.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")), "nodes")
    first = nodes.join(roots(nodes.select("fp"), distance), "fp").groupBy("root").agg(F.min("first").alias("first"))
    # rows are as many as documents: never broadcast, so that every size runs the same plan
    kept = first.select(F.col("first.row").alias(row)).hint("merge")
    return marked.join(kept, row, "left_semi").select(names)
