"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= t are at a squared distance of at most 2 - 2t. They are rotated by an orthogonal matrix and
split into blocks; in at least one block two such vectors are within that block's share of the squared distance, in
proportion to its dimensions. So each block is range-joined under its own budget, and the union of what the blocks find
is verified exactly, in double precision, on the whole vectors.

The rotation turns the principal axes of a bounded sample to the front (any rotation is exact), and blocks take the axes
in turn, so each has its share of the directions in which vectors differ most. The range join of a block lays a grid as
wide as its radius over its first axes. A vector belongs to its cell and is copied to those later neighbouring cells
that its ball reaches, so any two within the radius meet once. How many blocks, and over how many axes a grid, is chosen
for each length of vector by counting on the sample what each choice would compare and copy (``plan``): vectors that lie
near a few directions are cut into many small cells; where no choice compares less than everything, as with vectors that
are spread evenly over all directions, one block of one cell remains, and every pair is compared once.

Cells of more than ``TILE`` vectors are cut into tiles, and pairs of tiles are separate tasks. A tile's distances are
screened on a block's first ``SCREEN`` axes. A link is counted in the first block whose budget it meets, so nothing has
to be made distinct. A tile gives each vector's number of links and a spanning forest of its links, never the links
themselves: its output is as long as its input, however dense it is.

Equal vectors are one class with a count. Vectors that are null, zero, or hold null or non-finite components link with
nothing; so do vectors of different lengths with each other. Other columns are ignored, whatever their names. An empty
table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import components, discard, map_batches, written

COSINE, TILE, SCREEN = 0.95, 16384, 16
#: Vectors that plans are made from; lengths of vectors that get a plan of their own; copies of a vector that a plan may make.
SAMPLE, LENGTHS, COPIES = 2048, 4, 8
SLACK = 1e-9
_ROWS, _COLUMNS = 256, 16384


@dataclass
class Plan:
    """How vectors of one length are cut: rotation (None: none), axes of each block, axes under the grid."""

    basis: np.ndarray | None
    blocks: list[np.ndarray]
    grid: int

    def budgets(self, cosine: float) -> np.ndarray:
        """Each block's share of the squared distance."""
        return np.array([len(b) for b in self.blocks]) * ((2 - 2 * cosine) / sum(map(len, self.blocks)) * (1 + SLACK))

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return x if self.basis is None else x @ self.basis


def single(dim: int) -> Plan:
    """One block of one cell."""
    return Plan(None, [np.arange(dim)], 0)


def dealt(dim: int, n: int) -> list[np.ndarray]:
    """``n`` blocks that take the axes in turn."""
    return [np.arange(k, dim, n) for k in range(n)]


def cost(cells: Iterator[tuple[int, np.ndarray, np.ndarray, int]], n: int) -> tuple[float, float]:
    """(pairs compared, as a share of all; copies of a vector) of the cells of ``n`` vectors."""
    own: dict[tuple[int, int], int] = {}
    came: dict[tuple[int, int], int] = {}
    for block, _, keys, side in cells:
        for k, c in zip(*np.unique(keys, return_counts=True), strict=True):
            at = came if side else own
            at[block, int(k)] = at.get((block, int(k)), 0) + int(c)
    pairs = sum(c * (c - 1) / 2 + c * came.get(k, 0) for k, c in own.items())
    return pairs / max(n * (n - 1) / 2, 1), (sum(own.values()) + sum(came.values())) / max(n, 1)


def plan(x: np.ndarray, cosine: float) -> Plan:
    """The plan that compares least on a sample of unit vectors, weighed by the axes that a comparison screens."""
    n, dim = x.shape
    if n < 64 or dim < 2:
        return single(dim)
    _, axes = np.linalg.eigh(np.cov(x.T))
    basis = np.ascontiguousarray(axes[:, ::-1])
    best, least = Plan(basis, [np.arange(dim)], 0), float(8 + min(SCREEN, dim))
    for number in (1, 2, 3, 4, 6, 8):
        if number > dim:
            break
        for grid in range(1, min(4, dim // number) + 1):
            made = Plan(basis, dealt(dim, number), grid)
            share, copies = cost(cells(x, made, cosine), n)
            weight = share * (8 + min(SCREEN, dim // number)) + 1e-3 * copies
            if copies < COPIES and weight < 0.9 * least:
                best, least = made, weight
    return best


def vector_bytes(batch: pa.Array) -> list[bytes | None]:
    """Each vector's components, after a byte that tells whether single precision holds them; None if it can't link."""
    out: list[bytes | None] = []
    for x in batch.to_pylist():
        v = None if not x or None in x else np.array(x, np.float64) + 0.0  # -0.0 becomes 0.0
        if v is None or not np.isfinite(v).all() or not v.any():
            out.append(None)
            continue
        with np.errstate(over="ignore"):
            short = v.astype(np.float32)
        out.append(b"f" + short.tobytes() if (short == v).all() else b"d" + v.tobytes())
    return out


def dimensions(blob: bytes) -> int:
    return (len(blob) - 1) // (4 if blob[:1] == b"f" else 8)


def _units(blobs: list[bytes]) -> np.ndarray:
    """Unit vectors, in double precision, of blobs of equal dimensions."""
    if all(b[:1] == b"f" for b in blobs):
        x = np.frombuffer(b"".join(b[1:] for b in blobs), np.float32).reshape(len(blobs), -1).astype(np.float64)
    else:
        x = np.array([np.frombuffer(b, np.float32 if b[:1] == b"f" else np.float64, offset=1).astype(np.float64) for b in blobs])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lest squares overflow or vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cells(x: np.ndarray, how: Plan, cosine: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(block, rows, keys, side): the cells that each of the unit vectors belongs to (side 0) or is copied to (1)."""
    y = how.rotate(x)
    rows = np.arange(len(x))
    for b, (own, budget) in enumerate(zip(how.blocks, how.budgets(cosine), strict=True)):
        width = float(np.sqrt(budget)) if budget > 0 else 1e-6
        g = min(how.grid, len(own))
        if not g:
            yield b, rows, np.zeros(len(x), np.int64), 0
            continue
        z = y[:, own[:g]]
        cell = np.floor(z / width).astype(np.int64)
        base = 2 * (int(np.ceil(1 / width)) + 2) + 1
        places = np.array([base**d for d in range(g)], np.int64)

        def key(c: np.ndarray, places: np.ndarray = places, base: int = base) -> np.ndarray:
            return (c + base // 2) @ places

        yield b, rows, key(cell), 0
        low, high = z - cell * width, (cell + 1) * width - z
        for offset in product((-1, 0, 1), repeat=g):
            if offset <= (0,) * g:
                continue
            gap = sum((high[:, d] ** 2 if o > 0 else low[:, d] ** 2) for d, o in enumerate(offset) if o)
            near = np.flatnonzero(gap <= budget)
            yield b, near, key(cell[near] + np.array(offset)), 1


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Joins the classes of the links (i, j); returns the labels and the links that joined two."""
    found: list[tuple[int, int]] = []
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label, found
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        first = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
        parent = np.arange(len(label))
        parent[high[first]] = low[first]  # every class is hung under a lower one at most once: no cycle
        found += zip(i[first].tolist(), j[first].tolist(), strict=True)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]


def tile_links(how: Plan, block: int, x: np.ndarray, weight: np.ndarray, side: np.ndarray, part: np.ndarray, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Numbers of links (weighted) and a spanning forest of a tile's links that are this block's to count.

    Pairs need one row of the cell itself (side 0) and, in a tile of two parts, one row of each. Rows of the cell come
    first, so a pair is met once, by its earlier row. Distances over the block's first axes, which are at most those over
    the block, are screened in single precision, with room for its error, by one product: |a - b|^2 <= s exactly if
    a.b - |b|^2 / 2 >= (|a|^2 - s) / 2.
    """
    order = np.argsort(side, kind="stable")
    back = order  # place in the tile of each sorted row
    x, weight, part, own = x[order], weight[order], part[order], int((side == 0).sum())
    n = len(x)
    y = how.rotate(x)
    budget = how.budgets(cosine)
    z = y[:, how.blocks[block][:SCREEN]].astype(np.float32)
    norm = np.einsum("ij,ij->i", z, z)
    left = np.concatenate((z[:own], np.ones((own, 1), np.float32)), axis=1)
    right = np.concatenate((z, -norm[:, None] / 2), axis=1).T.copy()
    least = (norm[:own] - np.float32(budget[block])) / 2 - np.float32(1e-5)
    counts, label, forest = np.zeros(n, np.int64), np.arange(n), []
    two = part.min() != part.max()
    for at in range(0, own, _ROWS):
        for col in range(at, n, _COLUMNS):
            some = right[:, col : col + _COLUMNS]
            hit = np.flatnonzero(left[at : at + _ROWS] @ some >= least[at : at + _ROWS, None])
            if not len(hit):
                continue
            i, j = np.divmod(hit, some.shape[1])
            i, j = i + at, j + col
            keep = (j > i) & (part[i] != part[j]) if two else j > i
            i, j = i[keep], j[keep]
            for lo in range(0, len(i), 1 << 16):
                p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                ok = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                p, q = p[ok], q[ok]
                if not len(p):
                    continue
                if len(how.blocks) > 1:
                    apart = (y[p] - y[q]) ** 2
                    gaps = np.array([apart[:, c].sum(axis=1) for c in how.blocks]).T <= budget
                    mine = gaps.argmax(axis=1) == block
                    p, q = p[mine], q[mine]
                np.add.at(counts, p, weight[q])
                np.add.at(counts, q, weight[p])
                label, joined = _forest(label, p, q)
                forest += joined
    out = np.zeros(n, np.int64)
    out[back] = counts
    return out, [(int(back[i]), int(back[j])) for i, j in forest]


def plans(classes: DataFrame, cosine: float) -> dict[int, Plan]:
    """A plan for each of the commonest lengths of a sample of the vectors, by hash."""
    share = SAMPLE / max(1, classes.count())
    u = F.pmod(F.xxhash64(F.lit("plan"), "v"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    by: dict[int, list[bytes]] = {}
    for r in classes.where(u < share).select("v").collect():  # about SAMPLE vectors
        by.setdefault(dimensions(bytes(r.v)), []).append(bytes(r.v))
    common = sorted(by, key=lambda d: (-len(by[d]), d))[:LENGTHS]
    return {d: plan(_units(sorted(by[d])), cosine) for d in common}


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs of rows with cosine >= ``cosine``.

    component_id is the least vec_id reachable, kept whether it is the row's own. Repeated vec_ids are rows of their own.
    """
    spark = vectors.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vector_bytes(b.column(1)), pa.binary())], ["vec_id", "v"])

    rows = written(map_batches(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e")), read, "vec_id long, v binary", 4096), "vectors")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    shared = spark.sparkContext.broadcast(plans(classes, cosine))  # at most LENGTHS rotations

    def keyed(hot: dict[tuple[int, int, int], int], only_keys: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cid, n, v = b.column("cid").to_numpy(), b.column("n").to_numpy(), b.column("v").to_pylist()
                sizes = np.array([dimensions(x) for x in v])
                for size in np.unique(sizes).tolist():
                    some = np.flatnonzero(sizes == size)
                    blobs = [v[k] for k in some]
                    for block, at, key, side in cells(_units(blobs), shared.value.get(size) or single(size), cosine):
                        if only_keys:
                            k, c = np.unique(key, return_counts=True)
                            cols = [np.full(len(k), size, np.int32), np.full(len(k), block, np.int32), k, c.astype(np.int64)]
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["dim", "block", "key", "c"])
                            continue
                        cuts = np.array([hot.get((size, block, x), 1) for x in key.tolist()], np.int64)
                        own = cid[some[at]] % cuts
                        reps = np.repeat(np.arange(len(at)), cuts)
                        other = np.arange(len(reps)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                        a, o = at[reps], own[reps]
                        constant = [np.full(len(a), size, np.int32), np.full(len(a), block, np.int32)]
                        cols = [*constant, key[reps], np.minimum(o, other), np.maximum(o, other), o, np.full(len(a), side, np.int32), cid[some[a]], n[some[a]]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), pa.array([blobs[k] for k in a], pa.binary())], ["dim", "block", "key", "t1", "t2", "part", "side", "cid", "n", "v"])

        return run

    counted = map_batches(classes, keyed({}, True), "dim int, block int, key long, c long", 4096).groupBy("dim", "block", "key").agg(F.sum("c").alias("c"))
    size = F.greatest(F.lit(512), F.least(F.lit(TILE), F.expr("4194304 div dim"))) if TILE >= 512 else F.lit(TILE)
    # a cell is a place in the unit ball's grid: their number is bounded by the radius, whatever the table's size
    hot = {(r.dim, r.block, r.key): r.cuts for r in counted.withColumn("cuts", F.ceil(F.col("c") / size)).where("cuts > 1").collect()}
    tiles = map_batches(classes, keyed(hot, False), "dim int, block int, key long, t1 long, t2 long, part long, side int, cid long, n long, v binary", 4096)

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cid = pdf["cid"].to_numpy()
        how = shared.value.get(int(key[0])) or single(int(key[0]))
        counts, forest = tile_links(how, int(key[1]), _units(pdf["v"].tolist()), pdf["n"].to_numpy(), pdf["side"].to_numpy(), pdf["part"].to_numpy(), cosine)
        some = np.flatnonzero(counts)
        links = pd.DataFrame({"a": cid[some], "b": pd.array([None] * len(some), "Int64"), "w": counts[some]})
        edges = pd.DataFrame({"a": [cid[i] for i, _ in forest], "b": pd.array([cid[j] for _, j in forest], "Int64"), "w": 0})
        return pd.concat([links, edges]).astype({"a": "int64", "w": "int64"})

    found = written(tiles.groupBy("dim", "block", "key", "t1", "t2").applyInPandas(tile, "a long, b long, w long"), "tile-links")
    roots = components(found.where("b is not null").select("a", "b"))
    sums = found.where("b is null").groupBy("a").agg(F.sum("w").alias("w"))
    info = classes.select("cid", "rep", "n").join(sums, F.col("cid") == F.col("a"), "left").join(roots, F.col("cid") == F.col("node"), "left")
    info = written(info.select("cid", "rep", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "classes-linked")
    discard(found)
    least = info.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = info.join(least, "root").select("cid", "n_links", "component_id")
    linked = rows.where("v is not null").join(classes.select("v", "cid"), "v").join(by_class, "cid").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
