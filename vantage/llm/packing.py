"""Packing of token pieces into sequences by a grouping genetic algorithm.

Pieces are dealt by hash to shards of about ``SHARD`` pieces. In each shard ``ISLANDS`` populations evolve apart; a
solution's genes are whole sequences. Islands start from different solutions: best fit of the largest first, filling each
sequence with the lengths that complete it exactly, and both of these after a shuffle. Crossover takes whole well-filled
sequences of both parents, the fullest first, leaves out those that hold a piece already taken (duplicates), and puts the
displaced pieces back by best fit, largest first. After an epoch each island's elite also goes to the next island (a
ring), and a last step keeps each shard's best. A population stops after a generation that reaches the bound of
ceil(tokens / capacity) sequences.

The least filled sequence of each shard goes on to a next round of fewer shards, until one shard is left, so the
sequences left open by shards don't add up. Pieces that fill a sequence alone are never shuffled.
All tasks hold one shard's lengths (a few kB), whatever the corpus' size.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import discard, map_batches, unused, written
from vantage.llm.tokens import default_tokenizer, encoder

CAPACITY = 2048
SHARD, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4096, 2, 2, 4, 6
#: Sequences at least this full are passed on whole by crossover.
WELL_FILLED = 0.98

Bins = list[list[int]]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and id 0, cut into pieces where they are too many.

    Only the first piece of a cut document may be shorter than ``capacity``. A null text is empty: its only id is 0.
    """
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            rows = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(encode(text) + bytes(encode.dtype.itemsize), encode.dtype).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(d, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], items: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """Each item in turn goes to the fullest sequence that has room for it, or to a new one."""
    bins = bins if bins is not None else []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set when some sequence has r tokens of room
    for k, b in enumerate(bins):
        if room := capacity - sum(sizes[i] for i in b):
            by_room.setdefault(room, []).append(k)
            rooms |= 1 << room
    for i in items:
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if room := room - size:
            by_room.setdefault(room, []).append(k)
            rooms |= 1 << room
    return bins


def fitness(sizes: list[int], bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer sequences are better; among as many, unevenly filled ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def fill_exactly(sizes: list[int], items: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """New sequences for the items: each takes the first item left, then one or two that complete it, else the largest that fits.

    Sets of lengths are bits of an integer, so the lengths that complete a sequence are found by a few shifts.
    """
    bins = bins if bins is not None else []
    left: dict[int, list[int]] = {}
    for i in reversed(items):
        left.setdefault(sizes[i], []).append(i)
    there = mirror = 0  # bit n of there, and bit capacity - n of mirror: a piece of length n is left
    for n in left:
        there |= 1 << n
        mirror |= 1 << (capacity - n)
    gone = [False] * len(sizes)

    def take(n: int, own: list[int]) -> int:
        nonlocal there, mirror
        i = left[n].pop()
        if not left[n]:
            del left[n]
            there ^= 1 << n
            mirror ^= 1 << (capacity - n)
        gone[i] = True
        own.append(i)
        return n

    for i in items:
        if gone[i]:
            continue
        left[sizes[i]].remove(i) if left[sizes[i]][-1] != i else left[sizes[i]].pop()
        left[sizes[i]].append(i)
        own: list[int] = []
        room = capacity - take(sizes[i], own)
        while room > 0:
            fits = there & ((1 << (room + 1)) - 1)
            if not fits:
                break
            if fits >> room & 1:
                room -= take(room, own)
                continue
            pairs = fits & (mirror >> (capacity - room))  # n and room - n are both left
            half = room // 2
            if room % 2 == 0 and pairs >> half & 1 and len(left.get(half, ())) < 2:
                pairs ^= 1 << half
            if pairs:
                n = pairs.bit_length() - 1
                room -= take(n, own)
                room -= take(room, own)
                continue
            # nothing completes it: the pair or the piece that leaves the least room, looked for a little way down
            top = fits.bit_length() - 1
            for less in range(1, min(16, room - top) + 1):
                aim = room - less
                pairs = fits & (mirror >> (capacity - aim)) & ~(1 << (aim // 2) if aim % 2 == 0 else 0) & ((1 << aim) - 1)
                if pairs:
                    n = pairs.bit_length() - 1
                    room -= take(n, own)
                    room -= take(aim - n, own)
                    break
            else:
                room -= take(top, own)
        bins.append(own)
    return bins


def crossover(sizes: list[int], one: Bins, other: Bins, capacity: int, rng: random.Random) -> Bins:
    """Whole sequences of both parents, the better filled first; what is left over is put back by best fit, largest first.

    A well-filled sequence is passed over now and then, lest the children of two parents be all the same.
    """
    genes = [(sum(sizes[i] for i in b), k, b) for k, b in enumerate(one)] + [(sum(sizes[i] for i in b), -1 - k, b) for k, b in enumerate(other)]
    genes.sort(key=lambda g: (-g[0], rng.random()))
    kept, taken, full = [], set(), WELL_FILLED * capacity
    for fill, _, b in genes:
        if fill < full:
            break
        if taken.isdisjoint(b) and rng.random() < 0.95:
            kept.append(b[:])
            taken.update(b)
    displaced = sorted((i for b in one for i in b if i not in taken), key=lambda i: -sizes[i])
    return best_fit(sizes, displaced, capacity, kept)


def mutate(sizes: list[int], bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """The emptiest sequences and a few others are dissolved; their pieces fill sequences exactly or by best fit, in a shuffled order."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    gone = {*order[: max(3, len(bins) // 50)], *rng.sample(order, min(len(order), 1 + len(order) // 10))}
    loose = [i for k in gone for i in bins[k]]
    rng.shuffle(loose)
    if rng.random() < 0.5:
        loose.sort(key=lambda i: -sizes[i])
    kept = [b[:] for k, b in enumerate(bins) if k not in gone]
    return (fill_exactly if rng.random() < 0.7 else best_fit)(sizes, loose, capacity, kept)


def starts(sizes: list[int], capacity: int, island: int, rng: random.Random, population: int) -> list[Bins]:
    """An island's first solutions: even islands begin with best fit, odd ones with exact filling; then shuffled ones."""
    down = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    ways = (best_fit, fill_exactly) if island % 2 == 0 else (fill_exactly, best_fit)
    found = [ways[0](sizes, down, capacity)]
    while len(found) < population:
        # a shuffle among like lengths: the order stays nearly descending
        noisy = sorted(down, key=lambda i: -sizes[i] * rng.uniform(0.9, 1))
        found.append(ways[len(found) % 2](sizes, noisy, capacity))
    return found


def evolve(sizes: list[int], start: list[Bins], capacity: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS, island: int = 0) -> Bins:
    """The best solution of one island; ``start`` holds solutions that came from elsewhere."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    rank = lambda s: fitness(sizes, s, capacity)
    people = [[b[:] for b in s] for s in start]
    if people and max(map(len, people)) <= least:
        return max(people, key=rank)
    if not people:
        people = starts(sizes, capacity, island, rng, population)
    while len(people) < population:
        people.append(mutate(sizes, max(people, key=rank), capacity, rng))
    for _ in range(generations):
        people.sort(key=rank, reverse=True)
        a, b = people[0], people[rng.randrange(1, len(people))]
        young = [crossover(sizes, a, b, capacity, rng)]
        if len(a) > least:
            young += [crossover(sizes, b, people[-1], capacity, rng), mutate(sizes, a, capacity, rng)]
        people = sorted(people + young, key=rank, reverse=True)[:population]
        if len(people[0]) <= least:
            break
    return people[0]


def _bins(items: list[int], numbers: list[int]) -> Bins:
    found: dict[int, list[int]] = {}
    for i, b in zip(items, numbers, strict=True):
        found.setdefault(b, []).append(i)
    return list(found.values())


_GROUP = "shard long, island int, came int, item long, length long, bin int"


def _epoch(rows: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch of every island: rows of the solutions that it starts from (came; none where bin is null) to its elite."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        first = pdf[pdf.came == pdf.came.min()].sort_values("item")
        at = {x: k for k, x in enumerate(first.item.tolist())}
        sizes = first.length.tolist()
        start = [_bins([at[x] for x in own.item.tolist()], own.bin.tolist()) for _, own in pdf.groupby("came")] if epoch else []
        best = evolve(sizes, start, capacity, zlib.crc32(f"{shard} {island} {epoch}".encode()), island=island)
        items = first.item.to_numpy()
        return pd.DataFrame([(shard, island, 0, items[i], sizes[i], k) for k, b in enumerate(best) for i in b], columns=["shard", "island", "came", "item", "length", "bin"])

    return rows.groupBy("shard", "island").applyInPandas(run, _GROUP)


def _round(items: DataFrame, shards: int, capacity: int, level: int, islands: int, epochs: int) -> DataFrame:
    """(item, sequence, at, open): every item's place; open: its sequence is its shard's least filled one."""
    dealt = items.select(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).alias("shard"), "item", "length")
    rows = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(0).alias("came"), "item", "length", F.lit(None).cast("int").alias("bin"))
    before = None
    for e in range(epochs):
        rows = written(_epoch(rows, capacity, e), "elites")
        if before is not None:
            discard(before)
        before = rows
        if e + 1 < epochs and islands > 1:
            moved = rows.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.lit(1).alias("came"), "item", "length", "bin")
            rows = rows.unionByName(moved)

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        def worth(own: pd.DataFrame) -> tuple[int, float]:
            fill = own.groupby("bin").length.sum()
            return -len(fill), float((fill / capacity).pow(2).sum())

        own = max((g for _, g in pdf.sort_values("island").groupby("island")), key=worth).sort_values(["bin", "item"])
        fill = own.groupby("bin").length.sum()
        own = own.assign(at=own.groupby("bin").length.cumsum() - own.length, open=own.bin == fill.idxmin())
        return pd.DataFrame({"item": own.item, "length": own.length, "sequence": (level << 58) + (int(key[0]) << 20) + own["bin"].astype("int64"), "at": own["at"], "open": own.open})

    packed = written(rows.groupBy("shard").applyInPandas(best, "item long, length long, sequence long, at long, open boolean"), "packed")
    if before is not None:
        discard(before)
    return packed


def pack(sized: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Adds sequence_id and offset (which replace columns of these names) to rows with a ``length`` of 1 to ``capacity``.

    Each sequence's rows fill it gaplessly from offset 0. Rows keep their other columns, whatever their names; rows
    repeat freely, each is packed; an empty input stays empty. Which sequence a row gets depends on hashes of row
    numbers, not on arrival. A null or other length is an error.
    """
    sized = sized.drop("sequence_id", "offset")
    item = unused("_item", sized)
    checked = F.when(F.col("length").between(1, capacity), F.monotonically_increasing_id()).otherwise(F.raise_error(F.lit(f"a length must be 1 to {capacity}")).cast("long"))
    items = written(sized.withColumn(item, checked), "items")
    whole = items.where(F.col("length") >= capacity).select(*items.columns, (-1 - F.col(item)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level, places = items.where(F.col("length") < capacity).select(F.col(item).alias("item"), F.col("length").cast("long").alias("length")), 0, None
    while True:
        shards = -(-rest.count() // shard)
        if not shards:
            break
        done = _round(rest, shards, capacity, level, islands, epochs)
        settled = done if shards == 1 else done.where("not open")
        settled = settled.select(F.col("item").alias(item), F.col("sequence").alias("sequence_id"), F.col("at").alias("offset"))
        places = settled if places is None else places.unionByName(settled)
        if shards == 1:
            break
        rest, level = done.where("open").select("item", "length"), level + 1
    out = whole if places is None else whole.unionByName(items.where(F.col("length") < capacity).join(places, item).select(*whole.columns))
    return out.drop(item)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return pack(pieces(docs, tokenizer, capacity, id_col, text_col), capacity)
