"""Mixing of documents to target token shares by iterative proportional fitting.

Documents fall into cells of (source, lang, topic). Their tokens are summed by cell, and the cells' weights are raked
in turn to the target shares of each source, language and topic, until every marginal is met. A document is kept with
the probability that its cell's weight is calibrated to: proportional to the weight, at most 1, such that the expected
tokens kept are ``keep`` of all. The draw is a keyed hash of the document's id and text, so it is the same in every run;
rows equal in both are kept or dropped together.

Tokens are those of a public tokenizer. Topics are learned: spherical k-means over hashed token frequencies, weighted by
rarity. Rarities and centres are those of all documents: ``SAMPLE`` different texts (all, where there are fewer) only say
where the centres start, and rounds over a part of the texts, then over parts ``PARTS`` times as large, only bring them near
to where they will rest, as most rounds are long ways that a part shows as well. Rounds over all documents follow until the
centres rest, however many that takes: each is then the mean direction of just the documents that it is nearest to. A round
leaves out only documents that can't have changed their topic since they were last seen, by how far the centres have moved,
and counts them where they were. A topic that no document is nearest to starts again at the document farthest from all
centres, so there are ``TOPICS`` of them unless the documents have fewer directions. Every document gets the topic of the
nearest centre by its whole text.
A table with a column ``topic`` brings its own. A null text, or one without a token, has a null topic.

Nulls are categories of their own. A target that names no category is spread over no tokens and ignored; categories
without a target share what the others leave, in proportion to their tokens. Marginals that no weights can meet
(a category with tokens and a target of 0 is met by weight 0) leave the last iteration's weights, which are still the
closest in relative entropy to those found. An empty table stays empty. Other columns may have any names. A text of any
length is measured whole, one text at a time.

Up to ``DRIVER_CELLS`` cells (a few MB) are raked in the driver; more of them are raked as a table, by the same steps:
until every margin is met within ``CLOSE``, for at most ``ROUNDS`` rounds. A warning reports margins not met by then.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.llm.common import BATCH_ROWS, discard, map_batches, own_names, plain_names, written
from vantage.llm.tokens import default_tokenizer, encoder

#: Raked margins, and how strongly observed shares are levelled where no targets are given (1: not at all, 0: equal).
MARGINS, LEVELLING = ("source", "lang", "topic"), 0.7
KEEP, ROUNDS, CLOSE = 0.8, 200, 1e-9
DRIVER_CELLS = 50_000
KEY = "mix"
#: Learned topics; hashed token frequencies that describe a text; different texts that the centres start from (8 MB).
TOPICS, FEATURES, SAMPLE = 8, 1024, 2000
#: Centres rest when no coordinate changes by more. Sums of so many tasks reach the driver.
STILL, SUMS = 0.0, 64
#: Documents whose best two centres are this close at most are set apart; a lead within the last is left to rounding.
WIDEST, ROUNDING = 0.25, 1e-4
#: Leads under which documents are counted in a round, which says whether setting them apart saves work.
LEADS = 0.25 * 0.5 ** np.arange(9)
#: How much larger the next part of the texts is; the least has ``FIRST`` times ``SAMPLE`` texts or more. Rounds over a part
#: end when no lead can change by more than ``ROUGH``; those over all documents go on. In a part, centres go ``FURTHER`` ways.
PARTS, FIRST, ROUGH, FURTHER = 4, 3, 5e-3, 1.6


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Dampened frequencies of a text's token ids, hashed to ``FEATURES`` places."""
    return np.log1p(np.bincount(ids % FEATURES, minlength=FEATURES)).astype(np.float32)


def packed(ids: np.ndarray) -> bytes | None:
    """A text's frequencies as their places and values, without zeros; null where there is no token."""
    if not len(ids):
        return None
    counts = np.bincount(ids % FEATURES, minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + np.log1p(counts[at]).astype("<f4").tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    """Frequencies of packed rows."""
    x = np.zeros((len(rows), FEATURES), np.float32)
    for own, b in zip(x, rows, strict=True):
        n = len(b) // 6
        own[np.frombuffer(b, "<u2", n)] = np.frombuffer(b, "<f4", n, 2 * n)
    return x


def places(rows: list[bytes]) -> np.ndarray:
    """In how many of the packed rows each place is."""
    return np.bincount(np.concatenate([np.frombuffer(b, "<u2", len(b) // 6) for b in rows]), minlength=FEATURES)


class Topics:
    """Centres of topics and the weights of features."""

    def __init__(self, rarity: np.ndarray, centres: np.ndarray) -> None:
        self.rarity, self.centres = rarity, centres


def learn(x: np.ndarray, topics: int = TOPICS, rounds: int = 20, seed: int = 3) -> Topics:
    """Topics of rows of frequencies: spherical k-means from far-apart rows; the largest topic comes first."""
    x = x[x.any(axis=1)]
    rarity = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(1e-3)
    y = x * rarity
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    if len(y) <= topics:
        return Topics(rarity, y)
    rng = np.random.default_rng(seed)
    centres = y[[int(rng.integers(len(y)))]]
    while len(centres) < topics:  # the next centre is drawn by squared distance
        far = np.maximum(1 - (y @ centres.T).max(axis=1), 0)
        far = far**2 if far.sum() > 1e-9 else np.ones(len(y))
        centres = np.concatenate((centres, y[[int(rng.choice(len(y), p=far / far.sum()))]]))
    for _ in range(rounds):
        at = (y @ centres.T).argmax(axis=1)
        sums = np.array([y[at == k].sum(axis=0) for k in range(topics)])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres).astype(np.float32)
    sizes = np.bincount((y @ centres.T).argmax(axis=1), minlength=topics)
    return Topics(rarity, centres[np.argsort(-sizes, kind="stable")])


def _units(x: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Rows of frequencies as unit vectors weighted by rarity."""
    y = x * rarity
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return y


def _nearest(x: np.ndarray, model: Topics) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of frequencies as unit vectors weighted by rarity, the nearest centre of each, and its lead over the next."""
    y = _units(x, model.rarity)
    near = y @ model.centres.T
    best = np.partition(near, near.shape[1] - 2, axis=1)[:, -2:] if near.shape[1] > 1 else np.array([[-np.inf, 0]])
    return y, near.argmax(axis=1), np.broadcast_to(best[:, 1] - best[:, 0], len(x))


def _topic_sums(y: np.ndarray, at: np.ndarray, k: int, times: np.ndarray | float = 1) -> np.ndarray:
    """The sum of the unit vectors of each of k topics, and how many they are, as one row; a row counts so many times."""
    one = np.zeros((len(y), k), np.float32)
    one[np.arange(len(y)), at] = times
    return np.concatenate(((one.T @ y).ravel(), one.sum(axis=0)))


def _moved(sums: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centres as the mean directions of their topics; one without a document stays."""
    total = sums[: centres.size].reshape(centres.shape)
    norms = np.linalg.norm(total, axis=1, keepdims=True)
    return np.where(norms > 0, total / np.maximum(norms, 1e-12), centres).astype(np.float32)


def _summed(known: DataFrame, one: Callable[..., np.ndarray], width: int) -> np.ndarray:
    """The sum of ``one``, which gets each column as a list, over all rows; at most ``SUMS`` partial sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(width), TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                total += one(*(c.to_pylist() for c in b.columns))
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    return _added(map_batches(known, run, "part int, sums binary"), width)


def _added(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of tasks' sums, always in the same order."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = sum(np.frombuffer(x.as_py()) for x in table["sums"])
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    if parts.rdd.getNumPartitions() > SUMS:
        parts = parts.groupBy(F.col("part") % SUMS).applyInArrow(add, "part int, sums binary")
    got = parts.toArrow().sort_by("part")
    return sum((np.frombuffer(x.as_py()) for x in got["sums"]), np.zeros(width))


def _tally(x: np.ndarray, model: Topics, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Topics' sums over rows that lead by ``gap`` and over the others, rows by ``LEADS``, all rows; which rows the others are."""
    y, at, lead = _nearest(x, model)
    close, k = lead < gap, len(model.centres)
    parts = [_topic_sums(y[own], at[own], k) for own in (~close, close)] if close.any() else [_topic_sums(y, at, k), np.zeros(k * (FEATURES + 1))]
    return np.concatenate((*parts, (lead[:, None] < LEADS).sum(axis=0), [len(x)])), close


def _round(known: DataFrame, model: Topics) -> np.ndarray:
    """``_tally`` of all rows (column x)."""
    return _summed(known.select("x"), lambda rows: _tally(unpacked(rows), model, 0.0)[0], 2 * len(model.centres) * (FEATURES + 1) + len(LEADS) + 1)


def _apart(known: DataFrame, model: Topics, gap: float) -> tuple[DataFrame, np.ndarray]:
    """Rows (column x) whose nearest centre leads by less than ``gap``, written, and the ``_tally`` of all rows: one pass."""
    width = 2 * len(model.centres) * (FEATURES + 1) + len(LEADS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(width), TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                own, close = _tally(unpacked(b.column(0).to_pylist()), model, gap)
                total += own
                x = b.column(0).filter(pa.array(close))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.binary()), x], ["part", "sums", "x"])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], ["part", "sums", "x"])

    both = written(map_batches(known.select("x"), run, "part int, sums binary, x binary"), "close")
    return both, _added(both.where("sums is not null").select("part", "sums"), width)


def _farthest(known: DataFrame, model: Topics) -> tuple[float, np.ndarray]:
    """How far (1 - cosine) the row farthest from all centres is from the nearest, and that row as a unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far: tuple[float, bytes] = (-1.0, b"")
        for b in batches:
            if b.num_rows:
                rows = b.column(0).to_pylist()
                y, at, _ = _nearest(unpacked(rows), model)
                off = 1 - (y * model.centres[at]).sum(axis=1)
                far = max(far, *((float(off[i]), rows[i]) for i in np.flatnonzero(off == off.max())))
        if far[1]:
            yield pa.RecordBatch.from_arrays([pa.array([far[0]], pa.float64()), pa.array([far[1]], pa.binary())], ["off", "x"])

    row = map_batches(known.select("x"), run, "off double, x binary").orderBy(F.desc("off"), F.desc("x")).first()
    return row.off, _nearest(unpacked([row.x]), model)[0][0]


def _reach(a: np.ndarray, b: np.ndarray) -> float:
    """What the lead of a centre over another can change by at most when centres a become b: the longest way between two."""
    way = b.astype(float) - a
    return max((float(np.linalg.norm(way - one, axis=1).max()) for one in way), default=0.0)


def _roughly(sums: Callable[[np.ndarray], np.ndarray], centres: np.ndarray) -> np.ndarray:
    """Centres after rounds with the topics' sums by ``sums``, until they hardly move; they only start from here.

    Centres go ``FURTHER`` than to the means, as long as every round brings them nearer to the rows, then just to the means.
    """
    further, near, seen = FURTHER, -np.inf, set()
    while True:
        got = sums(centres)
        before, near = near, float((got[: centres.size] * centres.ravel()).sum())
        if near <= before:
            further = 1.0
        means = _moved(got, centres)
        if _reach(centres, means) <= ROUGH or centres.tobytes() in seen:
            return means
        seen.add(centres.tobytes())
        centres = centres + further * (means.astype(float) - centres)
        centres = (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).astype(np.float32) if further > 1 else means


def _blocks(known: DataFrame, rarity: np.ndarray) -> DataFrame:
    """Rows (column x) as unit vectors, up to ``BATCH_ROWS`` in one row, written: how many places each has, and their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = _units(unpacked(b.column(0).to_pylist()), rarity)
                row, place = np.nonzero(y)
                parts = np.bincount(row, minlength=len(y)).astype("<u2"), place.astype("<u2"), y[row, place].astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in parts], ["n", "place", "y"])

    return written(map_batches(known.select("x"), run, "n binary, place binary, y binary"), "blocks")


def _block_sums(blocks: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The topics' sums over the rows of ``_blocks``."""
    k = len(centres)

    def one(*columns: list[bytes]) -> np.ndarray:
        total = np.zeros(k * (FEATURES + 1))
        for n, place, values in zip(*columns, strict=True):
            n = np.frombuffer(n, "<u2")
            y = np.zeros((len(n), FEATURES), np.float32)
            y[np.repeat(np.arange(len(n)), n), np.frombuffer(place, "<u2")] = np.frombuffer(values, "<f4")
            total += _topic_sums(y, (y @ centres.T).argmax(axis=1), k)
        return total

    return _summed(blocks, one, k * (FEATURES + 1))


def _started(known: DataFrame, t: str, rarity: np.ndarray) -> np.ndarray:
    """Centres near to where they will rest: from far-apart texts, by rounds over larger and larger parts of the texts.

    A text is in a part by its hash, with all its copies, so parts don't depend on how rows are dealt.
    """
    # copies count once: else a few texts with very many copies would leave the others no place among the first
    count = known.select(t).distinct().count()
    u = F.pmod(F.xxhash64(F.lit("topics"), "t"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows, parts = known.select(F.col(t).alias("t"), "x"), []
    share = 1.0
    while count * share / PARTS >= FIRST * SAMPLE:
        share /= PARTS
        if count * share / PARTS >= FIRST * SAMPLE:  # another part is smaller: this one is gone over by tasks
            rows = written(rows.where(u < share), "part")
            parts.append(rows)
    least = share if share < 1 else 2 * SAMPLE / max(1, count)
    got = rows.where(u < least).groupBy("t").agg(F.min("x").alias("x"), F.count("*").alias("n")).withColumn("u", u).toArrow().sort_by([("u", "ascending"), ("t", "ascending")])
    texts, n = got["x"].to_pylist(), got["n"].to_numpy()  # under FIRST * SAMPLE * PARTS texts or so
    centres = learn(unpacked(sorted(texts[:SAMPLE]))).centres  # the order that rows arrive in doesn't count
    k = len(centres)
    if k and share < 1:
        y = _units(unpacked(texts), rarity)
        centres = _roughly(lambda c: _topic_sums(y, (y @ c.T).argmax(axis=1), k, n), centres)
        for part in reversed(parts):
            blocks = _blocks(part, rarity)
            centres = _roughly(lambda c, blocks=blocks: _block_sums(blocks, c), centres)
            discard(blocks)
    discard(*parts)
    return centres


def _fitted(table: DataFrame, t: str) -> Topics:
    """Topics of all rows of ``table``, which has packed frequencies x (null where a text has no token) and texts' hashes t."""
    known = table.where("x is not null")
    known_rows = _summed(known.select("x"), lambda rows: np.concatenate(([len(rows)], places(rows))), FEATURES + 1)
    n = int(known_rows[0])
    rarity = np.log((1 + n) / (1 + known_rows[1:])).astype(np.float32) + np.float32(1e-3)
    model = Topics(rarity, _started(known, t, rarity))
    k = len(model.centres)
    if not k:
        return model

    # Levels: rows to go over, the sums over those left out, their least lead, the centres it was measured at. They keep
    # their topics until the centres can have changed a lead by as much; as the centres slow down, fewer rows are close.
    width = k * (FEATURES + 1)
    levels = [(known, np.zeros(width), np.inf, model.centres)]
    gap, seen = 0.0, set()  # rounding could bring centres back instead of to rest
    while model.centres.tobytes() not in seen:
        seen.add(model.centres.tobytes())
        while any(_reach(since, model.centres) >= least - ROUNDING for *_, least, since in levels):
            discard(levels.pop()[0])
            gap = 0.0
        rows, rest, *_ = levels[-1]
        if gap:
            rows, got = _apart(rows.where("x is not null"), model, gap)
            levels.append((rows, rest + got[:width], gap, model.centres))
        else:
            got = _round(rows.where("x is not null"), model)
        total = rest + got[:width] + got[width : 2 * width]
        sizes = total[k * FEATURES :]
        centres = _moved(total, model.centres)
        rests = np.abs(centres - model.centres).max() <= STILL
        if rests and not sizes.all():
            off, row = _farthest(known, model)
            if off > ROUNDING:
                centres[int(sizes.argmin())], rests = row, False
        step = _reach(model.centres, centres)
        # the next round sets the close rows apart where they are a half of the rows at most
        under, gone = got[2 * width : -1], got[width + k * FEATURES : 2 * width].sum() if gap else got[-1]
        fit = (LEADS >= max(4 * step, 10 * ROUNDING)) & (LEADS <= min(WIDEST, levels[-1][2] / 2)) & (under <= gone / 2)
        gap = float(LEADS[fit].min(initial=np.inf)) if fit.any() else 0.0
        model = Topics(rarity, centres)
        if rests:
            break
    discard(*(rows for rows, *_ in levels[1:]))
    return Topics(rarity, model.centres[np.argsort(-sizes, kind="stable")])  # the largest topic comes first


def fit_topics(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> Topics:
    """Topics learned from all of ``docs``; where they start comes from some of its texts."""
    tokenizer = tokenizer or default_tokenizer()
    known = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            made = [np.frombuffer(encode(x.as_py()), encode.dtype) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed(x) for x in made], pa.binary())], ["h", "x"])

    table = written(map_batches(known, run, T.StructType([known.schema["h"], T.StructField("x", T.BinaryType())])), "frequencies")
    model = _fitted(table, "h")
    discard(table)
    return model


def measured(docs: DataFrame, tokenizer: str | None = None, with_text: bool = True) -> DataFrame:
    """``plain_names(docs)`` with tokens, source, lang, topic and the draw u in [0, 1): texts are tokenised and written once.

    Without ``with_text`` the column of the text is null.
    """
    tokenizer = tokenizer or default_tokenizer()
    learned = "topic" not in docs.columns
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    draw = F.pmod(F.xxhash64(F.lit(KEY), at["doc_id"], at["text"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
    given = F.lit(None).cast("string") if learned else F.col(at["topic"]).cast("string")
    own = plain_names(docs).select("*", F.col(at["source"]).cast("string").alias("source"), F.col(at["lang"]).cast("string").alias("lang"), draw.alias("u"), given.alias("topic"), F.xxhash64(at["text"]).alias("h"))
    place = docs.columns.index("text")
    schema = T.StructType([*own.schema.fields, T.StructField("tokens", T.LongType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            tokens, x = [], []
            for text in b.column(place):
                ids = np.frombuffer(encode(text.as_py()), encode.dtype)
                tokens.append(len(ids))
                x.append(packed(ids) if learned else None)
            cols = list(b.columns)
            if not with_text:
                cols[place] = pa.nulls(b.num_rows, cols[place].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(tokens, pa.int64()), pa.array(x, pa.binary())], [*b.schema.names, "tokens", "x"])

    table = written(map_batches(own, run, schema), "measured")
    if not learned:
        return table.drop("h", "x")
    model = _fitted(table, "h")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TOPICS and FEATURES

    @F.arrow_udf("string")
    def topic(x: pa.Array) -> pa.Array:
        out: list[str | None] = [None] * len(x)
        for start in range(0, len(x), BATCH_ROWS):
            part = x.slice(start, BATCH_ROWS)
            known = [i for i, r in enumerate(part.is_valid().to_pylist()) if r]
            if known and len(shared.value.centres):
                for i, k in zip(known, _nearest(unpacked(part.drop_null().to_pylist()), shared.value)[1], strict=True):
                    out[start + i] = f"topic-{k}"
        return pa.array(out, pa.string())

    out = table.withColumn("topic", topic("x")).drop("h", "x")
    if with_text:  # two readers find the topics again, which costs less than to write the texts again
        return out
    out = written(out, "topics")
    discard(table)
    return out


def target_shares(observed: dict, wanted: dict | None, levelling: float = LEVELLING) -> dict:
    """The share of each observed category. ``wanted`` gives some; without it, observed shares to the power levelling."""
    total = sum(observed.values())
    if not total:
        return {k: 1 / len(observed) for k in observed}
    if wanted is None:
        raised = {k: (v / total) ** levelling if v else 0.0 for k, v in observed.items()}
    else:
        given = {k: max(0.0, wanted[k]) for k in observed if k in wanted and observed[k]}
        other = sum(v for k, v in observed.items() if k not in given)
        rest = max(0.0, 1 - sum(given.values()))
        raised = {k: given[k] if k in given else (rest * v / other if other else 0.0) for k, v in observed.items()}
    scale = sum(raised.values()) or 1.0
    return {k: v / scale for k, v in raised.items()}


def _unmet(worst: float, rounds: int) -> None:
    warnings.warn(f"mixing: after {rounds} rounds the margins are still off by up to {worst:.1e}; the last weights are used", stacklevel=3)


def rake(tokens: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Weights by which the cells' tokens meet the shares of every margin; codes: each cell's category in a margin."""
    mass = tokens / max(tokens.sum(), 1)
    now = mass.copy()
    for _ in range(rounds):
        worst = 0.0
        for code, share in zip(codes, shares, strict=True):
            sums = np.bincount(code, now, len(share))
            worst = max(worst, float(np.abs(sums - share)[sums > 0].max(initial=0)))
            now = now * np.divide(share, sums, out=np.zeros_like(share), where=sums > 0)[code]
        if worst < close:
            break
    else:
        _unmet(worst, rounds)
    return np.divide(now, mass, out=np.zeros_like(now), where=mass > 0)


def calibrate(tokens: np.ndarray, weights: np.ndarray, keep: float) -> np.ndarray:
    """min(1, c * weight) with c such that the expected tokens are ``keep`` of all, or as many as weights over 0 allow."""
    order = np.argsort(-weights, kind="stable")
    w, n = weights[order], tokens[order].astype(float)
    aim = min(keep * n.sum(), n[w > 0].sum())
    done, below = np.concatenate(([0], np.cumsum(n))), np.concatenate((np.cumsum((w * n)[::-1])[::-1], [0.0]))
    for k in range(len(w)):  # the k heaviest cells are kept whole
        if below[k] <= 0:
            break
        c = (aim - done[k]) / below[k]
        if c * w[k] <= 1:
            return np.minimum(1, np.maximum(c, 0) * weights)
    return (weights > 0).astype(float)


def _raked_in_driver(cells: DataFrame, targets: dict | None, keep: float, levelling: float) -> DataFrame:
    spark, names = cells.sparkSession, [f"_{m}" for m in MARGINS]
    rows = cells.orderBy(*names).collect()  # at most DRIVER_CELLS
    tokens, codes, shares = np.array([r._n for r in rows], float), [], []
    for m in MARGINS:
        seen: dict = {}
        for r in rows:
            seen[r[f"_{m}"]] = seen.get(r[f"_{m}"], 0) + r._n
        share = target_shares(seen, (targets or {}).get(m), levelling)
        at = {k: i for i, k in enumerate(seen)}
        codes.append(np.array([at[r[f"_{m}"]] for r in rows], int))
        shares.append(np.array([share[k] for k in seen], float))
    weights = rake(tokens, codes, shares, ROUNDS, CLOSE)
    p = calibrate(tokens, weights, keep) if tokens.sum() else np.ones(len(rows))
    p = np.where(tokens > 0, p, 1.0)
    return spark.createDataFrame([(*(r[n] for n in names), float(w), float(x)) for r, w, x in zip(rows, weights, p, strict=True)], ", ".join(f"{n} string" for n in names) + ", weight double, p double")


def _raked_as_table(cells: DataFrame, targets: dict | None, keep: float, levelling: float) -> DataFrame:
    """The same steps with a table of cells: a margin's sums are joined back to its cells."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("_n")).first()[0] or 0
    now = written(cells.withColumn("_m", F.col("_n") / F.lit(float(max(total, 1)))), "cells")
    wanted = {}
    for m in MARGINS:
        name = f"_{m}"
        sums = now.groupBy(name).agg(F.sum("_m").alias("_s"))
        given = (targets or {}).get(m)
        if given is None:
            raised = sums.withColumn("_r", F.when(F.col("_s") > 0, F.pow("_s", F.lit(levelling))).otherwise(0.0))
        else:
            rows = spark.createDataFrame([(k, float(max(0.0, v))) for k, v in given.items()], "_k string, _g double")
            raised = sums.join(rows, F.col(name).eqNullSafe(F.col("_k")) & (F.col("_s") > 0), "left")
            left, other = raised.agg(F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("_g"), F.lit(0.0))), F.sum(F.when(F.col("_g").isNull(), F.col("_s")))).first()
            raised = raised.withColumn("_r", F.coalesce("_g", F.lit(left) * F.col("_s") / F.lit(other or 1.0)))
        scale = raised.agg(F.sum("_r")).first()[0] or 1.0
        wanted[m] = written(raised.select(F.col(name).alias("_k"), (F.col("_r") / scale).alias("_t")), "targets")
    for _ in range(ROUNDS):
        worst = []
        for m in MARGINS:
            name = f"_{m}"
            sums = now.groupBy(name).agg(F.sum("_m").alias("_s")).join(wanted[m], F.col(name).eqNullSafe(F.col("_k")))
            factor = sums.select("_k", F.when(F.col("_s") > 0, F.col("_t") / F.col("_s")).otherwise(0.0).alias("_f"), F.when(F.col("_s") > 0, F.abs(F.col("_t") - F.col("_s"))).otherwise(0.0).alias("_d"))
            nxt = written(now.drop("_d").join(factor, F.col(name).eqNullSafe(F.col("_k"))).select("_source", "_lang", "_topic", "_n", (F.col("_m") * F.col("_f")).alias("_m"), "_d"), "cells")
            discard(now)
            now = nxt
            worst.append(now.agg(F.max("_d")).first()[0] or 0.0)
        if max(worst) < CLOSE:
            break
    else:
        _unmet(max(worst), ROUNDS)
    weighed = written(now.withColumn("weight", F.when(F.col("_n") > 0, F.col("_m") * F.lit(float(max(total, 1))) / F.col("_n")).otherwise(0.0)), "weights")
    aim = min(keep * total, weighed.where("weight > 0").agg(F.sum("_n")).first()[0] or 0)
    scale = 0.0
    while True:  # expected tokens are concave in the scale: it grows, in few steps, to where they are ``aim``
        whole = F.col("weight") * F.lit(scale) >= 1
        done, below = weighed.agg(F.sum(F.when(whole, F.col("_n"))), F.sum(F.when(~whole, F.col("_n") * F.col("weight")))).first()
        if not below:  # every cell with a weight is kept whole
            break
        more = (aim - (done or 0)) / below
        if more <= scale * (1 + 1e-12):
            break
        scale = more
    return weighed.select(*(f"_{m}" for m in MARGINS), "weight", F.when(F.col("_n") > 0, F.least(F.lit(1.0), F.col("weight") * scale)).otherwise(1.0).alias("p"))


def weigh(docs: DataFrame, targets: dict | None = None, keep: float = KEEP, levelling: float = LEVELLING, tokenizer: str | None = None, with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` with n_tokens, topic, weight, p and kept (which replace columns of these names).

    ``targets`` gives, for some of source, lang and topic, shares of tokens by category. Documents without a token are
    kept with their cell's probability, or surely where their cell has no token. Without ``with_text`` texts are left out.
    """
    own = measured(docs, tokenizer, with_text)
    names = [f"_{m}" for m in MARGINS]
    cells = written(own.groupBy(*(F.col(m).alias(f"_{m}") for m in MARGINS)).agg(F.sum("tokens").alias("_n")), "cells")
    few = cells.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS
    table = (_raked_in_driver if few else _raked_as_table)(cells, targets, keep, levelling)
    table = F.broadcast(table) if few else table  # few: at most DRIVER_CELLS rows
    match = F.lit(True)
    for m, n in zip(MARGINS, names, strict=True):
        match = match & F.col(m).eqNullSafe(F.col(n))
    out = own.join(table, match)
    made = {"n_tokens": F.col("tokens"), "topic": F.col("topic"), "weight": F.col("weight"), "p": F.col("p"), "kept": F.col("u") < F.col("p")}
    rest = [c for c, name in zip(own_names(docs), docs.columns, strict=True) if name not in made and (with_text or name != "text")]
    return out.select(*rest, *(c.alias(name) for name, c in made.items()))
