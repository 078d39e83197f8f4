"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes a space, and the subwords are the UTF-8 byte n-grams of 1 to 4
bytes inside words, a word's ends included. Each is hashed to one of ``BUCKETS`` embeddings; their mean goes through a
linear softmax. The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled documents
(about ``PER_LANGUAGE`` of each language, those of least hash) and on short windows of them. A part of the sample that
training doesn't see sets a temperature and the least score at which a prediction is accepted.

A prediction uses a document's whole text and nothing else. Texts that are null or have no letter (a character of a
Unicode category L) are ``und`` with score 0 and are rejected; so is everything if no language could be learned.
Documents with a null doc_id or language are never learned from. Any number of languages can be learned: each gets an
equal part of the sample of ``SAMPLE`` documents, in expectation, so the sample alone bounds what the driver holds.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import discard, map_batches, written

BUCKETS, DIM, NGRAMS = 1 << 15, 16, (1, 2, 3, 4)
PER_LANGUAGE, WINDOWS = 300, 3
#: Documents of the whole sample, about, however many the languages, and the buckets of a training text (its commonest):
#: together at most 160 MB of counts in the driver. Predictions have no such bounds.
SAMPLE, TEXT_BUCKETS = 4800, 4096
#: Up to so many languages' shares are broadcast; beyond, narrow rows are joined to the same result.
BROADCAST_LANGUAGES = 10_000
EPOCHS, RATE, BATCH = 12, 40.0, 32
#: Of validation texts, the share that may be rejected; a score over MOST is never rejected.
REJECTS, MOST = 0.002, 0.5
UNKNOWN = "und"

_CHUNK = 1 << 20


_NOT_LETTERS = re.compile(r"[\W\d_]+")


@lru_cache(maxsize=1)
def _numbers() -> tuple[re.Pattern, re.Pattern]:
    """Numbers that are no decimal digits, such as fractions, which \\w takes in; apart from those beyond U+FFFF, as sets of these are slow."""
    every = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
    return re.compile(f"[{''.join(c for c in every if c <= '\uffff')}]"), re.compile(f"[{''.join(c for c in every if c > '\uffff')}]")


def cleaned(text: str | None) -> bytes:
    """Lower-cased words with single spaces between and around them; empty if there is no letter (Unicode category L)."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not words.isascii():
        near, far = _numbers()
        words = near.sub(" ", words)
        if max(words) > "\uffff":
            words = far.sub(" ", words)
        words = " ".join(words.split())
    return f" {words} ".encode("utf-8", "surrogatepass") if words else b""


def subwords(clean: bytes, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all subwords, in chunks; a chunk's n-grams start in it, so chunks miss and repeat none."""
    raw = np.frombuffer(clean, np.uint8)
    for at in range(0, len(raw), _CHUNK):
        b = raw[at : at + _CHUNK + max(NGRAMS) - 1]
        wide, space = b.astype(np.uint32), b == 32
        for n in NGRAMS:
            m = min(len(b) - n + 1, _CHUNK)
            if m <= 0:
                continue
            h = np.full(m, 2166136261 + n, np.uint32)
            for k in range(n):
                h = (h ^ wide[k : k + m]) * np.uint32(16777619)
            inside = ~space[:m] if n == 1 else np.ones(m, bool)
            for k in range(1, n - 1):
                inside &= ~space[k : k + m]
            h = h[inside]
            yield (h ^ (h >> np.uint32(15))) % np.uint32(buckets)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, clean: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.bias)), 0
        for own in subwords(clean, len(self.table)):
            total += self.table[own].sum(axis=0, dtype=np.float64)
            n += len(own)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, rejected."""
        clean = cleaned(text)
        if not clean or not self.languages:
            return UNKNOWN, 0.0, True
        p = softmax(self.logits(clean)[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.least)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """rows: language, buckets, counts. Every fifth of them only calibrates."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    if len(languages) == 1:
        return Model(languages, np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(r[0]) for r in rows])
    check = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    own = np.flatnonzero(~check)
    emb, w, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)

    def dense(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that a batch uses, and each of its rows' shares of them."""
        used, at = np.unique(np.concatenate([rows[i][1] for i in some]), return_inverse=True)
        x, start = np.zeros((len(some), len(used)), np.float32), 0
        for k, i in enumerate(some):
            n = len(rows[i][1])
            x[k, at[start : start + n]] = rows[i][2] / rows[i][2].sum()
            start += n
        return used, x

    steps, step = EPOCHS * -(-len(own) // BATCH), 0
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(own), -(-len(own) // BATCH)):
            used, x = dense(some)
            h = x @ emb[used]
            g = softmax(h @ w + bias)
            g[np.arange(len(some)), y[some]] -= 1
            g /= len(some)
            rate = RATE * (1 - step / steps)
            back = g @ w.T
            w -= rate / 10 * (h.T @ g)
            bias -= rate / 400 * g.sum(axis=0)
            emb[used] -= rate * (x.T @ back)
            step += 1
    seen = np.zeros(BUCKETS, bool)
    for i in own:
        seen[rows[i][1]] = True
    model = Model(languages, np.where(seen[:, None], emb @ w, 0).astype(np.float32), bias.astype(np.float64))
    if check.any():
        held = np.flatnonzero(check)
        z = np.array([(model.table[rows[i][1]] * (rows[i][2] / rows[i][2].sum())[:, None]).sum(axis=0) + bias for i in held])
        right = np.arange(len(held)), y[held]
        temperatures = np.geomspace(0.05, 20, 121)
        loss = [-np.log(np.maximum(softmax(z / t)[right], 1e-12)).mean() for t in temperatures]
        model.temperature = float(temperatures[int(np.argmin(loss))])
        model.least = float(min(MOST, np.quantile(softmax(z / model.temperature).max(axis=1), REJECTS)))
    return model


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, text, lang): of each language about ``per_language`` rows of least hash, fewer where languages are many.

    A language's share of hashes follows from its number of rows, so nothing is ranked or gathered. Rows equal in all
    three columns count once.
    """
    known = docs.where("lang is not null and doc_id is not null and text is not null").select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.count("*").alias("rows"))
    languages = counts.agg(F.count("*").alias("languages"))
    share = F.least(F.lit(float(per_language)), F.lit(float(SAMPLE)) / F.col("languages")) / F.col("rows")
    table = written(counts.crossJoin(languages).select(F.col("lang").alias("_l"), share.alias("_share")), "shares")  # a row each, by one row
    u = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    few = table.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    if few:
        chosen = known.join(F.broadcast(table), F.col("lang") == F.col("_l")).where(u < F.col("_share"))
    else:  # the same rows, found without shuffling texts: about SAMPLE keys come back to them
        narrow = known.select("doc_id", "lang", u.alias("_u"), F.xxhash64("text").alias("_h"))
        keys = written(narrow.join(table, F.col("lang") == F.col("_l")).where("_u < _share").select("doc_id", "_u", "_h").distinct(), "keys")
        chosen = known.withColumns({"_u": u, "_h": F.xxhash64("text")}).join(F.broadcast(keys), ["doc_id", "_u", "_h"])
    return chosen.select("doc_id", "text", "lang").dropDuplicates()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Train on labelled documents (doc_id, text, lang). What reaches the driver is bounded by the sample's parameters.

    A sample of more than twice its expected size is an error; it is never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, str, bytes, bytes]] = []
            for d, text, lang in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                clean = cleaned(text)
                if not clean:
                    continue
                rng = np.random.default_rng(abs(d))
                words, texts = clean.split(), [clean]
                for _ in range(WINDOWS):
                    n = int(rng.integers(1, 13))
                    at = int(rng.integers(0, max(1, len(words) - n + 1)))
                    texts.append(b" " + b" ".join(words[at : at + n]) + b" ")
                for k, own in enumerate(texts):
                    counts = sum((np.bincount(s, minlength=BUCKETS) for s in subwords(own)), np.zeros(BUCKETS, np.int64))
                    used = np.flatnonzero(counts)
                    if len(used) > TEXT_BUCKETS:
                        used = np.sort(used[np.argsort(-counts[used], kind="stable")[:TEXT_BUCKETS]])
                    out.append((d, k, lang, used.astype("<u4").tobytes(), counts[used].astype("<f4").tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "k", "lang", "ids", "counts"])

    table = written(map_batches(sample(docs, per_language), run, "doc_id long, k int, lang string, ids binary, counts binary"), "langid")
    if (found := table.count()) > 2 * (WINDOWS + 1) * SAMPLE:
        raise ValueError(f"the sample has {found} texts, over twice as many as {SAMPLE} documents have")
    rows = table.toArrow()
    discard(table)
    rows = rows.sort_by([("k", "ascending"), ("lang", "ascending"), ("doc_id", "ascending"), ("ids", "ascending")]) if rows.num_rows else rows
    return train([(r["lang"], np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["counts"], "<f4")) for r in rows.to_pylist()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred, score and rejected (which replace columns of these names).

    The model that every task gets is bounded by ``BUCKETS`` and the languages in the sample.
    """
    from pyspark.sql import types as T

    own = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = own.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict(x) for x in b.column(at).to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*b.schema.names, "lang_pred", "score", "rejected"])

    schema = T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return map_batches(own, run, schema)


def held_out() -> F.Column:
    """Documents that are never learned from: crc32 of the decimal doc_id is 0 modulo 5; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """``predict`` with a model learned from those documents that aren't held out."""
    return predict(docs, fit(docs.where(~held_out()).select("doc_id", "text", "lang")))
