"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame expressions alone.

A text is lower-cased and split at ASCII white space; its shingles are the sequences of ``WORDS`` words (a shorter text
is one shingle, one without words has none). A shingle's hash is the XXH64 chain over its words' XXH64. The sketch is the
``K`` least distinct hashes in ascending order. The sketch of a union is the K least of the parts' sketches, so
sketches merge across parts, files and days, exactly. From sketches alone come estimates of resemblance (Jaccard), of
containment and of the number of distinct shingles; all are exact while a text has fewer than K distinct shingles.
A null text counts as empty; a text of any length is sketched whole. Equal texts have equal sketches, whatever their ids.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import unused

WORDS, K = 5, 128
#: Rows in a chunk of neighbouring ids, about, and the most chunks (8 bytes each in the plan, 16 in a broadcast).
CHUNK_ROWS, CHUNKS = 64, 1 << 16
_SPACE = " \\t\\n\\x0B\\f\\r"


def with_sketch(df: DataFrame, text: str, out: str, words: int = WORDS, k: int = K) -> DataFrame:
    """Adds ``out``, an array of bigint: the sketch of the column ``text``."""
    t, w, h = f"_{out}_t", f"_{out}_w", f"_{out}_h"
    df = df.withColumn(t, F.expr(f"btrim(lower(coalesce({text}, '')), ' \\t\\n\\u000B\\u000C\\r')"))
    df = df.withColumn(w, F.transform(F.split(t, f"[{_SPACE}]+"), lambda x: F.xxhash64(x)))
    df = df.withColumn(h, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(F.col(w), i, words))))
    least = F.slice(F.sort_array(F.array_distinct(h)), 1, k)
    return df.withColumn(out, F.when(F.col(t) == "", F.array().cast("array<bigint>")).otherwise(least)).drop(t, w, h)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; of two empty sketches 1."""
    union = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from how low the k-th hash is."""
    last = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; of an empty a 1."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def merge_sketches(df: DataFrame, sketch: str, *keys: str, k: int = K) -> DataFrame:
    """The sketch of each group's union, as (keys, sketch); a group of empty sketches only is absent.

    Hashes are made distinct and cut to each task's k least of a key before they are shuffled, so a hot key moves
    at most k rows a task.
    """
    hashes = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    least = hashes.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_n") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def as_text(a: Column) -> Column:
    """A sketch as a string: its hashes in order, joined by commas."""
    return F.array_join(a.cast("array<string>"), ",")


def with_next(docs: DataFrame, id_col: str, cols: list[str], derive=lambda d: d) -> DataFrame:
    """Adds next_<col> of the row that follows in descending order of ids; after the last comes the first.

    Null ids come last; rows of equal ids follow by a hash of their first column of ``cols``, then by that column.
    ``derive`` may add columns before the step to the next row, which is taken for ``cols`` then present. Rows are dealt
    to chunks of neighbouring ids, by quantiles; an id that fills several quantiles, and null ids, are cut further by
    the hash, so neither an id that very many rows share nor a table without ids ends in one task (only rows equal in id
    and column stay together). A chunk also gets a copy of the row that follows its last one. So the rows are shuffled
    once, and no task has to see all of them. Other columns stay, whatever their names.
    """
    spark = docs.sparkSession
    id_, h, part, copy, to = (unused(f"_{x}", docs) for x in ("id", "hash", "part", "copy", "to"))
    own = docs.withColumn(id_, F.col(id_col).cast("long")).withColumn(h, F.xxhash64(F.coalesce(F.col(cols[0]).cast("string"), F.lit(""))))
    n, known = own.agg(F.count("*"), F.count(id_)).first()
    chunks, null_chunks = (max(1, min(CHUNKS, -(-m // CHUNK_ROWS))) for m in (known, n - known))
    quantiles: list[int] = []
    if chunks > 1:
        shares = ", ".join(f"{i / chunks:.9f}D" for i in range(1, chunks))
        quantiles = own.agg(F.expr(f"percentile_approx({id_}, array({shares}), {max(10_000, 4 * chunks)})")).first()[0] or []
    fills = Counter(quantiles)
    # a chunk starts at (id, hash); of an id that fills m quantiles, m chunks share the hashes
    cuts = [(x, -(1 << 63) + k * ((1 << 64) // m)) for x, m in sorted(fills.items()) for k in range(m)]
    # how many cuts are at or below the row, by binary search
    steps, top = [], 1
    while top <= len(cuts):
        steps.append(top)
        top *= 2
    chunk = F.lit(0)
    if cuts:
        ids, hashes = F.lit([x for x, _ in cuts]), F.lit([x for _, x in cuts])

        def below(place: Column) -> Column:
            x, y = F.try_element_at(ids, place), F.try_element_at(hashes, place)
            return (x < F.col(id_)) | ((x == F.col(id_)) & (y <= F.col(h)))

        chunk = F.aggregate(F.lit(steps[::-1]), F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & below(at + step), at + step).otherwise(at))
    null_chunk = F.least(F.lit(-1), F.floor((F.col(h).cast("double") / 2.0**64 + 0.5) * null_chunks).cast("int") - null_chunks)
    own = own.withColumn(part, F.when(F.col(id_).isNull(), null_chunk).otherwise(chunk))
    tops = own.groupBy(part).agg(F.max(F.struct(F.col(id_).alias("i"), F.col(h).alias("h"))).alias("top")).orderBy(part).collect()  # at most 2 CHUNKS + 1 rows
    after = [(r["top"]["i"], r["top"]["h"], tops[(i + 1) % len(tops)][part]) for i, r in enumerate(tops)]
    copies = F.broadcast(spark.createDataFrame(after, f"_top_i long, _top_h long, {to} int"))
    placed = own.join(copies, F.col(id_).eqNullSafe(F.col("_top_i")) & (F.col(h) == F.col("_top_h")), "left").select(*own.columns, to)
    here = F.struct(F.col(part).alias("c"), F.lit(False).alias("copy"))
    both = F.when(F.col(to).isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col(to).alias("c"), F.lit(True).alias("copy"))))
    dealt = placed.withColumn(copy, F.explode(both)).withColumn(part, F.col(f"{copy}.c")).withColumn(copy, F.col(f"{copy}.copy")).drop(to)
    dealt = derive(dealt.repartition(part))
    order = Window.partitionBy(part).orderBy(F.asc(copy), F.desc_nulls_last(id_), F.desc(h), F.asc(cols[0]))
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in cols}).where(~F.col(copy)).drop(id_, h, part, copy)


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    estimates: distinct_shingles, contained_edited (the share of the text's shingles that the edited text has),
    union_shingles (of both texts, from their merged sketch). Other columns of ``docs`` are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    near = with_next(own, "doc_id", ["text", "sketch"], lambda d: with_sketch(d, "text", "sketch"))
    near = near.withColumn("n_chars", F.length("text").cast("long"))
    near = near.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars - n_chars div 2 AS INT)), substring(next_text, 1, CAST(n_chars div 2 AS INT)))"))
    near = with_sketch(near, "edited", "edited_sketch")
    return near.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_count(F.col("sketch")).alias("distinct_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
        distinct_count(merged(F.col("sketch"), F.col("edited_sketch"))).alias("union_shingles"),
    )
