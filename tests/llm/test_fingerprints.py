import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from vantage.llm import fingerprints as fp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_shingles(text, words=5):
    parts = [w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in parts]
    out = set()
    for i in range(max(1, len(hashes) - words + 1) if hashes else 0):
        h = 42
        for x in hashes[i : i + words]:
            h = xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), h)
        out.add(signed(h))
    return out


def plain_near(a, b, k):
    a, b = sorted(a)[:k], sorted(b)[:k]
    u = sorted({*a, *b})[:k]
    return 1.0 if not u else sum(x in a and x in b for x in u) / len(u)


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)), r[1] or ""))
    out = []
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = plain_shingles(t), plain_shingles(edited), plain_shingles(nxt)
        text = lambda s: ",".join(map(str, sorted(s)[: fp.K]))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), plain_near(a, b, fp.K), plain_near(a, c, fp.K)))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_chars int, edited string")
    every = fp.compare_neighbours(docs).collect()
    got = [tuple(r)[:7] for r in every]
    assert sorted(got, key=str) == plain(rows)
    for r in every:
        a, b = ({int(x) for x in f.split(",") if x} for f in (r.fingerprint, r.edited_fingerprint))
        assert 0 <= r.contained_edited <= 1 and r.union_shingles >= r.distinct_shingles * 0.999
        if len(a) < fp.K and len(b) < fp.K and len(a | b) < fp.K:  # all estimates are exact
            assert r.distinct_shingles == len(a) and r.union_shingles == len(a | b) and abs(r.contained_edited - (len(a & b) / len(a) if a else 1)) < 1e-9


def test_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(fp, "CHUNK_ROWS", 2)
    rng = random.Random(0)
    rows = [(None, "null id one"), (7, ""), (7, "b a"), (7, "b a"), (-5, None), (10**15, "Éa bc d e f g " * 3000), (3, " \n\t "), (2, "日本 é x")]
    rows += [(rng.randrange(50), " ".join(rng.choice("abcdef") for _ in range(rng.randrange(40)))) for _ in range(30)]
    check(spark, rows)
    check(spark, [(1, "only one text of six words")])
    check(spark, [(5, "a b"), (5, "a c")])
    # an id that most rows share, and rows without ids, are cut into many chunks
    check(spark, [(7, f"a{i} b") for i in range(60)] + [(i, f"c{i}") for i in range(12)] + [(None, f"n{i} x") for i in range(50)])
    docs = spark.createDataFrame([(7, f"a{i}") for i in range(200)] + [(None, f"n{i}") for i in range(200)], "doc_id long, text string")
    seen = fp.with_next(docs, "doc_id", ["text"], lambda d: d.withColumn("chunk", F.col("_part")))
    assert seen.groupBy("chunk").count().agg(F.max("count")).first()[0] < 20
    assert fp.compare_neighbours(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimates_and_merging(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(4000)]
    texts = {"whole": base, "half": base[:2000], "other": base[:3000] + [word() for _ in range(1000)], "tail": base[1996:]}
    df = fp.with_sketch(spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k string, text string"), "text", "s")
    s = {r.k: r.s for r in df.collect()}
    wide = spark.createDataFrame([(s["whole"], s["half"], s["other"], s["tail"])], "a array<bigint>, b array<bigint>, c array<bigint>, d array<bigint>")
    a, b, c, d = map(F.col, "abcd")
    got = wide.select(fp.resemblance(a, c), fp.containment(b, a), fp.containment(a, b), fp.distinct_count(a), fp.merged(b, d), fp.resemblance(a, a)).first()
    true = len(plain_shingles(" ".join(texts["whole"])) & plain_shingles(" ".join(texts["other"]))) / len(plain_shingles(" ".join(texts["whole"])) | plain_shingles(" ".join(texts["other"])))
    assert abs(got[0] - true) < 0.13 and abs(got[1] - 1) < 0.25 and abs(got[2] - 0.5) < 0.15 and abs(got[3] / 3996 - 1) < 0.3
    assert got[4] == s["whole"] and got[5] == 1.0
    parts = spark.createDataFrame([("x", s["half"]), ("x", s["tail"]), ("x", s["half"]), ("y", s["other"]), ("z", [])], "g string, s array<bigint>")
    assert {r.g: r.s for r in fp.merge_sketches(parts, "s", "g").collect()} == {"x": s["whole"], "y": s["other"]}


def test_no_python_in_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = fp.compare_neighbours(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
