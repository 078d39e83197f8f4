import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from vantage.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if counts[i] * 2 > len(shingles))


def plain_components(fps, distance=3):
    """fps: (doc_id, fingerprint) pairs."""
    parent = {f: f for _, f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = sorted(parent)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for d, f in fps:
        least[root(f)] = min(d, least.get(root(f), d))
    return {d: least[root(f)] for d, f in fps}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\nAbcÉß日0.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_of_random_prints(spark, monkeypatch):
    rng = random.Random(3)
    fps = []
    for _ in range(60):
        centre = rng.getrandbits(64)
        fps.append(centre)
        for _ in range(rng.choice([0, 1, 2, 8])):
            near = fps[-1]
            for _ in range(rng.randint(1, 4)):
                near ^= 1 << rng.randrange(64)
            fps.append(near)
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << i) for i in range(64)] + [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = plain_components(list(enumerate(fps)))
    for run in (2048, 8):  # 8: hot keys are cut twice
        monkeypatch.setattr(simhash, "RUN", run)
        docs = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
        monkeypatch.setattr(simhash, "with_fingerprints", lambda d, *a: d)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
        assert got == want


def test_edge_cases(spark):
    rows = [(3, "a b c d", 1), (2, "A B c\td", 2), (5, "", 0), (4, None, 0), (7, " \n", 0), (None, "x y z", 1), (9, "word " * 40_000, 1), (2, "A B c\td", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumnRenamed("fp", "component_id")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(rows)
    by = {g[0]: g for g in got}
    assert by[3][2] == by[2][2] == 2 and by[4][2] == by[5][2] == by[7][2] == 4
    assert by[4][1] == "0" * 16 and by[9][2] == 9 and by[None][2] is None
    assert by[3][1] == f"{plain_fingerprint('a b c d'):016x}"
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    want = plain_components(prints)
    assert got == {d: (f"{f:016x}", want[d]) for d, f in prints}
