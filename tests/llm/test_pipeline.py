"""Each stage of the pipeline, on its own input, against a brute-force version."""

import sys
import zlib
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline
from test_packing import holds
from test_simhash import plain_components, plain_fingerprint

from vantage.llm import langid, mixing, pii, simhash
from vantage.llm.tokens import default_tokenizer

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12 34 -- !!", "en", "s", 11), (9002, None, None, None, None), (9003, "mail me at jo.12@corp.example.org or 10.1.2.3 please now", "en", "s", 54)], docs.schema)
    state = docs.unionByName(extra)
    columns = state.columns
    states = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, state, SF)
        if name != "packing":
            assert out.columns == columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        states[name] = (by_id(state), out)
        state = out

    before, after = states["language"][0], by_id(states["language"][1])
    gone = set(before) - set(after)
    assert {9001, 9002} <= gone
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    assert gone == {d for d, r in before.items() if model.predict(r.text)[2]} and len(gone) < 6

    before, after = states["near_dedup"][0], by_id(states["near_dedup"][1])
    found = plain_components([(d, plain_fingerprint(r.text)) for d, r in before.items()])
    assert set(after) == set(found.values()) and len(after) < len(before)
    assert all(after[d] == before[d] for d in after)

    before, after = states["surrogates"][0], by_id(states["surrogates"][1])
    assert set(before) == set(after)
    originals = {v for r in before.values() for _, _, _, v in pii.detect(r.text)}
    assert originals
    for d, r in before.items():
        spans = pii.detect(r.text)
        assert (after[d].text == r.text) == (not spans)
        assert not originals & {v for _, _, k, v in pii.detect(after[d].text)}
        assert after[d].n_chars == (len(after[d].text) if spans else r.n_chars)

    before, after = states["mixing"][0], by_id(states["mixing"][1])
    weighed = by_id(mixing.weigh(spark.createDataFrame(list(before.values()), docs.schema)))
    assert set(after) == {d for d, r in weighed.items() if r.kept} and 0.5 < len(after) / len(before) < 1

    before, rows = states["packing"][0], states["packing"][1].collect()
    e, want = Tokenizer.from_file(default_tokenizer()), {}
    for d, r in before.items():
        ids = np.array([*e.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        want[d] = (len(ids), zlib.crc32(ids.tobytes()))
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {d: n for d, (n, _) in want.items()}
    assert all(r.ids_crc32 == want[r.doc_id][1] for r in rows if r.length == want[r.doc_id][0])
    assert holds([(r.sequence_id, r.offset, r.length) for r in rows], 2048) <= -(-sum(got.values()) // 2048) + 1


def test_run(spark):
    rows = pipeline.run(spark, SF).collect()
    assert len(rows) > 50 and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_repeated_ids(spark):
    """Unlike texts stay whatever ids they share or lack."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(5, text, "en", "s", 1), (5, text, "en", "s", 1), (5, "quite another text that shares nothing", "en", "s", 1), (7, text, "en", "s", 1), (None, "null id here", "en", "s", 1)], schema)
    got = pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("5", text), ("5", "quite another text that shares nothing"), ("None", "null id here")])
    assert pipeline.near_dedup(spark, docs.limit(0), SF).collect() == []
    clash = docs.withColumnsRenamed({"lang": "_row", "source": "_FP"})
    assert len(simhash.survivors(clash).collect()) == 3 and simhash.survivors(clash).columns == clash.columns


def test_survivors_by_component(spark):
    """Null and repeated ids: rows are told apart by their component, not by their id."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(12)) for w in ("ash", "birch", "cedar", "date"))

    def kept(*rows):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
        return sorted(((r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, SF).collect()), key=str)

    # unrelated texts without an id all stay, once each; a copy of a text with an id goes
    assert kept((None, a), (None, b), (None, b), (None, c), (1, c), (2, d)) == sorted([(None, a), (None, b), (1, c), (2, d)], key=str)
    # one component without ids: the other rows without an id are not kept for it
    assert kept((None, a), (None, c), (1, c)) == sorted([(None, a), (1, c)], key=str)
    # 5 is the least id of b alone: the row of a that has it is a copy of 3
    assert kept((3, a), (5, a), (5, b)) == [(3, a), (5, b)]


def test_mixing_learns_from_every_document(spark, monkeypatch):
    """The stage's topics have the rarities of all its documents, however few of them start the centres."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(mixing, "SAMPLE", 20)
    fit, models = mixing._fitted, []
    monkeypatch.setattr(mixing, "_fitted", lambda *a: models.append(fit(*a)) or models[-1])
    pipeline.mixing(spark, docs, SF)
    e = Tokenizer.from_file(default_tokenizer())
    ids = [e.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()]
    x = np.array([mixing.frequencies(np.array(i)) for i in ids if i])
    assert np.allclose(models[0].rarity, np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1e-3, atol=1e-5)
