import unicodedata
import zlib

import numpy as np
import pytest

from vantage.llm import langid


def test_subwords():
    def plain(clean):
        out = []
        for n in langid.NGRAMS:
            for i in range(len(clean) - n + 1):
                g = clean[i : i + n]
                if 32 not in (g if n == 1 else g[1:-1]):
                    h = (2166136261 + n) & 0xFFFFFFFF
                    for x in g:
                        h = ((h ^ x) * 16777619) & 0xFFFFFFFF
                    out.append((h ^ (h >> 15)) % langid.BUCKETS)
        return sorted(out)

    clean = langid.cleaned("Ab é, 12 wörter!")
    assert clean == " ab é wörter ".encode()
    assert sorted(np.concatenate(list(langid.subwords(clean))).tolist()) == plain(clean)
    before, langid._CHUNK = langid._CHUNK, 5
    try:
        assert sorted(np.concatenate(list(langid.subwords(clean))).tolist()) == plain(clean)
    finally:
        langid._CHUNK = before


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("ho", langid.held_out())
    rows = langid.identify(docs).collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.ho]
    assert 100 < len(held) < 300
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) / len(rows) < 0.01


def test_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    rows = [(1, None), (2, ""), (3, "12 -- ?!"), (None, "the of and thing"), (4, "the thing was on " * 20_000), (4, "é"), (5, "½ ² ① Ⅷ ٣ _"), (6, "ʰ")]
    odd = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = {(r.doc_id, (r.text or "")[:3]): r for r in langid.predict(odd, model).collect()}
    for k in ((1, ""), (2, ""), (3, "12 "), (5, "½ ²")):
        assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
    assert got[None, "the"].lang_pred == "en" and got[4, "the"].lang_pred == "en" and not got[4, "the"].rejected
    assert got[4, "é"].lang_pred in model.languages and got[6, "ʰ"].lang_pred in model.languages
    none = langid.fit(docs.limit(0))
    assert langid.predict(odd, none).where("lang_pred <> 'und'").count() == 0
    one = langid.fit(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in langid.predict(odd, one).collect()} == {"de", "und"}


def test_letters_are_category_l():
    for c in map(chr, [*range(0x3000), *range(0x1D400, 0x1D800), 0x2160, 0x3007, 0xFF21, 0x20000]):
        assert bool(langid.cleaned(f"1 {c} 2")) == any(unicodedata.category(x)[0] == "L" for x in c.lower()), hex(ord(c))


def test_every_row_against_plain_forward_pass(spark):
    """Each prediction again: n-grams one by one, embeddings looked up, averaged, softmax, in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("ho", langid.held_out())
    model = langid.fit(docs.where("not ho"))
    rows = langid.predict(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (r.text or "").lower())
        clean = f" {' '.join(text.split())} ".encode()
        if not clean.strip():
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        total, n = np.zeros(len(model.languages)), 0
        for size in (1, 2, 3, 4):
            for i in range(len(clean) - size + 1):
                g = clean[i : i + size]
                if 32 in (g if size == 1 else g[1:-1]):
                    continue
                h = (2166136261 + size) & 0xFFFFFFFF
                for x in g:
                    h = ((h ^ x) * 16777619) & 0xFFFFFFFF
                total += model.table[(h ^ (h >> 15)) % langid.BUCKETS]
                n += 1
        z = (total / n + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.languages[int(p.argmax())]
        assert abs(r.score - p.max()) < 1e-9 and r.rejected == (p.max() < model.least) or abs(p.max() - model.least) < 1e-9
        assert r.ho == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_sample(spark, monkeypatch):
    """Any number of languages; repeated rows count once; a sample that runs over is an error."""
    many = spark.createDataFrame([(i, f"wort{i} abc", f"l{i % 600}") for i in range(3000)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "SAMPLE", 1200)
    got = langid.sample(many).collect()
    assert len({r.lang for r in got}) > 450 and 800 < len(got) < 1600
    monkeypatch.setattr(langid, "BROADCAST_LANGUAGES", 10)
    assert sorted(langid.sample(many).collect()) == sorted(got)
    monkeypatch.setattr(langid, "BROADCAST_LANGUAGES", 10_000)
    same = many.limit(1).crossJoin(spark.range(5000)).drop("id")
    assert len(langid.sample(same.unionByName(many.limit(5))).collect()) <= 6
    monkeypatch.setattr(langid, "SAMPLE", 1)
    monkeypatch.setattr(langid, "sample", lambda docs, n: docs)
    with pytest.raises(ValueError):
        langid.fit(many)
