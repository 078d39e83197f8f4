import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vantage.llm import mixing
from vantage.llm.tokens import default_tokenizer


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 5), st.integers(2, 4), st.integers(0, 99))
def test_rake_meets_margins(a, b, seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(1, 100, a * b).astype(float)
    codes = [np.repeat(np.arange(a), b), np.tile(np.arange(b), a)]
    shares = [rng.dirichlet(np.ones(a)), rng.dirichlet(np.ones(b))]
    w = mixing.rake(tokens, codes, shares, 5000)
    for code, share in zip(codes, shares, strict=True):
        assert np.allclose(np.bincount(code, w * tokens) / tokens.sum(), share, atol=1e-6)
    # the fitted table keeps every odds ratio
    m = (w * tokens).reshape(a, b)
    t = tokens.reshape(a, b)
    if (m > 1e-9).all():
        assert np.allclose(np.log(m[0, 0] * m[1, 1] / (m[0, 1] * m[1, 0])), np.log(t[0, 0] * t[1, 1] / (t[0, 1] * t[1, 0])), atol=1e-3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.floats(0, 10)), min_size=1, max_size=20).filter(lambda x: sum(n for n, _ in x)), st.floats(0.05, 1))
def test_calibrate(cells, keep):
    n, w = np.array([c[0] for c in cells], float), np.array([0 if c[1] < 1e-3 else c[1] for c in cells])
    p = mixing.calibrate(n, w, keep)
    assert (p >= 0).all() and (p <= 1 + 1e-12).all() and (p[w == 0] == 0).all()
    assert np.isclose((p * n).sum(), min(keep * n.sum(), n[w > 0].sum()), rtol=1e-6)
    part = (p > 0) & (p < 1)
    if part.sum() > 1:
        assert np.allclose(p[part] / w[part], (p[part] / w[part])[0])


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.weigh(docs).collect()
    assert len(rows) == 1000
    library = Tokenizer.from_file(default_tokenizer())
    tokens = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert all(r.n_tokens == tokens[r.doc_id] for r in rows)
    total = sum(r.n_tokens for r in rows)
    for m in ("source", "lang", "topic"):
        seen, raked = {}, {}
        for r in rows:
            seen[r[m]] = seen.get(r[m], 0) + r.n_tokens
            raked[r[m]] = raked.get(r[m], 0) + r.n_tokens * r.weight / total
        want = mixing.target_shares(seen, None)
        assert raked == pytest.approx(want, abs=1e-4)
    assert sum(r.p * r.n_tokens for r in rows) / total == pytest.approx(mixing.KEEP)
    assert abs(sum(r.n_tokens for r in rows if r.kept) / total - mixing.KEEP) < 0.06


def test_driver_and_table_agree(spark, monkeypatch):
    rows = [(i, " w" * (i % 7), f"s{i % 3}", "en" if i % 2 else None, "x" if i % 5 else "y") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = {"lang": {"en": 0.3, "xx": 0.2}, "topic": {"x": 0.5, "y": 0.5}}
    monkeypatch.setattr(mixing, "CLOSE", 1e-6)
    a = {r.doc_id: (r.weight, r.p, r.kept) for r in mixing.weigh(docs, targets).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 1)
    b = {r.doc_id: (r.weight, r.p, r.kept) for r in mixing.weigh(docs, targets).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][:2] == pytest.approx(b[k][:2], abs=1e-3)
    assert len(a) == 60


def test_edge_cases(spark):
    rows = [(None, None, None, None), (1, "", "s", "en"), (1, "", "s", "en"), (2, "word " * 30_000, "s", None), (3, "a !! b", None, "en")]
    docs = spark.createDataFrame([(*r, 0.0, "k") for r in rows], "doc_id long, text string, source string, lang string, weight double, kept string")
    got = mixing.weigh(docs).collect()
    assert len(got) == 5 and all(r.kept is not None and 0 <= r.p <= 1 for r in got)
    assert sorted(r.n_tokens for r in got) == [0, 0, 0, 3, 30_001]
    assert mixing.weigh(docs.limit(0)).collect() == []
    assert all(r.kept for r in mixing.weigh(docs.where("doc_id = 1")).collect())


def _blocks(spark):
    """Sources of nearly one language each: margins pull against one another, so raking takes many rounds."""
    rows = [(i, " w" * n, f"s{s}", f"l{l}", "x") for i, (s, l, n) in enumerate((s, l, 97 if s == l else 3) for s in range(2) for l in range(2))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string"), {"source": {"s0": 0.5, "s1": 0.5}, "lang": {"l0": 0.53, "l1": 0.47}}


def test_both_paths_rake_as_long(spark, monkeypatch):
    docs, targets = _blocks(spark)
    monkeypatch.setattr(mixing, "CLOSE", 1e-5)
    a = {r.doc_id: (r.weight, r.p, r.kept) for r in mixing.weigh(docs, targets).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 1)
    rows = mixing.weigh(docs, targets).collect()
    assert {r.doc_id for r in rows} == set(a)
    for r in rows:
        assert (r.weight, r.p) == pytest.approx(a[r.doc_id][:2], abs=1e-9)
    total = sum(r.n_tokens for r in rows)
    for m, shares in targets.items():
        for k, share in shares.items():
            assert sum(r.n_tokens * r.weight for r in rows if r[m] == k) / total == pytest.approx(share, abs=1e-5)


def test_unmet_margins_are_reported(spark, monkeypatch):
    docs, targets = _blocks(spark)
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    with pytest.warns(UserWarning, match="after 2 rounds"):
        a = {r.doc_id: (r.weight, r.p) for r in mixing.weigh(docs, targets).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 1)
    with pytest.warns(UserWarning, match="after 2 rounds"):
        b = {r.doc_id: (r.weight, r.p) for r in mixing.weigh(docs, targets).collect()}
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_table_scale_with_tiny_weights(spark, monkeypatch):
    """Weights many orders apart don't blur the scale of the probabilities."""
    rows = [(i, " w" * 50, f"s{i}", "en", "x") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = {"source": {"s0": 1e-30, "s1": 0.2, "s2": 0.3, "s3": 0.5}}
    a = {r.doc_id: r.p for r in mixing.weigh(docs, targets, 0.5).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 1)
    b = {r.doc_id: r.p for r in mixing.weigh(docs, targets, 0.5).collect()}
    assert a == pytest.approx(b, abs=1e-9) and sum(a.values()) == pytest.approx(2)


def test_every_row_against_brute_force(spark):
    """Tokens, topics, weights, probabilities and draws again, in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in mixing.weigh(docs).collect()}
    model, library = mixing.fit_topics(docs), Tokenizer.from_file(default_tokenizer())
    rows = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        counts = [0.0] * mixing.FEATURES
        for i in ids:
            counts[i % mixing.FEATURES] += 1
        x = np.log1p(np.array(counts)) * model.rarity
        near = [float(c @ x) for c in model.centres]
        topic = f"topic-{near.index(max(near))}" if ids else None
        if ids and sorted(near)[-1] - sorted(near)[-2] < 1e-4:
            topic = got[r.doc_id].topic  # too close to call in single precision
        rows.append((r.doc_id, r.text, (r.source, r.lang, topic), len(ids)))
    cells = {}
    for _, _, cell, n in rows:
        cells[cell] = cells.get(cell, 0) + n
    total = sum(cells.values())
    now = {c: n / total for c, n in cells.items()}
    wanted = []
    for m in range(3):
        sums = {}
        for c, n in cells.items():
            sums[c[m]] = sums.get(c[m], 0) + n / total
        raised = {k: v**mixing.LEVELLING for k, v in sums.items()}
        wanted.append({k: v / sum(raised.values()) for k, v in raised.items()})
    for _ in range(mixing.ROUNDS):
        worst = 0
        for m, shares in enumerate(wanted):
            sums = {}
            for c, v in now.items():
                sums[c[m]] = sums.get(c[m], 0) + v
            worst = max(worst, *(abs(sums[k] - shares[k]) for k in sums))
            now = {c: v * shares[c[m]] / sums[c[m]] for c, v in now.items()}
        if worst < mixing.CLOSE:
            break
    weight = {c: now[c] * total / cells[c] for c in cells if cells[c]}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1, mid * weight[c]) * cells[c] for c in weight) < mixing.KEEP * total else (low, mid)
    for d, text, cell, n in rows:
        r = got[d]
        assert (r.source, r.lang, r.topic) == cell and r.n_tokens == n
        p = min(1, low * weight[cell]) if cells[cell] else 1.0
        assert r.p == pytest.approx(p, abs=1e-6)
        h = xxhash.xxh64_intdigest(mixing.KEY.encode(), 42)
        h = xxhash.xxh64_intdigest(int(d).to_bytes(8, "little", signed=True), h) if d is not None else h
        h = xxhash.xxh64_intdigest(text.encode(), h) if text is not None else h
        u = (h - (1 << 64) if h >> 63 else h) % (1 << 52) / (1 << 52)
        assert r.kept == (u < r.p)
    assert len({r.topic for r in got.values()}) > 3


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "s", "en", "a", "b", 1.0, "d"), (None, "three", "s", "en", "a", "b", 1.0, "d")], "doc_id long, text string, source string, lang string, _tokens string, _source string, u double, c0 string")
    got = mixing.weigh(docs).collect()
    assert len(got) == 2 and all((r._tokens, r._source, r.c0) == ("a", "b", "d") and 0 <= r.p <= 1 for r in got)
    assert "text" not in mixing.weigh(docs, with_text=False).columns


def test_topics_come_from_all_documents(spark, monkeypatch):
    """Rarities count every document and each centre is the mean direction of all its documents, however few start it."""
    rng = np.random.default_rng(5)
    words = [[f"{'abcdefgh'[g]}{w}x" for w in range(30)] for g in range(4)]
    rows = [(i, " ".join(rng.choice(words[i % 4], 25))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(mixing, "SAMPLE", 30)
    monkeypatch.setattr(mixing, "SUMS", 2)
    monkeypatch.setattr(mixing, "STILL", 1e-9)
    model, library = mixing.fit_topics(docs.repartition(7)), Tokenizer.from_file(default_tokenizer())
    x = np.array([mixing.frequencies(np.array(library.encode(t, add_special_tokens=False).ids)) for _, t in rows])
    assert model.rarity == pytest.approx(np.log(401 / (1 + (x > 0).sum(axis=0))) + 1e-3, abs=1e-5)
    y = x * model.rarity
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    at = (y @ model.centres.T).argmax(axis=1)
    assert len(model.centres) == mixing.TOPICS
    for k, c in enumerate(model.centres):
        total = y[at == k].sum(axis=0)
        assert c == pytest.approx(total / np.linalg.norm(total), abs=1e-3)


def _rests(model, x):
    """Every centre is the mean direction of just the rows that it is nearest to, and every centre has rows."""
    assert np.allclose(model.rarity, np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1e-3, atol=1e-5)
    y = x * model.rarity
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    at = (y @ model.centres.T).argmax(axis=1)
    for k, c in enumerate(model.centres):
        total = y[at == k].sum(axis=0)
        assert c == pytest.approx(total / np.linalg.norm(total), abs=1e-6)
    return at


def _described(docs):
    library = Tokenizer.from_file(default_tokenizer())
    ids = [library.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()]
    return np.array([mixing.frequencies(np.array(i)) for i in ids if i])


def test_rounds_go_on_until_centres_rest(spark, monkeypatch):
    """No number of rounds and no small turn of a centre ends them, wherever they start and whichever rows are left out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    monkeypatch.setattr(mixing, "SAMPLE", 12)
    apart, gaps = mixing._apart, []
    monkeypatch.setattr(mixing, "_apart", lambda *a: gaps.append(a[2]) or apart(*a))
    model, x = mixing.fit_topics(docs), _described(docs)
    assert len(set(_rests(model, x))) == mixing.TOPICS and gaps
    monkeypatch.setattr(mixing, "WIDEST", 0.0)  # every round goes over all rows
    whole = mixing.fit_topics(docs)
    assert whole.centres == pytest.approx(model.centres, abs=1e-6)


def test_copies_leave_other_texts_their_topics(spark):
    """A text with very many copies takes no other text's place where the centres start."""
    texts = ["one and the same"] * 20_000 + [f"{w} {w}s" for w in ("ash", "birch", "cedar", "date", "elm", "fig", "gum")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    x = _described(docs.select("text").distinct())
    for table in (docs, docs.selectExpr("0L AS doc_id", "text")):
        y, at, _ = mixing._nearest(x, mixing.fit_topics(table))
        assert len(set(at)) == len(x) == mixing.TOPICS


def test_empty_topics_start_again(spark, monkeypatch):
    """Where the first texts all look alike, topics come to the documents that don't."""
    words = ["ash", "birch", "cedar", "date", "elm", "fig", "gum"]
    docs = spark.createDataFrame([(i, "same words" + " again" * i) for i in range(1, 300)] + [(-i, f"{w} {w}s") for i, w in enumerate(words)], "doc_id long, text string")
    monkeypatch.setattr(mixing, "SAMPLE", 9)
    model = mixing.fit_topics(docs)
    assert len(set(_rests(model, _described(docs)))) == mixing.TOPICS


def test_few_rows_are_gone_over_and_set_apart(spark, monkeypatch):
    """Rounds go over parts of the texts first, and rows are only set apart where they are few of those gone over."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").cache()
    n, batches, apart, gone, shares = docs.count(), mixing.map_batches, mixing._apart, [], []

    def counted(df, *more):
        if df.columns == ["x"]:
            gone.append(df.count())
        return batches(df, *more)

    def shared(known, *more):
        got = apart(known, *more)
        shares.append(got[0].where("x is not null").count() / known.count())
        return got

    monkeypatch.setattr(mixing, "map_batches", counted)
    monkeypatch.setattr(mixing, "_apart", shared)
    monkeypatch.setattr(mixing, "SAMPLE", 400)
    model = mixing.fit_topics(docs)
    _rests(model, _described(docs))
    assert shares and max(shares) < 0.6
    assert sum(gone) < 12 * n
