from pyspark.sql import functions as F

from vantage import model as M
from vantage.functions import text as X
from vantage.operators import link, uses

SERVER = ("backend", "b1", "CreateOrder", "o.go", 3, "http_request", "http", "server", "POST /api/v1/orders", ["/api/v1/orders", "orders"])
CLIENT = ("frontend", "f1", "fetchOrders", "api.js", 9, "http_request", "http", "client", "GET /api/v1/orders", ["/api/v1/orders"])
LINKS = [("frontend", "backend", "http")]


def setup(spark, line, server=SERVER, links=LINKS):
    eps = spark.createDataFrame([server, CLIENT], M.ENDPOINTS)
    lines = spark.createDataFrame([("frontend", "a/api.js", 4, line), ("backend", "b/o.go", 1, "router('/api/v1/orders')")], M.LINES)
    return spark.createDataFrame(links, M.LINKS), eps, lines


def test_patterns(spark):
    df = spark.createDataFrame([("POST /api/v1/orders/{id}/", ["a", "/x/y", ""], "http"), ("ns::f.g", [], "ffi"), ("", [], "http"), ("q", [], "ssh")], "s string, a array<string>, t string")
    got = [r[0] for r in df.select(X.build_patterns(F.col("s"), F.col("a"), F.col("t"))).collect()]
    assert got == [["POST /api/v1/orders/{id}/", "/api/v1/orders/{id}/", "a", "/x/y"], ["ns::f.g", "f.g", "g"], [], ["q"]]


def test_forward_and_reverse(spark):
    links, eps, lines = setup(spark, "fetch('/api/v1/orders');")
    fwd = link.forward_links(links, eps, lines).collect()
    assert {(r.server_node_id, r.client_file, r.client_line, r.match_kind) for r in fwd} >= {("b1", "a/api.js", 4, "normalized")}
    rev = link.reverse_links(links, eps, lines).collect()
    assert {(r.server_node_id, r.client_file, r.client_line, r.direction) for r in rev} == {("b1", "api.js", 9, "reverse")}
    links, eps, lines = setup(spark, "fetch('/other/path');")
    assert link.forward_links(links, eps, lines).count() == 0


def test_auto(spark):
    _, eps, lines = setup(spark, "fetch('/api/v1/orders');")
    repos = spark.createDataFrame([("backend",), ("frontend",)], "name string")
    got = link.auto_links(repos, eps, lines, bidirectional=False).collect()
    assert len(got) == 1 and got[0].link_type == "http"
    mail = (*SERVER[:6], "email", "server", "sendmail", [])
    _, eps, lines = setup(spark, "sendmail('user@example.com');", mail)
    assert [r.link_type for r in link.auto_links(repos, eps, lines, False).collect()] == ["email"]


def test_authoritative(spark):
    links, eps, _ = setup(spark, "")
    got = link.authoritative_links(links, eps).collect()
    assert [(r.server_node_id, r.client_node_id, r.confidence) for r in got] == [("b1", "f1", "high")]
    assert [(r.server_node_id, r.client_node_id) for r in link.authoritative_links(links, eps.limit(0)).collect()] == [("", "")]


def test_many_patterns_give_the_same(spark, monkeypatch):
    lines = spark.createDataFrame([("r", "f", i, t) for i, t in enumerate(["The cat /api/v1", "of ab", "xABy", "a", "", "é la b", "über la"])], M.LINES)
    pats = spark.createDataFrame([("r", p) for p in ("cat", "/api", "ab", "a", "la", "THE CAT", "é", "über")], "repo string, pattern string")
    few = {tuple(r) for r in link.containing(lines, pats).collect()}
    monkeypatch.setattr(link, "BROADCAST_PATTERNS", 1)
    assert {tuple(r) for r in link.containing(lines, pats).collect()} == few and len(few) > 8


def test_compatibility():
    assert "reverse-proxy" in M.compatible_types("http") and "rpc" in M.compatible_types("grpc") and M.compatible_types("none") == ()
    assert len(M.PROTOCOLS) == 48 and len(M.PROTOCOL_TO_LINK_TYPE) == 54 and set(M.LINK_TYPE_TO_PROTOCOL.values()) <= set(M.PROTOCOLS) and set(M.LINK_TYPE_TO_PROTOCOL) == set(M.LINK_TYPES)
    assert [len(M.api_rules(x)) for x in ("python", "cpp", "go", "java", "typescript", "c_sharp", "c", "x")] == [35, 24, 25, 23, 19, 20, 24, 0]


def _mixed(spark):
    """Equal and repeated endpoints, two kinds, short patterns, many hits in a file, client places that forward hits share."""
    urls = ["/api/v1/orders", "/the", "/api", "/x/abc", "GET /abc"]
    eps = [(f"r{i % 3}", f"n{i % 17:02d}", f"fn{i}", f"f{i % 7}", i % 4, "http_request", ("http", "grpc")[i % 2], ("server", "client", "both")[i % 5 % 3], urls[i % 5], [urls[(i + 1) % 5]] if i % 3 else []) for i in range(40)]
    text = ["see the API", "fetch('/api/v1/orders')", " xthe abc", "/x/ABC the", "", "/the"]
    lines = [(f"r{r}", f"f{f}", i, text[(i + f + r) % 6]) for r in range(3) for f in range(7) for i in range(120 if f == 3 else 9)]
    links = spark.createDataFrame([(f"r{a}", f"r{b}", t) for a in range(3) for b in range(3) if a != b for t in ("http", "rpc")], M.LINKS)
    return links, spark.createDataFrame(eps, M.ENDPOINTS), spark.createDataFrame(lines, M.LINES)


def _same_sums(got, candidates):
    keys = ["from_repo", "to_repo", "link_type", "match_kind", "server_node_id"]
    want = candidates.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("client_file").alias("files"), F.min("client_snippet").alias("snippet"))
    rows = sorted(tuple(r) for r in got.select(want.columns).collect())
    assert rows == sorted(tuple(r) for r in want.collect()) and len(rows) > 10


def test_forward_sums_need_no_candidates(spark, monkeypatch):
    links, eps, lines = _mixed(spark)
    want = link.forward_links(links, eps, lines)
    monkeypatch.setattr(uses, "PATTERNS", 4)
    _same_sums(uses.forward_sums(links, eps, lines), want)


def test_reverse_sums_need_no_candidates(spark, monkeypatch):
    links, eps, lines = _mixed(spark)
    want = link.reverse_links(links, eps, lines)
    monkeypatch.setattr(uses, "PATTERNS", 4)
    _same_sums(uses.reverse_sums(links, eps, lines), want)


def test_auto_sums_need_no_candidates(spark):
    _, eps, lines = _mixed(spark)
    repos = spark.createDataFrame([(f"r{i}",) for i in range(3)], "name string")
    _same_sums(uses.auto_sums(repos, eps, lines), link.auto_links(repos, eps, lines))


def test_authoritative_tests_signatures_once(spark):
    """Classes give the rows that a test of every pair gives; links without any keep one."""
    links, eps, _ = _mixed(spark)
    links = links.unionByName(spark.createDataFrame([("r0", "r9", "http")], M.LINKS))
    s, c = ({(r.repo, r.link_type, r.node_id, r.function_name): r for r in link.endpoints_for(eps, x).collect()} for x in ("server", "client"))
    over = lambda p, r: any(z and (p.lower() in z.lower() or z.lower() in p.lower()) for z in (r.signature, *r.signature_aliases))
    want = []
    for k in links.collect():
        hits = [(k.from_repo, k.to_repo, k.type, a.function_name, b.function_name) for a in s.values() for b in c.values() if (a.repo, a.link_type, b.repo, b.link_type) == (k.to_repo, k.type, k.from_repo, k.type) and (over(a.signature, b) or over(b.signature, a))]
        want += hits or [(k.from_repo, k.to_repo, k.type, "", "")]
    got = link.authoritative_links(links, eps)
    assert sorted((r.from_repo, r.to_repo, r.link_type, r.server_function_name, r.client_function_name) for r in got.collect()) == sorted(want) and len(want) > 50


def test_overlapping_pairs(spark):
    _, eps, _ = _mixed(spark)
    rows, want = eps.collect(), {}
    for a in rows:
        for b in rows:
            p = a.signature.lower()
            if (a.repo, a.interface_kind) == (b.repo, b.interface_kind) and a.node_id < b.node_id and any(z and (p in z.lower() or z.lower() in p) for z in (b.signature, *b.signature_aliases)):
                want[a.repo, a.interface_kind] = want.get((a.repo, a.interface_kind), 0) + 1
    assert {(r.repo, r.interface_kind): r.pairs for r in link.overlapping_pairs(eps).collect()} == want
