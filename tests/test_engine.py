"""Python sources to entry points, links, reachability, files and incremental reuse."""

import json
import os

import pytest
from pyspark.sql import functions as F

from vantage import cli, port
from vantage import model as M
from vantage.operators import extract, incremental, interfaces, modules, resolve
from vantage.plans import engine
from vantage.sinks import render
from vantage.sources import config as C
from vantage.sources import files, parse
from vantage.sources import versions as V
from vantage.streaming import incremental as streaming

APP = '''
import json, os


def read_settings(path):
    with open(path) as f:
        return json.load(f)


def environment():
    return os.getenv("HOME")


def ask(prompt):
    return input(prompt)


def double(x):
    return x * 2


def serve(request):
    """Answers "/api/v1/orders"."""
    return double(request.get("n"))


def main():
    ask("?")
'''
CLIENT = '''
def fetch_orders(session):
    return session.get("/api/v1/orders")
'''


@pytest.fixture
def project(tmp_path):
    for name, text in (("backend", APP), ("frontend", CLIENT)):
        (tmp_path / name / "src" / "core").mkdir(parents=True)
        (tmp_path / name / "src" / "core" / "app.py").write_text(text)
        (tmp_path / name / "src" / "core" / "test_app.py").write_text("def t(x):\n    return input(x)\n")
        (tmp_path / name / "node_modules").mkdir()
        (tmp_path / name / "node_modules" / "x.py").write_text("def y(z): return input(z)\n")
    (tmp_path / "project.json").write_text(json.dumps({"project": "shop", "repos": [{"name": n, "path": n, "language": "py"} for n in ("backend", "frontend")], "links": [{"from": "frontend", "to": "backend", "type": "http"}]}))
    return tmp_path


def graph_of(spark, root, name):
    lines = files.read_lines(spark, str(root / name), name, "python")
    text = lines.groupBy("repo", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return (*parse.parse(text), lines)


def test_scan(spark, project):
    nodes, edges, lines = graph_of(spark, project, "backend")
    assert {r.file.rsplit("/", 1)[-1] for r in lines.select("file").distinct().collect()} == {"app.py"}
    found = {r.function_name: r for r in engine.scan(nodes, edges, lines, spark.createDataFrame([("backend", "python")], "repo string, language string")).collect()}
    assert set(found) == {"read_settings", "environment", "ask", "serve", "main"}
    assert found["main"].is_root_function and found["serve"].descriptor.signature == "/api/v1/orders"
    assert found["environment"].entry_point_type == "environment_variable" and not found["environment"].is_root_function
    assert not found["ask"].is_root_function  # main calls it


def test_project_end_to_end(spark, project):
    cfg = C.load_project(str(project / "project.json"))
    parts = [graph_of(spark, project, r.name) for r in cfg.repos]
    nodes, edges, lines = (a.unionByName(b) for a, b in zip(*parts, strict=True))
    r = engine.analyse(cfg, nodes, edges, lines)
    links = r.links.collect()
    assert {(x.from_repo, x.to_repo, x.link_type) for x in links} == {("frontend", "backend", "http")}
    assert any(x.client_function_name == "fetch_orders" for x in links)
    out = engine.save(r, str(project / "out"), "both")
    assert {"backend", "frontend", "cross_edges", "model", "cert", "svg"} <= set(out)
    model = json.loads(open(out["model"]).read())
    assert model["links"][0]["edges"] and model["repos"][0]["sources"][0]["name"] == "core"
    assert "<svg" in open(out["svg"]).read() and json.loads(open(out["cert"]).read())["class"] == "GraphLinksModel"
    again = V.load_checkpoints(spark, {x.name: V.checkpoint_path(str(project / "out"), x.name) for x in cfg.repos})
    assert again.count() == r.entries.count()
    with pytest.raises(FileNotFoundError):
        V.load_checkpoints(spark, {"x": "/nowhere/x.json"})


def test_commands(spark, project):
    out = str(project / "scan")
    cli.main(["scan", "--project-path", str(project / "backend"), "--output-dir", out, "--html-report", "--graph", "--graph-format", "both"])
    assert json.loads(open(f"{out}/entry_points.json").read())["total_entry_points"] == 5
    html = open(f"{out}/entry_points_report.html").read()
    assert "read_settings" in html and "<html" in html
    cli.main(["graph-from-json", "--entrypoints-json", f"{out}/entry_points.json", "--output-dir", f"{out}/g", "--graph-format", "cert"])
    drawn = json.loads(open(f"{out}/g/exposure.json").read())
    assert {n["name"] for n in drawn["nodeDataArray"] if "name" in n} >= {"core", "EXT_FILE", "EXT_INPUT"}
    cli.main(["call-graph", "--project-path", str(project / "backend"), "--output-dir", out, "--filter-by-exposure", "--format", "cert"])
    assert json.loads(open(f"{out}/call_graph_stats.json").read())["functions"] == 6
    cli.main(["export-threagile", "--config", str(project / "project.json"), "--output", f"{out}/a.yaml"])
    cli.main(["render-threagile", "--config", f"{out}/a.yaml", "--output-dir", f"{out}/t"])
    assert os.path.exists(f"{out}/t/project_topology.svg") and os.path.exists(f"{out}/t/project_topology.json")


def test_configuration_errors(project):
    good = json.loads((project / "project.json").read_text())

    def bad(**change):
        (project / "bad.json").write_text(json.dumps({**good, **change}))
        with pytest.raises(C.ConfigError):
            C.load_project(str(project / "bad.json"))

    repo = good["repos"][0]
    bad(project=" ")
    bad(repos=[])
    bad(repos=[repo, repo])
    bad(repos=[{**repo, "path": "nowhere"}])
    bad(repos=[{**repo, "modules": ["nowhere"]}])
    bad(links=[{"from": "x", "to": "backend", "type": "http"}])
    bad(links=[{"from": "backend", "to": "backend", "type": "http"}])
    bad(links=[{"from": "frontend", "to": "backend", "type": "pigeon"}])


def test_violations(spark):
    repos = spark.createDataFrame([("a", "p", "py"), ("a", "p", "py"), ("b", "", "py")], "name string, path string, language string")
    links = spark.createDataFrame([("a", "z", "http"), ("b", "b", "pigeon")], "from_repo string, to_repo string, type string")
    assert {tuple(r) for r in C.violations(repos, links).collect()} == {("repeated_name", "a"), ("missing_field", "b"), ("unknown_repository", "z"), ("self_link", "b"), ("unknown_type", "pigeon")}


def test_architecture(tmp_path):
    p = C.Project("shop", [C.Repo("a", "/a", "c_sharp", "", ["m"]), C.Repo("b", "/b", "go", "api")], [C.Link("a", "b", "grpc")])
    path = C.save_architecture(p, str(tmp_path / "x.yaml"))
    back = C.load_architecture(path)
    assert back.project == "shop" and back.links_authoritative and [r.language for r in back.repos] == ["c_sharp", "go"] and back.repos[0].modules == ["m"]
    assert [(x.from_repo, x.to_repo, x.type) for x in back.links] == [("a", "b", "http")]  # grpc goes over https
    C.add_flows(path, [("a", "b", "http"), ("b", "a", "ssh"), ("b", "a", "ssh")])
    assert [x.type for x in C.load_architecture(path).links] == ["http", "ssh"]


def test_discovery(tmp_path):
    for rel in ("core/.git", "core/sub/.git", "group/service/.git", "docs", "plain"):
        (tmp_path / rel).mkdir(parents=True)
    (tmp_path / "core" / "go.mod").write_text("")
    (tmp_path / "group" / "service" / "a.py").write_text("")
    (tmp_path / "plain" / "b.py").write_text("")
    assert [(r.name, r.language, r.modules) for r in C.discover(str(tmp_path), True, 3)] == [("core", "go", ["sub"]), ("service", "python", [])]
    assert [r.name for r in C.discover(str(tmp_path), True, 1)] == ["core"]
    assert [r.name for r in C.discover(str(tmp_path), False)] == ["core", "group", "plain"]
    assert C.language_of(["tsconfig.json", "package.json"]) == "typescript" and C.language_of(["x.csproj"]) == "c_sharp" and C.language_of(["a.h", "b.cpp", "c.py"]) == "cpp" and C.language_of([]) == ""
    with pytest.raises(C.ConfigError):
        C.auto_project(str(tmp_path / "docs"))
    (tmp_path / "core" / "sub" / "deep").mkdir()
    (tmp_path / "core" / "sub" / "deep" / ".git").write_text("gitdir: ../x")
    (tmp_path / "core" / "node_modules" / "x" / ".git").mkdir(parents=True)
    assert C.discover(str(tmp_path), True, 2)[0].modules == ["sub", "sub/deep"] and C.discover(str(tmp_path), True, 1)[0].modules == ["sub"]
    (tmp_path / ".git").mkdir()
    whole = C.discover(str(tmp_path), True, 3)
    assert [(r.name, r.path, r.modules) for r in whole] == [(tmp_path.name, str(tmp_path), ["core", "core/sub", "core/sub/deep", "group/service"])]


def test_versions(tmp_path, spark):
    git = tmp_path / "r" / ".git"
    git.mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text("# x\nabc1234 refs/heads/main\n")
    assert V.version(str(tmp_path / "r")) == "abc1234"
    (git / "refs" / "heads").mkdir(parents=True)
    (git / "refs" / "heads" / "main").write_text("def5678\n")
    assert V.commit(str(tmp_path / "r")) == "def5678"
    (git / "HEAD").write_text("short")
    assert V.commit(str(tmp_path / "r")) is None
    assert V.version(str(tmp_path / "none")) == "no-files"
    listed = spark.createDataFrame([("r", "b.py", 2), ("r", "a.py", 1)], "repo string, rel string, size long")
    assert incremental.listing_hash(listed, "repo").first().version == V.listing_digest([("a.py", 1), ("b.py", 2)])
    hashed = incremental.links_hash(spark.createDataFrame([("b", "2"), ("a", "1")], "repo string, version string")).first()[0]
    assert hashed == V.links_digest({"a": "1", "b": "2"})


def test_snapshots(spark, tmp_path):
    s = V.Snapshots(spark, str(tmp_path / "store"))
    assert s.load("repo", "a", "v1") is None and s.current() == {}
    for v in ("v1", "v2"):
        s.save("repo", "a", v, spark.createDataFrame([(v,)], "x string"))
    assert s.load("repo", "a", "v1").first().x == "v1" and s.previous("repo", "a", "v3").first().x == "v2" and s.previous("repo", "a", "v2").first().x == "v1" and s.current() == {"a": "v2"}


def test_graph_projection(spark):
    text = json.dumps({"nodes": [{"id": "n1", "name": "h", "kind": "function", "file": "a.py", "start_line": 1, "end_line": 5}, {"id": "n1", "name": "late", "kind": "odd"}, None], "edges": [{"source_id": "n1", "target_id": "c1", "kind": "type_uses"}]})
    nodes, edges = V.load_graph(spark.createDataFrame([("r", text)], "repo string, graph string"))
    assert [(r.name, r.kind, r.start_line) for r in nodes.collect()] == [("late", None, 0)] and edges.first().kind == "type_uses"


def test_resolve(spark):
    nodes = spark.createDataFrame([("r", "n1", "a.py", 1, 5), ("r", "n2", "a.py", 2, 3), ("r", "c1", "a.py", 11, 20)], "repo string, node_id string, file string, start_line int, end_line int")
    sites = spark.createDataFrame([("r", "./A.py", 2), ("r", "a.py", 5), ("r", "a.py", 15), ("r", "a.py", 99)], "repo string, file string, line int")
    got = {(r.site_line): r.found for r in resolve.enclosing(sites, nodes, ["repo"]).collect()}
    assert got == {2: "n2", 5: "n1", 15: "c1", 99: None}
    mods = spark.createDataFrame([("r", "/base", "core"), ("r", "/base", "core/sub")], "repo string, base string, module string")
    at = spark.createDataFrame([("r", f"/base/{x}") for x in ("core/main.py", "core/sub/x.py", "other/x.py", "core")], "repo string, file string")
    assert {r.file[6:]: r.module for r in resolve.deepest_module(at, mods).collect()} == {"core/main.py": "core", "core/sub/x.py": "core/sub", "other/x.py": "", "core": ""}


def test_batches(spark):
    def sizes(files_):
        df = spark.createDataFrame([(f"{f}{i}", f, i) for f, n in files_ for i in range(n)], "node_id string, file string, ord int")
        return [r[1] for r in interfaces.batches_by_file(df, 5).groupBy("batch").count().orderBy("batch").collect()]

    assert sizes([("a", 20)]) == [5, 5, 5, 5] and sizes([(f"f{i}", 1) for i in range(7)]) == [5, 2] and sizes([("a", 3), ("b", 1), ("c", 6)]) == [5, 5]


def test_port(spark):
    def say_no(prompts):  # rejects the second item of a batch; nested, so that it is pickled by value
        return [json.dumps({"results": [{"index": i, "is_match": i != 1, "confidence": "high"} for i in range(3)]}) for _ in prompts]

    row = lambda f, line: ("fe", "be", "http", "b1", "", "/x", f, line, "s", "", "", "exact", "medium", "forward")
    from vantage.operators.link import _EDGE

    types = ["int" if c == "client_line" else "string" for c in _EDGE]
    edges = spark.createDataFrame([row("api.js", 10), row("api.js", 12), row("b.js", 5), row("c.js", 6)], ", ".join(f"{c} {t}" for c, t in zip(_EDGE, types, strict=True)))
    got = port.confirm(edges, say_no).collect()
    assert sorted((r.client_file, r.client_line, r.confidence) for r in got) == [("api.js", 10, "high"), ("api.js", 12, "high"), ("c.js", 6, "high")]
    assert port.confirm(edges, None).count() == 4
    silent = port.ask(spark.createDataFrame([("p",), ("p",)], "prompt string"), lambda ps: 1 / 0, attempts=2, pause=0)
    assert [r.response for r in silent.collect()] == [None, None]
    mods = spark.createDataFrame([("m", ["a", "b"]), ("n", ["a"])], "module string, types array<string>")
    assert {tuple(r) for r in port.representatives(mods).collect()} == {("m", "a", "a"), ("m", "b", "b")}


def test_links_are_judged_once(spark, tmp_path):
    from vantage.operators.link import _EDGE

    def say(prompts):  # rejects a link to /no; everything it is asked about stands in asked/
        import uuid

        for p in prompts:
            with open(f"{asked}/{uuid.uuid4().hex}", "w") as f:
                f.write(p)
        return [json.dumps({"results": [{"index": i, "is_match": "| /no |" not in line, "confidence": "high"} for i, line in enumerate(x for x in p.splitlines() if " | " in x)]}) for p in prompts]

    types = ", ".join(f"{c} {'int' if c == 'client_line' else 'string'}" for c in _EDGE)
    row = lambda sig, line: ("fe", "be", "http", "b1", "", sig, "a.js", line, "s", "", "", "exact", "medium", "forward")
    asked = str(tmp_path / "asked")
    os.makedirs(asked)
    before = spark.createDataFrame([row("/x", 1), row("/no", 2)], types)
    first = port.confirm_new(before, say, None)
    store, cfg = V.Snapshots(spark, str(tmp_path / "store")), C.Project("shop")
    assert engine.earlier_links(store, cfg, {"be": "1"}) is None
    engine.save_links(store, cfg, {"be": "1"}, first)
    assert engine.earlier_links(store, cfg, {"be": "1"}) is None  # only links of other versions are earlier ones
    earlier = engine.earlier_links(store, cfg, {"be": "2"})
    assert [r.server_signature for r in earlier.collect()] == ["/x"]
    for n in os.listdir(asked):
        os.remove(f"{asked}/{n}")
    now = spark.createDataFrame([row("/x", 1), row("/no", 2), row("/new", 3), row(None, 4)], types)
    got = {(r.server_signature, r.client_line): r.confidence for r in port.confirm_new(now, say, earlier).collect()}
    assert got[("/x", 1)] == "high" and got[("/new", 3)] == "high" and ("/no", 2) not in got and (None, 4) in got
    text = "".join(open(f"{asked}/{n}").read() for n in os.listdir(asked))
    assert "/new" in text and "/x" not in text
    assert port.confirm_new(now, None, earlier).count() == 4 and port.confirm_new(now.limit(0), say, earlier).count() == 0


def test_checkpoints_hold_everything(spark, project):
    nodes, edges, lines = graph_of(spark, project, "backend")
    out = str(project / "out")
    store = V.Snapshots(spark, str(project / "store"))

    def unsure(prompts):  # what stands on disk when the judge is asked was written before
        with open(f"{out}/repos/backend_entry_points.json") as f:
            before = json.load(f)
        assert before["entry_points"] and before["interfaces"] == {}
        open(f"{out}/asked", "w").close()
        return ["no answer"] * len(prompts)

    done = engine.rescan(store, "backend", "v1", nodes, edges, lines, "python", unsure, out)
    assert os.path.exists(f"{out}/asked")
    back = V.load_checkpoints(spark, {"backend": V.checkpoint_path(out, "backend")})
    key = lambda df: {(r.node_id, r.function_name, r.start_line, r.entry_point_type, r.confidence, json.dumps(r.external_sources), r.descriptor.signature, r.descriptor.interface_kind) for r in df.collect()}
    assert key(back) == key(done) and back.where("size(external_sources) > 0").count() > 0
    loose = done.withColumn("descriptor", F.lit(None).cast(M.DESCRIPTOR))
    engine.checkpoint(loose, "backend", "python", out)
    assert V.load_checkpoints(spark, {"backend": V.checkpoint_path(out, "backend")}).where("descriptor is null").count() == done.count()


def test_judge_by_name():
    asked = lambda *more: cli._judge(cli.parser().parse_args(["scan", *more]))
    assert asked() is None and asked("--judge", "json:dumps") is json.dumps and asked("--judge", "json:dumps", "--no-llm") is None
    with pytest.raises(AttributeError):
        asked("--judge", "json:nothing")


def test_fallback(spark):
    rows = [("deserialization", 'x = "/api/v1/orders"', "python", "f", "http", "/api/v1/orders"), ("environment_variable", 'extern "C" void g()', "cpp", "g", "ffi", "g"), ("unknown", '[DllImport("n.dll")]', "c_sharp", "run", "pinvoke", "run"), ("file_read", None, "python", "f", "file", ""), ("odd", "", "go", "f", "none", "")]
    df = spark.createDataFrame(rows, "t string, code string, lang string, name string, kind string, sig string")
    d = interfaces.fallback_descriptor(F.col("t"), F.col("code"), F.col("lang"), F.col("name"))
    assert all(r.kind == r.d.interface_kind and r.sig == r.d.signature for r in df.withColumn("d", d).collect())


def test_answers(spark):
    r = spark.createDataFrame([(1, "no json"), (2, '{"results": []}'), (3, 'so {"results": [{"index": 0, "interface_role": "Boss", "is_match": true}, 7, {"x": 1}]} end'), (4, None)], "batch long, response string")
    assert [(x.batch, x["index"]) for x in interfaces.answers(r).collect()] == [(3, 0)]
    items = spark.createDataFrame([(3, 0, "n")], "batch long, index int, node_id string")
    assert interfaces.descriptors(items, r).first().interface_role == "none"


def test_report_and_drawing(spark, tmp_path):
    e = spark.createDataFrame([("r", f"n{i}", f"f<{i}>", f"src/{m}/x.py", 1, 2, t, [("s", 1, "x", s)] if s is not None else [], True, "high", "", "") for i, (m, t, s) in enumerate([("orders", "http_request", "http_request"), ("orders", "file_read", None), ("users", "x", "environment_variable"), ("users", "x", "")])], M.ENTRY_POINTS)
    rows = modules.report_rows(e)
    assert {r.type: r.n for r in modules.report_by_type(rows).collect()} == {"http_request": 1, "file_read": 1, "environment_variable": 1}
    t = modules.report_totals(e, rows).first()
    assert (t.type_count, t.source_count, t.ep_count) == (3, 3, 4)
    html = open(render.html_report(e, str(tmp_path / "r.html"), "p", "python")).read()
    assert "f&lt;0&gt;" in html
    assert "No entry points" in open(render.exposure_graph(e.limit(0), str(tmp_path), "p", "python", "both")["svg"]).read()
    wishes = spark.createDataFrame([("l", "a", 5.0), ("l", "b", 0.0), ("l", "c", 6.0), ("l", "d", 90.0), ("r", "e", 7.0)], "side string, name string, wish double")
    assert {r.name: r.y for r in modules.next_free(wishes, ["side"], ["name"], "wish", 10.0).collect()} == {"b": 0, "a": 10, "c": 20, "d": 90, "e": 7}
    drawn = json.loads(open(render.exposure_graph(e, str(tmp_path), "p", "python", "both")["cert"]).read())
    boxes = {n["key"]: n for n in drawn["nodeDataArray"] if "name" in n}
    assert {n["name"] for n in boxes.values()} == {"orders", "users", "EXT_FILE", "EXT_HTTP", "EXT_ENV", "EXT.4"} and len(drawn["linkDataArray"]) == 4
    for x in drawn["linkDataArray"]:  # a link's line starts at its interface and ends at its module
        (ax, ay), (bx, by) = (map(float, boxes[x[k]]["loc"].split()) for k in ("from", "to"))
        left = x["toPort"] == "left0"
        assert x["points"][:2] == [ax + (120 if left else 0), ay + 52.5] and x["points"][-2:] == [bx + (0 if left else 150), by + 30]
    assert render.path_module("a/src/core/x.py") == "core" and render.path_module("src/x.py") == "root" and render.path_module("a/b/x.py") == "b"


def test_streaming(spark, tmp_path):
    source, store, check = (str(tmp_path / x) for x in ("in", "store", "check"))
    work = lambda df: df.withColumn("done", F.upper("name"))
    schema = "key string, version long, name string"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").json(source)
        streaming.start(spark, source, schema, store, check, ["key"], ["version"], work).awaitTermination()
        return {(r.key, r.done) for r in spark.read.parquet(store).collect()}

    assert run([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]) == {("a", "Y"), ("b", "Z")}
    assert run([("a", 3, "late"), ("c", 1, "w")]) == {("a", "Y"), ("b", "Z"), ("c", "W")}


def test_extract_order(spark):
    """The type comes from the best match and the name from the first rule contained."""
    rules = M.rules_frame(spark).where("language = 'python'")
    got = extract.match_names(spark.createDataFrame([("json.loads",), ("x.nothing",), ("os.getenv('A')",)], "callee string"), rules).collect()
    assert {(r.callee, r.api_type, r.api_name) for r in got} == {("json.loads", "deserialization", "load"), ("os.getenv('A')", "environment_variable", "getenv")}
