"""Relations of the engine derived from the driver's tables: the same SQL for Spark and, as common table expressions, DuckDB.

The tables hold no code, so parts stand for code nodes (a brand is a repository), consecutive lines of an order for
edges, documents for source files, pages for interface endpoints, events for versions. Every view covers whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

#: What the grep queries look for.
PATTERNS = ("License", "the", "of", "ing on", "reserved.", "est", "la", "über", "Version 2.0", "a")
#: Shared SQL; {name} is a table or another view.
VIEWS = {
    "g_nodes": """
        SELECT p_brand AS repo, CAST(p_partkey AS STRING) AS node_id, p_name AS name,
               CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' ELSE 'module' END AS kind,
               p_type AS file, p_size AS start_line, p_size + CAST(p_partkey % 20 AS INT) AS end_line
        FROM {part}""",
    "g_pairs": """
        SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b, a.l_returnflag AS flag
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
    "g_edges": """
        SELECT pa.p_brand AS src_repo, CAST(x.a AS STRING) AS src_id, pb.p_brand AS dst_repo, CAST(x.b AS STRING) AS dst_id,
               CASE WHEN pa.p_brand = pb.p_brand THEN 'call' ELSE 'cross' END AS scope, x.flag AS kind
        FROM {g_pairs} x JOIN {part} pa ON pa.p_partkey = x.a JOIN {part} pb ON pb.p_partkey = x.b""",
    "g_sources": "SELECT p_brand AS repo, CAST(p_partkey AS STRING) AS node_id FROM {part} WHERE p_size <= 5",
    "u_nodes": """
        SELECT 'all' AS repo, node_id, name, kind, file, start_line, end_line FROM {g_nodes} WHERE kind <> 'module'""",
    "u_edges": """
        SELECT 'all' AS repo, src_id AS source_id, dst_id AS target_id,
               CASE kind WHEN 'A' THEN 'calls' WHEN 'N' THEN 'inherits' ELSE 'contains' END AS kind
        FROM {g_edges} WHERE scope = 'call'""",
    "u_start": "SELECT 'all' AS repo, node_id FROM {g_nodes} WHERE start_line = 1",
    # consecutive nodes that together hold every line of a document; only the first has edges
    "x_nodes": """
        SELECT d.source AS repo, 'd' || CAST(d.doc_id AS STRING) || CASE s.part WHEN 0 THEN '' ELSE '.' || CAST(s.part AS STRING) END AS node_id,
               CASE WHEN s.part > 0 THEN 'f' || CAST(d.doc_id AS STRING) || '_' || CAST(s.part AS STRING) WHEN d.doc_id % 10 = 0 THEN 'main' ELSE 'f' || CAST(d.doc_id AS STRING) END AS name,
               CASE d.doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'function' ELSE 'class' END AS kind,
               d.lang || '/' || CASE WHEN d.doc_id % 17 = 0 THEN 'test_' WHEN d.doc_id % 19 = 0 THEN 'an_example_' ELSE '' END || CAST(d.doc_id AS STRING) || '.py' AS file,
               CAST(CASE s.part WHEN 0 THEN 1 WHEN 1 THEN 2 + d.doc_id % 40 ELSE 42 + d.doc_id % 40 END AS INT) AS start_line,
               CAST(CASE s.part WHEN 0 THEN 1 + d.doc_id % 40 WHEN 1 THEN 41 + d.doc_id % 40 ELSE 2147483647 END AS INT) AS end_line, d.doc_id % 3 AS n_parameters
        FROM (SELECT source, doc_id, lang, length(text) - length(replace(text, chr(10), '')) AS breaks FROM {documents}) d
        CROSS JOIN (VALUES (0), (1), (2)) AS s(part)
        WHERE s.part = 0 OR d.breaks > d.doc_id % 40 + CASE s.part WHEN 1 THEN 0 ELSE 40 END""",
    "x_edges": """
        SELECT d.source AS repo, 'd' || CAST(d.doc_id AS STRING) AS source_id, 'd' || CAST(d.doc_id + 20 AS STRING) AS target_id, 'calls' AS kind
        FROM {documents} d WHERE d.n_chars > 900
        UNION ALL
        SELECT d.source AS repo, 'd' || CAST(d.doc_id AS STRING) AS source_id, replace(p.p_name, ' ', '.') || '(x)' AS target_id, 'calls' AS kind
        FROM {documents} d JOIN {part} p ON p.p_partkey = d.doc_id""",
    "rules": """
        SELECT * FROM (VALUES (0, 'widget', 'user_input'), (1, 'ring', 'file_read'), (2, 'gear', 'socket'), (3, 'ging', 'http_request'),
            (4, 'tion', 'file_read'), (5, 'ation', 'deserialization'), (6, 'thering', 'database_query'), (7, 'small.ring(x)', 'websocket'),
            (8, 'keit', 'environment_variable'), (9, 'License', 'command_line_args'), (10, 'eaux', 'user_input')) AS t(ord, api_name, api_type)""",
    "patterns": "SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in PATTERNS) + ") AS t(pattern)",
    "l_repos": "SELECT DISTINCT 'r' || CAST(page_id % 6 AS STRING) AS name FROM {pages}",
    "l_links": "SELECT a.name AS from_repo, b.name AS to_repo, 'http' AS type FROM {l_repos} a JOIN {l_repos} b ON a.name <> b.name",
    "endpoints": """
        SELECT 'r' || CAST(page_id % 6 AS STRING) AS repo, 'e' || lpad(CAST(page_id AS STRING), 9, '0') AS node_id, 'fn' || CAST(page_id AS STRING) AS function_name,
               'p' || CAST(page_id AS STRING) AS file_path, CAST(1 AS INT) AS start_line,
               CASE page_id % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'reverse-proxy' WHEN 2 THEN 'grpc' ELSE 'http' END AS interface_kind,
               CASE page_id % 3 WHEN 0 THEN 'server' WHEN 1 THEN 'client' ELSE 'both' END AS interface_role, urls
        FROM {page_urls}""",
    "call_sites": """
        SELECT p.p_brand AS repo, p.p_type AS file, CAST(l.l_quantity AS INT) AS line, l.l_orderkey AS k
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "paths": "SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM {pages}",
    "files": "SELECT source AS repo, lang || '/' || CAST(doc_id AS STRING) AS rel, n_chars AS size FROM {documents}",
    "named_files": """
        SELECT 'r' || CAST(l_suppkey % 40 AS STRING) AS repo,
               CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'a/b/c/d/' ELSE 'vendor/x/' END || 'f' || CAST(l_orderkey AS STRING) ||
               CASE WHEN l_suppkey % 40 < 30 THEN CASE l_partkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.C' WHEN 3 THEN '.hpp' WHEN 4 THEN '' ELSE '.tar.js' END
                    WHEN l_suppkey % 40 < 36 THEN CASE WHEN l_partkey % 50 = l_suppkey % 3 THEN '/pom.xml' WHEN l_partkey % 50 = 7 THEN '/package.json' ELSE '.ts' END
                    WHEN l_suppkey % 40 < 39 THEN CASE WHEN l_partkey % 90 = 1 THEN '.sln' ELSE '.java' END ELSE '.txt' END AS rel
        FROM {lineitem}""",
    "dirs": """
        SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN p_type WHEN 1 THEN p_type || '/' || p_brand WHEN 2 THEN p_type || '/' || p_brand || '/m' || CAST(p_partkey % 7 AS STRING)
               WHEN 3 THEN 'vendor/' || p_brand ELSE p_type || '/x/y/z/w' || CAST(p_partkey % 3 AS STRING) END AS path, p_brand <> 'Brand#3' AND (p_size % 5 <> 0 OR p_type = 'SMALL') AS has_git
        FROM {part}""",
    "snapshots": """
        SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS STRING) || ' ' || CAST(event_id % 5 AS STRING) AS version, event_id AS mtime, value
        FROM {events}""",
    "entries": """
        SELECT 'b' || CAST(p_size % 5 AS STRING) AS repo, 'n' || lpad(CAST(p_partkey AS STRING), 9, '0') AS node_id, p_name AS function_name,
               CASE p_partkey % 6 WHEN 0 THEN 'src/' || replace(p_name, ' ', '-') || '/x.py' WHEN 1 THEN 'a/' || p_brand || '/lib/' || p_type || '/y.py'
                    WHEN 2 THEN 'top.py' WHEN 3 THEN 'a/b.py' WHEN 4 THEN 'q/w/' || p_type || '/z.py' ELSE 'pkg/app/z.py' END AS file_path,
               p_size AS start_line, p_size + 3 AS end_line,
               CASE p_size % 4 WHEN 0 THEN 'http_request' WHEN 1 THEN 'file_read' WHEN 2 THEN 'socket' ELSE 'unknown' END AS entry_point_type,
               CASE WHEN p_partkey % 3 = 0 THEN 'database_query' WHEN p_partkey % 3 = 1 THEN '' ELSE NULL END AS source_type,
               CASE WHEN p_partkey % 4 = 0 THEN 'websocket' ELSE NULL END AS other_type
        FROM {part}""",
    "responses": """
        SELECT event_id AS batch, CASE event_type
            WHEN 'view' THEN 'Here: {{"results": [{{"index": ' || CAST(event_id % 3 AS STRING) || ', "interface_role": " Server ", "interface_kind": "HTTP", "signature": "/a ", "is_match": true, "confidence": "HIGH", "signature_aliases": ["x", "y"]}}, {{"index": 1, "is_entry_point": false, "is_match": false}}]}} done'
            WHEN 'click' THEN '{{"results": []}}'
            WHEN 'error' THEN 'no json'
            WHEN 'signup' THEN '{{"results": [{{"interface_role": "server"}}, {{"index": 2, "interface_role": "boss", "confidence": "sure", "is_match": true}}, {{"index": 2, "interface_role": "client", "confidence": "low", "is_match": true}}]}}'
            ELSE props END AS response
        FROM {events}""",
    "flows": "SELECT 'flow-' || CAST(n_nationkey + 1 AS STRING) AS id, 'n' || CAST(n_nationkey AS STRING) AS source, 'r' || CAST(n_regionkey AS STRING) AS target, 'https' AS protocol FROM {nation}",
    "flow_edges": """
        SELECT 'n' || CAST(c_nationkey AS STRING) AS from_repo, 'r' || CAST(c_custkey % 5 AS STRING) AS to_repo,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'http' WHEN 'MACHINERY' THEN 'grpc' ELSE 'ssh' END AS link_type, c_custkey AS ord
        FROM {customer}""",
    "found_edges": """
        SELECT 'n' || CAST(n.n_nationkey AS STRING) AS from_repo, 'n' || CAST(s.s_nationkey AS STRING) AS to_repo,
               CASE l.l_returnflag WHEN 'A' THEN 'http' WHEN 'N' THEN 'grpc' ELSE 'rpc' END AS link_type,
               CAST(l.l_partkey AS STRING) AS server_signature, 'f' || CAST(l.l_suppkey AS STRING) AS client_file, CAST(l.l_linenumber AS INT) AS client_line,
               CAST(l.l_orderkey AS BIGINT) AS k
        FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey
        JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey""",
}
_URL = """["''](/[A-Za-z0-9_\\-./~?&=:{{}}%]+)["'']"""
#: Views whose text differs between the engines: (Spark, DuckDB).
BOTH = {
    "src_lines": (
        "SELECT repo, file, CAST(p + 1 AS INT) AS line_no, line FROM (SELECT source AS repo, lang || '/' || CAST(doc_id AS STRING) AS file, posexplode(split(text, '\\n')) AS (p, line) FROM {documents})",
        "SELECT source AS repo, lang || '/' || CAST(doc_id AS VARCHAR) AS file, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents",
    ),
    "x_lines": (
        "SELECT repo, file, CAST(p + 1 AS INT) AS line_no, line FROM (SELECT n.repo, n.file, posexplode(split(d.text, '\\n')) AS (p, line) FROM {documents} d JOIN {x_nodes} n ON n.node_id = 'd' || CAST(d.doc_id AS STRING))",
        "SELECT n.repo, n.file, CAST(generate_subscripts(string_split(d.text, chr(10)), 1) AS INT) AS line_no, unnest(string_split(d.text, chr(10))) AS line FROM documents d JOIN x_nodes n ON n.node_id = 'd' || CAST(d.doc_id AS VARCHAR)",
    ),
    "l_lines": (
        "SELECT repo, file, CAST(p + 1 AS INT) AS line_no, line FROM (SELECT 'r' || CAST(page_id % 6 AS STRING) AS repo, 'p' || CAST(page_id AS STRING) AS file, posexplode(split(html, '><')) AS (p, line) FROM {pages})",
        "SELECT 'r' || CAST(page_id % 6 AS VARCHAR) AS repo, 'p' || CAST(page_id AS VARCHAR) AS file, CAST(generate_subscripts(string_split(html, '><'), 1) AS INT) AS line_no, unnest(string_split(html, '><')) AS line FROM pages",
    ),
    "page_urls": (
        None,  # made by the url_literals function
        f"SELECT page_id, list_filter(u, lambda x, i: list_position(u, x) = i) AS urls FROM (SELECT page_id, regexp_extract_all(html, '{_URL.replace('{{', '{').replace('}}', '}')}', 1) AS u FROM pages)",
    ),
}
_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "page_urls":
        from pyspark.sql import functions as F

        from vantage.functions.text import url_literals

        return frame(spark, sf_dir, "pages").select("page_id", url_literals(F.col("html")).alias("urls"))
    text = BOTH[name][0] if name in BOTH else VIEWS[name]
    return spark.sql(text, **{n: frame(spark, sf_dir, n) for n in set(_NAME.findall(text))})


def _needs(name: str, done: list[str]) -> None:
    text = BOTH[name][1] if name in BOTH else VIEWS[name]
    own = re.findall(r"\b(" + "|".join([*VIEWS, *BOTH]) + r")\b", text) if name in BOTH else _NAME.findall(text)
    for n in own:
        if n != name and n not in TABLES and n not in done:
            _needs(n, done)
    if name not in done:
        done.append(name)


def oracle(sql: str) -> str:
    """DuckDB SQL: {name} in ``sql`` becomes a name, and the views that it needs come before it. A leading WITH is joined."""
    done: list[str] = []
    for n in _NAME.findall(sql):
        if n not in TABLES:
            _needs(n, done)
    plain = lambda t: _NAME.sub(r"\1", t).replace("{{", "{").replace("}}", "}")
    parts = [f"{n} AS ({BOTH[n][1] if n in BOTH else plain(VIEWS[n])})" for n in done]
    body = plain(sql).strip()
    if body.upper().startswith("WITH RECURSIVE"):
        body = body[len("WITH RECURSIVE") :]
        return "WITH RECURSIVE " + ", ".join([*parts, body.strip()])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:].strip()])
    return ("WITH " + ", ".join(parts) + "\n" if parts else "") + body
