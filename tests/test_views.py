"""The derived views hold whole tables."""

from collections import Counter

import duckdb

from vantage.plans import views


def test_nodes_hold_every_line(spark, tmp_path):
    sizes = {0: 1, 1: 2, 2: 4, 3: 44, 40: 1, 41: 42, 42: 43, 79: 40, 80: 41, 81: 43, 119: 300}
    docs = [(i, "\n".join(f"line {n}" for n in range(1, k + 1)), "en", "s", 1) for i, k in sizes.items()]
    docs += [(200, "", "en", "s", 0), (201, "\n" * 50, "en", "s", 50)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    nodes = [tuple(r) for r in views.frame(spark, str(tmp_path), "x_nodes").select("node_id", "file", "start_line", "end_line").collect()]
    lines = [tuple(r) for r in views.frame(spark, str(tmp_path), "x_lines").select("file", "line_no").collect()]
    assert sorted(Counter(f for f, _ in lines).values()) == sorted([*sizes.values(), 1, 51])
    held = Counter((f, n) for f, n in lines for _, g, a, b in nodes if f == g and a <= n <= b)
    assert held == Counter(lines)
    # no node begins beyond its text
    assert all((f, a) in held for _, f, a, _ in nodes)
    assert len({n for n, *_ in nodes}) == len(nodes) and {a for _, _, a, _ in nodes} > {1}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.execute(views.oracle("SELECT node_id, file, start_line, end_line FROM {x_nodes}")).fetchall()) == sorted(nodes)
