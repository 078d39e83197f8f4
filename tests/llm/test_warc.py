import base64
import gzip
import hashlib
import io
import json
import time

import pytest

from vantage.llm import warc


def test_normalise_streams(monkeypatch):
    payloads = [b"", b"a", b"x\r\n\r\ny" * 5000, "é日".encode() * 9, b"WARC/1.1\r\n\r\n"]
    records = [warc.record(i, f"http://e.x/{i} \n", p) for i, p in enumerate(payloads)]
    for chunk in (7, 1 << 20):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        for packed in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
            out, index = io.BytesIO(), io.BytesIO()
            assert warc.normalise(io.BytesIO(packed), out, index, {3: (0, "http://e.x/0 \n")}) == len(records)
            rows = [json.loads(x) for x in index.getvalue().splitlines()]
            got = [gzip.decompress(out.getvalue()[r["offset"] : r["offset"] + r["length"]]) for r in rows]
            assert [g for i, g in enumerate(got) if i != 3] == [g for i, g in enumerate(records) if i != 3] and sum(r["length"] for r in rows) == len(out.getvalue())
            head, _, rest = got[3].partition(b"\r\n\r\n")
            fields = warc.parse_head(head)
            assert fields["warc-refers-to"] == rows[0]["id"] and fields["x-refers-to-page"] == "0" and f"Content-Length: {len(payloads[3])}".encode() in rest and rest.endswith(b"\r\n\r\n\r\n\r\n")
            assert [r["type"] for r in rows] == ["response"] * 3 + ["revisit", "response"]
        with pytest.raises(ValueError):
            warc.normalise(io.BytesIO(gzip.compress(b"".join(records))[:-40]), io.BytesIO(), io.BytesIO())
        with pytest.raises(ValueError):
            warc.normalise(io.BytesIO(gzip.compress(b"".join(records)[:-40])), io.BytesIO(), io.BytesIO())
    assert warc.normalise(io.BytesIO(b""), io.BytesIO(), io.BytesIO()) == 0


def plain(rows, least=0):
    first = {}
    for page, url, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", (page, url or "")), (page, url or ""))
    out, stored = [], set()
    for page, url, html in rows:
        data = (html or "").encode()
        at = first.get(html or "")
        response = at is None or len(data) < least or ((page, url or "") == at and (html or "") not in stored)  # one of equal rows
        if response:
            stored.add(html or "")
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else at[0]))
    return sorted(out, key=str)


def test_records_in_linear_time():
    """Many small records in one chunk: no record costs a copy of what follows it."""
    data = b"".join(warc.record(i, f"http://e.x/{i}", b"x" * 500) for i in range(20_000))
    began = time.perf_counter()
    assert sum(1 for _ in warc._records(iter([data]))) == 20_000
    assert time.perf_counter() - began < 4


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least", [0, 3])
def test_edge_cases(spark, least):
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (3, "http://b", "same")]
    rows += [(None, "n", "alone"), (None, "m", "alone"), (None, "k", "same"), (7, "x\r\ny: z", "é" * 300_000), (8, "u", "a\r\n\r\nb"), (11, "u", "ab"), (12, "u", "ab"), (11, "u", "ab"), (11, "u", "ab")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    got = warc.archive(pages, least)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == plain(rows, least)
    kept = {r.page_id: r.payload for r in got.where("record_type = 'response'").collect()}
    assert kept[7] == "é" * 300_000 and kept[8] == "a\r\n\r\nb" and kept[1] == ""
    assert warc.archive(pages.limit(0)).collect() == []


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = pages.unionByName(pages.limit(9).selectExpr("page_id + 1000 as page_id", "url", "html"))
    got = warc.archive(pages).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain([(r.page_id, r.url, r.html) for r in pages.collect()])
