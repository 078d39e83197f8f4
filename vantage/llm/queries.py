"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.fingerprints import compare_neighbours

    return compare_neighbours(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.embed_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.token_store import read_store, write_store

    return read_store(spark, write_store(_read(spark, sf_dir, "documents")), with_ids=False)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.pii import replace

    return replace(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.mixing import weigh

    return weigh(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), with_text=False).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "p", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.warc import archive

    return archive(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.langid import held_out, identify

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.chat import link_conversations

    return link_conversations(_read(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: Base32 of a SHA-1 in hexadecimal: 32 groups of five bits, each from three hexadecimal digits that hold it.
_BASE32 = """list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(((CAST('0x' || substr(sha1(payload) || '00', CAST((5 * i) // 4 AS BIGINT) + 1, 3) AS INT) >> CAST(7 - (5 * i) % 4 AS INT)) & 31) AS BIGINT), 1)), lambda a, b: a || b)"""

_ORACLES = {
    "op2_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
          u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
          links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
          reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, (SELECT min(b) FROM reach r WHERE r.a = e.vec_id) AS component_id,
          e.vec_id = (SELECT min(b) FROM reach r WHERE r.a = e.vec_id) AS kept FROM embeddings e""",
    "op8_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), d AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first, row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS nth FROM p)
        SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
          CASE WHEN nth = 1 OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first END AS refers_to FROM d""",
    # calls of reply stand after what they refer to; a review waits for the later of its two turns, one level behind it
    "op10_chat": """
        WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth,
            EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = c.conv_id AND b.role = 'user' AND b.turn = c.turn - 2) AS follows FROM conversations c WHERE role = 'user'),
          r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM conversations WHERE role = 'assistant' AND coalesce(text, '') NOT LIKE '%<tool_call>%'),
          ids AS (SELECT DISTINCT conv_id, turn FROM u),
          calls AS (
            SELECT conv_id, turn, 0 AS place, 'turn-' || CAST(turn AS VARCHAR) AS call_id, 'reply' AS name, nth, text AS prompt, follows FROM u
            UNION ALL SELECT a.conv_id, a.turn, 1, 'review-' || CAST(a.turn AS VARCHAR), 'review', 1, NULL, false FROM ids a JOIN ids b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2),
          needs AS (
            SELECT conv_id, call_id, turn - 2 AS on_turn, 0 AS nr FROM calls WHERE name = 'reply' AND follows AND nth = 1
            UNION ALL SELECT conv_id, call_id, turn, 0 FROM calls WHERE name = 'review' UNION ALL SELECT conv_id, call_id, turn + 2, 1 FROM calls WHERE name = 'review'),
          last AS (SELECT n.conv_id, n.call_id, max(n.on_turn) AS on_turn FROM needs n GROUP BY n.conv_id, n.call_id),
          placed AS (
            SELECT c.*, l.on_turn IS NOT NULL AND nth = 1 AND (l.on_turn > c.turn OR (l.on_turn = c.turn AND c.place = 0)) AS waits, l.on_turn
            FROM calls c LEFT JOIN last l ON l.conv_id = c.conv_id AND l.call_id = c.call_id),
          every AS (
            SELECT p.conv_id, p.turn, p.place, p.call_id, p.name, CASE WHEN p.nth > 1 THEN 'repeated_call' WHEN p.prompt = '' THEN 'bad_arguments' WHEN r.turn IS NULL THEN 'no_result' ELSE 'linked' END AS status,
              CASE WHEN p.waits THEN p.on_turn ELSE p.turn END AS anchor_turn, CASE WHEN p.waits THEN 0 ELSE p.place END AS anchor_place, CASE WHEN p.waits THEN 1 ELSE 0 END AS level, r.turn AS result_turn,
              CASE WHEN p.name = 'review' THEN '{"turns":[{"$ref":"turn-' || CAST(p.turn AS VARCHAR) || '"},{"$ref":"turn-' || CAST(p.turn + 2 AS VARCHAR) || '"}]}'
                ELSE '{' || CASE WHEN p.follows THEN '"after":{"$ref":"turn-' || CAST(p.turn - 2 AS VARCHAR) || '"},' ELSE '' END || '"prompt":' || CAST(to_json(p.prompt) AS VARCHAR) || '}' END AS args, r.text AS answer
            FROM placed p LEFT JOIN r ON p.name = 'reply' AND r.conv_id = p.conv_id AND r.turn = p.turn + 1 AND r.nth = 1 AND p.nth = 1
            UNION ALL SELECT r.conv_id, r.turn, 0, 'turn-' || CAST(r.turn - 1 AS VARCHAR), NULL, CASE WHEN i.turn IS NULL THEN 'orphan_result' ELSE 'repeated_result' END, r.turn, 0, 0, r.turn, 'null', r.text
            FROM r LEFT JOIN ids i ON i.conv_id = r.conv_id AND i.turn = r.turn - 1 WHERE i.turn IS NULL OR r.nth > 1)
        SELECT conv_id, turn, CAST(place AS BIGINT) AS place, call_id, name, status, CASE WHEN status = 'bad_arguments' THEN '$.prompt: length 0' ELSE '' END AS problems,
          anchor_turn, CAST(anchor_place AS BIGINT) AS anchor_place, CAST(level AS INT) AS level, result_turn,
          '{"arguments":' || args || ',"id":"' || call_id || '","name":' || CASE WHEN name IS NULL THEN 'null' ELSE '"' || name || '"' END || ',"result":' || CASE WHEN answer IS NULL THEN 'null' ELSE CAST(to_json(answer) AS VARCHAR) END || '}' AS json
        FROM every""",
}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the tests hold the others against brute force, round trips or held-out accuracy."""
    return dict(_ORACLES)
