"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _vocab(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of every document."""
    from .op1_license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    from .op2_token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _vocab("word_bpe_49k.json"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    from .op3_jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the content-addressed archive and back."""
    from .op4_warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op5_rans_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids through the coded archive and back."""
    from .op5_rans_archive import token_archive

    return token_archive(table(spark, sf_dir, "documents"), _vocab("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that other documents keep."""
    from .op6_line_dedup import line_dedup

    got = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdict."""
    from .op7_mcd_quality import quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    got = quality_rules(docs, prefix="q_", keep_text=False)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return got.select("doc_id", *[F.col(f"q_{n}").alias(n) for n in names])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    from .op8_decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids packed into sequences of 2048."""
    from .op9_packing import packing

    return packing(table(spark, sf_dir, "documents"), _vocab("word_bpe_49k.json"))


def op10_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without byte strings that start earlier in the corpus."""
    from .op10_repeated_text import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, winning rule and verdict."""
    from .op11_url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults, cheapest repair and its digest."""
    from .op12_conversation_repair import conversation_repair

    return conversation_repair(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four whitened components of all different vectors."""
    from .op13_whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_jaccard_join, op4_warc, op5_rans_archive, op6_line_dedup, op7_mcd_quality, op8_decontamination, op9_packing,
                                op10_repeated_text, op11_url_filter, op12_conversation_repair, op13_whitening)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        k AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first_id, sha1(html) AS h FROM p)
        SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + (((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31))::INT, 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM k""",
    "op6_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
        k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                     '{_UPPER}', '{_LOWER}') AS key FROM l),
        hot AS (SELECT key, max(doc_id) AS keep FROM (SELECT DISTINCT doc_id, key FROM k WHERE length(key) >= 40)
                GROUP BY key HAVING count(*) >= 5),
        m AS (SELECT doc_id, pos, line, coalesce(doc_id < keep, false) AS gone FROM k LEFT JOIN hot USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op11_url_filter": f"""
        WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        r(action, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                     ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        u AS (SELECT DISTINCT host, path FROM h),
        b AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
              FROM u, r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM h LEFT JOIN b USING (host, path)""",
    "op12_conversation_repair": r"""
        WITH RECURSIVE k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        crc AS (  -- CRC-32 bit by bit: a byte enters with its first bit
            SELECT *, xor(list_reduce(flatten(list_transform(string_split(key, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1])),
                              lambda c, x: xor(xor(c, greatest(x, 0)) >> 1, (xor(c, greatest(x, 0)) & 1) * 3988292384), 4294967295::BIGINT), 4294967295) % 20 AS kind
            FROM k),
        d AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM crc WHERE kind <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
        f AS (
            SELECT *, left(role, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM o),
        s AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM f GROUP BY conv_id),
        move(p, x, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        ins(p, q, c, l) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'),
                                   (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
        edit AS (
            SELECT conv_id, i, p, p AS q, 3 AS c, 'D' AS l FROM f, range(4) t(p)
            UNION ALL SELECT conv_id, i, p, q, (fault = 'truncated')::INT, 'K' FROM f JOIN move USING (x) WHERE fault NOT IN ('blank', 'duplicate')
            UNION ALL SELECT conv_id, i, p, q, 2 + (fault = 'truncated')::INT, 'R' FROM f, move WHERE move.x IN ('u', 'a') AND fault NOT IN ('blank', 'duplicate')),
        step AS (SELECT conv_id, i, edit.p, ins.q, edit.c + ins.c AS c, edit.l || ins.l AS l FROM edit JOIN ins ON edit.q = ins.p),
        walk(conv_id, i, q, best) AS (
            SELECT conv_id, 0::BIGINT, q, {'c': c, 'a': l} FROM s, ins WHERE p = 0
            UNION ALL
            SELECT w.conv_id, w.i + 1, e.q, min({'c': w.best.c + e.c, 'a': w.best.a || e.l})
            FROM walk w JOIN step e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.p = w.q
            GROUP BY w.conv_id, w.i, e.q),
        best AS (
            SELECT s.conv_id, min(best) AS b FROM s JOIN walk w ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = s.n WHERE w.q IN (0, 3) GROUP BY s.conv_id),
        letter AS (SELECT conv_id, unnest(string_split(b.a, '')) AS l, unnest(range(length(b.a))) AS k FROM best WHERE b.a <> ''),
        place AS (
            SELECT conv_id, l, k, count(*) FILTER (l <> 'I') OVER w AS i, count(*) FILTER (l <> 'D') OVER w - 1
                       + count(*) FILTER (l <> 'D') OVER (PARTITION BY conv_id) % 2 AS spot
            FROM letter WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
        line AS (
            SELECT p.conv_id, k, CASE WHEN l = 'K' THEN f.role WHEN spot % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE f.text END AS line
            FROM place p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND l <> 'I' WHERE l <> 'D'),
        text AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS t FROM line GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
               coalesce(b.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN text ON text.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
