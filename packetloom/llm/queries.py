"""The registered corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, media, packing, secrets, sharding, simhash, substring, suffix_tree, toxicity, urls

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_suffix_tree": suffix_tree.op2_suffix_tree,
    "op3_media": media.op3_media,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_urls": urls.op6_urls,
    "op7_secrets": secrets.op7_secrets,
    "op8_substring": substring.op8_substring,
    "op9_packing": packing.op9_packing,
    "op10_sharding": sharding.op10_sharding,
}

#: CRC-32 of a text's bytes: the table of its polynomial, then a fold over the bytes.
CRC_SQL = """
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(i)))
"""

ORACLE: dict[str, str] = {
    "op8_substring": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
        k AS (SELECT s.r, s.i, count(*) OVER (PARTITION BY array_to_string(d.w[s.i:s.i + 34], ' ')) AS n FROM s JOIN d USING (r)),
        g AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM k WHERE n > 1) GROUP BY r),
        o AS (SELECT doc_id, w, coalesce(gone, []) AS gone, map_from_entries([(x, true) FOR x IN coalesce(gone, [])]) AS m FROM d LEFT JOIN g USING (r))
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
               sha256(array_to_string([w[p] FOR p IN range(1, len(w) + 1) IF m[p] IS NULL], ' ')) AS kept_sha256 FROM o
    """,
    "op10_sharding": f"""
        WITH {CRC_SQL},
        b AS (SELECT doc_id, coalesce('=' || source, '') AS source, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
        t AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || substr(h, 2 * p + 1, 2) AS BIGINT) FOR p IN range(0, len(h) // 2)]), lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) AS text_crc32 FROM b, crc_table),
        c AS (SELECT *, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(CAST(text_crc32 AS BIGINT) AS VARCHAR)) AS key FROM t),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM c),
        a AS (SELECT *, row_number() OVER (ORDER BY (rank - 0.5::DOUBLE) / n, source, rank) - 1 AS p, count(*) OVER () AS total FROM r)
        SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p * 24 // total AS INTEGER) AS shard,
               CAST(p - (p * 24 // total * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM a
    """,
}
