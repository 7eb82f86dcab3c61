"""Queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, cobucket, fingerprints, jaccard_join, lexical, packing, pii, quality, sharding, substring_dedup, suffix_dedup, topk, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op3_sharding": sharding.op3_sharding,
    "op4_topk": topk.op4_topk,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_packing": packing.op8_packing,
    "op9_quality": quality.op9_quality,
    "op10_bpe": bpe.op10_bpe,
    "op11_pii": pii.op11_pii,
    "op12_lexical": lexical.op12_lexical,
    "op13_cobucket": cobucket.op13_cobucket,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": rf"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
 least AS (SELECT words, min(doc_id) AS low FROM win GROUP BY words),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (words) WHERE doc_id > low),
 kept AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS t FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) a ANTI JOIN gone USING (doc_id, p) GROUP BY a.doc_id)
 SELECT doc_id, len(ws) AS n_words, (SELECT count(*) FROM gone g WHERE g.doc_id = w.doc_id) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op4_topk": """WITH v AS (SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))
 SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY a.r ORDER BY s DESC, b_id, b_r) AS INTEGER) AS rank, b_id AS vec_id, s AS score
 FROM (SELECT a.r, a.vec_id, b.vec_id AS b_id, b.r AS b_r, list_inner_product(a.q, b.q)::BIGINT AS s FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0) a QUALIFY rank <= 10""",
    "op6_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents), t AS (SELECT doc_id, ws, array_to_string(ws, ' ') AS words FROM w),
 c AS (SELECT words, min(doc_id) AS class_id, count(*) AS class_size, any_value(ws) AS ws FROM t GROUP BY words),
 s AS (SELECT DISTINCT class_id, array_to_string(ws[i : i + 4], ' ') AS shingle FROM (SELECT class_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM c WHERE len(ws) > 0)),
 n AS (SELECT class_id, count(*) AS n FROM s GROUP BY 1),
 both_ AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.class_id <> b.class_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM both_ JOIN n x ON x.class_id = a JOIN n y ON y.class_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
 reach AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
 g AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a), l AS (SELECT a, count(*) AS n_class_links, sum(class_size) AS docs FROM links JOIN c ON class_id = b GROUP BY a)
 SELECT doc_id, class_id, class_size, (class_size - 1 + coalesce(docs, 0))::BIGINT AS n_links, coalesce(n_class_links, 0) AS n_class_links, group_id
 FROM t JOIN c USING (words) JOIN g ON g.a = class_id LEFT JOIN l ON l.a = class_id""",
    "op7_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
 least AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (s) WHERE doc_id > low),
 runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (last IS NULL OR last < p - 1) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM gone) GROUP BY 1),
 kept AS (SELECT a.doc_id, string_agg(substr(h, 2 * p + 1, 2), '' ORDER BY p) AS t FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d) a ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
 SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)""",
    "op11_pii": pii.oracle_sql(),
    "op12_lexical": lexical.ORACLE_SQL,
}
