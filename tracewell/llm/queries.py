"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op10_decontaminate
from .exact_dedup import op5_exact_dedup
from .toxicity import op2_fm_toxicity
from .simhash import op8_simhash_near_dedup
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op3_trie_token_counts
from .language import op4_bigru_language
from .packing import op7_best_fit_packing
from .repair import op1_repair_tokens
from .url_filters import op6_url_filters

QUERIES = {f.__name__: f for f in (op1_repair_tokens, op2_fm_toxicity, op3_trie_token_counts, op4_bigru_language, op5_exact_dedup, op6_url_filters, op7_best_fit_packing, op8_simhash_near_dedup, op9_suffix_dedup, op10_decontaminate)}

ORACLE_SQL = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_url_filters": r"""
        WITH rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        ids AS (SELECT row_number() OVER () AS i, * FROM q),
        best AS (SELECT i, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict FROM ids JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY i)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ids LEFT JOIN best USING (i)""",
    "op10_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
        lens AS (SELECT DISTINCT n FROM g),
        s AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
        h AS (SELECT doc_id, i, n, item_id FROM s JOIN g USING (gram, n)),
        c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM h, unnest(range(i, i + n)) AS u(k) GROUP BY doc_id),
        t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
