"""SQL of the queries that SQL can express, over the same tables."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_DIGITS}', 1 + ((('0x' || substr(hex, {5 * k + 1}, 5))::INT >> {shift}) & 31), 1)" for k in range(8) for shift in (15, 10, 5, 0))

SQL = {
    "op7_warc": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
        d AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d""",
    "op8_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13)),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win),
        gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(generate_series(0, 12)) AS j FROM f WHERE first < doc_id)),
        each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_near_duplicates": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)
              UNION ALL SELECT doc_id, 'all ' || array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        two AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT u, v FROM two JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op10_decontamination": f"""
        WITH d AS (SELECT doc_id, {_ALNUM.format("coalesce(text, '')")} AS ws FROM documents),
        b AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM (SELECT item_id, {_ALNUM.format("coalesce(text, '')")} AS ws FROM benchmark) WHERE len(ws) > 0),
        bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS k FROM (SELECT item_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM b)),
        sizes AS (SELECT DISTINCT m FROM b),
        dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM d, sizes WHERE len(ws) >= m)),
        hit AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, k)),
        p AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(generate_series(0, m - 1)) AS j FROM hit) GROUP BY 1),
        it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
