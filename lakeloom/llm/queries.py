"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, embedding_dedup, html_extract, mixing, near_dedup, prefix_trie, quality, resample, substring_dedup, suffix_dedup, suffix_tree_lm, toxicity

QUERIES = {
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op6_html_extract": html_extract.op6_html_extract,
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_toxicity": toxicity.op3_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_suffix_tree_lm": suffix_tree_lm.op12_suffix_tree_lm,
    "op13_resample": resample.op13_resample,
}


def _crc(x: str) -> str:
    """SQL: unsigned CRC-32 of a text's UTF-8 bytes, bit by bit."""
    byte = f"CAST('0x' || substr(hex(encode({x})), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)"
    given = f"list_concat([CAST(4294967295 AS BIGINT)], list_transform(generate_series(1, CAST(strlen({x}) AS BIGINT)), lambda i: {byte}))"
    step = "list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, CASE WHEN s & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))"
    return f"xor(list_reduce({given}, lambda c, b: {step}), CAST(4294967295 AS BIGINT))"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op11_prefix_trie": f"""
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, {_crc('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    own AS (SELECT c.conv_id, 0 AS k, place, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND place <= h UNION ALL SELECT c.conv_id, 1, place, x FROM c JOIN t USING (conv_id) WHERE place > h),
    r AS (SELECT c.conv_id, coalesce(ts, []) AS ts FROM c LEFT JOIN (SELECT conv_id, list(x ORDER BY k, place) AS ts FROM own GROUP BY conv_id) USING (conv_id)),
    p AS (SELECT conv_id, ts, unnest(generate_series(0, len(ts))) AS depth FROM r),
    n AS (SELECT depth, ts[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN len(ts) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY ALL),
    kids AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
    e AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * length(n.prefix[n.depth].t) ELSE 0 END AS saved FROM n LEFT JOIN kids ON kids.depth = n.depth AND kids.prefix = n.prefix),
    up AS (SELECT unnest(generate_series(0, depth)) AS a, prefix, depth, n_children, saved FROM e),
    sums AS (SELECT a AS depth, prefix[1:a] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY ALL)
    SELECT e.conv_id, CAST(e.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
    FROM e JOIN sums ON sums.depth = e.depth AND sums.prefix = e.prefix LEFT JOIN e above ON above.depth = e.depth - 1 AND above.prefix = e.prefix[1:e.depth - 1]
    """,
    # a blank is the end of a text, two are its start
    "op12_suffix_tree_lm": f"""
    WITH d AS (SELECT doc_id, {_crc('CAST(doc_id AS VARCHAR)')} % 10 = 0 AS held_out, list_append(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), ' ') AS ws FROM documents),
    t AS (SELECT doc_id, held_out, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] ELSE '  ' END AS p1, CASE WHEN i > 2 THEN ws[i - 2] WHEN i = 2 THEN '  ' END AS p2 FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM d)),
    c1 AS (SELECT w, count(*) AS n FROM t WHERE NOT held_out GROUP BY w),
    c2 AS (SELECT p1, w, count(*) AS n FROM t WHERE NOT held_out GROUP BY ALL),
    c3 AS (SELECT p2, p1, w, count(*) AS n FROM t WHERE NOT held_out AND p2 IS NOT NULL GROUP BY ALL),
    sizes AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens, count(*) AS kinds FROM c1),
    s1 AS (SELECT p1, CAST(sum(n) AS BIGINT) AS total, count(*) AS next FROM c2 GROUP BY p1 HAVING sum(n) >= 3),
    g1 AS (SELECT p1, c2.w AS w, c2.n AS n, total, next, (c1.n + 0.1::DOUBLE) / (tokens + 0.1::DOUBLE * (kinds + 1)) AS root FROM c2 JOIN s1 USING (p1) JOIN c1 ON c1.w = c2.w, sizes),
    k1 AS (SELECT p1, any_value(total) AS total, any_value(next) AS next FROM g1 GROUP BY p1 HAVING sum(n * CAST(round(65536 * ln(n / (total * root))) AS BIGINT)) >= 65536 * any_value(next)),
    s2 AS (SELECT p2, p1, CAST(sum(n) AS BIGINT) AS total, count(*) AS next FROM c3 GROUP BY ALL HAVING sum(n) >= 3),
    g2 AS (SELECT c3.*, s2.total AS total, s2.next AS next, (c1.n + 0.1::DOUBLE) / (tokens + 0.1::DOUBLE * (kinds + 1)) AS root, k1.total AS t1, k1.next AS n1, c2.n AS c2 FROM c3 JOIN s2 USING (p2, p1) JOIN c1 USING (w) JOIN c2 ON c2.p1 = c3.p1 AND c2.w = c3.w LEFT JOIN k1 ON k1.p1 = c3.p1, sizes),
    h2 AS (SELECT *, CASE WHEN t1 IS NULL THEN root ELSE (c2 + n1 * root) / (t1 + n1) END AS below FROM g2),
    k2 AS (SELECT p2, p1, any_value(total) AS total, any_value(next) AS next FROM h2 GROUP BY p2, p1 HAVING sum(n * CAST(round(65536 * ln(n / (total * below))) AS BIGINT)) >= 65536 * any_value(next)),
    r AS (SELECT doc_id, held_out, i, coalesce(c1.n, 0) AS n, (coalesce(c1.n, 0) + 0.1::DOUBLE) / (tokens + 0.1::DOUBLE * (kinds + 1)) AS root, coalesce(c2.n, 0) AS c2, coalesce(c3.n, 0) AS c3, k1.total AS t1, k1.next AS n1, k2.total AS t2, k2.next AS n2
        FROM t LEFT JOIN c1 ON c1.w = t.w LEFT JOIN c2 ON c2.p1 = t.p1 AND c2.w = t.w LEFT JOIN c3 ON c3.p2 = t.p2 AND c3.p1 = t.p1 AND c3.w = t.w LEFT JOIN k1 ON k1.p1 = t.p1 LEFT JOIN k2 ON k2.p2 = t.p2 AND k2.p1 = t.p1, sizes),
    q AS (SELECT *, CASE WHEN t1 IS NULL THEN root ELSE (c2 + n1 * root) / (t1 + n1) END AS one FROM r)
    SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (n > 0) AS n_known, (SELECT tokens FROM sizes) AS train_tokens, sum(log10(root) ORDER BY i) AS base_score,
        sum(log10(CASE WHEN t2 IS NULL THEN one ELSE (c3 + n2 * one) / (t2 + n2) END) ORDER BY i) AS score FROM q GROUP BY doc_id, held_out
    """,
    "op13_resample": f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    f AS (SELECT doc_id, unnest(ws) AS w FROM d),
    b AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
    words AS (SELECT w, {_crc('w')} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM b)),
    raw AS (SELECT bucket, count(*) AS s FROM f JOIN words USING (w) GROUP BY bucket),
    target AS (SELECT bucket, count(*) AS t FROM b JOIN words USING (w) GROUP BY bucket),
    sizes AS (SELECT CAST((SELECT count(*) FROM f) AS DOUBLE) AS s_all, CAST((SELECT count(*) FROM b) AS DOUBLE) AS t_all),
    gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * (s_all + 10000)) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM raw FULL JOIN target USING (bucket), sizes),
    sums AS (SELECT doc_id, sum(gain) AS weight FROM f JOIN words USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
    scored AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN sums USING (doc_id)),
    fit AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN (SELECT * FROM fit WHERE rank <= (SELECT count(*) FROM fit) * 10 // 100) USING (doc_id)
    """,
    "op4_chat_format": r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    e AS (SELECT *, 17 + length(regexp_replace(role, '([<\[])(\\*(?:/?INST\]|/?s>))', '\1\\\2', 'g')) + length(regexp_replace(text, '([<\[])(\\*(?:/?INST\]|/?s>))', '\1\\\2', 'g')) AS size FROM c),
    p AS (SELECT *, sum(size) OVER w + 3 AS upto, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(upto) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
    FROM p GROUP BY conv_id
    """,
    "op5_substring_dedup": r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    places AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 12)) AS i, ws FROM w WHERE len(ws) >= 13),
    win AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS h FROM places),
    firsts AS (SELECT h, min(doc_id) AS first_id FROM win GROUP BY h),
    hits AS (SELECT doc_id, i FROM win JOIN firsts USING (h) WHERE first_id < doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM hits),
    words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS j FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op7_decontaminate": r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    bp AS (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM bp),
    sizes AS (SELECT DISTINCT n FROM bw),
    dp AS (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, sizes WHERE len(ws) >= n),
    hit AS (SELECT doc_id, item_id, i, bw.n AS n FROM dp JOIN bw ON bw.n = dp.n AND bw.s = array_to_string(ws[i:i + dp.n - 1], ' ')),
    places AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM hit),
    n_hits AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
    items AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hit GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n_hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    # the layouts of these tables have one article element each, whose blocks are p, h1, ul and li; fixtures and brute force test what other pages hold
    "op6_html_extract": r"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
    b AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(h, '(?s)<script.*?</script>|<!--.*?-->', '', 'g'), '<br>', ' ', 'g'), '</?(?:p|h1|ul|li)[^>]*>') AS pieces FROM a),
    c AS (SELECT page_id, url, list_transform(pieces, lambda x: regexp_replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g')) AS pieces FROM b),
    d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(pieces, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c)
    SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
    """,
    "op1_embedding_dedup": r"""
    WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
    ok AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_max(list_transform(x, lambda y: abs(y))) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
    reach AS (SELECT vec_id AS node, vec_id AS r FROM v UNION SELECT node, b FROM reach JOIN links ON r = a),
    comp AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node),
    n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON node = vec_id LEFT JOIN n ON a = vec_id
    """,
    "op8_near_dedup": r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM p),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    reach AS (SELECT doc_id AS node, doc_id AS r FROM w UNION SELECT node, b FROM reach JOIN links ON r = a),
    comp AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
    SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN comp ON node = w.doc_id LEFT JOIN n USING (doc_id)
    """,
    "op10_suffix_dedup": r"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
    c AS (SELECT doc_id, h, n, unnest(generate_series(0, CAST(n AS BIGINT) - 200, 256)) AS c FROM d WHERE n >= 200),
    e AS (SELECT doc_id, c, h[2 * c + 1:2 * c + 910] AS h, least(256, n - 199 - c) AS n FROM c),
    p AS (SELECT doc_id, c, h, unnest(generate_series(1, CAST(n AS BIGINT))) AS i FROM e),
    win AS (SELECT doc_id, c + i AS i, md5_number(h[2 * i - 1:2 * i + 398]) AS m FROM p),
    again AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
    starts AS (SELECT doc_id, i FROM win SEMI JOIN again USING (m)),
    edges AS (SELECT doc_id, i, i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS fresh FROM starts),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS b FROM (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM edges) GROUP BY doc_id, k),
    cuts AS (SELECT doc_id, count(*) AS n_spans, sum(b - a + 1) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM spans GROUP BY doc_id),
    kept AS (SELECT doc_id, n_spans, n_removed, unnest(generate_series(1, len(a) + 1)) AS k, list_concat([0], b) AS begins, list_concat(a, [1000000000]) AS ends, h FROM cuts JOIN d USING (doc_id)),
    rest AS (SELECT doc_id, n_spans, n_removed, string_agg(h[2 * begins[k] + 1:2 * ends[k] - 2], '' ORDER BY k) AS h FROM kept GROUP BY ALL)
    SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest.h, d.h))) AS kept_sha256
    FROM d LEFT JOIN rest USING (doc_id)
    """,
}
