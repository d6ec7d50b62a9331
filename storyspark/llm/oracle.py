"""DuckDB SQL for the registered queries of this package that SQL can express."""

from __future__ import annotations

LLM_ORACLE: dict[str, str] = {}

LLM_ORACLE["op1_revisits"] = r"""
WITH cut AS (
  SELECT page_id, (page_id % 2147483648) * 2654435761 % 4294967296 AS mixed,
    regexp_replace(trim(url), '^[a-z][a-z0-9+.-]*://(?:www\.)?|#.*$', '', 'gi') AS bare,
    '"' || md5(regexp_extract(coalesce(html, ''), '<title>([^<]*)', 1)) || '"' AS tag,
    strlen(coalesce(html, ''))::VARCHAR AS size
  FROM pages
), named AS (
  SELECT *,
    regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(?:80|443)$', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*(.*)$', 1),
       '([?&])(?:(?:utm_[^=&]*|ref|gclid|fbclid)=[^&]*(?:&|$))+', '\1', 'g'), '[?&]+$', ''), '/+$', '') AS canonical_url
  FROM cut
), records AS (
  SELECT page_id AS record_id, canonical_url, page_id AS t, 'response' AS kind, tag AS etag, size FROM named WHERE mixed % 13 <> 0
  UNION ALL
  SELECT -page_id - 1, canonical_url, page_id + mixed % 1000 + 1, 'revisit',
    CASE WHEN mixed % 7 = 0 THEN 'W/"another"' ELSE 'W/' || tag END, '0'
  FROM named WHERE mixed % 3 <> 0
), asof_rows AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'etag': etag, 'size': size} END IGNORE NULLS) OVER (
    PARTITION BY canonical_url ORDER BY t, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS original
  FROM records
), judged AS (
  SELECT *, CASE WHEN original IS NULL THEN 'unmatched' WHEN replace(etag, 'W/', '') = original.etag THEN 'resolved' ELSE 'changed' END AS status
  FROM asof_rows WHERE kind = 'revisit'
)
SELECT record_id, canonical_url, original.id AS original_id, status,
  CASE WHEN status = 'resolved' THEN 'content-length=' || original.size || chr(10) || 'content-type=text/html' || chr(10) ELSE 'content-length=0' || chr(10) END
  || 'date=second ' || t::VARCHAR || chr(10) || 'etag=' || etag AS headers
FROM judged
"""

LLM_ORACLE["op4_ngram_join"] = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM listed
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n + b.n AS total, count(*) AS common
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM shared WHERE 100 * common >= 85 * (total - common)
), ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT u, v FROM ways UNION SELECT r.u, w.v FROM reach r JOIN ways w ON r.v = w.u
), lowest AS (
  SELECT u, min(v) AS low FROM reach GROUP BY u
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM sets LEFT JOIN lowest ON doc_id = u
"""

LLM_ORACLE["op5_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    source_size * 2.0::DOUBLE AS top
  FROM totals
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(top) OVER (ORDER BY top / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY top / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), final AS (
  SELECT arg_min(level, {'need': top / weight, 'rank': rank}) AS final FROM levels WHERE top > weight * level
), targets AS (
  SELECT source, source_size, CASE WHEN final IS NULL THEN top ELSE least(top, weight * final) END AS target
  FROM levels CROSS JOIN (SELECT max(final) AS final FROM final)
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized
)
SELECT doc_id, size, source_size, target,
  (least(greatest(floor(target)::BIGINT - start, 0), size) + least(greatest(floor(target)::BIGINT - source_size - start, 0), size))::BIGINT AS taken
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
"""

LLM_ORACLE["op6_decontamination"] = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), item_places AS (
  SELECT item_id, len(w) AS n, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS pos, w FROM items WHERE len(w) > 0
), anchors AS (
  SELECT item_id, n, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS shingle FROM item_places
), weights AS (
  SELECT shingle, 1.0::DOUBLE / count(DISTINCT item_id) AS weight FROM anchors GROUP BY shingle
), doc_places AS (
  SELECT doc_id, len(w) AS size, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS pos, w FROM words WHERE len(w) > 0
), doc_shingles AS (
  SELECT doc_id, size, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS shingle FROM doc_places
), starts AS (
  SELECT DISTINCT d.doc_id, a.n, greatest(least(d.pos - a.pos, d.size - a.n), 0) AS start
  FROM doc_shingles d JOIN (SELECT DISTINCT n, pos, shingle FROM anchors) a ON d.shingle = a.shingle
), window_shingles AS (
  SELECT DISTINCT s.doc_id, s.n, s.start, d.shingle, coalesce(weight, 1.0::DOUBLE) AS weight
  FROM starts s JOIN doc_shingles d ON d.doc_id = s.doc_id AND d.pos >= s.start AND d.pos <= s.start + greatest(s.n - 5, 0)
  LEFT JOIN weights ON weights.shingle = d.shingle
), window_sums AS (
  SELECT doc_id, n, start, sum(weight) AS total FROM window_shingles GROUP BY ALL
), item_shingles AS (
  SELECT DISTINCT item_id, n, shingle FROM anchors
), item_sums AS (
  SELECT item_id, n, sum(weight) AS total FROM item_shingles JOIN weights USING (shingle) GROUP BY ALL
), common AS (
  SELECT w.doc_id, w.n, w.start, i.item_id, sum(w.weight) AS common
  FROM window_shingles w JOIN item_shingles i ON w.shingle = i.shingle AND w.n = i.n GROUP BY ALL
), scored AS (
  SELECT c.doc_id, c.item_id, round(common / (w.total + i.total - common), 6) AS similarity
  FROM common c JOIN window_sums w ON c.doc_id = w.doc_id AND c.n = w.n AND c.start = w.start JOIN item_sums i ON c.item_id = i.item_id
)
SELECT doc_id, item_id, max(similarity) AS similarity FROM scored WHERE similarity >= 0.8 GROUP BY ALL
"""

LLM_ORACLE["op11_ranked_search"] = r"""
WITH doc_terms AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sized AS (
  SELECT doc_id, len(w)::BIGINT AS n FROM doc_terms WHERE len(w) > 0
), corpus AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized
), postings AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM doc_terms) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM postings CROSS JOIN corpus GROUP BY term, docs
), items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), impacts AS (
  SELECT p.doc_id, p.term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))) AS impact
  FROM postings p JOIN sized USING (doc_id) JOIN weights USING (term) CROSS JOIN corpus
), scored AS (
  SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM items JOIN impacts USING (term) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

LLM_ORACLE["op12_conversation_repair"] = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
  ), 4294967295) % 20 AS damage
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE damage <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role)::VARCHAR || ':' || role || text), copy) AS spot FROM damaged
), judged AS (
  SELECT conv_id, turn, role, text, spot, left(role, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY spot) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY spot) AS before
  FROM placed
), kinds AS (
  SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE '-' END AS class, coalesce(fault IN ('blank', 'duplicate'), false) AS goes FROM judged
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(spot) AS rows
  FROM kinds GROUP BY conv_id
), steps(class, origin, target, cost, edits) AS (
  VALUES ('*', 0, 0, 3, 'D'), ('*', 1, 1, 3, 'D'), ('*', 2, 2, 3, 'D'), ('*', 3, 3, 3, 'D'),
    ('*', 0, 2, 2, 'R'), ('*', 1, 2, 2, 'R'), ('*', 2, 3, 2, 'R'), ('*', 3, 2, 2, 'R'),
    ('*', 0, 3, 4, 'IR'), ('*', 1, 3, 4, 'IR'), ('*', 2, 2, 4, 'IR'), ('*', 3, 3, 4, 'IR'),
    ('s', 0, 1, 0, 'K'),
    ('u', 0, 2, 0, 'K'), ('u', 1, 2, 0, 'K'), ('u', 3, 2, 0, 'K'), ('u', 2, 2, 2, 'IK'),
    ('a', 2, 3, 0, 'K'), ('a', 0, 3, 2, 'IK'), ('a', 1, 3, 2, 'IK'), ('a', 3, 3, 2, 'IK')
), paths AS (
  SELECT conv_id, 0::BIGINT AS spot, 0 AS state, '000000' AS path FROM counted
  UNION ALL
  SELECT k.conv_id, k.spot, s.target, min(lpad((left(p.path, 6)::INTEGER + s.cost + CASE WHEN k.fault = 'truncated' AND s.edits <> 'D' THEN 1 ELSE 0 END)::VARCHAR, 6, '0') || substr(p.path, 7) || s.edits)
  FROM paths p JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.spot = p.spot + 1
    JOIN steps s ON s.origin = p.state AND (s.class = '*' OR s.class = k.class) AND (NOT k.goes OR s.edits = 'D')
  GROUP BY k.conv_id, k.spot, s.target
), ended AS (
  SELECT c.conv_id, min(lpad((left(path, 6)::INTEGER + CASE state WHEN 2 THEN 2 WHEN 1 THEN 4 ELSE 0 END)::VARCHAR, 6, '0') || substr(path, 7) || CASE state WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END) AS path
  FROM counted c JOIN paths p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.spot = c.rows GROUP BY c.conv_id
), answers AS (
  SELECT conv_id, left(path, 6)::BIGINT AS cost, substr(path, 7) AS audit FROM ended
), letters AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(length(audit))) AS k FROM answers WHERE audit <> ''
), numbered AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS spot, count(*) FILTER (edit <> 'D') OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), made AS (
  SELECT n.conv_id, n.k, n.edit, n.place, r.role, r.text, max(CASE WHEN n.edit = 'K' AND left(r.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS system
  FROM numbered n LEFT JOIN kinds r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.spot = n.spot AND n.edit <> 'I' WHERE n.edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS whole FROM made GROUP BY conv_id
), every AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM every e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN answers a ON a.conv_id IS NOT DISTINCT FROM e.conv_id
  LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""

LLM_ORACLE["op13_line_dedup"] = r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), listed AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS spot FROM cut
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM listed
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS goes FROM keyed k LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (goes)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
