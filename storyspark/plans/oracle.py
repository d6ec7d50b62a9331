"""The registered queries as SQL for the checking engine, written independently of the Spark plans."""

from __future__ import annotations

from storyspark.functions import fixed_values as fixed
from storyspark.plans import adapters as ad

_K = "json_extract_string(props, '$.k')"


def _view(sql: str, **names: str) -> str:
    for name, table in {"k": _K, **names}.items():
        sql = sql.replace("{" + name + "}", table)
    return sql.replace("{{", "{").replace("}}", "}")


DOCS = f"docs0 AS ({_view(ad.DOCS, documents='documents')})"
STORY_DOCS = f"""{DOCS}, docs AS (
  SELECT *, 'src' || source_id AS source_key, 'src' || source_id || '.example.org' AS source_domain,
    'https://src' || source_id || '.example.org/' || doc_id || CASE WHEN doc_id % 12 = 0 THEN '.pdf' ELSE '' END AS url,
    source_id % 3 + 1 AS tier, source_id % 4 = 0 AS is_official FROM docs0)"""
SOURCES = f"sources AS ({_view(ad.SOURCES, documents='documents')})"


def _matches(docs: str, patterns: dict[str, str], first_no: int = 0) -> str:
    """One row per match with its type number and position."""
    return " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS anchor_type, {no} AS type_no, unnest(m) AS anchor_value, "
        f"generate_subscripts(m, 1) AS pos "
        f"FROM (SELECT doc_id, regexp_extract_all(clean_text, '(?i){pattern}', 0) AS m FROM {docs})"
        for no, (name, pattern) in enumerate(patterns.items(), first_no)
    )


ANCHORS = f"anchors AS ({_matches('docs', fixed.ANCHOR_PATTERNS)})"
BASE = f"WITH RECURSIVE {STORY_DOCS}, {SOURCES}, {ANCHORS}"

WEIGHT = (
    "CASE anchor_type "
    + " ".join(f"WHEN '{name}' THEN {weight}" for name, weight in fixed.ANCHOR_WEIGHTS.items())
    + f" ELSE {fixed.OTHER_ANCHOR_WEIGHT} END"
)
FEATURES = f"""features AS (
  SELECT d.doc_id, least(round(coalesce(sum(CAST({WEIGHT} AS DOUBLE)) FILTER (a.doc_id IS NOT NULL), 0), 6), 10.0) AS evidence_score,
    count(a.doc_id) AS anchors_count, any_value(d.is_official) AS has_official_domain,
    any_value(ends_with(d.url, '.pdf')) AS has_pdf, count(*) FILTER (anchor_type = 'VALOR') AS money_count,
    false AS has_table_like
  FROM docs d LEFT JOIN anchors a ON a.doc_id = d.doc_id GROUP BY d.doc_id)"""

_NORMAL = r"lower(trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g')))"


def _normal(x: str) -> str:
    return _NORMAL.replace("{x}", x)


_KEYWORDS = ", ".join(
    f"('{lane}', '{k}', {fixed.LANE_PRIORITIES.get(lane, fixed.OTHER_LANE_PRIORITY)}, {order})"
    for order, (lane, words) in enumerate(fixed.LANE_KEYWORDS.items())
    for k in words
)
_KNOWN = ", ".join(f"'{lane}'" for lane in (*fixed.LANE_KEYWORDS, *fixed.EXTRA_KNOWN_LANES))


def _keyword_lanes(texts: str) -> str:
    """CTEs giving the best keyword lane per ``key`` of ``texts(key, t)``."""
    return f"""keywords(lane, word, prio, ord) AS (VALUES {_KEYWORDS}),
  hits AS (SELECT key, lane, prio, ord, count(*) AS n FROM {texts}, keywords WHERE contains(t, word)
           GROUP BY key, lane, prio, ord),
  keyword_lane AS (SELECT key, lane FROM hits QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, prio DESC, ord) = 1)"""


LANES = f"""lane_texts AS (SELECT doc_id AS key, {_normal("title || ' ' || clean_text")} AS t FROM docs),
  {_keyword_lanes('lane_texts')},
  lanes AS (SELECT doc_id, coalesce(lane, 'geral') AS lane FROM docs LEFT JOIN keyword_lane ON key = doc_id)"""


def _assignment(key: str = "anchor_value") -> str:
    """Parents by the lowest document sharing an anchor, then the root of every parent chain."""
    return f"""firsts AS (SELECT {key} AS k, min(doc_id) AS first_doc FROM anchors GROUP BY ALL),
  parents AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(f.first_doc), d.doc_id)) AS parent
    FROM docs d LEFT JOIN anchors a ON a.doc_id = d.doc_id LEFT JOIN firsts f ON f.k = a.{key} GROUP BY d.doc_id),
  {_CHAIN}"""


_CHAIN = """chain AS (SELECT doc_id, parent FROM parents
    UNION ALL SELECT c.doc_id, p.parent FROM chain c JOIN parents p ON p.doc_id = c.parent WHERE p.parent < c.parent),
  event_docs AS (SELECT min(c.parent) AS event_id, d.doc_id, any_value(d.source_id) AS source_id, any_value(d.seen_at) AS seen_at,
      min(c.parent) = d.doc_id AS is_primary
    FROM chain c JOIN docs d ON d.doc_id = c.doc_id GROUP BY d.doc_id)"""

ASSIGNED = f"{BASE}, {_assignment()}"

EVENTS = f"""{LANES},
  spans AS (SELECT event_id, min(seen_at) FILTER (is_primary) AS first_seen_at, max(seen_at) AS last_seen_at
    FROM event_docs GROUP BY event_id),
  story_events AS (SELECT event_id, CASE WHEN tier = 1 THEN 'HOT' ELSE 'NEW' END AS status,
      CASE WHEN title = '' THEN 'Novo sinal de pauta em ' || source_domain ELSE title END AS summary, lane,
      CASE WHEN tier = 1 THEN 85.0::DOUBLE ELSE 50.0::DOUBLE END AS breaking_score, first_seen_at, last_seen_at
    FROM spans JOIN docs ON docs.doc_id = event_id JOIN lanes ON lanes.doc_id = event_id)"""

SCORES = f"""{FEATURES}, as_of AS (SELECT max(seen_at) AS t FROM docs),
  source_part AS (SELECT event_id, count(*) AS source_count, min(tier) AS tier, bool_or(is_official) AS official, bool_or(tier = 1) AS tier1
    FROM event_docs JOIN sources USING (source_id) GROUP BY event_id),
  velocity_part AS (SELECT event_id, count(*) FILTER (seen_at >= t - INTERVAL 30 MINUTE) AS velocity FROM event_docs, as_of GROUP BY event_id),
  evidence_part AS (SELECT event_id, max(evidence_score) AS evidence FROM event_docs JOIN features USING (doc_id) GROUP BY event_id),
  inputs AS (SELECT e.*, source_count, tier, official, tier1, velocity, evidence, t,
      exp(-(epoch_us(t) - epoch_us(first_seen_at)) / 3600e6 / 2.0) AS decay
    FROM story_events e JOIN source_part USING (event_id) JOIN velocity_part USING (event_id)
      JOIN evidence_part USING (event_id), as_of),
  scores AS (SELECT event_id, status, summary, lane, first_seen_at, evidence, tier1, t,
      round((10 + (4 - tier) * 2.0 + 5.0 * ln(1 + velocity) + 3.0 * sqrt(source_count)) * decay, 2) AS score,
      round(least((5 + CASE WHEN official THEN 5 ELSE 0 END + CASE WHEN tier1 THEN 0 ELSE 10 END) * (1 + evidence / 5.0), 100.0), 2) AS gap,
      concat_ws('|', CASE WHEN velocity > 5 THEN 'PLANTAO_VELOCITY_SPIKE' END, CASE WHEN tier = 1 THEN 'PLANTAO_TIER_WEIGHT' END,
        CASE WHEN source_count > 2 THEN 'PLANTAO_DIVERSITY' END, CASE WHEN decay < 0.8 THEN 'PLANTAO_DECAY' END) AS breaking_reasons,
      concat_ws('|', CASE WHEN evidence > 3 THEN 'OCEANO_EVIDENCE_STRONG' END, CASE WHEN NOT tier1 THEN 'OCEANO_COVERAGE_LAG' END,
        CASE WHEN official THEN 'OCEANO_OFFICIAL_SOURCE' END) AS gap_reasons
    FROM inputs)"""

STORY = f"{ASSIGNED}, {EVENTS}, {SCORES}"


def _stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


ORACLE: dict[str, str] = {}

ORACLE["anchors"] = f"""WITH {STORY_DOCS}, {ANCHORS}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY type_no, pos) - 1 AS anchor_no, anchor_type, anchor_value FROM anchors"""


def _pointers() -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {no} AS type_no, clean_text, regexp_extract_all(clean_text, '(?i){p}', 0) AS m, "
        f"string_split_regex(clean_text, '(?i){p}') AS g FROM docs"
        for no, p in enumerate(fixed.ANCHOR_PATTERNS.values())
    )
    return f"""WITH {STORY_DOCS}, found AS (SELECT * FROM ({parts}) WHERE len(m) > 0),
  each AS (SELECT *, unnest(m) AS anchor_value, generate_subscripts(m, 1) AS pos FROM found),
  offsets AS (SELECT doc_id, type_no, pos, clean_text, anchor_value,
      CAST(list_sum(list_transform(g[1:pos], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:pos - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM each)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY type_no, pos) - 1 AS anchor_no, anchor_value,
  substr(clean_text, greatest(start - 20, 0) + 1, least(start + length(anchor_value) + 20, length(clean_text)) - greatest(start - 20, 0)) AS evidence_ptr
FROM offsets"""


ORACLE["anchor_ptrs"] = _pointers()

ORACLE["extra_anchors"] = f"""WITH texts AS (
  SELECT page_id AS doc_id, 'Em 05/03/2024 veja https://www.in.gov.br/dou/' || page_id || ' e anexo-' || page_id || '.pdf. ' || url || ' ' || html AS clean_text FROM pages),
  found AS ({_matches('texts', fixed.EXTRA_ANCHOR_PATTERNS)})
SELECT doc_id, anchor_type, anchor_value, count(*) AS n FROM found GROUP BY ALL"""

ORACLE["evidence_features"] = f"WITH {STORY_DOCS}, {ANCHORS}, {FEATURES} SELECT * FROM features"

ORACLE["normalized_text"] = f"SELECT doc_id, sha256({_normal('text')}) AS normalized_sha256 FROM documents"


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _suffix_table() -> str:
    rows = ", ".join(
        f"('{name}', '{s}', {order})"
        for order, (name, suffixes) in enumerate(fixed.CLASS_HOST_SUFFIXES.items())
        for s in suffixes
    )
    tokens = ", ".join(
        f"('{name}', '{t}', {order})"
        for order, (name, words) in enumerate(fixed.CLASS_NAME_TOKENS.items())
        for t in words
    )
    return f"suffixes(class, suffix, ord) AS (VALUES {rows}), tokens(class, token, ord) AS (VALUES {tokens})"


HOSTS = f"hosts AS (SELECT *, lower(split_part(url, '/', 3)) AS host FROM ({_view(ad.HOSTS, pages='pages')}))"

ORACLE["source_class"] = f"""WITH {HOSTS}, {_suffix_table()},
  by_host AS (SELECT page_id, arg_min(class, ord) AS c FROM hosts, suffixes WHERE host = suffix OR ends_with(host, '.' || suffix) GROUP BY page_id),
  by_token AS (SELECT page_id, arg_min(class, ord) AS c FROM hosts, tokens WHERE contains({_normal("name || ' ' || url")}, token) GROUP BY page_id)
SELECT page_id, coalesce(CASE WHEN {_in(_normal('current_class'), fixed.SOURCE_CLASSES)} THEN {_normal('current_class')} END,
  by_host.c, by_token.c, 'other') AS source_class
FROM hosts LEFT JOIN by_host USING (page_id) LEFT JOIN by_token USING (page_id)"""


def _media_group() -> str:
    rows = ", ".join(f"('{g}', '{s}')" for g, ss in fixed.MEDIA_GROUP_HOST_SUFFIXES.items() for s in ss)
    return f"""WITH {HOSTS}, groups(grp, suffix) AS (VALUES {rows}),
  best AS (SELECT page_id, arg_max(grp, length(suffix)) AS g FROM hosts, groups WHERE host = suffix OR ends_with(host, '.' || suffix) GROUP BY page_id)
SELECT page_id, host, g AS media_group, coalesce({_in('g', fixed.MAINSTREAM_MEDIA_GROUPS)}, false) AS is_mainstream
FROM hosts LEFT JOIN best USING (page_id)"""


ORACLE["host_matches"] = f"""WITH hosts AS (SELECT page_id, lower(trim(split_part(url, '/', 3))) AS host FROM ({_view(ad.HOSTS, pages='pages')})),
  suffixes(suffix) AS (VALUES {", ".join(f"('{x}')" for x in fixed.CLASS_HOST_SUFFIXES['primary'])})
SELECT page_id, host, EXISTS (SELECT 1 FROM suffixes WHERE host = suffix OR ends_with(host, '.' || suffix)) AS is_primary FROM hosts"""

ORACLE["media_group"] = _media_group()
ORACLE["media_group_by_table"] = _media_group()

ORACLE["editorial_lane"] = f"WITH {STORY_DOCS}, {LANES} SELECT doc_id, lane FROM lanes"

ORACLE["editorial_lane_hints"] = f"""WITH hints AS ({_view(ad.LANE_HINTS, conversations='conversations')}),
  lane_texts AS (SELECT {{'c': conv_id, 't': turn}} AS key, {_normal('title')} AS t FROM hints), {_keyword_lanes('lane_texts')},
  ready AS (SELECT *, {_normal('explicit_lane')} AS e, replace({_normal('topic')}, ' ', '_') AS tp, replace({_normal('editoria')}, ' ', '_') AS ed,
    {_normal('source_scope')} AS sc FROM hints)
SELECT conv_id, turn, coalesce(CASE WHEN e IN ({_KNOWN}) THEN e END, lane, CASE WHEN tp IN ({_KNOWN}) THEN tp END,
  CASE WHEN ed IN ({_KNOWN}) THEN ed END, CASE WHEN sc IN ('federal', 'estadual', 'municipal') THEN 'politica'
  WHEN sc = 'internacional' THEN 'internacional' END, 'geral') AS lane
FROM ready LEFT JOIN keyword_lane ON key = {{'c': conv_id, 't': turn}}"""

ORACLE["assign_events"] = f"""{ASSIGNED}
SELECT event_id, doc_id, source_id, {_stamp('seen_at')} AS seen_at, is_primary FROM event_docs"""

ORACLE["assign_events_by_type"] = (
    f"WITH RECURSIVE {STORY_DOCS}, {ANCHORS.replace('anchors AS', 'anchors0 AS')}, "
    "anchors AS (SELECT doc_id, anchor_type || ' ' || anchor_value AS typed FROM anchors0), "
    f"{_assignment('typed')} SELECT event_id, doc_id FROM event_docs"
)

ORACLE["assign_events_lookback"] = f"""{BASE},
  placed AS (SELECT a.doc_id, anchor_value, seen_at FROM anchors a JOIN docs USING (doc_id)),
  parents AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(b.doc_id), d.doc_id)) AS parent
    FROM docs d LEFT JOIN placed a ON a.doc_id = d.doc_id
    LEFT JOIN placed b ON b.anchor_value = a.anchor_value AND b.seen_at BETWEEN a.seen_at - INTERVAL 4 HOUR AND a.seen_at
    GROUP BY d.doc_id), {_CHAIN}
SELECT event_id, doc_id FROM event_docs"""

ORACLE["new_events"] = f"""{ASSIGNED}, {EVENTS}
SELECT event_id, status, summary, lane, breaking_score, {_stamp('first_seen_at')} AS first_seen_at,
  {_stamp('last_seen_at')} AS last_seen_at FROM story_events"""

ORACLE["event_velocity"] = f"""{ASSIGNED}
SELECT event_id, count(*) FILTER (seen_at >= (SELECT max(seen_at) FROM docs) - INTERVAL 30 MINUTE) AS velocity
FROM event_docs GROUP BY event_id"""

ORACLE["event_source_stats"] = f"""{ASSIGNED}
SELECT event_id, count(*) AS source_count, min(tier) AS highest_tier, bool_or(is_official) AS has_official, bool_or(tier = 1) AS has_tier1
FROM event_docs JOIN sources USING (source_id) GROUP BY event_id"""

ORACLE["event_distinct_sources"] = f"""{ASSIGNED}
SELECT event_id, count(DISTINCT source_id) AS source_count FROM event_docs JOIN sources USING (source_id) GROUP BY event_id"""

ORACLE["event_evidence"] = f"""{ASSIGNED}, {FEATURES}
SELECT event_id, max(evidence_score) AS max_evidence FROM event_docs JOIN features USING (doc_id) GROUP BY event_id"""

ORACLE["event_scores"] = f"""{STORY}
SELECT event_id, score AS breaking_score, gap AS gap_score, breaking_reasons, gap_reasons, {_stamp('t')} AS computed_at FROM scores"""

ORACLE["alert_candidates"] = f"""{STORY}
SELECT event_id, score AS breaking_score, gap AS gap_score FROM scores WHERE score > 20 OR gap > 20"""


def _feed(where: str, limit: int, story: str = STORY) -> str:
    return f"""{story},
  top AS (SELECT * FROM scores WHERE {where} ORDER BY score DESC, first_seen_at DESC, event_id LIMIT {limit}),
  counted AS (SELECT event_id, anchor_type, anchor_value, count(*) AS n
    FROM top JOIN event_docs USING (event_id) JOIN anchors USING (doc_id) GROUP BY ALL),
  paged AS (SELECT *, ('0x' || substr(md5(anchor_value), 1, 8))::BIGINT % CAST(ceil(count(*) OVER (PARTITION BY event_id) / 1000) AS BIGINT) AS page FROM counted),
  nested AS (SELECT event_id, page, string_agg(anchor_type || ':' || anchor_value || '=' || n, '|' ORDER BY anchor_type, anchor_value) AS anchors
    FROM paged GROUP BY event_id, page),
  sizes AS (SELECT event_id, count(*) AS anchor_count, CAST(sum(n) AS BIGINT) AS mentions FROM counted GROUP BY event_id)
SELECT event_id, status, summary, score, lane, {_stamp('first_seen_at')} AS created_at, coalesce(anchor_count, 0) AS anchor_count,
  coalesce(mentions, 0) AS mentions, coalesce(page, 0) AS anchor_page, coalesce(anchors, '') AS anchors
FROM top LEFT JOIN sizes USING (event_id) LEFT JOIN nested USING (event_id)"""


def _feed_anchors(where: str, limit: int, story: str = STORY) -> str:
    return f"""{story},
  top AS (SELECT * FROM scores WHERE {where} ORDER BY score DESC, first_seen_at DESC, event_id LIMIT {limit})
SELECT event_id, anchor_type, anchor_value, count(*) AS mentions FROM top JOIN event_docs USING (event_id) JOIN anchors USING (doc_id) GROUP BY ALL"""


ORACLE["event_feed"] = _feed("true", 20)
ORACLE["feed_anchors"] = _feed_anchors("true", 100)
ORACLE["event_feed_filtered"] = _feed("status = 'NEW' AND lane = 'tecnologia'", 10)
ORACLE["feed_anchors_filtered"] = _feed_anchors("status = 'NEW' AND lane = 'tecnologia'", 10)

ORACLE["dashboard_counts"] = f"""{ASSIGNED}, {EVENTS}
SELECT (SELECT count(*) FROM sources) AS sources_count, (SELECT count(*) FROM story_events WHERE status = 'HOT') AS events_hot,
  (SELECT count(*) FROM story_events WHERE status = 'NEW') AS events_new, (SELECT count(*) FROM docs) AS docs_count"""

ORACLE["dashboard_cards"] = f"""{STORY},
  top AS (SELECT * FROM scores WHERE status <> 'IGNORED' ORDER BY score DESC, first_seen_at DESC, event_id LIMIT 12),
  named AS (SELECT DISTINCT event_id, anchor_type, anchor_value FROM top JOIN event_docs USING (event_id) JOIN anchors USING (doc_id)),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY anchor_type, anchor_value) AS n FROM named),
  tags AS (SELECT event_id, string_agg(anchor_type || ': ' || substr(anchor_value, 1, 15), '|' ORDER BY n) AS tags FROM numbered WHERE n <= 3 GROUP BY event_id)
SELECT event_id, status, lane, summary, CAST(trunc(score) AS INT) || '%' AS score_label, strftime(first_seen_at, '%H:%M') AS created_label,
  coalesce(tags, '') AS tags
FROM top LEFT JOIN tags USING (event_id)"""

ORACLE["gap_ranking"] = f"""{STORY}
SELECT event_id, status, lane, gap AS gap_score, evidence AS max_evidence, round(1 + evidence / 5.0, 4) AS evidence_multiplier,
  CASE WHEN tier1 THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END AS coverage_lag
FROM scores ORDER BY gap DESC, event_id LIMIT 20"""

# Components by exhaustive reachability: every event reachable over shared anchors.
COMPONENTS = f"""{ASSIGNED},
  held AS (SELECT DISTINCT event_id, anchor_type || ' ' || anchor_value AS anchor FROM anchors JOIN event_docs USING (doc_id)),
  links AS (SELECT DISTINCT a.event_id AS u, b.event_id AS v FROM held a JOIN held b USING (anchor) WHERE a.event_id <> b.event_id),
  reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
  audit AS (SELECT u AS from_event_id, min(v) AS to_event_id FROM reach GROUP BY u HAVING min(v) < u)"""

ORACLE["merge_audit"] = f"""{COMPONENTS},
  shared AS (SELECT h.event_id, count(*) AS n FROM held h
    WHERE (SELECT count(*) FROM held o WHERE o.anchor = h.anchor) > 1 GROUP BY h.event_id)
SELECT from_event_id, to_event_id, 'SHARED_ANCHOR' AS reason_code, n AS shared_anchors,
  {_stamp('(SELECT max(seen_at) FROM docs)')} AS created_at
FROM audit JOIN shared ON event_id = from_event_id"""

# The same, with the members of absorbed events moved to the event that took them in.
CANONICAL = f"""{COMPONENTS.replace("event_docs", "event_docs0")},
  event_docs AS (SELECT coalesce(to_event_id, event_id) AS event_id, doc_id, source_id, seen_at, coalesce(to_event_id, event_id) = doc_id AS is_primary
    FROM event_docs0 LEFT JOIN audit ON from_event_id = event_id)"""
ORACLE["merged_feed"] = _feed("true", 20, f"{CANONICAL}, {EVENTS}, {SCORES}")
ORACLE["merged_feed_anchors"] = _feed_anchors("true", 20, f"{CANONICAL}, {EVENTS}, {SCORES}")

ORACLE["merged_events"] = f"""{COMPONENTS}, {EVENTS}
SELECT event_id, to_event_id AS canonical_event_id, CASE WHEN to_event_id IS NULL THEN status ELSE 'MERGED' END AS status
FROM story_events LEFT JOIN audit ON from_event_id = event_id"""

ORACLE["resolve_redirects"] = """SELECT o_orderkey AS from_event_id, first AS to_event_id
FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders) WHERE o_orderkey > first"""

PROFILES = f"""raw AS ({_view(ad.PROFILES, pages='pages')}),
  profiles AS (SELECT id, domain, url, enabled, CASE WHEN json_valid(fetch_policy_json) THEN fetch_policy_json::JSON END AS j FROM raw),
  parsed AS (SELECT id, domain, enabled, j ->> '$.source_id' AS source_key, coalesce(j ->> '$.source_domain', domain) AS source_domain,
      CAST(j ->> '$.tier' AS INT) AS tier, coalesce(CAST(j ->> '$.is_official' AS BOOLEAN), false) AS is_official,
      coalesce(j ->> '$.lang', 'pt-BR') AS lang, j ->> '$.pool' AS pool, j ->> '$.strategy' AS strategy,
      j -> '$.cadence' AS cadence, j ->> '$.cadence.cron' AS cron, j -> '$.endpoints' AS endpoints,
      coalesce(CAST(j ->> '$.limits.rate_limit_req_per_min' AS INT), 10) AS rate_limit_req_per_min, 1 AS concurrency_per_domain,
      coalesce(CAST(j ->> '$.limits.timeout_seconds' AS INT), 30) AS timeout_seconds,
      coalesce(CAST(j ->> '$.limits.max_bytes' AS BIGINT), 5000000) AS max_bytes, 24 AS starvation_window_hours, true AS baseline_rolling
    FROM profiles),
  checked AS (SELECT *, concat_ws('|', CASE WHEN source_key IS NULL THEN 'source_id_missing' END,
      CASE WHEN coalesce(tier, 0) NOT BETWEEN 1 AND 3 THEN 'tier_out_of_range' END,
      CASE WHEN NOT coalesce({_in('pool', fixed.POOLS)}, false) THEN 'pool_unknown' END,
      CASE WHEN NOT coalesce({_in('strategy', fixed.STRATEGIES)}, false) THEN 'strategy_unknown' END,
      CASE WHEN endpoints IS NULL OR endpoints::VARCHAR = '{{}}' THEN 'endpoints_empty' END,
      CASE WHEN cadence IS NULL THEN 'cadence_missing' END,
      CASE WHEN cron <> '' AND len(string_split(cron, ' ')) <> 5 THEN 'cron_fields' END,
      CASE WHEN timeout_seconds < 1 THEN 'timeout_seconds_too_small' END,
      CASE WHEN max_bytes < 1024 THEN 'max_bytes_too_small' END) AS errors FROM parsed)"""

ORACLE["active_profiles"] = f"""WITH {PROFILES}
SELECT * EXCLUDE (domain, enabled, cadence, endpoints, errors) FROM checked WHERE enabled AND errors = ''"""

ORACLE["rejected_profiles"] = f"WITH {PROFILES} SELECT id, domain, errors FROM checked WHERE enabled AND errors <> ''"

ORACLE["pool_routing"] = f"""WITH {PROFILES}
SELECT CASE pool WHEN 'HEAVY_RENDER_POOL' THEN 'fetch_render' WHEN 'DEEP_EXTRACT_POOL' THEN 'fetch_deep' ELSE 'fetch_fast' END AS queue,
  count(*) AS n FROM checked WHERE enabled AND errors = '' GROUP BY 1"""

ORACLE["endpoint_choice"] = f"""WITH {PROFILES}
SELECT id, coalesce(nullif(endpoints ->> '$.feed', ''), nullif(endpoints ->> '$.latest', ''), nullif(endpoints ->> '$.api', '')) AS fetch_url,
  coalesce(nullif(endpoints ->> '$.feed', ''), nullif(endpoints ->> '$.latest', '')) AS document_url FROM checked"""

_ITEM = """SELECT CAST(floor(doc_id / 10) AS BIGINT) AS feed_id,
  row_number() OVER (PARTITION BY CAST(floor(doc_id / 10) AS BIGINT) ORDER BY doc_id) - 1 AS item_no,
  'Nota ' || doc_id AS title, 'https://news.example.org/' || doc_id AS url, sha256({t}) AS text_sha256 FROM documents"""
ORACLE["rss_items"] = _ITEM.format(t="CASE WHEN doc_id % 3 = 2 THEN '' ELSE text END")
ORACLE["atom_items"] = _ITEM.format(t="text")



def _html_text() -> str:
    """Furniture goes block by block; all articles, else all main blocks, else the body is the text."""
    body = "regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript", "template", "head", "nav", "header", "footer", "aside"):
        body = f"regexp_replace({body}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    inside = r"array_to_string(regexp_extract_all(body, '(?is)<{0}\b[^<>]*>(.*?)</{0}\s*>', 1), chr(10))"
    return rf"""a AS (SELECT page_id, {body} AS body FROM pages),
  b AS (SELECT page_id, coalesce(nullif({inside.format("article")}, ''), nullif({inside.format("main")}, ''), body) AS t FROM a),
  c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is)</t[dh]\s*>\s*<t[dh]\b[^>]*>', ' | ', 'g'),
    '(?is)</?(?:p|div|br|hr|ul|ol|li|dl|dt|dd|h[1-6]|table|thead|tbody|tfoot|tr|td|th|section|article|main|blockquote|pre|figure|figcaption|form)\b[^>]*>', E'\n', 'g'),
    '(?s)<[^>]*>', '', 'g') AS t FROM b),
  d AS (SELECT page_id, replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&') AS t FROM c),
  e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), ' ?(?:\n ?)+', E'\n', 'g'), '^\s+|\s+$', '', 'g') AS t FROM d)"""


HTML_TEXT = _html_text()
ORACLE["html_text"] = f"WITH {HTML_TEXT} SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM e WHERE t <> ''"

# Items of feeds and texts of pages. A body fetched again, or shared with an earlier source, counts once.
ORACLE["ingest_documents"] = f"""WITH {PROFILES}, {HTML_TEXT},
  active AS (SELECT c.*, url AS page_url, html FROM checked c JOIN pages ON page_id = id WHERE c.enabled AND errors = ''),
  chosen AS (SELECT id, source_domain, strategy, endpoints, CASE WHEN strategy = 'RSS' THEN 'feed' || least(id, (SELECT max(doc_id) // 10 + 1 FROM documents)) ELSE html END AS body FROM active),
  firsts AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY body ORDER BY id) = 1),
  items AS (SELECT id, source_domain, 'https://news.example.org/' || doc_id AS url, 'Nota ' || doc_id AS title, doc_id % 10 AS item_no,
      CASE WHEN doc_id % 3 = 2 THEN '' ELSE text END AS t FROM firsts JOIN documents ON doc_id // 10 = id WHERE strategy = 'RSS'
    UNION ALL SELECT id, source_domain, coalesce(nullif(endpoints ->> '$.feed', ''), nullif(endpoints ->> '$.latest', '')),
      'Sugestão de Pauta: ' || source_domain, 0, t FROM firsts JOIN e ON page_id = id WHERE strategy <> 'RSS' AND t <> '')
SELECT id * 33554432 + item_no AS doc_id, id AS source_id, url, title, length(t) AS n_chars, sha256(t) AS content_hash FROM items"""

# Pages and feed items, each body with a source of its own, through the whole main path.
FETCHED = f"""{HTML_TEXT},
  named AS (
    SELECT page_id * 2 AS source_id, 0 AS item_no, '' AS title, NULL::VARCHAR AS link, t AS clean_text FROM e WHERE t <> ''
    UNION ALL SELECT (doc_id // 10) * 2 + 1, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1, 'Nota ' || doc_id,
      'https://news.example.org/' || doc_id, CASE WHEN (doc_id // 10) % 2 = 0 AND doc_id % 3 = 2 THEN '' ELSE text END FROM documents),
  docs AS (SELECT source_id * 16777216 + item_no AS doc_id, source_id, 'src' || source_id AS source_key, 'src' || source_id || '.example.org' AS source_domain,
      title, coalesce(link, 'https://src' || source_id || '.example.org') AS url, clean_text, source_id % 3 + 1 AS tier, source_id % 4 = 0 AS is_official,
      TIMESTAMP '2024-01-01 00:00:00' + source_id * INTERVAL '1' MINUTE AS seen_at FROM named),
  sources AS (SELECT DISTINCT source_id, tier, is_official FROM docs)"""
ORACLE["fetch_to_feed"] = _feed("true", 50, STORY.replace(f"{STORY_DOCS}, {SOURCES}", FETCHED))
ORACLE["fetch_to_feed_anchors"] = _feed_anchors("true", 50, STORY.replace(f"{STORY_DOCS}, {SOURCES}", FETCHED))

ORACLE["table_text"] = r"""WITH lines AS (SELECT conv_id, turn, list_transform(string_split(text, E'\n'),
    lambda l: array_to_string(list_filter(string_split(l, ' '), lambda c: c <> ''), ' | ')) AS l FROM conversations)
SELECT conv_id, turn, sha256(E'\n[TABLE]\n' || array_to_string(list_filter(l, lambda x: x <> ''), E'\n') || E'\n[/TABLE]\n') AS table_sha256 FROM lines"""

ORACLE["body_hash"] = "SELECT page_id, sha256(html) AS content_hash FROM pages"

ORACLE["fetch_log"] = """SELECT page_id AS source_id, url, 200 AS status_code, CAST(trunc(page_id % 977 / 311.0::DOUBLE * 1000) AS INT) AS latency_ms,
  CAST(length(html) AS INT) AS bytes, 'FAST_POOL' AS pool, sha256(html) AS snapshot_hash,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' SECOND, '%Y-%m-%d %H:%M:%S') AS attempted_at FROM pages"""

ORACLE["snapshot_dedup"] = f"""WITH {STORY_DOCS}, bodies AS (
  SELECT d.doc_id, seen_at, sha256(text) AS h FROM docs d JOIN documents USING (doc_id)),
  late AS (SELECT * FROM bodies WHERE hour(seen_at) >= 12)
SELECT h AS snapshot_hash, 'https://news.example.org/' || arg_min(doc_id, (seen_at, doc_id)) AS url,
  {_stamp('min(seen_at)')} AS fetched_at, count(*) AS copies
FROM late WHERE h NOT IN (SELECT h FROM bodies WHERE hour(seen_at) < 12) GROUP BY h"""

ORACLE["document_records"] = f"""WITH {STORY_DOCS}
SELECT doc_id, source_id, CASE WHEN doc_id % 3 > 0 THEN url ELSE 'https://' || source_domain || '/latest' END AS url,
  CASE WHEN doc_id % 4 > 0 AND title <> '' THEN title ELSE 'Sugestão de Pauta: ' || source_domain END AS title,
  length(clean_text) AS n_chars, sha256(clean_text) AS content_hash, sha256(clean_text) AS body_hash, 1 AS version_no
FROM docs"""

ORACLE["score_upsert"] = """SELECT user_id AS event_id, value AS breaking_score, epoch_us(ts) AS computed_at_us FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) = 1"""

ORACLE["score_mirror"] = f"{STORY} SELECT event_id, status, score AS breaking_score FROM scores"

ORACLE["draft_export"] = f"""{ASSIGNED}, {FEATURES},
  first_anchor AS (SELECT doc_id, arg_min(anchor_value, (type_no, pos)) AS a FROM anchors GROUP BY doc_id)
SELECT event_id, CASE WHEN d.doc_id % 5 > 0 THEN title END AS title, 'DRAFT' AS status, sha256(clean_text) AS body_sha256,
  source_key AS provenance, a AS first_anchor, evidence_score, {_stamp('d.seen_at')} AS timeline_at,
  '2024-03-01T00:00:00+00:00' AS created_at,
  CASE WHEN d.doc_id % 3 > 0 AND d.doc_id % 10 < 7 THEN 'true' END AS needs_review,
  CASE WHEN d.doc_id % 3 > 0 AND d.doc_id % 10 < 7 THEN 'Low confidence in automated extraction' END AS review_reason
FROM event_docs e JOIN docs d ON d.doc_id = e.doc_id JOIN features f ON f.doc_id = d.doc_id LEFT JOIN first_anchor x ON x.doc_id = d.doc_id
WHERE is_primary"""

FEEDBACK = f"feedback AS ({_view(ad.FEEDBACK, events='events')})"
ORACLE["feedback_log"] = f"""WITH {FEEDBACK}
SELECT feedback_id, event_id, action, coalesce(payload_json ->> '$.user_id', 'anonymous') AS actor,
  {_in('action', fixed.FEEDBACK_ACTIONS)} AS is_valid FROM feedback"""

ORACLE["feedback_ignored_events"] = f"""{ASSIGNED}, {EVENTS}, {FEEDBACK}
SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM feedback WHERE action = 'IGNORE') THEN 'IGNORED' ELSE status END AS status
FROM story_events"""

_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda x: x <> '')"


def _tokens(t: str) -> str:
    return _TOKENS.replace("{t}", t)


ORACLE["tokens"] = f"""WITH t AS (SELECT doc_id, {_tokens('text')} AS w FROM documents)
SELECT doc_id, len(w) AS n_tokens, sha256(array_to_string(w, ' ')) AS tokens_sha256 FROM t"""

_BITS = ", ".join(
    f"sum(CASE WHEN (h >> {i}) & 1 = 1 THEN 1 ELSE -1 END) AS b{i}" for i in range(64)
)
_FOLD = " + ".join(f"CASE WHEN b{i} > 0 THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))
SIMHASH = f"""words AS (SELECT doc_id, unnest({_tokens('text')}) AS w FROM documents),
  hashed AS (SELECT doc_id, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS h FROM words),
  votes AS (SELECT doc_id, count(*) AS n, {_BITS} FROM hashed GROUP BY doc_id),
  folded AS (SELECT doc_id, n, {_FOLD} AS u FROM votes),
  simhashes AS (SELECT d.doc_id, CAST(coalesce(CASE WHEN u >= {1 << 63}::HUGEINT THEN u - {1 << 64}::HUGEINT ELSE u END, 0) AS BIGINT) AS simhash,
    coalesce(n, 0) AS token_count FROM documents d LEFT JOIN folded USING (doc_id))"""
ORACLE["simhash"] = f"WITH {SIMHASH} SELECT * FROM simhashes"

_GROUPS = "groups AS (SELECT simhash, min(doc_id) AS doc_id, count(*) AS copies FROM simhashes WHERE token_count > 0 GROUP BY simhash)"
ORACLE["duplicate_groups"] = f"WITH {SIMHASH}, {_GROUPS} SELECT * FROM groups"

ORACLE["duplicate_members"] = f"""WITH {SIMHASH}, {_GROUPS}
SELECT s.doc_id, g.doc_id AS group_id FROM simhashes s JOIN groups g ON s.simhash = g.simhash WHERE s.token_count > 0"""

ORACLE["near_dup_groups"] = f"""WITH RECURSIVE {SIMHASH}, {_GROUPS},
  near AS (SELECT a.doc_id AS u, b.doc_id AS v FROM groups a JOIN groups b ON bit_count(xor(a.simhash, b.simhash)) <= 3),
  reach AS (SELECT u, v FROM near UNION SELECT r.u, n.v FROM reach r JOIN near n ON r.v = n.u),
  lowest AS (SELECT u, min(v) AS low FROM reach GROUP BY u)
SELECT s.doc_id, low AS group_id FROM simhashes s JOIN groups g ON s.simhash = g.simhash JOIN lowest ON u = g.doc_id WHERE s.token_count > 0"""

ORACLE["near_dup_pairs"] = f"""WITH {SIMHASH}, {_GROUPS}
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.copies AS copies_a, b.copies AS copies_b,
  1 - bit_count(xor(a.simhash, b.simhash)) / 64.0::DOUBLE AS similarity
FROM groups a JOIN groups b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.simhash, b.simhash)) <= 3"""

ORACLE["turn_jaccard"] = f"""WITH t AS (SELECT conv_id, turn, list_distinct({_tokens('text')}) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0
  ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE END, 9) AS jaccard
FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"""

ORACLE["jaccard_pairs"] = f"""WITH t AS (SELECT doc_id, list_sort(list_distinct({_tokens('text')})) AS w FROM documents),
  sets AS (SELECT min(doc_id) AS id, count(*) AS copies, w FROM t WHERE len(w) > 0 GROUP BY w),
  words AS (SELECT id, len(w) AS n, unnest(w) AS token FROM sets),
  shared AS (SELECT a.id AS x, b.id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common
    FROM words a JOIN words b ON a.token = b.token AND a.id < b.id GROUP BY a.id, b.id)
SELECT x AS doc_a, y AS doc_b, a.copies AS copies_a, b.copies AS copies_b, round(common / (nx + ny - common)::DOUBLE, 9) AS jaccard
FROM shared JOIN sets a ON a.id = x JOIN sets b ON b.id = y WHERE common / (nx + ny - common)::DOUBLE >= 0.6"""

ORACLE["bm25_top"] = f"""WITH {DOCS}, t AS (SELECT doc_id, {_tokens('clean_text')} AS w FROM docs0),
  sizes AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
  tf AS (SELECT doc_id, len(w) AS length, term, len(list_filter(w, lambda x: x = term)) AS tf
    FROM t, (VALUES ('acórdão'), ('portaria'), ('processo'), ('the')) q(term)),
  df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term)
SELECT doc_id, length, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS bm25
FROM tf JOIN df USING (term), sizes GROUP BY doc_id, length HAVING sum(tf) > 0 ORDER BY bm25 DESC, doc_id LIMIT 20"""

VERSIONS = f"""{STORY_DOCS}, {ANCHORS}, held AS (SELECT doc_id, list(DISTINCT anchor_value) AS anchors FROM anchors GROUP BY doc_id),
  versions AS (SELECT v.*, coalesce(anchors, []) AS anchors FROM ({_view(ad.VERSIONS, docs='docs0')}) v LEFT JOIN held USING (doc_id)),
  pairs AS (SELECT url, lag(version_no) OVER w AS from_version, version_no AS to_version, lag(anchors) OVER w AS a0, anchors AS a1,
      lag(value) OVER w AS v0, value AS v1, lag(time) OVER w AS t0, time AS t1
    FROM versions WINDOW w AS (PARTITION BY url ORDER BY version_no) QUALIFY lag(version_no) OVER w IS NOT NULL)"""
_ADDED = "array_to_string(list_sort(list_filter(a1, lambda x: NOT list_contains(a0, x))), '|')"
_REMOVED = "array_to_string(list_sort(list_filter(a0, lambda x: NOT list_contains(a1, x))), '|')"
ORACLE["anchor_delta"] = f"WITH {VERSIONS} SELECT url, from_version, to_version, {_ADDED} AS added, {_REMOVED} AS removed FROM pairs"
ORACLE["value_delta"] = f"""WITH {VERSIONS} SELECT url, from_version, to_version, CASE WHEN v0 IS DISTINCT FROM v1 THEN v0 END AS from_value,
  CASE WHEN v0 IS DISTINCT FROM v1 THEN v1 END AS to_value,
  CASE WHEN v0 IS DISTINCT FROM v1 THEN coalesce(v1, 0) - coalesce(v0, 0) END AS diff FROM pairs"""


def _iso(t: str) -> str:
    """What Python's ``isoformat`` gives: six digits of a second unless it is whole, and the offset."""
    digits = f"lpad((epoch_us({t}) % 1000000)::VARCHAR, 6, '0')"
    return f"strftime({t}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({t}) % 1000000 = 0 THEN '' ELSE '.' || {digits} END || '+00:00'"


ORACLE["temporal_delta"] = f"""WITH {VERSIONS} SELECT url, from_version, to_version,
  CASE WHEN t0 IS DISTINCT FROM t1 THEN {_iso('t0')} END AS previous_time,
  CASE WHEN t0 IS DISTINCT FROM t1 THEN {_iso('t1')} END AS new_time,
  CASE WHEN t0 IS DISTINCT FROM t1 THEN t1 > t0 END AS is_postponed FROM pairs"""
ORACLE["full_delta"] = f"""WITH {VERSIONS} SELECT url, from_version, to_version, {_ADDED} AS added,
  v0 IS DISTINCT FROM v1 AS value_changed, t0 IS DISTINCT FROM t1 AS time_changed FROM pairs"""

STATES = f"states AS ({_view(ad.STATES, events='events')})"
_OVERDUE = "(epoch_us({now}) - epoch_us(started_at)) / 1e6 > CASE WHEN pool = 'FAST_POOL' THEN 60 ELSE 120 END"
ORACLE["state_step"] = f"""WITH {STATES} SELECT event_id, status, CASE WHEN status = 'NEW' THEN 'HYDRATING'
  WHEN status = 'HYDRATING' AND {_OVERDUE.format(now='ts')} THEN 'PARTIAL_ENRICH' ELSE status END AS next_status FROM states"""
_NOW = "(SELECT max(ts) FROM events)"
ORACLE["state_transitions"] = f"""WITH {STATES}, stepped AS (SELECT event_id, status AS old_status,
    CASE WHEN status = 'NEW' THEN 'HYDRATING' WHEN status = 'HYDRATING' AND {_OVERDUE.format(now=_NOW)} THEN 'PARTIAL_ENRICH'
      WHEN status = 'QUARANTINE' AND {_NOW} > started_at + INTERVAL 15 MINUTE THEN 'EXPIRED' ELSE status END AS status FROM states)
SELECT *, CASE old_status WHEN 'NEW' THEN 'hydration started' WHEN 'HYDRATING' THEN 'hydration timeout' ELSE 'quarantine expired' END AS status_reason
FROM stepped WHERE status <> old_status"""
ORACLE["quarantine_flags"] = f"WITH {STATES} SELECT event_id, value < 20 AND source_count >= 2 AS is_quarantine FROM states"
ORACLE["viral_flags"] = f"WITH {STATES} SELECT event_id, value > 50 AND source_count >= 3 AS is_viral FROM states"
ORACLE["quarantine_expiry"] = f"""WITH {STATES} SELECT event_id,
  CASE WHEN status = 'QUARANTINE' AND ts + INTERVAL 14 MINUTE > started_at + INTERVAL 15 MINUTE THEN 'EXPIRED' ELSE status END AS status FROM states"""

FETCHES = f"fetches AS ({_view(ad.FETCHES, events='events')})"
ORACLE["yield_starvation"] = f"""WITH {FETCHES} SELECT source_id, {_stamp("date_trunc('day', attempted_at)")} AS window_start, count(*) AS attempts
FROM fetches GROUP BY source_id, date_trunc('day', attempted_at) HAVING bool_and(status_code = 200) AND sum(yield_count) = 0"""
ORACLE["yield_baseline"] = f"""WITH {FETCHES}, slots AS (SELECT source_id, date_trunc('hour', attempted_at) AS slot, count(*) AS n, sum(yield_count) AS y
    FROM fetches GROUP BY ALL)
SELECT s.source_id, {_stamp('s.slot')} AS slot, any_value(s.n) AS attempts, round(any_value(s.y / s.n::DOUBLE), 6) AS mean_yield,
  round(sum(p.y) / sum(p.n)::DOUBLE, 6) AS baseline_yield
FROM slots s LEFT JOIN slots p ON p.source_id = s.source_id AND dayofweek(p.slot) = dayofweek(s.slot) AND hour(p.slot) = hour(s.slot)
  AND p.slot < s.slot AND p.slot >= s.slot - INTERVAL 28 DAY
GROUP BY s.source_id, s.slot"""
ORACLE["slo_p95"] = f"""WITH {FETCHES}, p AS (SELECT pool, count(*) AS attempts, quantile_disc(latency_ms, 0.95) AS p95_ms FROM fetches GROUP BY pool)
SELECT *, p95_ms > CASE pool WHEN 'FAST_POOL' THEN 60000 WHEN 'HEAVY_RENDER_POOL' THEN 120000 ELSE 300000 END AS is_breach FROM p"""
ORACLE["fetch_errors"] = f"""WITH {FETCHES} SELECT source_id, pool, count(*) AS attempts, count(*) FILTER (status_code BETWEEN 400 AND 499) AS client_errors,
  count(*) FILTER (status_code >= 500) AS server_errors FROM fetches GROUP BY ALL"""

OBSERVED = f"""observations AS ({_view(ad.OBSERVATIONS, events='events')}),
  hashed AS (SELECT *, sha256(event_id || '|' || status) AS alert_hash FROM observations),
  candidates AS MATERIALIZED (SELECT * FROM hashed WINDOW w AS (PARTITION BY event_id ORDER BY observed_at, observation_id)
    QUALIFY gate AND lag(alert_hash) OVER w IS DISTINCT FROM alert_hash)"""
ORACLE["alert_transitions"] = f"WITH {OBSERVED} SELECT event_id, observation_id, alert_hash FROM candidates"


def _sent(cooldown: str) -> str:
    """Alerts one after the other: the first of an event, then always the next one after the cooldown."""
    return f"""onward AS MATERIALIZED (SELECT a.event_id, a.observed_at, min(b.observed_at) AS next_at
    FROM candidates a LEFT JOIN candidates b ON b.event_id = a.event_id AND b.observed_at >= a.observed_at + INTERVAL {cooldown}
    GROUP BY a.event_id, a.observed_at),
  sent AS (SELECT event_id, min(observed_at) AS sent_at FROM candidates GROUP BY event_id
    UNION ALL SELECT s.event_id, o.next_at FROM sent s JOIN onward o ON o.event_id = s.event_id AND o.observed_at = s.sent_at WHERE o.next_at IS NOT NULL)"""


ORACLE["alert_cooldown"] = f"""WITH RECURSIVE {OBSERVED}, {_sent('1 HOUR')}
SELECT s.event_id, min(observation_id) AS observation_id, epoch_us(sent_at + INTERVAL 1 HOUR) AS cooldown_until_us
FROM sent s JOIN candidates c ON c.event_id = s.event_id AND c.observed_at = s.sent_at GROUP BY s.event_id, sent_at"""

ORACLE["change_feed"] = f"""{COMPONENTS}, {EVENTS}, {SCORES},
  fresh AS (SELECT e.event_id, e.status, to_event_id, s.score <> breaking_score AS touched
    FROM story_events e JOIN scores s USING (event_id) LEFT JOIN audit ON from_event_id = e.event_id)
SELECT event_id, CASE WHEN to_event_id IS NOT NULL THEN 'EVENT_MERGED' ELSE 'EVENT_UPSERT' END AS change,
  CASE WHEN to_event_id IS NOT NULL THEN 'MERGED' ELSE status END AS status, to_event_id AS target_event_id
FROM fresh WHERE to_event_id IS NOT NULL OR touched"""

_COUNTS = ", ".join(f"count(*) FILTER (action = '{a}') AS n_{a.lower()}" for a in fixed.FEEDBACK_ACTIONS)
_VALID = _in("action", fixed.FEEDBACK_ACTIONS)
ORACLE["feedback_stats"] = f"""{ASSIGNED}, {EVENTS}, {FEEDBACK}
SELECT lane, count(*) AS n_actions, {_COUNTS}, round(count(*) FILTER (action = 'IGNORE') / count(*)::DOUBLE, 9) AS ignored_rate
FROM feedback JOIN story_events USING (event_id) WHERE {_VALID} GROUP BY lane"""
ORACLE["feedback_stats_merged"] = f"""{CANONICAL}, {EVENTS}, {FEEDBACK},
  led AS (SELECT coalesce(to_event_id, event_id) AS event_id, action FROM feedback LEFT JOIN audit ON from_event_id = event_id)
SELECT lane, count(*) AS n_actions, {_COUNTS}, round(count(*) FILTER (action = 'IGNORE') / count(*)::DOUBLE, 9) AS ignored_rate
FROM led JOIN story_events USING (event_id) WHERE {_VALID} GROUP BY lane"""
ORACLE["feedback_stats_by_source"] = f"""{ASSIGNED}, {FEEDBACK}
SELECT source_id, count(*) AS n_actions, {_COUNTS}, round(count(*) FILTER (action = 'IGNORE') / count(*)::DOUBLE, 9) AS ignored_rate
FROM feedback JOIN event_docs e USING (event_id) WHERE is_primary AND {_VALID} GROUP BY source_id"""

_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
ORACLE["stream_velocity"] = f"""WITH minutes AS (SELECT user_id % 5 AS event_id, date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY ALL),
  slid AS (SELECT event_id, m - back * INTERVAL 1 MINUTE AS w, n FROM minutes, range(30) r(back))
SELECT event_id, {_stamp('w')} AS window_start, sum(n)::BIGINT AS velocity FROM slid
WHERE w + INTERVAL 30 MINUTE <= {_CLOSED} GROUP BY event_id, w"""
ORACLE["stream_starvation"] = f"""WITH {FETCHES} SELECT source_id, {_stamp("date_trunc('day', attempted_at)")} AS window_start, count(*) AS attempts
FROM fetches WHERE date_trunc('day', attempted_at) + INTERVAL 1 DAY <= {_CLOSED}
GROUP BY source_id, date_trunc('day', attempted_at) HAVING bool_and(status_code = 200) AND sum(yield_count) = 0"""
ORACLE["stream_first_fetches"] = "SELECT DISTINCT sha256(text) AS snapshot_hash FROM documents"
ORACLE["timed_transitions"] = f"""WITH states AS ({_view(ad.STATES.replace("event_id, ts", "event_id, user_id, ts"), events='events')}),
  log AS (SELECT user_id % 20 AS event_id, status, ts AS began, lead(ts) OVER (PARTITION BY user_id % 20 ORDER BY ts) AS next_at,
      ts + CASE WHEN status = 'QUARANTINE' THEN INTERVAL 15 MINUTE WHEN pool = 'FAST_POOL' THEN INTERVAL 1 MINUTE ELSE INTERVAL 2 MINUTE END AS deadline
    FROM states)
SELECT event_id, status AS old_status, CASE status WHEN 'HYDRATING' THEN 'PARTIAL_ENRICH' ELSE 'EXPIRED' END AS status, epoch_us(deadline) AS at_us
FROM log WHERE status IN ('HYDRATING', 'QUARANTINE') AND began <= {_CLOSED} AND deadline < least(coalesce(next_at, {_CLOSED}), {_CLOSED})"""
ORACLE["stream_state_timeouts"] = ORACLE["timed_transitions"]
ORACLE["stream_alerts"] = ORACLE["alert_cooldown"]

ORACLE["incremental_events"] = ORACLE["assign_events"]
ORACLE["incremental_new_events"] = ORACLE["new_events"]

ORACLE["stream_ingest"] = ORACLE["anchors"]
ORACLE["stream_events"] = ORACLE["assign_events"]
ORACLE["stream_changes"] = """WITH rows AS (SELECT user_id % 20 AS event_id, CASE WHEN event_type = 'view' THEN event_id % 3 END AS target,
    CASE WHEN event_type = 'view' THEN 'MERGED' ELSE event_type END AS status, floor(value / 50) AS score, ts FROM events),
  seen AS (SELECT *, row_number() OVER w AS k, lag(status) OVER w AS status0, lag(target) OVER w AS target0, lag(score) OVER w AS score0
    FROM rows WINDOW w AS (PARTITION BY event_id ORDER BY ts, status, score)),
  told AS (SELECT event_id, status, CASE WHEN status = 'MERGED' THEN target END AS target_event_id,
    CASE WHEN k > 1 AND status = 'MERGED' AND (status <> status0 OR target IS DISTINCT FROM target0) THEN 'EVENT_MERGED'
      WHEN k > 1 AND status <> status0 THEN 'EVENT_STATE_CHANGED'
      WHEN k = 1 OR score <> score0 OR target IS DISTINCT FROM target0 THEN 'EVENT_UPSERT' END AS change FROM seen)
SELECT event_id, change, status, target_event_id, count(*) AS n FROM told WHERE change IS NOT NULL GROUP BY ALL"""
ORACLE["enabled_sources"] = f"WITH {SOURCES} SELECT source_id, tier, is_official FROM sources WHERE enabled"

ORACLE["tfidf_terms"] = f"""WITH {DOCS}, words AS (SELECT doc_id, unnest({_tokens('clean_text')}) AS term FROM docs0),
  counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
  freq AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
  weighed AS (SELECT doc_id, term, tf, df, round(tf * ln(((SELECT count(*) FROM docs0) + 1) / (df + 1)::DOUBLE), 6) AS tfidf FROM counts JOIN freq USING (term))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS rank, term, tf, df, tfidf FROM weighed QUALIFY rank <= 5"""

_MINIMA = " || '|' || ".join(
    f"min((h * (2 * {i} * {i} * 104729 + 2 * {i} + 1) + {i} * 15485863) % 4294967311)::VARCHAR" for i in range(1, 17)
)
ORACLE["minhash"] = f"""WITH {DOCS}, words AS (SELECT doc_id, unnest({_tokens('clean_text')}) AS w FROM docs0),
  hashed AS (SELECT doc_id, ('0x' || substr(md5(w), 25, 8))::BIGINT AS h FROM words)
SELECT doc_id, {_MINIMA} AS minhash FROM hashed GROUP BY doc_id"""

ORACLE["yield_baseline_calendar"] = f"""WITH {FETCHES}, slots AS (SELECT source_id, date_trunc('hour', attempted_at) AS slot, count(*) AS n, sum(yield_count) AS y
    FROM fetches GROUP BY ALL),
  named AS (SELECT *, CASE WHEN source_id % 3 = 2 THEN 'none' WHEN day(slot) = 1 THEN 'holiday' WHEN isodow(slot) >= 6 THEN 'weekend'
    WHEN source_id % 3 = 0 AND hour(slot) BETWEEN 9 AND 17 OR source_id % 3 = 1 AND hour(slot) BETWEEN 6 AND 11 THEN 'work' ELSE 'off' END AS period FROM slots)
SELECT s.source_id, {_stamp('s.slot')} AS slot, any_value(s.period) AS period, any_value(s.n) AS attempts, round(any_value(s.y / s.n::DOUBLE), 6) AS mean_yield,
  round(sum(p.y) / sum(p.n)::DOUBLE, 6) AS baseline_yield
FROM named s LEFT JOIN named p ON p.source_id = s.source_id AND p.period = s.period AND p.slot < s.slot AND p.slot >= s.slot - INTERVAL 28 DAY
GROUP BY s.source_id, s.slot"""

ORACLE["velocity_at_arrival"] = f"""{ASSIGNED}
SELECT a.event_id, a.doc_id, count(*) AS velocity FROM event_docs a JOIN event_docs b
  ON a.event_id = b.event_id AND b.seen_at <= a.seen_at AND b.seen_at >= a.seen_at - INTERVAL 30 MINUTE GROUP BY ALL"""

ORACLE["redirects_as_of"] = """WITH RECURSIVE moves AS (SELECT user_id % 40 AS f, ts, max(CAST(floor((user_id % 40) * (event_id % 7) / 7) AS BIGINT)) AS target
    FROM events WHERE event_type = 'signup' AND user_id % 40 > 0 GROUP BY ALL),
  periods AS (SELECT *, lead(ts) OVER (PARTITION BY f ORDER BY ts) AS ended FROM moves),
  readers AS (SELECT event_id AS reader_id, event_id % 45 AS event_id, ts FROM events WHERE event_type <> 'signup'),
  walk AS (SELECT reader_id, event_id AS at, ts FROM readers
    UNION SELECT w.reader_id, p.target, w.ts FROM walk w JOIN periods p ON p.f = w.at AND p.ts <= w.ts AND (p.ended IS NULL OR p.ended > w.ts))
SELECT reader_id, any_value(r.event_id) AS event_id, min(w.at) AS target_event_id FROM walk w JOIN readers r USING (reader_id) GROUP BY reader_id"""

ORACLE["deferred_merges"] = f"""{COMPONENTS} SELECT from_event_id, to_event_id FROM audit"""
ORACLE["score_upsert_by_bucket"] = ORACLE["score_upsert"]

ORACLE["bm25_join"] = f"""WITH {DOCS}, sized AS (SELECT doc_id, {_tokens('clean_text')} AS tokens FROM docs0),
  total AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM sized),
  counted AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM sized),
  tfs AS (SELECT doc_id, length, term, count(*) AS tf FROM counted GROUP BY ALL),
  weights AS (SELECT term, ln(1.0::DOUBLE + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tfs CROSS JOIN total GROUP BY term, n),
  asked AS (SELECT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark),
  scored AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS bm25
    FROM asked JOIN tfs USING (term) JOIN weights USING (term) CROSS JOIN total GROUP BY ALL),
  ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id)::INTEGER AS rank, doc_id, bm25 FROM scored WHERE bm25 > 0)
SELECT * FROM ranked WHERE rank <= 10"""

ORACLE["minhash_groups"] = f"""WITH RECURSIVE {DOCS}, sets AS (SELECT doc_id, list_distinct({_tokens('clean_text')}) AS s FROM docs0),
  items AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
  shared AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n + b.n AS total, count(*) AS common FROM items a JOIN items b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT u, v FROM shared WHERE common / (total - common)::DOUBLE >= 0.8),
  reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
  least_of AS (SELECT u, min(v) AS low FROM reach GROUP BY u)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS group_id FROM sets LEFT JOIN least_of ON u = doc_id"""
