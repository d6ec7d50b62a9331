"""Views that shape the test tables like the pipeline's inputs.

The test text holds no Brazilian identifiers, so the views derive some from the row ids. The SQL below runs
unchanged on Spark and on the checking engine. Nothing outside tests, benchmarks and the registered queries
uses this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed

DOCS = """
SELECT doc_id, CAST(substr(source, 4) AS INT) AS source_id, substr(text, 1, 80) AS title, lang,
  TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS seen_at,
  concat(text,
   CASE WHEN doc_id % 3 = 0 THEN concat(' CNPJ 12.', lpad(CAST(CAST(floor(doc_id / 50) AS BIGINT) % 1000 AS VARCHAR(9)), 3, '0'),
        '.678/0001-', lpad(CAST(CAST(floor(doc_id / 50) AS BIGINT) % 97 AS VARCHAR(9)), 2, '0'), ' ') ELSE '' END,
   CASE WHEN doc_id % 5 = 0 THEN concat(' processo ', lpad(CAST(CAST(floor(doc_id / 200) AS BIGINT) AS VARCHAR(9)), 7, '0'), '-12.2024.8.26.0100 ') ELSE '' END,
   CASE WHEN doc_id % 7 = 0 THEN concat(' R$ ', CAST(doc_id % 90 + 10 AS VARCHAR(9)), '.000,00 ') ELSE '' END,
   CASE WHEN doc_id % 11 = 0 THEN concat(' PL ', CAST(doc_id AS VARCHAR(9)), '/2024 ') ELSE '' END,
   CASE WHEN doc_id % 13 = 0 THEN concat(' ACÓRDÃO ', CAST(doc_id % 17 AS VARCHAR(9)), '/2023 ') ELSE '' END,
   CASE WHEN doc_id % 17 = 0 THEN ' Portaria nº 12/2024 ' ELSE '' END,
   CASE WHEN doc_id % 19 = 0 THEN ' SEI 12345.000001/2024-11 ' ELSE '' END,
   CASE WHEN doc_id % 23 = 0 THEN ' CPF 111.222.333-44 ' ELSE '' END) AS clean_text
FROM {documents}
"""

SOURCES = """
SELECT DISTINCT CAST(substr(source, 4) AS INT) AS source_id, CAST(substr(source, 4) AS INT) % 3 + 1 AS tier,
  CAST(substr(source, 4) AS INT) % 4 = 0 AS is_official, CAST(substr(source, 4) AS INT) % 10 <> 9 AS enabled
FROM {documents}
"""

# ``{k}`` reads the integer k out of the JSON column; the two engines name that function differently.
FETCHES = """
SELECT event_id AS attempt_id, user_id AS source_id, ts AS attempted_at,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, CAST(floor(value * 10) AS INT) AS latency_ms,
  CASE user_id % 3 WHEN 0 THEN 'FAST_POOL' WHEN 1 THEN 'HEAVY_RENDER_POOL' ELSE 'DEEP_EXTRACT_POOL' END AS pool,
  CASE WHEN user_id % 25 = 0 THEN 0 ELSE CAST({k} AS INT) END AS yield_count
FROM {events}
"""

FEEDBACK = """
SELECT event_id AS feedback_id, CAST(floor(event_id / 7) AS BIGINT) AS event_id,
  CASE event_type WHEN 'click' THEN 'PAUTAR' WHEN 'view' THEN 'SNOOZE' WHEN 'error' THEN 'IGNORE'
                  WHEN 'signup' THEN 'MERGE' ELSE 'publish' END AS action,
  CASE WHEN event_id % 4 = 0 THEN '{{"note": "x"}}' ELSE concat('{{"user_id": "u', CAST(user_id AS VARCHAR(9)), '"}}') END AS payload_json,
  ts AS created_at
FROM {events}
"""

# One source profile per page, some of them broken in each way the validator knows.
PROFILES = """
SELECT page_id AS id, split_part(url, '/', 3) AS domain, concat('Fonte ', CAST(page_id AS VARCHAR(9))) AS name, url,
  page_id % 10 <> 9 AS enabled,
  CASE WHEN page_id % 31 = 30 THEN '{{"source_id": ' ELSE concat('{{',
    CASE WHEN page_id % 29 = 28 THEN '' ELSE concat('"source_id": "s', CAST(page_id AS VARCHAR(9)), '", ') END,
    CASE WHEN page_id % 2 = 0 THEN '"source_domain": "fixed.example.org", ' ELSE '' END,
    '"tier": ', CAST(page_id % 4 + CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS VARCHAR(9)), ', ',
    CASE WHEN page_id % 5 = 0 THEN '"is_official": true, ' ELSE '' END,
    CASE WHEN page_id % 7 = 0 THEN '"lang": "en", ' ELSE '' END,
    '"pool": "', CASE page_id % 7 WHEN 0 THEN 'HEAVY_RENDER_POOL' WHEN 1 THEN 'DEEP_EXTRACT_POOL' WHEN 2 THEN 'SLOW' ELSE 'FAST_POOL' END, '", ',
    '"strategy": "', CASE page_id % 8 WHEN 0 THEN 'HTML' WHEN 1 THEN 'PDF' WHEN 2 THEN 'FAX' ELSE 'RSS' END, '", ',
    '"endpoints": {{', CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('"feed": "", "latest": "', url, '/l"')
        WHEN 2 THEN concat('"api": "', url, '/a"') ELSE concat('"feed": "', url, '/f"') END, '}}, ',
    CASE WHEN page_id % 23 = 22 THEN '' ELSE concat('"cadence": {{',
      CASE page_id % 5 WHEN 0 THEN '"cron": "0 * * * *"' WHEN 1 THEN '"cron": "0 * * *"' WHEN 2 THEN '"cron": ""' ELSE '"interval_seconds": 60' END, '}}, ') END,
    '"limits": {{', CASE page_id % 9 WHEN 0 THEN '"timeout_seconds": 0' WHEN 1 THEN '"max_bytes": 1023' WHEN 2 THEN '"rate_limit_req_per_min": 5' ELSE '' END, '}}',
    '}}') END AS fetch_policy_json
FROM {pages}
"""

# Versions of a page: five consecutive documents of one source are versions of the same address.
VERSIONS = """
SELECT doc_id, concat('https://news.example.org/', CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR(9)), '/', CAST(source_id AS VARCHAR(9))) AS url,
  CAST(floor((doc_id % 100) / 20) AS BIGINT) + 1 AS version_no,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 7 AS DOUBLE) END AS value,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE TIMESTAMP '2024-03-01 00:00:00' + doc_id % 5 * INTERVAL '1' HOUR + doc_id % 3 * INTERVAL '0.25' SECOND END AS time,
  clean_text
FROM {docs}
"""

# Events with a state: one per fetch record.
STATES = """
SELECT event_id, ts, value,
  CASE event_type WHEN 'click' THEN 'NEW' WHEN 'view' THEN 'HYDRATING' WHEN 'error' THEN 'QUARANTINE'
                  WHEN 'signup' THEN 'HOT' ELSE 'HYDRATING' END AS status,
  CASE user_id % 3 WHEN 0 THEN 'FAST_POOL' WHEN 1 THEN 'HEAVY_RENDER_POOL' ELSE 'DEEP_EXTRACT_POOL' END AS pool,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts - user_id * INTERVAL '1' SECOND END AS started_at,
  user_id % 5 AS source_count
FROM {events}
"""

# Repeated observations of few events: their status, and whether a score passes the alert gate.
OBSERVATIONS = """
SELECT user_id % 5 AS event_id, event_id AS observation_id, ts AS observed_at, event_type AS status, value * 3 > 30 AS gate
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; timestamps without zone become UTC timestamps."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A text table, spread over all cores when it is too small a file to be split by the scan.

    A table of many files or row groups already has more scan tasks than cores and is left as it is.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DOCS, documents=text_table(spark, sf_dir, "documents", "doc_id"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SOURCES, documents=table(spark, sf_dir, "documents"))


def events_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of FETCHES, FEEDBACK, STATES and OBSERVATIONS."""
    k = "get_json_object(props, '$.k')"
    return spark.sql(sql.replace("{k}", k), events=table(spark, sf_dir, "events"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROFILES, pages=table(spark, sf_dir, "pages"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VERSIONS, docs=docs(spark, sf_dir))


def latest(df: DataFrame, column: str) -> Column:
    """The greatest value of a column as a scalar subquery: the tests' ``as_of``."""
    return df.agg(F.max(column)).scalar()


def _host_case() -> str:
    """Hosts from the taxonomy lists and some look-alikes, chosen by ``page_id``."""
    known = [s for suffixes in fixed.CLASS_HOST_SUFFIXES.values() for s in suffixes]
    grouped = [s for suffixes in fixed.MEDIA_GROUP_HOST_SUFFIXES.values() for s in suffixes]
    hosts = known + ["WWW." + s for s in grouped] + ["notgov.br.example.com", "xglobo.com", "a.b.jota.info"]
    whens = " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(hosts))
    return f"CASE page_id % {len(hosts) + 20} {whens} ELSE split_part(url, '/', 3) END"


HOSTS = f"""
SELECT page_id, concat('https://', {_host_case()}, '/x') AS url,
  CASE page_id % 9 WHEN 0 THEN 'Poder360' WHEN 1 THEN 'Prefeitura de X' WHEN 2 THEN 'Brasil de  Fato' WHEN 3 THEN 'Terra' ELSE 'x' END AS name,
  CASE page_id % 41 WHEN 0 THEN ' Competitor ' WHEN 1 THEN 'unknown' ELSE NULL END AS current_class
FROM {{pages}}
"""

LANE_HINTS = """
SELECT conv_id, turn,
  CASE (conv_id + turn) % 9 WHEN 0 THEN 'Hardnews ' WHEN 1 THEN 'geral' WHEN 2 THEN 'Politica' ELSE NULL END AS explicit_lane,
  CASE (conv_id + turn) % 7 WHEN 0 THEN 'Meio  Ambiente' WHEN 1 THEN 'nada' ELSE NULL END AS topic,
  CASE (conv_id + turn) % 5 WHEN 0 THEN 'Direitos Humanos' ELSE NULL END AS editoria,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'Federal' WHEN 1 THEN 'internacional' WHEN 2 THEN 'mundo' ELSE NULL END AS source_scope,
  CASE WHEN turn % 3 = 0 THEN text ELSE NULL END AS title
FROM {conversations}
"""


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HOSTS, pages=table(spark, sf_dir, "pages"))


def lane_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LANE_HINTS, conversations=table(spark, sf_dir, "conversations"))
