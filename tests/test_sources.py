"""Profiles, feeds, pages, fetch records and document records."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from storyspark.plans.ingest import documents_from_fetches
from storyspark.sources import feeds, fetches, html, profiles
from storyspark.sources.seeds import seed_sources

GOOD = {
    "source_id": "s",
    "tier": 1,
    "pool": "FAST_POOL",
    "strategy": "RSS",
    "endpoints": {"feed": "https://x/feed"},
    "cadence": {"interval_seconds": 60},
}


def source_rows(spark, policies):
    rows = [(i, "x.org", "X", 1, False, "pt-BR", p if isinstance(p, str) else json.dumps(p), True) for i, p in enumerate(policies)]
    return spark.createDataFrame(
        rows,
        "id bigint, domain string, name string, tier int, is_official boolean, lang string, fetch_policy_json string, enabled boolean",
    )


BROKEN = [
    ({**GOOD, "tier": 4}, "tier_out_of_range"),
    ({**GOOD, "endpoints": {}}, "endpoints_empty"),
    ({**GOOD, "cadence": {"cron": "* * * *"}}, "cron_fields"),
    ({**GOOD, "pool": "SLOW"}, "pool_unknown"),
    ({**GOOD, "strategy": "FAX"}, "strategy_unknown"),
    ({**GOOD, "limits": {"timeout_seconds": 0}}, "timeout_seconds_too_small"),
    ({**GOOD, "limits": {"max_bytes": 1023}}, "max_bytes_too_small"),
    ({**GOOD, "observability": {"starvation_window_hours": 0}}, "starvation_window_hours_too_small"),
    ({k: v for k, v in GOOD.items() if k != "source_id"}, "source_id_missing"),
    ({k: v for k, v in GOOD.items() if k != "cadence"}, "cadence_missing"),
    ('{"source_id": ', "source_id_missing"),
]


def test_broken_profiles_are_rejected(spark):
    got = {r.id: r.errors for r in profiles.rejected_profiles(source_rows(spark, [p for p, _ in BROKEN])).collect()}
    assert set(got) == set(range(len(BROKEN)))
    for i, (_, code) in enumerate(BROKEN):
        assert code in got[i]
        assert i == len(BROKEN) - 1 or got[i] == [code]


def test_defaults(spark):
    given = {**GOOD, "source_domain": "y.org", "lang": "en", "limits": {"max_bytes": 2048}, "cadence": {"cron": ""}}
    rows = profiles.active_profiles(source_rows(spark, [GOOD, given])).orderBy("id").collect()
    first, second = rows
    assert (first.source_domain, first.lang, first.is_official) == ("x.org", "pt-BR", False)
    assert (first.rate_limit_req_per_min, first.concurrency_per_domain, first.timeout_seconds, first.max_bytes) == (10, 1, 30, 5_000_000)
    assert (first.starvation_window_hours, first.baseline_rolling, first.headers, first.yield_keys) == (24, True, {}, [])
    assert (second.source_domain, second.lang, second.max_bytes) == ("y.org", "en", 2048)


def test_seeds(spark):
    rows = profiles.active_profiles(seed_sources(spark)).collect()
    assert len(rows) == 8 and {r.tier for r in rows} == {1}
    assert sum("feed" in r.endpoints for r in rows) == 5
    assert not any(r.is_official for r in rows)
    queues = profiles.active_profiles(seed_sources(spark)).select(profiles.fetch_queue(F.col("pool")).alias("q"))
    assert sorted(r.q for r in queues.collect()) == ["fetch_deep"] + ["fetch_fast"] * 7


def test_endpoints(spark):
    maps = [{"feed": "f", "latest": "l"}, {"feed": "", "latest": "l"}, {"api": "a"}, {}]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m map<string,string>")
    got = df.select(
        profiles.fetch_url(F.col("m")).alias("f"), profiles.document_url(F.lit(None), F.col("m")).alias("d")
    ).collect()
    assert [(r.f, r.d) for r in got] == [("f", "f"), ("l", "l"), ("a", None), (None, None)]


RSS = (
    '<?xml version="1.0"?><rss version="2.0"><channel><title>T</title>'
    "<item><title>A &amp; B</title><link>https://x/1</link><description><![CDATA[<p>um</p>]]></description></item>"
    "<item><link>https://x/2</link><summary>dois</summary><description>d</description></item>"
    "<item><title>C</title></item></channel></rss>"
)
WANT_RSS = [("A & B", "https://x/1", "<p>um</p>"), (None, "https://x/2", "dois"), ("C", None, "")]


def test_rss_bodies_and_files(spark, tmp_path):
    one = '<rss><channel><item><title>only</title><description>d</description></item></channel></rss>'
    df = spark.createDataFrame([(1, RSS), (2, one), (3, "<rss><channel></channel></rss>")], "feed_id int, body string")
    rows = feeds.rss_items(df).orderBy("feed_id", "item_no").collect()
    assert [(r.title, r.url, r.text) for r in rows if r.feed_id == 1] == WANT_RSS
    assert [(r.title, r.text) for r in rows if r.feed_id != 1] == [("only", "d")]
    (tmp_path / "feed.xml").write_text(RSS)
    rows = feeds.scan_rss_files(spark, str(tmp_path)).collect()
    assert sorted((r.title or "", r.url, r.text) for r in rows) == sorted((t or "", u, x) for t, u, x in WANT_RSS)


def test_atom(spark):
    body = (
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title><link href="https://x/1"/>'
        "<summary>s</summary></entry><entry><title>u</title></entry></feed>"
    )
    rows = feeds.atom_items(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r.item_no, r.title, r.url, r.text) for r in rows] == [(0, "t", "https://x/1", "s"), (1, "u", None, "")]


PAGES = [
    ("<p>a<p>b<br>c", "a\nb\nc"),
    ("<html><head><title>t</title></head><body><nav>n</nav><main><p>m</p></main><p>o</p></body></html>", "m"),
    ("<body><header>h</header><article class='x'><h1>T</h1><!-- c --><p>1 <b>2</b>3</p></article><p>o</p><footer>f</footer>", "T\n1 23"),
    ('<script>var t="<p>no</p>";</script><STYLE>p{}</STYLE><p>yes</p>', "yes"),
    ("<table><tr><td>a</td> <td>b</td></tr><tr><th>c</th></tr></table>", "a | b\nc"),
    ("a &amp;lt; b &lt;c&gt; &#231;&#xE3;o &eacute;&ccedil; &unknown; &copy R&D &#128512;", "a &lt; b <c> ção éç &unknown; &copy R&D 😀"),
    ("<article></article><nav>x</nav>", None),
    ("<!-- only -->", None),
]


def test_html_main_text(spark):
    df = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(PAGES)], "page_id int, url string, html string")
    got = {r.page_id: r.text for r in html.page_items(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES) if t}


def test_fetch_records_and_snapshots(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "u1", "ção", 200, 0.2999, "FAST_POOL", t0)]
    df = spark.createDataFrame(
        rows, "source_id bigint, url string, body string, status_code int, elapsed_s double, pool string, attempted_at timestamp"
    )
    (row,) = fetches.fetch_records(df).collect()
    assert (row.latency_ms, row.bytes, len(row.snapshot_hash)) == (299, 3, 64)
    fetched = spark.createDataFrame(
        [(1, "a", "x", t0 + dt.timedelta(hours=1)), (2, "b", "x", t0), (3, "c", "y", t0), (4, "d", "z", t0)],
        "fetch_id bigint, url string, body string, fetched_at timestamp",
    )
    history = spark.createDataFrame([("z",)], "body string").select(fetches.body_hash(F.col("body")).alias("snapshot_hash"))
    got = {r.fetch_id: (r.url, r.copies) for r in fetches.new_snapshots(fetched, history).collect()}
    assert got == {2: ("b", 2), 3: ("c", 1)}


def test_document_records(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, 1, "x.org", {"latest": "l"}, None, "", "ã" * 10_050, "h", t0), (2, 1, "x.org", {}, "T", "u", "t", "h", t0)],
        "doc_id bigint, source_id bigint, source_domain string, endpoints map<string,string>, title string, item_url string, "
        "text string, body_hash string, seen_at timestamp",
    )
    first, second = fetches.document_records(df).orderBy("doc_id").collect()
    assert (first.title, first.url, len(first.clean_text), first.version_no) == ("Sugestão de Pauta: x.org", "l", 10_050, 1)
    assert (second.title, second.url, second.clean_text) == ("T", "u", "t")


def test_documents_from_fetches(spark):
    t0 = dt.datetime(2024, 1, 1)
    rss = {**GOOD, "endpoints": {"latest": "https://x/latest"}}
    page = {**GOOD, "strategy": "HTML", "endpoints": {"latest": "https://y/latest"}}
    active = profiles.active_profiles(source_rows(spark, [rss, page]))
    html_body = "<article><p>texto</p></article>"
    rows = [(1, 0, RSS), (2, 0, RSS), (3, 1, html_body), (4, 1, "<nav>x</nav>"), (5, 7, html_body)]
    fetched = spark.createDataFrame(
        [(n, s, "u", b, t0 + dt.timedelta(minutes=n)) for n, s, b in rows],
        "fetch_id bigint, source_id bigint, url string, body string, fetched_at timestamp",
    )
    got = [tuple(r) for r in documents_from_fetches(fetched, active).orderBy("doc_id").select("doc_id", "url", "title", "clean_text").collect()]
    default = "Sugestão de Pauta: x.org"
    assert got == [
        (2**24, "https://x/1", "A & B", "<p>um</p>"),
        (2**24 + 1, "https://x/2", default, "dois"),
        (2**24 + 2, "https://x/latest", "C", ""),
        (3 * 2**24, "https://y/latest", default, "texto"),
    ]
    assert documents_from_fetches(fetched, active, skip_known=False).count() == 7
    history = spark.createDataFrame([(RSS,)], "body string").select(fetches.body_hash(F.col("body")).alias("snapshot_hash"))
    assert documents_from_fetches(fetched, active, history).count() == 1


@pytest.mark.parametrize("path", ["/shared/ckpt", "/shared/ckpt/"])
def test_stage_folder_comes_from_the_session(spark, path):
    from storyspark import session

    class Context:
        master, applicationId = "yarn", "app-1"

        def __init__(self, conf):
            self.conf = conf

        def getConf(self):
            return self.conf

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}

        def __init__(self, conf):
            self.sparkContext = Context(conf)

    assert session.stage_root(Session({"spark.checkpoint.dir": path})) == "/shared/ckpt/storyspark-stage/app-1"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.stage_root(Session({}))
    assert "/storyspark-stage/" in session.stage_root(spark)
