"""The registered queries. Each takes ``(spark, sf_dir)`` and reads the tables in that folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.functions import anchors as anchor_columns
from storyspark.functions import fixed_values as fixed
from storyspark.functions import states as state_rules
from storyspark.functions import taxonomy, text
from storyspark.operators import minhash as minhashes
from storyspark.operators import (
    alerts,
    assign,
    calendars,
    changes,
    deferred,
    evidence,
    feed,
    health,
    merge,
    neardup,
    redirects,
    scoring,
    search,
    similar,
    states,
    suffixes,
    velocity,
    versions,
)
from storyspark.operators.hotkeys import with_next, with_previous
from storyspark.operators.incremental import EventStore
from storyspark.plans import adapters as ad
from storyspark.plans.ingest import documents_from_fetches, story_documents
from storyspark.plans.story import StoryTables, assign_facts, build_story, document_facts, with_lane
from storyspark.session import new_stage_path, stage
from storyspark.sinks import tables
from storyspark.sinks.bucketed import BucketTable
from storyspark.sources import feeds, fetches, html, profiles
from storyspark.streaming import ingest, runner, sketches, timers, windows

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def joined(array: Column | str) -> Column:
    """Array of strings as one string, so that results compare as scalars."""
    return F.array_join(array, "|")


def stamp(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# --- shared inputs ---


def story_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the source columns that ingest takes from the source profile."""
    number = F.col("source_id").cast("string")
    pdf = F.when(F.col("doc_id") % 12 == 0, F.lit(".pdf")).otherwise(F.lit(""))
    return ad.docs(spark, sf_dir).withColumns(
        {
            "source_key": F.concat(F.lit("src"), number),
            "source_domain": F.concat(F.lit("src"), number, F.lit(".example.org")),
            "url": F.concat(F.lit("https://src"), number, F.lit(".example.org/"), F.col("doc_id"), pdf),
            "tier": F.col("source_id") % 3 + 1,
            "is_official": F.col("source_id") % 4 == 0,
        }
    )


def story(spark: SparkSession, sf_dir: str) -> StoryTables:
    return build_story(story_docs(spark, sf_dir), ad.sources(spark, sf_dir))


def assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Document facts, their anchors and their events."""
    facts = document_facts(story_docs(spark, sf_dir))
    return facts, *assign_facts(facts)


# --- anchors and evidence ---


@query
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.extract_anchors(ad.docs(spark, sf_dir)).select(
        "doc_id", F.col("anchor_no").cast("bigint").alias("anchor_no"), "anchor_type", "anchor_value"
    )


@query
def anchor_ptrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.extract_anchors(ad.docs(spark, sf_dir), with_context=True).select(
        "doc_id", F.col("anchor_no").cast("bigint").alias("anchor_no"), "anchor_value", "evidence_ptr"
    )


@query
def extra_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, government links and PDF links, over page sources and their addresses."""
    pages = ad.text_table(spark, sf_dir, "pages", "page_id")
    extra = F.concat(
        F.lit("Em 05/03/2024 veja https://www.in.gov.br/dou/"), "page_id", F.lit(" e anexo-"), "page_id", F.lit(".pdf. ")
    )
    docs = pages.select(F.col("page_id").alias("doc_id"), F.concat(extra, "url", F.lit(" "), "html").alias("clean_text"))
    return (
        evidence.extract_anchors(docs, extra_types=True)
        .filter(F.col("anchor_type").isin(*fixed.EXTRA_ANCHOR_PATTERNS))
        .groupBy("doc_id", "anchor_type", "anchor_value")
        .agg(F.count("*").alias("n"))
    )


@query
def evidence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.evidence_features(story_docs(spark, sf_dir))


# --- taxonomy ---


@query
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.text_table(spark, sf_dir, "documents", "doc_id")
    return docs.select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("normalized_sha256"))


@query
def source_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.hosts(spark, sf_dir)
    return rows.select(
        "page_id", taxonomy.source_class(F.col("name"), F.col("url"), F.col("current_class")).alias("source_class")
    )


@query
def host_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages under one of the official domains."""
    hosts = ad.hosts(spark, sf_dir).select("page_id", text.url_host(F.col("url")).alias("host"))
    suffixes = fixed.CLASS_HOST_SUFFIXES["primary"]
    return hosts.select("page_id", "host", taxonomy.host_matches_any(F.col("host"), suffixes).alias("is_primary"))


@query
def media_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = taxonomy.media_group(text.url_host(F.col("url")))
    return ad.hosts(spark, sf_dir).select(
        "page_id",
        text.url_host(F.col("url")).alias("host"),
        group.alias("media_group"),
        taxonomy.is_mainstream(group).alias("is_mainstream"),
    )


def media_group_table(spark: SparkSession) -> DataFrame:
    """The media groups' host suffixes as a table, the form in which an operator of any number of hosts keeps them."""
    rows = [(suffix, group) for group, listed in fixed.MEDIA_GROUP_HOST_SUFFIXES.items() for suffix in listed]
    return spark.createDataFrame(rows, "suffix string, media_group string")


@query
def media_group_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``media_group`` with the suffixes as data."""
    hosts = ad.hosts(spark, sf_dir).select("page_id", text.url_host(F.col("url")).alias("host"))
    found = suffixes.longest_suffix(hosts, media_group_table(spark))
    return found.withColumn("is_mainstream", taxonomy.is_mainstream(F.col("media_group")))


@query
def editorial_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_lane(story_docs(spark, sf_dir)).select("doc_id", "lane")


@query
def editorial_lane_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules behind keywords: explicit lane, topic, editoria and scope."""
    rows = ad.lane_hints(spark, sf_dir)
    columns = {c: F.col(c) for c in ("explicit_lane", "topic", "editoria", "source_scope", "title")}
    return rows.select("conv_id", "turn", taxonomy.editorial_lane(**columns).alias("lane"))


# --- events and scores ---


@query
def assign_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, event_docs = assigned(spark, sf_dir)
    return event_docs.select("event_id", "doc_id", "source_id", stamp("seen_at").alias("seen_at"), "is_primary")


#: Buckets of the tables that the queries store events in, for the few gigabytes of a test; a lasting store takes more.
STORE_BUCKETS = 8


def event_store(spark: SparkSession, sf_dir: str, batches: int = 4) -> EventStore:
    """All documents stored in several batches by their id."""
    facts = document_facts(story_docs(spark, sf_dir))
    rows = stage(evidence.explode_anchors(facts), "anchors")
    first, last = facts.agg(F.min("doc_id"), F.max("doc_id")).first()
    store = EventStore(spark, new_stage_path(spark, "event-store"), n_buckets=STORE_BUCKETS)
    for k in range(batches):
        low, high = (first + (last + 1 - first) * i // batches for i in (k, k + 1))
        inside = F.col("doc_id").between(low, high - 1)
        store.add(facts.filter(inside), rows.filter(inside), ad.sources(spark, sf_dir), k, ad.latest(facts, "seen_at"))
    return store


@query
def incremental_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``assign_events``, found batch by batch against what is stored."""
    return event_store(spark, sf_dir).event_docs().select("event_id", "doc_id", "source_id", stamp("seen_at").alias("seen_at"), "is_primary")


@query
def incremental_new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_store(spark, sf_dir).events().select(
        "event_id", "status", "summary", "lane", "breaking_score", stamp("first_seen_at").alias("first_seen_at"), stamp("last_seen_at").alias("last_seen_at")
    )


@query
def assign_events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = document_facts(story_docs(spark, sf_dir))
    rows = evidence.explode_anchors(facts)
    return assign.assign_events(facts, rows, match_on=("anchor_type", "anchor_value")).select("event_id", "doc_id")


@query
def assign_events_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = document_facts(story_docs(spark, sf_dir))
    rows = evidence.explode_anchors(facts)
    return assign.assign_events(facts, rows, lookback_seconds=4 * 3600).select("event_id", "doc_id")


@query
def new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, event_docs = assigned(spark, sf_dir)
    return assign.build_events(event_docs).select(
        "event_id",
        "status",
        "summary",
        "lane",
        "breaking_score",
        stamp("first_seen_at").alias("first_seen_at"),
        stamp("last_seen_at").alias("last_seen_at"),
    )


@query
def event_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, event_docs = assigned(spark, sf_dir)
    return scoring.event_velocity(event_docs, ad.latest(docs, "seen_at"))


@query
def velocity_at_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The velocity of its event when each document came."""
    _, _, event_docs = assigned(spark, sf_dir)
    return velocity.velocity_at_arrival(event_docs)


@query
def event_source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, event_docs = assigned(spark, sf_dir)
    return scoring.event_source_stats(event_docs, ad.sources(spark, sf_dir))


@query
def event_distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, event_docs = assigned(spark, sf_dir)
    return scoring.event_source_stats(event_docs, ad.sources(spark, sf_dir), distinct_sources=True).select(
        "event_id", "source_count"
    )


@query
def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, _, event_docs = assigned(spark, sf_dir)
    metrics = scoring.event_metrics(event_docs, ad.sources(spark, sf_dir), ad.latest(facts, "seen_at"))
    return metrics.select("event_id", "max_evidence")


@query
def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return story(spark, sf_dir).scores.select(
        "event_id",
        "breaking_score",
        "gap_score",
        joined("reasons.breaking").alias("breaking_reasons"),
        joined("reasons.gap").alias("gap_reasons"),
        stamp("computed_at").alias("computed_at"),
    )


@query
def alert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with a threshold that the test data can reach."""
    return scoring.alert_candidates(story(spark, sf_dir).scores, threshold=20.0).select(
        "event_id", "breaking_score", "gap_score"
    )


# --- feed ---


def _feed(built: StoryTables, **filters) -> DataFrame:
    rows = feed.event_feed(built.scored_events(), built.event_docs, built.anchors, **filters)
    label = F.transform("anchors", lambda a: F.concat_ws("=", F.concat_ws(":", a["type"], a["value"]), a["mentions"].cast("string")))
    return rows.withColumn("created_at", stamp("created_at")).withColumn("anchors", joined(label))


def _feed_anchors(built: StoryTables, **filters) -> DataFrame:
    return feed.feed_anchors(built.scored_events(), built.event_docs, built.anchors, **filters)


@query
def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(story(spark, sf_dir))


@query
def feed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All anchors of the hundred best events."""
    return _feed_anchors(story(spark, sf_dir), limit=100)


@query
def event_feed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(story(spark, sf_dir), status="NEW", lane="tecnologia", limit=10)


@query
def feed_anchors_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed_anchors(story(spark, sf_dir), status="NEW", lane="tecnologia", limit=10)


def merged_story(spark: SparkSession, sf_dir: str) -> StoryTables:
    return build_story(story_docs(spark, sf_dir), ad.sources(spark, sf_dir), merge=True)


@query
def merged_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed of canonical events."""
    return _feed(merged_story(spark, sf_dir))


@query
def merged_feed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed_anchors(merged_story(spark, sf_dir))


def fetched_bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(bodies, profiles)``: every page and, in turn as RSS and Atom, every feed, each with a source of its own."""
    pages = ad.text_table(spark, sf_dir, "pages", "page_id").select((F.col("page_id") * 2).alias("source_id"), F.col("html").alias("body"), F.lit("HTML").alias("strategy"))
    kinds = (feed_bodies(spark, sf_dir).filter("feed_id % 2 = 0"), feed_bodies(spark, sf_dir, atom=True).filter("feed_id % 2 = 1"))
    feeds_ = kinds[0].unionByName(kinds[1]).select((F.col("feed_id") * 2 + 1).cast("bigint").alias("source_id"), "body", F.lit("RSS").alias("strategy"))
    rows = pages.unionByName(feeds_)
    bodies = rows.select(F.col("source_id").alias("fetch_id"), "source_id", "body", F.timestamp_seconds(F.lit(1704067200) + F.col("source_id") * 60).alias("fetched_at"))
    number = F.col("source_id").cast("string")
    domain = F.concat(F.lit("src"), number, F.lit(".example.org"))
    sources = rows.select(
        F.col("source_id").alias("id"),
        domain.alias("source_domain"),
        "strategy",
        F.create_map(F.lit("latest"), F.concat(F.lit("https://"), domain)).alias("endpoints"),
        F.concat(F.lit("src"), number).alias("source_key"),
        (F.col("source_id") % 3 + 1).cast("int").alias("tier"),
        (F.col("source_id") % 4 == 0).alias("is_official"),
    )
    return bodies, sources


def fetched_story(spark: SparkSession, sf_dir: str) -> StoryTables:
    """From fetched bodies to scored events: records, anchors, events and scores of all pages and all feed items."""
    bodies, sources = fetched_bodies(spark, sf_dir)
    records = documents_from_fetches(bodies, sources, skip_known=False)
    return build_story(story_documents(records, sources), sources.withColumnRenamed("id", "source_id"))


@query
def fetch_to_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(fetched_story(spark, sf_dir), limit=50)


@query
def fetch_to_feed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed_anchors(fetched_story(spark, sf_dir), limit=50)


@query
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, event_docs = assigned(spark, sf_dir)
    return feed.dashboard_counts(
        ad.sources(spark, sf_dir), assign.build_events(event_docs), docs
    )


@query
def dashboard_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = story(spark, sf_dir)
    cards = feed.dashboard_cards(built.scored_events(), built.event_docs, built.anchors)
    return cards.withColumn("tags", joined("tags"))


@query
def gap_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = story(spark, sf_dir)
    return feed.gap_ranking(built.events, built.scores).withColumn(
        "evidence_multiplier", F.round("evidence_multiplier", 4)
    )


@query
def merge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found, event_docs = assigned(spark, sf_dir)
    return merge.merge_audit(event_docs, found, ad.latest(docs, "seen_at")).select(
        "from_event_id",
        "to_event_id",
        "reason_code",
        F.get_json_object("evidence_json", "$.shared_anchors").cast("bigint").alias("shared_anchors"),
        stamp("created_at").alias("created_at"),
    )


@query
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found, event_docs = assigned(spark, sf_dir)
    audit = merge.merge_audit(event_docs, found, ad.latest(docs, "seen_at"))
    events = assign.build_events(event_docs)
    return merge.apply_merges(events, audit).select("event_id", "canonical_event_id", "status")


@query
def resolve_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long merge chains: every order was absorbed by the previous order of its customer."""
    orders = ad.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    previous = with_previous(
        orders, ["o_custkey"], "o_orderkey", F.floor(F.col("o_orderkey") / 100_000), F.struct("o_orderkey"), "previous"
    )
    audit = previous.filter("previous IS NOT NULL").select(
        F.col("o_orderkey").alias("from_event_id"), F.col("previous.o_orderkey").alias("to_event_id")
    )
    return merge.resolve_redirects(audit)


@query
def deferred_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merges of ``merge_audit``, found in four batches of documents and applied when the last ones are due."""
    _, rows, event_docs = assigned(spark, sf_dir)
    first, last = event_docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    store = deferred.MergeStore(spark, new_stage_path(spark, "merge-store"), n_buckets=STORE_BUCKETS)
    for k in range(4):
        low, high = (first + (last + 1 - first) * i // 4 for i in (k, k + 1))
        inside = F.col("doc_id").between(low, high - 1)
        store.add(event_docs.filter(inside), rows.filter(inside), k, F.timestamp_seconds(F.lit(k * 3600)))
    return store.applied(F.timestamp_seconds(F.lit(3 * 3600 + deferred.TOLERANCE_S)))


@query
def redirects_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an event stood for when each view of it was logged, while merges send it to one target after the other."""
    log = ad.table(spark, sf_dir, "events").withColumn("from_event_id", F.col("user_id") % 40)
    target = F.floor(F.col("from_event_id") * (F.col("event_id") % 7) / 7).cast("bigint")
    moves = log.filter("event_type = 'signup' AND from_event_id > 0").select("from_event_id", target.alias("to_event_id"), F.col("ts").alias("valid_from"))
    readers = log.filter("event_type <> 'signup'").select(F.col("event_id").alias("reader_id"), (F.col("event_id") % 45).alias("event_id"), F.col("ts").alias("at"))
    return redirects.redirects_as_of(readers, moves).select("reader_id", "event_id", "target_event_id")


# --- sources, fetches and documents ---


@query
def enabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.enabled_sources(ad.sources(spark, sf_dir)).select("source_id", "tier", "is_official")


@query
def active_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.active_profiles(ad.profiles(spark, sf_dir))
    return found.select(
        "id",
        "source_key",
        "source_domain",
        "tier",
        "is_official",
        "lang",
        "pool",
        "strategy",
        F.col("cadence.cron").alias("cron"),
        "rate_limit_req_per_min",
        "concurrency_per_domain",
        "timeout_seconds",
        "max_bytes",
        "starvation_window_hours",
        "baseline_rolling",
    )


@query
def rejected_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles.rejected_profiles(ad.profiles(spark, sf_dir))
    return rows.select("id", "domain", joined("errors").alias("errors"))


@query
def pool_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles.active_profiles(ad.profiles(spark, sf_dir))
    return rows.groupBy(profiles.fetch_queue(F.col("pool")).alias("queue")).agg(F.count("*").alias("n"))


@query
def endpoint_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles.parse_profiles(ad.profiles(spark, sf_dir))
    return rows.select(
        "id",
        profiles.fetch_url(F.col("endpoints")).alias("fetch_url"),
        profiles.document_url(F.lit(""), F.col("endpoints")).alias("document_url"),
    )


def feed_bodies(spark: SparkSession, sf_dir: str, atom: bool = False) -> DataFrame:
    """Feed documents of ten items each, made of the documents table."""
    docs = ad.text_table(spark, sf_dir, "documents", "doc_id")

    def escaped(column: Column) -> Column:
        return F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    title = tag("title", F.concat(F.lit("Nota "), "doc_id"))
    link = F.concat(F.lit("https://news.example.org/"), "doc_id")
    body = escaped(F.col("text"))
    if atom:
        item = tag("entry", F.concat(title, F.lit('<link href="'), link, F.lit('"/>'), tag("summary", body)))
    else:
        kind = F.col("doc_id") % 3
        text_tags = (
            F.when(kind == 0, tag("description", body))
            .when(kind == 1, F.concat(tag("summary", body), tag("description", F.lit("short"))))
            .otherwise(F.lit(""))
        )
        item = tag("item", F.concat(title, tag("link", link), text_tags))
    feeds = docs.groupBy(F.floor(F.col("doc_id") / 10).alias("feed_id")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("items")
    )
    items = F.array_join(F.transform("items", lambda i: i["item"]), "\n")
    whole = tag("feed", items) if atom else tag("rss", tag("channel", F.concat(F.lit("<title>Feed</title>"), items)))
    return feeds.select("feed_id", whole.alias("body"))


def _items(rows: DataFrame) -> DataFrame:
    return rows.select(
        "feed_id", F.col("item_no").cast("bigint").alias("item_no"), "title", "url", F.sha2("text", 256).alias("text_sha256")
    )


@query
def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(feeds.rss_items(feed_bodies(spark, sf_dir)))


@query
def atom_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(feeds.atom_items(feed_bodies(spark, sf_dir, atom=True)))


@query
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_items(ad.text_table(spark, sf_dir, "pages", "page_id")).select(
        "page_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )


@query
def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table cells: lines and words of the conversations stand for rows and cells."""
    turns = ad.table(spark, sf_dir, "conversations")
    cells = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    return turns.select("conv_id", "turn", F.sha2(text.table_text(cells), 256).alias("table_sha256"))


@query
def body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.text_table(spark, sf_dir, "pages", "page_id").select("page_id", fetches.body_hash(F.col("html")).alias("content_hash"))


@query
def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ad.text_table(spark, sf_dir, "pages", "page_id").select(
        F.col("page_id").alias("source_id"),
        "url",
        F.col("html").alias("body"),
        F.lit(200).alias("status_code"),
        (F.col("page_id") % 977 / 311.0).alias("elapsed_s"),
        F.lit("FAST_POOL").alias("pool"),
        (F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))).alias("attempted_at"),
    )
    rows = fetches.fetch_records(pages)
    return rows.select("source_id", "url", "status_code", "latency_ms", "bytes", "pool", "snapshot_hash", stamp("attempted_at").alias("attempted_at"))


@query
def snapshot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of the second half of the day that the first half did not bring."""
    bodies = ad.docs(spark, sf_dir).select(
        F.col("doc_id").alias("fetch_id"),
        F.concat(F.lit("https://news.example.org/"), "doc_id").alias("url"),
        F.col("seen_at").alias("fetched_at"),
    ).join(ad.text_table(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("fetch_id"), F.col("text").alias("body")), "fetch_id")
    morning = F.hour("fetched_at") < 12
    history = bodies.filter(morning).select(fetches.body_hash(F.col("body")).alias("snapshot_hash")).distinct()
    return fetches.new_snapshots(bodies.filter(~morning), history).select(
        "snapshot_hash", "url", stamp("fetched_at").alias("fetched_at"), "copies"
    )


@query
def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without title or link every few rows, so that both defaults occur."""
    docs = story_docs(spark, sf_dir)
    endpoints = F.create_map(F.lit("latest"), F.concat(F.lit("https://"), "source_domain", F.lit("/latest")))
    items = docs.select(
        "doc_id",
        "source_id",
        "source_domain",
        endpoints.alias("endpoints"),
        F.when(F.col("doc_id") % 4 > 0, F.col("title")).alias("title"),
        F.when(F.col("doc_id") % 3 > 0, F.col("url")).otherwise(F.lit("")).alias("item_url"),
        F.col("clean_text").alias("text"),
        fetches.body_hash(F.col("clean_text")).alias("body_hash"),
        "seen_at",
    )
    rows = fetches.document_records(items)
    return rows.select(
        "doc_id", "source_id", "url", "title", F.length("clean_text").cast("bigint").alias("n_chars"), "content_hash", "body_hash", "version_no"
    )


@query
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid source fetched twice: a feed or a page, by the strategy of its profile."""
    active = profiles.active_profiles(ad.profiles(spark, sf_dir))
    pages = ad.text_table(spark, sf_dir, "pages", "page_id")
    bodies = (
        active.select(F.col("id").alias("source_id"), "strategy")
        .join(pages.withColumnRenamed("page_id", "source_id"), "source_id")
        .join(feed_bodies(spark, sf_dir).withColumnRenamed("feed_id", "source_id"), "source_id", "left")
        .withColumn("body", F.when(F.col("strategy") == "RSS", F.coalesce("body", F.lit("<rss/>"))).otherwise(F.col("html")))
    )
    numbers = F.array(F.col("source_id") * 2, F.col("source_id") * 2 + 1)
    fetched = bodies.select(F.explode(numbers).alias("fetch_id"), "source_id", "url", "body").withColumn(
        "fetched_at", F.timestamp_seconds(F.lit(1704067200) + F.col("fetch_id"))
    )
    rows = documents_from_fetches(fetched, active)
    return rows.select(
        "doc_id", "source_id", "url", "title", F.length("clean_text").cast("bigint").alias("n_chars"), "content_hash"
    )


# --- sinks ---


def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("event_id"), F.col("value").alias("breaking_score"), F.col("ts").alias("computed_at"))


@query
def score_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores stored up to 20 January, then all later ones on top."""
    rows = score_history(spark, sf_dir)
    early = F.col("computed_at") < F.lit("2024-01-20").cast("timestamp")
    stored = tables.latest_scores(rows.filter(early))
    return tables.upsert_scores(stored, rows.filter(~early)).select(
        "event_id", "breaking_score", F.unix_micros("computed_at").alias("computed_at_us")
    )


@query
def score_upsert_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score_upsert`` into a stored table, of which the second batch rewrites the buckets that it touches."""
    history, cut = score_history(spark, sf_dir), F.timestamp_seconds(F.lit(1705708800))
    schema = ", ".join(f"{name} {kind}" for name, kind in history.dtypes)
    stored = BucketTable(spark, new_stage_path(spark, "scores"), schema, "event_id", STORE_BUCKETS)
    for batch_id, rows in enumerate((history.filter(F.col("computed_at") < cut), history.filter(F.col("computed_at") >= cut))):
        stored.upsert(stage(tables.latest_scores(rows), "latest-scores"), batch_id)
    return stored.read().select("event_id", "breaking_score", F.unix_micros("computed_at").alias("computed_at_us"))


@query
def score_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return story(spark, sf_dir).scored_events().select("event_id", "status", "breaking_score")


@query
def draft_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, _, event_docs = assigned(spark, sf_dir)
    values = F.transform("anchors", lambda a: a["anchor_value"])
    found = facts.select("doc_id", values.alias("anchors"), "evidence_score")
    first = event_docs.filter("is_primary").select("event_id", "doc_id")
    rows = (
        first.join(story_docs(spark, sf_dir), "doc_id")
        .join(found, "doc_id")
        .select(
            "event_id",
            F.when(F.col("doc_id") % 5 > 0, F.col("title")).alias("title"),
            "clean_text",
            F.array("source_key").alias("sources"),
            "anchors",
            "evidence_score",
            F.array().cast("array<string>").alias("reasons"),
            F.array(F.struct(stamp("seen_at").alias("at"), "url")).alias("timeline"),
            F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 10 / 10.0).alias("confidence"),
        )
    )
    drafts = tables.draft_articles(rows, F.lit("2024-03-01 00:00:00").cast("timestamp"))

    def field(path: str) -> Column:
        return F.get_json_object("draft_json", f"$.{path}")

    return drafts.select(
        "event_id",
        field("title").alias("title"),
        field("status").alias("status"),
        F.sha2(field("body"), 256).alias("body_sha256"),
        field("provenance[0]").alias("provenance"),
        field("evidence.anchors[0]").alias("first_anchor"),
        field("evidence.evidence_score").cast("double").alias("evidence_score"),
        field("timeline[0].at").alias("timeline_at"),
        field("created_at").alias("created_at"),
        field("needs_review").alias("needs_review"),
        field("review_reason").alias("review_reason"),
    )


@query
def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.check_feedback(ad.events_view(spark, sf_dir, ad.FEEDBACK))
    return rows.select("feedback_id", "event_id", "action", "actor", "is_valid")


@query
def feedback_ignored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, event_docs = assigned(spark, sf_dir)
    events = assign.build_events(event_docs)
    return tables.apply_feedback(events, ad.events_view(spark, sf_dir, ad.FEEDBACK)).select("event_id", "status")


# --- fingerprints and similarity ---


@query
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.tokens(F.col("text"))
    return ad.text_table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", F.size(found).cast("bigint").alias("n_tokens"), F.sha2(F.array_join(found, " "), 256).alias("tokens_sha256")
    )


@query
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.document_simhash(ad.text_table(spark, sf_dir, "documents", "doc_id"), "text")


@query
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicate_groups(neardup.document_simhash(ad.text_table(spark, sf_dir, "documents", "doc_id"), "text"))


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(neardup.document_simhash(ad.text_table(spark, sf_dir, "documents", "doc_id"), "text"), "simhash")


@query
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicate_members(_hashes(spark, sf_dir))


@query
def near_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(_hashes(spark, sf_dir))


@query
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = stage(neardup.document_simhash(ad.text_table(spark, sf_dir, "documents", "doc_id"), "text"), "simhash")
    return neardup.near_duplicate_pairs(hashes)


@query
def turn_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-set similarity of every conversation turn and the next one."""
    turns = ad.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("t"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("next_t"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(text.jaccard(F.col("t"), F.col("next_t")), 9).alias("jaccard")
    )


@query
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = similar.similar_pairs(ad.text_table(spark, sf_dir, "documents", "doc_id"), 0.6, "text")
    return rows.withColumn("jaccard", F.round("jaccard", 9))


BM25_TERMS = ["acórdão", "portaria", "processo", "the"]


@query
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.bm25_top(ad.docs(spark, sf_dir), BM25_TERMS).withColumn("length", F.col("length").cast("bigint"))


@query
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = similar.tfidf_top_terms(ad.docs(spark, sf_dir))
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query
def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = similar.minhash_signatures(ad.docs(spark, sf_dir))
    return rows.select("doc_id", joined(F.transform("minhash", lambda m: m.cast("string"))).alias("minhash"))


@query
def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhashes.minhash_groups(ad.docs(spark, sf_dir), threshold=0.8)


@query
def bm25_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    items = ad.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25_join(ad.docs(spark, sf_dir), items, k=10)


# --- deltas and states ---


def version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.versions(spark, sf_dir)
    values = F.transform(anchor_columns.anchor_array(F.col("clean_text")), lambda a: a["anchor_value"])
    return rows.select("url", F.col("version_no"), values.alias("anchors"), "value", "time")


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.full_deltas(stage(version_rows(spark, sf_dir), "versions"))


_VERSION_KEY = ("url", "from_version", "to_version")


@query
def anchor_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).select(
        *_VERSION_KEY, joined("anchors.added").alias("added"), joined("anchors.removed").alias("removed")
    )


@query
def value_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).select(
        *_VERSION_KEY,
        F.col("values.from").alias("from_value"),
        F.col("values.to").alias("to_value"),
        F.col("values.diff").alias("diff"),
    )


@query
def temporal_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).select(*_VERSION_KEY, "temporal.previous_time", "temporal.new_time", "temporal.is_postponed")


@query
def full_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _deltas(spark, sf_dir)
    return rows.select(
        *_VERSION_KEY,
        joined("anchors.added").alias("added"),
        F.col("values").isNotNull().alias("value_changed"),
        F.col("temporal").isNotNull().alias("time_changed"),
    )


@query
def state_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.events_view(spark, sf_dir, ad.STATES)
    step = state_rules.next_status(F.col("status"), F.col("pool"), F.col("started_at"), F.col("ts"))
    return rows.select("event_id", "status", step.alias("next_status"))


@query
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.events_view(spark, sf_dir, ad.STATES)
    moved = states.state_transitions(rows, ad.latest(ad.table(spark, sf_dir, "events"), "ts"))
    return moved.select("event_id", "old_status", "status", "status_reason")


@query
def quarantine_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.events_view(spark, sf_dir, ad.STATES)
    return rows.select("event_id", state_rules.is_quarantine_case(F.col("value"), F.col("source_count")).alias("is_quarantine"))


@query
def viral_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.events_view(spark, sf_dir, ad.STATES)
    return rows.select("event_id", state_rules.is_unverified_viral(F.col("value"), F.col("source_count")).alias("is_viral"))


@query
def quarantine_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.events_view(spark, sf_dir, ad.STATES)
    as_of = F.col("ts") + F.expr("INTERVAL 14 MINUTES")
    return rows.select(
        "event_id", state_rules.expire_quarantine(F.col("status"), F.col("started_at"), as_of).alias("status")
    )


# --- health, alerts, changes and feedback ---


@query
def yield_starvation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = health.yield_starvation(ad.events_view(spark, sf_dir, ad.FETCHES))
    return rows.select("source_id", stamp("window_start").alias("window_start"), "attempts")


@query
def yield_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = health.yield_baseline(ad.events_view(spark, sf_dir, ad.FETCHES))
    return rows.select(
        "source_id",
        stamp("slot").alias("slot"),
        "attempts",
        F.round("mean_yield", 6).alias("mean_yield"),
        F.round("baseline_yield", 6).alias("baseline_yield"),
    )


@query
def yield_baseline_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines by office and early hours; the first of a month is a holiday, and a third of the sources have no calendar."""
    rows = ad.events_view(spark, sf_dir, ad.FETCHES)
    days = rows.select(F.to_date("attempted_at").alias("day")).distinct()
    kinds = spark.createDataFrame([("office", 9, 18), ("early", 6, 12)], "calendar string, open_hour int, close_hour int")
    holidays = days.filter(F.dayofmonth("day") == 1).withColumn("calendar", F.explode(F.array(F.lit("office"), F.lit("early"))))
    periods = calendars.working_calendars(days, kinds, holidays)
    kind = F.when(F.col("source_id") % 3 == 0, "office").when(F.col("source_id") % 3 == 1, "early")
    sources = rows.select("source_id").distinct().withColumn("calendar", kind)
    found = calendars.yield_baseline_calendar(rows, sources, periods)
    return found.select(
        "source_id", stamp("slot").alias("slot"), "period", "attempts", F.round("mean_yield", 6).alias("mean_yield"), F.round("baseline_yield", 6).alias("baseline_yield")
    )


@query
def slo_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.latency_p95(ad.events_view(spark, sf_dir, ad.FETCHES))


@query
def fetch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.error_counts(ad.events_view(spark, sf_dir, ad.FETCHES))


@query
def alert_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts.alert_transitions(ad.events_view(spark, sf_dir, ad.OBSERVATIONS))
    return rows.select("event_id", "observation_id", "alert_hash")


@query
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an hour of cooldown, so that runs of silenced candidates occur in the test data."""
    candidates = stage(alerts.alert_transitions(ad.events_view(spark, sf_dir, ad.OBSERVATIONS)), "alert-candidates")
    return alerts.sent_alerts(candidates, cooldown_s=3600).select(
        "event_id", "observation_id", F.unix_micros("cooldown_until").alias("cooldown_until_us")
    )


@query
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starting events against scored and merged ones."""
    docs, found, event_docs = assigned(spark, sf_dir)
    as_of = ad.latest(docs, "seen_at")
    old = stage(assign.build_events(event_docs), "events")
    scores = scoring.score_events(old, event_docs, ad.sources(spark, sf_dir), as_of)
    new = merge.apply_merges(tables.mirror_scores(old, scores), merge.merge_audit(event_docs, found, as_of))
    return changes.change_feed(old, new)


@query
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, event_docs = assigned(spark, sf_dir)
    events = assign.build_events(event_docs)
    rows = changes.feedback_stats(ad.events_view(spark, sf_dir, ad.FEEDBACK), events, by="lane")
    return rows.withColumn("ignored_rate", F.round("ignored_rate", 9))


@query
def feedback_stats_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions on absorbed events count for the event that took them in."""
    built = build_story(story_docs(spark, sf_dir), ad.sources(spark, sf_dir), merge=True)
    rows = changes.feedback_stats(ad.events_view(spark, sf_dir, ad.FEEDBACK), built.events, by="lane", redirects=built.redirects)
    return rows.withColumn("ignored_rate", F.round("ignored_rate", 9))


@query
def feedback_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, event_docs = assigned(spark, sf_dir)
    first = event_docs.filter("is_primary").select("event_id", "source_id")
    rows = changes.feedback_stats(ad.events_view(spark, sf_dir, ad.FEEDBACK), first, by="source_id")
    return rows.withColumn("ignored_rate", F.round("ignored_rate", 9))


# --- streams, run over all that is there ---


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a table as a stream, whether it is one file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    # Spark streams folders: a table of one file is its folder, filtered by the file's name.
    is_file = any(file.endswith(f"/{name}.parquet") for file in spark.read.parquet(path).inputFiles())
    return runner.read_files(runner.stream_session(spark), *((sf_dir, f"{name}.parquet") if is_file else (path, "*.parquet")))


def stream_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    rows = stream_of(spark, sf_dir, "events")
    return rows.sparkSession.sql(sql.replace("{k}", "get_json_object(props, '$.k')"), events=rows)


@query
def stream_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_of(spark, sf_dir, "events")
    docs = rows.select((F.col("user_id") % 5).alias("event_id"), F.col("ts").alias("seen_at"))
    found = runner.run_available(windows.event_velocity(docs), spark, "velocity")
    return found.select("event_id", stamp("start").alias("window_start"), "velocity")


@query
def stream_starvation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_view(spark, sf_dir, ad.FETCHES)
    found = runner.run_available(windows.yield_starvation(rows), spark, "starvation")
    return found.select("source_id", stamp("window_start").alias("window_start"), "attempts")


@query
def stream_first_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetch per body; which copy comes first is open, so only the hash is shown."""
    rows = stream_of(spark, sf_dir, "documents").select(
        F.col("text").alias("body"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("fetched_at")
    )
    return runner.run_available(windows.first_fetches(rows), spark, "fetches").select("snapshot_hash")


def _state_log(rows: DataFrame) -> DataFrame:
    return rows.select((F.col("user_id") % 20).alias("event_id"), "status", "pool", F.col("ts").alias("at"))


def split_events(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """The events table as a stream of several micro-batches, each of a later range of time."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    n, first, last = rows.agg(F.count("*"), F.min(at), F.max(at)).first()
    ranged, folder = new_stage_path(spark, "events-by-range"), new_stage_path(spark, "events-in-parts")
    part = F.floor((at - first) / F.lit(last + 1 - first) * parts)
    rows.withColumn("part", part).write.partitionBy("part").parquet(ranged)
    # As many files for each part; they become a micro-batch in the order in which the parts are written.
    files = min(spark.sparkContext.defaultParallelism, 1 + n // 10_000)
    for k in range(parts):
        spark.read.schema(rows.schema).parquet(f"{ranged}/part={k}").repartition(files).write.mode("append").parquet(folder)
    return runner.read_files(runner.stream_session(spark), folder, "*.parquet", files_per_batch=files)


@query
def stream_slo_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the closed days of a stream from stored sketches; approximate, so there is no SQL to compare with."""
    rows = stream_view(spark, sf_dir, ad.FETCHES)
    stored = runner.run_available(sketches.latency_sketches(rows.select("pool", "attempted_at", "latency_ms")), spark, "latency-sketches")
    return sketches.slo_of_sketches(stored)


def split_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    rows = split_events(spark, sf_dir)
    return rows.sparkSession.sql(sql.replace("{k}", "get_json_object(props, '$.k')"), events=rows)


@query
def stream_state_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _state_log(split_view(spark, sf_dir, ad.STATES.replace("event_id, ts", "event_id, user_id, ts")))
    found = timers.state_timeouts(rows, spark, new_stage_path(spark, "timeouts"))
    return found.select("event_id", "old_status", "status", F.unix_micros("at").alias("at_us"))


@query
def timed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the timeouts, over the same log."""
    rows = _state_log(ad.events_view(spark, sf_dir, ad.STATES.replace("event_id, ts", "event_id, user_id, ts")))
    log = with_next(rows, ["event_id"], "at", F.date_trunc("hour", "at"), F.struct("at"), "following").withColumn(
        "next_at", F.col("following.at")
    )
    as_of = ad.latest(ad.table(spark, sf_dir, "events"), "ts") - F.expr("INTERVAL 1 HOUR")
    found = states.timed_transitions(log, as_of)
    return found.select("event_id", "old_status", "status", F.unix_micros("at").alias("at_us"))


@query
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_view(spark, sf_dir, ad.OBSERVATIONS)
    found = timers.sent_alerts(rows, spark, new_stage_path(spark, "alerts"), cooldown_s=3600, late_by_s=0)
    return found.select("event_id", "observation_id", F.unix_micros("cooldown_until").alias("cooldown_until_us"))


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[EventStore, str]:
    rows = stream_of(spark, sf_dir, "documents")
    number = F.col("source_id").cast("string")
    domain = F.concat(F.lit("src"), number, F.lit(".example.org"))
    docs = rows.sparkSession.sql(ad.DOCS, documents=rows).withColumns(
        {
            "source_key": F.concat(F.lit("src"), number),
            "source_domain": domain,
            "url": F.concat(F.lit("https://"), domain, F.lit("/"), F.col("doc_id")),
            "tier": F.col("source_id") % 3 + 1,
            "is_official": F.col("source_id") % 4 == 0,
        }
    )
    folder = new_stage_path(spark, "ingested")
    return ingest.ingest_documents(docs, ad.sources(spark, sf_dir), spark, folder, n_buckets=STORE_BUCKETS), folder


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor rows that the document stream appended."""
    _, folder = _ingested(spark, sf_dir)
    written = spark.read.parquet(f"{folder}/doc_anchors")
    return written.select("doc_id", F.col("anchor_no").cast("bigint").alias("anchor_no"), "anchor_type", "anchor_value")


@query
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that the document stream stored."""
    store, _ = _ingested(spark, sf_dir)
    return store.event_docs().select("event_id", "doc_id", "source_id", stamp("seen_at").alias("seen_at"), "is_primary")


@query
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change feed of the event stream over several micro-batches: new rows, changed states and merges."""
    rows = split_events(spark, sf_dir)
    merged = F.col("event_type") == "view"
    events = rows.select(
        (F.col("user_id") % 20).alias("event_id"),
        F.when(merged, F.col("event_id") % 3).alias("canonical_event_id"),
        F.when(merged, F.lit("MERGED")).otherwise(F.col("event_type")).alias("status"),
        F.lit("s").alias("summary"),
        F.lit("geral").alias("lane"),
        F.floor(F.col("value") / 50).cast("double").alias("breaking_score"),
        F.col("ts").alias("updated_at"),
    )
    found = timers.event_changes(events, spark, new_stage_path(spark, "changes"), late_by_s=0)
    return found.groupBy("event_id", "change", "status", "target_event_id").agg(F.count("*").alias("n"))
