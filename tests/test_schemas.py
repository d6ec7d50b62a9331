"""Results have the declared table columns."""

import pytest
from pyspark.sql import functions as F

from storyspark import schemas
from storyspark.operators.evidence import extract_anchors
from storyspark.plans import adapters as ad
from storyspark.plans.catalog import story, story_docs
from storyspark.sinks.tables import check_feedback
from storyspark.sources import fetches


def names(schema: str) -> set[str]:
    return {part.split()[0] for part in schema.split(", ") if ":" not in part.split()[0]}


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    built = story(spark, sf_dir)
    pages = ad.table(spark, sf_dir, "pages")
    fetched = pages.selectExpr(
        "page_id AS source_id", "url", "html AS body", "200 AS status_code", "0.5D AS elapsed_s", "'FAST_POOL' AS pool",
        "current_timestamp() AS attempted_at",
    )
    snapshots = fetches.new_snapshots(
        fetched.selectExpr("source_id AS fetch_id", "url", "body", "attempted_at AS fetched_at"),
        fetched.limit(0).select(F.lit("").alias("snapshot_hash")),
    )
    return {
        schemas.DOC_ANCHORS: extract_anchors(story_docs(spark, sf_dir), with_context=True),
        schemas.EVENT_DOCS: built.event_docs,
        schemas.EVENTS: built.scored_events(),
        schemas.EVENT_SCORES: built.scores,
        schemas.FEATURES: built.features(),
        schemas.FETCH_ATTEMPTS: fetches.fetch_records(fetched),
        schemas.SNAPSHOTS: snapshots,
        schemas.FEEDBACK: check_feedback(ad.events_view(spark, sf_dir, ad.FEEDBACK)),
    }


@pytest.mark.parametrize(
    "schema",
    [
        schemas.DOC_ANCHORS,
        schemas.EVENT_DOCS,
        schemas.EVENTS,
        schemas.EVENT_SCORES,
        schemas.FEATURES,
        schemas.FETCH_ATTEMPTS,
        schemas.SNAPSHOTS,
        schemas.FEEDBACK,
    ],
)
def test_columns(tables, schema):
    assert names(schema) <= set(tables[schema].columns)
