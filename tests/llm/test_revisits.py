import random

import pytest

from storyspark.llm import revisits

SCHEMA = "record_id bigint, url string, captured_at double, kind string, etag string, last_modified string, headers map<string,string>, body string, `at` string, slice int"


def records(spark, rows):
    return spark.createDataFrame([(*r, "b", "x", 1) for r in rows], SCHEMA)


def brute(spark, rows):
    frame = records(spark, rows)
    names = frame.select("record_id", revisits.canonical_url(frame["url"]).alias("u")).collect()
    url = {r.record_id: r.u for r in names}
    out = []
    for i, _, at, kind, tag, modified, _ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and url[r[0]] is not None and url[r[0]] == url[i] and r[2] is not None and at is not None and (r[2], r[0]) < (at, i)]
        original = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        if original is None:
            status = "unmatched"
        elif tag is not None and original[4] is not None:
            status = "resolved" if tag.removeprefix("W/") == original[4].removeprefix("W/") else "changed"
        elif modified is not None and original[5] is not None:
            status = "resolved" if modified == original[5] else "changed"
        else:
            status = "unchecked"
        out.append((i, original and original[0], status))
    return sorted(out)


@pytest.mark.parametrize("slice_rows", [1_000_000, 40, 1])
def test_equals_looking_back_record_by_record(spark, slice_rows):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        url = rng.choice(["http://a.example/x", "https://www.A.example/x/", "http://a.example/x?utm_source=f", "http://b.example/y", "http://hot.example/"] + ["http://hot.example/#top"] * 5)
        kind = "response" if rng.random() < 0.15 else "revisit"
        rows.append((i, url, float(rng.randint(0, 60)), kind, rng.choice(['"1"', 'W/"1"', '"2"', None]), rng.choice(["m1", "m2", None]), {"ETag": "t"}))
    got = revisits.resolve_revisits(records(spark, rows), slice_rows).collect()
    assert sorted((r.record_id, r.original_id, r.status) for r in got) == brute(spark, rows)


def test_only_permitted_headers_are_merged(spark):
    stored = {"Content-Type": "text/html", "ETag": "old", "Cache-Control": "a", "X-Own": "1"}
    fresh = {"etag": "new", "Content-Length": "0", "content-type": "wrong", "Expires": "later"}
    rows = [(1, "http://a/", 1.0, "response", '"v"', None, stored), (2, "http://a/", 2.0, "revisit", '"v"', None, fresh), (3, "http://a/", 3.0, "revisit", '"w"', None, fresh), (4, "http://a/", 4.0, "revisit", '"v"', None, None)]
    got = {r.record_id: r for r in revisits.resolve_revisits(records(spark, rows)).collect()}
    assert got[2].headers == {"content-type": "text/html", "etag": "new", "cache-control": "a", "x-own": "1", "expires": "later"}
    assert got[3].status == "changed" and got[3].headers == fresh
    assert got[4].headers == {k.lower(): v for k, v in stored.items()}


def test_nulls_ties_and_no_rows(spark):
    rows = [
        (1, None, 1.0, "response", None, None, None),
        (2, None, 2.0, "revisit", None, None, None),
        (3, "http://a/", None, "revisit", None, None, None),
        (4, "http://a/", 5.0, "response", None, None, {}),
        (5, "http://a/", 5.0, "revisit", None, None, None),
        (3, "http://a/", 5.0, "revisit", None, None, None),
    ]
    got = sorted((r.record_id, r.original_id, r.status) for r in revisits.resolve_revisits(records(spark, rows)).collect())
    assert got == [(2, None, "unmatched"), (3, None, "unmatched"), (3, None, "unmatched"), (5, 4, "unchecked")]
    assert revisits.resolve_revisits(records(spark, rows).filter("record_id = 99")).count() == 0


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://www.Example.org:80/A/b/?utm_source=x&utm_medium=y&page=2&ref=z#frag", "example.org/A/b/?page=2"),
        ("https://example.org/", "example.org"),
        ("example.org?ref=1", "example.org"),
        ("https://example.org:8443/x?a=1&b=2", "example.org:8443/x?a=1&b=2"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_urls(spark, url, want):
    frame = spark.createDataFrame([(url,)], "url string")
    assert frame.select(revisits.canonical_url(frame["url"])).first()[0] == want


def test_names_that_differ_in_case_count_once_and_the_last_one_counts(spark):
    """Archives hold both; an engine of strict maps must not end the job."""
    kind = "record_id bigint, url string, captured_at double, kind string, etag string, last_modified string, names array<string>, values array<string>, original string"
    rows = [
        (1, "http://a.org/x", 1.0, "response", "e", None, {"Date": "1", "date": "2", "X-A": "k", "x-a": "l"}, "clash"),
        (2, "http://a.org/x", 2.0, "revisit", "e", None, {"DATE": "3", "Date": "4", "X-A": "no"}, "clash"),
    ]
    rows = [(*r[:6], list(r[6]), list(r[6].values()), r[7]) for r in rows]  # a Python dictionary loses its order on the way
    records = spark.createDataFrame(rows, kind).selectExpr("*", "map_from_arrays(names, values) AS headers")
    (got,) = revisits.resolve_revisits(records).collect()
    assert (got.original_id, got.status, got.headers) == (1, "resolved", {"date": "4", "x-a": "l"})
    assert revisits.resolve_revisits(records.filter("record_id > 9")).collect() == []
