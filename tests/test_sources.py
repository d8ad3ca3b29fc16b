import json

import pytest
from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.sources import captures, paged


def test_paged_batch_and_stream_agree(spark):
    batch = paged.reader(spark, "paged_provider", pages="4", page_size="3").orderBy("item_id").collect()
    assert [r.item_id for r in batch] == list(range(12))
    query = paged.reader(spark, "paged_provider", stream=True, pages="4", page_size="3").writeStream.format("memory").queryName("paged").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.item_id for r in spark.table("paged").collect()) == list(range(12))


def test_paged_modes(spark):
    assert paged.reader(spark, "paged_provider", mode="empty").count() == 0
    with pytest.raises(PySparkException, match="COLLECTION_UPSTREAM_PERMANENT"):
        paged.reader(spark, "paged_provider", mode="error").count()
    with pytest.raises(ValueError):
        paged.reader(spark, "odd")
    with pytest.raises(ValueError):
        paged.register(paged.PagedProvider)


def test_captures(spark, tmp_path):
    capture = lambda provider, body, **more: json.dumps({"capture_version": 1, "provider": provider, "captured_at": "2026-01-01T00:00:00Z", "http_status": 200, "response_body": body} | more)
    files = {
        "a.json": capture("marketaux", {"data": [{"uuid": "1"}, {"uuid": "2"}], "meta": {}}), "b.json": capture("finnhub", {"c": 1, "t": 2}), "c.json": capture("sec_edgar", {"filings": {"recent": {"form": ["x", "y"], "accessionNumber": ["z"]}}}),
        "d.json": capture("eia", {"response": {"data": []}}), "e.json": capture("odd", {"a": 1}), "f.json": capture("eia", {"api_key": "abc"}), "g.json": capture("finnhub", {"c": 1}, http_status=500), "h.json": "not json", "i.txt": "{}",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {r.file[0]: (r.items, r.state, r.replay_ready) for r in captures.audit(captures.read_captures(spark, str(tmp_path))).collect()}
    assert got == {
        "a": (2, "normalized", True), "b": (1, "normalized", True), "c": (2, "normalized", True), "d": (0, "capture_empty", True), "e": (0, "provider_unknown", True), "f": (0, "secret_detected", True),
        "g": (1, "normalized", False), "h": (0, "provider_unknown", False),
    }


def test_written_captures_are_canonical(spark, tmp_path):
    bodies = spark.createDataFrame([("eia", '{"b": 1, "a": [true, null]}'), ("eia", '{ "a":[true,null],"b":1 }')], "provider string, body string")
    assert captures.write_captures(bodies, f"{tmp_path}/out").select("sha256").distinct().count() == 1
    assert {r.value for r in spark.read.text(f"{tmp_path}/out").collect()} == {'{"a":[true,null],"b":1}'}


def test_sanitized_maps(spark):
    row = spark.range(1).select(captures.sanitized(F.create_map(F.lit("Api_Key"), F.lit("x"), F.lit("q"), F.lit("my token"), F.lit("n"), F.lit("ok"))).alias("m"), captures.safe_headers(F.create_map(F.lit("Date"), F.lit("d"), F.lit("Set-Cookie"), F.lit("c")), ["date"]).alias("h")).first()
    assert row.m == {"q": "[REDACTED]", "n": "ok"} and row.h == {"Date": "d"}
    got = spark.range(1).select(captures.head(F.array(F.lit(1), F.lit(2), F.lit(3)), 2).alias("p")).first().p
    assert (list(got["items"]), got.has_more) == ([1, 2], True)


def test_integrity(spark):
    df = spark.createDataFrame([("1", "c", None), ("2", "c", None), ("3", None, None)], "id string, canonical_url string, raw_item_id string").withColumns({"source_id": F.lit("s"), "external_id": F.lit(None).cast("string"), "content_hash": F.lit(None).cast("string")})
    assert [(r.key, r["values"], r.n) for r in schemas.duplicate_keys(df, "content_items").collect()] == [("canonical_url", "c", 2)]
    runs = spark.createDataFrame([(0.5, 101.0), (None, 5.0)], "confidence double, importance_score double").withColumns({"latest_seen_at": F.lit("2026-01-02").cast("timestamp"), "first_seen_at": F.lit("2026-01-03").cast("timestamp")})
    assert [list(r.b) for r in runs.select(schemas.broken_checks("event_candidates").alias("b")).collect()] == [["importance_score between 0 and 100", "latest_seen_at >= first_seen_at"], ["latest_seen_at >= first_seen_at"]]
    assert schemas.orphans(df, "canonical_url", df.select(F.lit("x").alias("id"))).count() == 2
    assert schemas.schema_differences(spark.createDataFrame([], schemas.TABLES["notifications"]).drop("reason").withColumn("more", F.lit(1)).withColumn("retry_count", F.lit("x")), "notifications") == ["missing reason", "type of retry_count", "unknown more"]
    for name in schemas.TABLES:
        assert schemas.schema_differences(spark.createDataFrame([], schemas.TABLES[name]), name) == []


def test_captures_keep_to_their_limit(spark, tmp_path):
    said = {"a": ("marketaux", 2, {"data": [{}, {}]}), "b": ("marketaux", 1, {"data": [{}, {}]}), "c": ("marketaux", 4, {"data": []}), "d": ("finnhub", 1, {"c": 1}), "e": ("eia", None, {"response": {"data": []}})}
    for name, (provider, limit, body) in said.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"provider": provider, "request": {"limit": limit}, "response_body": body}))
    got = {r.file[0]: r.within_limit for r in captures.audit(captures.read_captures(spark, str(tmp_path))).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": False}


def test_one_broken_file_leaves_the_others_whole(spark, tmp_path):
    """Providers and files fail by themselves; the items of the rest are all there."""
    body = {"marketaux": {"data": [{"uuid": "a"}, {"uuid": "b"}]}, "eia": {"response": {"data": [{"period": "2024-01"}]}}, "finnhub": {"c": 1.0}, "sec_edgar": {"filings": {"recent": {"form": ["a", "b"]}}}}
    capture = lambda p, status=200, **more: json.dumps({"provider": p, "http_status": status, "response_body": body.get(p), **more})
    files = {
        "a.json": capture("marketaux"), "b.json": '{"provider": "marketaux", "http_status": 200, "response_body": {"data": [', "c.json": capture("eia", 503), "d.json": capture("eia"), "e.json": capture("finnhub", 429), "f.json": capture("sec_edgar"), "g.json": capture("odd"),
        "h.json": capture("finnhub", 404), "i.json": capture("eia", None, error="timeout"), "j.json": "[]", "k.json": "", "note.txt": "no capture",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = captures.collected(captures.read_captures(spark, str(tmp_path)))
    got = {r.file: (len(r["items"]), r.error_code) for r in found.collect()}
    assert got == {
        "a.json": (2, None), "b.json": (0, "COLLECTION_CONTRACT_INVALID"), "c.json": (0, "COLLECTION_UPSTREAM_RETRYABLE"), "d.json": (1, None), "e.json": (0, "COLLECTION_RATE_LIMITED"), "f.json": (2, None), "g.json": (0, "COLLECTION_CONFIG_INVALID"),
        "h.json": (0, "COLLECTION_CONTRACT_INVALID"), "i.json": (0, "COLLECTION_TIMEOUT"), "j.json": (0, "COLLECTION_CONTRACT_INVALID"),
    }
    by = {r.provider: (r.files, r.failed, r["items"], r.errors) for r in captures.outcomes_by_provider(found).collect()}
    assert by["eia"] == (3, 2, 1, {"COLLECTION_TIMEOUT": 1, "COLLECTION_UPSTREAM_RETRYABLE": 1}) and by["marketaux"] == (1, 0, 2, {}) and by[None] == (2, 2, 0, {"COLLECTION_CONTRACT_INVALID": 2})
