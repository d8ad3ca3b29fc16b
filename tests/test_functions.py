import hashlib
import json
import uuid
from datetime import UTC, datetime
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scoring, text, timing


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def plain_url(value):
    """The documented canonical form, in plain Python."""
    try:
        parts = urlsplit(value.strip())
        port = parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in ("http", "https") or not parts.hostname:
        return None
    host = f"[{parts.hostname.lower()}]" if ":" in parts.hostname else parts.hostname.lower()
    if port is not None and (scheme, port) not in (("http", 80), ("https", 443)):
        host = f"{host}:{port}"
    query = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in text.TRACKING_KEYS)
    return urlunsplit((scheme, host, parts.path.rstrip("/") or "/", urlencode(query), ""))


@pytest.mark.parametrize("url", [
    "HTTPS://Example.TEST:443/article/?z=2&utm_source=x&a=1#f", "http://a.b/c%20d?x=é", "http://[::1]:80/", "http://u:p@h.com/p", "ftp://x/y", "http://h.com:99999/", "http://h.com:abc/", "http://h.com?a", "http://h.com?a=",
    "http://h.com/?q=%zz", "http://h.com/a//", "  https://h.com/x  ", "http://h.com:8080/a?b=~*&B=1&b=0", "no url", "https://", "http://h.com/?FBCLID=1&x=a+b", "https://h.com:/p",
])
def test_canonical_url(spark, url):
    assert one(spark, url, text.canonical_url) == plain_url(url)


def test_canonical_url_null(spark):
    assert one(spark, None, text.canonical_url) is None


@pytest.mark.parametrize("title", ["Fed Raises Rates!", "Straße ﬁnd ſ", "…", "", None, "A  b\tC-3"])
def test_title_fingerprint(spark, title):
    import re

    tokens = re.findall("[a-z0-9]+", (title or "").casefold())
    assert one(spark, title, text.title_fingerprint) == (hashlib.sha256(" ".join(tokens).encode()).hexdigest() if tokens else None)


@pytest.mark.parametrize(("value", "want"), [
    ("2026-07", datetime(2026, 7, 1)), ("2026", None), ("2026-8-1", None), ("2026-07-01T02:03:04Z", datetime(2026, 7, 1, 2, 3, 4)), ("2026-07-01T02:03:04+02:00", datetime(2026, 7, 1, 0, 3, 4)),
    ("1960-01-01", datetime(1960, 1, 1)), ("", None), (None, None), ("2026-13-01", None),
])
def test_instant(spark, value, want):
    got = spark.createDataFrame([(value,)], "x string").select(F.date_format(text.instant(F.col("x")), "yyyy-MM-dd HH:mm:ss").alias("y")).first().y
    assert got == (want and f"{want:%Y-%m-%d %H:%M:%S}")


@pytest.mark.parametrize("value", ["plain", 'with "quotes" and \\', "é", "", "\U0001f600 \t\n\x01\x1f\x7f ẞ"])
def test_opaque_ref(spark, value):
    want = "entity:" + hashlib.sha256(json.dumps(value).encode()).hexdigest()
    assert one(spark, value, lambda c: text.opaque_ref("entity", c)) == want


def test_redact_and_squeeze(spark):
    assert one(spark, "a Token: abc http://x.y/z b", text.redact) == "a [REDACTED] [REDACTED] b"
    assert one(spark, "x" * 600, text.redact) == "x" * 500
    assert one(spark, " a   b\n", text.squeeze) == "a b"


@pytest.mark.parametrize("reference,unsafe", [("internal://a", False), ("INTERNAL://a", False), ("https://a", True), ("capture://x?token=1", True), (None, False), ("x", True)])
def test_reference(spark, reference, unsafe):
    assert one(spark, reference, text.unsafe_reference) == unsafe


@pytest.mark.parametrize("key", ["src1:source:12", "a", ""])
def test_name_uuid(spark, key):
    assert one(spark, key, timing.name_uuid) == str(uuid.uuid5(uuid.NAMESPACE_URL, key))


def test_due_backs_off(spark):
    at = datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(s, f, None if never else at) for s, f, never in ((60, 2, False), (60, 0, False), (60, 9, False), (None, 0, True), (60, 0, True))]
    df = spark.createDataFrame(rows, "s int, f int, at timestamp")
    due = lambda sec: [r.d for r in df.select(timing.is_due(F.timestamp_seconds(F.lit(at.timestamp() + sec)), F.col("at"), F.lit(None).cast("timestamp"), F.col("s"), F.col("f")).alias("d")).collect()]
    assert due(0) == [False, False, False, False, True]
    assert due(60) == [False, True, False, False, True]
    assert due(240) == [True, True, False, False, True]
    assert due(960) == [True, True, True, False, True]


def test_retry_ceiling(spark):
    df = spark.createDataFrame([(None, 2), (1200.0, 0), (-4.0, 1), (None, 20)], "after double, n int")
    assert [r.c for r in df.select(timing.retry_ceiling(F.col("after"), F.col("n")).alias("c")).collect()] == [20.0, 900.0, 0.0, 300.0]


def test_cursor_relations(spark):
    c = lambda p, i="a": json.dumps({"provider_item_id": i, "published_at": p}, separators=(",", ":"))
    rows = [(None, c("1"), True), (c("2"), c("2"), True), (c("2"), c("2"), False), (c("2"), c("1"), True), (c("2"), c("3"), False), ("junk", c("3"), True), (c("1"), "junk", True), (c("1", "b"), c("1", "a"), True)]
    df = spark.createDataFrame(rows, "a string, b string, s boolean")
    got = [r.r for r in df.select(text.cursor_relation(F.col("a"), F.col("b"), F.col("s")).alias("r")).collect()]
    assert got == ["advance", "unchanged", "invalid", "invalid", "advance", "invalid", "invalid", "invalid"]


def test_scores_have_bounds(spark):
    df = spark.createDataFrame([(0, True, 5, 5, 50), (9, True, 9, 9, 50), (1, False, 1, 0, None)], "e long, o boolean, s long, n long, p int")
    args = [F.col(c) for c in "eosnp"]
    rows = df.select(scoring.importance(*args).alias("i"), F.array_join(scoring.importance_reasons(*args), ";").alias("r"), F.round(scoring.confidence(F.col("e"), F.col("o"), F.col("s")), 4).alias("c")).collect()
    assert [(r.i, r.c) for r in rows] == [(0.0, 0.0), (100.0, 0.95), (10.0, 0.45)]
    assert rows[0].r == "no_active_evidence:0" and rows[2].r.startswith("base:10;source_diversity:0")
