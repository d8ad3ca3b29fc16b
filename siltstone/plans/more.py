"""Further registered queries: lookups with defaults, bindings, guards and roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text, timing
from siltstone.operators import coverage, dedup, normalize, payloads, projections, resolve, rollup, schedule, validate
from siltstone.operators.tables import dealt
from siltstone.plans.views import view, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = with_views(sql.strip())
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@_query("SELECT r.run_id, count(c.id) AS items FROM v_raw r LEFT JOIN (SELECT * FROM v_content WHERE external_id IS NOT NULL) c ON c.raw_item_id = r.id GROUP BY r.run_id")
def run_content_counts(spark, sf_dir):
    content = view(spark, sf_dir, "content").where("external_id is not null").select("raw_item_id", F.col("id").alias("content_id"))
    raw = view(spark, sf_dir, "raw")
    return raw.join(content, raw.id == content.raw_item_id, "left").groupBy("run_id").agg(F.count("content_id").alias("items"))


@_query("""SELECT a.id, coalesce(c.cursor, 'none') AS cursor_value, coalesce(c.errors, 0) AS errors FROM v_accounts a LEFT JOIN
(SELECT source_account_id, CAST(max(id) AS VARCHAR) AS cursor, count(*) FILTER (WHERE status = 'failed') AS errors FROM v_runs WHERE source_account_id IS NOT NULL AND status IN ('running', 'failed') GROUP BY 1) c ON c.source_account_id = a.id""")
def cursor_defaults(spark, sf_dir):
    runs = view(spark, sf_dir, "runs").where("source_account_id is not null and status in ('running', 'failed')")
    known = runs.groupBy("source_account_id").agg(F.max("id").cast("string").alias("cursor"), F.count_if(F.col("status") == "failed").alias("errors"))
    accounts = view(spark, sf_dir, "accounts")
    return accounts.join(known, accounts.id == known.source_account_id, "left").select("id", F.coalesce("cursor", F.lit("none")).alias("cursor_value"), F.coalesce("errors", F.lit(0).cast("long")).alias("errors"))


@_query("""
WITH p AS (SELECT external_id, content_hash, concat('loc', id % 3) AS loc, id AS seq FROM v_content WHERE source_published_at IS NOT NULL),
l AS (SELECT external_id, content_hash, loc, max(seq) AS meta FROM p GROUP BY ALL)
SELECT c.id, meta FROM v_content c LEFT JOIN l ON l.external_id IS NOT DISTINCT FROM c.external_id AND l.content_hash = c.content_hash AND l.loc = concat('loc', c.id % 3)""")
def sidecar_bind(spark, sf_dir):
    rows = view(spark, sf_dir, "content").select("id", "source_published_at", "external_id", F.col("content_hash").alias("payload_hash"), F.concat(F.lit("loc"), (F.col("id") % 3).cast("string")).alias("payload_location"))
    pending = rows.where("source_published_at is not null").select("external_id", "payload_hash", "payload_location", F.col("id").alias("seq"), F.col("id").alias("meta"))
    return normalize.bound_sidecar(rows.drop("source_published_at"), pending).select("id", "meta")


@_query("""
WITH f AS (SELECT provider, provider_item_id IS NULL AS no_id, event_time IS NULL AS no_time, provider_item_id IS NOT NULL AND event_time IS NOT NULL AS ready FROM v_evidence)
SELECT provider, count(*) AS items, count(*) FILTER (WHERE no_id) AS missing_id, count(*) FILTER (WHERE no_time) AS missing_time, count(*) FILTER (WHERE ready) AS dedup_keys FROM f GROUP BY provider""")
def replay_readiness(spark, sf_dir):
    has = lambda c: F.col(c).isNotNull()
    return view(spark, sf_dir, "evidence").groupBy("provider").agg(F.count("*").alias("items"), F.count_if(~has("provider_item_id")).alias("missing_id"), F.count_if(~has("event_time")).alias("missing_time"), F.count_if(has("provider_item_id") & has("event_time")).alias("dedup_keys"))


@_query("""
SELECT r.run_id, count(*) AS raw, count(c.id) AS visible, CASE WHEN count(*) > 0 AND count(c.id) = 0 THEN 'INVALID' ELSE 'OK' END AS guard
FROM v_raw r LEFT JOIN (SELECT * FROM v_content WHERE title IS NOT NULL AND canonical_url IS NOT NULL AND source_published_at IS NOT NULL) c ON c.raw_item_id = r.id GROUP BY r.run_id""")
def feed_guard(spark, sf_dir):
    visible = view(spark, sf_dir, "content").where("title is not null and canonical_url is not null and source_published_at is not null").select("raw_item_id", F.col("id").alias("c"))
    raw = view(spark, sf_dir, "raw")
    counted = raw.join(visible, raw.id == visible.raw_item_id, "left").groupBy("run_id").agg(F.count("*").alias("raw"), F.count("c").alias("visible"))
    return counted.withColumn("guard", F.when((F.col("raw") > 0) & (F.col("visible") == 0), "INVALID").otherwise("OK"))


@_query("SELECT evidence_id, count(DISTINCT candidate_id) AS n FROM v_links WHERE active GROUP BY 1 HAVING count(DISTINCT candidate_id) > 1")
def link_problems(spark, sf_dir):
    return resolve.link_problems(view(spark, sf_dir, "links"))


@_query("SELECT c_custkey AS evidence_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 11 = 0)")
def evidence_unprocessed(spark, sf_dir):
    """Customers as evidence, their orders as links, of which a part is active."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    links = orders.select(F.col("o_custkey").alias("evidence_id"), ((F.col("o_orderstatus") == "P") | (F.col("o_orderkey") % 11 == 0)).alias("active"))
    return resolve.unprocessed(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("evidence_id")), links)


@_query("SELECT id // 3 AS verification, CASE WHEN bool_and(http_status = 200) THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS checks FROM v_runs GROUP BY 1")
def verification_rollup(spark, sf_dir):
    return view(spark, sf_dir, "runs").groupBy(F.expr("id div 3").alias("verification")).agg(F.when(F.bool_and(F.col("http_status") == 200), "PASS").otherwise("FAIL").alias("verdict"), F.count("*").alias("checks"))


@_query("SELECT candidate_id, arg_min(CASE WHEN official THEN evidence_id END, evidence_id) AS strong FROM v_links WHERE official GROUP BY candidate_id")
def strong_identity(spark, sf_dir):
    rows = view(spark, sf_dir, "links").select("candidate_id", F.when(F.col("official"), F.col("evidence_id")).alias("strong"), "evidence_id")
    return rollup.sticky_first(rows, "candidate_id", "strong", "evidence_id")


@_query("""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY provider, provider_item_hash ORDER BY id) AS n FROM v_evidence)
SELECT provider, count(*) AS rows, count(*) FILTER (WHERE n = 1) AS first, count(*) FILTER (WHERE n > 1) AS repeated FROM b GROUP BY provider""")
def first_wins(spark, sf_dir):
    rows = view(spark, sf_dir, "evidence")
    first = dedup.first_of(rows, ["provider", "provider_item_hash"], [F.col("id")]).groupBy("provider").agg(F.count("*").alias("first"))
    return rows.groupBy("provider").agg(F.count("*").alias("rows")).join(first, "provider").withColumn("repeated", F.col("rows") - F.col("first"))


@_query("""SELECT event_id, CASE WHEN event_id % 11 = 0 OR s IN (401, 402, 403, 429) OR s >= 500 THEN 'BLOCKED' WHEN s NOT BETWEEN 200 AND 299 OR event_id % 7 = 0 THEN 'FAIL' WHEN event_id % 5 = 0 THEN 'FAIL' WHEN event_id % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS result
FROM (SELECT event_id, 200 + (event_id * 37) % 350 AS s FROM events)""")
def smoke_results(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    i = F.col("event_id")
    status = F.when(i % 11 != 0, 200 + (i * 37) % 350).cast("int")
    fields = F.when(i % 3 == 0, F.array(F.lit("other"))).otherwise(F.array(F.lit("other"), F.lit("k")))
    return events.select("event_id", validate.smoke_result(status, i % 7 != 0, (i % 5).cast("int"), fields, F.array(F.lit("k"))).alias("result"))


@_query("""SELECT event_id, CAST(CASE WHEN h ~ '^[0-9]+$' AND CAST(h AS BIGINT) <= 3600 THEN h END AS DOUBLE) AS retry_after, CAST(greatest(event_id % 500 + 120, 900) AS BIGINT) AS marker_seconds
FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'soon' ELSE CAST(event_id AS VARCHAR) END AS h FROM events)""")
def retry_headers(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    value = F.when(F.col("event_id") % 4 == 0, "soon").otherwise(F.col("event_id").cast("string"))
    headers = F.create_map(F.when(F.col("event_id") % 2 == 0, "Retry-After").otherwise("retry-after"), value, F.lit("date"), F.lit("x"))
    return events.select("event_id", timing.retry_after_header(headers).alias("retry_after"), timing.marker_seconds(F.col("event_id") % 500, F.lit(120), F.lit(900)).cast("long").alias("marker_seconds"))


@_query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#@\s]+([/?#]\S*)?$', 'i') AND NOT regexp_matches(url, '(api[_-]?key|authorization|token|secret|password)=', 'i') AND length(url) <= 4000 THEN url END AS safe_url FROM pages""")
def safe_urls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.safe_public_url(F.col("url")).alias("safe_url"))


# --- mappers: provider payloads made of the tables, as evidence -----------------------------------------------------

def _observed():
    return F.lit("2024-01-31 12:00:00").cast("timestamp")


@_query("""SELECT p_partkey AS part, 'provider-item:' || sha256('["' || p_brand || '",' || CAST(1700000000 + p_partkey AS VARCHAR) || ']') AS provider_item_id, 'asset:' || sha256('"' || p_brand || '"') AS asset,
  CAST(2 AS INT) AS numbers, 'validated' AS processing_status FROM part""")
def quote_mapping(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    body = F.to_json(F.struct(F.col("p_retailprice").alias("c"), F.col("p_size").alias("d"), F.lit("1.5").alias("dp"), F.lit(True).alias("h"), (1700000000 + F.col("p_partkey")).alias("t")))
    rows = normalize.quote_rows(part.select("p_partkey", F.col("p_brand").alias("symbol"), body.alias("body")))
    out = normalize.quote_evidence(rows.select(F.col("p_partkey").alias("part"), "symbol", "t", "item_id", "numeric_field_count"), _observed())
    # The envelope has no key of the row it was made from: the raw hash tells them apart, so the part comes from the item.
    named = rows.select(F.col("p_partkey").alias("part"), text.opaque_json("provider-item", text.json_list(text.json_string(F.col("symbol")), F.col("t").cast("string"))).alias("provider_item_id")).distinct()
    return out.join(named, "provider_item_id").select("part", "provider_item_id", F.get("asset_refs", F.lit(0)).alias("asset"), F.col("numeric_presence.numeric_field_count").alias("numbers"), "processing_status")


@_query("""SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 5 <> 0 THEN 'provider-item:' || sha256('["2024-0' || CAST(1 + n_nationkey % 9 AS VARCHAR) || '","' || n_name || '","RES"]') END AS provider_item_id,
  CAST(CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS numbers, CASE WHEN n_nationkey % 5 <> 0 THEN 'validated' ELSE 'blocked' END AS processing_status FROM nation""")
def energy_mapping(spark, sf_dir):
    k = F.col("n_nationkey")
    row = F.struct(F.concat(F.lit("2024-0"), (1 + k % 9).cast("string")).alias("period"), F.lit("1.5").alias("price"), F.lit("").alias("stateid"), F.col("n_name").alias("stateDescription"), F.when(k % 5 != 0, "RES").alias("sectorid"))
    body = F.to_json(F.struct(F.struct(F.array(row).alias("data")).alias("response")))
    # A number as text does not count, one as number does.
    body = F.regexp_replace(body, '"price":"1.5"', F.when(k % 3 == 0, '"price":1.5,"value":2').otherwise('"price":"1.5","value":2'))
    rows = normalize.energy_rows(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", body.alias("body")))
    out = normalize.energy_evidence(rows, _observed()).select(F.col("entity_refs"), "provider_item_id", F.col("numeric_presence.numeric_field_count").alias("numbers"), "processing_status")
    names = rows.select(F.col("n_nationkey").alias("nation"), F.array(text.opaque_ref("entity", F.col("stateDescription"))).alias("entity_refs"))
    return out.join(names, "entity_refs").select("nation", "provider_item_id", "numbers", "processing_status")


@_query("""SELECT 'provider-item:' || sha256('"d' || CAST(doc_id AS VARCHAR) || '"') AS provider_item_id, text IS NOT NULL AND text <> '' AS has_title, doc_id % 3 = 0 AS has_url, 'entity:' || sha256('"' || lang || '"') AS entity FROM documents""")
def news_mapping(spark, sf_dir):
    i = F.col("doc_id")
    url = F.when(i % 3 == 0, F.concat(F.lit("https://news.test/"), i.cast("string")))
    item = F.struct(F.concat(F.lit("d"), i.cast("string")).alias("uuid"), F.col("text").alias("title"), url.alias("url"), F.lit("2024-01-05T10:00:00Z").alias("published_at"), F.array("lang").alias("entities"))
    body = F.to_json(F.struct(F.array(item).alias("data")))
    rows = normalize.news_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select(body.alias("body"))).drop("body")
    return normalize.news_evidence(rows, _observed()).select("provider_item_id", "content_presence.has_title", "content_presence.has_url", F.get("entity_refs", F.lit(0)).alias("entity"))


@_query("""SELECT s_suppkey AS supplier, CASE WHEN s_nationkey < 20 THEN s_suppkey % 12 BETWEEN 1 AND [3, 1, 5, 10][1 + s_suppkey % 4] AND s_nationkey % 11 <= s_suppkey % 12 ELSE false END AS within FROM supplier""")
def capture_limits(spark, sf_dir):
    i = F.col("s_suppkey")
    provider = F.element_at(F.array(*(F.lit(p) for p in validate.CAPTURE_LIMITS)), (i % 4 + 1).cast("int"))
    count = F.when(F.col("s_nationkey") < 20, F.col("s_nationkey") % 11)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(i.alias("supplier"), validate.capture_within_limit(provider, i % 12, count).alias("within"))


@_query("""SELECT c_custkey AS customer, CASE WHEN c_custkey % 17 = 0 OR c_custkey % 19 = 0 THEN 'display_keys_invalid' WHEN c_custkey % 7 = 0 THEN 'provider_item_id_required' WHEN c_custkey % 11 = 0 THEN 'published_at_required'
  WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'title_unsafe' WHEN c_custkey % 13 = 0 OR c_custkey % 23 = 0 THEN 'url_unsafe' END AS display_error FROM customer""")
def display_errors(spark, sf_dir):
    i = F.col("c_custkey")
    title = F.when(i % 3 == 0, F.repeat(F.lit("x"), F.lit(2001))).when(i % 5 == 0, "my password=abc").when(i % 2 == 0, F.col("c_name"))
    url = F.when(i % 13 == 0, "https://user@host.test/a").when(i % 23 == 0, "https://host.test/a?Authorization=b").when(i % 2 == 0, "https://host.test/a")
    keys = F.when(i % 17 == 0, F.array(F.lit("provider_item_id"), F.lit("published_at"), F.lit("body"))).when(i % 19 == 0, F.array(F.lit("published_at"))).otherwise(F.array(F.lit("display_url"), F.lit("published_at"), F.lit("provider_item_id")))
    error = validate.display_error(F.when(i % 7 != 0, F.col("c_name")), F.when(i % 11 != 0, F.lit("2024-01-01")), title, url, keys)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(i.alias("customer"), error.alias("display_error"))


@_query("""WITH n AS (SELECT o_orderkey AS i, trim(regexp_replace(o_orderpriority, '\\s+', ' ', 'g')) AS t FROM orders)
SELECT 'n' || CAST(i AS VARCHAR) AS provider_item_id, CASE WHEN i % 3 = 0 THEN 'api_token,published_at,title,uuid' ELSE 'description,published_at,title,url,uuid' END AS keys_given, CASE WHEN i % 3 = 0 THEN 'published_at,title,uuid' ELSE 'description,published_at,title,url,uuid' END AS field_names,
  CASE WHEN i % 5 = 0 THEN NULL ELSE t END AS title, i % 3 <> 0 AS has_description, i % 3 <> 0 AND i % 7 <> 0 AS has_url, i % 11 <> 0 AS is_valid FROM n WHERE i % 11 <> 0
UNION ALL SELECT NULL, CASE WHEN i % 3 = 0 THEN 'api_token,published_at,title,uuid' ELSE 'description,published_at,title,url,uuid' END, CASE WHEN i % 3 = 0 THEN 'published_at,title,uuid' ELSE 'description,published_at,title,url,uuid' END,
  CASE WHEN i % 5 = 0 THEN NULL ELSE t END, i % 3 <> 0, i % 3 <> 0 AND i % 7 <> 0, false FROM n WHERE i % 11 = 0""")
def news_items_sanitised(spark, sf_dir):
    """Items made of orders as JSON, read back: some lack fields, some name or hold secrets."""
    i, q = F.col("o_orderkey"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    uuid = F.when(i % 11 == 0, F.lit('"my token"')).otherwise(q(F.concat(F.lit("n"), i.cast("string"))))
    title = F.when(i % 5 == 0, F.lit('"see secret=1"')).otherwise(q(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("  "))))
    url = F.when(i % 7 == 0, F.lit('"ftp://host.test/"')).otherwise(F.lit('"https://host.test/a"'))
    more = F.when(i % 3 == 0, F.lit('"api_token":"x"')).otherwise(F.concat(F.lit('"description":"d","url":'), url))
    body = F.concat(F.lit('{"uuid":'), uuid, F.lit(',"title":'), title, F.lit(',"published_at":"2024-01-05T10:00:00Z",'), more, F.lit("}"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(body.alias("item"))
    rows = rows.select(F.json_object_keys("item").alias("keys"), F.from_json("item", "uuid string, title string, url string, snippet string, description string, published_at string").alias("v")).select("keys", "v.*")
    given = rows.withColumn("keys_given", F.array_join(F.array_sort("keys"), ","))
    out = validate.news_item(rows).select("provider_item_id", F.array_join("field_names", ",").alias("field_names"), "title", "has_description", "has_url", "is_valid")
    # The keys that were given depend on one thing only, which what is left of them tells.
    return out.join(given.select(F.array_join(F.array_sort(F.filter("keys", lambda k: k != "api_token")), ",").alias("field_names"), "keys_given").distinct(), "field_names")


@_query("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'COLLECTION_CANCELLED' WHEN event_id % 11 = 0 THEN 'COLLECTION_TIMEOUT'
  ELSE [NULL, 'COLLECTION_CONFIG_INVALID', 'COLLECTION_CONTRACT_INVALID', 'COLLECTION_RATE_LIMITED', 'COLLECTION_TIMEOUT', CASE WHEN event_id % 2 = 0 THEN 'COLLECTION_UPSTREAM_RETRYABLE' ELSE 'COLLECTION_CONTRACT_INVALID' END, 'COLLECTION_UNKNOWN'][event_id % 7 + 1] END AS error FROM events""")
def collection_errors(spark, sf_dir):
    i = F.col("event_id")
    said = F.get(F.array(F.lit(None), *(F.lit(c) for c in ("provider_config_invalid", "provider_contract_invalid", "provider_rate_limited", "provider_timeout", "provider_upstream_error", "provider_on_fire"))), (i % 7).cast("int"))
    error = validate.collection_error(said, F.when(i % 2 == 0, True), cancelled=i % 13 == 0, past_deadline=F.when(i % 11 == 0, True))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", error.alias("error"))


@_query("""SELECT c_custkey AS customer, CASE WHEN c_custkey % 5 NOT BETWEEN 1 AND 3 THEN 'provider_record_limit_invalid' WHEN c_custkey % 7 = 0 THEN 'provider_deadline_invalid' WHEN c_custkey % 11 = 0 THEN 'provider_config_fields_invalid'
  WHEN c_custkey % 13 = 0 THEN 'provider_config_unsafe' WHEN c_custkey % 3 = 0 THEN 'provider_timeout_invalid' WHEN c_custkey % 17 = 0 THEN 'provider_language_invalid' WHEN c_custkey % 19 = 0 THEN 'provider_symbols_invalid' END AS request_error FROM customer""")
def request_errors(spark, sf_dir):
    i = F.col("c_custkey")
    now = F.lit("2024-01-31 12:00:00").cast("timestamp")
    key = F.when(i % 11 == 0, "odd").otherwise("language")
    config = F.create_map(key, F.when(i % 13 == 0, "token x").otherwise("en"))
    symbols = F.when(i % 19 == 0, F.array_repeat(F.lit("S"), 11)).when(i % 2 == 0, F.array(F.lit("S")))
    error = validate.request_error(i % 5, F.when(i % 7 == 0, now).otherwise(now + F.expr("interval 1 minute")), now, config, ("language", "symbols", "timeout_seconds"), F.when(i % 3 == 0, 0.0), F.when(i % 17 == 0, ""), symbols)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(i.alias("customer"), error.alias("request_error"))


@_query("""SELECT id, CASE WHEN status = 'succeeded' AND (fetched_count = 0 OR http_status = 200) THEN 'PASS' ELSE 'FAIL' END AS verdict, status = 'succeeded' AND fetched_count = 0 AS no_new_items FROM v_runs""")
def provider_outcomes(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    evidence = F.when(F.col("http_status") == 200, F.col("fetched_count")).otherwise(0)
    errors = F.when(F.col("status") == "failed", F.array(F.lit("COLLECTION_UPSTREAM_5XX")))
    out = schedule.provider_outcome(F.col("status").isin("succeeded", "failed"), F.col("fetched_count"), evidence, F.col("status"), errors)
    return runs.select("id", out.alias("o")).select("id", F.col("o.status").alias("verdict"), "o.no_new_items")


# --- projections of items, and payloads of any depth ----------------------------------------------------------------

def _projections(spark, sf_dir):
    """Projections of all four providers made of orders; some break one rule each."""
    i = F.col("o_orderkey")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    item = F.when(i % 23 == 0, F.lit("7")).when(i % 29 == 0, F.lit('"a token"')).otherwise(q(F.concat(F.lit("o"), i.cast("string"))))
    names = F.when(i % 31 == 0, F.lit('["a",null]')).when(i % 37 == 0, F.lit('"a"')).otherwise(F.lit('["a","b"]'))
    hashed = F.when(i % 41 == 0, F.lit('"ff"')).otherwise(q(F.sha2(i.cast("string"), 256)))
    place = F.when(i % 43 == 0, F.lit('"https://a.test/"')).otherwise(F.lit('"internal://a"'))
    flag = F.when(i % 47 == 0, F.lit('"yes"')).when(i % 2 == 0, F.lit("true")).otherwise(F.lit("false"))
    own = F.element_at(F.array(
        F.concat(F.lit('"has_title":'), flag, F.lit(',"has_description":false,"has_snippet":true,"has_source_url":false')), F.concat(F.lit('"symbol":"S","numeric_field_count":'), F.when(i % 47 == 0, F.lit("1.5")).otherwise((i % 8).cast("string"))),
        F.concat(F.lit('"geography":"G","sector":"R","has_numeric_value":'), flag), F.concat(F.lit('"ticker":"T","form":"10-K","has_primary_document":'), flag)), (i % 4 + 1).cast("int"))
    more = F.when(i % 53 == 0, F.lit(',"more":1')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"provider_item_id":'), item, F.lit(',"published_at":"2024-01-05T10:00:00Z","field_names":'), names, F.lit(',"payload_hash":'), hashed, F.lit(',"payload_reference":'), place, F.lit(","), own, more, F.lit("}"))
    provider = F.when(i % 59 == 0, F.lit("odd")).otherwise(F.element_at(F.array(*(F.lit(p) for p in validate.PROVIDERS)), (i % 4 + 1).cast("int")))
    # Some 100 microseconds of work follow for a row, so rows of one large file are dealt out to all tasks.
    orders = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")
    return orders.select(i.alias("id"), provider.alias("provider"), body.alias("projection"), _observed().alias("observed_at"))


_PROJECTION_ERROR = """CASE WHEN o_orderkey % 59 = 0 THEN 'unknown_provider' WHEN o_orderkey % 53 = 0 THEN 'projection_keys_mismatch' WHEN o_orderkey % 23 = 0 OR o_orderkey % 29 = 0 THEN 'projection_identity_invalid'
  WHEN o_orderkey % 31 = 0 OR o_orderkey % 37 = 0 THEN 'field_names_invalid' WHEN o_orderkey % 41 = 0 THEN 'payload_hash_invalid' WHEN o_orderkey % 43 = 0 THEN 'payload_reference_invalid' WHEN o_orderkey % 47 = 0 THEN 'provider_fields_invalid' END"""


@_query(f"SELECT o_orderkey AS id, {_PROJECTION_ERROR} AS projection_error FROM orders")
def projection_errors(spark, sf_dir):
    rows = _projections(spark, sf_dir)
    return rows.select("id", projections.content_error(F.col("provider"), F.col("projection")).alias("projection_error"))


@_query(f"""
WITH ok AS (SELECT o_orderkey AS i, 'o' || CAST(o_orderkey AS VARCHAR) AS item, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'null' END AS said FROM orders WHERE ({_PROJECTION_ERROR}) IS NULL),
made AS (SELECT CASE i % 4
    WHEN 0 THEN '{{"description":null,"published_at":"2024-01-05T10:00:00Z","snippet":true,"title":' || said || ',"url":null,"uuid":"' || item || '"}}'
    WHEN 1 THEN '{{' || array_to_string(list_transform(['c','d','dp','h','l','o','pc'][1:i % 8], lambda f: '"' || f || '":0,'), '') || '"published_at":"2024-01-05T10:00:00Z","t":"2024-01-05T10:00:00Z"}}'
    WHEN 2 THEN '{{"period":"2024-01-05T10:00:00Z","price":' || replace(said, 'true', '0') || ',"published_at":"2024-01-05T10:00:00Z","sectorid":"R","stateid":"G"}}'
    ELSE '{{"accessionNumber":"' || item || '","filingDate":"2024-01-05T10:00:00Z","form":"10-K","primaryDocument":' || said || ',"published_at":"2024-01-05T10:00:00Z"}}' END AS body,
  CASE i % 4 WHEN 1 THEN '["S","2024-01-05T10:00:00Z"]' WHEN 2 THEN '["2024-01-05T10:00:00Z","G","R"]' ELSE '"' || item || '"' END AS ident, CASE i % 4 WHEN 1 THEN i % 8 WHEN 2 THEN CAST(said = 'true' AS INT) ELSE 0 END AS numbers, i % 4 AS p FROM ok)
SELECT ['marketaux', 'finnhub', 'eia', 'sec_edgar'][1 + p] AS provider, 'provider-item:' || sha256(ident) AS provider_item_id, sha256(body) AS provider_item_hash, CAST(numbers AS INT) AS numbers FROM made""")
def projection_mapping(spark, sf_dir):
    out = projections.projection_evidence(_projections(spark, sf_dir))
    return out.select("provider", "provider_item_id", "provider_item_hash", F.col("numeric_presence.numeric_field_count").alias("numbers"))


@_query("""SELECT s_suppkey AS id, '{"a":{"Access_Token":"[REDACTED]","b":[1,{"secret":"[REDACTED]","n":' || CAST(s_suppkey AS VARCHAR) || '}]},"u":"x?token=1"}' AS redacted,
  '{"a":{"Access_Token":[1],"b":[1,{"secret":{"k":2},"n":' || CAST(s_suppkey AS VARCHAR) || '}]}' || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ',"u":"x"' END || '}' AS cleaned, s_suppkey % 2 = 0 AS has_secret FROM supplier""")
def payload_secrets(spark, sf_dir):
    i = F.col("s_suppkey").cast("string")
    body = lambda url: F.concat(F.lit('{"a":{"Access_Token":[1],"b":[1,{"secret":{"k":2},"n":'), i, F.lit('}]},"u":"'), url, F.lit('"}'))
    some = body(F.when(F.col("s_suppkey") % 2 == 0, "x?token=1").otherwise("x"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), body(F.lit("x?token=1")).alias("all"), some.alias("some"))
    return payloads.with_secret_flag(payloads.cleaned(payloads.redacted(rows, "all", "redacted"), "some", "cleaned"), "some", "has_secret").drop("all", "some")


def _captures(spark, sf_dir) -> DataFrame:
    """A response of each provider, and of an unknown one, made of each supplier."""
    i = F.col("s_suppkey")
    n, k = i.cast("string"), (i % 4).cast("int")
    news = F.concat(F.lit('{"meta":{"token":"t"},"data":['), F.array_join(F.transform(F.sequence(F.lit(1), 1 + i % 3), lambda j: F.concat(F.lit('{"uuid":"'), n, F.lit("-"), j.cast("string"), F.lit('","score":2.50,"title":'), F.when(j == 2, F.lit('""')).otherwise(F.lit('"\u00e9"')), F.lit(',"published_at":"2024-01-05"}'))), ","), F.lit(',"no item"]}'))
    quote = F.concat(F.lit('{"t":1700000000,"c":'), F.when(i % 3 == 0, F.lit("null")).otherwise(F.lit("1e2")), F.lit("}"))
    energy = F.concat(F.lit('{"response":{"total":2,"data":[{"stateid":"NY","period":"2024-01","sectorid":'), F.when(i % 3 == 0, F.lit('""')).otherwise(F.lit('"RES"')), F.lit('},{"period":""}]}}'))
    filing = F.lit('{"filings":{"recent":{"form":["10-K","8-K"],"accessionNumber":["a"],"filingDate":[],"size":3}}}')
    provider = F.when(i % 9 == 0, "odd").otherwise(F.get(F.array(*(F.lit(p) for p in validate.PROVIDERS)), k))
    context = F.create_map(F.lit("symbol"), F.when(i % 5 != 0, F.lit("S")), F.when(i % 2 == 0, F.lit("cik")).otherwise("other"), F.lit("1"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(i.alias("capture"), provider.alias("provider"), F.get(F.array(news, quote, energy, filing), k).alias("body"), context.alias("context"))
    return payloads.item_texts(rows, "body", "items")


_CAPTURES = """WITH s AS (SELECT s_suppkey AS i, CASE WHEN s_suppkey % 9 = 0 THEN 'odd' ELSE ['marketaux', 'finnhub', 'eia', 'sec_edgar'][s_suppkey % 4 + 1] END AS provider, s_suppkey % 4 AS k FROM supplier)"""


@_query(_CAPTURES + """, t AS (
  SELECT i, unnest(CASE provider WHEN 'marketaux' THEN list_transform(range(1, 2 + i % 3), lambda j: '{"published_at":"2024-01-05","score":2.5,"title":"' || CASE WHEN j = 2 THEN '' ELSE '\\u00e9' END || '","uuid":"' || CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR) || '"}')
    WHEN 'finnhub' THEN ['{"c":' || CASE WHEN i % 3 = 0 THEN 'null' ELSE '100.0' END || ',"t":1700000000}'] WHEN 'eia' THEN ['{"period":"2024-01","sectorid":"' || CASE WHEN i % 3 = 0 THEN '' ELSE 'RES' END || '","stateid":"NY"}', '{"period":""}']
    WHEN 'sec_edgar' THEN ['{"accessionNumber":"a","form":"10-K"}', '{"form":"8-K"}'] END) AS item FROM s)
SELECT i AS capture, sha256(item) AS item_hash, length(item) AS chars FROM t""")
def item_hashes(spark, sf_dir):
    items = _captures(spark, sf_dir).select("capture", F.explode("items").alias("item"))
    return items.select("capture", text.stable_hash(F.col("item")).alias("item_hash"), F.char_length("item").alias("chars"))


@_query(_CAPTURES + """SELECT i AS capture, provider, CASE provider WHEN 'marketaux' THEN 1 + i % 3 WHEN 'finnhub' THEN 1 WHEN 'odd' THEN 0 ELSE 2 END AS input_items,
  CASE provider WHEN 'marketaux' THEN 'published_at:0,title:' || CASE WHEN i % 3 >= 1 THEN '1' ELSE '0' END || ',url:' || CAST(1 + i % 3 AS VARCHAR) || ',uuid:0' WHEN 'finnhub' THEN 'c:' || CASE WHEN i % 3 = 0 THEN '1' ELSE '0' END || ',t:0' WHEN 'eia' THEN 'period:1'
    WHEN 'sec_edgar' THEN 'accessionNumber:1,filingDate:2,form:0' ELSE '' END AS missing,
  CASE provider WHEN 'marketaux' THEN 1 + i % 3 WHEN 'finnhub' THEN CASE WHEN i % 5 <> 0 THEN 1 ELSE 0 END WHEN 'eia' THEN CASE WHEN i % 3 = 0 THEN 0 ELSE 1 END WHEN 'sec_edgar' THEN 1 ELSE 0 END AS dedup_keys,
  CASE provider WHEN 'finnhub' THEN 'symbol' WHEN 'eia' THEN 'sectorid,stateid' WHEN 'sec_edgar' THEN CASE WHEN i % 2 = 0 THEN 'cik,form' ELSE 'form' END ELSE '' END AS entities,
  CASE provider WHEN 'marketaux' THEN 'published_at' WHEN 'finnhub' THEN 't' WHEN 'eia' THEN 'period' ELSE '' END AS times, CASE provider WHEN 'odd' THEN 'unknown_provider,no_input_items' ELSE '' END AS errors, provider <> 'odd' AS replay_ready FROM s""")
def replay_summaries(spark, sf_dir):
    found = coverage.replay_summaries(_captures(spark, sf_dir), "capture")
    missing = F.array_join(F.transform(F.array_sort(F.map_entries("missing_required_fields")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    joined = lambda c, name: F.array_join(c, ",").alias(name)
    return found.select("capture", "provider", "input_items", missing.alias("missing"), F.col("dedup_key_available_count").alias("dedup_keys"), joined("entity_fields_available", "entities"), joined("timestamp_fields_available", "times"), joined("errors", "errors"), "replay_ready")


@_query(_CAPTURES + """SELECT i AS capture, ['data,meta', 'c,t', 'response', 'filings'][k + 1] AS top_level_keys, ['published_at,score,title,uuid', '', '', ''][k + 1] AS news_keys, CASE k WHEN 0 THEN 2 + i % 3 END AS news_count,
  CASE k WHEN 2 THEN 'period,sectorid,stateid' ELSE '' END AS energy_keys, CASE k WHEN 2 THEN 2 END AS energy_count, CASE k WHEN 3 THEN 'accessionNumber,filingDate,form,size' ELSE '' END AS filing_keys, CASE k WHEN 3 THEN 2 END AS filing_count FROM s""")
def response_shapes(spark, sf_dir):
    rows = _captures(spark, sf_dir).select("capture", "body")
    for name, path, columnar in (("news", "$.data", False), ("energy", "$.response.data", False), ("filing", "$.filings.recent", True)):
        rows = normalize.response_shape(rows, item_path=path, columnar=columnar).withColumnsRenamed({"item_keys": f"{name}_keys", "item_count": f"{name}_count"})
    return rows.drop("body")


@_query("""SELECT CASE WHEN official_source THEN 'official' ELSE 'other' END AS grp, count(*) FILTER (WHERE provider_item_id IS NOT NULL) AS provider_item_id_available_count, count(*) FILTER (WHERE event_time IS NOT NULL) AS event_time_available_count, count(*) FILTER (WHERE id % 3 <> 0) AS entity_available_count,
  count(*) AS dedup_key_available_count, count(*) FILTER (WHERE official_source) AS official_source_count, count(*) FILTER (WHERE provider = 'finnhub') AS market_data_count, count(*) FILTER (WHERE provider = 'sec_edgar') AS disclosure_count, count(*) FILTER (WHERE provider = 'marketaux') AS news_signal_count FROM v_evidence GROUP BY 1""")
def envelope_counts(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = view(spark, sf_dir, "evidence").withColumns({
        "grp": F.when(F.col("official_source"), "official").otherwise("other"), "entity_refs": F.when(F.col("id") % 3 == 1, F.array("entity")).otherwise(none), "asset_refs": F.when(F.col("id") % 3 == 2, F.array("entity")).otherwise(none),
        "official_source_flag": F.col("official_source"), "market_data_flag": F.col("provider") == "finnhub", "disclosure_flag": F.col("provider") == "sec_edgar", "news_signal_flag": F.col("provider") == "marketaux"})
    return coverage.envelope_coverage(rows, "grp")


@_query("""SELECT 'items' AS name, CAST(NULL AS VARCHAR) AS key, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem UNION ALL SELECT 'types', l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'captures_seen', NULL, count(*) FROM lineitem
UNION ALL SELECT 'shipped', NULL, arg_max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END, l_orderkey * 10 + l_linenumber) FROM lineitem UNION ALL SELECT 'odd', NULL, 1""")
def summaries_merged(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = lambda k, v: F.create_map(k, v.cast("long"))
    flags = F.create_map(F.lit("shipped"), F.col("l_linestatus") == "F", F.lit("odd"), F.when(F.col("l_linenumber") == 1, F.lit(True)))
    rows = lines.select(one(F.lit("items"), F.col("l_linenumber")).alias("counts"), F.create_map(F.lit("types"), one(F.col("l_returnflag"), F.lit(1))).alias("nested"), flags.alias("flags"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return coverage.merged(rows, order="place")
