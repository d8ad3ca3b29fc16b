"""Registered queries of single records: times, projections against raw rows, candidates for a replay, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scoring, text
from siltstone.operators import coverage, feed, normalize, payloads, projections, schedule, validate
from siltstone.plans import more
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


def _pick(index, *values):
    return F.get(F.array(*(F.lit(v) if v is None or isinstance(v, str) else v for v in values)), index.cast("int"))


@_query("""SELECT event_id, strftime(CASE event_id % 9 WHEN 0 THEN TIMESTAMP '1970-01-01' + to_seconds(1700000000 + event_id) WHEN 1 THEN TIMESTAMP '1970-01-01' + to_milliseconds(1500 + event_id * 1000) WHEN 2 THEN TIMESTAMP '2024-03-01'
  WHEN 3 THEN TIMESTAMP '2024-03-05 08:00:00' WHEN 4 THEN TIMESTAMP '2024-03-05 10:00:00' END, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events""")
def json_instants(spark, sf_dir):
    """Seconds, months, times with and without zone; a year, a word, a boolean and null are no times."""
    i = F.col("event_id")
    said = _pick(i % 9, (1700000000 + i).cast("string"), F.concat((1 + i).cast("string"), F.lit(".5")), '"2024-03"', '"2024-03-05T10:00:00+02:00"', '" 2024-03-05 10:00:00 "', '"2024"', '"soon"', "true", "null")
    at = text.instant_of_json(F.parse_json(said))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


#: Projections made of evidence, of which each part differs from the raw row in one way; raw rows have what was collected.
@_query("""
WITH r AS (SELECT r.id, r.source_id, r.source_account_id, c.external_id, c.content_hash, concat('internal://', r.id) AS place FROM v_raw r JOIN v_content c ON c.id = r.id),
p AS (SELECT e.id, CASE WHEN e.id % 25 = 3 THEN -1 - e.id ELSE e.id END AS raw_item_id, CASE WHEN e.id % 7 = 0 THEN 'other' ELSE e.source_id END AS source_id, CASE WHEN e.id % 11 = 0 THEN NULL ELSE e.source_account_id END AS account, CASE WHEN e.id % 13 = 0 THEN 'odd' ELSE e.provider END AS provider,
  CASE WHEN e.id % 17 = 0 THEN 'zz' ELSE c.external_id END AS item, CASE WHEN e.id % 19 = 0 THEN 'ff' ELSE c.content_hash END AS hash, CASE WHEN e.id % 23 = 0 THEN 'internal://x' ELSE concat('internal://', e.id) END AS place FROM v_evidence e JOIN v_content c ON c.id = e.id)
SELECT p.id, CASE WHEN r.id IS NULL THEN 'raw_item_id' ELSE nullif(concat_ws(',', CASE WHEN p.source_id IS DISTINCT FROM r.source_id THEN 'source_id' END, CASE WHEN p.account IS DISTINCT FROM r.source_account_id THEN 'source_account_id' END, CASE WHEN p.provider = 'odd' THEN 'provider' END,
  CASE WHEN p.item IS DISTINCT FROM r.external_id THEN 'external_id' END, CASE WHEN p.hash IS DISTINCT FROM r.content_hash THEN 'payload_hash' END, CASE WHEN p.place IS DISTINCT FROM r.place THEN 'payload_location' END), '') END AS mismatch
FROM p LEFT JOIN r ON r.id = p.raw_item_id""")
def raw_projection_mismatch(spark, sf_dir):
    content = view(spark, sf_dir, "content").select(F.col("id").alias("c"), "external_id", "content_hash")
    raw = view(spark, sf_dir, "raw")
    raw = raw.join(content, raw.id == content.c).select("id", "source_id", "source_account_id", "external_id", F.col("content_hash").alias("payload_hash"), F.concat(F.lit("internal://"), F.col("id").cast("string")).alias("payload_location"))
    e, i = view(spark, sf_dir, "evidence"), F.col("id")
    fault = lambda n, bad, good: F.when(i % n == 0, bad).otherwise(good)
    said = F.to_json(F.struct(
        fault(17, F.lit("zz"), F.col("external_id")).alias("provider_item_id"), fault(19, F.lit("ff"), F.col("content_hash")).alias("payload_hash"), fault(23, F.lit("internal://x"), F.concat(F.lit("internal://"), i.cast("string"))).alias("payload_reference")))
    made = e.join(content, e.id == content.c).select(
        "id", F.when(i % 25 == 3, -1 - i).otherwise(i).alias("raw_item_id"), fault(7, F.lit("other"), F.col("source_id")).alias("source_id"), fault(11, F.lit(None), F.col("source_account_id")).alias("source_account_id"),
        fault(13, F.lit("odd"), F.col("provider")).alias("provider"), said.alias("projection"))
    return projections.raw_mismatch(made, raw).select("id", "mismatch")


@_query(f"""
WITH p AS (SELECT o_orderkey AS id, o_orderkey // 3 AS raw_item_id, ({more._PROJECTION_ERROR}) IS NOT NULL AS bad, o_orderkey % 5 = 0 AS naive FROM orders),
e AS (SELECT *, row_number() OVER (PARTITION BY raw_item_id, NOT bad AND NOT naive ORDER BY id) AS place FROM p)
SELECT id, CASE WHEN bad THEN 'projection_invalid' WHEN naive THEN 'projection_observed_at_invalid' WHEN place > 1 THEN 'projection_already_exists' END AS save_error FROM e""")
def projection_saves(spark, sf_dir):
    rows = more._projections(spark, sf_dir).drop("observed_at").withColumns({"raw_item_id": F.expr("id div 3"), "observed_at": F.when(F.col("id") % 5 == 0, "2024-01-31T12:00:00").otherwise("2024-01-31T12:00:00+00:00")})
    return projections.saved(rows, ["id"]).select("id", "save_error")


@_query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 2 = 0 THEN 'a_failed' END, CASE WHEN event_id % 3 = 0 THEN 'b_failed' END, CASE WHEN event_id % 5 = 0 AND event_id % 2 <> 0 THEN 'a_failed' END], lambda x: x IS NOT NULL), ',') AS errors FROM events""")
def error_lists(spark, sf_dir):
    i = F.col("event_id")
    said = F.array_compact(F.array(F.when(i % 2 == 0, "a_failed"), F.when(i % 3 == 0, "b_failed"), F.when(i % 2 == 0, "a_failed"), F.when(i % 3 == 0, "b_failed")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.array_join(schedule.error_list(said, F.when(i % 5 == 0, "A_FAILED")), ",").alias("errors"))


@_query("""WITH p AS (SELECT CASE WHEN id % 9 = 0 THEN 'odd' ELSE provider END AS provider FROM v_evidence)
SELECT provider, count(*) AS items, CAST(list_position(['marketaux', 'finnhub', 'eia', 'sec_edgar'], provider) - 1 AS INT) AS provider_place FROM p GROUP BY provider""")
def providers_in_order(spark, sf_dir):
    rows = view(spark, sf_dir, "evidence").select(F.when(F.col("id") % 9 == 0, "odd").otherwise(F.col("provider")).alias("provider"))
    return feed.in_provider_order(coverage.histogram(rows, "provider"))


@_query("""WITH r AS (SELECT candidate_id, count(DISTINCT source_id) AS sources, array_to_string(list_sort(list_distinct(list(entity))), ',') AS companies FROM v_links WHERE active GROUP BY 1)
SELECT candidate_id, companies, 'uncertain' AS impact_direction, 'short_term' AS impact_horizon, CASE WHEN sources > 1 THEN 0.5 ELSE 0.25 END::DOUBLE AS confidence, 'Deterministic mock; human-reviewed impact analysis is required.' AS rationale_summary, true AS required_market_validation, 1 AS analysis_version FROM r""")
def event_impact_analysis(spark, sf_dir):
    links, none = view(spark, sf_dir, "links").where("active"), F.array().cast("array<string>")
    values = links.select("candidate_id", "entity").distinct().groupBy("candidate_id").agg(F.array_sort(F.collect_list("entity")).alias("companies"))
    rows = links.groupBy("candidate_id").agg(F.count_distinct("source_id").alias("sources")).join(values, "candidate_id")
    made = rows.select("candidate_id", scoring.mock_impact(F.col("sources"), F.col("companies"), none, none, F.lit("high")).alias("a"))
    return made.select("candidate_id", F.array_join("a.affected_companies", ",").alias("companies"), "a.impact_direction", "a.impact_horizon", "a.confidence", "a.rationale_summary", "a.required_market_validation", "a.analysis_version")


@_query("""SELECT p_partkey AS part, CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END AS INT) AS numeric_field_count, CASE WHEN p_size % 4 <> 0 AND p_partkey % 5 <> 0 THEN p_brand || ':' || CAST(1700000000 + p_partkey AS VARCHAR) END AS item_id FROM part""")
def quotes_with_numbers(spark, sf_dir):
    i = F.col("p_partkey")
    price = F.when(F.col("p_size") % 4 == 0, F.lit('"1.5"')).otherwise(F.lit("1.5"))
    body = F.concat(F.lit('{"c":'), price, F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(',"t":'), (1700000000 + i).cast("string"))), F.lit("}"))
    rows = normalize.quote_rows(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("symbol"), body.alias("body")))
    return rows.select(F.col("p_partkey").alias("part"), "numeric_field_count", "item_id")


@_query("""SELECT s_suppkey AS id, '{"data":[1,{"k":2}],"response":{"data":[1,2,3]},"n":' || CAST(s_suppkey AS VARCHAR) || '}' AS news, '{"data":[1,{"k":2},"3"],"response":{"data":[1,2]},"n":' || CAST(s_suppkey AS VARCHAR) || '}' AS energy FROM supplier""")
def payloads_shortened(spark, sf_dir):
    body = F.concat(F.lit('{"data":[1,"a?token=1",{"k":2,"Token":3},"3"],"response":{"data":[1,2,3]},"n":'), F.col("s_suppkey").cast("string"), F.lit("}"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), body.alias("body"), F.lit("marketaux").alias("a"), F.lit("eia").alias("b"))
    return payloads.shortened(payloads.shortened(rows, "body", "news", 2, provider="a"), "body", "energy", 2, provider="b").select("id", "news", "energy")


@_query("""SELECT c_custkey AS customer, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS leaks FROM customer""")
def request_leaks(spark, sf_dir):
    i = F.col("c_custkey")
    params = F.create_map(F.when(i % 3 == 0, "API_Token").otherwise("symbols"), F.col("c_name"), F.lit("filter"), F.when(i % 5 == 0, "token=1").otherwise("x"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(i.alias("customer"), validate.request_leaks(params).alias("leaks"))


@_query("""SELECT s_suppkey AS supplier, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'S quote' WHEN 2 THEN 'Energy data NY 2024-01' ELSE '10-K filing S' END AS title, ['news', 'market_data', 'official_data', 'filing'][s_suppkey % 4 + 1] AS kind FROM supplier""")
def display_titles(spark, sf_dir):
    provider = _pick(F.col("s_suppkey") % 4, *validate.PROVIDERS)
    title = normalize.display_title(provider, symbol=F.lit("S"), period=F.lit("2024-01"), place=F.lit("NY"), form=F.lit("10-K"), title=F.col("s_name"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("supplier"), title.alias("title"), normalize.content_kind(provider).alias("kind"))


@_query("""SELECT 'provider-item:' || sha256('"a' || CAST(s_suppkey AS VARCHAR) || '"') AS provider_item_id, '2024-01-02 10:00:00' AS at, true AS has_url, 'asset:' || sha256('"T"') AS asset FROM supplier
UNION ALL SELECT 'provider-item:' || sha256('"b' || CAST(s_suppkey AS VARCHAR) || '"'), '2024-01-03 00:00:00', false, 'asset:' || sha256('"T"') FROM supplier""")
def filing_mapping(spark, sf_dir):
    i = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit('{"filings":{"recent":{"accessionNumber":["a'), i, F.lit('","b'), i, F.lit('","cut"],"filingDate":["2024-01-01","2024-01-03"],"acceptanceDateTime":["2024-01-02T10:00:00Z","never"],"reportDate":["2023-12-31","2023-12-30"],"form":["8-K","10-Q"],"primaryDocument":["d",""]}}}'))
    rows = normalize.filing_rows(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(body.alias("body"), F.lit("T").alias("ticker")))
    out = normalize.filing_evidence(rows, more._observed())
    return out.select("provider_item_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("at"), "content_presence.has_url", F.get("asset_refs", F.lit(0)).alias("asset"))


@_query(more._CAPTURES + """, b AS (SELECT i, unnest(CASE provider WHEN 'marketaux' THEN list_transform(range(1, 2 + i % 3), lambda j: CASE WHEN j = 2 THEN 'item,time,dedup,news' ELSE 'item,time,dedup,content,news' END)
    WHEN 'finnhub' THEN [array_to_string(list_filter([CASE WHEN i % 5 <> 0 THEN 'item' END, 'time', 'source', CASE WHEN i % 5 <> 0 THEN 'entity' END, CASE WHEN i % 5 <> 0 THEN 'asset' END, CASE WHEN i % 5 <> 0 THEN 'dedup' END, CASE WHEN i % 3 <> 0 THEN 'numeric' END, 'market'], lambda x: x IS NOT NULL), ',')]
    WHEN 'eia' THEN [CASE WHEN i % 3 = 0 THEN 'time,source,entity,official' ELSE 'item,time,source,entity,dedup,official' END, 'source,official'] WHEN 'sec_edgar' THEN ['item,source,dedup,official,disclosure', 'source,official,disclosure'] END) AS has FROM s)
SELECT i AS capture, has, count(*) AS items FROM b GROUP BY ALL""")
def replay_candidates(spark, sf_dir):
    found = coverage.replay_candidates(more._captures(spark, sf_dir))
    has = F.concat_ws(",", *(F.when(F.col(c), F.lit(name)) for name, c in (
        ("item", "provider_item_id_available"), ("time", "event_time_available"), ("source", "source_available"), ("entity", "entity_available"), ("asset", "asset_or_company_available"), ("dedup", "dedup_key_available"), ("content", "content_text_available"),
        ("numeric", "numeric_value_available"), ("official", "official_source_flag"), ("market", "market_data_flag"), ("disclosure", "disclosure_flag"), ("news", "news_signal_flag"))))
    return found.groupBy("capture", has.alias("has")).agg(F.count("*").alias("items"))


@_query("""SELECT '{"failed":' || CAST(count(*) FILTER (WHERE status = 'failed') AS VARCHAR) || ',"last_started_at":"' || strftime(max(started_at), '%Y-%m-%d %H:%M:%S') || '","runs":' || CAST(count(*) AS VARCHAR) || '}' AS report FROM v_runs""")
def run_report(spark, sf_dir):
    runs = view(spark, sf_dir, "runs").agg(F.count("*").alias("runs"), F.date_format(F.max("started_at"), "yyyy-MM-dd HH:mm:ss").alias("last_started_at"), F.count_if(F.col("status") == "failed").alias("failed"))
    return coverage.report(runs)
