"""The registered queries over the driver's tables, each with the DuckDB SQL that it is compared with.

A query and its SQL are written apart: the SQL restates the meaning, it is not derived from the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scoring, text, timing
from siltstone.operators import coverage, dedup, delivery, feed, fold, normalize, resolve, rollup, schedule, validate
from siltstone.operators.tables import dealt, written
from siltstone.plans.views import NOW, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
METHODS = ["marketaux", "finnhub", "eia", "sec_edgar"]


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_views(sql.strip())
        return f

    return add


def queries() -> dict[str, Query]:
    from siltstone.plans import changes, more, records
    from siltstone.streaming import jobs

    return _QUERIES | more.queries() | changes.queries() | records.queries() | jobs.queries()


def oracle_sql() -> dict[str, str]:
    from siltstone.plans import changes, more, records
    from siltstone.streaming import jobs

    return _SQL | more.oracle_sql() | changes.oracle_sql() | records.oracle_sql() | jobs.oracle_sql()


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- feeds ----------------------------------------------------------------------------------------------------------

_FEED = """
SELECT c.id, c.title, c.canonical_url, c.source_id, s.access_method, c.source_published_at, e.id AS evidence_id, e.processing_status
FROM v_content c JOIN v_sources s ON c.source_id = s.id {raw} LEFT JOIN v_evidence e ON e.raw_item_id = c.raw_item_id
WHERE c.title IS NOT NULL AND c.canonical_url IS NOT NULL AND c.source_published_at IS NOT NULL {where}
ORDER BY c.source_published_at DESC, c.id DESC, e.id DESC NULLS LAST LIMIT {limit}
"""


def _feed_tables(spark: SparkSession, sf_dir: str):
    return view(spark, sf_dir, "content"), view(spark, sf_dir, "sources"), view(spark, sf_dir, "evidence")


@_query(_FEED.format(raw="", where="AND s.access_method = 'marketaux'", limit=50))
def feed_recent(spark, sf_dir):
    return feed.recent(*_feed_tables(spark, sf_dir), limit=50, methods=["marketaux"])


@_query(_FEED.format(raw="JOIN v_raw r ON r.id = c.raw_item_id", where="AND r.run_id = 7", limit=5))
def feed_for_run(spark, sf_dir):
    content, sources, evidence = _feed_tables(spark, sf_dir)
    return feed.for_run(content, view(spark, sf_dir, "raw"), sources, evidence, 7)


@_query("""
WITH ids AS (SELECT (id % 7) * 1000000000000 - id AS pos, id FROM v_content WHERE external_id IS NOT NULL)
SELECT pos, c.id, title, source_id, access_method FROM ids JOIN v_content c USING (id) JOIN v_sources s ON s.id = c.source_id
""")
def feed_by_ids_ordered(spark, sf_dir):
    content = view(spark, sf_dir, "content")
    ids = content.where("external_id is not null").select(((F.col("id") % 7) * 1_000_000_000_000 - F.col("id")).alias("pos"), "id")
    return feed.by_ids(content, view(spark, sf_dir, "sources"), ids)


@_query("""
WITH b AS (
  SELECT conv_id, turn, concat_ws(chr(10), concat(CASE conv_id % 4 WHEN 0 THEN 'News' WHEN 1 THEN 'Market data' WHEN 2 THEN 'Official energy data' ELSE 'Company filing' END, ': ', text),
    concat('Source: ', role), concat('Time: ', CAST(turn AS VARCHAR)), CASE WHEN turn % 2 = 0 THEN concat('https://news.test/', conv_id) END) AS block FROM conversations)
SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY turn, block) AS message, count(*) AS items,
  CASE WHEN length(string_agg(block, chr(10) || chr(10))) > 4096 THEN 'message_too_long' END AS message_error FROM b GROUP BY conv_id
""")
def notify_message(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations")
    provider = F.element_at(F.array(*(F.lit(m) for m in METHODS)), (F.col("conv_id") % 4 + 1).cast("int"))
    url = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://news.test/"), F.col("conv_id").cast("string")))
    items = rows.select("conv_id", "turn", feed.block(provider, F.col("text"), F.col("role"), F.col("turn").cast("string"), url).alias("block"))
    return feed.messages(items, "conv_id", "turn")


# --- schedules ------------------------------------------------------------------------------------------------------

_NOW = f"TIMESTAMP '{NOW}'"


@_query(f"""
WITH able AS (SELECT * FROM v_sources WHERE enabled AND authorization_status IN ('authorized', 'implemented') AND schedule_seconds IS NOT NULL ORDER BY id LIMIT 1000),
latest AS (SELECT source_id, max(started_at) AS last_run FROM v_runs GROUP BY source_id),
due AS (
  SELECT a.id AS source_id, schedule_seconds FROM able a LEFT JOIN latest l ON l.source_id = a.id
  WHERE greatest(last_success_at, last_run) IS NULL OR {_NOW} >= greatest(last_success_at, last_run) + to_seconds(schedule_seconds * least(power(2, consecutive_failures), 16)::BIGINT)),
fanned AS (
  SELECT source_id, a.id AS account_id, schedule_seconds FROM due JOIN v_accounts a USING (source_id) WHERE a.enabled
  UNION ALL SELECT source_id, NULL, schedule_seconds FROM due WHERE source_id NOT IN (SELECT source_id FROM v_accounts)),
t AS (
  SELECT source_id, account_id, CAST(floor(epoch({_NOW}) / schedule_seconds) AS BIGINT) AS scheduled_slot FROM fanned f
  WHERE NOT EXISTS (SELECT 1 FROM v_runs r WHERE r.status = 'running' AND r.source_id = f.source_id AND r.source_account_id IS NOT DISTINCT FROM f.account_id)),
k AS (SELECT *, concat(source_id, ':', coalesce(account_id, 'source'), ':', scheduled_slot) AS dispatch_key FROM t),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(dispatch_key)) AS x FROM k)
SELECT source_id, account_id, scheduled_slot, dispatch_key,
  concat('collection-', substr(x, 1, 8), '-', substr(x, 9, 4), '-5', substr(x, 14, 3), '-', substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(x, 17, 1)), 1), substr(x, 18, 3), '-', substr(x, 21, 12)) AS task_id FROM h
""")
def due_targets(spark, sf_dir):
    return schedule.due_targets(view(spark, sf_dir, "sources"), view(spark, sf_dir, "accounts"), view(spark, sf_dir, "runs"), _now())


@_query(f"SELECT id, source_id, started_at FROM v_runs WHERE status = 'running' AND started_at < {_NOW} - INTERVAL 900 SECOND AND id NOT IN (SELECT id FROM v_runs WHERE id % 7 = 0)")
def stale_runs(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    return schedule.stale_runs(runs, _now(), claims=runs.where("id % 7 = 0").select("id")).select("id", "source_id", "started_at")


_DIAGNOSIS = """
WITH m AS (SELECT unnest(['marketaux', 'finnhub', 'eia', 'sec_edgar', 'other']) AS access_method),
s AS (SELECT *, enabled AND authorization_status IN ('authorized', 'implemented') AS ok FROM v_sources {only}),
n AS (
  SELECT m.access_method, (SELECT count(*) FROM s WHERE s.access_method = m.access_method) AS source_count,
    (SELECT count(*) FROM s JOIN v_accounts a ON a.source_id = s.id WHERE s.access_method = m.access_method) AS account_count,
    (SELECT count(*) FROM s JOIN v_accounts a ON a.source_id = s.id WHERE s.access_method = m.access_method AND s.ok AND a.enabled) AS eligible_target_count,
    (SELECT count(*) FROM s WHERE s.access_method = m.access_method AND enabled) AS on_, (SELECT count(*) FROM s WHERE s.access_method = m.access_method AND ok) AS able FROM m),
d AS (SELECT access_method, source_count, account_count, eligible_target_count, CASE WHEN eligible_target_count > 1 THEN 'target_not_unique' WHEN eligible_target_count = 1 THEN NULL WHEN source_count = 0 THEN 'source_missing'
  WHEN on_ = 0 THEN 'source_disabled' WHEN able = 0 THEN 'source_unauthorized' ELSE 'account_missing' END AS target_error FROM n)
"""


def _diagnosed(spark, sf_dir):
    methods = spark.createDataFrame([(m,) for m in [*METHODS, "other"]], "access_method string")
    return schedule.diagnose(methods, view(spark, sf_dir, "sources"), view(spark, sf_dir, "accounts"))


@_query(_DIAGNOSIS.format(only="") + "SELECT * FROM d")
def target_diagnosis(spark, sf_dir):
    return _diagnosed(spark, sf_dir)


@_query(_DIAGNOSIS.format(only="") + """SELECT *, CASE WHEN eligible_target_count = 1 THEN 'already_exists' WHEN target_error = 'source_missing' THEN 'create_source_and_account'
  WHEN target_error = 'account_missing' THEN 'create_account' ELSE 'blocked' END AS action FROM d""")
def target_bootstrap(spark, sf_dir):
    return schedule.bootstrap(_diagnosed(spark, sf_dir))


@_query("""
WITH t AS (
  SELECT s.id AS source_id, a.id AS account_id, s.access_method FROM v_sources s JOIN v_accounts a ON a.source_id = s.id
  UNION ALL SELECT id, NULL, access_method FROM v_sources UNION ALL SELECT 'gone', NULL, 'marketaux'
  UNION ALL SELECT s.id, 's1', 'quotes' FROM v_sources s)
SELECT t.source_id, t.account_id, t.access_method, CASE WHEN t.access_method NOT IN ('marketaux', 'finnhub', 'eia', 'sec_edgar') THEN 'method_not_registered'
  WHEN s.id IS NULL OR NOT s.enabled OR s.access_method <> t.access_method OR s.authorization_status NOT IN ('authorized', 'implemented') THEN 'source_not_authorized'
  WHEN t.account_id IS NOT NULL AND (a.id IS NULL OR a.source_id <> t.source_id OR NOT a.enabled) THEN 'account_missing_mismatched_or_disabled'
  WHEN t.account_id IS NULL AND t.source_id IN (SELECT source_id FROM v_accounts) THEN 'source_level_forbidden' END AS target_error
FROM t LEFT JOIN v_sources s ON s.id = t.source_id LEFT JOIN v_accounts a ON a.id = t.account_id
""")
def eligibility_errors(spark, sf_dir):
    sources, accounts = view(spark, sf_dir, "sources"), view(spark, sf_dir, "accounts")
    pairs = sources.select(F.col("id").alias("source_id"), "access_method").join(accounts.select("source_id", F.col("id").alias("account_id")), "source_id")
    none = F.lit(None).cast("string")
    targets = pairs.select("source_id", "account_id", "access_method")
    targets = targets.union(sources.select("id", none, "access_method")).union(spark.createDataFrame([("gone", None, "marketaux")], "source_id string, account_id string, access_method string"))
    targets = targets.union(sources.select("id", F.lit("s1"), F.lit("quotes")))
    return schedule.target_errors(targets, sources, accounts, METHODS)


@_query("""
SELECT id, http_status, CASE WHEN http_status = 429 THEN 'COLLECTION_RATE_LIMITED' WHEN http_status >= 500 THEN 'COLLECTION_UPSTREAM_5XX' WHEN http_status NOT BETWEEN 200 AND 299 THEN 'COLLECTION_UPSTREAM_PERMANENT' END AS error_code,
  CASE WHEN http_status BETWEEN 200 AND 299 THEN 'succeeded' WHEN fetched_count > 0 THEN 'partial' ELSE 'failed' END AS outcome,
  CASE WHEN (http_status = 429 OR http_status >= 500) AND id % 5 < 3 THEN 'retry' ELSE 'failed' END AS after_error FROM v_runs
""")
def run_outcomes(spark, sf_dir):
    runs = view(spark, sf_dir, "runs").withColumn("error_code", validate.http_error(F.col("http_status")))
    return runs.select("id", "http_status", "error_code", schedule.run_outcome(F.col("fetched_count"), F.col("error_code").isNotNull()).alias("outcome"), schedule.retry_outcome(F.col("error_code"), F.col("id") % 5).alias("after_error"))


@_query("SELECT source_id, CAST(sum(fetched_count) AS BIGINT) AS fetched, count(*) FILTER (WHERE http_status <> 200) AS errors, max(started_at) AS latest_run_at FROM v_runs GROUP BY source_id")
def run_counters(spark, sf_dir):
    return view(spark, sf_dir, "runs").groupBy("source_id").agg(F.sum("fetched_count").alias("fetched"), F.count_if(F.col("http_status") != 200).alias("errors"), F.max("started_at").alias("latest_run_at"))


_STATUS = "CASE status WHEN 'failed' THEN 'FAILED' WHEN 'running' THEN 'RETRY' ELSE 'PASS' END"


@_query(f"""SELECT id // 4 AS cycle, CASE WHEN bool_or({_STATUS} IN ('FAILED', 'BLOCKED', 'RETRY') OR (id % 97 = 0)) THEN 'PARTIAL' ELSE 'PASS' END AS cycle_status, count(*) AS providers
FROM v_runs GROUP BY 1""")
def cycle_status(spark, sf_dir):
    rows = view(spark, sf_dir, "runs").select(F.expr("id div 4").alias("cycle"), F.expr(_STATUS).alias("status"), F.when(F.col("id") % 97 == 0, "FAILED").otherwise("PASS").alias("delivery"))
    return schedule.cycle_status(rows)


@_query("""SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN least(greatest(value, 0), 900) ELSE least(300, 5 * power(2, event_id % 9)) END, 6) AS ceiling,
  CAST(greatest(1, least(ceil(value), 300)) AS BIGINT) AS cadence FROM events""")
def retry_ceiling(spark, sf_dir):
    asked = F.when(F.col("event_id") % 4 == 0, F.col("value"))
    return _read(spark, sf_dir, "events").select("event_id", F.round(timing.retry_ceiling(asked, F.col("event_id") % 9), 6).alias("ceiling"), timing.cadence_delay(F.col("value"), 300).alias("cadence"))


# --- cursors --------------------------------------------------------------------------------------------------------


@_query("""SELECT user_id, arg_max(CAST(event_id AS VARCHAR), (strftime(ts, '%Y-%m-%dT%H:%M:%S'), CAST(event_id AS VARCHAR))) AS item, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS published_at FROM events GROUP BY user_id""")
def cursor_latest(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("p"), F.col("event_id").cast("string").alias("i"))
    return rows.groupBy("user_id").agg(F.max(F.struct("p", "i")).alias("m")).select("user_id", F.col("m.i").alias("item"), F.col("m.p").alias("published_at"))


@_query("""
WITH p AS (SELECT user_id, event_id, lpad(CAST((event_id * 7919) % 1000 AS VARCHAR), 4, '0') AS c FROM events),
s AS (SELECT *, max(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p)
SELECT event_id, CASE WHEN seen IS NULL OR c > seen THEN 'advance' WHEN c = seen AND user_id % 4 IN (2, 3) THEN 'unchanged' ELSE 'invalid' END AS relation FROM s
""")
def cursor_relation(spark, sf_dir):
    from pyspark.sql import Window

    place = F.lpad(((F.col("event_id") * 7919) % 1000).cast("string"), 4, "0")
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", text.cursor(F.lit("x"), place).alias("c"), place.alias("place"))
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("place").over(before)
    current = F.when(seen.isNotNull(), text.cursor(F.lit("x"), seen))
    return rows.select("event_id", text.cursor_relation(current, F.col("c"), F.col("user_id") % 4 >= 2).alias("relation"))


# --- text -----------------------------------------------------------------------------------------------------------

_URL = r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)\??([^#]*)', ['scheme', 'host', 'path', 'query']) AS p FROM pages),
q AS (SELECT page_id, url, p, list_sort(list_filter(string_split(p.query, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))) AS kept FROM u),
c AS (SELECT page_id, CASE WHEN p.scheme <> '' THEN concat(lower(p.scheme), '://', lower(p.host), CASE WHEN rtrim(p.path, '/') = '' THEN '/' ELSE rtrim(p.path, '/') END, CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END) END AS canonical_url FROM q)
"""


@_query(_URL + "SELECT page_id, canonical_url FROM c")
def url_canonical(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical_url"))


@_query(_URL + "SELECT canonical_url, count(*) AS pages, min(page_id) AS first_page FROM c GROUP BY canonical_url")
def url_canonical_groups(spark, sf_dir):
    return url_canonical(spark, sf_dir).groupBy("canonical_url").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@_query("""
SELECT doc_id, CASE WHEN len(t) > 0 THEN sha256(array_to_string(t, ' ')) END AS title_fingerprint, sha256(coalesce(text, '')) AS content_hash
FROM (SELECT doc_id, text, regexp_extract_all(replace(lower(split_part(coalesce(text, ''), chr(10), 1)), 'ß', 'ss'), '[a-z0-9]+') AS t FROM documents)
""")
def title_fingerprints(spark, sf_dir):
    title = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return _read(spark, sf_dir, "documents").select("doc_id", text.title_fingerprint(title).alias("title_fingerprint"), text.stable_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


@_query(r"""SELECT doc_id, left(regexp_replace(text, '(?i)(authorization|cookie|token|secret|password|cursor)\s*[:=]\s*\S+|https?://\S+', '[REDACTED]', 'g'), 500) AS detail FROM documents""")
def redact_detail(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("detail"))


@_query(r"""SELECT doc_id, regexp_matches(text, '(?i)["'']?(password|secret|token|api_?key|authorization)["'']?\s*[:=]\s*["'']?[A-Za-z0-9]') AS has_secret,
  CASE WHEN regexp_matches(text, '(?i)["'']?(password|secret|token|api_?key|authorization)["'']?\s*[:=]\s*["'']?[A-Za-z0-9]') THEN 'secret_detected' WHEN doc_id % 6 > 3 THEN 'provider_unknown' WHEN n_chars % 9 = 0 THEN 'capture_empty' ELSE 'normalized' END AS state FROM documents""")
def secret_scan(spark, sf_dir):
    provider = F.coalesce(F.get(F.array(*(F.lit(m) for m in METHODS)), (F.col("doc_id") % 6).cast("int")), F.lit("other"))
    rows = _read(spark, sf_dir, "documents")
    return rows.select("doc_id", coverage.secret_in(F.col("text")).alias("has_secret"), coverage.capture_state(F.col("text"), provider, F.col("n_chars") % 9, METHODS).alias("state"))


@_query("""SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS top_level_keys FROM events""")
def json_shape(spark, sf_dir):
    return normalize.response_shape(_read(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "top_level_keys")


_ARRAYS = """
WITH a AS (SELECT p_partkey // 40 AS lot, list(p_partkey ORDER BY p_partkey) AS k, list(p_name ORDER BY p_partkey) FILTER (WHERE p_size % 3 <> 0) AS n FROM part GROUP BY 1),
z AS (SELECT lot, i, k[i] AS k, n[i] AS n, len(k) AS lk, coalesce(len(n), 0) AS ln FROM a, generate_series(1, greatest(len(k), coalesce(len(n), 0))) AS s(i))
SELECT lot, 'cut' AS kind, k, n FROM z WHERE i <= least(lk, ln) UNION ALL SELECT lot, 'padded', k, n FROM z
"""


@_query(_ARRAYS)
def columnar_zip(spark, sf_dir):
    kept = F.when(F.col("p_size") % 3 != 0, F.struct("p_partkey", "p_name"))
    names = F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["p_name"])
    arrays = _read(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 40").alias("lot")).agg(F.array_sort(F.collect_list("p_partkey")).alias("k"), names.alias("n"))
    cut, padded = (normalize.zipped(arrays, ("k", "n"), padded=p).select("lot", F.lit("padded" if p else "cut").alias("kind"), "k", "n") for p in (False, True))
    return cut.union(padded)


# --- deduplication and writes ---------------------------------------------------------------------------------------


@_query("""
WITH k AS (SELECT *, coalesce('id|' || source_id || '|' || external_id, 'url|' || canonical_url, 'hash|' || source_id || '|' || content_hash) AS identity_key FROM v_content)
SELECT min(id) AS id, identity_key FROM k GROUP BY identity_key
""")
def content_dedup_precedence(spark, sf_dir):
    return dedup.by_precedence(view(spark, sf_dir, "content")).select("id", "identity_key")


@_query("""
WITH stored AS (SELECT * FROM v_content WHERE source_published_at < TIMESTAMP '2024-01-02 00:00:00'),
fresh AS (SELECT * FROM v_content c WHERE raw_item_id NOT IN (SELECT raw_item_id FROM stored)
  AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.source_id = c.source_id AND s.external_id = c.external_id)),
one AS (SELECT *, row_number() OVER (PARTITION BY raw_item_id ORDER BY id) AS a, CASE WHEN external_id IS NOT NULL THEN row_number() OVER (PARTITION BY source_id, external_id ORDER BY id) ELSE 1 END AS b FROM fresh)
SELECT id, source_id, external_id FROM one WHERE a = 1 AND b = 1
""")
def content_new_only(spark, sf_dir):
    content = view(spark, sf_dir, "content")
    return dedup.new_only(content, content.where("source_published_at < timestamp_ntz'2024-01-02 00:00:00'")).select("id", "source_id", "external_id")


#: Evidence that repeats by hash and item, and agrees with what is stored in some of the fields that count.
_REPEATED = """SELECT id, provider, concat('q', id % 300) AS provider_item_id, provider_item_hash, id % 50 AS raw_item_id, observed_at, event_time IS NULL AS timeless, official_source, processing_status, title IS NOT NULL AS titled,
  entity, source_id, source_account_id, content_item_id, id AS own_raw FROM v_evidence"""
_CLASSIFY = f"""
WITH x AS ({_REPEATED}),
stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, provider_item_hash ORDER BY id) AS a, row_number() OVER (PARTITION BY provider, provider_item_id ORDER BY id) AS b FROM x WHERE observed_at < TIMESTAMP '2024-01-11 00:00:00') WHERE a = 1 AND b = 1),
met AS (
  SELECT x.*, h.id IS NOT NULL AS has_h, i.id IS NOT NULL AS has_i, i.provider_item_hash AS i_hash,
    (x.provider_item_id = h.provider_item_id AND x.raw_item_id = h.raw_item_id AND x.timeless = h.timeless AND x.official_source = h.official_source AND x.processing_status = h.processing_status AND x.titled = h.titled AND x.entity = h.entity) AS same_h,
    (x.raw_item_id = i.raw_item_id AND x.timeless = i.timeless AND x.official_source = i.official_source AND x.processing_status = i.processing_status AND x.titled = i.titled AND x.entity = i.entity) AS same_i
  FROM x LEFT JOIN stored h ON h.provider = x.provider AND h.provider_item_hash = x.provider_item_hash LEFT JOIN stored i ON i.provider = x.provider AND i.provider_item_id = x.provider_item_id),
d AS (SELECT * EXCLUDE (raw_item_id), own_raw AS raw_item_id, CASE WHEN has_h THEN CASE WHEN same_h THEN 'existing' ELSE 'provider_hash_conflict' END WHEN has_i THEN CASE WHEN i_hash <> provider_item_hash THEN 'provider_item_id_conflict' WHEN same_i THEN 'existing' ELSE 'provider_hash_conflict' END ELSE 'inserted' END AS decision FROM met)
"""


def _repeated(evidence: DataFrame) -> DataFrame:
    """Evidence with all fields in which it must agree with what is stored; those that tell every row apart stand aside."""
    kind = F.element_at(F.array(*(F.lit(t[0]) for t in validate.ITEM_TYPES)), F.array_position(F.array(*(F.lit(m) for m in METHODS)), F.col("provider")).cast("int"))
    by = lambda place: validate.by_item_type(F.col("provider_item_type"), place)
    none, no_refs = F.lit(None).cast("string"), F.array().cast("array<string>")
    timeless = F.col("event_time").isNull()
    missing = F.struct(F.lit("event_time_missing").alias("code"), F.lit("event_time").alias("field"), F.lit("Time is unavailable.").alias("safe_message"))
    return evidence.withColumns({"own_raw": F.col("raw_item_id"), "own_source": F.col("source_id"), "own_account": F.col("source_account_id"), "own_content": F.col("content_item_id"), "own_time": F.col("event_time"), "provider_item_type": kind}).withColumns({
        "evidence_version": F.lit(1), "evidence_kind": by(2), "source_type": by(3), "source_id": none, "source_account_id": none, "raw_item_id": F.col("id") % 50, "content_item_id": none,
        "provider_item_id": F.concat(F.lit("q"), (F.col("id") % 300).cast("string")), "event_time": F.lit(None).cast("timestamp"), "access_level": F.when(timeless, "unknown").otherwise("link_only"), "official_source_flag": F.col("official_source"),
        "market_data_flag": by(5), "disclosure_flag": by(6), "news_signal_flag": by(7), "content_presence": F.struct(F.col("title").isNotNull().alias("has_title")), "numeric_presence": F.struct(F.lit(0).alias("numeric_field_count")),
        "entity_refs": F.array("entity"), "asset_refs": no_refs, "topic_refs": no_refs, "raw_payload_reference": F.concat(F.lit("internal://evidence/"), F.col("provider_item_hash")),
        "errors": F.when(timeless, F.array(missing)).otherwise(F.array().cast("array<struct<code:string,field:string,safe_message:string>>"))})


def _stored(rows: DataFrame) -> DataFrame:
    """What was observed before a day, unique by hash and by item."""
    from pyspark.sql import Window

    by = lambda key: F.row_number().over(Window.partitionBy("provider", key).orderBy("id"))
    return rows.where("observed_at < timestamp_ntz'2024-01-11 00:00:00'").withColumns({"_a": by("provider_item_hash"), "_b": by("provider_item_id")}).where("_a = 1 and _b = 1").drop("_a", "_b")


@_query(_CLASSIFY + "SELECT id, decision FROM d")
def evidence_classify(spark, sf_dir):
    rows = _repeated(view(spark, sf_dir, "evidence"))
    return dedup.classify(rows, _stored(rows)).select("id", "decision")


_PROVENANCE = """
p AS (SELECT d.*, CASE WHEN r.id IS NULL THEN 'raw_item_id:reference_not_found' WHEN r.source_id <> d.source_id OR r.source_account_id IS DISTINCT FROM d.source_account_id THEN 'raw_item_id:provenance_mismatch'
  WHEN d.source_account_id IS NOT NULL AND a.id IS NULL THEN 'source_account_id:reference_not_found' WHEN d.source_account_id IS NOT NULL AND a.source_id <> d.source_id THEN 'source_account_id:provenance_mismatch'
  WHEN d.content_item_id IS NOT NULL AND c.id IS NULL THEN 'content_item_id:reference_not_found' WHEN d.content_item_id IS NOT NULL AND (c.source_id <> d.source_id OR c.raw_item_id <> d.raw_item_id) THEN 'content_item_id:provenance_mismatch' END AS provenance_error
  FROM {rows} d LEFT JOIN v_raw r ON r.id = CASE WHEN d.raw_item_id % 25 = 3 THEN -d.raw_item_id ELSE d.raw_item_id END LEFT JOIN v_accounts a ON a.id = d.source_account_id LEFT JOIN v_content c ON c.id = CASE WHEN d.content_item_id % 13 = 0 THEN -1 - d.content_item_id ELSE d.content_item_id END)
"""


def _provenance(spark, sf_dir, rows):
    """Some references point nowhere: to a raw or content row that no table has."""
    gone = lambda c, n, k: F.when(F.col(c) % n == k, -1 - F.col(c)).otherwise(F.col(c))
    rows = rows.withColumns({"raw_item_id": gone("raw_item_id", 25, 3), "content_item_id": gone("content_item_id", 13, 0)})
    return dedup.provenance_error(rows, view(spark, sf_dir, "raw"), view(spark, sf_dir, "accounts"), view(spark, sf_dir, "content"))


@_query("WITH " + _PROVENANCE.format(rows="v_evidence") + "SELECT id, provenance_error FROM p")
def provenance_errors(spark, sf_dir):
    return _provenance(spark, sf_dir, view(spark, sf_dir, "evidence")).select("id", "provenance_error")


_ENVELOPE = """
SELECT *, concat_ws(',', CASE WHEN id % 23 = 0 THEN 'unsupported_evidence_version' END,
  CASE WHEN id % 19 = 0 THEN 'unknown_access_level' END, CASE WHEN provider <> expected THEN 'provider_item_type_mismatch' END,
  CASE WHEN flags_differ THEN 'evidence_flags_mismatch' END, CASE WHEN item_type = 'eia_energy_timeseries' AND id % 2 = 1 THEN 'eia_numeric_nullable_required' END,
  CASE WHEN id % 29 = 0 AND id % 19 <> 0 THEN 'access_level_unknown' END, CASE WHEN id % 31 = 0 THEN 'provider_item_hash_invalid' END, CASE WHEN event_time IS NULL THEN 'event_time_missing' END,
  CASE WHEN id % 37 = 0 THEN 'numeric_field_count_invalid' END, CASE WHEN id % 41 = 0 OR id % 43 = 0 THEN 'unsafe_raw_payload_reference' END, CASE WHEN id % 47 = 0 OR id % 53 = 0 OR id % 59 = 0 THEN 'unsafe_embedded_error' END) AS codes
FROM (SELECT *, CASE id % 5 WHEN 0 THEN 'marketaux_news' WHEN 1 THEN 'finnhub_quote' WHEN 2 THEN 'eia_energy_timeseries' WHEN 3 THEN 'sec_filing' ELSE CASE provider WHEN 'marketaux' THEN 'marketaux_news' WHEN 'finnhub' THEN 'finnhub_quote' WHEN 'eia' THEN 'eia_energy_timeseries' ELSE 'sec_filing' END END AS item_type,
  CASE id % 5 WHEN 0 THEN 'marketaux' WHEN 1 THEN 'finnhub' WHEN 2 THEN 'eia' WHEN 3 THEN 'sec_edgar' ELSE provider END AS expected,
  official_source <> (CASE id % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true ELSE provider IN ('eia', 'sec_edgar') END) AS flags_differ FROM v_evidence)
"""


def _envelopes(evidence: DataFrame) -> DataFrame:
    """Evidence as envelopes, with a fault of every kind in some rows."""
    kinds = [t[0] for t in validate.ITEM_TYPES]
    own = F.element_at(F.array(*(F.lit(k) for k in kinds)), F.array_position(F.array(*(F.lit(m) for m in METHODS)), F.col("provider")).cast("int"))
    kind = F.coalesce(F.get(F.array(*(F.lit(k) for k in kinds)), (F.col("id") % 5).cast("int")), own)
    fault = lambda n, bad, good: F.when(F.col("id") % n == 0, bad).otherwise(good)
    df = evidence.withColumn("provider_item_type", kind)
    by = lambda place: validate.by_item_type(F.col("provider_item_type"), place)
    safe = F.concat(F.lit("internal://evidence/"), F.col("provider_item_hash"))
    return df.withColumns({
        "evidence_version": fault(23, F.lit(2), F.lit(1)), "evidence_kind": by(2), "source_type": by(3), "access_level": fault(19, F.lit("odd"), fault(29, F.lit("unknown"), F.lit("link_only"))),
        "official_source_flag": F.col("official_source"), "market_data_flag": by(5), "disclosure_flag": by(6), "news_signal_flag": by(7),
        "numeric_presence": F.struct((F.col("id") % 2 == 0).alias("nullable_allowed"), fault(37, F.lit(-1), F.lit(1)).alias("numeric_field_count")), "provider_item_hash": fault(31, F.lit("no hash"), F.col("provider_item_hash")),
        "raw_payload_reference": fault(41, F.lit("https://x.test/a"), fault(43, F.concat(safe, F.lit("?token=1")), safe)),
        "errors": F.array(F.struct(fault(47, F.lit("Bad Code"), F.lit("some_code")).alias("code"), fault(59, F.lit("field name"), F.lit(None).cast("string")).alias("field"), fault(53, F.lit("Title: a secret"), F.lit(validate.SAFE_ERROR_MESSAGES[1])).alias("safe_message")))})


@_query("WITH v AS (" + _ENVELOPE + ") SELECT id, codes FROM v")
def evidence_validate(spark, sf_dir):
    return _envelopes(view(spark, sf_dir, "evidence")).select("id", F.array_join(validate.envelope_errors(), ",").alias("codes"))


@_query(_CLASSIFY + ", " + _PROVENANCE.format(rows="d") + ", v AS (" + _ENVELOPE + """), o AS (
  SELECT CASE WHEN v.codes <> '' OR provenance_error IS NOT NULL THEN 'invalid' WHEN decision LIKE '%conflict' THEN 'conflict' WHEN decision = 'existing' THEN 'existing' WHEN p.id % 41 = 0 THEN 'blocked' ELSE 'inserted' END AS outcome FROM p JOIN v USING (id))
SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'inserted') AS inserted, count(*) FILTER (WHERE outcome = 'existing') AS existing, count(*) FILTER (WHERE outcome = 'blocked') AS blocked,
  count(*) FILTER (WHERE outcome = 'invalid') AS invalid, count(*) FILTER (WHERE outcome = 'conflict') AS conflict, true AS conserved FROM o""")
def write_summary(spark, sf_dir):
    evidence = view(spark, sf_dir, "evidence")
    codes = _envelopes(evidence).select(F.col("id").alias("_id"), validate.envelope_errors().alias("codes"))
    rows = _repeated(evidence)
    rows = dedup.classify(rows, _stored(rows)).select("id", "decision", F.col("own_raw").alias("raw_item_id"), F.col("own_source").alias("source_id"), F.col("own_account").alias("source_account_id"), F.col("own_content").alias("content_item_id"))
    rows = _provenance(spark, sf_dir, rows)
    rows = rows.join(codes, rows.id == F.col("_id"))
    return dedup.write_summary(rows.withColumn("outcome", dedup.write_decision(F.col("id") % 41 == 0, F.col("codes"), F.col("provenance_error"), F.col("decision"))))


@_query("""SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS missing, count(*) FILTER (WHERE o_custkey % 10 <> l_suppkey % 10) AS differs, count(*) AS links
FROM lineitem LEFT JOIN orders ON CASE WHEN l_orderkey % 37 = 0 THEN -l_orderkey ELSE l_orderkey END = o_orderkey""")
def provenance_audit(spark, sf_dir):
    key = F.col("l_orderkey")
    links, orders = _read(spark, sf_dir, "lineitem").select(F.when(key % 37 == 0, -key).otherwise(key).alias("l_orderkey"), "l_suppkey"), _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    met = links.join(orders, links.l_orderkey == orders.o_orderkey, "left")
    return met.agg(F.count_if(F.col("o_orderkey").isNull()).alias("missing"), F.count_if(F.col("o_custkey") % 10 != F.col("l_suppkey") % 10).alias("differs"), F.count("*").alias("links"))


# --- events ---------------------------------------------------------------------------------------------------------

_SIGNED = """
WITH e AS (
  SELECT id AS evidence_id, *, CASE WHEN len(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '[a-z0-9]+')) > 0 THEN sha256(array_to_string(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '[a-z0-9]+'), ' ')) END AS fp,
    concat('https://news.test/', id % 260) AS url, coalesce(event_time, observed_at) AS seen FROM v_evidence),
s AS (SELECT *, list_filter([CASE WHEN official_source AND provider_item_id IS NOT NULL THEN 'official:' || sha256(provider || ':' || provider_item_id) END, 'url:' || sha256(url),
    CASE WHEN provider_item_id IS NOT NULL THEN 'provider:' || sha256(provider || ':' || provider_item_id) END, 'hash:' || sha256(provider || ':' || provider_item_hash)], lambda x: x IS NOT NULL) AS sigs FROM e)
"""


def _signed(spark, sf_dir) -> DataFrame:
    rows = view(spark, sf_dir, "evidence").withColumnRenamed("id", "evidence_id").withColumn("entity_refs", F.array("entity"))
    return resolve.with_signatures(rows)


@_query(_SIGNED + """, a AS (SELECT evidence_id, array_to_string(sigs, ',') AS signatures, fp AS title_fingerprint, split_part(sigs[1], ':', 1) AS anchor_type, split_part(sigs[1], ':', 2) AS anchor_value_hash FROM s)
SELECT *, sha256(anchor_type || ':' || anchor_value_hash) AS cluster_key FROM a""")
def evidence_signatures(spark, sf_dir):
    return resolve.with_anchor(_signed(spark, sf_dir)).select("evidence_id", F.array_join("signatures", ",").alias("signatures"), "title_fingerprint", "anchor_type", "anchor_value_hash", "cluster_key")


#: Evidence without address, item or official source: the weakest anchors.
_WEAK = _SIGNED + """, w AS (SELECT *, 'hash:' || sha256(provider || ':' || provider_item_hash) AS h FROM s),
x AS (SELECT evidence_id, CASE WHEN fp IS NOT NULL THEN 'entity_title_time' ELSE 'hash' END AS anchor_type,
  CASE WHEN fp IS NOT NULL THEN sha256('[''' || entity || ''']:' || fp || ':' || CAST(CAST(floor(epoch(seen) / 86400) AS BIGINT) AS VARCHAR)) ELSE split_part(h, ':', 2) END AS anchor_value_hash FROM w)
SELECT *, sha256(anchor_type || ':' || anchor_value_hash) AS cluster_key FROM x"""


@_query(_WEAK)
def evidence_anchor_bucket(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = view(spark, sf_dir, "evidence").withColumnRenamed("id", "evidence_id").withColumns({"entity_refs": F.array("entity"), "canonical_url": none, "provider_item_id": none})
    return resolve.with_anchor(resolve.with_signatures(rows)).select("evidence_id", "anchor_type", "anchor_value_hash", "cluster_key")


_CANDIDATES = """, c AS (SELECT evidence_id // 10 AS id, list_distinct(flatten(list(sigs))) AS sigs, list_distinct(list(fp)) AS fps, list_distinct(list(entity)) AS entities, min(seen) AS first_at, max(seen) AS last_at FROM s WHERE observed_at < TIMESTAMP '2024-01-11 00:00:00' GROUP BY 1),
i AS (SELECT * FROM s)"""


def _candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All evidence as incoming, and candidates that stand for what was observed before a day."""
    rest = signed.where("observed_at < timestamp_ntz'2024-01-11 00:00:00'").withColumns({"id": F.expr("evidence_id div 10"), "at": resolve.seen_at(), "fps": F.array_compact(F.array("title_fingerprint"))})
    rolled = rollup.accumulated(rest, "id", ["signatures", "fps", "entity_refs"], "at")
    return signed, rolled.select("id", F.col("signatures").alias("identity_signatures"), F.col("fps").alias("title_fingerprints"), F.col("entity_refs").alias("entities"), "first_seen_at", "latest_seen_at")


_RANKED = """, r AS (
  SELECT evidence_id, c.id AS candidate_id, min(CASE split_part(g, ':', 1) WHEN 'official' THEN 1 WHEN 'url' THEN 2 WHEN 'provider' THEN 3 ELSE 5 END) AS rank
  FROM (SELECT evidence_id, unnest(sigs) AS g FROM i) x JOIN (SELECT id, unnest(sigs) AS g FROM c) c USING (g) GROUP BY ALL
  UNION ALL SELECT evidence_id, c.id, 4 FROM i, c WHERE list_contains(fps, fp) AND list_contains(entities, entity) AND seen >= first_at - INTERVAL 24 HOUR AND seen <= last_at + INTERVAL 24 HOUR),
b AS (SELECT evidence_id, candidate_id, min(rank) AS rank FROM r GROUP BY ALL),
m AS (SELECT evidence_id, min(rank) AS rank FROM b GROUP BY 1),
n AS (SELECT evidence_id, m.rank, count(*) AS n, min(candidate_id) AS candidate_id FROM b JOIN m USING (evidence_id) WHERE b.rank = m.rank GROUP BY ALL)"""


@_query(_SIGNED + _CANDIDATES + _RANKED + """
SELECT i.evidence_id, CASE WHEN n = 1 THEN candidate_id END AS matched_candidate_id, CASE WHEN n IS NULL THEN 'new_candidate' WHEN n > 1 THEN 'ambiguous_new_candidate'
  ELSE ['official_identity', 'canonical_url', 'provider_external_id', 'entity_title_time', 'approved_hash'][rank] END AS match_rule FROM i LEFT JOIN n USING (evidence_id)""")
def event_match_ranked(spark, sf_dir):
    return resolve.match(*_candidates(_signed(spark, sf_dir))).select("evidence_id", "matched_candidate_id", "match_rule")


_WINDOWED = """, t AS (SELECT evidence_id, c.id AS candidate_id FROM i, c WHERE list_contains(fps, fp) AND list_contains(entities, entity) AND seen >= first_at - INTERVAL 24 HOUR AND seen <= last_at + INTERVAL 24 HOUR)
"""


@_query(_SIGNED + _CANDIDATES + _WINDOWED + "SELECT evidence_id, candidate_id, 4 AS rank FROM t")
def event_match_time_window(spark, sf_dir):
    return resolve.time_window_pairs(*_candidates(_signed(spark, sf_dir)))


@_query(_SIGNED + _CANDIDATES + _WINDOWED + "SELECT evidence_id, count(*) AS matches FROM t GROUP BY evidence_id")
def event_match_time_window_counts(spark, sf_dir):
    return resolve.time_window_counts(*_candidates(_signed(spark, sf_dir)))


@_query(_SIGNED + _CANDIDATES + _RANKED + """, u AS (
  SELECT i.*, coalesce(n.n > 1, false) AS amb, CASE WHEN coalesce(n.n > 1, false) THEN 'ambiguous_evidence' ELSE split_part(sigs[1], ':', 1) END AS anchor_type,
    CASE WHEN coalesce(n.n > 1, false) THEN sha256(CAST(i.evidence_id AS VARCHAR)) ELSE split_part(sigs[1], ':', 2) END AS value FROM i LEFT JOIN n USING (evidence_id) WHERE n.n IS NULL OR n.n > 1),
k AS (SELECT *, sha256(anchor_type || ':' || value) AS cluster_key FROM u),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY seen, evidence_id) AS place FROM k) WHERE place = 1)
SELECT cluster_key, anchor_type, array_to_string(sigs, ',') AS identity_signatures, coalesce(fp, '') AS title_fingerprints, 'information_event' AS event_type, 'candidate' AS status, CAST(NULL AS VARCHAR) AS canonical_title,
  seen AS first_seen_at, seen AS latest_seen_at, event_time AS occurred_at, entity AS primary_entity, entity AS companies, '' AS assets, 1 AS evidence_count, 1 AS source_count, round(CASE WHEN official_source THEN 0.65 ELSE 0.45 END, 4) AS confidence,
  CAST(15 + CASE WHEN official_source THEN 30 ELSE 0 END AS DOUBLE) AS importance_score FROM f""")
def event_new_candidates(spark, sf_dir):
    rows = resolve.match(*_candidates(_signed(spark, sf_dir)))
    text_of = lambda c: F.array_join(c, ",").alias(c)
    return resolve.new_candidates(rows).select(
        "cluster_key", "anchor_type", text_of("identity_signatures"), text_of("title_fingerprints"), "event_type", "status", "canonical_title", "first_seen_at", "latest_seen_at", "occurred_at", "primary_entity", text_of("companies"),
        text_of("assets"), "evidence_count", "source_count", F.round("confidence", 4).alias("confidence"), F.col("importance_score").cast("double").alias("importance_score"))


_ROLLED = """SELECT candidate_id, count(DISTINCT CASE WHEN active THEN evidence_id END) AS evidence_count, count(DISTINCT CASE WHEN active THEN source_id END) AS source_count,
  coalesce(bool_or(CASE WHEN active THEN official END), false) AS official, count(DISTINCT CASE WHEN active THEN entity END) AS entity_count FROM {0} GROUP BY candidate_id"""


@_query("WITH r AS (" + _ROLLED.format("v_links") + """), u AS (SELECT candidate_id, array_to_string(list_sort(list_distinct(list(entity))), ',') AS entities, min(seen_at) AS first_seen_at, max(seen_at) AS latest_seen_at FROM v_links GROUP BY 1)
SELECT r.*, CASE WHEN evidence_count = 0 THEN 'rejected' ELSE 'candidate' END AS status, entities, first_seen_at, latest_seen_at FROM r JOIN u USING (candidate_id)""")
def event_rollup(spark, sf_dir):
    links = written(view(spark, sf_dir, "links"), "links")
    sets = rollup.accumulated(links.withColumn("entities", F.array("entity")), "candidate_id", ["entities"], "seen_at").withColumn("entities", F.array_join("entities", ","))
    return rollup.candidate_status(rollup.active_counts(links)).join(sets, "candidate_id")


_SCORE = """CASE WHEN evidence_count = 0 THEN 0 ELSE 10 + CASE WHEN official THEN 30 ELSE 0 END + least(20, greatest(0, source_count - 1) * 10) + CASE WHEN source_count > 1 THEN 15 ELSE 0 END + least(15, entity_count * 5) END"""


@_query("WITH r AS (" + _ROLLED.format("v_links") + f""") SELECT *, CAST({_SCORE} AS DOUBLE) AS importance_score,
  CASE WHEN evidence_count = 0 THEN 'no_active_evidence:0' ELSE concat_ws(';', 'base:10', CASE WHEN official THEN 'official_source:30' END, concat('source_diversity:', least(20, greatest(0, source_count - 1) * 10)), concat('corroboration:', CASE WHEN source_count > 1 THEN 15 ELSE 0 END),
    concat('entity_relevance:', least(15, entity_count * 5)), 'source_priority:0') END AS importance_reasons,
  CASE WHEN evidence_count = 0 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, 0.45::DOUBLE + CASE WHEN official THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + least(0.3::DOUBLE, greatest(0, source_count - 1) * 0.15::DOUBLE)), 4) END AS confidence FROM r""")
def event_score(spark, sf_dir):
    return rollup.scored(rollup.active_counts(view(spark, sf_dir, "links")))


@_query("WITH o AS (SELECT * REPLACE (active AND candidate_id % 3 <> 0 AS active) FROM v_links), r AS (" + _ROLLED.format("o") + ") SELECT *, CASE WHEN evidence_count = 0 THEN 'rejected' ELSE 'candidate' END AS status FROM r")
def event_deactivate_recalc(spark, sf_dir):
    links = dealt(written(view(spark, sf_dir, "links"), "links"), "candidate_id", "evidence_id")
    return rollup.candidate_status(rollup.active_counts(rollup.deactivate(links, links.where("candidate_id % 3 = 0"))))


_MOVES = """
WITH l AS (SELECT *, CASE WHEN official THEN 'official_identity' ELSE 'canonical_url' END AS match_rule FROM v_links),
m AS (SELECT evidence_id, max(candidate_id) AS from_id, max(candidate_id) + CASE WHEN evidence_id % 5 = 0 THEN 0 ELSE 1 END AS to_id FROM l GROUP BY 1),
h AS (SELECT evidence_id, count(*) FILTER (WHERE active) AS n, min(candidate_id) FILTER (WHERE active) AS held FROM l GROUP BY 1),
e AS (SELECT m.*, CASE WHEN from_id = to_id THEN 'event_candidate_regroup_target_unchanged' WHEN n <> 1 OR held <> from_id THEN 'event_candidate_association_ambiguous'
  WHEN to_id NOT IN (SELECT candidate_id FROM l) THEN 'event_candidate_not_found' END AS move_error FROM m JOIN h USING (evidence_id)),
g AS (SELECT * FROM e WHERE move_error IS NULL),
o AS (SELECT l.* REPLACE (active AND g.evidence_id IS NULL AS active) FROM l LEFT JOIN g ON g.evidence_id = l.evidence_id AND g.from_id = l.candidate_id
  UNION ALL SELECT l.* REPLACE (g.to_id AS candidate_id, 'reviewed_regroup' AS match_rule) FROM l JOIN g ON g.evidence_id = l.evidence_id AND g.from_id = l.candidate_id WHERE l.active)
"""


def _moves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Links with the rule they were made by, and a move of each evidence from its greatest candidate, with what forbids it."""
    links = view(spark, sf_dir, "links").withColumn("match_rule", F.when(F.col("official"), "official_identity").otherwise("canonical_url"))
    moves = links.groupBy("evidence_id").agg(F.max("candidate_id").alias("from_id")).withColumn("to_id", F.col("from_id") + F.when(F.col("evidence_id") % 5 == 0, 0).otherwise(1))
    return links, rollup.regroup_errors(links, moves, links.select(F.col("candidate_id").alias("id")).distinct())


@_query(_MOVES + "SELECT evidence_id, from_id, to_id, move_error FROM e")
def event_regroup_errors(spark, sf_dir):
    return _moves(spark, sf_dir)[1]


@_query(_MOVES + "SELECT candidate_id, match_rule, count(*) AS links, count(*) FILTER (WHERE active) AS active FROM o GROUP BY ALL")
def event_regroup(spark, sf_dir):
    links, moves = _moves(spark, sf_dir)
    after = rollup.regroup(links, moves.where("move_error is null").drop("move_error"))
    return after.groupBy("candidate_id", "match_rule").agg(F.count("*").alias("links"), F.count_if("active").alias("active"))


@_query("""
WITH r AS (SELECT candidate_id, count(DISTINCT source_id) AS sources FROM v_links WHERE active GROUP BY 1)
SELECT candidate_id, CASE WHEN sources > 1 THEN 0.5 ELSE 0.25 END::DOUBLE AS confidence,
  CASE candidate_id % 4 WHEN 0 THEN 'trading_action_language_forbidden' WHEN 1 THEN 'rationale_summary_required' ELSE '' END AS errors FROM r""")
def event_impact_mock(spark, sf_dir):
    rolled = view(spark, sf_dir, "links").where("active").groupBy("candidate_id").agg(F.count_distinct("source_id").alias("sources"))
    said = F.when(F.col("candidate_id") % 4 == 0, "Above the threshold").when(F.col("candidate_id") % 4 == 1, " ").otherwise(F.lit(scoring.MOCK_RATIONALE))
    rows = rolled.select("candidate_id", scoring.mock_impact_confidence(F.col("sources")).alias("confidence"), said.alias("said"))
    return rows.select("candidate_id", "confidence", F.array_join(scoring.analysis_errors(F.col("confidence"), F.lit(1), F.col("said")), ",").alias("errors"))


_FOLDED = "WITH RECURSIVE " + _SIGNED.strip()[5:] + """, r AS (
  SELECT row_number() OVER (ORDER BY seen, evidence_id) AS n, evidence_id, sigs, fp, entity, seen, sha256('ambiguous_evidence:' || sha256(CAST(evidence_id AS VARCHAR))) AS lone,
    sha256(CASE WHEN split_part(sigs[1], ':', 1) = 'hash' AND fp IS NOT NULL THEN 'entity_title_time:' || sha256('[''' || entity || ''']:' || fp || ':' || CAST(CAST(floor(epoch(seen) / 86400) AS BIGINT) AS VARCHAR)) ELSE sigs[1] END) AS own FROM s),
f(n, clusters, evidence_id, cluster_key, rank) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(k VARCHAR, sigs VARCHAR[], fps VARCHAR[], entities VARCHAR[], last TIMESTAMP)[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER)
  UNION ALL
  SELECT n, CASE WHEN list_contains(list_transform(clusters, lambda c: c.k), key)
      THEN list_transform(clusters, lambda c: CASE WHEN c.k = key THEN {'k': c.k, 'sigs': list_distinct(list_concat(c.sigs, sigs)), 'fps': list_distinct(list_append(c.fps, fp)), 'entities': list_distinct(list_append(c.entities, entity)), 'last': greatest(c.last, seen)} ELSE c END)
      ELSE list_append(clusters, {'k': key, 'sigs': sigs, 'fps': [fp], 'entities': [entity], 'last': seen}) END, evidence_id, key, CASE WHEN ways > 1 THEN 0 ELSE best END
  FROM (SELECT *, CASE WHEN best = 9 THEN own WHEN ways > 1 THEN lone ELSE clusters[list_position(ranks, best)].k END AS key
    FROM (SELECT *, coalesce(list_min(ranks), 9) AS best, CASE WHEN coalesce(list_min(ranks), 9) = 9 THEN 0 ELSE len(list_filter(ranks, lambda x: x = list_min(ranks))) END AS ways
      FROM (SELECT r.*, clusters, list_transform(clusters, lambda c: CASE WHEN list_has_any(c.sigs, list_filter(r.sigs, lambda x: starts_with(x, 'official:'))) THEN 1 WHEN list_has_any(c.sigs, list_filter(r.sigs, lambda x: starts_with(x, 'url:'))) THEN 2
          WHEN list_has_any(c.sigs, list_filter(r.sigs, lambda x: starts_with(x, 'provider:'))) THEN 3 WHEN list_contains(c.fps, r.fp) AND list_contains(c.entities, r.entity) AND r.seen <= c.last + INTERVAL 24 HOUR THEN 4
          WHEN list_has_any(c.sigs, r.sigs) THEN 5 ELSE 9 END) AS ranks FROM f JOIN r ON r.n = f.n + 1))))
SELECT evidence_id, cluster_key, CASE rank WHEN 0 THEN 'ambiguous_new_candidate' WHEN 9 THEN 'new_candidate' ELSE ['official_identity', 'canonical_url', 'provider_external_id', 'entity_title_time', 'approved_hash'][rank] END AS match_rule FROM f WHERE n > 0"""


#: The SQL is the process itself: one row after the other, with all clusters so far in a list.
@_query(_FOLDED)
def event_fold_components(spark, sf_dir):
    return fold.fold(_signed(spark, sf_dir))


# --- delivery -------------------------------------------------------------------------------------------------------


@_query("""
WITH stored AS (SELECT concat(CASE id % 4 WHEN 0 THEN 'marketaux' WHEN 1 THEN 'finnhub' WHEN 2 THEN 'eia' ELSE 'sec_edgar' END, ':telegram:', id) AS dedup_key FROM v_content WHERE id % 3 = 0),
i AS (SELECT id AS content_id, concat(CASE id % 4 WHEN 0 THEN 'marketaux' WHEN 1 THEN 'finnhub' WHEN 2 THEN 'eia' ELSE 'sec_edgar' END, ':telegram:', id) AS dedup_key FROM v_content)
SELECT content_id, dedup_key, 'sending' AS status, 0 AS retry_count FROM i WHERE dedup_key NOT IN (SELECT dedup_key FROM stored)""")
def notify_claim_new(spark, sf_dir):
    items = view(spark, sf_dir, "content").select(F.col("id").alias("content_id"), F.element_at(F.array(*(F.lit(m) for m in METHODS)), (F.col("id") % 4 + 1).cast("int")).alias("provider"))
    stored = items.where("content_id % 3 = 0").select(delivery.dedup_key(F.col("provider"), F.col("content_id")).alias("dedup_key"))
    # Every item twice: a batch that repeats itself still claims each once.
    return delivery.claim_new(items.union(items), stored).select("content_id", "dedup_key", "status", "retry_count")


_RETRY = """SELECT id, 'sending' AS status, CASE WHEN status = 'pending' THEN retry_count ELSE retry_count + 1 END AS retry_count, {now} AS scheduled_at, content_id FROM v_notifications
WHERE retry_count < 3 AND (status = 'failed' OR (status = 'sending' AND scheduled_at < {now} - INTERVAL 300 SECOND){more}) ORDER BY v_notifications.scheduled_at NULLS LAST, id LIMIT 500"""


@_query(_RETRY.format(now=_NOW, more=" OR status = 'pending'"))
def notify_claim_retries(spark, sf_dir):
    return delivery.claim_retries(view(spark, sf_dir, "notifications"), _now(), limit=500).select("id", "status", "retry_count", "scheduled_at", "content_id")


@_query(_RETRY.format(now=_NOW, more=""))
def notify_claim_retries_strict(spark, sf_dir):
    return delivery.claim_retries(view(spark, sf_dir, "notifications"), _now(), limit=500, pending=False).select("id", "status", "retry_count", "scheduled_at", "content_id")


@_query(f"""SELECT count(*) FILTER (WHERE retry_count >= 3 AND status IN ('failed', 'sending')) AS exhausted,
  count(*) FILTER (WHERE retry_count >= 3 AND (status = 'failed' OR (status = 'sending' AND scheduled_at < {_NOW} - INTERVAL 300 SECOND))) AS exhausted_strict FROM v_notifications""")
def notify_exhausted(spark, sf_dir):
    return delivery.exhausted(view(spark, sf_dir, "notifications"), _now())


@_query("""SELECT id, CASE WHEN status = 'sending' AND id % 3 = 0 THEN 'sent' WHEN status = 'sending' AND id % 3 = 1 THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'sending' AND id % 3 = 1 THEN 'delivery_failed' END AS failure_code FROM v_notifications""")
def notify_mark(spark, sf_dir):
    rows = view(spark, sf_dir, "notifications")
    results = rows.where("id % 3 < 2").select("id", (F.col("id") % 3 == 0).alias("sent"), F.lit("delivery_failed").alias("code"))
    return delivery.mark(rows, results).select("id", "status", "failure_code")


# --- coverage -------------------------------------------------------------------------------------------------------


@_query("""SELECT provider, count(*) AS items, count(*) FILTER (WHERE coalesce(provider_item_id, '') <> '') AS has_provider_item_id, count(*) FILTER (WHERE event_time IS NOT NULL) AS has_event_time,
  count(*) FILTER (WHERE coalesce(title, '') <> '') AS has_title, count(*) FILTER (WHERE content_item_id IS NOT NULL) AS has_content_item_id, count(*) AS has_toxic FROM v_evidence GROUP BY provider""")
def coverage_fields(spark, sf_dir):
    return coverage.field_coverage(view(spark, sf_dir, "evidence"), "provider", ["provider_item_id", "event_time", "title", "content_item_id", "toxic"])


@_query("SELECT event_type, count(*) AS items FROM events GROUP BY event_type")
def coverage_type_histogram(spark, sf_dir):
    return coverage.histogram(_read(spark, sf_dir, "events"), "event_type")
