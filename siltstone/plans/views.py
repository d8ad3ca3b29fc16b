"""The tables of the pipeline as views over the driver's tables.

Each view is given once, as projections that Spark and DuckDB both read; where they spell time arithmetic differently,
``{name}`` stands for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-01-31 12:00:00"
#: Spellings of the two dialects.
SPARK = {
    "base": "TIMESTAMP_NTZ'2024-01-01 00:00:00'", "late": "TIMESTAMP_NTZ'2024-01-30 00:00:00'",
    "minutes": lambda x, t: f"timestampadd(MINUTE, CAST({x} AS INT), {t})", "hours": lambda x, t: f"timestampadd(HOUR, CAST({x} AS INT), {t})",
    "first_line": "split_part(text, '\n', 1)", "sha": lambda x: f"sha2({x}, 256)",
}
DUCK = {
    "base": "TIMESTAMP '2024-01-01 00:00:00'", "late": "TIMESTAMP '2024-01-30 00:00:00'",
    "minutes": lambda x, t: f"({t} + to_minutes(CAST({x} AS BIGINT)))", "hours": lambda x, t: f"({t} + to_hours(CAST({x} AS BIGINT)))",
    "first_line": "split_part(text, chr(10), 1)", "sha": lambda x: f"sha256({x})",
}

METHOD = "CASE {0} % 4 WHEN 0 THEN 'marketaux' WHEN 1 THEN 'finnhub' WHEN 2 THEN 'eia' ELSE 'sec_edgar' END"


def _views(d: dict) -> dict[str, str]:
    return {
        "sources": f"""SELECT id, n % 7 <> 3 AS enabled, CASE n % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'implemented' ELSE 'authorized' END AS authorization_status,
            CASE WHEN n % 11 = 10 THEN NULL ELSE 3600 * (1 + n % 4) END AS schedule_seconds, {METHOD.format('n')} AS access_method, n % 6 AS consecutive_failures,
            CASE WHEN n % 3 = 0 THEN NULL ELSE {d['hours']('-n', d['late'])} END AS last_success_at
            FROM (SELECT DISTINCT source AS id, CAST(substr(source, 4) AS INT) AS n FROM documents) AS s""",
        "accounts": """SELECT concat('s', s_suppkey) AS id, concat('src', s_suppkey % 17) AS source_id, s_suppkey % 3 <> 0 AS enabled,
            CASE WHEN s_suppkey % 4 = 0 THEN 'pending' ELSE 'verified' END AS identity_status FROM supplier""",
        "runs": """SELECT event_id AS id, concat('src', user_id % 20) AS source_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('s', user_id % 100 + 1) END AS source_account_id, ts AS started_at,
            CASE WHEN event_type = 'signup' AND event_id % 20 = 0 THEN 'running' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'partial' ELSE 'succeeded' END AS status, event_id % 4 AS fetched_count,
            CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 429 WHEN 1 THEN 503 ELSE 404 END ELSE 200 END AS http_status FROM events""",
        "content": f"""SELECT doc_id AS id, doc_id AS raw_item_id, source AS source_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat('x', doc_id % 700) END AS external_id,
            CASE WHEN doc_id % 13 = 0 THEN NULL ELSE {d['first_line']} END AS title, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE concat('https://news.test/', doc_id % 900) END AS canonical_url,
            CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {d['minutes']('doc_id % 5000', d['base'])} END AS source_published_at, {d['sha']("coalesce(text, '')")} AS content_hash FROM documents""",
        "raw": """SELECT doc_id AS id, doc_id % 25 AS run_id, source AS source_id, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE concat('s', doc_id % 100 + 1) END AS source_account_id FROM documents""",
        "evidence": f"""SELECT doc_id AS id, doc_id AS raw_item_id, {METHOD.format('doc_id')} AS provider, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE concat('p', doc_id % 350) END AS provider_item_id,
            {d['sha']("concat('h', doc_id % 300)")} AS provider_item_hash, source AS source_id, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE concat('s', doc_id % 100 + 1) END AS source_account_id,
            CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id END AS content_item_id, quality = 1 AS official_source, toxic = 1 AS toxic,
            CASE WHEN doc_id % 7 = 0 THEN NULL ELSE {d['hours']('doc_id % 400', d['base'])} END AS event_time, {d['hours']('doc_id % 500', d['base'])} AS observed_at,
            CASE WHEN toxic = 1 THEN 'blocked' ELSE 'validated' END AS processing_status, CASE WHEN doc_id % 3 = 0 THEN line ELSE concat('Story ', doc_id % 7) END AS title, concat('https://news.test/', doc_id % 260, '?utm_source=a') AS canonical_url,
            concat('e', doc_id % 3) AS entity FROM labels JOIN (SELECT doc_id, source, {d['first_line']} AS line FROM documents) AS lines USING (doc_id)""",
        "notifications": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'sending' END AS status, CAST(o_orderkey % 5 AS INT) AS retry_count,
            CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS scheduled_at, CAST(NULL AS VARCHAR(20)) AS failure_code, o_custkey AS content_id FROM orders""",
        "links": """SELECT l_orderkey AS candidate_id, l_partkey AS evidence_id, concat('src', l_suppkey % 20) AS source_id, l_linestatus = 'F' AS official, p_brand AS entity,
            l_returnflag <> 'R' AS active, l_shipdate AS seen_at FROM lineitem JOIN part ON l_partkey = p_partkey""",
    }


def sql(name: str) -> str:
    """A view as DuckDB SQL."""
    return "(" + _views(DUCK)[name] + ")"


def with_views(query: str) -> str:
    """DuckDB SQL with the views it names in front."""
    used = [v for v in _views(DUCK) if f"v_{v}" in query]
    if not used:
        return query
    head = "WITH RECURSIVE " if query.startswith("WITH RECURSIVE ") else "WITH "
    return head + ", ".join(f"v_{v} AS ({_views(DUCK)[v]})" for v in used) + (", " + query[len(head) :] if query.startswith("WITH ") else " " + query)


_TABLES = {"sources": ["documents"], "accounts": ["supplier"], "runs": ["events"], "content": ["documents"], "raw": ["documents"], "evidence": ["labels", "documents"], "notifications": ["orders"], "links": ["lineitem", "part"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the tables it reads are bound by name, not registered."""
    text = _views(SPARK)[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}").replace(f"JOIN {t} ", f"JOIN {{{t}}} AS {t} ")
    return spark.sql(text, **tables)
