"""Registered queries of what changes over time: links, roll-ups, claims and deliveries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import delivery, feed, rollup
from siltstone.operators.tables import dealt, written
from siltstone.plans.views import NOW, view, with_views
from siltstone.schemas import broken_checks

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_NOW = f"TIMESTAMP '{NOW}'"


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


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


# --- links and roll-ups ---------------------------------------------------------------------------------------------

#: Links that were closed before carry the time they were last seen; a part is closed now.
_CLOSED = f"""
WITH l AS (SELECT *, CASE WHEN NOT active THEN CAST(seen_at AS TIMESTAMP) END AS removed_at FROM v_links),
o AS (SELECT * REPLACE (active AND NOT (candidate_id % 3 = 0 AND evidence_id % 2 = 0) AS active, CASE WHEN active AND candidate_id % 3 = 0 AND evidence_id % 2 = 0 THEN {_NOW} ELSE removed_at END AS removed_at) FROM l)
"""


def _links(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    links = view(spark, sf_dir, "links").withColumn("removed_at", F.when(~F.col("active"), F.col("seen_at").cast("timestamp_ntz")))
    return links, _closed_now(links)


def _closed_now(links: DataFrame) -> DataFrame:
    return links.where("candidate_id % 3 = 0 and evidence_id % 2 = 0").select("candidate_id", "evidence_id")


@_query(_CLOSED + "SELECT candidate_id, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE NOT active) AS closed, max(removed_at) AS last_removed_at, CAST(0 AS BIGINT) AS broken FROM o GROUP BY candidate_id")
def event_close_links(spark, sf_dir):
    links, which = _links(spark, sf_dir)
    after = rollup.deactivate(links, which, _now())
    broken = F.count_if(F.size(broken_checks("event_candidate_evidence")) > 0)
    return after.groupBy("candidate_id").agg(F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("closed"), F.max("removed_at").alias("last_removed_at"), broken.alias("broken"))


@_query("""
WITH n AS (SELECT candidate_id, evidence_id, count(*) FILTER (WHERE active) AS n FROM v_links GROUP BY ALL)
SELECT candidate_id, evidence_id, CASE WHEN n = 0 THEN 'event_candidate_evidence_not_found' WHEN n > 1 THEN 'event_candidate_association_ambiguous' END AS close_error FROM n""")
def event_close_errors(spark, sf_dir):
    links = dealt(written(view(spark, sf_dir, "links").select("candidate_id", "evidence_id", "active"), "links"), "candidate_id", "evidence_id")
    return rollup.deactivate_errors(links, links.select("candidate_id", "evidence_id").distinct())


_MOVED = _CLOSED + """, m AS (SELECT evidence_id, candidate_id AS from_id, candidate_id + 2 AS to_id FROM o WHERE active AND candidate_id % 4 = 1 AND evidence_id % 5 = 0),
p AS (SELECT DISTINCT * FROM m),
a AS (SELECT o.candidate_id, o.evidence_id, o.source_id, o.official, o.entity, o.active AND p.evidence_id IS NULL AS active FROM o LEFT JOIN p ON p.evidence_id = o.evidence_id AND p.from_id = o.candidate_id
  UNION ALL SELECT p.to_id, o.evidence_id, o.source_id, o.official, o.entity, true FROM o JOIN p ON p.evidence_id = o.evidence_id AND p.from_id = o.candidate_id WHERE o.active)
"""


#: The SQL rolls up all links as they are in the end; the query starts from the roll-up before and takes the changes in.
@_query(_MOVED + """SELECT candidate_id, count(DISTINCT CASE WHEN active THEN evidence_id END) AS evidence_count, count(DISTINCT CASE WHEN active THEN source_id END) AS source_count,
  coalesce(bool_or(CASE WHEN active THEN official END), false) AS official, count(DISTINCT CASE WHEN active THEN entity END) AS entity_count,
  CASE WHEN count(DISTINCT CASE WHEN active THEN evidence_id END) = 0 THEN 'rejected' ELSE 'candidate' END AS status FROM a GROUP BY candidate_id""")
def event_rollup_changes(spark, sf_dir):
    links = written(_links(spark, sf_dir)[0], "links")
    which = _closed_now(links)
    counts, state = written(rollup.active_counts(links), "counts"), written(rollup.multiplicities(links), "multiplicities")
    keys = ["candidate_id", "evidence_id"]
    # First some links are closed, then others are moved: each time only the links that change make deltas.
    which = which.distinct()
    closing = links.join(which, keys, "left_semi")
    counts, state = rollup.kept_up(counts, state, rollup.link_deltas(closing, rollup.deactivate(closing, which, _now())))
    closed = written(rollup.deactivate(links, which, _now()), "links")
    moves = closed.where("active and candidate_id % 4 = 1 and evidence_id % 5 = 0").select("evidence_id", F.col("candidate_id").alias("from_id"), (F.col("candidate_id") + 2).alias("to_id")).distinct()
    moving = closed.join(moves.select("evidence_id", F.col("from_id").alias("candidate_id")), keys, "left_semi")
    counts, _ = rollup.kept_up(counts, state, rollup.link_deltas(moving, rollup.regroup(moving, moves, _now())))
    return rollup.candidate_status(counts)


# --- deliveries -----------------------------------------------------------------------------------------------------

_POLICIES = 3


@_query(f"""
WITH n AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'mail' ELSE 'telegram' END AS channel, concat('policy', id % {_POLICIES}) AS policy_rule_id FROM v_notifications),
r AS (SELECT *, row_number() OVER (PARTITION BY channel, policy_rule_id ORDER BY scheduled_at NULLS LAST, id) AS place FROM n
  WHERE retry_count < 3 AND (status IN ('failed', 'pending') OR (status = 'sending' AND scheduled_at < {_NOW} - INTERVAL 300 SECOND)))
SELECT id, channel, policy_rule_id, 'sending' AS status, CASE WHEN status = 'pending' THEN retry_count ELSE retry_count + 1 END AS retry_count, {_NOW} AS scheduled_at
FROM r WHERE place <= CASE policy_rule_id WHEN 'policy0' THEN 7 WHEN 'policy1' THEN 20 ELSE 0 END""")
def notify_claim_by_policy(spark, sf_dir):
    rows = view(spark, sf_dir, "notifications").withColumns({"channel": F.when(F.col("id") % 5 == 0, "mail").otherwise("telegram"), "policy_rule_id": F.concat(F.lit("policy"), F.col("id") % _POLICIES)})
    pairs = rows.select("channel", "policy_rule_id").distinct()
    limits = pairs.withColumn("claims", F.when(F.col("policy_rule_id") == "policy0", 7).when(F.col("policy_rule_id") == "policy1", 20)).where("claims is not null")
    return delivery.claim_retries_by(rows, limits, _now(), most=20).select("id", "channel", "policy_rule_id", "status", "retry_count", "scheduled_at")


_METHODS = ("marketaux", "finnhub", "eia", "sec_edgar", "unheard_of")


@_query("""
WITH i AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 5 < 4 THEN concat_ws(chr(10), concat(['News', 'Market data', 'Official energy data', 'Company filing'][conv_id % 5 + 1], ': ', text), concat('Source: ', role), concat('Time: ', CAST(turn AS VARCHAR))) END AS block,
    text LIKE '%token=%' OR (conv_id % 7 = 6 AND turn = 1) AS unsafe, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
f AS (SELECT * FROM i WHERE place <= 5),
d AS (SELECT conv_id, CASE WHEN bool_or(block IS NULL) THEN 'telegram_provider_unsupported' WHEN bool_or(unsafe) THEN 'telegram_content_unsafe' WHEN length(string_agg(block, chr(10) || chr(10))) > 2500 THEN 'telegram_message_too_long'
  WHEN conv_id % 11 = 3 THEN 'telegram_delivery_failed' WHEN conv_id % 11 = 5 THEN 'telegram_transport_failed' WHEN conv_id % 11 = 7 THEN 'telegram_request_rejected' END AS failure_code FROM f GROUP BY conv_id)
SELECT conv_id, turn, CASE WHEN failure_code IS NULL THEN 'sent' ELSE 'failed' END AS status, failure_code FROM f JOIN d USING (conv_id)""")
def notify_deliver(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    provider = reduce(lambda c, kv: c.when(F.col("conv_id") % 5 == kv[0], kv[1]), list(enumerate(_METHODS))[1:], F.when(F.col("conv_id") % 5 == 0, _METHODS[0]))
    items = rows.select("conv_id", "turn", feed.block(provider, F.col("text"), F.col("role"), F.col("turn").cast("string"), F.lit(None)).alias("block"), (F.col("text").contains("token=") | ((F.col("conv_id") % 7 == 6) & (F.col("turn") == 1))).alias("unsafe"))
    k = F.col("conv_id") % 11
    answers = rows.select("conv_id").distinct().withColumns({"http_status": F.when(k == 7, 500).otherwise(200), "failure": F.when(k == 3, "boom").when(k == 5, "telegram_transport_failed")})
    return delivery.deliver(items, answers, "conv_id", "turn", limit=5, message_chars=2500).select("conv_id", "turn", "status", "failure_code")
