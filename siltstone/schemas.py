"""Schemas of the stored tables, and the integrity that plain files don't enforce: keys, references and checks as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES = {
    "sources": "id string, code string, name string, source_type string, access_method string, authorization_status string, retention_class string, enabled boolean, schedule_seconds int, last_success_at timestamp, consecutive_failures int",
    "source_accounts": "id string, source_id string, external_id string, handle string, endpoint string, identity_status string, enabled boolean, collection_options string",
    "collection_cursors": "source_account_id string, cursor_type string, cursor_value string, last_published_at timestamp",
    "collection_runs": "id string, source_id string, source_account_id string, started_at timestamp, finished_at timestamp, status string, fetched_count int, new_count int, duplicate_count int, error_count int, error_code string, error_message_redacted string, retry_count int",
    "raw_items": "id string, source_id string, source_account_id string, collection_run_id string, external_id string, fetched_at timestamp, http_status int, content_type string, payload_location string, payload_hash string, retention_class string, parse_status string",
    "content_items": "id string, raw_item_id string, source_id string, source_account_id string, content_kind string, external_id string, title string, source_summary string, body string, body_availability string, author string, language string, original_url string, canonical_url string, source_published_at timestamp, source_updated_at timestamp, first_seen_at timestamp, content_hash string, deleted_status string, metadata string",
    "evidence_items": "id string, evidence_version int, provider string, provider_item_type string, evidence_kind string, source_type string, source_id string, source_account_id string, raw_item_id string, content_item_id string, provider_item_id string, provider_item_hash string, event_time timestamp, observed_at timestamp, access_level string, processing_status string, official_source_flag boolean, market_data_flag boolean, disclosure_flag boolean, news_signal_flag boolean, content_presence struct<has_title:boolean,has_body:boolean,has_url:boolean,has_snippet:boolean,has_description:boolean>, numeric_presence struct<has_numeric_value:boolean,numeric_field_count:int,nullable_allowed:boolean>, entity_refs array<string>, asset_refs array<string>, topic_refs array<string>, raw_payload_reference string, errors array<struct<code:string,field:string,safe_message:string>>",
    "event_candidates": "id string, cluster_key string, anchor_type string, anchor_value_hash string, strong_identity_hash string, identity_signatures array<string>, title_fingerprints array<string>, event_type string, status string, canonical_title string, fact_summary string, first_seen_at timestamp, latest_seen_at timestamp, occurred_at timestamp, published_at timestamp, primary_entity string, entities array<string>, companies array<string>, assets array<string>, sectors array<string>, topics array<string>, evidence_count int, source_count int, confidence double, importance_score double, importance_reasons array<string>",
    "event_candidate_evidence": "candidate_id string, evidence_id string, match_rule string, rule_version int, official_source boolean, active boolean, added_at timestamp, removed_at timestamp",
    "notifications": "id string, content_item_id string, priority string, reason string, policy_rule_id string, policy_version int, channel string, dedup_key string, payload_version int, status string, scheduled_at timestamp, sent_at timestamp, failure_code string, retry_count int",
}

#: Keys by table; a null in a key makes it no key.
UNIQUE = {
    "sources": [["code"]], "source_accounts": [["source_id", "external_id"]], "collection_cursors": [["source_account_id", "cursor_type"]],
    "content_items": [["raw_item_id"], ["source_id", "external_id"], ["canonical_url"], ["source_id", "content_hash"]], "evidence_items": [["provider", "provider_item_hash"], ["provider", "provider_item_id"]],
    "event_candidates": [["cluster_key"]], "notifications": [["dedup_key"]],
}

#: Conditions that every row meets; a null condition passes, as in SQL.
CHECKS = {
    "sources": ["schedule_seconds > 0", "consecutive_failures >= 0"],
    "collection_runs": ["finished_at >= started_at", "least(fetched_count, new_count, duplicate_count, error_count, retry_count) >= 0"],
    "raw_items": ["http_status between 100 and 599"],
    "event_candidates": ["confidence between 0 and 1", "importance_score between 0 and 100", "latest_seen_at >= first_seen_at"],
    "event_candidate_evidence": ["active <> (removed_at is not null)"],
}


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """(key, values, n) of every key that more than one row has."""
    out = None
    for key in UNIQUE.get(table, []):
        some = df.where(" and ".join(f"{c} is not null" for c in key)).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
        rows = some.select(F.lit(",".join(key)).alias("key"), F.concat_ws("|", *key).alias("values"), "n")
        out = rows if out is None else out.union(rows)
    return out if out is not None else df.sparkSession.createDataFrame([], "key string, values string, n long")


def broken_checks(table: str) -> Column:
    """The checks that a row breaks, as an array of their texts."""
    return F.array_compact(F.array(*(F.when(~F.expr(c), F.lit(c)) for c in CHECKS.get(table, [])))) if CHECKS.get(table) else F.array().cast("array<string>")


def orphans(df: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Rows whose reference is given and found nowhere."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col("id").alias(column)), column, "left_anti")


def schema_differences(df: DataFrame, table: str) -> list[str]:
    """What a stored table has more, less or otherwise than declared."""
    wanted = dict(df.sparkSession.createDataFrame([], TABLES[table]).dtypes)
    got = dict(df.dtypes)
    return sorted([f"missing {c}" for c in wanted.keys() - got.keys()] + [f"unknown {c}" for c in got.keys() - wanted.keys()] + [f"type of {c}" for c in wanted.keys() & got.keys() if wanted[c] != got[c]])
