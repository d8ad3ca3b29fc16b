"""Deduplication by identity keys, and the decision whether a row may be stored; all set-wise, first row of a key wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields in which a row must agree with a stored one to be the same evidence; when it was observed does not count.
EQUIVALENCE = (
    "evidence_version", "provider", "provider_item_type", "evidence_kind", "source_type", "source_id", "source_account_id", "raw_item_id", "content_item_id", "provider_item_id", "provider_item_hash", "event_time", "access_level",
    "processing_status", "official_source_flag", "market_data_flag", "disclosure_flag", "news_signal_flag", "content_presence", "numeric_presence", "entity_refs", "asset_refs", "topic_refs", "raw_payload_reference", "errors",
)


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def identity(source: Column, external_id: Column, url: Column, content_hash: Column) -> Column:
    """The strongest identity a content row has: its source's id, else its address, else its source's hash."""
    return F.coalesce(F.concat(F.lit("id|"), source, F.lit("|"), external_id), F.concat(F.lit("url|"), url), F.concat(F.lit("hash|"), source, F.lit("|"), content_hash))


def by_precedence(df: DataFrame) -> DataFrame:
    """One row for each identity, the least id; rows without any identity all stay."""
    keyed = df.withColumn("identity_key", identity(F.col("source_id"), F.col("external_id"), F.col("canonical_url"), F.col("content_hash")))
    some = first_of(keyed.where("identity_key is not null"), ["identity_key"], [F.col("id")])
    return some.unionByName(keyed.where("identity_key is null"))


def new_only(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose raw item and whose (source, external id) are both new, also within the batch.

    Two anti joins: one with OR would compare every pair.  Null external ids never match.
    """
    fresh = incoming.join(stored.select("raw_item_id"), "raw_item_id", "left_anti")
    fresh = fresh.join(stored.where("external_id is not null").select("source_id", "external_id"), ["source_id", "external_id"], "left_anti")
    fresh = first_of(fresh, ["raw_item_id"], [F.col("id")])
    named = first_of(fresh.where("external_id is not null"), ["source_id", "external_id"], [F.col("id")])
    return named.unionByName(fresh.where("external_id is null"))


def insert_missing(incoming: DataFrame, stored: DataFrame, key: str, order: list) -> DataFrame:
    """What ``INSERT ... ON CONFLICT (key) DO NOTHING RETURNING`` would return."""
    return first_of(incoming, [key], order).join(stored.select(key), key, "left_anti")


def provenance_error(rows: DataFrame, raw: DataFrame, accounts: DataFrame, content: DataFrame) -> DataFrame:
    """Adds ``provenance_error``: what a row refers to is not found, or belongs to something else."""
    r = raw.select(F.col("id").alias("_r"), F.col("source_id").alias("_rs"), F.col("source_account_id").alias("_ra"))
    a = accounts.select(F.col("id").alias("_a"), F.col("source_id").alias("_as"))
    c = content.select(F.col("id").alias("_c"), F.col("source_id").alias("_cs"), F.col("raw_item_id").alias("_cr"))
    met = rows.join(r, rows.raw_item_id == F.col("_r"), "left").join(a, rows.source_account_id == F.col("_a"), "left").join(c, rows.content_item_id == F.col("_c"), "left")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    error = (
        F.when(F.col("_r").isNull(), "raw_item_id:reference_not_found").when(~same("_rs", "source_id") | ~same("_ra", "source_account_id"), "raw_item_id:provenance_mismatch")
        .when(F.col("source_account_id").isNotNull() & F.col("_a").isNull(), "source_account_id:reference_not_found").when(F.col("source_account_id").isNotNull() & ~same("_as", "source_id"), "source_account_id:provenance_mismatch")
        .when(F.col("content_item_id").isNotNull() & F.col("_c").isNull(), "content_item_id:reference_not_found")
        .when(F.col("content_item_id").isNotNull() & (~same("_cs", "source_id") | ~same("_cr", "raw_item_id")), "content_item_id:provenance_mismatch")
    )
    return met.withColumn("provenance_error", error).drop("_r", "_rs", "_ra", "_a", "_as", "_c", "_cs", "_cr")


def classify(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``decision``: inserted, existing, or a conflict; by (provider, hash) first, then by (provider, item id).

    Stored keys are unique; null item ids never match.
    """
    packed = lambda prefix="": F.struct(*(F.col(prefix + c) for c in EQUIVALENCE))
    by_hash = stored.select(F.col("provider").alias("_p"), F.col("provider_item_hash").alias("_h"), packed().alias("_by_hash"))
    by_id = stored.where("provider_item_id is not null").select(F.col("provider").alias("_q"), F.col("provider_item_id").alias("_i"), packed().alias("_by_id"))
    rows = incoming.withColumn("_own", packed())
    met = rows.join(by_hash, (rows.provider == F.col("_p")) & (rows.provider_item_hash == F.col("_h")), "left").join(by_id, (rows.provider == F.col("_q")) & (rows.provider_item_id == F.col("_i")), "left")
    same = lambda other: reduce(lambda a, b: a & b, (F.col(f"_own.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in EQUIVALENCE))
    decision = (
        F.when(F.col("_h").isNotNull(), F.when(same("_by_hash"), "existing").otherwise("provider_hash_conflict"))
        .when(F.col("_i").isNotNull(), F.when(F.col("_by_id.provider_item_hash") != F.col("provider_item_hash"), "provider_item_id_conflict").when(same("_by_id"), "existing").otherwise("provider_hash_conflict"))
        .otherwise("inserted")
    )
    return met.withColumn("decision", decision).drop("_own", "_p", "_h", "_by_hash", "_q", "_i", "_by_id")


def write_decision(unsafe: Column, errors: Column, provenance: Column, decision: Column) -> Column:
    """The outcome of one write: invalid by envelope or provenance, else as classified; unsafe references only block."""
    return F.when(F.size(errors) > 0, "invalid").when(provenance.isNotNull(), "invalid").when(decision.endswith("conflict"), "conflict").when(decision == "existing", "existing").when(unsafe, "blocked").otherwise("inserted")


def write_summary(rows: DataFrame) -> DataFrame:
    """Counts by outcome; their sum is the number of rows."""
    names = ("inserted", "existing", "blocked", "invalid", "conflict")
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("outcome") == n).alias(n) for n in names)).withColumn("conserved", F.col("total") == reduce(lambda a, b: a + b, (F.col(n) for n in names)))
