"""Captured provider responses as files: one JSON document each, read and written by Spark, so any store will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import SECRET_MARKS, canonical_json, stable_hash
from siltstone.operators.coverage import capture_state, replay_ready, secret_in
from siltstone.operators.payloads import item_texts
from siltstone.operators.validate import PROVIDERS, capture_within_limit, collection_error

#: Places of the items in each provider's body.
ITEM_PATHS = {"marketaux": "$.data", "finnhub": None, "eia": "$.response.data", "sec_edgar": "$.filings.recent"}


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row for each ``*.json`` file directly under ``path``: file, size, sha256, text and the parsed envelope."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    text = F.decode("content", "UTF-8")
    v = F.try_parse_json(text)
    field = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    return files.select(
        F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), text.alias("text"), field("capture_version", "int").alias("capture_version"),
        field("provider", "string").alias("provider"), field("captured_at", "string").alias("captured_at"), field("http_status", "int").alias("http_status"), field("error", "string").alias("error"), F.try_variant_get(v, "$.request.limit", "int").alias("limit"),
        F.to_json(field("response_body", "variant")).alias("body"))


def item_count(provider: Column, body: Column) -> Column:
    """Items in a body: array elements, one object, or the longest column of a struct of arrays."""
    elements = lambda path: F.json_array_length(F.get_json_object(body, path))
    columns = F.from_json(F.get_json_object(body, "$.filings.recent"), "map<string,array<string>>")
    longest = F.array_max(F.transform(F.map_values(columns), F.size))
    count = F.when(provider == "marketaux", elements("$.data")).when(provider == "eia", elements("$.response.data")).when(provider == "sec_edgar", longest).when(provider == "finnhub", F.when(F.size(F.json_object_keys(body)) > 0, 1).otherwise(0))
    return F.coalesce(count, F.lit(0))


def audit(captures: DataFrame) -> DataFrame:
    """Per capture: what it is, whether it keeps to its provider's limit of items or holds secrets, and whether it can be
    replayed."""
    n = item_count(F.col("provider"), F.col("body"))
    return captures.select(
        "file", "provider", "size", "sha256", F.array_join(F.array_sort(F.json_object_keys("body")), ",").alias("top_level_keys"), n.alias("items"), capture_within_limit(F.col("provider"), F.col("limit"), n).alias("within_limit"),
        secret_in(F.col("text")).alias("secret"), capture_state(F.col("text"), F.coalesce("provider", F.lit("")), n, list(PROVIDERS)).alias("state"), F.coalesce(replay_ready(F.col("http_status"), F.col("error")), F.lit(False)).alias("replay_ready"))


def capture_error(parsed: Column, provider: Column, http_status: Column, error: Column) -> Column:
    """What is wrong with one capture, as a provider's error: null if it can be used.  Each file is judged by itself."""
    return (
        F.when(~parsed, "provider_contract_invalid").when(~F.coalesce(provider.isin(*PROVIDERS), F.lit(False)), "provider_config_invalid")
        .when(error == "timeout", "provider_timeout").when(http_status == 429, "provider_rate_limited").when((http_status >= 500) | error.isNotNull(), "provider_upstream_error")
        .when(~F.coalesce(http_status.between(200, 299), F.lit(False)), "provider_upstream_error")
    )


def collected(captures: DataFrame) -> DataFrame:
    """(file, provider, items, error_code) of every file of ``read_captures``: the items of those that can be used, as canonical
    JSON texts, and of every other one the run's error.

    A file that is no JSON, or a provider that failed, leaves the others whole: nothing is raised, each file is a row.  Upstream
    errors of 500 and above, and rate limits, may pass by themselves; those below are final.  A file that names no provider is
    told by its name alone; one without a byte is not listed, as Spark passes over it.
    """
    parsed = F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT<"), F.lit(False))
    wrong = capture_error(parsed, F.col("provider"), F.col("http_status"), F.col("error"))
    judged = captures.withColumn("_wrong", wrong).withColumn("body", F.when(F.col("_wrong").isNull(), F.col("body")))
    with_items = item_texts(judged, "body", "items")
    code = collection_error(F.col("_wrong"), F.coalesce(F.col("http_status") >= 500, F.lit(False)))
    return with_items.select("file", "provider", F.coalesce("items", F.array().cast("array<string>")).alias("items"), code.alias("error_code"))


def outcomes_by_provider(found: DataFrame) -> DataFrame:
    """Per provider: files, failed, items and the errors with their numbers (map); files that name none are under null."""
    errors = found.where("error_code is not null").groupBy("provider", "error_code").agg(F.count("*").alias("n"))
    errors = errors.groupBy(F.col("provider").alias("_p")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_code", "n")))).alias("errors"))
    sums = found.groupBy("provider").agg(F.count("*").alias("files"), F.count("error_code").alias("failed"), F.sum(F.size("items")).alias("items"))
    return sums.join(errors, F.col("provider").eqNullSafe(F.col("_p")), "left").select("provider", "files", "failed", "items", F.coalesce("errors", F.create_map().cast("map<string,bigint>")).alias("errors"))


def write_captures(bodies: DataFrame, path: str) -> DataFrame:
    """Writes (provider, body) as canonical JSON lines under ``path`` and returns the hashes of what was written."""
    rows = bodies.select("provider", canonical_json(F.col("body")).alias("value"))
    rows.write.mode("append").partitionBy("provider").text(path)
    return rows.select("provider", stable_hash(F.col("value")).alias("sha256"), F.octet_length("value").alias("size"))


def sanitized(values: Column) -> Column:
    """A map of texts with secret keys dropped and secret values replaced."""
    low = "|".join(SECRET_MARKS)
    kept = F.map_filter(values, lambda k, v: ~F.lower(k).rlike(low))
    return F.transform_values(kept, lambda k, v: F.when(F.lower(v).rlike(low), F.lit("[REDACTED]")).otherwise(v))


def safe_headers(headers: Column, allowed: list[str]) -> Column:
    """Response headers that may be kept."""
    return F.map_filter(headers, lambda k, v: F.lower(k).isin(*allowed))


def head(items: Column, limit: int) -> Column:
    """The first ``limit`` items and whether there are more."""
    return F.struct(F.slice(items, 1, limit).alias("items"), (F.size(items) > limit).alias("has_more"))
