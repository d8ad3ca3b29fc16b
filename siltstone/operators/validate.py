"""Validation: each rule gives an error code, a row's codes come as one array in the order of the rules."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import has_secret_mark, present, safe_identifier, safe_public_url, squeeze, unsafe_reference

#: Item type, provider, evidence kind, source type, and the flags official, market data, disclosure, news.
ITEM_TYPES = (
    ("marketaux_news", "marketaux", "news", "news", False, False, False, True),
    ("finnhub_quote", "finnhub", "market_data", "market_data", False, True, False, False),
    ("eia_energy_timeseries", "eia", "energy_official", "official_energy", True, False, False, False),
    ("sec_filing", "sec_edgar", "disclosure", "disclosure", True, False, True, False),
)
PROVIDERS = tuple(t[1] for t in ITEM_TYPES)
FLAGS = ("official_source_flag", "market_data_flag", "disclosure_flag", "news_signal_flag")
ACCESS_LEVELS = ("public_fulltext", "public_summary", "subscription_required", "licensed", "link_only", "blocked", "unknown")
PROCESSING = ("pending", "validated", "blocked", "invalid")
#: The keys of a provider's sanitised projection; the first five are common.
COMMON_KEYS = ("provider_item_id", "published_at", "field_names", "payload_hash", "payload_reference")
PROJECTION_KEYS = {
    "marketaux": COMMON_KEYS + ("has_title", "has_description", "has_snippet", "has_source_url"),
    "finnhub": COMMON_KEYS + ("symbol", "numeric_field_count"),
    "eia": COMMON_KEYS + ("geography", "sector", "has_numeric_value"),
    "sec_edgar": COMMON_KEYS + ("ticker", "form", "has_primary_document"),
}
#: Errors that a later try may not meet.
RETRYABLE = ("COLLECTION_TIMEOUT", "COLLECTION_NETWORK", "COLLECTION_RATE_LIMITED", "COLLECTION_UPSTREAM_5XX", "COLLECTION_UPSTREAM_RETRYABLE", "COLLECTION_DATABASE_UNAVAILABLE", "COLLECTION_LOCK_LOST")
ENVELOPE_VERSION = 1


def codes(*rules: tuple[Column, str]) -> Column:
    """The codes whose condition holds; a null condition does not."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(code)) for cond, code in rules)))


def by_item_type(item_type: Column, place: int) -> Column:
    """A column of ITEM_TYPES for a row's item type; null for unknown types."""
    return reduce(lambda c, t: c.when(item_type == t[0], F.lit(t[place])), ITEM_TYPES[1:], F.when(item_type == ITEM_TYPES[0][0], F.lit(ITEM_TYPES[0][place])))


def not_in(value: Column, allowed) -> Column:
    return value.isNull() | ~value.isin(*allowed)


def flags_consistent() -> Column:
    """Whether the four flags are those of the item type."""
    return reduce(and_, (F.col(f).eqNullSafe(by_item_type(F.col("provider_item_type"), 4 + i)) for i, f in enumerate(FLAGS)))


#: The messages that an embedded error may carry.
SAFE_ERROR_MESSAGES = (
    "Access level must be explicitly classified.", "Event time is unavailable; no value was inferred.", "Evidence contract value is unknown.", "Evidence flags do not match the provider item type.",
    "Evidence kind does not match the provider item type.", "Evidence version is not supported.", "Numeric field count cannot be negative.", "Provider does not match the provider item type.",
    "Provider item hash is missing or invalid.", "Provider item ID is unavailable.", "Raw payload reference is unsafe.", "Source type does not match the provider item type.",
    "The embedded error is not content-safe.", "This evidence type must allow nullable numeric values.",
)


def embedded_errors_safe(errors: Column) -> Column:
    """Whether all errors have a plain code, no field or a plain one, and a message that says nothing of the content."""
    plain = lambda c: F.coalesce(c.rlike(r"^[a-z][a-z0-9_]*\z"), F.lit(False))
    ok = lambda e: plain(e["code"]) & (e["field"].isNull() | plain(e["field"])) & F.coalesce(e["safe_message"].isin(*SAFE_ERROR_MESSAGES), F.lit(False))
    return F.coalesce(F.forall(errors, ok), F.lit(True))


def envelope_errors() -> Column:
    """Codes for a row of the evidence envelope."""
    kind = F.col("provider_item_type")
    known = kind.isin(*(t[0] for t in ITEM_TYPES))
    differs = lambda name, place: known & ~F.col(name).eqNullSafe(by_item_type(kind, place))
    return codes(
        (~F.col("evidence_version").eqNullSafe(F.lit(ENVELOPE_VERSION)), "unsupported_evidence_version"),
        (not_in(F.col("provider"), PROVIDERS), "unknown_provider"),
        (not_in(kind, [t[0] for t in ITEM_TYPES]), "unknown_provider_item_type"),
        (not_in(F.col("evidence_kind"), [t[2] for t in ITEM_TYPES]), "unknown_evidence_kind"),
        (not_in(F.col("source_type"), [t[3] for t in ITEM_TYPES]), "unknown_source_type"),
        (not_in(F.col("access_level"), ACCESS_LEVELS), "unknown_access_level"),
        (not_in(F.col("processing_status"), PROCESSING), "unknown_processing_status"),
        (differs("provider", 1), "provider_item_type_mismatch"),
        (differs("evidence_kind", 2), "evidence_kind_mismatch"),
        (differs("source_type", 3), "source_type_mismatch"),
        (known & ~flags_consistent(), "evidence_flags_mismatch"),
        ((kind == "eia_energy_timeseries") & ~F.coalesce(F.col("numeric_presence.nullable_allowed"), F.lit(False)), "eia_numeric_nullable_required"),
        (F.col("access_level") == "unknown", "access_level_unknown"),
        (~F.coalesce(F.col("provider_item_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "provider_item_hash_invalid"),
        (F.col("event_time").isNull(), "event_time_missing"),
        (F.col("numeric_presence.numeric_field_count") < 0, "numeric_field_count_invalid"),
        (unsafe_reference(F.col("raw_payload_reference")), "unsafe_raw_payload_reference"),
        (~embedded_errors_safe(F.col("errors")), "unsafe_embedded_error"),
    )


def projection_error(provider: Column, keys: Column) -> Column:
    """closed-set check of a projection's keys: null if they are exactly those of the provider."""
    out = F.lit("unknown_provider")
    for name, wanted in PROJECTION_KEYS.items():
        allowed = F.array(*(F.lit(k) for k in wanted))
        same = (F.size(F.array_except(keys, allowed)) == 0) & (F.size(F.array_except(allowed, keys)) == 0)
        out = F.when(provider == name, F.when(~same, F.lit("projection_keys_mismatch"))).otherwise(out)
    return out


#: The keys that a display row must have, those it may have, and the bounds of a row and of a news request.
DISPLAY_REQUIRED = ("provider_item_id", "published_at")
DISPLAY_KEYS = (*DISPLAY_REQUIRED, "display_title", "display_url")
TITLE_CHARS, URL_CHARS, NEWS_RECORDS, NEWS_SYMBOLS = 2000, 4000, 3, 10
#: A secret's name, and one with a value.
_SECRET_NAME = r"(?i)(api[_-]?key|api[_-]?token|authorization|x-finnhub-token|token|secret|password)"
_SECRET_VALUE = _SECRET_NAME + "="


def _secret(value: Column) -> Column:
    return F.coalesce(value.rlike(_SECRET_VALUE), F.lit(False))


def display_error(item_id: Column, published_at: Column, title: Column, url: Column, keys: Column | None = None) -> Column:
    """What makes a row unfit for display: its ``keys`` are a closed set, id and time are required, title and address may be
    missing, but not unsafe."""
    array = lambda names: F.array(*(F.lit(k) for k in names))
    closed = F.lit(True) if keys is None else F.coalesce((F.size(F.array_except(array(DISPLAY_REQUIRED), keys)) == 0) & (F.size(F.array_except(keys, array(DISPLAY_KEYS))) == 0), F.lit(False))
    return (
        F.when(~closed, "display_keys_invalid").when(~present(item_id), "provider_item_id_required").when(~present(published_at), "published_at_required")
        .when(title.isNotNull() & ((title == "") | (F.char_length(title) > TITLE_CHARS) | _secret(title)), "title_unsafe")
        .when(url.isNotNull() & ((F.char_length(url) > URL_CHARS) | _secret(url) | safe_public_url(url).isNull()), "url_unsafe")
    )


def request_error(limit: Column, deadline: Column, now: Column, config: Column, known: tuple[str, ...], timeout: Column, language: Column, symbols: Column) -> Column:
    """The first thing wrong with a news request; ``config`` is a map of texts, ``known`` the keys it may have."""
    keys = F.map_keys(config)
    unsafe = F.exists(F.map_entries(config), lambda e: F.coalesce(has_secret_mark(e["key"]) | has_secret_mark(e["value"]), F.lit(False)))
    odd = lambda s: s.isNull() | (s == "") | has_secret_mark(s)
    return (
        F.when(~F.coalesce(limit.between(1, NEWS_RECORDS), F.lit(False)), "provider_record_limit_invalid").when(F.coalesce(deadline <= now, F.lit(True)), "provider_deadline_invalid")
        .when(F.size(F.array_except(keys, F.array(*(F.lit(k) for k in known)))) > 0, "provider_config_fields_invalid").when(unsafe, "provider_config_unsafe")
        .when(F.coalesce(timeout, F.lit(10.0)) <= 0, "provider_timeout_invalid").when(language.isNotNull() & odd(language), "provider_language_invalid")
        .when(symbols.isNotNull() & ((F.size(symbols) == 0) | (F.size(symbols) > NEWS_SYMBOLS) | F.exists(symbols, odd)), "provider_symbols_invalid")
    )


def news_item(df: DataFrame) -> DataFrame:
    """Sanitised news items: id and time required and free of secrets; a title or address that is unsafe or too long is left
    out, and flags say what is left.  ``field_names`` are the keys of the item (column ``keys``, where the rows have it), sorted,
    without those that name a secret."""
    free = lambda c: F.when(present(F.col(c)) & ~F.col(c).rlike(_SECRET_NAME), F.col(c))
    item, when = free("uuid"), free("published_at")
    title, url = squeeze(F.col("title")), safe_public_url(F.col("url"))
    title = F.when(present(title) & (F.char_length(title) <= TITLE_CHARS) & ~_secret(title), title)
    url = F.when((F.char_length(url) <= URL_CHARS) & ~_secret(url), url)
    keys = F.col("keys") if "keys" in df.columns else F.lit(None).cast("array<string>")
    names = F.array_sort(F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: ~k.rlike(_SECRET_NAME)))
    return df.select(
        item.alias("provider_item_id"), when.alias("published_at"), title.alias("title"), url.alias("url"), names.alias("field_names"), title.isNotNull().alias("has_title"), present(F.col("description")).alias("has_description"),
        present(F.col("snippet")).alias("has_snippet"), url.isNotNull().alias("has_url"), (item.isNotNull() & when.isNotNull()).alias("is_valid"))


def smoke_result(status: Column, valid_json: Column, count: Column, fields: Column, required: Column) -> Column:
    """BLOCKED, FAIL or PASS of a first request to a provider."""
    no_required = (F.size(required) > 0) & ~F.arrays_overlap(fields, required)
    return (
        F.when(status.isNull() | status.isin(401, 402, 403, 429) | (status >= 500), "BLOCKED").when(~status.between(200, 299) | ~valid_json, "FAIL")
        .when(F.coalesce(count, F.lit(0)) <= 0, "FAIL").when(F.size(fields) <= 0, "FAIL").when(no_required, "FAIL").otherwise("PASS")
    )


def http_error(status: Column) -> Column:
    """Error code of an HTTP status, null if it is fine."""
    return F.when(status == 429, "COLLECTION_RATE_LIMITED").when(status >= 500, "COLLECTION_UPSTREAM_5XX").when(~status.between(200, 299), "COLLECTION_UPSTREAM_PERMANENT")


#: What a provider's error is called in a run; an upstream error depends on whether a retry may help.
PROVIDER_ERRORS = {"provider_config_invalid": "COLLECTION_CONFIG_INVALID", "provider_contract_invalid": "COLLECTION_CONTRACT_INVALID", "provider_rate_limited": "COLLECTION_RATE_LIMITED", "provider_timeout": "COLLECTION_TIMEOUT"}


def collection_error(code: Column, may_retry: Column, *, cancelled: Column | None = None, past_deadline: Column | None = None) -> Column:
    """The run's error for a provider's error: null for none, COLLECTION_UNKNOWN for one that is not declared.  A cancelled run
    and one past its deadline are told so, whatever the provider said."""
    said = F.when(code == "provider_upstream_error", F.when(F.coalesce(may_retry, F.lit(False)), "COLLECTION_UPSTREAM_RETRYABLE").otherwise("COLLECTION_CONTRACT_INVALID"))
    for own, run in PROVIDER_ERRORS.items():
        said = said.when(code == own, run)
    said = said.when(code.isNotNull(), "COLLECTION_UNKNOWN")
    no = F.lit(False)
    return F.when(F.coalesce(cancelled, no) if cancelled is not None else no, "COLLECTION_CANCELLED").when(F.coalesce(past_deadline, no) if past_deadline is not None else no, "COLLECTION_TIMEOUT").otherwise(said)


def retryable(code: Column) -> Column:
    return F.coalesce(code.isin(*RETRYABLE), F.lit(False))


#: The greatest limit of a captured request by provider; of its response, marketaux may hold 15 items at most.
CAPTURE_LIMITS = {"marketaux": 3, "finnhub": 1, "eia": 5, "sec_edgar": 10}


def capture_within_limit(provider: Column, limit: Column, count: Column) -> Column:
    """Whether a capture asked for, and holds, no more items than its provider allows; false where either is unknown."""
    ok = reduce(or_, ((provider == p) & limit.between(1, n) & (count <= limit) for p, n in CAPTURE_LIMITS.items()))
    return F.coalesce(ok, F.lit(False))


def result_counts_match(raw: Column, metadata: Column, display: Column) -> Column:
    """Whether optional side arrays have one element for each raw row."""
    n = F.size(raw)
    return (metadata.isNull() | (F.size(metadata) == n)) & (display.isNull() | (F.size(display) == n))


def request_leaks(params: Column) -> Column:
    """Whether a request's parameters carry a secret by name or value."""
    return F.exists(F.map_entries(params), lambda e: has_secret_mark(e["key"]) | has_secret_mark(e["value"]))
