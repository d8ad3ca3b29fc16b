"""Sanitised projections of provider items: the closed check, and the evidence envelope of those that pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import REFERENCE_PREFIXES, instant, json_list, json_string, opaque_refs, stable_hash
from siltstone.operators.normalize import QUOTE_FIELDS, envelope_columns
from siltstone.operators.validate import COMMON_KEYS, PROJECTION_KEYS, PROVIDERS, projection_error

#: Fixed value: what no text of a projection may hold.
SECRET = r"(?i)(api[_-]?key|api[_-]?token|authorization|x-finnhub-token|token|secret|password)"


def _free(value: Column) -> Column:
    return F.coalesce((value != "") & ~value.rlike(SECRET), F.lit(False))


def content_error(provider: Column, projection: Column) -> Column:
    """The first thing wrong with a projection (JSON text), null if it may be stored.

    Keys must be exactly the provider's; id, time and the provider's own texts are strings, not empty and free of secrets;
    flags are booleans; a count is a whole number (a boolean counts as 0 or 1) of no more than a quote's fields; the hash is
    64 hex digits and the reference one of ours.  Null, malformed and repeated keys are a mismatch of keys.
    """
    return _parsed(projection, lambda v, keys: _error_of(provider, v, keys))


def _parsed(projection: Column, made: Callable[[Column, Column], Column]) -> Column:
    """``made`` of the parsed text and its keys.  As arguments of lambdas they are computed once for a row; as expressions they would
    be again at each place that reads them, and what is behind them too: a projection was made and parsed some thirty times."""
    bound = lambda value, made: F.get(F.transform(F.array(value), made), F.lit(0))
    return bound(projection, lambda said: bound(F.struct(F.try_parse_json(said).alias("v"), F.json_object_keys(said).alias("keys")), lambda j: made(j["v"], j["keys"])))


def _error_of(provider: Column, v: Column, found: Column) -> Column:
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("VOID"))
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")

    def fits(key: str) -> Column:
        if key.startswith("has_"):
            return kind(key) == "BOOLEAN"
        if key == "numeric_field_count":
            return (kind(key) == "BOOLEAN") | ((kind(key) == "BIGINT") & F.coalesce(F.try_variant_get(v, f"$.{key}", "bigint") <= len(QUOTE_FIELDS), F.lit(False)))
        return (kind(key) == "STRING") & _free(text(key))

    names = F.try_variant_get(v, "$.field_names", "array<string>")
    listed = F.coalesce((F.size(names) == 0) | ((kind("field_names") == "ARRAY<STRING>") & F.forall(names, _free)), F.lit(False))
    hashed = (kind("payload_hash") == "STRING") & F.coalesce(text("payload_hash").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))
    ours = reduce(lambda a, b: a | b, (F.startswith(text("payload_reference"), F.lit(p)) for p in REFERENCE_PREFIXES))
    keys = projection_error(provider, F.when(v.isNotNull(), found))
    own = F.lit(True)
    for name, wanted in PROJECTION_KEYS.items():
        own = F.when(provider == name, reduce(and_, (fits(k) for k in wanted[len(COMMON_KEYS) :]))).otherwise(own)
    return (
        F.when(provider.isNull(), "unknown_provider").when(v.isNull() | found.isNull(), "projection_keys_mismatch").when(keys.isNotNull(), keys)
        .when(~(fits("provider_item_id") & fits("published_at")), "projection_identity_invalid").when(~listed, "field_names_invalid").when(~hashed, "payload_hash_invalid")
        .when(~((kind("payload_reference") == "STRING") & F.coalesce(ours, F.lit(False)) & _free(text("payload_reference"))), "payload_reference_invalid").when(~own, "provider_fields_invalid")
    )


def _object(**fields: Column) -> Column:
    """JSON texts as a JSON object with sorted keys; a null text is the value null."""
    inner = [F.concat(F.lit(f'"{k}":'), F.coalesce(c, F.lit("null"))) for k, c in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}"))


def projection_evidence(rows: DataFrame) -> DataFrame:
    """The evidence of projections that pass ``content_error``: ``rows`` has provider, projection (JSON text), observed_at.

    A projection says which fields an item has, not what they hold, so the item that is hashed holds true, 0 or null in their
    place; equal projections have equal hashes, whenever they were observed.
    """
    fields = {k: "boolean" if k.startswith("has_") else "int" if k == "numeric_field_count" else "string" for wanted in PROJECTION_KEYS.values() for k in (*COMMON_KEYS[:2], *wanted[len(COMMON_KEYS) :])}
    read = lambda v, keys: F.struct(_error_of(F.col("provider"), v, keys).alias("error"), *(F.try_variant_get(v, f"$.{k}", kind).alias(k) for k, kind in fields.items()))
    fit = F.filter(F.array(_parsed(F.col("projection"), read)), lambda r: r["error"].isNull())
    fine = rows.select("provider", "observed_at", F.explode(fit).alias("_p"))
    p = lambda k: F.col(f"_p.{k}")
    # Escaped once for all places that read them.
    strings = [k for k, kind in fields.items() if kind == "string"]
    fine = fine.select("*", F.transform(F.array(*map(p, strings)), json_string).alias("_t"))
    text = lambda k: F.get("_t", F.lit(strings.index(k)))
    flag = lambda k, value: F.when(p(k), F.lit(value))
    at = instant(p("published_at"))
    made = lambda provider, item_type, hashed, **more: (provider, envelope_columns(item_type, item_hash=stable_hash(hashed), observed_at=F.col("observed_at"), event_time=at, **more))

    parts = {"title": "has_title", "description": "has_description", "snippet": "has_snippet", "url": "has_source_url"}
    news = _object(published_at=text("published_at"), uuid=text("provider_item_id"), **{k: flag(f, "true") for k, f in parts.items()})
    count = F.greatest(F.coalesce(p("numeric_field_count"), F.lit(0)), F.lit(0))
    # Fields sort before published_at and t, and in the order in which they are given.
    zeros = F.array_join(F.transform(F.slice(F.array(*(F.lit(f) for f in QUOTE_FIELDS)), F.lit(1), count), lambda f: F.concat(F.lit('"'), f, F.lit('":0,'))), "")
    quote = F.concat(F.lit("{"), zeros, F.lit('"published_at":'), text("published_at"), F.lit(',"t":'), text("published_at"), F.lit("}"))
    energy = _object(published_at=text("published_at"), period=text("published_at"), stateid=text("geography"), sectorid=text("sector"), price=flag("has_numeric_value", "0"))
    filing = _object(published_at=text("published_at"), accessionNumber=text("provider_item_id"), filingDate=text("published_at"), form=text("form"), primaryDocument=flag("has_primary_document", "true"))
    out = [
        made("marketaux", "marketaux_news", news, item_json=text("provider_item_id"), **{f"has_{k}": p(f) for k, f in parts.items()}),
        made("finnhub", "finnhub_quote", quote, item_json=json_list(text("symbol"), text("published_at")), asset_refs=opaque_refs("asset", F.array(p("symbol"))), numeric_field_count=count),
        made("eia", "eia_energy_timeseries", energy, item_json=json_list(text("published_at"), text("geography"), text("sector")), numeric_field_count=p("has_numeric_value").cast("int"),
             entity_refs=opaque_refs("entity", F.array(p("geography"))), topic_refs=opaque_refs("topic", F.array(p("sector")))),
        made("sec_edgar", "sec_filing", filing, item_json=text("provider_item_id"), has_url=p("has_primary_document"), asset_refs=opaque_refs("asset", F.array(p("ticker"))), topic_refs=opaque_refs("topic", F.array(p("form")))),
    ]
    # One scan for all providers: each column is that of the row's provider.
    (*others, (_, last)) = out
    either = lambda name: reduce(lambda rest, o: F.when(F.col("provider") == o[0], o[1][name]).otherwise(rest), reversed(others), last[name])
    return fine.select(*(either(name).alias(name) for name in last))


def raw_mismatch(projections: DataFrame, raw: DataFrame) -> DataFrame:
    """``projections`` (raw_item_id, source_id, source_account_id, provider, and the projection as JSON) with ``mismatch``: what
    differs from the raw row that it was made from, in this order; null where all agrees.  A raw row that is not there differs
    as a whole.  Nulls agree with nulls."""
    said = F.from_json("projection", "provider_item_id string, payload_hash string, payload_reference string")
    r = raw.select(F.col("id").alias("_id"), F.col("source_id").alias("_source"), F.col("source_account_id").alias("_account"), F.col("external_id").alias("_item"), F.col("payload_hash").alias("_hash"), F.col("payload_location").alias("_place"))
    met = projections.withColumn("_p", said).join(r, F.col("raw_item_id") == F.col("_id"), "left")
    pairs = (("source_id", "_source", "source_id"), ("source_account_id", "_account", "source_account_id"), ("_p.provider_item_id", "_item", "external_id"), ("_p.payload_hash", "_hash", "payload_hash"), ("_p.payload_reference", "_place", "payload_location"))
    differs = [F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(name)) for a, b, name in pairs]
    found = F.concat_ws(",", differs[0], differs[1], F.when(~F.coalesce(F.col("provider").isin(*PROVIDERS), F.lit(False)), "provider"), *differs[2:])
    return met.withColumn("mismatch", F.when(F.col("_id").isNull(), "raw_item_id").when(found != "", found)).select(*projections.columns, "mismatch")


def saved(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (raw_item_id, provider, projection, observed_at as text) with ``save_error``: an invalid projection, a time
    without zone, or a raw row that an earlier row (by ``order``) has saved; null for those that are kept, one a raw row."""
    zoned = F.coalesce(F.col("observed_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.lit(False)) & F.expr("try_cast(observed_at as timestamp)").isNotNull()
    error = F.when(content_error(F.col("provider"), F.col("projection")).isNotNull(), "projection_invalid").when(~zoned, "projection_observed_at_invalid")
    judged = rows.withColumn("_error", error)
    place = F.row_number().over(Window.partitionBy("raw_item_id", F.col("_error").isNull()).orderBy(*order))
    return judged.withColumn("save_error", F.coalesce("_error", F.when(place > 1, "projection_already_exists"))).drop("_error")
