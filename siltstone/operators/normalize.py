"""Provider payloads as rows, and rows as the one common evidence envelope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import canonical_json, first_instant, instant, json_list, json_string, opaque_json, opaque_refs, present, stable_hash
from siltstone.operators.validate import ENVELOPE_VERSION, FLAGS, by_item_type

NEWS = "data array<struct<uuid:string,title:string,url:string,snippet:string,description:string,published_at:string,source:string,entities:array<string>,keywords:array<string>,language:string>>"
ENERGY = "response struct<data:array<struct<period:string,price:variant,value:variant,stateid:string,stateDescription:string,sectorid:string,sectorName:string>>>"
FILING_FIELDS = ("accessionNumber", "filingDate", "acceptanceDateTime", "reportDate", "form", "primaryDocument")
FILINGS = "filings struct<recent:struct<" + ",".join(f"{f}:array<string>" for f in FILING_FIELDS) + ">>"
QUOTE_FIELDS = ("c", "d", "dp", "h", "l", "o", "pc")


def news_rows(df: DataFrame, body: str = "body") -> DataFrame:
    """One row for each element of ``data``."""
    return df.select("*", F.from_json(body, NEWS).alias("_b")).select(*df.columns, F.inline("_b.data"))


def energy_rows(df: DataFrame, body: str = "body") -> DataFrame:
    """One row for each period; place and sector from the code, or where that is missing or empty from the name."""
    rows = df.select("*", F.from_json(body, ENERGY).alias("_b")).select(*df.columns, F.inline("_b.response.data"))
    either = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))
    rows = rows.withColumns({"geography": either("stateid", "stateDescription"), "sector": either("sectorid", "sectorName")})
    complete = present(F.col("period")) & F.col("geography").isNotNull() & F.col("sector").isNotNull()
    return rows.withColumn("item_id", F.when(complete, F.concat_ws(":", "period", "geography", "sector")))


def _is_number(value: Column) -> Column:
    """1 for a JSON number, 0 for strings, booleans, null and what is missing."""
    return F.coalesce(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|TINYINT|SMALLINT)"), F.lit(False)).cast("int")


def quote_rows(df: DataFrame, body: str = "body") -> DataFrame:
    """The one quote of a response, with the numbers counted; strings and booleans don't count, and without a number it is no
    quote."""
    v = F.try_parse_json(body)
    number = lambda f: _is_number(F.try_variant_get(v, f"$.{f}", "variant"))
    rows = df.select("*", F.try_variant_get(v, "$.t", "bigint").alias("t"), reduce(lambda a, b: a + b, map(number, QUOTE_FIELDS)).alias("numeric_field_count"))
    whole = present(F.col("symbol")) & F.col("t").isNotNull() & (F.col("numeric_field_count") > 0)
    return rows.withColumn("item_id", F.when(whole, F.concat_ws(":", "symbol", F.col("t").cast("string"))))


def filing_rows(df: DataFrame, body: str = "body", *, padded: bool = False) -> DataFrame:
    """Rows of the struct of arrays: as many as the shortest array has, or padded with nulls to the longest."""
    parsed = df.select("*", F.from_json(body, FILINGS)["filings"]["recent"].alias("_r"))
    arrays = [F.coalesce(F.col(f"_r.{f}"), F.array().cast("array<string>")).alias(f) for f in FILING_FIELDS]
    return zipped(parsed.select(*df.columns, *arrays), FILING_FIELDS, padded=padded)


def zipped(df: DataFrame, names, *, padded: bool = False) -> DataFrame:
    """Arrays of the given names side by side as rows, cut to the shortest or padded to the longest."""
    rows = F.arrays_zip(*(F.col(n) for n in names))
    if not padded:
        rows = F.slice(rows, F.lit(1), F.least(*(F.size(n) for n in names)))
    return df.select(*(c for c in df.columns if c not in names), F.inline(rows))


def response_shape(df: DataFrame, body: str = "body", *, item_path: str | None = None, columnar: bool = False) -> DataFrame:
    """Adds the sorted top-level keys of each JSON body, as one text; with ``item_path`` (as ``$.a.b``) also item_keys, the
    sorted keys of the first item, and item_count.

    Items are a list, or one object: that is one item, or with ``columnar`` as many as its longest list has; its keys are then
    the item's.  A first element that is no object has no keys; where there are no items at the path the count is null.
    """
    sorted_keys = lambda c: F.array_join(F.array_sort(F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))), ",")
    df = df.withColumn("top_level_keys", sorted_keys(F.col(body)))
    if item_path is None:
        return df
    items = F.try_variant_get(F.try_parse_json(body), item_path, "variant")
    kind, said = F.schema_of_variant(items), F.to_json(items)
    listed, single = kind.startswith("ARRAY<"), kind.startswith("OBJECT<")
    columns = F.map_values(F.from_json(said, "map<string,string>"))
    longest = F.coalesce(F.array_max(F.transform(columns, lambda c: F.json_array_length(c))), F.lit(0))
    one = longest if columnar else F.when(F.size(F.json_object_keys(said)) > 0, 1).otherwise(0)
    return df.withColumns({
        "item_keys": sorted_keys(F.when(listed, F.get_json_object(said, "$[0]")).when(single, said)),
        "item_count": F.when(listed, F.json_array_length(said)).when(single, one)})


def envelope_columns(item_type: str, *, item_json: Column, event_time: Column, item_hash: Column, observed_at: Column, **more: Column) -> dict[str, Column]:
    """The common envelope of one item type by name; ``item_json`` is the provider's id as JSON, and rows without it are blocked
    and say so.  The columns are those of ``schemas.TABLES["evidence_items"]``, without the references of stored rows."""
    no_refs = F.array().cast("array<string>")
    false = F.lit(False)
    missing = item_json.isNull()
    error = F.struct(F.lit("provider_item_id_missing").alias("code"), F.lit("provider_item_id").alias("field"), F.lit("Provider item ID is unavailable.").alias("safe_message"))
    kind = F.lit(item_type)
    provider = by_item_type(kind, 1)
    numbers = more.get("numeric_field_count", F.lit(0))
    return {
        "evidence_version": F.lit(ENVELOPE_VERSION), "provider": provider, "provider_item_type": kind, "evidence_kind": by_item_type(kind, 2), "source_type": by_item_type(kind, 3),
        "provider_item_id": F.when(~missing, opaque_json("provider-item", item_json)), "provider_item_hash": item_hash, "observed_at": observed_at, "event_time": event_time,
        "access_level": F.lit("link_only"), "processing_status": F.when(missing, "blocked").otherwise("validated"),
        **{f: by_item_type(kind, 4 + i) for i, f in enumerate(FLAGS)},
        "content_presence": F.struct(*(more.get(c, false).alias(c) for c in ("has_title", "has_body", "has_url", "has_snippet", "has_description"))),
        "numeric_presence": F.struct((numbers > 0).alias("has_numeric_value"), numbers.alias("numeric_field_count"), F.lit(item_type == "eia_energy_timeseries").alias("nullable_allowed")),
        **{c: more.get(c, no_refs) for c in ("entity_refs", "asset_refs", "topic_refs")},
        "raw_payload_reference": F.concat(F.lit("internal://evidence/"), provider, F.lit("/"), item_hash),
        "errors": F.when(missing, F.array(error)).otherwise(F.array().cast("array<struct<code:string,field:string,safe_message:string>>")),
    }


def envelope(df: DataFrame, item_type: str, **parts: Column) -> DataFrame:
    """Rows with ``envelope_columns`` in place of their own."""
    return df.select(*(c.alias(name) for name, c in envelope_columns(item_type, **parts).items()))


def _hash_of(df: DataFrame) -> Column:
    """Of the whole item where rows have its canonical text, as ``payloads.item_texts`` gives it, else of the columns."""
    if "item_text" in df.columns:
        return stable_hash(F.col("item_text"))
    return stable_hash(canonical_json(F.to_json(F.struct(*(F.col(c) for c in df.columns)))))


def _named(value: Column) -> Column:
    return F.when(present(value), json_string(value))


def news_evidence(rows: DataFrame, observed_at: Column) -> DataFrame:
    return envelope(rows, "marketaux_news", item_json=_named(F.col("uuid")), event_time=instant(F.col("published_at")), item_hash=_hash_of(rows), observed_at=observed_at, entity_refs=opaque_refs("entity", F.col("entities")), topic_refs=opaque_refs("topic", F.col("keywords")), **{f"has_{c}": present(F.col(c)) for c in ("title", "url", "snippet", "description")})


def quote_evidence(rows: DataFrame, observed_at: Column) -> DataFrame:
    return envelope(rows, "finnhub_quote", item_json=F.when(F.col("item_id").isNotNull(), json_list(json_string(F.col("symbol")), F.col("t").cast("string"))), event_time=F.timestamp_seconds("t"), item_hash=_hash_of(rows), observed_at=observed_at, asset_refs=opaque_refs("asset", F.array("symbol")), numeric_field_count=F.col("numeric_field_count"))


def energy_evidence(rows: DataFrame, observed_at: Column) -> DataFrame:
    numbers = _is_number(F.col("price")) + _is_number(F.col("value"))
    item = F.when(F.col("item_id").isNotNull(), json_list(*(json_string(F.col(c)) for c in ("period", "geography", "sector"))))
    return envelope(rows, "eia_energy_timeseries", item_json=item, event_time=instant(F.col("period")), item_hash=_hash_of(rows), observed_at=observed_at, entity_refs=opaque_refs("entity", F.array("stateid", "stateDescription")), topic_refs=opaque_refs("topic", F.array("sectorid", "sectorName")), numeric_field_count=numbers)


def filing_evidence(rows: DataFrame, observed_at: Column) -> DataFrame:
    return envelope(rows, "sec_filing", item_json=_named(F.col("accessionNumber")), event_time=first_instant(F.col("acceptanceDateTime"), F.col("filingDate"), F.col("reportDate")), item_hash=_hash_of(rows), observed_at=observed_at, has_url=present(F.col("primaryDocument")), asset_refs=opaque_refs("asset", F.array("ticker")), topic_refs=opaque_refs("topic", F.array("form")))


def display_title(provider: Column, *, symbol: Column, period: Column, place: Column, form: Column, title: Column) -> Column:
    """What a reader sees of an item."""
    return F.when(provider == "finnhub", F.concat(symbol, F.lit(" quote"))).when(provider == "eia", F.concat_ws(" ", F.lit("Energy data"), place, period)).when(provider == "sec_edgar", F.concat_ws(" ", form, F.lit("filing"), symbol)).otherwise(title)


def content_kind(provider: Column) -> Column:
    return F.when(provider == "marketaux", "news").when(provider == "sec_edgar", "filing").when(provider == "finnhub", "market_data").otherwise("official_data")


def bound_sidecar(raw: DataFrame, pending: DataFrame) -> DataFrame:
    """Raw rows with the pending metadata of the same (external_id, payload_hash, payload_location), nulls equal; of pending
    rows that repeat a key the one with the greatest ``seq`` counts."""
    keys = ["external_id", "payload_hash", "payload_location"]
    rest = [c for c in pending.columns if c not in keys and c != "seq"]
    last = pending.groupBy(*keys).agg(*(F.max_by(c, "seq").alias(c) for c in rest))
    last = last.select(*(F.col(k).alias(f"_{k}") for k in keys), *rest)
    return raw.join(last, reduce(lambda a, b: a & b, (raw[k].eqNullSafe(last[f"_{k}"]) for k in keys)), "left").drop(*(f"_{k}" for k in keys))
