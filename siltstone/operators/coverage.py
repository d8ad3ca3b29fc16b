"""Coverage reports: how many rows have a field, of which types, and what a capture may not hold."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import present

#: A name that tells of a secret, followed by a value.
SECRET_PATTERN = r"""(?i)["']?(password|secret|token|api_?key|authorization)["']?\s*[:=]\s*["']?[A-Za-z0-9]"""


def has_value(name: str, kind: str) -> Column:
    """Neither null nor empty; zero and false count."""
    c = F.col(name)
    if kind == "string":
        return present(c)
    return F.coalesce(F.size(c) > 0, F.lit(False)) if kind.startswith(("array", "map")) else c.isNotNull()


def field_coverage(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Per group: items, and for each field how many rows have it, in one aggregation."""
    kinds = dict(df.dtypes)
    return df.groupBy(by).agg(F.count("*").alias("items"), *(F.count_if(has_value(f, kinds[f])).alias(f"has_{f}") for f in fields))


def histogram(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("items"))


def secret_in(text: Column) -> Column:
    return F.coalesce(text.rlike(SECRET_PATTERN), F.lit(False))


def capture_state(text: Column, provider: Column, items: Column, providers: list[str]) -> Column:
    """Fail closed, in this order: secrets, an unknown provider, nothing in it."""
    return F.when(secret_in(text), "secret_detected").when(~provider.isin(*providers), "provider_unknown").when(items <= 0, "capture_empty").otherwise("normalized")


def replay_ready(status: Column, error: Column) -> Column:
    return status.between(200, 299) & error.isNull()


#: By provider, the fields that an item must have, those that make its identity, and those that may tell of
#: entities and times.
REQUIRED = {"marketaux": ("uuid", "title", "url", "published_at"), "finnhub": ("c", "t"), "eia": ("period",), "sec_edgar": ("accessionNumber", "filingDate", "form")}
IDENTITY = {"marketaux": ("uuid",), "finnhub": (), "eia": ("period", "stateid", "sectorid"), "sec_edgar": ("accessionNumber",)}
ENTITY_FIELDS = {"marketaux": ("entities", "source"), "finnhub": ("symbol",), "eia": ("stateid", "sectorid"), "sec_edgar": ("cik", "ticker", "form")}
TIME_FIELDS = {"marketaux": ("published_at",), "finnhub": ("t",), "eia": ("period",), "sec_edgar": ("filingDate", "acceptanceDateTime", "reportDate")}


def replay_summaries(captures: DataFrame, by: str) -> DataFrame:
    """Per capture (``by``, provider, items as JSON texts, context as a map): what a replay would find.

    input_items; missing_required_fields (how many items lack each field that its provider requires: null and empty lack it);
    dedup_key_available_count; entity_fields_available and timestamp_fields_available (sorted; an entity may stand in the
    context); errors; replay_ready.  Everything is counted in one aggregation: no item or set of keys is collected.
    """
    of = lambda table: [(p, f) for p, fields in table.items() for f in fields]
    item = F.col("_item")
    filled = lambda f: F.coalesce(item[f] != "", F.lit(False))
    stands = lambda f: F.coalesce(F.map_contains_key(item, F.lit(f)), F.lit(False))
    known = F.col("provider").isin(*REQUIRED)
    falsy = ("", "0", "0.0", "false", "[]", "{}")
    truth = lambda c: F.coalesce(~c.isin(*falsy), F.lit(False))
    unique = F.lit(False)
    for p, fields in IDENTITY.items():
        whole = truth(F.col("context")["symbol"]) if not fields else reduce(and_, (truth(item[f]) for f in fields))
        unique = F.when(F.col("provider") == p, whole).otherwise(unique)
    rows = captures.select(by, "provider", "context", F.explode_outer("items").alias("_text")).withColumn("_item", F.from_json("_text", "map<string,string>"))
    there = F.col("_text").isNotNull()
    names = sorted({f for table in (ENTITY_FIELDS, TIME_FIELDS) for _, f in of(table)})
    counted = rows.groupBy(by).agg(
        F.first("provider").alias("provider"), F.count_if(there).alias("input_items"), F.count_if(there & unique).alias("dedup_key_available_count"),
        *(F.count_if(there & ~filled(f)).alias(f"_missing_{f}") for f in sorted({f for _, f in of(REQUIRED)})), *(F.coalesce(F.bool_or(stands(f)), F.lit(False)).alias(f"_has_{f}") for f in names),
        F.first("context").alias("context"))
    lists = lambda table, test: F.array_compact(F.array(*(F.when((F.col("provider") == p) & test(f), F.lit(f)) for p, f in sorted(of(table), key=lambda x: x[1]))))
    named = lambda f: F.coalesce(F.map_contains_key(F.col("context"), F.lit(f)), F.lit(False))
    required = F.map_from_entries(F.array_compact(F.array(*(F.when(F.col("provider") == p, F.struct(F.lit(f).alias("field"), F.col(f"_missing_{f}").alias("n"))) for p, f in of(REQUIRED)))))
    errors = F.array_compact(F.array(F.when(~F.coalesce(known, F.lit(False)), "unknown_provider"), F.when(F.col("input_items") == 0, "no_input_items")))
    return counted.select(
        by, "provider", "input_items", required.alias("missing_required_fields"), "dedup_key_available_count", lists(ENTITY_FIELDS, lambda f: F.col(f"_has_{f}") | named(f)).alias("entity_fields_available"),
        lists(TIME_FIELDS, lambda f: F.col(f"_has_{f}")).alias("timestamp_fields_available"), errors.alias("errors"), (F.size(errors) == 0).alias("replay_ready"))


#: Fields whose values are numbers of a quote.
PRICE_FIELDS = ("c", "d", "dp", "h", "l", "o", "pc")


def replay_candidates(captures: DataFrame) -> DataFrame:
    """One row for each item of ``captures`` (capture, provider, items as JSON texts, context as a map): which parts of an
    envelope it could fill, and what kind of source it is.  Null, empty texts and empty lists fill nothing; zero and false do.
    Items of unknown providers are left out."""
    item, provider = F.col("_item"), F.col("provider")
    has = lambda *fields: reduce(or_, (F.coalesce(~item[f].isin("", "[]", "{}"), F.lit(False)) for f in fields))
    told = lambda key: F.coalesce(F.col("context")[key] != "", F.lit(False))
    yes, no = F.lit(True), F.lit(False)
    place, sector = has("stateid", "stateDescription"), has("sectorid", "sectorName")
    quoted, dated = told("symbol") & has("t"), has("period") & place & sector
    by = lambda news, quote, energy, filing: F.when(provider == "marketaux", news).when(provider == "finnhub", quote).when(provider == "eia", energy).otherwise(filing)
    ident = by(has("uuid"), quoted, dated, has("accessionNumber"))
    rows = captures.where(provider.isin(*REQUIRED)).select("capture", "provider", "context", F.explode("items").alias("_text")).withColumn("_item", F.from_json("_text", "map<string,string>"))
    return rows.select(
        "capture", "provider", ident.alias("provider_item_id_available"), by(has("published_at"), has("t"), has("period"), has("acceptanceDateTime", "filingDate", "reportDate")).alias("event_time_available"),
        by(has("source"), yes, yes, yes).alias("source_available"), by(has("entities"), told("symbol"), place | sector, told("ticker")).alias("entity_available"), by(has("entities"), told("symbol"), no, told("ticker")).alias("asset_or_company_available"),
        ident.alias("dedup_key_available"), by(has("title", "snippet", "description"), no, no, no).alias("content_text_available"), by(no, has(*PRICE_FIELDS), has("price", "value"), no).alias("numeric_value_available"),
        provider.isin("eia", "sec_edgar").alias("official_source_flag"), (provider == "finnhub").alias("market_data_flag"), (provider == "sec_edgar").alias("disclosure_flag"), (provider == "marketaux").alias("news_signal_flag"))


def report(summary: DataFrame) -> DataFrame:
    """Each row of a summary as one JSON text (``report``) with sorted keys; nulls are told as null."""
    return summary.select(F.to_json(F.struct(*sorted(summary.columns)), {"ignoreNullFields": "false"}).alias("report"))


#: The counts of an envelope report, and the conditions that they count.
ENVELOPE_COUNTS = {
    "provider_item_id_available_count": "provider_item_id is not null", "event_time_available_count": "event_time is not null", "entity_available_count": "size(entity_refs) > 0 or size(asset_refs) > 0",
    "dedup_key_available_count": "provider_item_id is not null or provider_item_hash is not null", "official_source_count": "official_source_flag", "market_data_count": "market_data_flag", "disclosure_count": "disclosure_flag", "news_signal_count": "news_signal_flag",
}


def envelope_coverage(envelopes: DataFrame, by: str) -> DataFrame:
    """Per group the eight counts of an envelope report, in one aggregation."""
    return envelopes.groupBy(by).agg(*(F.count_if(F.expr(condition)).alias(name) for name, condition in ENVELOPE_COUNTS.items()))


def merged(summaries: DataFrame, *, order: str | None = None) -> DataFrame:
    """Summaries of files as one, in rows (name, key, n): sums by name for ``counts`` (map of numbers), by name and key for
    ``nested`` (map of maps of numbers), and the number of files as ``captures_seen``.  Missing maps count nothing.  With
    ``order``, ``flags`` (map of booleans) are merged too, as 1 or 0: of each the last in that order stays."""
    flat = summaries.select(F.explode("counts").alias("name", "n")).select("name", F.lit(None).cast("string").alias("key"), "n")
    deep = summaries.select(F.explode("nested").alias("name", "inner")).select("name", F.explode("inner").alias("key", "n"))
    sums = flat.union(deep).groupBy("name", "key").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    out = sums.union(summaries.agg(F.lit("captures_seen").alias("name"), F.lit(None).cast("string").alias("key"), F.count("*").alias("n")))
    if order is None:
        return out
    flags = summaries.select(order, F.explode("flags").alias("name", "flag")).where("flag is not null").groupBy("name").agg(F.max_by("flag", order).alias("flag"))
    return out.union(flags.select("name", F.lit(None).cast("string").alias("key"), F.col("flag").cast("long").alias("n")))
