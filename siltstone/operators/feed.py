"""Feeds: the newest visible items, and the message that shows them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a provider's items are called.
LABELS = {"marketaux": "News", "finnhub": "Market data", "eia": "Official energy data", "sec_edgar": "Company filing"}
MESSAGE_LIMIT = 4096
#: Providers in the order in which they are asked, shown and reported.
PROVIDER_ORDER = ("marketaux", "finnhub", "eia", "sec_edgar")


def in_provider_order(rows: DataFrame, provider: str = "provider") -> DataFrame:
    """Adds ``provider_place``, by a join with the four rows of the order; a provider that is none of them comes last, with a
    null place, and stays."""
    order = rows.sparkSession.createDataFrame(list(enumerate(PROVIDER_ORDER)), f"provider_place int, {provider} string")
    return rows.join(F.broadcast(order), provider, "left").select(*rows.columns, "provider_place")


def visible() -> Column:
    return F.col("title").isNotNull() & F.col("canonical_url").isNotNull() & F.col("source_published_at").isNotNull()


def recent(content: DataFrame, sources: DataFrame, evidence: DataFrame, *, limit: int, methods: list[str] | None = None) -> DataFrame:
    """The newest visible items with their source and any evidence; an item with several evidence rows shows several times."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1 to 50")
    src = sources.select(F.col("id").alias("source_id"), "access_method")
    src = src.where(F.col("access_method").isin(*methods)) if methods else src
    ev = evidence.select("raw_item_id", F.col("id").alias("evidence_id"), "processing_status")
    rows = content.where(visible()).join(src, "source_id").join(ev, "raw_item_id", "left")
    return rows.orderBy(F.desc("source_published_at"), F.desc("id"), F.desc_nulls_last("evidence_id")).limit(limit).select("id", "title", "canonical_url", "source_id", "access_method", "source_published_at", "evidence_id", "processing_status")


def for_run(content: DataFrame, raw: DataFrame, sources: DataFrame, evidence: DataFrame, run_id, *, limit: int = 5) -> DataFrame:
    """The newest visible items of one run."""
    mine = raw.where(F.col("run_id") == run_id).select(F.col("id").alias("raw_item_id"))
    return recent(content.join(mine, "raw_item_id"), sources, evidence, limit=limit)


def by_ids(content: DataFrame, sources: DataFrame, ids: DataFrame) -> DataFrame:
    """Items in the order of the given ids (pos, id)."""
    src = sources.select(F.col("id").alias("source_id"), "access_method")
    return content.join(ids, "id").join(src, "source_id").orderBy("pos").select("pos", "id", "title", "source_id", "access_method")


def block(provider: Column, title: Column, source: Column, at: Column, url: Column) -> Column:
    """The lines that show one item; null for an unknown provider."""
    label = reduce(lambda c, kv: c.when(provider == kv[0], F.lit(kv[1])), list(LABELS.items())[1:], F.when(provider == "marketaux", F.lit("News")))
    return F.when(label.isNotNull(), F.concat_ws("\n", F.concat(label, F.lit(": "), title), F.concat(F.lit("Source: "), source), F.concat(F.lit("Time: "), at), url))


def messages(items: DataFrame, by: str, order: str) -> DataFrame:
    """One message for each group of items (``block``), in order, and what is wrong with it."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("block").alias("b"))))
    out = items.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["b"]), "\n\n").alias("message"), F.count("*").alias("items"))
    return out.withColumn("message_error", F.when(F.col("items") == 0, "feed_empty").when(F.char_length("message") > MESSAGE_LIMIT, "message_too_long"))
