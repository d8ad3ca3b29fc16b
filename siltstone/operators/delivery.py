"""Delivery state: notifications are claimed, sent or failed; state changes are new rows, not updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.dedup import insert_missing

ATTEMPTS, STALE_SECONDS = 3, 300


def dedup_key(provider: Column, content_id: Column) -> Column:
    return F.concat_ws(":", provider, F.lit("telegram"), content_id.cast("string"))


def claim_new(items: DataFrame, stored: DataFrame, *, available: bool = True) -> DataFrame:
    """Notifications for items that have none: SENDING where a channel is available, else PENDING."""
    keyed = items.withColumn("dedup_key", dedup_key(F.col("provider"), F.col("content_id")))
    return insert_missing(keyed, stored, "dedup_key", [F.col("content_id")]).withColumns({"status": F.lit("sending" if available else "pending"), "retry_count": F.lit(0)})


def retryable(now: Column, *, pending: bool = True) -> Column:
    """Notifications that may be tried (again): failed, stuck in sending, and, unless told otherwise, pending."""
    stuck = (F.col("status") == "sending") & (F.col("scheduled_at") < now - F.expr(f"interval {STALE_SECONDS} seconds"))
    states = (F.col("status") == "failed") | stuck
    return (F.col("retry_count") < ATTEMPTS) & ((states | (F.col("status") == "pending")) if pending else states)


def _claimed(now: Column) -> dict[str, Column]:
    return {"retry_count": F.when(F.col("status") == "pending", F.col("retry_count")).otherwise(F.col("retry_count") + 1), "status": F.lit("sending"), "scheduled_at": now, "failure_code": F.lit(None).cast("string")}


def claim_retries(notifications: DataFrame, now: Column, *, limit: int, pending: bool = True) -> DataFrame:
    """The ``limit`` oldest retryable notifications as they are once claimed; a pending one costs no attempt."""
    chosen = notifications.where(retryable(now, pending=pending)).orderBy(F.asc_nulls_last("scheduled_at"), "id").limit(limit)
    return chosen.withColumns(_claimed(now))


def claim_retries_by(notifications: DataFrame, limits: DataFrame, now: Column, *, most: int, pending: bool = True) -> DataFrame:
    """The oldest retryable notifications of each channel and policy, as they are once claimed.

    ``limits`` (channel, policy_rule_id, claims) says how many each may claim; those it does not name claim none, and none
    more than ``most``.  That bound is part of the rank, so each task sends on no more than ``most`` rows of a channel and
    policy, however many wait there.  Rows without time come last, ties go to the lower id.
    """
    waiting = notifications.where(retryable(now, pending=pending))
    place = F.row_number().over(Window.partitionBy("channel", "policy_rule_id").orderBy(F.asc_nulls_last("scheduled_at"), "id"))
    oldest = waiting.withColumn("_place", place).where(F.col("_place") <= most)
    chosen = oldest.join(limits.select("channel", "policy_rule_id", "claims"), ["channel", "policy_rule_id"]).where("_place <= claims").drop("_place", "claims").select(notifications.columns)
    return chosen.withColumns(_claimed(now))


def exhausted(notifications: DataFrame, now: Column) -> DataFrame:
    """How many are out of attempts: any that fail or send, and by the stricter count only those stuck in sending."""
    out = F.col("retry_count") >= ATTEMPTS
    stuck = (F.col("status") == "sending") & (F.col("scheduled_at") < now - F.expr(f"interval {STALE_SECONDS} seconds"))
    return notifications.agg(F.count_if(out & F.col("status").isin("failed", "sending")).alias("exhausted"), F.count_if(out & ((F.col("status") == "failed") | stuck)).alias("exhausted_strict"))


def mark(notifications: DataFrame, results: DataFrame) -> DataFrame:
    """State after a delivery: rows named in ``results`` (id, sent, code) that are sending become sent or failed."""
    met = notifications.join(results.select("id", "sent", "code"), "id", "left")
    hit = F.col("sent").isNotNull() & (F.col("status") == "sending")
    return met.withColumns({"status": F.when(hit & F.col("sent"), "sent").when(hit, "failed").otherwise(F.col("status")), "failure_code": F.when(hit & ~F.col("sent"), F.col("code"))}).drop("sent", "code")


#: Why a message as a whole was not delivered.
TOO_LONG, UNSUPPORTED, LEAKING, REJECTED, FAILED = "telegram_message_too_long", "telegram_provider_unsupported", "telegram_content_unsafe", "telegram_request_rejected", "telegram_delivery_failed"
#: The errors of a transport that are told as they are; any other is a failed delivery.
KNOWN_FAILURES = (REJECTED, "telegram_transport_failed", TOO_LONG, UNSUPPORTED)


def message_decisions(items: DataFrame, by: str, order: str, *, limit: int, message_chars: int = 4096) -> DataFrame:
    """(by, items, error): whether the items of each message can be delivered, all or none.

    ``items`` has provider, block (null for an unknown provider) and unsafe.  A message takes the first ``limit`` of its items
    by ``order``; an unknown provider, a leak or too long a text among them fails it as a whole.  Everything is counted and
    summed: no message is put together here, and no more than ``limit`` rows of one are sent on by a task.
    """
    first = items.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(order, "block"))).where(F.col("_place") <= limit)
    summed = first.groupBy(by).agg(
        F.count("*").alias("items"), F.count_if(F.col("block").isNull()).alias("_unknown"), F.count_if(F.coalesce("unsafe", F.lit(False))).alias("_unsafe"),
        (F.sum(F.char_length(F.coalesce("block", F.lit("")))) + 2 * (F.count("*") - 1)).alias("_chars"))
    error = F.when(F.col("_unknown") > 0, UNSUPPORTED).when(F.col("_unsafe") > 0, LEAKING).when(F.col("_chars") > message_chars, TOO_LONG)
    return summed.select(by, "items", error.alias("error"))


def deliver(items: DataFrame, answers: DataFrame, by: str, order: str, *, limit: int, message_chars: int = 4096) -> DataFrame:
    """Each item of a message (the first ``limit``) with what became of it: sent, failed and the code, the same for all of them.

    ``answers`` (by, http_status, failure) are what a transport said of each message; a message that was not fit to be sent
    has none, and one that was sent and has none was rejected.
    """
    decided = message_decisions(items, by, order, limit=limit, message_chars=message_chars).join(answers.select(by, "http_status", "failure"), by, "left")
    said = F.when(F.col("failure").isin(*KNOWN_FAILURES), F.col("failure")).when(F.col("failure").isNotNull(), FAILED).when(~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)), REJECTED)
    code = F.coalesce("error", said)
    outcome = decided.select(by, code.alias("failure_code"), F.when(code.isNull(), "sent").otherwise("failed").alias("status"))
    first = items.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(order, "block"))).where(F.col("_place") <= limit).drop("_place")
    return first.join(outcome, by)
