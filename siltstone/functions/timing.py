"""Time arithmetic of schedules, retries and dispatch, as Column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(value: Column) -> Column:
    """Whole seconds since 1970, rounded down also before it."""
    return F.floor(F.unix_micros(value.cast("timestamp")) / F.lit(1_000_000)).cast("long")


def next_due(last_success: Column, last_run: Column, schedule_seconds: Column, failures: Column) -> Column:
    """When a source is due again: after its schedule, doubled for each failure up to sixteen-fold."""
    wait = schedule_seconds * F.least(F.pow(F.lit(2.0), failures), F.lit(16.0)).cast("long")
    return F.timestamp_seconds(seconds(F.greatest(last_success.cast("timestamp"), last_run.cast("timestamp"))) + wait)


def is_due(now: Column, last_success: Column, last_run: Column, schedule_seconds: Column, failures: Column) -> Column:
    """Never run: due.  No schedule: not due."""
    due = next_due(last_success, last_run, schedule_seconds, failures)
    return schedule_seconds.isNotNull() & (F.greatest(last_success, last_run).isNull() | F.coalesce(now.cast("timestamp") >= due, F.lit(False)))


def slot(now: Column, schedule_seconds: Column) -> Column:
    return F.floor(seconds(now) / schedule_seconds).cast("long")


def dispatch_key(source: Column, account: Column, at_slot: Column) -> Column:
    return F.concat_ws(":", source, F.coalesce(account, F.lit("source")), at_slot.cast("string"))


def name_uuid(key: Column) -> Column:
    """Version 5 UUID of a key in the URL namespace, from SHA-1 and the version and variant bits."""
    h = F.sha1(F.concat(F.lit(uuid.NAMESPACE_URL.bytes), key.cast("binary")))
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def retry_ceiling(retry_after: Column, retry_count: Column, *, base: float = 5.0, longest: float = 300.0, longest_after: float = 900.0) -> Column:
    """The longest delay before a retry: what the server asked for, within bounds, or base doubled for each retry."""
    after = F.when(retry_after.isNotNull(), F.least(F.greatest(retry_after, F.lit(0.0)), F.lit(longest_after)))
    return F.coalesce(after, F.least(F.lit(longest), F.lit(base) * F.pow(F.lit(2.0), retry_count)))


def jittered(ceiling: Column, asked: Column, seed: int = 0) -> Column:
    """The delay itself: exact where the server asked for it, else anything up to the ceiling."""
    return F.when(asked.isNotNull(), ceiling).otherwise(F.rand(seed) * ceiling)


def retry_after_header(headers: Column) -> Column:
    """Seconds from a Retry-After header of any case: a number in 0..3600, else null."""
    named = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == "retry-after")
    value = F.trim(F.get(named, F.lit(0))["value"]).try_cast("double")
    return F.when(value.between(0, 3600), value)


def cadence_delay(value: Column, longest: int) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(1), F.least(F.ceil(value), F.lit(longest)))).cast("long")


def marker_seconds(delay: Column, deadline: Column, stale: Column) -> Column:
    """How long a retry marker must live."""
    return F.greatest(delay + deadline, stale)
