"""Which sources are due, which runs are stale, and what is wrong with a target; loops over sources become joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.timing import dispatch_key, is_due, name_uuid, slot

#: States in which a source may be read.
READABLE = ("authorized", "implemented")


def eligible(methods: list[str] | None = None) -> Column:
    out = F.col("enabled") & F.col("authorization_status").isin(*READABLE)
    return out & F.col("access_method").isin(*methods) if methods else out


def due_targets(sources: DataFrame, accounts: DataFrame, runs: DataFrame, now: Column, *, limit: int = 1000) -> DataFrame:
    """Targets to collect now: (source_id, account_id, scheduled_slot, dispatch_key, task_id).

    The first ``limit`` eligible sources by id that are due; each enabled account of them, or the source itself if it has no
    accounts at all; none that is running.
    """
    able = sources.where(eligible() & F.col("schedule_seconds").isNotNull()).orderBy("id").limit(limit)
    latest = runs.groupBy("source_id").agg(F.max("started_at").alias("latest_run_at"))
    met = able.join(latest, able.id == latest.source_id, "left").drop("source_id")
    due = met.where(is_due(now, F.col("last_success_at"), F.col("latest_run_at"), F.col("schedule_seconds"), F.col("consecutive_failures")))
    due = due.select(F.col("id").alias("source_id"), "schedule_seconds")
    mine = accounts.select(F.col("source_id").alias("_s"), F.col("id").alias("account_id"), F.col("enabled").alias("_on"))
    fanned = due.join(mine, due.source_id == mine._s, "left").where("_s is null or _on").drop("_s", "_on")
    running = runs.where("status = 'running'").select(F.col("source_id").alias("_s"), F.col("source_account_id").alias("_a")).distinct()
    idle = fanned.join(running, (fanned.source_id == running._s) & fanned.account_id.eqNullSafe(running._a), "left_anti")
    at = slot(now, F.col("schedule_seconds"))
    out = idle.select("source_id", "account_id", at.alias("scheduled_slot"), dispatch_key(F.col("source_id"), F.col("account_id"), at).alias("dispatch_key"))
    return out.withColumn("task_id", F.concat(F.lit("collection-"), name_uuid(F.col("dispatch_key"))))


def stale_runs(runs: DataFrame, now: Column, *, seconds: int = 900, claims: DataFrame | None = None) -> DataFrame:
    """Runs that have been running for longer than ``seconds`` and that no live claim protects."""
    old = runs.where((F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"interval {seconds} seconds")))
    return old if claims is None else old.join(claims.select("id"), "id", "left_anti")


def target_errors(targets: DataFrame, sources: DataFrame, accounts: DataFrame, methods: list[str]) -> DataFrame:
    """Adds ``target_error`` to targets (source_id, account_id, access_method): the first reason why one can't run."""
    s = sources.select(F.col("id").alias("_s"), F.col("enabled").alias("_on"), F.col("access_method").alias("_m"), F.col("authorization_status").alias("_auth"))
    a = accounts.select(F.col("id").alias("_a"), F.col("source_id").alias("_as"), F.col("enabled").alias("_aon"))
    any_account = accounts.select(F.col("source_id").alias("_h")).distinct()
    met = targets.join(s, targets.source_id == s._s, "left").join(a, targets.account_id == a._a, "left").join(any_account, targets.source_id == any_account._h, "left")
    bad_source = F.col("_s").isNull() | ~F.col("_on") | (F.col("_m") != F.col("access_method")) | ~F.col("_auth").isin(*READABLE)
    bad_account = F.col("account_id").isNotNull() & (F.col("_a").isNull() | (F.col("_as") != F.col("source_id")) | ~F.col("_aon"))
    error = (
        F.when(~F.col("access_method").isin(*methods), "method_not_registered").when(bad_source, "source_not_authorized").when(bad_account, "account_missing_mismatched_or_disabled")
        .when(F.col("account_id").isNull() & F.col("_h").isNotNull(), "source_level_forbidden")
    )
    return met.withColumn("target_error", error).select(*targets.columns, "target_error")


def diagnose(methods: DataFrame, sources: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per access method: source_count, account_count, eligible_target_count and why there isn't exactly one target."""
    s = sources.withColumn("_ok", eligible()).groupBy("access_method").agg(F.count("*").alias("source_count"), F.count_if("enabled").alias("_enabled"), F.count_if("_ok").alias("_able"))
    owned = accounts.select(F.col("source_id").alias("_s"), F.col("enabled").alias("_on")).join(sources.select("id", "access_method", eligible().alias("_ok")), F.col("_s") == F.col("id"))
    a = owned.groupBy("access_method").agg(F.count("*").alias("account_count"), F.count_if(F.col("_on") & F.col("_ok")).alias("eligible_target_count"))
    met = methods.join(s, "access_method", "left").join(a, "access_method", "left").na.fill(0)
    error = (
        F.when(F.col("eligible_target_count") > 1, "target_not_unique").when(F.col("eligible_target_count") == 1, F.lit(None)).when(F.col("source_count") == 0, "source_missing")
        .when(F.col("_enabled") == 0, "source_disabled").when(F.col("_able") == 0, "source_unauthorized").otherwise("account_missing")
    )
    return met.select("access_method", "source_count", "account_count", "eligible_target_count", error.alias("target_error"))


def bootstrap(diagnosis: DataFrame) -> DataFrame:
    """What to create so that a method gets its target: nothing where one exists, nothing where a decision is needed."""
    action = F.when(F.col("eligible_target_count") == 1, "already_exists").when(F.col("target_error") == "source_missing", "create_source_and_account").when(F.col("target_error") == "account_missing", "create_account").otherwise("blocked")
    return diagnosis.withColumn("action", action)


def retry_outcome(code: Column, attempt: Column, most: int = 3) -> Column:
    from siltstone.operators.validate import retryable

    return F.when(retryable(code) & (attempt < most), "retry").otherwise("failed")


def run_outcome(fetched: Column, failed: Column) -> Column:
    """How a run ends: an error after some rows is partial."""
    return F.when(~failed, "succeeded").when(fetched > 0, "partial").otherwise("failed")


def provider_outcome(processed: Column, raw: Column, evidence: Column, collection: Column, errors: Column) -> Column:
    """(status, no_new_items) of one provider's run: PASS needs raw rows and evidence, or a collection that succeeded and had
    nothing new; ``errors`` are the codes that were met."""
    clean = F.coalesce(processed, F.lit(False)) & (F.size(F.coalesce(errors, F.array().cast("array<string>"))) == 0)
    quiet = F.coalesce(clean & (raw == 0) & (collection == "succeeded"), F.lit(False))
    ok = F.coalesce(clean & (quiet | ((raw > 0) & (evidence > 0))), F.lit(False))
    return F.struct(F.when(ok, "PASS").otherwise("FAIL").alias("status"), quiet.alias("no_new_items"))


def cycle_status(statuses: DataFrame, by: str = "cycle") -> DataFrame:
    """PARTIAL if any provider failed, was blocked or must retry, or if delivery failed or was blocked."""
    bad = F.bool_or(F.col("status").isin("FAILED", "BLOCKED", "RETRY") | F.col("delivery").isin("BLOCKED", "FAILED"))
    return statuses.groupBy(by).agg(F.when(F.coalesce(bad, F.lit(False)), "PARTIAL").otherwise("PASS").alias("cycle_status"), F.count("*").alias("providers"))


def error_list(errors: Column, run_error: Column) -> Column:
    """The errors of an outcome and of its run, in lower case, each once and in the order of their first place."""
    last = F.when(run_error.isNotNull(), F.array(F.lower(run_error))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.coalesce(errors, F.array().cast("array<string>")), last))
