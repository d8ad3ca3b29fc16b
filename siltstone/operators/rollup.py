"""Candidates rolled up from their active links: counts, unions of sets, time spans, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scoring import confidence, importance, importance_reasons
from siltstone.operators.tables import TASK_ROWS, dealt, once, written


#: What a link gives its candidate, by kind.
_KINDS = {"evidence": "evidence_id", "source": "source_id", "entity": "entity", "official": "official"}
#: So many parts hold the values of a candidate that has more links than one task takes.
_PARTS = 64


def _by_value(links: DataFrame, by: str, weight: Column) -> DataFrame:
    """(by, part, kind, value, n): the sum of ``weight`` over the active links that give ``by`` a value; a null value stands for
    links that give none, so that no ``by`` is lost.

    Links go through one exchange by candidate, as they are, and become values behind it.  A candidate with more links than
    ``TASK_ROWS`` is dealt out by its values instead, into parts; a value is in one part.
    """
    on = lambda c: F.when(F.col("active"), F.col(c)).alias(c)
    official = F.when(F.col("active") & F.col("official"), F.lit(True)).alias("official")
    table = once(links, "links")
    rows = table.select(by, on("evidence_id"), on("source_id"), on("entity"), official, weight.alias("n"))
    hot = rows.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > TASK_ROWS).select(F.col(by).alias("_hot"))
    met = rows.join(F.broadcast(hot), F.col(by) == F.col("_hot"), "left")
    whole = F.lit(-1)
    split = met.select("*", F.explode(F.when(F.col("_hot").isNull(), F.array(whole)).otherwise(F.array(*map(F.lit, range(len(_KINDS)))))).alias("_k"))
    split = split.select(by, *(F.when(F.col("_k").isin(-1, i), F.col(c)).alias(c) for i, c in enumerate(_KINDS.values())), "n", "_k")
    split = split.withColumn("part", F.when(F.col("_k") == whole, 0).otherwise(F.pmod(F.xxhash64(*_KINDS.values()), F.lit(_PARTS))).cast("int")).drop("_k")
    values = F.map_from_arrays(F.array(*map(F.lit, _KINDS)), F.array(*(F.col(c).cast("string") for c in _KINDS.values())))
    out = dealt(split, by, "part", rows=table).select(by, "part", "n", F.explode(values).alias("kind", "value")).where("value is not null or kind = 'evidence'")
    return out.groupBy(by, "part", "kind", "value").agg(F.sum("n").alias("n"))


def active_counts(links: DataFrame, *, by: str = "candidate_id") -> DataFrame:
    """evidence_count, source_count, official and entity_count of every candidate, also of those without active links.

    ``links`` has candidate_id, evidence_id, source_id, official, entity (or null) and active.
    """
    of = lambda kind: F.count_if((F.col("kind") == kind) & F.col("value").isNotNull()).alias(kind)
    parts = _by_value(links, by, F.lit(1)).groupBy(by, "part").agg(*map(of, _KINDS))
    return parts.groupBy(by).agg(F.sum("evidence").alias("evidence_count"), F.sum("source").alias("source_count"), (F.sum("official") > 0).alias("official"), F.sum("entity").alias("entity_count"))


def candidate_status(rolled: DataFrame) -> DataFrame:
    """A candidate without evidence is rejected, and comes back with evidence."""
    return rolled.withColumn("status", F.when(F.col("evidence_count") == 0, "rejected").otherwise("candidate"))


def scored(rolled: DataFrame) -> DataFrame:
    args = [F.col(c) for c in ("evidence_count", "official", "source_count", "entity_count")] + [F.lit(None)]
    return rolled.withColumns({
        "importance_score": importance(*args), "importance_reasons": F.array_join(importance_reasons(*args), ";"),
        "confidence": F.round(confidence(F.col("evidence_count"), F.col("official"), F.col("source_count")), 4)})


def accumulated(rows: DataFrame, by: str, sets: list[str], at: str) -> DataFrame:
    """Sorted unions of array columns, and the first and latest time; these never shrink.

    Values are made distinct as rows, so of a hot key only its different values come together, never its rows.
    """
    times = rows.groupBy(by).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("latest_seen_at"))
    values = rows.select(by, F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in sets)), F.array(*sets))).alias("_set", "_values")).select(by, "_set", F.explode("_values").alias("_value")).distinct()
    unions = values.groupBy(by).agg(*(F.array_sort(F.collect_list(F.when(F.col("_set") == c, F.col("_value")))).alias(c) for c in sets))
    empty = F.array().cast("array<string>")
    return times.join(unions, by, "left").select(by, *(F.coalesce(c, empty).alias(c) for c in sets), "first_seen_at", "latest_seen_at")


def sticky_first(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The first value that is not null; later ones don't replace it."""
    return rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.min_by(value, order).alias(value))


def deactivate_errors(links: DataFrame, which: DataFrame) -> DataFrame:
    """``which`` (candidate_id, evidence_id) with ``close_error``: there is no active link to close, or more than one."""
    held = links.where("active").groupBy("candidate_id", "evidence_id").agg(F.count("*").alias("_n"))
    met = which.join(held, ["candidate_id", "evidence_id"], "left")
    error = F.when(F.col("_n").isNull(), "event_candidate_evidence_not_found").when(F.col("_n") > 1, "event_candidate_association_ambiguous")
    return met.select(*which.columns, error.alias("close_error"))


def deactivate(links: DataFrame, which: DataFrame, at: Column | None = None) -> DataFrame:
    """Links with those in ``which`` (candidate_id, evidence_id) closed; evidence itself stays.  With ``at``, links that are
    closed now get it as ``removed_at``; those closed before keep theirs."""
    marks = which.select("candidate_id", "evidence_id", F.lit(True).alias("_off")).distinct()
    met = links.join(marks, ["candidate_id", "evidence_id"], "left")
    closing = F.col("active") & F.col("_off").isNotNull()
    columns = links.columns if at is None or "removed_at" in links.columns else [*links.columns, "removed_at"]
    if at is not None:
        met = met.withColumn("removed_at", F.when(closing, at).otherwise(F.col("removed_at") if "removed_at" in links.columns else F.lit(None)))
    return met.withColumn("active", F.col("active") & ~closing).select(columns)


# --- roll-ups kept up to date ---------------------------------------------------------------------------------------


def multiplicities(links: DataFrame) -> DataFrame:
    """(candidate_id, kind, value, n): how many active links give a candidate each of its values.

    ``kind`` is evidence, source, entity or official.  This is the state that roll-ups are kept by: a link adds one to each of
    its values and takes one away when it is closed, and a value counts while its n is above zero.
    """
    return _by_value(links, "candidate_id", F.lit(1)).where("value is not null").select("candidate_id", "kind", "value", "n")


def link_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(candidate_id, kind, value, n): what changed, from the links that a change touched as they were and as they are."""
    columns = ["candidate_id", *_KINDS.values(), "active"]
    both = before.select(*columns, F.lit(-1).alias("_sign")).unionByName(after.select(*columns, F.lit(1).alias("_sign")))
    return _by_value(both, "candidate_id", F.col("_sign")).where("value is not null and n <> 0").select("candidate_id", "kind", "value", "n")


def with_deltas(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """The state after ``deltas``: sums by value, so that a hot candidate is dealt out by its values."""
    return state.unionByName(deltas).groupBy("candidate_id", "kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def counts_of(state: DataFrame) -> DataFrame:
    """``active_counts`` from the state: values are rows, so they are counted, never collected.  Candidates without active
    links are not among them."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return state.where("n > 0").groupBy("candidate_id").agg(of("evidence").alias("evidence_count"), of("source").alias("source_count"), (of("official") > 0).alias("official"), of("entity").alias("entity_count"))


def refreshed(counts: DataFrame, state: DataFrame, deltas: DataFrame) -> DataFrame:
    """``counts`` brought up to date: only the candidates in ``deltas`` are counted anew, from the state after them; those
    that have no active link any more, and those that are new, are among them."""
    touched = deltas.select("candidate_id").distinct()
    now = touched.join(counts_of(state.join(touched, "candidate_id", "left_semi")), "candidate_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    now = now.select("candidate_id", zero("evidence_count"), zero("source_count"), F.coalesce("official", F.lit(False)).alias("official"), zero("entity_count"))
    return counts.join(touched, "candidate_id", "left_anti").select(now.columns).unionByName(now)


def kept_up(counts: DataFrame, state: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, state) after ``deltas``, as written tables: what one change leaves is what the next one starts from, and no
    plan carries the changes before it.

    The state is dealt out once; a value that begins or ceases to count moves the counts by one, so no candidate is counted
    anew.  All candidates in ``deltas`` are among the counts.
    """
    none = F.lit(0).cast("long")
    told = state.select("candidate_id", "kind", "value", F.col("n").alias("before"), none.alias("delta"))
    told = told.unionByName(written(deltas, "deltas").select("candidate_id", "kind", "value", none.alias("before"), F.col("n").alias("delta")))
    moved = dealt(told, "candidate_id", "kind", "value").groupBy("candidate_id", "kind", "value").agg(F.sum("before").alias("before"), F.sum("delta").alias("delta"))
    moved = written(moved.withColumn("n", F.col("before") + F.col("delta")), "multiplicities")
    step = (F.col("n") > 0).cast("int") - (F.col("before") > 0).cast("int")
    steps = moved.where("delta <> 0").groupBy("candidate_id").agg(*(F.sum(F.when(F.col("kind") == k, step).otherwise(0)).alias(f"_{k}") for k in _KINDS))
    met = counts.join(steps, "candidate_id", "full")
    count = lambda k: (F.coalesce(f"{k}_count", none) + F.coalesce(f"_{k}", none)).alias(f"{k}_count")
    official = F.when(F.col("_official") > 0, True).when(F.col("_official") < 0, False).otherwise(F.coalesce("official", F.lit(False))).alias("official")
    return written(met.select("candidate_id", count("evidence"), count("source"), official, count("entity")), "counts"), moved.where("n <> 0").select("candidate_id", "kind", "value", "n")


def regroup_errors(links: DataFrame, moves: DataFrame, candidates: DataFrame) -> DataFrame:
    """``moves`` with ``move_error``: the target is the same or missing, the evidence is unknown, or its one active link is
    not with the candidate that it is to leave."""
    held = links.groupBy("evidence_id").agg(F.count_if("active").alias("_n"), F.min(F.when(F.col("active"), F.col("candidate_id"))).alias("_held"))
    known = candidates.select(F.col("id").alias("_to"))
    met = moves.join(held, "evidence_id", "left").join(known, F.col("to_id") == F.col("_to"), "left")
    error = (
        F.when(F.col("from_id") == F.col("to_id"), "event_candidate_regroup_target_unchanged").when(F.col("_n").isNull(), "evidence_item_not_found")
        .when((F.col("_n") != 1) | (F.col("_held") != F.col("from_id")), "event_candidate_association_ambiguous").when(F.col("_to").isNull(), "event_candidate_not_found")
    )
    return met.select(*moves.columns, error.alias("move_error"))


def regroup(links: DataFrame, moves: DataFrame, at: Column | None = None) -> DataFrame:
    """Links after ``moves`` (evidence_id, from_id, to_id): old links are closed and keep the rule they were made by, new ones
    are added by review, so history stays.  Links without ``match_rule`` get it, null for old ones; with ``at``, closed links
    get it as ``removed_at``, and new ones none."""
    if "match_rule" not in links.columns:
        links = links.withColumn("match_rule", F.lit(None).cast("string"))
    marks = moves.select("evidence_id", F.col("from_id").alias("candidate_id"), "to_id")
    closed = deactivate(links, marks, at)
    added = links.where("active").join(marks, ["evidence_id", "candidate_id"]).withColumns({"candidate_id": F.col("to_id"), "match_rule": F.lit("reviewed_regroup")})
    if at is not None:
        added = added.withColumn("removed_at", F.lit(None).cast(closed.schema["removed_at"].dataType))
    return closed.unionByName(added.select(closed.columns))
