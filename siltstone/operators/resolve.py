"""Entity resolution: evidence is matched against event candidates by ranked identities; joins replace comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scoring import confidence, importance, importance_reasons
from siltstone.functions.text import canonical_url, present, stable_hash, title_fingerprint
from siltstone.operators.running import running
from siltstone.operators.tables import written

DAY_MICROS = 86_400_000_000
#: Rules by rank.
RULES = {1: "official_identity", 2: "canonical_url", 3: "provider_external_id", 4: "entity_title_time", 5: "approved_hash"}

#: Rows of a class and day that meet as many of the other side in one task.
_BLOCK = 4096


def seen_at() -> Column:
    return F.coalesce("event_time", "observed_at")


def with_signatures(evidence: DataFrame) -> DataFrame:
    """Adds url, signatures (strongest first), title_fingerprint and strong_identity_hash."""
    own = F.concat_ws(":", "provider", "provider_item_id")
    named = lambda kind, value: F.concat(F.lit(kind + ":"), stable_hash(value))
    df = evidence.withColumns({"url": canonical_url(F.col("canonical_url")), "title_fingerprint": title_fingerprint(F.col("title"))})
    signatures = F.array_compact(F.array(
        F.when(F.col("official_source") & present(F.col("provider_item_id")), named("official", own)), F.when(F.col("url").isNotNull(), named("url", F.col("url"))),
        F.when(present(F.col("provider_item_id")), named("provider", own)), named("hash", F.concat_ws(":", "provider", "provider_item_hash"))))
    df = df.withColumn("signatures", signatures)
    return df.withColumn("strong_identity_hash", F.when(F.get("signatures", F.lit(0)).startswith("official:"), F.substring_index(F.get("signatures", F.lit(0)), ":", -1)))


def python_list(values: Column) -> Column:
    """A list of texts as ``['a', 'b']``: the form that anchors hash."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))


def with_anchor(df: DataFrame, ambiguous: Column | None = None) -> DataFrame:
    """Adds anchor_type, anchor_value_hash and cluster_key: what a new candidate of this evidence is called."""
    best = F.get("signatures", F.lit(0))
    bucket = F.floor(F.unix_micros(seen_at().cast("timestamp")) / F.lit(DAY_MICROS)).cast("string")
    titled = best.startswith("hash:") & (F.size("entity_refs") > 0) & F.col("title_fingerprint").isNotNull()
    amb = ambiguous if ambiguous is not None else F.lit(False)
    kind = F.when(amb, "ambiguous_evidence").when(titled, "entity_title_time").otherwise(F.substring_index(best, ":", 1))
    value = F.when(amb, stable_hash(F.col("evidence_id").cast("string"))).when(titled, stable_hash(F.concat_ws(":", python_list(F.array_sort("entity_refs")), "title_fingerprint", bucket))).otherwise(F.substring_index(best, ":", -1))
    return df.withColumns({"anchor_type": kind, "anchor_value_hash": value}).withColumn("cluster_key", stable_hash(F.concat_ws(":", "anchor_type", "anchor_value_hash")))


def rank_of(signature: Column) -> Column:
    kind = F.substring_index(signature, ":", 1)
    return F.when(kind == "official", 1).when(kind == "url", 2).when(kind == "provider", 3).otherwise(5)


def signature_matches(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """(evidence_id, candidate_id, rank) by shared signatures: an equi join on exploded signatures.

    A match needs one candidate and whether there are others, so of the candidates of a signature the least and the greatest
    stand for all: no signature turns into pairs, however many share it.
    """
    e = evidence.select("evidence_id", F.explode("signatures").alias("signature"))
    c = candidates.select(F.col("id").alias("candidate_id"), F.explode(F.array_distinct("identity_signatures")).alias("signature"))
    c = c.groupBy("signature").agg(F.min("candidate_id").alias("a"), F.max("candidate_id").alias("b"))
    c = c.select("signature", F.explode(F.array_distinct(F.array("a", "b"))).alias("candidate_id"))
    return e.join(c, "signature").select("evidence_id", "candidate_id", rank_of(F.col("signature")).alias("rank"))


def _windowed(evidence: DataFrame, candidates: DataFrame, hours: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Looks (evidence_id, at, class), spans (candidate_id, class, begin, end) and classes (class, fingerprint, entities).

    A class is a title with a set of entities.  Each candidate is in one class of each of its titles, and an evidence looks
    into every class of its title that shares an entity with it, once.  So classes never count a candidate twice, however many
    entities it shares, and candidates of equal entities are one class.
    """
    gap = F.expr(f"interval {hours} hours")
    spans = candidates.select(F.col("id").alias("candidate_id"), (F.col("first_seen_at") - gap).alias("begin"), (F.col("latest_seen_at") + gap).alias("end"), F.array_sort(F.array_distinct("entities")).alias("entities"), F.explode(F.array_distinct("title_fingerprints")).alias("fingerprint"))
    spans = spans.where("begin <= end and fingerprint is not null").withColumn("class", F.sha2(F.to_json(F.struct("fingerprint", "entities")), 256))
    classes = spans.groupBy("class").agg(F.first("fingerprint").alias("fingerprint"), F.first("entities").alias("entities"))
    e = evidence.where("title_fingerprint is not null").select("evidence_id", F.col("title_fingerprint").alias("fingerprint"), seen_at().alias("at"), F.explode(F.array_distinct("entity_refs")).alias("entity"))
    looks = e.join(classes.select("class", "fingerprint", F.explode("entities").alias("entity")), ["fingerprint", "entity"]).select("evidence_id", "at", "class").distinct()
    return looks, spans.select("candidate_id", "class", F.col("begin").cast(looks.schema["at"].dataType).alias("begin"), F.col("end").cast(looks.schema["at"].dataType).alias("end")), classes


def time_window_counts(evidence: DataFrame, candidates: DataFrame, *, hours: int = 24) -> DataFrame:
    """(evidence_id, matches): of how many candidates the title is the same, an entity is shared, and the time is within
    ``hours`` of the span, both ends included.  Evidence without any is left out.

    Spans open and close along the time of their class: how many are open at a time is a running sum of +1 and -1, summed per
    moment first.  Days are buckets, so a class is dealt out by days; rows grow with evidence and spans, not with matches.
    Nulls match nothing; rows of equal evidence_id count as one.
    """
    looks, spans, _ = _windowed(evidence, candidates, hours)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    turns = spans.select("class", micros("begin").alias("ord"), F.lit(1).alias("step")).union(spans.select("class", micros("end") + 1, F.lit(-1)))
    turns = turns.groupBy("class", "ord").agg(F.sum("step").alias("step"))
    none = F.lit(None).cast(looks.schema["evidence_id"].dataType)
    lines = turns.select("class", "ord", "step", F.lit(0).alias("kind"), none.alias("evidence_id")).union(looks.select("class", micros("at").alias("ord"), F.lit(None).cast("long"), F.lit(1), "evidence_id"))
    open_now = running(lines.where("ord is not null").withColumn("bucket", F.floor(F.col("ord") / DAY_MICROS)), ["class"], "bucket", ["ord", "kind"], {"open": ("sum", "step")})
    return open_now.where("kind = 1").groupBy("evidence_id").agg(F.sum("open").alias("matches")).where("matches > 0")


def _repeated(df: DataFrame, name: str) -> DataFrame:
    """Values of ``name`` that several rows have."""
    return df.groupBy(name).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(name).alias("_id"))


def _met(looks: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of rows of one class whose time lies in the span.  Of a class and day with many rows both sides are cut into
    slices, each of which meets each: a task compares about ``_BLOCK`` x ``_BLOCK`` rows, however large a class is, and rows are
    repeated once for so many that they meet."""
    day, on = F.expr("interval 1 day"), ["class", "day"]
    looks = looks.withColumn("day", F.date_trunc("day", "at"))
    days = spans.withColumn("day", F.explode(F.sequence(F.date_trunc("day", "begin"), F.date_trunc("day", "end"), day)))
    sizes = looks.groupBy(*on).agg(F.count("*").alias("i")).join(days.groupBy(*on).agg(F.count("*").alias("j")), on)
    sizes = written(sizes, "sizes")
    compared = sizes.agg(F.sum(F.col("i").cast("double") * F.col("j"))).first()[0] or 0
    tasks = max(looks.sparkSession.sparkContext.defaultParallelism, int(compared // _BLOCK**2) + 1)
    large = F.broadcast(sizes.where(f"i > {_BLOCK} or j > {_BLOCK}").select(*on, *(F.ceil(F.col(x) / _BLOCK).cast("int").alias(f"_{x}") for x in "ij")))

    def sliced(df: DataFrame, own: str, other: str, *row: str) -> DataFrame:
        count = lambda x: F.coalesce(F.col(f"_{x}"), F.lit(1))
        df = df.join(large, on, "left").withColumns({own: F.pmod(F.xxhash64(*row), count(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), count(other) - 1))})
        return df.drop("_i", "_j").repartition(tasks, *on, "i", "j")

    pairs = sliced(looks, "i", "j", "evidence_id", "at").join(sliced(days, "j", "i", "candidate_id", "begin", "end"), [*on, "i", "j"])
    return pairs.where(F.col("at").between(F.col("begin"), F.col("end"))).select("evidence_id", "candidate_id", F.lit(4).alias("rank"))


def time_window_pairs(evidence: DataFrame, candidates: DataFrame, *, hours: int = 24) -> DataFrame:
    """(evidence_id, candidate_id, rank) of all matches by title, entity and time: as many rows as there are matches, so ask
    ``time_window_counts`` first.  Evidence and spans meet by class and day, so a large class is dealt out by days.

    Evidence has one title and one day, and a candidate one class of a title: a pair of rows meets once, and pairs are not
    shuffled.  Only pairs of ids that several rows have are made distinct.
    """
    e = written(evidence.where("title_fingerprint is not null").select("evidence_id", "title_fingerprint", "event_time", "observed_at", "entity_refs"), "evidence")
    c = written(candidates.select("id", "first_seen_at", "latest_seen_at", "entities", "title_fingerprints"), "candidates")
    looks, spans, _ = _windowed(e, c, hours)
    looks, spans = written(looks, "looks"), written(spans, "spans")
    many_e, many_c = written(_repeated(e, "evidence_id"), "repeated"), written(_repeated(c, "id"), "repeated")
    if many_e.isEmpty() and many_c.isEmpty():
        return _met(looks, spans)
    parts = lambda df, ids, name: [df.join(ids, F.col(name).eqNullSafe(F.col("_id")), how) for how in ("left_anti", "left_semi")]
    (one_e, more_e), (one_c, more_c) = parts(looks, many_e, "evidence_id"), parts(spans, many_c, "candidate_id")
    return _met(one_e, one_c).union(_met(more_e, spans).union(_met(one_e, more_c)).distinct())


def time_window_matches(evidence: DataFrame, candidates: DataFrame, *, hours: int = 24) -> DataFrame:
    """(evidence_id, candidate_id, rank): of the matches of ``time_window_pairs`` the least and the greatest candidate.

    Two are enough to tell a unique match from several, and they grow with evidence and spans, not with their product.  The
    candidates that cover a whole day are two ids; those whose span begins in a day are running ids up to the time of the
    evidence, and those whose span ends there the same from the other side; hours are buckets.
    """
    looks, spans, _ = _windowed(evidence, candidates, hours)
    looks, spans = written(looks, "looks"), written(spans, "spans")
    day = F.expr("interval 1 day")
    days = spans.withColumn("day", F.explode(F.sequence(F.date_trunc("day", "begin"), F.date_trunc("day", "end"), day)))
    begins, stops = F.col("begin") > F.col("day"), F.col("end") < F.col("day") + day
    on = ["class", "day"]
    e = looks.withColumn("day", F.date_trunc("day", "at"))
    ends = lambda df, *by: df.groupBy(*by).agg(F.min("candidate_id").alias("a"), F.max("candidate_id").alias("b"))
    found = e.join(ends(days.where(~begins & ~stops), *on), on).select("evidence_id", "a", "b")
    inner = e.join(ends(days.where(begins & stops), *on, "begin", "end"), on).where(F.col("at").between(F.col("begin"), F.col("end")))
    found = found.union(inner.select("evidence_id", "a", "b"))
    for edge, which, sign in (("begin", begins & ~stops, 1), ("end", ~begins & stops, -1)):
        at = lambda c: (sign * F.unix_micros(F.col(c).cast("timestamp"))).alias("ord")  # noqa: B023, E731
        lines = ends(days.where(which), *on, edge).select(*on, at(edge), F.lit(0).alias("kind"), F.lit(None).cast(e.schema["evidence_id"].dataType).alias("evidence_id"), "a", "b")
        lines = lines.union(e.select(*on, at("at"), F.lit(1), "evidence_id", F.lit(None).cast(lines.schema["a"].dataType), F.lit(None).cast(lines.schema["b"].dataType)))
        seen = running(lines.withColumn("bucket", F.floor(F.col("ord") / (DAY_MICROS // 24))), on, "bucket", ["ord", "kind"], {"lo": ("min", "a"), "hi": ("max", "b")})
        found = found.union(seen.where("kind = 1 and lo is not null").select("evidence_id", "lo", "hi"))
    met = found.groupBy("evidence_id").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return met.select("evidence_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("candidate_id"), F.lit(4).alias("rank"))


def match(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per evidence: evidence_id, candidate_id, match_rule and the anchor.

    The best rank decides: one candidate at it is the match, several make the evidence ambiguous, none makes it new.
    ``evidence`` has signatures; REJECTED candidates match like any other.
    """
    # Both sides are read several times: as tables they are made once, and the plan stays small.
    evidence, candidates = written(evidence, "evidence"), written(candidates, "candidates")
    hits = signature_matches(evidence, candidates).union(time_window_matches(evidence, candidates))
    best = hits.groupBy("evidence_id", "candidate_id").agg(F.min("rank").alias("rank"))
    # Per evidence: the least rank, how many candidates have it, and one of them; partial aggregates of (rank, count).
    counted = best.groupBy("evidence_id", "rank").agg(F.count("*").alias("n"), F.min("candidate_id").alias("candidate_id"))
    first = counted.groupBy("evidence_id").agg(F.min_by(F.struct("rank", "n", "candidate_id"), "rank").alias("b"))
    met = evidence.join(first, "evidence_id", "left").withColumns({"_n": F.col("b.n"), "_rank": F.col("b.rank")})
    rule = F.when(F.col("_n").isNull(), "new_candidate").when(F.col("_n") > 1, "ambiguous_new_candidate")
    for rank, name in RULES.items():
        rule = rule.when(F.col("_rank") == rank, name)
    met = met.withColumns({"match_rule": rule, "matched_candidate_id": F.when(F.col("_n") == 1, F.col("b.candidate_id"))})
    return with_anchor(met, F.coalesce(F.col("_n") > 1, F.lit(False))).drop("b", "_n", "_rank")


def new_candidates(matched: DataFrame) -> DataFrame:
    """Candidates to create: one for each cluster_key of unmatched evidence, from its first row by time and id.  Title and
    summary are left to review; ``asset_refs``, ``topic_refs`` and ``source_priority`` count where the rows have them."""
    rows = matched.where("matched_candidate_id is null")
    place = F.row_number().over(Window.partitionBy("cluster_key").orderBy(seen_at(), "evidence_id"))
    none, texts = F.lit(None), F.array().cast("array<string>")
    either = lambda c: F.col(c) if c in rows.columns else texts
    priority = F.col("source_priority") if "source_priority" in rows.columns else none
    args = [F.lit(1), F.col("official_source"), F.lit(1), F.size("entity_refs"), priority]
    return rows.withColumn("_place", place).where("_place = 1").select(
        "cluster_key", "anchor_type", "anchor_value_hash", "strong_identity_hash", F.col("signatures").alias("identity_signatures"), F.array_compact(F.array("title_fingerprint")).alias("title_fingerprints"),
        F.lit("information_event").alias("event_type"), F.lit("candidate").alias("status"), none.cast("string").alias("canonical_title"), none.cast("string").alias("fact_summary"), seen_at().alias("first_seen_at"), seen_at().alias("latest_seen_at"),
        F.col("event_time").alias("occurred_at"), F.col("event_time").alias("published_at"), F.get("entity_refs", F.lit(0)).alias("primary_entity"), F.col("entity_refs").alias("entities"), F.col("entity_refs").alias("companies"),
        either("asset_refs").alias("assets"), texts.alias("sectors"), either("topic_refs").alias("topics"), F.lit(1).alias("evidence_count"), F.lit(1).alias("source_count"),
        confidence(F.lit(1), F.col("official_source"), F.lit(1)).alias("confidence"), importance(*args).alias("importance_score"), importance_reasons(*args).alias("importance_reasons"))


def unprocessed(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Evidence without an active link: processing again returns the link it has."""
    return evidence.join(links.where("active").select("evidence_id"), "evidence_id", "left_anti")


def link_problems(links: DataFrame) -> DataFrame:
    """Evidence with more than one active link."""
    return links.where("active").groupBy("evidence_id").agg(F.count_distinct("candidate_id").alias("n")).where("n > 1")
