"""Clusters by the order-dependent process: each evidence joins the one best candidate so far, or opens its own.

Rows are not taken one by one.  A guess of all clusters is tested at once: what every row would decide, given the clusters that
the guess gives to the rows before it, follows from running least and greatest clusters of its keys.  Where the decisions are
the guess, the guess is the outcome of the process, as the first row depends on nothing, and each row only on earlier ones.
Otherwise the decisions make the next guess: a row that joins points to an earlier row of its cluster, and pointers are
followed to their ends.  The first row that was wrong is right in the next round, with all before it.

A round is a fixed number of joins and groups over written tables.  No cluster, signature or title is in one task: hot keys are
split into buckets of consecutive rows.  The first guess lets every row join, so that only rows that turn out ambiguous, and
what follows from them, take more rounds: as many as ambiguities follow from each other, in the worst case one for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.resolve import DAY_MICROS, RULES, rank_of, seen_at, with_anchor
from siltstone.operators.running import running
from siltstone.operators.tables import dispose, written

#: Rows whose places differ in these low bits only are one bucket of a hot key.
BUCKET_BITS = 16
HOUR_MICROS = DAY_MICROS // 24


def _day(at: Column) -> Column:
    return F.floor(at / DAY_MICROS)


def _ordered(evidence: DataFrame) -> DataFrame:
    """Rows with their place in the order of time and id, and the keys of the clusters that they may open."""
    none = F.lit(None).cast("string")
    rows = with_anchor(evidence.select("evidence_id", "signatures", "entity_refs", "title_fingerprint", "event_time", "observed_at"))
    rows = with_anchor(rows.withColumn("own_key", F.col("cluster_key")), F.lit(True)).withColumnRenamed("cluster_key", "lone_key")
    rows = rows.select("evidence_id", "own_key", "lone_key", F.unix_micros(seen_at().cast("timestamp")).alias("at"), F.array_distinct("signatures").alias("signatures"), F.coalesce("title_fingerprint", none).alias("title"), F.array_distinct("entity_refs").alias("entities"))
    # Sorted by ranges: partitions follow each other, and so do the ids that they give out.
    return written(rows.orderBy("at", "evidence_id").withColumn("mid", F.monotonically_increasing_id()), "fold-rows")


def _asked(rows: DataFrame) -> DataFrame:
    """(mid, at, title, entity): where a row looks for clusters of its title."""
    return rows.where("title is not null").select("mid", "at", "title", F.explode("entities").alias("entity"))


def _pointers(rows: DataFrame) -> DataFrame:
    """For each row the earlier rows it may join, whatever the clusters: p1, p2, p3, p5 by signatures (the first row that has
    it), and p4, the last row before it within a day that shares its title and an entity."""
    signed = rows.select("mid", F.explode("signatures").alias("signature")).withColumn("rank", rank_of(F.col("signature")))
    first = signed.groupBy("signature").agg(F.min("mid").alias("first")).where("first is not null")
    by_rank = signed.join(first, "signature").where("first < mid").groupBy("mid").agg(*(F.min(F.when(F.col("rank") == k, F.col("first"))).alias(f"p{k}") for k in (1, 2, 3, 5)))
    line = _asked(rows).withColumn("bucket", F.shiftright("mid", BUCKET_BITS))
    last = running(line, ["title", "entity"], "bucket", ["mid"], {"last_mid": ("max", "mid"), "last_at": ("max", "at")}, inclusive=False)
    titled = last.where(F.col("at") - F.col("last_at") <= DAY_MICROS).groupBy("mid").agg(F.max("last_mid").alias("p4"))
    kept = rows.select("mid", "own_key", "lone_key").join(by_rank, "mid", "left").join(titled, "mid", "left")
    return written(kept, "fold-pointers")


def _followed(rows: DataFrame) -> DataFrame:
    """(mid, key, root) from (mid, key, parent): pointers are doubled until every row knows the end of its own."""
    now = written(rows.select("mid", "key", F.coalesce("parent", "mid").alias("root")), "fold-guess")
    while True:
        ends = now.select(F.col("mid").alias("_m"), F.col("root").alias("_r"))
        met = now.join(ends, now.root == ends._m).select("mid", "key", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved"))
        last, now = now, written(met, "fold-guess")
        dispose(last)
        if not now.where("moved").limit(1).count():
            break
    keys = now.select(F.col("mid").alias("_m"), F.col("key").alias("_k"))
    out = written(now.select("mid", "root").join(keys, F.col("root") == F.col("_m")).select("mid", F.col("_k").alias("key"), "root"), "fold-guess")
    dispose(now)
    return out


def _by_signature(guessed: DataFrame) -> DataFrame:
    """(mid, rank, lo, hi): the least and the greatest cluster of the earlier rows that have a signature."""
    lines = guessed.select("mid", "v", F.explode("signatures").alias("signature")).withColumn("bucket", F.shiftright("mid", BUCKET_BITS))
    seen = running(lines, ["signature"], "bucket", ["mid"], {"lo": ("min", "v"), "hi": ("max", "v")}, inclusive=False)
    return seen.where("lo is not null").select("mid", rank_of(F.col("signature")).alias("rank"), "lo", "hi")


def _by_title(guessed: DataFrame) -> DataFrame:
    """The same for clusters that have the row's title and an entity of it by then, and a row in the day before.

    Rows come in order of time, so a cluster is in time if it has a row earlier on the same day, or one on the day before not
    over 24 hours ago.  The first is told by the cluster's first row of the day, the second by its last one of that day.
    """
    titles = guessed.where("title is not null").groupBy("key", "title").agg(F.min("mid").alias("t_mid"), F.min("at").alias("t_at"))
    entities = guessed.select("key", "mid", "at", F.explode("entities").alias("entity")).groupBy("key", "entity").agg(F.min("mid").alias("e_mid"), F.min("at").alias("e_at"))
    days = guessed.groupBy("key", _day(F.col("at")).alias("day")).agg(F.min("mid").alias("first"), F.max("at").alias("last"), F.min("v").alias("v"))
    asked = _asked(guessed)
    both = titles.join(entities, "key").join(asked.select("title", "entity").distinct(), ["title", "entity"], "left_semi")
    held = both.join(days, "key").where(_day(F.greatest("t_at", "e_at")) <= F.col("day"))
    none = F.lit(None)
    line = lambda df, side, day, order, kind, mid, v: df.select("title", "entity", F.lit(side).alias("side"), day.alias("day"), order.alias("ord"), F.lit(kind).alias("kind"), mid.cast("long").alias("mid"), v.alias("v"))
    no_v = none.cast(guessed.schema["v"].dataType)
    at, last = F.col("at"), F.col("last")
    # On equal places: a row does not see what begins with itself, but does see what ended just a day ago.
    lines = (
        line(asked, 0, _day(at), F.col("mid"), 0, F.col("mid"), no_v).union(line(held, 0, F.col("day"), F.greatest("first", "t_mid", "e_mid"), 1, none, F.col("v")))
        .union(line(asked, 1, _day(at), DAY_MICROS - at, 1, F.col("mid"), no_v)).union(line(held, 1, F.col("day") + 1, -last, 0, none, F.col("v")))
    )
    lines = lines.withColumn("bucket", F.when(F.col("side") == 0, F.shiftright("ord", BUCKET_BITS)).otherwise(F.floor(F.col("ord") / HOUR_MICROS)))
    seen = running(lines, ["title", "entity", "side", "day"], "bucket", ["ord", "kind"], {"lo": ("min", "v"), "hi": ("max", "v")})
    return seen.where("mid is not null and lo is not null").groupBy("mid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("mid", F.lit(4).alias("rank"), "lo", "hi")


def _decided(rows: DataFrame, guess: DataFrame, pointers: DataFrame) -> DataFrame:
    """What each row decides, given the guess for the rows before it: mid, key, parent, rank, ambiguous, and old_key."""
    guessed = rows.join(guess, "mid").withColumn("v", F.struct("key", "root"))
    found = _by_signature(guessed).union(_by_title(guessed)).groupBy("mid").agg(F.min(F.struct("rank", "lo", "hi")).alias("b"))
    met = pointers.join(guess.select("mid", F.col("key").alias("old_key")), "mid").join(found, "mid", "left")
    rank, ambiguous = F.col("b.rank"), F.coalesce(F.col("b.lo.key") != F.col("b.hi.key"), F.lit(False))
    key = F.when(rank.isNull(), F.col("own_key")).when(ambiguous, F.col("lone_key")).otherwise(F.col("b.lo.key"))
    joined = F.coalesce(*(F.when(rank == k, F.col(f"p{k}")) for k in (1, 2, 3, 4, 5)), F.col("b.lo.root"))
    parent = F.when(rank.isNotNull() & ~ambiguous, joined)
    return met.select("mid", key.alias("key"), parent.alias("parent"), rank.alias("rank"), ambiguous.alias("ambiguous"), "old_key")


def fold(evidence: DataFrame) -> DataFrame:
    """evidence_id, cluster_key and match_rule of every row of ``evidence`` (with signatures), in order of time, then id.

    Rows without time come first and meet no title; rows without title, entities or signatures just lack that way to match.
    Repeated evidence_ids are rows of their own.  An empty table gives no rows.
    """
    rows = _ordered(evidence)
    pointers = _pointers(rows)
    guess = _followed(pointers.select("mid", F.col("own_key").alias("key"), F.coalesce("p1", "p2", "p3", "p4", "p5").alias("parent")))
    while True:
        decided = written(_decided(rows, guess, pointers), "fold-decided")
        dispose(guess)
        if not decided.where("key <> old_key").limit(1).count():
            break
        guess = _followed(decided)
        dispose(decided)
    rule = F.when(F.col("rank").isNull(), "new_candidate").when(F.col("ambiguous"), "ambiguous_new_candidate")
    for rank, name in RULES.items():
        rule = rule.when(F.col("rank") == rank, name)
    return rows.join(decided, "mid").select("evidence_id", F.col("key").alias("cluster_key"), rule.alias("match_rule"))
