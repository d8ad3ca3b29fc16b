"""Runs of words that repeat with a period: found by splitting at rare words, then by comparing words a lag apart.

A run of period q and length L >= max(6, 4 q) holds each of its words at least LEAST times.  So a word that occurs less often
in a segment is in no run of that segment, and splits it; the parts are counted anew and split until each holds all its words
often enough.  Most text is gone by then; what survives is scanned lag by lag.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import bounded

#: A run has this many periods at least, and this many words.
LEAST, SHORTEST = 4, 6

Run = tuple[int, int, int]  # start, length, period


def stable_segments(words: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) of at least SHORTEST words in which every word occurs LEAST times or more.

    A part's words are counted by themselves, those of the largest part by taking the others away, and rare words are looked
    up by their places.  So a word is counted again only when its segment has halved, however deep the recursion goes.
    """
    out: list[tuple[int, int]] = []
    if len(words) < SHORTEST:
        return out
    # The first level at once: most words of most documents are rare in the whole document.
    keep = np.bincount(words)[words] >= LEAST
    edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    ids = words.tolist()
    todo = [(a, b, None, None) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= SHORTEST]
    places: dict[int, list[int]] = {}
    for a, b, *_ in todo:
        for i in range(a, b):
            places.setdefault(ids[i], []).append(i)
    while todo:
        a, b, counts, changed = todo.pop()
        if counts is None:
            counts = Counter(ids[a:b])
            changed = counts.keys()
        cuts = []
        for w in changed:
            if 0 < counts[w] < LEAST:
                at = bisect_left(places[w], a)
                cuts += places[w][at : at + counts[w]]
        if not cuts:
            out.append((a, b))
            continue
        cuts.sort()
        parts = [(x + 1, y) for x, y in zip([a - 1, *cuts], [*cuts, b], strict=True)]
        large = max(parts, key=lambda p: p[1] - p[0])
        gone = [ids[i] for i in cuts]
        for x, y in parts:
            if (x, y) != large:
                gone += ids[x:y]
                if y - x >= SHORTEST:
                    todo.append((x, y, None, None))
        if large[1] - large[0] >= SHORTEST:
            counts.subtract(gone)
            todo.append((*large, counts, set(gone)))
    return sorted(out)


def _equal_from(words: np.ndarray, at: int, lag: int) -> int:
    """How many words from ``at`` on equal those ``lag`` later."""
    n, step = 0, 16
    while at + n + lag < len(words):
        a, b = words[at + n : at + n + step], words[at + n + lag : at + n + lag + step]
        differ = np.flatnonzero(a[: len(b)] != b)
        if len(differ):
            return n + int(differ[0])
        n += len(b)
        step *= 2
    return n


def _equal_before(words: np.ndarray, at: int, lag: int) -> int:
    """How many words before ``at`` equal those ``lag`` later, counted backwards."""
    n, step = 0, 16
    while n < at:
        lo = max(0, at - n - step)
        differ = np.flatnonzero(words[lo : at - n] != words[lo + lag : at - n + lag])
        if len(differ):
            return n + (at - n - lo) - 1 - int(differ[-1])
        n, step = at - lo, step * 2
    return n


def lag_scan(words: np.ndarray) -> list[Run]:
    """All runs of a segment, by start and period.

    A run of period q holds four places that are multiples of q, so for each lag only those places are compared: about
    n log n comparisons.  Around three equal pairs in a row the stretch is followed to both ends.  A stretch inside a run of
    a smaller period is none of its own, as it overlaps that run by more than both periods.
    """
    n, found = len(words), []
    reach = np.zeros(n, np.int64)  # of the runs found that begin here or before, where the last one ends
    for q in range(1, n // LEAST + 1):
        at = words[::q]
        same = at[1:] == at[:-1]
        places = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q
        done = 0
        for x in places[reach[places] < places + 3 * q + 1].tolist():
            if x + 3 * q < done:
                continue
            start, end = x - _equal_before(words, x, q), x + _equal_from(words, x, q) + q
            done = end
            if end - start >= max(SHORTEST, LEAST * q) and reach[start] < end:
                found.append((start, end - start, q))
                np.maximum(reach[start:end], end, out=reach[start:end])
        if n and reach[0] == n:
            break  # what is left would lie inside this run
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(words: list[bytes]) -> list[Run]:
    """All runs (start, length, period) of a sequence of words, by start, then period."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return sorted(((a + start, length, q) for a, b in stable_segments(ids) for start, length, q in lag_scan(ids[a:b])), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that are left when each run keeps its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def collapse_runs(docs: DataFrame, *, planted: Column | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, runs (array of start, length, period; by start, then period)
    and collapsed (the words that are left, joined by one space).

    ``planted``, if given, is a struct (a, p) or null for each row: the words from ``a`` on then repeat those ``p`` before,
    which tests the detection inside real text.  Null and empty texts have no words; null doc_ids stay; repeated rows stay;
    of words that tie in number nothing depends on the order; other columns are dropped; an empty table gives no rows.  A
    task holds the words of one text at a time, about ten times the text; time grows as n log n.
    """
    made = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                runs, texts = [], []
                for text, how in zip(part.column("text"), part.column("how").to_pylist(), strict=True):
                    words = (text.as_py() or "").encode().split()  # bytes are split at ASCII white space only
                    if how and how["p"] and words:
                        a, p = how["a"], how["p"]
                        unit = words[a : a + p]
                        words = words[:a] + (unit * ((len(words) - a) // p + 1))[: len(words) - a]
                    found = runs_of(words)
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    texts.append(b" ".join(collapsed(words, found)).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(runs, made.field(1).type), pa.array(texts, pa.string())], schema=made)

    how = planted if planted is not None else F.lit(None).cast("struct<a:long,p:long>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), how.alias("how"))
    return bounded(rows).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted_period() -> Column:
    """A tenth of the documents, by the checksum of their ids, repeat a stretch up to their end; null for the others."""
    h = F.crc32(F.col("doc_id").cast("string"))
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    g = F.floor(h / 10)
    a = g % n
    return F.when((h % 10 == 0) & (n > 0), F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")))


def digests(found: DataFrame) -> DataFrame:
    """What ``collapse_runs`` found, in numbers: doc_id, n_runs, the longest run (start, length, period, exponent_milli; null
    where there is none; of equal lengths that of least start, then period), runs_sha256 and collapsed_sha256."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    df = found.withColumn("_best", best)
    return df.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.s")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.p")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.p")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
