"""Suffix-array dedup of byte strings by distributed prefix doubling.

Positions get a rank for the bytes that begin there: first for a quarter of the threshold, and then, at offsets that double,
from the pair of their own rank and the rank that many bytes on, until the pairs cover the threshold.  In each round Spark
deals the ranks out in order, tasks sort them, and positions whose rank is unique go, as no longer string from there can
tie; the rest is ranked again at the doubled length.  What still ties at the threshold occurs elsewhere.

The first round need not rank all positions: a string of the threshold's length can only tie if the least of the ranks in it
does.  So only those least ranks, one for every 76 bytes or so, are dealt out, and strings whose least rank is unique go.

Ranks are named by hashes of the pairs, so both sides of a tie find the name by themselves and only the ranks move, not the
positions: 32 bits and the bucket in rounds that only drop positions, 128 bits in the last.  The last round is done in parts,
so that its shuffle stays below twice the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import blocks as B
from siltstone.llm.shared import bounded, dispose, mix, paired, text_key, written

WIDTH = 200
#: Ranges of ranks that the last round handles one after the other.
PARTS = 2
#: Positions ranked at a time: arrays of them stay in a core's cache.
_SLICE = 1 << 15
#: Two ranks for each byte to begin with.
_LETTERS = np.random.default_rng(23).integers(0, 2**64, (2, 256), dtype=np.uint64)


def lengths(width: int) -> list[int]:
    """Lengths at which positions are ranked: a quarter of ``width``, half of it, all of it."""
    return sorted({max(1, -(-width // 4)), max(1, -(-width // 2)), width})


def ranks_at(buf: np.ndarray, places: np.ndarray, ladder: list[int], which: int = 0) -> np.ndarray:
    """The ranks, at the last length of ``ladder``, of the strings at sorted ``places`` of a buffer."""
    length = ladder[-1]
    out = np.empty(len(places), np.uint64)
    done = 0
    while done < len(places):
        a = int(places[done])
        b = int(np.searchsorted(places, a + _SLICE))
        ranks, w = _LETTERS[which][buf[a : a + _SLICE + length - 1]], 1
        for longer in ladder:
            ranks, w = paired(ranks, w, longer), longer
        out[done:b] = mix(ranks[places[done:b] - a])
        done = b
    return out


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima within stretches of that length."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = v
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def least_in(buf: np.ndarray, places: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the strings of ``width`` bytes at sorted ``places``: the number of the place of the least rank of ``length`` bytes in
    each, equal ranks from the left, and the ranks at these places."""
    number, ranks, done, span = np.empty(len(places), np.int64), [], 0, width - length + 1
    last = -1
    low = np.uint64((1 << 16) - 1)
    while done < len(places):
        a = int(places[done])
        b = int(np.searchsorted(places, a + _SLICE))
        r = mix(paired(_LETTERS[0][buf[a : a + _SLICE + width - 1]], 1, length))
        order = (r & ~low) | np.arange(len(r), dtype=np.uint64)
        at = (sliding_least(order, span)[places[done:b] - a] & low).astype(np.int64)
        new = np.concatenate([[a + at[0] != last], at[1:] != at[:-1]])
        number[done:b] = np.cumsum(new) - 1 + sum(map(len, ranks))
        ranks.append(r[at[new]])
        last = a + int(at[-1])
        done = b
    return number, np.concatenate([*ranks, np.zeros(0, np.uint64)])


def whole(text: bytes, most: int, width: int = WIDTH) -> list[tuple[int, int, int]]:
    """The text as one piece, or pieces that overlap by ``width`` - 1 bytes, so that each window is in one of them."""
    return [(a, min(len(text), a + most + width - 1), a) for a in range(0, max(1, len(text) - width + 1), most)]


def _ranked(block: B.Block, width: int, length: int) -> tuple:
    """Windows in question and known ones, places of the former, ranks of both at this length (two at the last), and for each
    place the number of its rank."""
    asks, known = block.windows(block.off, width)
    places = [np.flatnonzero(x) for x in (asks, known)]
    ladder = [x for x in lengths(width) if x <= length]
    if length < width and len(ladder) == 1:
        (number, first), (_, other) = (least_in(block.buf, p, width, length) for p in places)
        return asks, known, places[0], number, len(first), np.concatenate([first, other]), None
    both = [np.concatenate([ranks_at(block.buf, p, ladder, k) for p in places]) for k in range(1 + (length == width))]
    return asks, known, places[0], np.arange(len(places[0])), len(places[0]), both[0], both[1] if length == width else None


def _offers(held: DataFrame, width: int, length: int, n: int, part: range) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.each_block(batches):
            *_, n_asks, first, second = _ranked(block, width, length)
            yield from B.offer_ranks(block.number, first, second, n_asks, n, part)

    return held.mapInArrow(run, B.DEALT)


def _settled(held: DataFrame, said: DataFrame, width: int, length: int, n: int, schema: str, left) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = B.Block(batch, row)
                asks, known, places, number, n_asks, first, second = _ranked(block, width, length)
                bits = [x.as_buffer() for x in batch.column("said")[row].values]
                asks = np.zeros_like(asks)
                asks[places[B.settle_ranks(first, second, n_asks, bits, n)[number]]] = True
                out = left(block, asks, known)
                if out is not None:
                    yield out

    return held.join(said, "block").mapInArrow(run, schema)


def repeated_strings(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """(k1, k2, ranges) of the different texts with strings of ``width`` bytes that start anywhere else too; ``ranges`` are
    those of their first bytes, (first, last)."""
    held = B.in_blocks(docs, lambda text, most: whole(text, most, width), "blocks")
    for length in lengths(width):
        last = length == width
        parts = PARTS if last else 1
        n = B.buckets_of(held, 2 / (width - length + 2) if length == lengths(width)[0] else 1.0)
        kind = B.LONG if last else B.SHORT
        said = [B.answers(_offers(held, width, length, n, range(n * p // parts, n * (p + 1) // parts)), B.tied, kind, "ties") for p in range(parts)]
        every = said[0] if parts == 1 else _joined(said)
        if last:
            found = written(_settled(held, every, width, length, n, B.RANGES, lambda b, asks, known: b.ranges(b.off, asks | known)), "repeats")
            dispose(held, *said)
            return B.ranges_by_text(found)
        now = written(_settled(held, every, width, length, n, f"{B.PIECES}, block long", lambda b, asks, known: b.left(b.off, asks, known)), "blocks")
        dispose(held, *said)
        held = now


def _joined(said: list[DataFrame]) -> DataFrame:
    """Answers of several parts in one list; a block may have had nothing to ask in one of them."""
    out, *rest = said
    for more in rest:
        more = more.withColumnRenamed("said", "more")
        none = F.array().cast("array<binary>")
        out = out.join(more, "block", "full").select("block", F.concat(F.coalesce("said", none), F.coalesce("more", none)).alias("said"))
    return out


def dedup_bytes(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if any string of ``width`` bytes over it also starts anywhere else, the same document included, judged on the
    input; matches never cross documents.  Null texts are empty, and so are results of an empty table; a very long text is
    ranked in pieces; repeated rows count as copies; other columns, clashing names too, are dropped.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digest = [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                raw, gone, last, kept = text.as_py().encode(), B.covered(ranges.as_py(), width), 0, hashlib.sha256()
                for a, b in gone:
                    kept.update(raw[last:a])
                    last = b
                kept.update(raw[last:])
                removed.append(sum(b - a for a, b in gone))
                spans.append(len(gone))
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["a", "b", "n_removed", "n_spans", "cut_sha256"])

    found = B.different_texts(docs).drop("copies").join(repeated_strings(docs, width=width), ["k1", "k2"])
    found = bounded(found).mapInArrow(cut, "a long, b long, n_removed long, n_spans long, cut_sha256 string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", *text_key(), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole_sha256"))
    met = rows.join(found, (rows.k1 == found.a) & (rows.k2 == found.b), "left")
    zero = F.lit(0).cast("long")
    return met.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))
