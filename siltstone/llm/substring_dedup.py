"""Substring dedup by relative Lempel-Ziv parsing over words.

The corpus is its own reference, cut into blocks.  All blocks are indexed by their grams of ANCHOR words: the index is dealt
out by gram, and tells each position the first other place of the reference that holds its gram (its source).  A text is then
parsed greedily: a factor goes on for as long as the sources of its positions follow each other in the reference.  Windows
inside a factor are long enough copies of one stretch of the reference.  Windows that cross the end of a factor, and hold
known grams only, may be copies of another stretch: they are looked up one by one, under 128 bits, in an index of windows.
Words that either kind of window covers are the duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import blocks as B
from siltstone.llm.shared import UNSPACED, bounded, byte_buffer, chunks, dispose, text_key, window_ranks, word_hashes, words, written

WIDTH = 35
#: Words in a gram of the index.
ANCHOR = 12

GRAM = np.dtype([("rank", "<u4"), ("at", "<i4")])
SOURCE = np.dtype([("block", "<i8"), ("at", "<i4")])


class Words:
    """The words of a block: their hashes (two of them on demand) and the offsets of its pieces in them."""

    def __init__(self, block: B.Block):
        self.buf = block.buf
        self.starts, self.ends, self.off = words(block.buf, block.off, UNSPACED)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return word_hashes(self.buf, self.starts, self.ends, seed)

    def whole(self, width: int, least: int) -> np.ndarray:
        """Where ``width`` words fit into a piece, of the pieces of ``least`` words or more."""
        sizes = np.diff(self.off)
        n = int(self.off[-1])
        return np.flatnonzero((np.arange(n) <= np.repeat(self.off[1:] - width, sizes)) & np.repeat(sizes >= least, sizes))


def split_at_words(text: bytes, most: int, width: int = WIDTH) -> list[tuple[int, int, int]]:
    """The text as one piece, or pieces that overlap by ``width`` - 1 words, so that each window is in one of them."""
    if len(text) <= most:
        return [(0, len(text), 0)]
    starts, ends, _ = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), UNSPACED)
    out, at = [], 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(starts, starts[at] + most)))
        out.append((int(starts[at]), int(ends[min(last + width - 1, len(ends)) - 1]), at))
        at = last
    return out


# --- the index of grams ---------------------------------------------------------------------------------------------


def _grams(said: Words, width: int, k: int) -> tuple[np.ndarray, ...]:
    """Places of the grams of a block and their ranks; the order of the ranks, and where each new one begins in it."""
    at = said.whole(k, width)
    ranks = window_ranks(said.hashes(), k)[at]
    order = np.argsort(ranks, kind="stable")
    new = np.ones(len(ranks), bool)
    new[1:] = ranks[order][1:] != ranks[order][:-1]
    return at, ranks, order, np.flatnonzero(new)


def _index(held: DataFrame, width: int, k: int, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.each_block(batches):
            at, ranks, order, begin = _grams(Words(block), width, k)
            first = order[begin]
            entries = np.empty(len(first), GRAM)
            entries["rank"], entries["at"] = ranks[first].astype(np.uint32), at[first]
            yield from B.dealt(block.number, ranks[first], entries, ranks[:0], entries[:0], n, range(n))

    return held.mapInArrow(run, B.DEALT)


def sources(entries: list[np.ndarray], asks: list[int], blocks: np.ndarray) -> list[bytes]:
    """For each block: a bit for each of its grams that another block holds too, and the first such place."""
    every = np.concatenate(entries)
    block = np.repeat(blocks, [len(e) for e in entries])
    order = np.lexsort((every["at"], block, every["rank"]))
    rank = every["rank"][order]
    begin = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(rank)))
    # The first entry of a group is the source of all others, the second that of the first.
    of = np.repeat(begin, size)
    of[begin] += size > 1
    met = np.empty(len(rank), bool)
    met[order] = np.repeat(size > 1, size)
    place = np.empty(len(rank), SOURCE)
    place["block"][order], place["at"][order] = block[order][of], every["at"][order][of]
    first = np.cumsum([0, *(len(e) for e in entries)]).tolist()
    return [np.packbits(met[a:b]).tobytes() + place[a:b][met[a:b]].tobytes() for a, b in zip(first, first[1:], strict=False)]


def parse(said: Words, number: int, width: int, k: int, answers: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a block: whether the window that starts there lies in a factor; whether it crosses factors."""
    at, ranks, order, begin = _grams(said, width, k)
    count = np.diff(np.append(begin, len(order)))
    bounds = np.append(B.bucket_bounds(ranks[order[begin]], n), len(begin))
    met, place = np.zeros(len(begin), bool), np.zeros(len(begin), SOURCE)
    full = np.flatnonzero(np.diff(bounds))
    for b, raw in zip(full.tolist(), answers, strict=True):
        lo, hi = int(bounds[b]), int(bounds[b + 1])
        cut = -(-(hi - lo) // 8)
        met[lo:hi] = np.unpackbits(np.frombuffer(raw[:cut], np.uint8), count=hi - lo).view(bool)
        place[lo:hi][met[lo:hi]] = np.frombuffer(raw[cut:], SOURCE)
    # The least place besides its own, in this block or another.
    first = at[order[begin]]
    second = at[order[np.minimum(begin + 1, len(order) - 1)]] if len(order) else first
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(begin)), count)
    local = np.where(at == first[group], second[group], first[group])
    other = met[group] & ((place["block"][group] < number) | (count[group] == 1))
    total = int(said.off[-1])
    block, source = np.full(total + 1, -1, np.int64), np.full(total + 1, -2, np.int64)
    block[at] = np.where(other, place["block"][group], np.where(count[group] > 1, number, -1))
    source[at] = np.where(other, place["at"][group], local)
    held = block >= 0
    # A factor goes on from a place to the next one where sources do; no gram reaches over the end of a piece.
    goes_on = held[:-1] & held[1:] & (block[:-1] == block[1:]) & (source[1:] == source[:-1] + 1)
    goes_on &= ~np.isin(np.arange(1, total + 1), said.off)
    start = said.whole(width, width)
    until = lambda flags: np.append(np.flatnonzero(~flags), total)[np.searchsorted(np.flatnonzero(~flags), start)]
    inside, crossing = np.zeros(total, bool), np.zeros(total, bool)
    inside[start] = (until(goes_on) >= start + width - k) & held[start]
    crossing[start] = until(held[:-1]) > start + width - k
    return inside, crossing & ~inside


def _factors(held: DataFrame, said: DataFrame, width: int, k: int, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = B.Block(batch, row)
                of = Words(block)
                inside, crossing = parse(of, block.number, width, k, [x.as_py() for x in batch.column("said")[row].values], n)
                copied = np.zeros(int(of.off[-1]), bool)
                copied[of.whole(width, width)] = True
                copied &= np.repeat(block.copied, np.diff(of.off))
                left = block.left(of.off, crossing & ~copied, inside | copied)
                if left is not None:
                    yield left

    return held.join(said, "block").mapInArrow(run, f"{B.PIECES}, block long")


# --- the ends of factors --------------------------------------------------------------------------------------------


def _ranked(block: B.Block, width: int) -> tuple:
    of = Words(block)
    asks, known = block.windows(of.off, width)
    places = [np.flatnonzero(x) for x in (asks, known)]
    first, second = (window_ranks(of.hashes(seed), width)[np.concatenate(places)] for seed in (1, 2))
    return of, asks, known, places[0], first, second


def _lookups(held: DataFrame, width: int, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.each_block(batches):
            _, _, _, places, first, second = _ranked(block, width)
            yield from B.offer_ranks(block.number, first, second, len(places), n, range(n))

    return held.mapInArrow(run, B.DEALT)


def _looked_up(held: DataFrame, said: DataFrame, width: int, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = B.Block(batch, row)
                of, asks, known, places, first, second = _ranked(block, width)
                known[places[B.settle_ranks(first, second, len(places), [x.as_buffer() for x in batch.column("said")[row].values], n)]] = True
                out = block.ranges(of.off, known)
                if out is not None:
                    yield out

    return held.join(said, "block").mapInArrow(run, B.RANGES)


def duplicate_spans(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """(k1, k2, ranges) of the different texts with windows of ``width`` words which start elsewhere too; ``ranges`` are those
    of their first words, (first, last)."""
    k = min(ANCHOR, width)
    held = B.in_blocks(docs, lambda text, most: split_at_words(text, most, width), "reference")
    n = B.buckets_of(held)
    said = B.answers(_index(held, width, k, n), sources, GRAM, "sources")
    factors = written(_factors(held, said, width, k, n), "factors")
    dispose(held, said)
    met = B.answers(_lookups(factors, width, n), B.tied, B.LONG, "lookups")
    found = written(_looked_up(factors, met, width, n), "spans")
    dispose(factors, met)
    return B.ranges_by_text(found)


def _pieces(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    raw = text.encode()
    starts, ends, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), UNSPACED)
    return raw, starts, ends


def dedup_substrings(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by single spaces).

    A word goes if any window of ``width`` words over it starts anywhere else too, the same document included, judged on the
    input; so copies lose all their windows, the first one too.  Null texts have no words, and an empty table gives an empty
    result; a very long text is parsed in pieces; repeated rows count as copies; other columns, clashing names too, are
    dropped.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                raw, starts, ends = _pieces(text.as_py())
                gone = np.zeros(len(starts), bool)
                for a, b in B.covered(ranges.as_py(), width):
                    gone[a:b] = True
                left = np.flatnonzero(~gone)
                removed.append(int(gone.sum()))
                kept.append(b" ".join(raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True)).decode())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["a", "b", "n_removed", "kept"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = byte_buffer(batch.column("text"))
            n, digest = [], []
            for i, j in chunks(off):
                part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                starts, ends, woff = words(part, o, UNSPACED)
                n.append(np.diff(woff))
                sizes = ends - starts
                at = np.cumsum(sizes + 1) - sizes - 1
                joined = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
                inside = np.flatnonzero(UNSPACED[part])
                joined[inside + np.repeat(at - starts, sizes)] = part[inside]
                bounds = np.append(at, len(joined))[woff].tolist()
                digest += [hashlib.sha256(joined[a : max(a, b - 1)].tobytes()).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(np.concatenate([*n, np.zeros(0, np.int64)])), pa.array(digest, pa.string())], ["doc_id", "k1", "k2", "n_words", "whole_sha256"])

    found = B.different_texts(docs).drop("copies").join(duplicate_spans(docs, width=width), ["k1", "k2"])
    found = bounded(found).mapInArrow(cut, "a long, b long, n_removed long, kept string")
    found = found.select("a", "b", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", *text_key())
    rows = rows.mapInArrow(whole, "doc_id long, k1 long, k2 long, n_words long, whole_sha256 string")
    met = rows.join(found, (rows.k1 == found.a) & (rows.k2 == found.b), "left")
    return met.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))
