"""Benchmark decontamination: test n-grams as a broadcast hash set, training windows scanned against it, hits verified.

The set is broadcast in blocks whose size is bounded whatever the size of the benchmark; each further block is one more
narrow pass over the same rows, so documents are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import LETTERS, LOWER, bounded, byte_buffer, chunks, dispose, set_aside, text_key, window_ranks, word_hashes, words, written

#: Bytes of benchmark text in a broadcast block: with its windows at most 12 times as much, in words of one letter.
BLOCK_BYTES = 8_000_000


class Grams:
    """The windows of a block of texts as arrays, for each length in words: sorted hashes and a bit table before them, and where
    each window stands in the normalised texts.  About 20 bytes a window, besides the texts."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.keys = np.array([k for k, _ in items], np.int64)
        buf, off = byte_buffer(pa.array([t for _, t in items], pa.string()))
        low = LOWER[buf]
        starts, ends, woff = words(low, off, LETTERS)
        self.said, at = spaced(low, starts, ends)
        sizes, hashes = np.diff(woff), word_hashes(low, starts, ends)
        self.by_length = []
        for m in np.unique(np.minimum(sizes[sizes > 0], width)).tolist():
            fits = (np.minimum(sizes, width) == m) & (sizes > 0)
            first = np.flatnonzero(np.repeat(fits, sizes) & (np.arange(len(starts)) <= np.repeat(woff[1:] - m, sizes)))
            h = window_ranks(hashes, m)[first]
            order = np.argsort(h, kind="stable")
            h, first = h[order], first[order]
            text = (np.searchsorted(woff, first, side="right") - 1).astype(np.int32)
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            last = first + m - 1
            self.by_length.append((m, h, bits, at[first].astype(np.int32), (at[last] + (ends - starts)[last]).astype(np.int32), text))


def spaced(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and where each begins."""
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(at, sizes) + place] = low[np.repeat(starts, sizes) + place]
    return out.tobytes(), at


def _pieces(benchmark: DataFrame, width: int) -> DataFrame:
    """(k1, part, text): each different text once, however many items have it; a text of over BLOCK_BYTES in parts, which
    overlap by ``width`` - 1 words, so that each window is in one of them."""
    most = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("k1").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                if len(raw) <= most:
                    rows.append((key, 0, text))
                    continue
                starts, ends, _ = words(LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), LETTERS)
                a = 0
                while a == 0 or a + width <= len(starts):
                    b = max(a + 1, int(np.searchsorted(starts, starts[a] + most))) if len(starts) else 1
                    if len(starts):
                        rows.append((key, a, raw[starts[a] : ends[min(b + width - 1, len(ends)) - 1]].decode()))
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "part", "text"])

    return bounded(_items(benchmark).select("k1", "text").distinct()).mapInArrow(run, "k1 long, part long, text string")


def _blocks(benchmark: DataFrame, width: int) -> Iterator[Grams]:
    pieces = written(_pieces(benchmark, width), "benchmark")
    total = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    for b in range(n):
        # A hash deals out about BLOCK_BYTES to a block, as no piece is larger.
        rows = pieces.where(F.pmod(F.xxhash64("k1", "part"), F.lit(n)) == b).collect()
        if rows:
            yield Grams([(r.k1, r.text) for r in rows], width)
    dispose(pieces)


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, text and its key k1 of the items that have a text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return items.select("item_id", "text", text_key()[0])


def _scan(low: np.ndarray, off: np.ndarray, grams: Grams) -> dict[int, tuple[list[tuple[int, int]], set]]:
    """For each row that is hit: spans of words, and the items."""
    starts, ends, woff = words(low, off, LETTERS)
    hits: dict[int, tuple[list, set]] = {}
    if not len(starts):
        return hits
    said, at_byte, sizes = None, None, ends - starts
    hashes = word_hashes(low, starts, ends)
    for m, known, bits, begin, end, text in grams.by_length:
        h = window_ranks(hashes, m)
        at = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(known, h[at]), np.searchsorted(known, h[at], side="right")
        row = np.searchsorted(woff, at, side="right") - 1
        fits = (hi > lo) & (at + m <= woff[row + 1])
        for i, r, a, b in zip(at[fits].tolist(), row[fits].tolist(), lo[fits].tolist(), hi[fits].tolist(), strict=True):
            if said is None:
                said, at_byte = spaced(low, starts, ends)
            window = said[at_byte[i] : at_byte[i + m - 1] + sizes[i + m - 1]]
            same = [k for k in range(a, b) if grams.said[begin[k] : end[k]] == window]
            if same:
                spans, seen = hits.setdefault(r, ([], set()))
                first = i - int(woff[r])
                spans.append((first, first + m))
                seen.update(grams.keys[text[same]].tolist())
    return hits


def find_hits(docs: DataFrame, benchmark: DataFrame, *, width: int = 10) -> DataFrame:
    """Adds to ``docs``: n_words (long), hit_words (array of word numbers [start, end, start, end, ...] of merged spans)
    and hit_items (array of long: the keys of the benchmark texts, which ``report`` turns into items).

    A window is ``width`` consecutive words of an item (a shorter item is one window); hits are compared word by word.
    Null and empty texts have no words and no hits, empty tables give empty results or none hit, and very long texts are
    scanned whole; items without words or text are skipped, those without id hit like any other; repeated items and rows
    count as they stand.  Columns of ``docs`` with these three names are replaced, all others are kept.
    """
    docs = bounded(docs).drop("n_words", "hit_words", "hit_items")
    base = docs.withColumns({"n_words": F.lit(None).cast("long"), "hit_words": F.array().cast("array<int>"), "hit_items": F.array().cast("array<long>")})
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(g) for g in _blocks(benchmark, width)] or [spark.sparkContext.broadcast(Grams([], width))]
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            grams = block.value
            for batch in batches:
                buf, off = byte_buffer(batch.column("text").cast(pa.string()))
                n = np.zeros(batch.num_rows, np.int64)
                spans, items = batch.column("hit_words").to_pylist(), batch.column("hit_items").to_pylist()
                for i, j in chunks(off):
                    low, o = LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
                    n[i:j] = np.diff(words(low, o, LETTERS)[2])
                    for r, (new, seen) in _scan(low, o, grams).items():
                        spans[i + r] = merged(spans[i + r], new)
                        items[i + r] = sorted({*items[i + r], *seen})
                out = {"n_words": pa.array(n), "hit_words": pa.array(spans, pa.list_(pa.int32())), "hit_items": pa.array(items, pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([out.get(c, batch.column(k)) for k, c in enumerate(batch.schema.names)], batch.schema.names)

        base = base.mapInArrow(run, base.schema)
    return base


def merged(old: list[int], new: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted([*zip(old[::2], old[1::2], strict=True), *new]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def report(docs: DataFrame, benchmark: DataFrame, *, width: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Items without id contaminate, but are not among the items that n_items and items_sha256 cover.  Null texts have no words,
    and null items no windows; very long texts of both sides count whole; repeated rows and null doc_ids stay, items of equal
    text all count; other columns are dropped; empty tables on either side give rows without hits, or none.
    """
    hit = F.aggregate(F.sequence(F.lit(0), F.size("hit_words") - 2, F.lit(2)), F.lit(0).cast("long"), lambda s, i: s + F.get("hit_words", i + 1) - F.get("hit_words", i))
    n_hit = F.when(F.size("hit_words") > 0, hit).otherwise(F.lit(0).cast("long"))
    found = find_hits(docs.select("doc_id", "text"), benchmark, width=width)
    rows = written(found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "hit_items"), "hits")
    # Items of each different set of texts that documents hit; they join behind the scan, so none goes through the driver.
    ids = _items(benchmark).where("item_id is not null").select("k1", "item_id").distinct()
    sets = rows.where(F.size("hit_items") > 0).select(F.col("hit_items").alias("hit_set")).distinct()
    of = sets.select("hit_set", F.explode("hit_set").alias("k1")).join(ids, "k1").groupBy("hit_set").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    # Most rows hit nothing: they don't join, or all would meet in the task of the empty set.
    none = F.array().cast("array<string>")
    hit = rows.where(F.size("hit_items") > 0).join(of, F.col("hit_items") == F.col("hit_set"), "left").withColumn("ids", F.coalesce("ids", none)).drop("hit_set")
    met = rows.where(F.size("hit_items") == 0).withColumn("ids", none).unionByName(hit)
    return met.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("ids"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, whole_documents: bool = True) -> DataFrame:
    """``docs`` without the contaminated documents, or with the hit words cut out of their texts.

    All other columns stay, clashing names and nulls too; null and empty texts are never hit; very long texts count whole;
    repeated rows share their fate; an empty benchmark leaves all rows, an empty table stays empty.
    """
    free, restored = set_aside(docs, ("n_words", "hit_words", "hit_items"))
    found = find_hits(free, benchmark, width=width)
    if whole_documents:
        return restored(found.where(F.size("hit_words") == 0))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for r, spans in enumerate(batch.column("hit_words").to_pylist()):
                if spans:
                    raw = texts[r].encode()
                    buf = LOWER[np.frombuffer(raw, np.uint8)]
                    starts, ends, _ = words(buf, np.array([0, len(buf)]), LETTERS)
                    kept, last = [], 0
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        kept.append(raw[last : starts[a]])
                        last = int(ends[b - 1])
                    texts[r] = b"".join([*kept, raw[last:]]).decode()
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return restored(found.mapInArrow(cut, found.schema))
