"""Texts in blocks, and the exchange by which strings of equal rank in different blocks are found.

A block is one row: the bytes of some megabytes of different texts, back to back.  In a task all positions of a block are
ranked by whole-array operations, equal ranks of a block are one entry, and entries are dealt out to buckets by rank.  Spark
shuffles a row for each block and bucket; a bucket sorts its entries and answers each block which of its entries tie.  So a
string that a third of all texts hold is one entry for each block, however often it occurs.

At N bytes there are N / BLOCK_BYTES blocks and N / BUCKET_ENTRIES buckets, so rows grow faster than N at first; but never
beyond one for each entry: from some terabytes on a shuffled row holds few entries, and costs what any row of Spark costs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import bounded, byte_buffer, text_key, written

#: Bytes in a block; a longer text is cut into pieces that overlap by a window less one symbol.
BLOCK_BYTES = 2_000_000
#: Entries in a bucket, were all positions to be dealt out: 16 MB of short ones.
BUCKET_ENTRIES = 4_000_000

#: (first byte, end byte, number of the first symbol) of the pieces of a text.
Pieces = Callable[[bytes, int], list[tuple[int, int, int]]]
PIECES = "data binary, sizes array<int>, k1 array<long>, k2 array<long>, first array<long>, copied array<boolean>, asks binary, known binary"


def different_texts(docs: DataFrame) -> DataFrame:
    """(k1, k2, text, copies) of the different texts; copies shrink in the tasks that read them, before the exchange."""
    rows = bounded(docs).select(F.col("text").cast("string").alias("text")).where("text <> ''").select("text", *text_key())
    return rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def in_blocks(docs: DataFrame, pieces: Pieces, name: str) -> DataFrame:
    """The different texts of ``docs`` as a written table of blocks, each with a number of its own."""
    most = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            buf, off = byte_buffer(batch.column("text"))
            raw = memoryview(buf)
            keys = [batch.column(c).to_pylist() for c in ("k1", "k2", "copies")]
            for r, (a, b) in enumerate(zip(off.tolist(), off[1:].tolist(), strict=False)):
                for start, end, first in pieces(bytes(raw[a:b]), most):
                    if held and size + end - start > most:
                        yield block(held)
                        held, size = [], 0
                    held.append((bytes(raw[a + start : a + end]), end - start, keys[0][r], keys[1][r], first, keys[2][r] > 1))
                    size += end - start
        if held:
            yield block(held)

    def block(held: list[tuple]) -> pa.RecordBatch:
        data, *lists = zip(*held, strict=True)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        cols = [pa.array([b"".join(data)], pa.binary()), *(pa.array([list(x)], pa.list_(k)) for x, k in zip(lists, kinds, strict=True)), *(pa.nulls(1, pa.binary()) for _ in range(2))]
        return pa.RecordBatch.from_arrays(cols, ["data", "sizes", "k1", "k2", "first", "copied", "asks", "known"])

    return written(different_texts(docs).mapInArrow(run, PIECES).withColumn("block", F.monotonically_increasing_id()), name)


def buckets_of(blocks: DataFrame, share: float = 1.0) -> int:
    """How many buckets are filled by this share of the positions of all blocks."""
    return int((blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0) * share // BUCKET_ENTRIES) + 1


class Block:
    """A row of blocks in a task; ``asks`` and ``known`` (bool, for each symbol of the block) are the windows in question and
    those known to occur elsewhere."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.batch, self.row = batch, row
        self.buf = np.frombuffer(batch.column("data")[row].as_buffer(), np.uint8)
        self.off = np.concatenate([[0], np.cumsum(batch.column("sizes")[row].values.to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.number = batch.column("block")[row].as_py()
        self.copied = batch.column("copied")[row].values.to_numpy(zero_copy_only=False)

    def windows(self, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """asks and known as they were left, or at first: windows of texts that stand in several rows are known."""
        said = [self.batch.column(c)[self.row].as_buffer() for c in ("asks", "known")]
        if said[0] is not None:
            return tuple(np.unpackbits(np.frombuffer(x, np.uint8), count=int(off[-1])).view(bool) for x in said)
        start = np.arange(int(off[-1])) <= np.repeat(off[1:] - width, np.diff(off))
        copied = np.repeat(self.copied, np.diff(off))
        return start & ~copied, start & copied

    def left(self, off: np.ndarray, asks: np.ndarray, known: np.ndarray) -> pa.RecordBatch | None:
        """The block with the windows that are left, without the pieces that have none."""
        open_ = asks | known
        any_ = np.add.reduceat(open_, off[:-1][off[1:] > off[:-1]]) > 0 if len(open_) else np.zeros(0, bool)
        keep = np.zeros(len(off) - 1, bool)
        keep[off[1:] > off[:-1]] = any_
        if not keep.any():
            return None
        of_symbol, of_byte = np.repeat(keep, np.diff(off)), np.repeat(keep, np.diff(self.off))
        lists = [pa.array([self.batch.column(c)[self.row].values.filter(pa.array(keep))], self.batch.schema.field(c).type) for c in ("sizes", "k1", "k2", "first", "copied")]
        bits = [pa.array([np.packbits(x[of_symbol]).tobytes()], pa.binary()) for x in (asks, known)]
        return pa.RecordBatch.from_arrays([pa.array([self.buf[of_byte].tobytes()], pa.binary()), *lists, *bits, pa.array([self.number])], ["data", "sizes", "k1", "k2", "first", "copied", "asks", "known", "block"])


    def ranges(self, off: np.ndarray, found: np.ndarray) -> pa.RecordBatch | None:
        """For each piece with windows that were found: the ranges of their first symbols in the text, ends included."""
        edge = found.copy()
        edge[1:] &= ~found[:-1]
        edge[off[:-1][off[:-1] < off[-1]]] |= found[off[:-1][off[:-1] < off[-1]]]  # none goes on into the next piece
        start = np.flatnonzero(edge)
        if not len(start):
            return None
        over = np.unique(np.concatenate([np.flatnonzero(~found), off[1:], start]))
        last = over[np.searchsorted(over, start, side="right")] - 1
        row = np.searchsorted(off, start, side="right") - 1
        keys = [self.batch.column(c)[self.row].values.to_numpy(zero_copy_only=False) for c in ("k1", "k2", "first")]
        shift = keys[2][row] - off[row]
        rows, bounds = np.unique(row, return_index=True)
        pairs = pa.StructArray.from_arrays([pa.array((x + shift).astype(np.int32)) for x in (start, last)], ["first", "last"])
        lists = pa.ListArray.from_arrays(pa.array([*bounds.tolist(), len(row)], pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([pa.array(keys[0][rows]), pa.array(keys[1][rows]), lists], ["k1", "k2", "ranges"])


RANGES = "k1 long, k2 long, ranges array<struct<first:int,last:int>>"


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch, row)


# --- dealing out ----------------------------------------------------------------------------------------------------


def bucket_bounds(ranks: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` buckets begins in sorted ranks: buckets are ranges of equal size."""
    return np.searchsorted(ranks, np.array([(b << 64) // n for b in range(n)], np.uint64)) if len(ranks) else np.zeros(n, np.int64)


def dealt(number: int, asks: np.ndarray, asked: np.ndarray, known: np.ndarray, named: np.ndarray, n: int, part: range) -> Iterator[pa.RecordBatch]:
    """A row for each bucket in ``part``: entries that ask, then those that are known, each by sorted rank."""
    a, b = (np.append(bucket_bounds(x, n), len(x)).tolist() for x in (asks, known))
    full = [k for k in part if a[k + 1] > a[k] or b[k + 1] > b[k]]
    data = [asked[a[k] : a[k + 1]].tobytes() + named[b[k] : b[k + 1]].tobytes() for k in full]
    size = [a[k + 1] - a[k] for k in full]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([number] * len(full), pa.int64()), pa.array(size, pa.int32()), pa.array(data, pa.binary())], ["bucket", "block", "n", "data"])


DEALT = "bucket int, block long, n int, data binary"


def answers(offers: DataFrame, answer: Callable[[list[np.ndarray], list[int], np.ndarray], list[bytes]], kind: np.dtype, name: str) -> DataFrame:
    """(block, said): what each bucket answers to each block, in order of buckets.  ``answer`` gets the entries of each block
    in a bucket, how many of them ask, and the numbers of the blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        entries = [np.frombuffer(x.as_buffer(), kind) for x in table.column("data")]
        said = answer(entries, table.column("n").to_pylist(), table.column("block").to_numpy())
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "said": pa.array(said, pa.binary())})

    found = offers.groupBy("bucket").applyInArrow(run, "block long, bucket int, said binary")
    found = found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "said"))).alias("said"))
    return written(found.select("block", F.col("said.said").alias("said")), name)


# --- ranks that tie -------------------------------------------------------------------------------------------------

SHORT, LONG = np.dtype("<u4"), np.dtype([("a", "<u8"), ("b", "<u8")])


def _grouped(ranks: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the ranks, where a new one begins in it, and how often each occurs."""
    order = np.argsort(ranks) if second is None else np.lexsort((second, ranks))
    new = np.ones(len(ranks), bool)
    s = ranks[order]
    new[1:] = s[1:] != s[:-1]
    if second is not None:
        s = second[order]
        new[1:] |= s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    return order, begin, np.diff(np.append(begin, len(ranks)))


def _entries(ranks: np.ndarray, second: np.ndarray | None) -> np.ndarray:
    if second is None:
        return ranks.astype(SHORT)
    out = np.empty(len(ranks), LONG)
    out["a"], out["b"] = ranks, second
    return out


def _twice(values: np.ndarray, n_asks: int) -> np.ndarray:
    # What is known is there twice: then whatever occurs once asks.
    return np.concatenate([values, values[n_asks:]])


def offer_ranks(number: int, ranks: np.ndarray, second: np.ndarray | None, n_asks: int, n: int, part: range) -> Iterator[pa.RecordBatch]:
    """Deals out the ranks of a block, those that ask before the others.  In filters (no ``second``) an entry is 32 bits of its
    rank, besides those that name its bucket: chance keeps a string too many in question, and loses none."""
    r, s = _twice(ranks, n_asks), None if second is None else _twice(second, n_asks)
    order, begin, count = _grouped(r, s)
    at = order[begin]
    once, again = at[count == 1], at[count > 1]
    pick = lambda x: (r[x], _entries(r[x], None if s is None else s[x]))
    return dealt(number, *pick(once), *pick(again), n, part)


def tied(entries: list[np.ndarray], asks: list[int], blocks: np.ndarray) -> list[bytes]:
    """For each block a bit for each entry that asks: whether another entry of the bucket is the same."""
    every = np.concatenate(entries)
    if every.dtype == SHORT:
        key = np.sort(every.astype(np.uint64) << np.uint64(32) | np.arange(len(every), dtype=np.uint64))
        order, value = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), key >> np.uint64(32)
        same = value[1:] == value[:-1]
    else:
        order = np.lexsort((every["b"], every["a"]))
        value = every[order]
        same = value[1:] == value[:-1]
    tie = np.zeros(len(every), bool)
    tie[order[1:]] |= same
    tie[order[:-1]] |= same
    first = np.cumsum([0, *(len(e) for e in entries)]).tolist()
    return [np.packbits(tie[a : a + k]).tobytes() for a, k in zip(first, asks, strict=False)]


def settle_ranks(ranks: np.ndarray, second: np.ndarray | None, n_asks: int, said: list[bytes], n: int) -> np.ndarray:
    """Which of the first ``n_asks`` ranks tie with another, given the answers of all buckets to what ``offer_ranks`` sent."""
    r, s = _twice(ranks, n_asks), None if second is None else _twice(second, n_asks)
    order, begin, count = _grouped(r, s)
    once = np.flatnonzero(count == 1)
    bounds = np.append(bucket_bounds(r[order[begin[once]]], n), len(once))
    again = np.append(bucket_bounds(r[order[begin[count > 1]]], n), int((count > 1).sum()))
    full = np.flatnonzero((np.diff(bounds) > 0) | (np.diff(again) > 0))
    tie = count > 1
    bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=int(bounds[k + 1] - bounds[k])) for k, x in zip(full.tolist(), said, strict=True)]
    tie[once] = np.concatenate(bits).view(bool) if bits else False
    out = np.empty(len(r), bool)
    out[order] = np.repeat(tie, count)
    return out[:n_asks]


def ranges_by_text(found: DataFrame) -> DataFrame:
    """(k1, k2, ranges) from rows (k1, k2, ranges) of pieces: a text has as many ranges as stretches, at most."""
    return found.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"))


def covered(ranges: list[dict], width: int) -> list[tuple[int, int]]:
    """Maximal spans of symbols [start, end) that windows with starts in the given ranges cover; ranges are sorted."""
    out: list[list[int]] = []
    for r in ranges:
        a, b = r["first"], r["last"] + width
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]
