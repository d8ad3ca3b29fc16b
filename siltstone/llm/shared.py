"""Helpers that several corpus operators share: written tables and text as numpy arrays.

Inside tasks a column of texts is handled as one byte buffer plus the offsets of its rows, so words, hashes and
windows are found by whole-array operations.  Every helper takes nulls as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.tables import dispose, written

__all__ = ["dispose", "written"]

#: Bytes of text that a task handles at a time; one longer text is handled alone.
CHUNK_BYTES = 1_000_000


#: Rows and bytes in an Arrow batch between Spark and Python: texts can be long, and both sides hold whole batches.
BATCH_ROWS, BATCH_BYTES = 1_000, 16_000_000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold few texts, and few long ones."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key).removesuffix("b")  # a number, or one with a unit
        if not now.isdigit() or int(now) not in range(1, most + 1):
            conf.set(key, str(most))
    return df


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its own columns of these names out of the way, and what gives a result their names and order back."""
    own = {c: f"_own_{c}" for c in df.columns if c in names}
    return df.withColumnsRenamed(own), lambda out: out.drop(*names).withColumnsRenamed({v: k for k, v in own.items()}).select(df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str | Column = "text") -> list[Column]:
    """Two independent 64-bit hashes that identify a text: equal texts share all results, so they share the key."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


# --- text as arrays -------------------------------------------------------------------------------------------------


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows back to back, and each row's offset (one more than there are rows)."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    off = off.astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` bytes, or a single row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes outside the given inclusive ranges."""
    inside = np.ones(256, bool)
    for a, b in ranges:
        inside[a : b + 1] = False
    return inside


#: Words of letters, digits and anything beyond ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
LETTERS = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Words between ASCII white space: ``[^\x20\x09-\x0D]+``.
UNSPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the number of words before it (one more than there are rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    mask = inside[buf]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    full = off[1:] > off[:-1]
    at = off[:-1][full]
    first[at] = mask[at]
    at = off[1:][full] - 1
    last[at] = mask[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of the input over all bits of the output."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_FOLD = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each word: the sum of what each byte gives at its place in the word, mixed with the length.

    Bytes and places are mixed together before they are summed, so no repeated pattern cancels out.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    value = mix(((place << 8) | buf[np.repeat(starts, sizes) + place]).astype(np.uint64) * _FOLD + np.uint64(seed))
    return mix(np.add.reduceat(value, before) + sizes.astype(np.uint64) * _TURN)


def paired(ranks: np.ndarray, width: int, target: int) -> np.ndarray:
    """Ranks of strings of ``target`` symbols from ranks of their parts of ``width``: at offsets that double, the rank of a
    string is made from those of its first and its last part.  Equal strings have equal ranks, others only by chance."""
    while width < target:
        step = min(width, target - width)
        # In place, and one step after the other: this is where most time goes.
        out = ranks[:-step] * _FOLD
        out += ranks[step:]
        out ^= out >> np.uint64(32)
        out *= _TURN
        ranks, width = out, width + step
    return ranks


def window_ranks(symbols: np.ndarray, width: int) -> np.ndarray:
    """A rank for each window of ``width`` symbols (uint64 hashes); none where there are fewer symbols."""
    return mix(paired(symbols, 1, width)) if len(symbols) >= width else np.zeros(0, np.uint64)
