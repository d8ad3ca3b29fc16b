"""Quality rules: statistics of each text, and lines that too many documents of one host share.

Lines are normalised and hashed; for each host the distinct documents that hold a line are counted; lines above the limit
are removed, and a document that loses most of its words by that is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import UNSPACED, bounded, byte_buffer, chunks, mix, text_key, window_ranks, word_hashes, words, written

#: A line stays while at most so many documents of its host hold it.
LINE_DOCUMENTS = 100
#: A document needs more than this share (in hundredths) of its words in lines that stay.
LEAST_KEPT = 30
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def normal_line(line: str) -> str:
    """A-Z in lower case, white space as single spaces, none at the ends."""
    return _SPACES.sub(" ", line).strip(" ").translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def text_statistics(buf: np.ndarray, off: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols and n_repeat_words of the rows of a byte buffer."""
    starts, ends, woff = words(buf, off, UNSPACED)
    begin = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])  # noqa: E731  sums by row
    out = {"n_words": np.diff(woff), "word_chars": begin(UNSPACED[buf] & ((buf & 0xC0) != 0x80)), "n_symbols": begin(_SYMBOLS[buf])}
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= window:
        h = window_ranks(word_hashes(buf, starts, ends), window)
        row = np.repeat(np.arange(len(off) - 1), np.diff(woff))
        valid = np.flatnonzero(row[: len(h)] == row[window - 1 :])
        key = mix(h[valid] + row[valid].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        at = valid[again]
        covered[at] += 1
        np.add.at(covered, at + window, -1)
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])[woff])
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, host, k1, k2 (the key of the text) and the statistics of every row; null texts are empty, null hosts "" ."""
    schema = "doc_id long, host string, k1 long, k2 long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = byte_buffer(batch.column("text"))
            parts = [text_statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in chunks(off)]
            cols = {k: np.concatenate([p[k] for p in parts]).astype(np.int64) for k in parts[0]} if parts else {k: np.zeros(0, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}
            dup = []
            for text in batch.column("text"):
                lines = [x for x in (text.as_py() or "").split("\n") if x.strip("\x20\t\n\v\f\r")]
                dup.append(len(lines) - len(set(lines)))
            cols["n_dup_lines"] = np.array(dup, np.int64)
            rest = [pa.array(cols[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "host", "k1", "k2")), *rest], schema.replace(" long", "").replace(" string", "").split(", "))

    return _keyed(docs).mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), F.col("text").cast("string").alias("text")).select("doc_id", "host", "text", *text_key())


def line_rows(docs: DataFrame) -> DataFrame:
    """(host, k1, k2, l1, l2, n): two hashes of each different line of each row with its host, and the words in all its
    occurrences.  Lines don't leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, l1, l2, n = [], [], [], []
            for r, (host, text) in enumerate(zip(batch.column("host"), batch.column("text"), strict=True)):
                of: dict[str, int] = {}
                for line in (text.as_py() or "").split("\n"):
                    if normal := normal_line(line):
                        of[normal] = of.get(normal, 0) + normal.count(" ") + 1
                at += [r] * len(of)
                n += of.values()
                begin = host.as_py() + "\0"
                for line in of:
                    said = (begin + line).encode()
                    l1.append(xxhash.xxh64_intdigest(said, 1))
                    l2.append(xxhash.xxh64_intdigest(said, 2))
            took = batch.select(["host", "k1", "k2"]).take(pa.array(at, pa.int64()))
            hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (l1, l2)]
            yield pa.RecordBatch.from_arrays([*took.columns, *hashes, pa.array(n, pa.int64())], ["host", "k1", "k2", "l1", "l2", "n"])

    return _keyed(docs).mapInArrow(run, "host string, k1 long, k2 long, l1 long, l2 long, n long")


def judge(docs: DataFrame, *, line_documents: int = LINE_DOCUMENTS, least_kept: int = LEAST_KEPT) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words, kept.

    base_failed: fewer than 10 words, or over a fifth of the words in 5-word windows that repeat in the text.  n_line_words:
    the words in lines that more than ``line_documents`` documents of the host hold; every row is a document, copies too.  A
    document is kept unless base_failed or ``least_kept`` per cent of its words at most would be left.  Null texts are
    empty and rows without a host share the host ""; repeated rows stay; an empty table gives an empty result; a very long
    text is judged whole; other columns, clashing names too, are dropped.
    """
    # One row for each different text of a host and how many documents have it: copies shrink in the tasks that read them, before any exchange.
    lines = written(line_rows(docs).groupBy("host", "k1", "k2", "l1", "l2").agg(F.max("n").alias("n"), F.count("*").alias("copies")), "lines")
    common = lines.groupBy("l1", "l2").agg(F.sum("copies").alias("held")).where(F.col("held") > line_documents).select("l1", "l2")
    lost = lines.join(common, ["l1", "l2"], "left_semi").groupBy("host", "k1", "k2").agg(F.sum("n").alias("lost"))
    lost = lost.select(F.col("host").alias("h"), F.col("k1").alias("a"), F.col("k2").alias("b"), "lost")
    base = statistics(docs)
    found = base.join(lost, (base.host == lost.h) & (base.k1 == lost.a) & (base.k2 == lost.b), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    gone = F.coalesce("lost", F.lit(0).cast("long"))
    kept = ~failed & (100 * (F.col("n_words") - gone) > least_kept * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), gone.alias("n_line_words"), kept.alias("kept"))
