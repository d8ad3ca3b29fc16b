"""Packing documents into training sequences of one size, balanced by what attention over them costs.

A document's tokens are those of a tokenizer file, then one end id.  Its cost is estimated as linear plus quadratic in its
length.  Documents are taken in descending order of cost, and each goes to the sequence of least cost that still has room for
it; where none has, it is cut to fill the cheapest one and its rest waits for its turn.  A task packs its rows in groups of
some hundred sequences: nothing is shuffled, no key groups rows, and a lost task packs the same rows again.
"""

from __future__ import annotations

import functools
import heapq
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import bounded

CAPACITY, END_ID = 4096, 2
#: Sequences that are filled together, and so hold this many times the tokens in memory, besides the longest text.
GROUP = 256
#: Words whose ids a worker keeps, twice: those met last, and those met before.
KEPT_WORDS = 500_000
#: The cost of n tokens is n + n * n / QUADRATIC: at that length attention costs as much as everything else.
QUADRATIC = 8192

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cost_of(n: int) -> float:
    return n + n * n / QUADRATIC


#: The tokenizer's own split of lower-cased ASCII words.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: A word of Latin letters with ASCII signs around it; an apostrophe before letters may belong to them.
_SIGNED_WORD = re.compile("([!-&(-@[-`{-~]*)([^\x00-@[-`{-\x7f\u0250-\U0010ffff]+)([!-@[-`{-~]*)")


class _Words(dict):
    """The ids of words, made when first asked for.

    No token spans the parts that the tokenizer splits words into, so words of printable ASCII, and Latin words with signs
    around them, are put together from parts; all other words are encoded whole.
    """

    def __init__(self, tokenizer) -> None:  # noqa: ANN001
        super().__init__()
        self.tokenizer, self.older, self.parts = tokenizer, {}, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = b"".join([self.parts.get(p) or self._part(p) for p in self._split(word.decode())])
        self[word] = ids
        return ids

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII_PIECES.findall(text.lower()) if text.isprintable() else [text]
        m = _SIGNED_WORD.fullmatch(text)
        return [x for x in (*_ASCII_PIECES.findall(m[1]), m[2], *_ASCII_PIECES.findall(m[3])) if x] if m and m[2].lower().isalpha() else [text]

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():  # its bytes stand for themselves, and it is one part
            ids = [t.id for t in self.tokenizer.model.tokenize(part)]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        made = self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)
        return made

    def make_room(self) -> None:
        """Forgets what was not asked for lately; common words come back from the older ones."""
        if len(self) > KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        if len(self.parts) > KEPT_WORDS:
            self.parts = {}


def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to their ids as little-endian unsigned 32-bit integers.  Strings of special tokens in a text are text.

    No token spans white space, so each word between ASCII white space, all of which the tokenizer drops, is encoded once.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    words = _Words(tokenizer)

    def encode(texts: list[str]) -> list[bytes]:
        words.make_room()
        return [b"".join(map(words.__getitem__, t.encode().split())) for t in texts]

    return encode


@functools.cache
def _encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """One for all tasks of a worker, which so share the words they have met."""
    return word_encoder(path)


def fill(lengths: list[int], room: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces (sequence, offset, document, start, length) that fill ``room``, and what is left (document, start, length).

    A document longer than any room is cut at once; of documents of equal cost the earlier comes first.
    """
    most = max(room or lengths, default=1)
    todo = [(-cost_of(min(n - at, most)), k, at, min(n - at, most)) for k, n in enumerate(lengths) for at in range(0, n, most)]
    heapq.heapify(todo)
    left, cost, size = np.array(room, np.int64), np.zeros(len(room)), np.array(room, np.int64)
    made, open_tokens = [], int(left.sum())
    while todo and open_tokens:
        _, k, at, n = heapq.heappop(todo)
        fits = np.flatnonzero(left >= n)
        among = fits if len(fits) else np.flatnonzero(left)
        s = int(among[np.argmin(cost[among])])
        part = min(n, int(left[s]))
        made.append((s, int(size[s] - left[s]), k, at, part))
        left[s] -= part
        cost[s] += cost_of(part)
        open_tokens -= part
        if part < n:
            heapq.heappush(todo, (-cost_of(n - part), k, at + part, n - part))
    return made, [(k, at, n) for _, k, at, n in sorted(todo, key=lambda x: (x[1], x[2]))]


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``capacity`` tokens, a power of two: doc_id, start, length,
    ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and offset.

    Every sequence is full but for the last rows of a task, whose rest fills sequences of powers of two; so no padding is
    needed.  Each row is a document of its own, repeated rows and equal doc_ids too.  Null and empty texts have the end id
    alone; a null doc_id stays null; texts of any length are cut (a task holds one at a time, besides its group); ties go to
    the earlier row and the lower sequence.  An empty table gives no pieces.  Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        base, sequence = TaskContext.get().partitionId() << 33, 0
        waiting: list[tuple[int | None, int, bytes, int]] = []  # doc_id, start, ids, tokens of the document
        tokens = 0

        def close(last: bool) -> pa.RecordBatch:
            nonlocal waiting, tokens, sequence
            rest = tokens % capacity
            room = [capacity] * (tokens // capacity) + ([1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1] if last else [])
            made, over = fill([len(w[2]) // 4 for w in waiting], room)
            made.sort()
            rows = [(waiting[k], at, n, s, offset) for s, offset, k, at, n in made]
            columns = [[w[0] for w, *_ in rows], [w[1] + at for w, at, *_ in rows], [n for _, _, n, *_ in rows], [w[2][4 * at : 4 * (at + n)] for w, at, n, *_ in rows],
                       [w[3] for w, *_ in rows], [base + sequence + s for *_, s, _ in rows], [o for *_, o in rows]]
            sequence += len(room)
            waiting = [(waiting[k][0], waiting[k][1] + at, waiting[k][2][4 * at : 4 * (at + n)], waiting[k][3]) for k, at, n in over]
            tokens = sum(n for *_, n in over)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            texts = batch.column("text")
            for i in range(0, batch.num_rows, 64):
                part = [t or "" for t in texts.slice(i, 64).to_pylist()]
                for doc_id, ids in zip(batch.column("doc_id").slice(i, 64).to_pylist(), encode(part), strict=True):
                    ids += end
                    waiting.append((doc_id, 0, ids, len(ids) // 4))
                    tokens += len(ids) // 4
                if tokens >= GROUP * capacity:
                    yield close(False)
        if tokens:
            yield close(True)

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
