"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A vocabulary of byte strings with ranks is loaded into an Aho-Corasick automaton whose alphabet is Latin-1 (one code
point a byte).  A piece of text is encoded greedily from the longest token at each place; a token is accepted after its
left neighbour only if merging by rank would keep the two apart, and the search steps back where none fits.  Every place
is given up at most once, so the time is linear in the piece, and the ids equal those of merging by rank.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import bounded

#: Entries that the caches of pieces and of neighbour tests may hold in a worker before they are emptied.
CACHE_ENTRIES = 400_000


class BytePairs:
    """Encoder and decoder for one vocabulary (token bytes -> rank) and one pattern that cuts text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.splits = {r: self._split(t, r) for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            # A token that merging never yields may only stand for a whole piece.
            if len(token) == 1 or self.splits[rank]:
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.shorter = {r: self._prefix(t) for t, r in ranks.items()}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.apart: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, if merging its bytes by lower ranks ends with two."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            least, i = min((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if least >= rank:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        ids = tuple(self.ranks.get(p, -1) for p in parts)
        return ids if len(ids) == 2 and -1 < min(ids) and max(ids) < rank or len(ids) == 2 and all(len(p) == 1 for p in parts) else None

    def _prefix(self, token: bytes) -> int | None:
        """The longest token that is a proper prefix of this one."""
        for n in range(len(token) - 1, 0, -1):
            r = self.ranks.get(token[:n])
            if r is not None and (n == 1 or self.splits[r]):
                return r
        return None

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these neighbours as they are.

        Undo the merges on both sides of the border, latest first.  Whenever the two tokens that then touch could merge
        at a rank below the merge undone last, that merge would have come first and joined the sides.
        """
        known = self.apart.get((left, right))
        if known is not None:
            return known
        a, b, bound, held = left, right, 1 << 60, True
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < bound:
                held = False
                break
            sa = self.splits[a] if len(self.bytes_of[a]) > 1 else None
            sb = self.splits[b] if len(self.bytes_of[b]) > 1 else None
            if sa is None and sb is None:
                break
            if sb is None or (sa is not None and a > b):
                # On equal ranks the left merge comes first, so only a strictly lower rank could cross the border.
                bound, a = a, sa[1]
            else:
                bound, b = b + 1, sb[0]
        if len(self.apart) >= CACHE_ENTRIES:
            self.apart.clear()
        self.apart[(left, right)] = held
        return held

    def _backtrack(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        size = [0] * n
        for end, (length, rank) in self.automaton.iter(piece.decode("latin-1")):
            at = end - length + 1
            if length > size[at]:
                size[at], longest[at] = length, rank
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            while True:
                end = pos + len(self.bytes_of[token])
                if open_at[end] and (not out or self._stay_apart(out[-1], token)):
                    out.append(token)
                    pos = end
                    token = longest[pos] if pos < n else -1
                    break
                nxt = self.shorter[token]
                if nxt is None:
                    open_at[pos] = 0
                    token = out.pop()
                    pos -= len(self.bytes_of[token])
                    break
                token = nxt
        return out

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.pieces.get(text)
        if ids is None:
            raw = text.encode()
            whole = self.ranks.get(raw)
            ids = (whole,) if whole is not None else tuple(self._backtrack(raw))
            if len(text) <= 64:
                if len(self.pieces) >= CACHE_ENTRIES:
                    self.pieces.clear()
                self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        known, out = self.pieces.get, []
        for p in self.pattern.findall(text):
            out += known(p) or self.piece(p)
        return np.array(out, "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_LOADED: dict[tuple[str, str], BytePairs] = {}


def loaded(path: str, pattern: str) -> BytePairs:
    """One encoder for each vocabulary and worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[(path, pattern)] = BytePairs.load(path, pattern)
    return _LOADED[(path, pattern)]


def tokenize(docs: DataFrame, path: str, pattern: str, *, keep_ids: bool = True) -> DataFrame:
    """Token ids of every whole text, and the digests of the ids and of the bytes they decode to.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (array of int).  A null text counts
    as empty: no tokens.  Repeated rows and a null doc_id are carried through; other columns, clashing names too, are dropped;
    very long texts are encoded whole, one at a time; ties do not arise; an empty table gives an empty result.  The vocabulary
    file must exist at ``path`` on every executor, as installed packages do.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha, kept = [], [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
                if keep_ids:
                    kept.append(ids.view("<i4"))
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
