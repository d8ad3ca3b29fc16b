"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  The binary Golay code (23, 12) is perfect: every word
is within three bits of one codeword.  The codewords that the words within one bit of a segment decode to are one or six;
two segments that differ in at most two bits share one of them, as they share a word half way.  Of at most two differing
bits in all, one of the three segments has none: the keys of a fingerprint are, for each segment, the segment itself with
the codeword indices of the next one.  Fingerprints that share a key with another are verified.

Texts of which a fifth of the shingles differ are about ten of 64 bits apart, where no such key is selective.  Where these
count too (``keep_one(similar=...)``), candidates are texts that share a band of least shingle hashes; each pair of a small
band, and what is not linked yet in a large one, is verified by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.components import components
from siltstone.llm.shared import LOWER, UNSPACED, bounded, byte_buffer, chunks, dispose, mix, set_aside, text_key, window_ranks, word_hashes, words, written

#: Generator polynomial of the (23, 12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a Golay key that are compared each with each.
SMALL = 16
_NAMELESS = -(1 << 63)
#: Bands of so many least hashes each: of texts with a Jaccard similarity of 0.8, one pair in 30,000 shares no band.
BANDS, BAND_ROWS = 20, 4
#: In a band that more texts share, each is compared with two of them at first, and then by its rarest shingles.
ALL_PAIRS = 8
#: Texts of one rare shingle that a task compares with all others of it.
PART = 256
_CHAIN = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(12).integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def _syndrome_of(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    single = [_syndrome_of(1 << i) for i in range(23)]
    high = np.zeros(1 << 12, np.uint32)
    for i in range(12):
        high[1 << i : 2 << i] = high[: 1 << i] ^ single[11 + i]
    leaders = np.zeros(1 << 11, np.uint32)
    for i in range(23):
        leaders[single[i]] = 1 << i
        for j in range(i):
            leaders[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                leaders[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return high, leaders, np.array([0, *(1 << i for i in range(23))], np.uint32)


_HIGH, _LEADERS, _FLIPS = _tables()


def codewords(segment: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords that the words within one bit of each 23-bit segment decode to: 24 columns."""
    near = segment.astype(np.uint32)[:, None] ^ _FLIPS
    return (near ^ _LEADERS[(near & 0x7FF) ^ _HIGH[near >> np.uint32(11)]]) >> np.uint32(11)


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and key of every fuzzy key of the fingerprints (uint64)."""
    rows, keys = [], []
    parts = [(fingerprints >> np.uint64(a)) & np.uint64((1 << w) - 1) for a, w in SEGMENTS]
    for i in range(3):
        index = np.sort(codewords(parts[(i + 1) % 3]), 1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append(mix((parts[i][r] << np.uint64(14)) | (index[r, c].astype(np.uint64) << np.uint64(2)) | np.uint64(i)))
    return np.concatenate(rows), np.concatenate(keys)


def shingle_fingerprints(buf: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the rows of a byte buffer: bit by bit the majority of the hashes of its word shingles."""
    low = LOWER[buf]
    starts, ends, woff = words(low, off, UNSPACED)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(starts):
        return out
    # All words with one space after each: every shingle is a slice of this.
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int(at[-1] + sizes[-1] + 1), 0x20, np.uint8)
    inside = np.flatnonzero(UNSPACED[low])
    joined[inside + np.repeat(at - starts, sizes)] = low[inside]
    per_row = np.diff(woff)
    n = np.where(per_row >= width, per_row - width + 1, np.minimum(per_row, 1))
    rows = np.flatnonzero(n)
    first = np.repeat(woff[:-1][rows] - (np.cumsum(n[rows]) - n[rows]), n[rows]) + np.arange(int(n.sum()))
    last = first + np.repeat(np.minimum(per_row[rows], width), n[rows]) - 1
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(data[a:b], 42) for a, b in zip(at[first].tolist(), (at[last] + sizes[last]).tolist(), strict=True)], np.uint64)
    begin = np.cumsum(n[rows]) - n[rows]
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    over = (2 * ones > n[rows][:, None]).astype(np.uint8)
    out[rows] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different word shingles of the rows of a byte buffer, row by row, and each row's offset in them.  A text
    of fewer words is one shingle; one without words has none."""
    low = LOWER[buf]
    starts, ends, woff = words(low, off, UNSPACED)
    per_row = np.diff(woff)
    n = np.where(per_row >= width, per_row - width + 1, np.minimum(per_row, 1))
    row = np.repeat(np.arange(len(n)), n)
    first = np.repeat(woff[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    hashes, size = word_hashes(low, starts, ends), np.minimum(per_row, width)[row]
    h = np.empty(len(first), np.uint64)
    for m in np.unique(size).tolist():
        h[size == m] = window_ranks(hashes, m)[first[size == m]]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))])


def band_keys(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """BANDS keys for each row that has shingles: texts share one with probability similarity ** BAND_ROWS."""
    begin = off[:-1][off[1:] > off[:-1]]
    keys = np.zeros((len(begin), BANDS), np.uint64)
    if len(begin):
        for i, factor in enumerate(_FACTORS):
            band = i // BAND_ROWS
            keys[:, band] = mix(keys[:, band] * _CHAIN + mix(np.minimum.reduceat(hashes * factor, begin)) + np.uint64(i + 1))
    return keys


def _shingled(texts: DataFrame, width: int, keys: bool) -> DataFrame:
    """(k1, hashes) of rows of (k1, text): the band keys, or all shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = byte_buffer(batch.column("text"))
            for i, j in chunks(off):
                values, at = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                if keys:
                    values, at = band_keys(values, at).ravel(), np.concatenate([[0], np.cumsum((at[1:] > at[:-1]) * BANDS)])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("k1").slice(i, j - i), lists], ["k1", "hashes"])

    return texts.mapInArrow(run, "k1 long, hashes array<long>")


def candidates(met: DataFrame) -> DataFrame:
    """Pairs (a < b) of texts to compare first, from rows (k1, key, n) of bands that n texts share.

    Up to ALL_PAIRS texts of a band are compared each with each.  Of more, each text is compared with two: that which meets
    most others over all bands, in the whole band and in a salted part of it of about ALL_PAIRS.  A text that the others were
    made from meets most.  What these comparisons leave open is found by ``unsettled_pairs``.
    """
    degree = met.groupBy("k1").agg(F.sum("n").alias("degree"))
    few = met.where(F.col("n") <= ALL_PAIRS).groupBy("key").agg(F.array_sort(F.collect_list("k1")).alias("all")).select(F.posexplode("all").alias("i", "a"), "all")
    pairs = few.select("a", F.explode(F.slice("all", F.col("i") + 2, ALL_PAIRS)).alias("b"))
    part = F.pmod(F.xxhash64("k1", "key"), F.ceil(F.col("n") / ALL_PAIRS))
    hot = written(met.where(F.col("n") > ALL_PAIRS).join(degree, "k1").select("key", "k1", "degree", part.alias("part")), "hot")
    hub = F.max(F.struct("degree", "k1"))
    parts = hot.groupBy("key", "part").agg(hub.alias("hub"))
    wholes = parts.groupBy("key").agg(F.max("hub").alias("hub"))
    stars = [hot.join(wholes, "key"), hot.join(parts, ["key", "part"])]
    for s in stars:
        pairs = pairs.union(s.select(F.col("k1").alias("a"), F.col("hub.k1").alias("b")))
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def unsettled_pairs(met: DataFrame, texts: DataFrame, rooted: DataFrame, width: int, similar: int) -> DataFrame:
    """Pairs (a < b) that may be similar and are not in one component yet, of texts in bands of more than ALL_PAIRS.

    Bands whose texts are all in one component have nothing left to find.  The texts of the others are joined by their rarest
    shingles: of two texts that share ``similar`` hundredths, the first ``n - ceil(similar * n / 100) + 1`` of n shingles of
    each, in one order, have one in common, so no link is lost.  The order is by the number of these texts that hold a
    shingle, which keeps passages that many share out.  ``rooted`` has k1 and root.
    """
    hot = met.where(F.col("n") > ALL_PAIRS).join(rooted, "k1")
    split = hot.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
    open_ = written(hot.join(split, "key", "left_semi").groupBy("k1").agg(F.first("root").alias("root")), "open")
    sets = _shingled(texts.join(open_, "k1", "left_semi"), width, False).groupBy("k1").agg(F.first("hashes").alias("hashes"))
    each = written(sets.select("k1", F.size("hashes").alias("size"), F.explode("hashes").alias("h")), "shingles")
    held = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # Shingles of one text alone come first in its order; they are counted, not listed.
    mine = each.join(held, "h").groupBy("k1", "size").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shared"))
    left = F.col("size") - F.expr(f"({similar} * size + 99) div 100") + 1 - (F.col("size") - F.size("shared"))
    first = mine.where(left > 0).select("k1", "size", F.posexplode(F.slice("shared", F.lit(1), left.cast("int"))).alias("i", "x"), F.size("shared").alias("of"))
    # What follows a shingle in the order bounds what two texts can share if it is their first one in common.
    first = first.select("k1", "size", "x", (F.col("of") - F.col("i")).alias("after"))
    rows = written(first.join(open_, "k1"), "prefixes")
    # Of shingles that the same texts hold, the first one counts.
    group = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("k1").cast("decimal(38,0)")).alias("of"))
    groups = rows.groupBy("x").agg(group.alias("g"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
    groups = groups.groupBy("g").agg(F.min("x").alias("x")).select("x", F.ceil(F.col("g.n") / PART).cast("int").alias("parts"))
    now = written(rows.join(groups, "x").select("x.h", "k1", "size", "after", "root", "parts"), "groups")
    salt = F.pmod(F.xxhash64("k1"), F.col("parts")).cast("int")
    side = lambda c: [F.col(v).alias(f"{c}_{v}") for v in ("root", "size", "after")]
    one = now.select("h", salt.alias("part"), F.col("k1").alias("a"), *side("a"))
    two = now.select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("k1").alias("b"), *side("b"))
    enough = (100 + similar) * F.least("a_after", "b_after") >= similar * (F.col("a_size") + F.col("b_size"))
    return one.join(two, ["h", "part"]).where((F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & enough).select("a", "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int, similar: int) -> DataFrame:
    """The pairs (a, b) whose texts share ``similar`` hundredths of their shingles or more (Jaccard similarity)."""
    wanted = pairs.select(F.col("a").alias("k1")).union(pairs.select("b")).distinct()
    # A text that stands in many rows is read once: rows shrink to one for each key in the tasks that read them.
    sets = written(_shingled(texts.join(wanted, "k1", "left_semi"), width, False).groupBy("k1").agg(F.first("hashes").alias("hashes")), "sets")
    side = lambda c: sets.select(F.col("k1").alias(c), F.col("hashes").alias(f"{c}_hashes"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("same", F.size(F.array_intersect("a_hashes", "b_hashes")))
    near = 100 * F.col("same") >= similar * (F.size("a_hashes") + F.size("b_hashes") - F.col("same"))
    return both.where(near).select("a", "b")


def similar_roots(docs: DataFrame, marks: DataFrame, near: DataFrame, width: int, similar: int) -> DataFrame:
    """(node, component) of fingerprints by the edges ``near`` and by links of texts whose ``width``-word shingles have a
    Jaccard similarity of ``similar`` hundredths or more.  ``marks`` has k1 and fingerprint of every row."""
    texts = bounded(docs).select(F.col("text").cast("string").alias("text")).select(text_key()[0], "text")
    prints = written(marks.groupBy("k1").agg(F.min("fingerprint").alias("fingerprint")), "prints")
    keys = _shingled(texts, width, True).select("k1", F.explode("hashes").alias("key")).distinct()
    met = written(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "bands")

    def between(pairs: DataFrame, names: DataFrame) -> DataFrame:
        side = lambda c: names.toDF(c, f"{c}_name")
        return pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("a_name").alias("a"), F.col("b_name").alias("b")).where("a <> b").distinct()

    found = verified(written(candidates(met), "pairs"), texts, width, similar)
    roots = written(components(near.union(between(found, prints))), "roots")
    rooted = prints.join(roots, prints.fingerprint == roots.node, "left").select("k1", F.coalesce("component", "fingerprint").alias("root"))
    rooted = written(rooted, "rooted")
    rest = verified(written(unsettled_pairs(met, texts, rooted, width, similar), "unsettled"), texts, width, similar)
    joined = components(between(rest, rooted))
    lone = joined.select("node", F.col("component").alias("into"))
    merged = roots.select(F.col("node").alias("of"), "component").join(lone, F.col("component") == lone.node, "left").select(F.col("of").alias("node"), F.coalesce("into", "component").alias("component"))
    return merged.union(joined.join(roots.select("node"), "node", "left_anti"))


def fingerprints(docs: DataFrame, *, width: int = 3, keyed: bool = False) -> DataFrame:
    """Adds ``fingerprint`` (long holding 64 bits) to doc_id, and with ``keyed`` to the key of the text (k1, k2) too; null and
    empty texts have fingerprint zero."""
    names = ["doc_id", "k1", "k2"] if keyed else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = byte_buffer(batch.column("text"))
            out = [shingle_fingerprints(buf[off[i] : off[j]], off[i : j + 1] - off[i], width) for i, j in chunks(off)]
            fp = np.concatenate([*out, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fp.view(np.int64))], [*names, "fingerprint"])

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", *(text_key() if keyed else []))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fingerprint"]))


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) among distinct fingerprints, such that two within two differing bits are always connected.

    Fingerprints are joined on their Golay keys, and each pair within a key is verified.  Keys that over SMALL fingerprints
    share, dense groups of near copies, would turn into too many pairs: there, a fingerprint is verified through the words
    within one bit of it.  Two fingerprints are within two bits exactly if they share such a word, at most 65 can share
    one, and each is linked with the least of them, so nothing is lost.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fingerprint").to_numpy(zero_copy_only=False)
            rows, keys = golay_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[rows])], ["key", "fingerprint"])

    keys = prints.mapInArrow(keyed, "key long, fingerprint long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keys.join(sizes, "key"), "golay")
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    few = met.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_set("fingerprint")).alias("all"))
    each = few.select(F.posexplode("all").alias("i", "a"), "all")
    near = each.select("a", F.explode(F.filter(F.slice("all", F.col("i") + 2, SMALL), lambda b: apart(F.col("a"), b) <= 2)).alias("b"))
    many = met.where(F.col("n") > SMALL).select("fingerprint").distinct()
    flips = [F.lit(v).cast("long") for v in [*(1 << i for i in range(63)), -(1 << 63)]]
    around = many.select("fingerprint", F.explode(F.array(F.col("fingerprint"), *(F.col("fingerprint").bitwiseXOR(v) for v in flips))).alias("word"))
    stars = around.groupBy("word").agg(F.min("fingerprint").alias("least"), F.max("fingerprint").alias("most")).where("least <> most")
    found = around.join(stars.select("word", "least"), "word").where("fingerprint <> least")
    found = found.where(apart(F.col("fingerprint"), F.col("least")) <= 2).select(F.col("fingerprint").alias("a"), F.col("least").alias("b"))
    edges = written(near.union(found).distinct(), "links")
    dispose(met)
    return edges


def near_duplicates(docs: DataFrame, *, width: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 lower-case hex digits), component_id (the least doc_id reachable by links).

    Fingerprints link at two or fewer differing bits; texts without words, null ones too, have fingerprint zero and link
    like any other.  A null doc_id never names a component unless all its members lack one (component_id is then null).
    Repeated rows stay; other columns, clashing names too, are dropped; a very long text counts whole; an empty table gives
    an empty result.
    """
    marks = written(fingerprints(docs, width=width), "fingerprints")
    roots = components(links(marks.select("fingerprint").distinct()))
    least = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    named = least.join(roots, least.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("root"))
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(heads, "root").select(F.col("fingerprint").alias("f"), "component_id")
    return marks.join(of, marks.fingerprint == of.f).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, width: int = 3, similar: int | None = None, shingle: int = 5) -> DataFrame:
    """One row of each group of near-duplicates: that with the least doc_id.

    Texts link where their fingerprints differ in two bits at most, and with ``similar`` also where that many hundredths of
    their ``shingle``-word shingles are the same (Jaccard similarity of the sets).

    Rows without doc_id come after all others.  Where doc_ids tie, the key of the text decides, then the other columns; so
    repeated rows shrink to one, and a doc_id that stands for texts of two groups stays once in each.  Columns whose names
    clash with our own stay as they are; very long texts count whole; an empty table gives an empty result.
    """
    marks = written(fingerprints(docs, width=width, keyed=True), "fingerprints")
    edges = links(marks.select("fingerprint").distinct())
    roots = components(edges) if similar is None else similar_roots(docs, marks, edges, shingle, similar)
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k1", "k2")
    firsts = marks.groupBy("fingerprint").agg(F.min(first).alias("head"))
    firsts = firsts.join(roots, firsts.fingerprint == roots.node, "left").groupBy(F.coalesce("component", "fingerprint")).agg(F.min("head").alias("head"))
    # With an id for rows without one the three columns are plain keys: join and window share one exchange.
    heads = firsts.select(F.coalesce("head.doc_id", F.lit(_NAMELESS)).alias("a"), F.col("head.k1").alias("b"), F.col("head.k2").alias("c"))
    free, restored = set_aside(docs, ("_id", "_k1", "_k2", "_place"))
    key1, key2 = text_key(F.col("text").cast("string"))
    free = free.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NAMELESS)), "_k1": key1, "_k2": key2})
    kept = free.join(heads, (free["_id"] == heads["a"]) & (free["_k1"] == heads["b"]) & (free["_k2"] == heads["c"]), "left_semi")
    rest = [F.col(c).asc_nulls_first() for c, kind in kept.dtypes if c not in ("doc_id", "text", "_id", "_k1", "_k2") and "map<" not in kind and "variant" not in kind]
    order = [F.col("doc_id").asc_nulls_last(), *rest]
    return restored(kept.withColumn("_place", F.row_number().over(Window.partitionBy("_id", "_k1", "_k2").orderBy(*order))).where("_place = 1"))
