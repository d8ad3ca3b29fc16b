"""Quality classifier: a byte-level convolutional network in numpy, trained here and scored inside tasks.

Bytes are embedded; narrow filters slide over them; their activations are averaged within overlapping chunks that cover the
whole document; a hidden layer looks at each chunk, its best activations over all chunks are kept (max-pooling), and a
logistic unit combines them into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import bounded, byte_buffer, chunks, set_aside

#: Bytes under a filter, between neighbouring filters, between neighbouring chunks (which are twice as long).
WIDTH, STRIDE, HOP = 8, 4, 128
EMBEDDED, FILTERS, HIDDEN = 6, 24, 24
#: Bounds of the training sample: labelled rows of each class, and bytes of a training text (scored texts have no bound).
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 20_000
PAD = 256
_PER_HOP = HOP // STRIDE
_LEAST = 16


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        of = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        embed = of(257, EMBEDDED, scale=0.5)
        embed[PAD] = 0
        return cls(embed, of(WIDTH * EMBEDDED, FILTERS, scale=0.3), np.zeros(FILTERS, np.float32), of(FILTERS, HIDDEN, scale=0.4), np.zeros(HIDDEN, np.float32), of(HIDDEN, scale=0.2), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.filter_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def chunk_means(self, grid: np.ndarray, n_places: np.ndarray) -> np.ndarray:
        """Mean filter activation of each row of ``grid`` (places by WIDTH bytes) over its first places."""
        places = grid.shape[1]
        z = self.embed[grid].reshape(-1, WIDTH * EMBEDDED) @ self.filters + self.filter_bias
        np.maximum(z, 0, out=z)
        z = z.reshape(-1, places, FILTERS) * (np.arange(places)[None, :] < n_places[:, None])[:, :, None]
        return z.sum(1) / np.maximum(n_places, _LEAST)[:, None].astype(np.float32)


def laid_out(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hops of each row as byte places (hops, places, WIDTH), filter places used in each hop, hop offsets of the rows."""
    sizes = np.diff(off)
    hops = np.maximum(1, -(-sizes // HOP))
    hop_off = np.concatenate([[0], np.cumsum(hops)])
    padded = np.full(int(hop_off[-1]) * HOP + WIDTH, PAD, np.int16)
    at = np.repeat(hop_off[:-1] * HOP - off[:-1], sizes) + np.arange(len(buf))
    padded[at] = buf
    # A filter at the end of a hop looks into the next; the next row's bytes don't belong to it.
    grid = np.lib.stride_tricks.as_strided(padded, (int(hop_off[-1]), _PER_HOP, WIDTH), (HOP * 2, STRIDE * 2, 2)).copy()
    last = hop_off[1:] - 1
    for place in range((HOP - WIDTH) // STRIDE + 1, _PER_HOP):
        grid[last, place, HOP - place * STRIDE :] = PAD
    row = np.repeat(np.arange(len(sizes)), hops)
    index = np.arange(int(hop_off[-1])) - hop_off[:-1][row]
    used = np.clip(-(-(sizes[row] - index * HOP) // STRIDE), 0, _PER_HOP)
    return grid, used, hop_off


def pooled(net: Network, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hidden activations pooled by row, the chunk each came from, chunk means, chunk offsets of the rows."""
    grid, used, hop_off = laid_out(buf, off)
    sums = net.chunk_means(grid, used) * np.maximum(used, _LEAST)[:, None]
    hops = np.diff(hop_off)
    # A chunk is a hop and the next one; the last hop of a longer row is in the chunk before it.
    n_chunks = np.maximum(hops - 1, 1)
    c_off = np.concatenate([[0], np.cumsum(n_chunks)])
    row = np.repeat(np.arange(len(hops)), n_chunks)
    first = hop_off[:-1][row] + np.arange(int(c_off[-1])) - c_off[:-1][row]
    second = np.minimum(first + 1, hop_off[1:][row] - 1)
    two = (second > first)[:, None]
    n = used[first] + used[second] * two[:, 0]
    means = (sums[first] + sums[second] * two) / np.maximum(n, _LEAST)[:, None]
    h = np.maximum(means @ net.hidden + net.hidden_bias, 0)
    return np.maximum.reduceat(h, c_off[:-1], axis=0), h, means, c_off


def scores(net: Network, buf: np.ndarray, off: np.ndarray, shift: float = 0.0) -> np.ndarray:
    out = [np.zeros(0)]
    for i, j in chunks(off, 400_000):
        p = pooled(net, buf[off[i] : off[j]], off[i : j + 1] - off[i])[0]
        out.append(1 / (1 + np.exp(-(p @ net.out + net.out_bias[0] + shift).astype(np.float64))))
    return np.concatenate(out)


def _gradients(net: Network, texts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buf = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    p, h, means, c_off = pooled(net, buf, off)
    grid, used, hop_off = laid_out(buf, off)
    logit = p @ net.out + net.out_bias[0]
    err = ((1 / (1 + np.exp(-logit)) - labels) / len(labels)).astype(np.float32)
    g_out, g_out_bias = p.T @ err, np.array([err.sum()], np.float32)
    # Of each row and hidden unit only the chunk that gave the pooled value has a gradient.
    row = np.repeat(np.arange(len(texts)), np.diff(c_off))
    g_h = np.where((h == p[row]) & (h > 0), err[row][:, None] * net.out, 0).astype(np.float32)
    at = np.flatnonzero(g_h.any(1))
    g_h, m = g_h[at], means[at]
    g_hidden, g_hidden_bias = m.T @ g_h, g_h.sum(0)
    g_means = g_h @ net.hidden.T
    first = hop_off[:-1][row[at]] + at - c_off[:-1][row[at]]
    second = np.minimum(first + 1, hop_off[1:][row[at]] - 1)
    n = np.maximum(used[first] + used[second] * (second > first), _LEAST)
    g_hop = np.zeros((len(grid), FILTERS), np.float32)
    np.add.at(g_hop, first, g_means / n[:, None])
    np.add.at(g_hop, second[second > first], (g_means / n[:, None])[second > first])
    hop = np.flatnonzero(g_hop.any(1))
    x = net.embed[grid[hop]].reshape(-1, WIDTH * EMBEDDED)
    live = (x @ net.filters + net.filter_bias > 0) & (np.arange(_PER_HOP)[None, :] < used[hop][:, None]).reshape(-1)[:, None]
    g_z = np.repeat(g_hop[hop], _PER_HOP, axis=0) * live
    g_filters, g_filter_bias = x.T @ g_z, g_z.sum(0)
    g_x = (g_z @ net.filters.T).reshape(-1, EMBEDDED)
    g_embed = np.stack([np.bincount(grid[hop].reshape(-1), g_x[:, c], 257) for c in range(EMBEDDED)], 1).astype(np.float32)
    g_embed[PAD] = 0
    return [g_embed, g_filters, g_filter_bias, g_hidden, g_hidden_bias, g_out, g_out_bias]


def train(texts: list[bytes], labels: list[int], *, epochs: int = 14, batch: int = 48, rate: float = 0.01, seed: int = 2) -> Network:
    """A network fitted by Adam; the same sample gives the same network."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    data, y = [np.frombuffer(t, np.uint8) for t in texts], np.array(labels, np.float32)
    params = net.parameters()
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    epochs = max(epochs, min(120, 12_000 // max(1, len(data))))
    total = epochs * -(-len(data) // batch)
    for _ in range(epochs if data else 0):
        order = rng.permutation(len(data))
        for a in range(0, len(data), batch):
            pick = order[a : a + batch]
            step += 1
            lr = rate * (1 - 0.95 * step / total)
            for p, g, m, s in zip(params, _gradients(net, [data[i] for i in pick], y[pick]), mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


# --- on Spark -------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows that no training sees: crc32 of the doc_id as text has remainder 1 by 3 (a missing doc_id counts as empty)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[Network, float]:
    """A network from a bounded sample of labelled rows that are not held out, and the shift of the score that restores the
    classes' shares among all such labels.  Rows without doc_id or label are not used."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for y in (0, 1):
        of = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        drawn = of if drawn is None else drawn.union(of)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= sample_bytes)
    found = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()
    found.sort(key=lambda r: r.doc_id)
    net = train([r.text.encode() for r in found], [r.y for r in found])
    seen = [sum(r.y == y for r in found) for y in (0, 1)]
    shift = float(np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)) - np.log((seen[1] + 1) / (seen[0] + 1)))
    return net, shift


def score(docs: DataFrame, net: Network, shift: float = 0.0) -> DataFrame:
    """``docs`` with score (double) and predicted (int): whole texts, empty, null and very long ones too.  Columns of these
    names are replaced; nothing but the text counts, so equal texts tie; repeated rows and nulls in other columns stay; an
    empty table stays empty."""
    docs = bounded(docs).drop("score", "predicted")
    net_everywhere = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = net_everywhere.value
        for batch in batches:
            s = scores(net, *byte_buffer(batch.column("text").cast(pa.string())), shift)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.  Repeated rows and null doc_ids stay; without labels every score is that
    of an untrained network.  Null texts are scored as empty ones; very long texts count whole, chunk by chunk; equal texts
    have equal scores; an empty table gives an empty result; other columns are dropped."""
    net, shift = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(rows, net, shift).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of good quality, with all their columns, clashing names too.  Null and
    empty texts are judged as an empty text, very long ones whole; equal texts share their fate; an empty table stays empty."""
    net, shift = fit(docs, labels)
    free, restored = set_aside(docs, ("score", "predicted"))
    return restored(score(free, net, shift).where("predicted = 1"))
