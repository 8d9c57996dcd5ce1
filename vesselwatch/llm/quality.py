"""Text quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered whole by overlapping chunks. In a chunk, learned filters of ``WIDTH`` bytes
slide by ``STRIDE``; a filter's response is a sum of one learned weight for each of its bytes. The responses
are max-pooled over the chunk and combined to a chunk logit; the mean of the chunk logits gives one
probability. Max pooling over chunks also shows what a chunk lacks, as in repeated text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselwatch.llm.common import bounded_batches

CHUNK, OVERLAP, WIDTH, STRIDE, FILTERS = 512, 32, 8, 4, 16
#: Labelled texts that the network is fitted on, at most, their bytes, about, and passes over them.
SAMPLE, SAMPLE_BYTES, EPOCHS = 6000, 48 << 20, 10
#: Chunks of one text that a step of the fit draws, about.
STEP_CHUNKS = 12
#: Texts up to this score count as low quality.
THRESHOLD = 0.3


def chunks(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes padded by zeros, first place of each position's window, first position of each chunk, first chunk of each text).

    Every text has at least one chunk and every chunk one position; an empty text is one of zeros.
    """
    step = CHUNK - OVERLAP
    flat, places, chunk_starts, text_starts = [], [], [], []
    at = positions = n_chunks = 0
    for text in texts:
        size = max(len(text), 1)
        text_starts.append(n_chunks)
        for lo in range(0, max(size - OVERLAP, 1), step):
            n = max(1, -(-(min(lo + CHUNK, size) - lo - WIDTH) // STRIDE) + 1)
            places.append((at + lo, n))
            chunk_starts.append(positions)
            positions += n
            n_chunks += 1
        flat.append(text)
        pad = WIDTH + STRIDE + (not text)
        flat.append(bytes(pad))
        at += len(text) + pad
    first, n = np.array(places, np.int64).reshape(-1, 2).T
    starts = np.array(chunk_starts, np.int64)
    windows = np.repeat(first, n) + (np.arange(positions) - np.repeat(starts, n)) * STRIDE
    return np.frombuffer(b"".join(flat), np.uint8), windows, starts, np.array(text_starts, np.int64)


class ByteNet:
    """``filters`` [WIDTH * 256, FILTERS] and ``bias`` of the convolution; ``weights`` and ``offset`` of the chunk logit."""

    def __init__(self, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.filters = (rng.standard_normal((WIDTH * 256, FILTERS)) * 0.3).astype(np.float32)
        self.weights = (rng.standard_normal(FILTERS) * 0.3).astype(np.float32)
        self.offset = np.float32(0)

    def responses(self, data: np.ndarray, windows: np.ndarray) -> np.ndarray:
        out = self.filters[data[windows]]
        for j in range(1, WIDTH):
            out += self.filters[data[windows + j].astype(np.int64) + 256 * j]
        return out

    def pooled(self, data: np.ndarray, windows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Max of each filter over each chunk, positive part; a bounded number of chunks at a time."""
        out = np.empty((len(starts), FILTERS), np.float32)
        ends = np.append(starts[1:], len(windows))
        for lo in range(0, len(starts), 128):
            hi = min(lo + 128, len(starts))
            r = self.responses(data, windows[starts[lo] : ends[hi - 1]])
            out[lo:hi] = np.maximum.reduceat(r, starts[lo:hi] - starts[lo])
        return np.maximum(out, 0)

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        data, windows, starts, firsts = chunks(texts)
        logits = self.pooled(data, windows, starts).astype(np.float64) @ self.weights.astype(np.float64) + float(self.offset)
        mean = np.add.reduceat(logits, firsts) / np.diff(np.append(firsts, len(starts)))
        return 1 / (1 + np.exp(-np.clip(mean, -40, 40)))

    def fit(self, texts: Sequence[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.03) -> ByteNet:
        """Adam on the log loss of the texts' probabilities, both classes weighing the same, in batches of 64 texts."""
        names = ("filters", "weights", "offset")
        moments = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in names}
        rng = np.random.Generator(np.random.PCG64(3))
        good = min(max(labels.mean(), 0.01), 0.99)
        weight = np.where(labels == 1, 0.5 / good, 0.5 / (1 - good))
        t = 0
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs)
            order = rng.permutation(len(texts))
            for at in range(0, len(order), 64):
                t += 1
                part = order[at : at + 64]
                grads = self._gradients([texts[k] for k in part], labels[part], weight[part], rng)
                for k in names:
                    m, v = moments[k]
                    m = 0.9 * m + 0.1 * grads[k]
                    v = 0.999 * v + 0.001 * grads[k] ** 2
                    moments[k] = (m, v)
                    setattr(self, k, (getattr(self, k) - pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
        return self

    def _gradients(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        data, windows, starts, firsts = chunks(texts)
        n_chunks = np.diff(np.append(firsts, len(starts)))
        # a step draws some chunks of long texts; scoring reads them all
        drawn = rng.random(len(starts)) < np.repeat(np.minimum(1, STEP_CHUNKS / n_chunks), n_chunks)
        drawn[firsts] = True
        chunk_text = np.repeat(np.arange(len(texts)), n_chunks)[drawn]
        sizes = np.diff(np.append(starts, len(windows)))
        windows, sizes = windows[np.repeat(drawn, sizes)], sizes[drawn]
        starts = np.cumsum(sizes) - sizes
        r = self.responses(data, windows)
        top = np.maximum.reduceat(r, starts)
        pooled = np.maximum(top, 0)
        per_text = np.bincount(chunk_text, minlength=len(texts))
        logits = np.bincount(chunk_text, pooled @ self.weights, minlength=len(texts)) / per_text + self.offset
        error = weight * (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - labels) / len(texts)
        share = (error / per_text)[chunk_text]
        grads = {"filters": 1e-5 * self.filters, "weights": (1e-4 * self.weights + share @ pooled).astype(np.float32), "offset": np.float32(error.sum())}
        place, column = (r == np.repeat(top, sizes, axis=0)).nonzero()
        chunk = np.repeat(np.arange(len(starts)), sizes)[place]
        _, first = np.unique(chunk * FILTERS + column, return_index=True)
        first = first[top[chunk[first], column[first]] > 0]
        place, column, chunk = place[first], column[first], chunk[first]
        step = (share[chunk] * self.weights[column]).astype(np.float32)
        for j in range(WIDTH):
            np.add.at(grads["filters"], (data[windows[place] + j].astype(np.int64) + 256 * j, column), step)
        return grads


def is_held_out(doc_id: Column) -> Column:
    """True for a fifth of the ids, by the CRC-32 of the id as text; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, sample_bytes: int = SAMPLE_BYTES) -> ByteNet | None:
    """A network fitted on at most ``sample`` labelled texts outside the held-out fifth; None without any.

    ``docs``: (doc_id, text), ``labels``: (doc_id, quality 0/1). The sample is that of the smallest hashes of
    ids, as far as it has ``sample_bytes`` bytes; both classes keep their shares. Of repeated ids in ``docs`` all rows count.
    """
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows: broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "quality")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # two numbers of each, to see how many fit
    sizes = np.array([r["n"] for r in rows.select("doc_id", F.octet_length("text").alias("n")).orderBy(*order, "n").limit(sample).collect()])
    fit = int(np.searchsorted(np.cumsum(sizes), sample_bytes, "right"))
    found = rows.orderBy(*order, F.octet_length("text")).limit(max(1, fit)).collect() if len(sizes) else []
    if not found:
        return None
    return ByteNet().fit([r["text"].encode() for r in found], np.array([r["quality"] for r in found], np.float64), epochs)


def _scorer(net):
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):
            out.append(net.value.scores([(t or "").encode() for t in texts[at : at + 256].to_pylist()]))
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return run


def score_quality(docs: DataFrame, net: ByteNet | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: the probability that a text is of good quality, from its whole text alone.

    Defined cases: null and empty texts get the score of the empty text; without a network (no labels)
    every score is 0.5; long texts are read whole; repeated rows are scored alike; an empty table gives an empty
    result; a column called as ``score_col`` is replaced, all others pass through.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if net is None:
        return docs.withColumn(score_col, F.lit(0.5))
    shipped = spark.sparkContext.broadcast(net)  # WIDTH * 256 * FILTERS numbers, whatever the data
    return docs.withColumn(score_col, F.arrow_udf(_scorer(shipped), "double")(F.coalesce(F.col(text_col), F.lit(""))))
