"""A quality classifier: random-indexing word vectors, pooled per document, then a two-layer network in numpy.

Words are hashed into `buckets` rows. Each row has a fixed sparse ternary index vector; its context vector sums the index
vectors of its neighbours over all documents, so the statistics are a matrix of fixed size whatever the corpus. Documents
are pooled from the normed context vectors of their words; only this fixed number of values per document is joined with
labels and learnt from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BUCKETS, SIZE, NONZERO, REACH = 1 << 14, 64, 4, 2
#: Parts in which the matrix of sums travels.
BLOCKS = 64
#: Words that are gathered before their counts are added, and after which a long document's sums are taken up.
TOKENS = 1 << 20
PIECE = 1 << 15
#: Labelled documents to learn from, at most; drawn by the hash of their id.
MOST_LABELLED = 20_000
HIDDEN, EPOCHS, RATE = 32, 40, 0.003


class Buckets(dict):
    """Words → rows, found once each."""

    def __missing__(self, word: str) -> int:
        row = self[word] = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return row

    def rows(self, text: str | None) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        words = (text or "").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of each row's NONZERO entries."""
    rng = np.random.default_rng(7)
    return rng.integers(0, SIZE, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in; (block, sums) out, this partition's sums over neighbours up to REACH words away, as packed() blocks of rows."""
    places, signs = index_vectors()
    buckets, sums = Buckets(), np.zeros(BUCKETS * SIZE)

    def add(parts: list[np.ndarray]) -> None:
        gap = np.full(REACH, -1)
        rows = np.concatenate([x for p in parts for x in (p, gap)])
        for reach in range(1, REACH + 1):
            a, b = rows[:-reach], rows[reach:]
            both = (a >= 0) & (b >= 0)
            a, b = a[both], b[both]
            for own, other in ((a, b), (b, a)):
                for k in range(NONZERO):
                    sums[:] += np.bincount(own * SIZE + places[other, k], signs[other, k], BUCKETS * SIZE)

    held, size = [], 0
    for b in batches:
        for t in b.column(0):
            held.append(buckets.rows(t.as_py()))
            size += len(held[-1])
            if size >= TOKENS:
                add(held)
                held, size = [], 0
    if held:
        add(held)
    yield packed(sums.astype(np.int64).reshape(BLOCKS, -1))


def packed(blocks: np.ndarray) -> pa.RecordBatch:
    """A row per block that isn't all zero. Most sums of a partition are small: with the sign as lowest bit and the bytes of
    equal weight side by side, they compress well."""
    signed = (blocks << 1) ^ (blocks >> 63)
    planes = np.ascontiguousarray(signed.astype("<i8")).view(np.uint8).reshape(len(blocks), -1, 8).transpose(0, 2, 1)
    rows = [(i, zlib.compress(planes[i].tobytes(), 1)) for i, x in enumerate(blocks) if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "sums"])


def unpacked(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(block), np.uint8).reshape(8, -1)
    signed = np.ascontiguousarray(planes.T).view("<i8").ravel()
    return (signed >> 1) ^ -(signed & 1)


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks that come; at most the whole matrix is held."""
    sums = np.zeros((BLOCKS, BUCKETS * SIZE // BLOCKS), np.int64)
    for b in batches:
        for i, x in zip(b.column(0).to_pylist(), b.column(1)):
            sums[i] += unpacked(x.as_py())
    yield packed(sums)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS unit vectors of SIZE from the texts of all docs; sums are made before the shuffle and after it."""
    own = docs.select("text").mapInArrow(context_sums, "block int, sums binary")
    table = np.zeros((BLOCKS, BUCKETS * SIZE // BLOCKS))
    for r in own.repartition("block").mapInArrow(add_blocks, "block int, sums binary").collect():  # BLOCKS rows at most
        table[r["block"]] += unpacked(r["sums"])
    table = table.reshape(BUCKETS, SIZE)
    table = np.sign(table) * np.log1p(np.abs(table))
    table -= table.mean(axis=0)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: str | None, buckets: Buckets, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the word vectors, the cosine of neighbours, the logarithm of the number of words."""
    rows = buckets.rows(text)
    n = len(rows)
    out = np.zeros(2 * SIZE + 2)
    if not n:
        return out
    total, squares, along = np.zeros(SIZE), np.zeros(SIZE), 0.0
    for i in range(0, n, PIECE):
        x = vectors[rows[i : i + PIECE + 1]]
        along += float(np.einsum("ij,ij->", x[1:], x[:-1]))
        x = x[:PIECE]
        total += x.sum(axis=0)
        squares += np.einsum("ij,ij->j", x, x)
    mean = total / n
    out[:SIZE], out[SIZE : 2 * SIZE] = mean, np.sqrt(np.maximum(squares / n - mean**2, 0))
    out[-2], out[-1] = along / n, np.log1p(n) / 10
    return out


@dataclass
class Network:
    """Two layers on standardized features; scores are logits over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Learns from four fifths of the rows by Adam; sets the temperature on the rest. Without rows of both classes: their smoothed share."""
    rng = np.random.default_rng(11)
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        size = 2 * SIZE + 2
        return Network(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network(
        x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), float(np.log(share / (1 - share)))
    )
    z = (x - net.mean) / net.scale
    names = ["w1", "b1", "w2", "b2"]
    m, v, step = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), 0
    for _ in range(EPOCHS):
        rng.shuffle(own)
        for i in range(0, len(own), 128):
            b = own[i : i + 128]
            h = np.tanh(z[b] @ net.w1 + net.b1)
            d = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30))) - y[b]) / len(b)
            back = np.outer(d, net.w2) * (1 - h**2)
            grads = {"w1": z[b].T @ back + 1e-4 * net.w1, "b1": back.sum(axis=0), "w2": h.T @ d + 1e-4 * net.w2, "b2": d.sum()}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                setattr(net, k, getattr(net, k) - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    if len(held):
        logits = net.logits(x[held])
        heats = np.geomspace(0.25, 8, 61)
        losses = [np.mean(np.logaddexp(0, np.where(y[held] == 1, -1, 1) * logits / t)) for t in heats]
        net.temperature = float(heats[int(np.argmin(losses))])
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """One row for each of docs (doc_id, text): doc_id, held_out, score (0 to 1, rounded to 6 digits), predicted.

    Labels (doc_id, quality) are learnt from where crc32 of the id as text, modulo 4, isn't 2, from at most `most_labelled`
    rows; rows without quality are no labels. Word statistics come from all texts. A document's label, lang, source and id
    don't enter its score; null and empty texts are scored as texts without words. Further columns are ignored. Null ids
    are never held out and have no label; repeated rows are scored alike; an empty table gives an empty one."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            x = [pooled(t.as_py(), buckets, vectors.value) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])

    features = materialize(docs.select("doc_id", "text").mapInArrow(pool, "doc_id long, x array<float>"), "features")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    known = labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y")).where(~held_out)
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_labelled)  # so few that they are broadcast
    chosen = features.join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_labelled).toArrow()
    x = np.array(chosen.column("x").to_pylist(), float).reshape(chosen.num_rows, 2 * SIZE + 2)
    network = fit(x, (chosen.column("y").to_numpy() > 0).astype(float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, 2 * SIZE + 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(network.scores(x.astype(float)))], ["doc_id", "score"])

    scored = features.mapInArrow(score, "doc_id long, score double").withColumn("score", F.round("score", 6))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
