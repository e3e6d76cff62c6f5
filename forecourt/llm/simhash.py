"""SimHash near-duplicate detection: exact comparison of fingerprints in tiles, with exclusive-or and bit counts in numpy.

All pairs within the radius are found. Comparing every tile of the corpus with every other would be quadratic, so the
tiles are laid out by the pigeonhole principle: of radius + 1 blocks of bits, two fingerprints within the radius share
one unchanged. Fingerprints with a common block meet in a cell; inside a cell they are sorted by population count and
cut into tiles, and tile pairs whose counts lie further apart than the radius are skipped. In a cell with more than
`cell_rows` fingerprints the other bits are blocks again: twice as many as the radius, half of which stay unchanged, so
that its fingerprints meet in smaller cells by a block and some of its others. What is dense even so holds copies that
differ in few bits; its cells are dealt in parts, of which each pair is compared in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, connected_components, materialize

BITS = 64
#: Ids on several rows that are broadcast at most.
MOST_REPEATED = 500_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 if set in over half of the shingles' hashes. No word: 0. Fewer words than a shingle: their sequence is the only one."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(42)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fp), one for each row of docs; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def tile_links(fps: np.ndarray, radius: int, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all distinct fingerprints within the radius, tile pair by tile pair."""
    counts = np.bitwise_count(fps)
    order = np.argsort(counts, kind="stable")
    fps, counts = fps[order], counts[order].astype(np.int64)
    left, right = [], []
    for i in range(0, len(fps), tile):
        for j in range(i, len(fps), tile):
            if counts[j] - counts[min(i + tile, len(fps)) - 1] > radius:
                break
            near = np.bitwise_count(fps[i : i + tile, None] ^ fps[None, j : j + tile]) <= radius
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            keep = a < b
            left.append(order[a[keep]])
            right.append(order[b[keep]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected to: as much as n edges, however many links there are."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def link_cells(batches: Iterator[pa.RecordBatch], radius: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell in; edges out, a spanning forest of each run of whole cells. Holds one such run and a batch."""

    def edges(fps: np.ndarray) -> pa.RecordBatch:
        fps = np.unique(fps)
        label = forest(len(fps), *tile_links(fps, radius))
        joined = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[x].view(np.int64)) for x in (label[joined], joined)], ["a", "b"])

    cells, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for b in batches:
        cells = np.concatenate([cells, b.column(0).to_numpy()])
        fps = np.concatenate([fps, b.column(1).to_numpy().view(np.uint64)])
        ends = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        at = 0
        while (k := np.searchsorted(ends, at + chunk)) < len(ends):
            yield edges(fps[at : ends[k]])
            at = ends[k]
        cells, fps = cells[at:], fps[at:]
    if len(fps):
        yield edges(fps)


def bits_at(lo: int, hi: int) -> Column:
    """Bits lo to hi of fp, hi excluded."""
    return F.shiftrightunsigned(F.shiftleft("fp", BITS - hi), BITS - hi + lo)


def cuts(spans: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """Spans of bits as n blocks of about equal size; a block may lie in two spans."""
    bits = [i for lo, hi in spans for i in range(lo, hi)]
    edges = [len(bits) * i // n for i in range(n + 1)]
    blocks = []
    for a, b in zip(edges, edges[1:]):
        own = bits[a:b]
        breaks = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1] + 1), len(own)]
        blocks.append([(own[x], own[y - 1] + 1) for x, y in zip(breaks, breaks[1:])])
    return blocks


def cells(nodes: DataFrame, radius: int, cell_rows: int) -> DataFrame:
    """Rows (cell, fp): any two fingerprints of nodes (fp, distinct) within the radius have a cell in common."""
    first = [blocks[0] for blocks in cuts([(0, BITS)], radius + 1)]
    each = F.array(*[F.struct(F.lit(i).alias("block"), F.xxhash64(F.lit(i), bits_at(*b)).alias("cell")) for i, b in enumerate(first)])
    keys = nodes.select("fp", F.explode(each).alias("k")).select("fp", "k.block", "k.cell")

    def split(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of cells of up to cell_rows fingerprints, and of the others with their number, n."""
        large = keys.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
        joined = keys.join(large, "cell", "left")
        return joined.where("n IS NULL").drop("n"), joined.where("n IS NOT NULL")

    small, dense = split(keys)
    finer = []
    for i, own in enumerate(first):
        rest = cuts([b for b in first if b != own], 2 * radius)
        for chosen in combinations(rest, radius):
            values = [bits_at(*span) for block in chosen for span in block]
            finer.append(F.when(F.col("block") == i, F.xxhash64("cell", F.lit(str(chosen)), *values)))
    smaller = dense.select("fp", F.explode(F.array_compact(F.array(*finer))).alias("cell"))
    fine, densest = split(smaller)
    parts = F.ceil(F.col("n") / cell_rows).cast("int")
    dealt = densest.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
    return small.select("cell", "fp").unionByName(fine.select("cell", "fp")).unionByName(dealt)


def fingerprint_components(nodes: DataFrame, radius: int = 2, cell_rows: int = 1024) -> DataFrame:
    """Rows (fp, label) for the fingerprints of nodes (fp long, distinct) that have a link; equal labels: linked, directly or through others."""
    own = cells(nodes, radius, cell_rows)
    edges = own.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda it: link_cells(it, radius, 512), "a long, b long")
    return connected_components(edges).select(F.col("node").alias("fp"), "label")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, cell_rows: int = 1024) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of docs (doc_id, text; further columns are ignored).

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id that links of at most `radius` differing bits
    reach, itself included. Null text counts as empty; empty texts have fingerprint zero and link like any other. A null
    doc_id gets its component's smallest doc_id, or null where that has none. Repeated rows are kept. Empty in, empty out.
    Copies meet before anything is compared: only distinct fingerprints enter cells."""
    of = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(of.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    labels = fingerprint_components(nodes.select("fp"), radius, cell_rows)
    named = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    component = named.join(lowest, "label").select("fp", "component_id")
    return of.join(component, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3, cell_rows: int = 1024) -> DataFrame:
    """docs without near duplicates: of each group one row stays, that with the smallest doc_id, nulls last; of several with
    that id, the one with the smallest text, then any one of them. Rows with neither a doc_id nor a word pass unjudged.
    Rows, not ids, are judged: an id that stands on several texts loses none of them. Further columns stay, whatever they are."""
    fields = [F.col(f"`{c}`") for c in docs.columns]
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*fields).alias("doc")), "numbered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["row", "doc_id", "fp"])

    wordless = F.col("doc.doc_id").isNull() & ~F.coalesce("doc.text", F.lit("")).rlike(WORD)
    judged = numbered.where(~wordless).select("row", "doc.doc_id", "doc.text")
    of = materialize(judged.mapInArrow(run, "row long, doc_id long, fp long"), "fingerprints")
    # Only ids on several rows need their texts to choose by.
    repeated = materialize(of.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    repeated = F.broadcast(repeated) if repeated.count() <= MOST_REPEATED else repeated
    texts = judged.join(repeated, "doc_id", "left_semi").select("row", "text").unionByName(judged.where("doc_id IS NULL").select("row", "text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text", "row")
    first = materialize(of.join(texts, "row", "left").groupBy("fp").agg(F.min(order).alias("first")), "first")
    labels = fingerprint_components(first.select("fp"), radius, cell_rows)
    chosen = first.join(labels, "fp", "left").groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("first").alias("first"))
    rows = chosen.select(F.col("first.row").alias("row"))
    kept = numbered.where(~wordless).join(rows, "row", "left_semi").select("doc").unionByName(numbered.where(wordless).select("doc"))
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
