"""Benchmark decontamination: every training passage queries a BM25 index of the test items by block-max WAND.

Index terms are pairs of neighbouring words; their frequencies and the mean length are taken over the whole benchmark. The
index is built in shards of about SHARD items and SHARD_WORDS words. One shard is broadcast; of more, each lies in the
shared folder and a task takes them in turn for every HELD_BYTES of documents, so that one shard is in memory
at a time and documents are read once. They are neither shuffled nor cut: a passage whose summed term maxima stay below
the lowest threshold is skipped in numpy, the others walk the postings. What is retrieved is verified on word shingles.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import parquet
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path
from .common import file_system, map_rows, materialize

PASSAGE, STRIDE = 64, 32
SHINGLE, SIMILARITY = 5, 0.8
#: Of an item's score for itself, in proportion to what the passage that lies best on it holds of it at least.
SHARE = 0.5
K1, B = 1.2, 0.75
#: Parts of fewer words have less than 0.8 of their runs left when one word is changed, and are judged by their words too.
SHORT = SHINGLE - 1 + 5 * SHINGLE
SHARD, SHARD_WORDS = 5_000, 300_000
#: Documents that a task holds while it takes one shard after the other.
HELD_BYTES = 64 << 20
BLOCK = 8
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def term(raw: str) -> str:
    """A word without case and without signs at its ends; '' if nothing is left."""
    return EDGE.sub("", raw.lower())


def terms(text: str | None) -> list[str]:
    return [t for t in map(term, (text or "").split()) if t]


def shingles(words: list) -> set:
    """Runs of five words; of fewer, the whole."""
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The last sentence is the answer, what stands before it the question; a lone sentence is both."""
    parts = [t for t in map(terms, SENTENCE.split(text or "")) if t]
    if len(parts) < 2:
        return (parts * 2 + [[], []])[0], (parts * 2 + [[], []])[1]
    return [t for p in parts[:-1] for t in p], parts[-1]


def in_order(words: list[str], places: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence of words and n others, of which places has the positions as bits."""
    full = (1 << n) - 1
    v = full
    for w in words:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def nearly(part: list[str], found: int) -> bool:
    """Whether so many of its words are 0.8 of the part, or all but one."""
    return found >= min(SIMILARITY * len(part), len(part) - 1)


def held_by_words(parts: tuple[list[str], list[str]], whole: list[str], words: list[str]) -> bool:
    """Whether one stretch of words has 0.8 of the item's words in order, and of each part 0.8 or all but one.

    A stretch lies where neighbouring words are about as far from each other as in the item, with room for words added: with
    a fifth of its words lost and as many added, 0.4 of its pairs are left."""
    at = defaultdict(list)
    for i, pair in enumerate(zip(whole, whole[1:])):
        at[pair].append(i)
    shifts = Counter(k - i for k, pair in enumerate(zip(words, words[1:])) for i in at.get(pair, ()))
    room = max(2, len(whole) // 5)
    near = Counter({s: sum(shifts[s + k] for k in range(-room, room + 1)) for s in shifts})
    for s, n in near.most_common():
        if n < 0.4 * len(whole) - 1:
            break
        own = words[max(0, s - room) : s + len(whole) + room]
        places: dict[str, int] = defaultdict(int)
        for k, w in enumerate(own):
            places[w] |= 1 << k
        if in_order(whole, places, len(own)) >= SIMILARITY * len(whole) and all(nearly(p, in_order(p, places, len(own))) for p in parts):
            return True
    return False


@dataclass
class Statistics:
    """Of the whole benchmark: items, their mean number of terms, and in how many items a term is."""

    n: int
    mean: float
    frequency: dict[tuple[str, str], int]

    @staticmethod
    def of(bags: list[Counter]) -> Statistics:
        return Statistics(len(bags), sum(sum(b.values()) for b in bags) / max(1, len(bags)), Counter(t for b in bags for t in b))


class Index:
    """Postings of a shard. Slots number its items; of each list, every BLOCK slots keep their largest weight.

    Without statistics, those of the shard itself stand for the benchmark's."""

    def __init__(self, items: list[tuple[int, str | None]], statistics: Statistics | None = None):
        self.ids, self.parts, bags = [], [], []
        for item_id, text in items:
            question, answer = question_and_answer(text)
            own = terms(text)
            if len(own) > 1:
                self.ids.append(item_id)
                self.parts.append((question, answer))
                bags.append(Counter(zip(own, own[1:])))
        statistics = statistics or Statistics.of(bags)
        n, mean, frequency = statistics.n, statistics.mean, statistics.frequency
        own = {t for b in bags for t in b}
        self.word_id = {w: i for i, w in enumerate(sorted({w for pair in own for w in pair}))}
        code = {(a, b): self.word_id[a] * len(self.word_id) + self.word_id[b] for a, b in own}
        self.codes = np.array(sorted(code.values()), np.int64)
        self.term_id = {pair: int(i) for pair, i in zip(code, np.searchsorted(self.codes, list(code.values())))}
        self.postings: list[dict[int, float]] = [{} for _ in own]
        self.threshold = []
        for slot, bag in enumerate(bags):
            long = sum(bag.values())
            held = min(1, min(PASSAGE, (long + 1 + STRIDE) / 2) / (long + 1))
            total = 0.0
            for t, f in bag.items():
                weight = math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * long / mean))
                self.postings[self.term_id[t]][slot] = weight
                total += weight
            self.threshold.append(SHARE * total * held)
        self.slots = [list(p) for p in self.postings]
        self.blocks = []
        for p in self.postings:
            best: dict[int, float] = defaultdict(float)
            for slot, weight in p.items():
                best[slot // BLOCK] = max(best[slot // BLOCK], weight)
            self.blocks.append(best)
        self.most = np.array([max(p.values()) for p in self.postings] + [0.0])
        self.lowest = min(self.threshold, default=math.inf)
        self.low_block = [min(self.threshold[i : i + BLOCK]) for i in range(0, len(bags), BLOCK)]

    def retrieve(self, query: list[int]) -> Iterator[tuple[int, float]]:
        """(slot, score) of all items at or above their threshold for these distinct terms: WAND with block maxima."""
        ends = len(self.ids)
        cursor = [(self.slots[t][0], t) for t in query]
        while cursor:
            cursor.sort()
            bound, pivot = 0.0, None
            for slot, t in cursor:
                bound += self.most[t]
                if bound >= self.lowest:
                    pivot = slot
                    break
            if pivot is None:
                return
            block = pivot // BLOCK
            if sum(self.blocks[t].get(block, 0.0) for _, t in cursor) < self.low_block[block]:
                target = (block + 1) * BLOCK
            else:
                score = sum(self.postings[t].get(pivot, 0.0) for _, t in cursor)
                if score >= self.threshold[pivot]:
                    yield pivot, score
                target = pivot + 1
            if target >= ends:
                return
            moved = []
            for slot, t in cursor:
                if slot < target:
                    own = self.slots[t]
                    at = bisect_left(own, target)
                    if at == len(own):
                        continue
                    slot = own[at]
                moved.append((slot, t))
            cursor = moved


class Words(dict):
    """Raw words → ids of their terms, found once each; -1 without a term, `other` for those that no item has."""

    def __init__(self, word_id: dict[str, int]):
        self.word_id, self.other = word_id, len(word_id)

    def __missing__(self, raw: str) -> int:
        t = term(raw)
        found = self[raw] = self.word_id.get(t, self.other) if t else -1
        return found


class Searcher:
    """Finds what a document leaks; remembers `cached` words at most."""

    def __init__(self, index: Index, cached: int = 500_000):
        self.index, self.cached = index, cached
        self.known = Words(index.word_id)

    def term_ids(self, text: str) -> np.ndarray:
        """The term that begins at each word; the number of terms stands for pairs that no item has."""
        raw = text.split()
        if len(self.known) > self.cached:
            self.known.clear()
        index, other = self.index, self.known.other
        words = np.fromiter(map(self.known.__getitem__, raw), np.int64, len(raw))
        words = words[words >= 0]
        ids = np.full(max(0, len(words) - 1), len(index.codes))
        both = np.flatnonzero((words[:-1] < other) & (words[1:] < other))
        code = words[both] * other + words[both + 1]
        at = np.minimum(np.searchsorted(index.codes, code), len(index.codes) - 1)
        ids[both] = np.where(index.codes[at] == code, at, len(index.codes)) if len(both) else at
        return ids

    def leaks(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question overlap, answer overlap) of each item that the document holds."""
        index = self.index
        if not index.ids:
            return []
        ids = self.term_ids(text or "")
        sums = np.concatenate([[0.0], np.cumsum(index.most[ids])])
        starts = np.arange(0, max(1, len(ids) - PASSAGE + STRIDE), STRIDE)
        stops = np.minimum(starts + PASSAGE, len(ids))
        found: dict[int, float] = {}
        other = len(index.postings)
        for k in np.flatnonzero(sums[stops] - sums[starts] >= index.lowest * (1 - 1e-9)):
            query = np.unique(ids[starts[k] : stops[k]])
            query = query[query < other]
            if index.most[query].sum() >= index.lowest:
                for slot, score in index.retrieve(query.tolist()):
                    found[slot] = max(found.get(slot, 0.0), score)
        if not found:
            return []
        words = terms(text)
        held = {n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} for n in range(1, SHINGLE + 1)}
        leaks = []
        for slot, score in sorted(found.items()):
            shares = []
            for part in index.parts[slot]:
                own = shingles(part)
                shares.append(sum(s in held[len(s)] for s in own) / len(own))
            if min(shares) >= SIMILARITY or self.nearly_held(index.parts[slot], shares, words, held):
                leaks.append((index.ids[slot], score, *shares))
        return leaks

    def nearly_held(self, parts: tuple[list[str], list[str]], shares: list[float], words: list[str], held: dict[int, set]) -> bool:
        """Whether the item's runs as a whole reach 0.8, or it is held but for words of short parts."""
        question, answer = parts
        whole = question if question is answer else question + answer
        own = shingles(whole)
        if sum(s in held[len(s)] for s in own) >= SIMILARITY * len(own):
            return True
        if any(share < SIMILARITY and len(part) >= SHORT for share, part in zip(shares, parts)):
            return False
        return held_by_words(tuple(p for p, share in zip(parts, shares) if share < SIMILARITY), whole, words)


PAIR_COUNTS = "shard int, a string, b string, n long"


def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, text) in; for each pair of neighbouring words the items of this part that have it. A pair of nulls counts the
    items themselves, one of '' their terms."""
    for b in batches:
        counts: Counter = Counter()
        for shard, text in zip(b.column(0).to_pylist(), b.column(1)):
            own = terms(text.as_py())
            if len(own) > 1:
                counts.update((shard, *pair) for pair in set(zip(own, own[1:])))
                counts[shard, None, None] += 1
                counts[shard, "", ""] += len(own) - 1
        rows = [(*k, n) for k, n in counts.items()]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["shard", "a", "b", "n"])


def build_shards(benchmark: DataFrame) -> tuple[DataFrame, int, str]:
    """Rows (shard, index), pickled, of benchmark (item_id, text), their number and where they lie.

    Each shard is built by a task of its own; of the statistics it is given those of its own pairs."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.count("*"), F.sum(F.size(F.split("text", r"\s+")))).first()
    shards = max(1, math.ceil(size[0] / SHARD), math.ceil((size[1] or 0) / SHARD_WORDS))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    of_shards = materialize(items.select("shard", "text").mapInArrow(pair_counts, PAIR_COUNTS).groupBy("shard", "a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    whole = of_shards.groupBy("a", "b").agg(F.sum("n").alias("frequency"))
    totals = {r["a"]: r["frequency"] for r in whole.where("a IS NULL OR a = ''").collect()}  # two numbers
    n, length = totals.get(None, 0), totals.get("", 0)
    frequencies = of_shards.where("a <> ''").join(whole, ["a", "b"]).select("shard", "a", "b", "frequency")

    def build(key: tuple, items: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        frequency = dict(zip(zip(pairs["a"], pairs["b"]), pairs["frequency"].tolist()))
        own = sorted(zip((None if pd.isna(i) else int(i) for i in items["item_id"]), items["text"]), key=str)
        return pd.DataFrame({"shard": [key[0]], "index": [pickle.dumps(Index(own, Statistics(n, length / max(1, n), frequency)))]})

    built = items.groupBy("shard").cogroup(frequencies.groupBy("shard")).applyInPandas(build, "shard int, index binary")
    path = new_path(benchmark.sparkSession, "benchmark-index")
    built.repartition(shards, "shard").write.partitionBy("shard").parquet(path)
    return benchmark.sparkSession.read.schema("index binary, shard int").parquet(path), shards, path


class Shards:
    """The searchers of all shards, one at a time in memory."""

    def __init__(self, load: Callable[[int], bytes | None], n: int):
        self.load, self.n, self.at, self.searcher = load, n, -1, None

    def each(self) -> Iterator[Searcher]:
        for k in range(self.n):
            if k != self.at:
                self.searcher = None
                found = self.load(k)
                self.at, self.searcher = k, Searcher(pickle.loads(found) if found else Index([]))
            yield self.searcher


def indexes(benchmark: DataFrame) -> Callable[[], Shards]:
    """What tasks call for the shards of benchmark (item_id, text)."""
    built, shards, path = build_shards(benchmark)
    if shards == 1:
        found = built.first()
        sent = benchmark.sparkSession.sparkContext.broadcast(bytes(found["index"]) if found else b"")
        return lambda: Shards(lambda k: sent.value, 1)

    def load(k: int) -> bytes | None:
        fs, root = file_system(f"{path}/shard={k}")
        for f in fs.get_file_info(FileSelector(root, allow_not_found=True)):
            if f.path.endswith(".parquet"):
                return parquet.read_table(f.path, columns=["index"], filesystem=fs, partitioning=None).column(0)[0].as_py()
        return None

    return lambda: Shards(load, shards)


def searched(batches: Iterator[pa.RecordBatch], shards: Shards, held_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
    """Each batch with what its documents leak, from all shards; batches have a column text. Up to held_bytes are held, and a batch."""
    held, size = [], 0

    def taken() -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
        found: list[list[list[tuple]]] = [[[] for _ in range(b.num_rows)] for b in held]
        for searcher in shards.each():
            for b, own in zip(held, found):
                for leaks, text in zip(own, b.column("text")):
                    leaks += searcher.leaks(text.as_py())
        yield from zip(held, found)

    for b in batches:
        held.append(b)
        size += b.nbytes
        if shards.n == 1 or size >= held_bytes:
            yield from taken()
            held, size = [], 0
    if held:
        yield from taken()


def contaminated(docs: DataFrame, benchmark: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, score, question_overlap, answer_overlap.

    docs (doc_id, text) and benchmark (item_id, text); further columns are ignored. Words are compared without case and
    without signs at their ends. score: the best of the document's passages. The overlaps are shares of the question's
    and answer's runs of five words that the document has too. Reported is where both are 0.8 or more, where those of the item
    as a whole are, or where what is less is a part of under SHORT words and a stretch of the document has, in order, 0.8 of
    the item's words and 0.8 or all but one of that part's. Null and empty texts hold nothing; null, empty and one-word
    items are in nothing. Null ids and repeated rows are reported as they come; an empty table on either side gives an empty one.
    Scores don't depend on the number of shards."""
    shards = indexes(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in searched(batches, shards(), held_bytes):
            rows = [(d, *x) for d, leaks in zip(b.column("doc_id").to_pylist(), found) for x in leaks]
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
            names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names)

    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("score", F.round("score", 6))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The rows of docs that hold no item of benchmark, with all their columns, judged where they are."""
    shards = indexes(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in searched(batches, shards(), held_bytes):
            yield b.filter(pa.array([not leaks for leaks in found], pa.bool_()))

    return map_rows(docs, run)
