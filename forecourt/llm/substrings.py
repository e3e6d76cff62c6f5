"""Removal of word runs that occur elsewhere in the corpus, by suffix automata of reference shards.

Each window of `window` words has a minimizer, the lowest hash of its runs of GRAM words; equal windows have equal
minimizers, and only minimizers that occur twice can hide a repeat. Passages that very many texts share have minimizers of
over `shard_rows` occurrences. Their repeated windows are the reference: counted with partial sums, merged into passages,
built into suffix automata of at most SHARD_WORDS words and broadcast, at most REFERENCE windows; what carries these
minimizers is streamed through them for its matching statistics, and maximal spans of `window` words or more are removed.
A reference beyond that bound is looked up window by window in a join instead.

An automaton of all other parts of the corpus, broadcast to all documents, would cost documents x shards. They are sharded by
content: the segments that share a minimizer of few occurrences are a shard, and are streamed through its automaton where
the shuffle brings them together. All ways are exact, and together they cover all windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 35
GRAM = 8
KEY = ["k1", "k2"]
#: Windows of a broadcast reference, and words of an automaton, at most.
REFERENCE, SHARD_WORDS = 20_000, 50_000
#: Minimizers or texts of very many occurrences that are broadcast at most, and texts that a task remembers.
MOST_HEAVY, REMEMBERED = 500_000, 500_000


def minimizers(words: list[bytes], window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of each run of windows, by their starts, that have the same minimizer at the same place."""
    gram = min(gram, window)
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    g = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(g)]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    size = window - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(g, size).argmin(axis=1) + np.arange(len(g) - size + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return g[at[first]].view(np.int64), first, last


class Automaton:
    """A suffix automaton of several sequences; counts: how often a state's strings end in them, by weight."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def split(self, p: int, c, q: int) -> int:
        """The state for the strings of q no longer than from p by c."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self.state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list, weight: int) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self.split(last, c, self.next[last][c])
            else:
                new, p = self.state(self.length[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self.split(p, c, self.next[p][c])
                last = new
            self.count[last] += weight

    def finish(self) -> None:
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def repeated(self, sequence: list, window: int) -> list[int]:
        """Starts of the windows of sequence that occur twice or more in all."""
        found, s, matched = [], 0, 0
        for end, c in enumerate(sequence, 1):
            s = self.next[s][c]
            matched += 1
            while self.length[self.link[s]] >= window:
                s = self.link[s]
            if matched >= window and self.count[s] > 1:
                found.append(end - window)
        return found


    def matching(self, sequence: list, window: int) -> list[int]:
        """Starts of the windows of any sequence that the automaton holds: where the longest match that ends with it is as long."""
        found, s, matched = [], 0, 0
        for end, c in enumerate(sequence, 1):
            while s and c not in self.next[s]:
                s = self.link[s]
                matched = self.length[s]
            s, matched = (self.next[s][c], matched + 1) if c in self.next[s] else (0, 0)
            if matched >= window:
                found.append(end - window)
        return found


def passages(windows: list[list[bytes]]) -> list[list[bytes]]:
    """Sequences of which the windows are exactly these distinct ones, each once: those that follow each other are merged."""
    after: dict[tuple, list[int]] = {}
    for i, w in enumerate(windows):
        after.setdefault(tuple(w[:-1]), []).append(i)
    ends = {tuple(w[1:]) for w in windows}
    first = [i for i, w in enumerate(windows) if tuple(w[:-1]) not in ends]
    used, out = [False] * len(windows), []
    for i in [*first, *range(len(windows))]:
        if used[i]:
            continue
        sequence, k = list(windows[i][:-1]), i
        while k is not None:
            used[k] = True
            sequence.append(windows[k][-1])
            k = next((x for x in after.get(tuple(sequence[len(sequence) - len(windows[i]) + 1 :]), ()) if not used[x]), None)
        out.append(sequence)
    return out


def reference_shards(windows: list[list[bytes]], shard_words: int) -> list[Automaton]:
    """Automata of the passages of windows, of about shard_words words each."""
    shards, words = [], shard_words
    for p in passages(windows):
        if words >= shard_words:
            shards.append(Automaton())
            words = 0
        shards[-1].add(p, 1)
        words += len(p)
    return shards


def spans(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal (from, to) that windows with these ascending starts cover."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


OCCURRENCES = pa.schema([("h", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
SEGMENTS = pa.schema([("h", pa.int64()), ("segment", pa.binary()), ("copies", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32()), ("first", pa.int32())])
WINDOWS = pa.schema([("digest", pa.binary()), ("copies", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32()), ("first", pa.int32())])
COUNTS = pa.schema([("digest", pa.binary()), ("copies", pa.int64())])
CONTENTS = pa.schema([("digest", pa.binary()), ("words", pa.binary())])
SPANS = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
TEXTS = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
DDL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def shards(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows of SEGMENTS, sorted by h, in; spans of repeated windows out. Holds one shard and a batch."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    out: list[tuple] = []
    for _, shard in groupby(rows(), key=lambda r: r[0]):
        members = list(shard)
        weights: dict[bytes, int] = {}
        for _, segment, copies, *_ in members:
            weights[segment] = weights.get(segment, 0) + copies
        split = {segment: segment.split() for segment in weights}
        if len(split) == 1:
            (segment, words), = split.items()
            found = {segment: [(0, len(words))] if weights[segment] > 1 else []}
        else:
            automaton = Automaton()
            for segment, words in split.items():
                automaton.add(words, weights[segment])
            automaton.finish()
            found = {segment: spans(automaton.repeated(words, window), window) for segment, words in split.items()}
        out += [(k1, k2, first + a, first + b) for _, segment, _, k1, k2, first in members for a, b in found[segment]]
        if len(out) > 20_000:
            yield batch(out, SPANS)
            out = []
    yield batch(out, SPANS)


def digest_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def few_enough(counted: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Rows of counted (n) with n above a bound, least or a multiple of it, so that there are at most MOST_HEAVY; and the bound."""
    while (heavy := counted.where(F.col("n") > least)).count() > MOST_HEAVY:
        least *= 2
    return heavy, least


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield batch(held, schema)
            held = []
    yield batch(held, schema)


def heavy_spans(segments: DataFrame, window: int, reference: int, shard_words: int) -> DataFrame:
    """Rows of SPANS: the windows of segments (rows of SEGMENTS, of heavy minimizers) that are in them twice or more."""
    spark = segments.sparkSession

    def each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for segment, copies, k1, k2, first in zip(*(b.column(c).to_pylist() for c in ("segment", "copies", "k1", "k2", "first"))):
                words = segment.split()
                for s in range(len(words) - window + 1):
                    yield digest_of(words[s : s + window]), copies, k1, k2, first + s

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of this part: what very many texts share leaves a task once."""
        held: dict[bytes, int] = {}
        for digest, copies, *_ in each_window(batches):
            held[digest] = held.get(digest, 0) + copies
            if len(held) >= REMEMBERED:
                yield from in_batches(iter(held.items()), COUNTS)
                held = {}
        yield from in_batches(iter(held.items()), COUNTS)

    sums = segments.mapInArrow(counts, ddl(COUNTS)).groupBy("digest").agg(F.sum("copies").alias("n"))
    again = materialize(sums.where("n > 1").select("digest"), "repeated-windows")
    if again.count() > reference:
        found = segments.mapInArrow(lambda it: in_batches(each_window(it), WINDOWS), ddl(WINDOWS)).join(again, "digest", "left_semi")
        return found.select("k1", "k2", F.col("first").alias("start"), (F.col("first") + window).alias("stop"))
    wanted = spark.sparkContext.broadcast({bytes(r[0]) for r in again.collect()})  # reference at most

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            left = set(wanted.value)
            for b in batches:
                for segment in b.column(0).to_pylist():
                    words = segment.split() if left else []
                    for s in range(len(words) - window + 1):
                        own = words[s : s + window]
                        if (digest := digest_of(own)) in left:
                            left.remove(digest)
                            yield digest, b" ".join(own)

        yield from in_batches(rows(), CONTENTS)

    held = segments.select("segment").mapInArrow(contents, ddl(CONTENTS)).groupBy("digest").agg(F.first("words").alias("words"))
    automata = reference_shards(sorted(bytes(r["words"]).split() for r in held.collect()), shard_words)
    sent = [spark.sparkContext.broadcast(a) for a in automata]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places() -> Iterator[tuple[tuple[int, int], int]]:
            for b in batches:
                for segment, k1, k2, first in zip(*(b.column(c).to_pylist() for c in ("segment", "k1", "k2", "first"))):
                    words = segment.split()
                    for shard in sent:
                        yield from (((k1, k2), first + s) for s in shard.value.matching(words, window))

        def rows() -> Iterator[tuple]:
            """The segments of a text follow each other, and so their spans are made maximal here."""
            for key, own in groupby(places(), key=lambda x: x[0]):
                yield from ((*key, a, b) for a, b in spans(sorted({s for _, s in own}), window))

        yield from in_batches(rows(), SPANS)

    return segments.mapInArrow(stream, ddl(SPANS))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, shard_rows: int = 500, digest: bool = False, reference: int = REFERENCE, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """One row for each of docs (doc_id, text; further columns are ignored): doc_id, n_words, n_removed, and kept, its words
    that no repeated window covers, joined by single spaces; with digest, kept_sha256 in place of kept.

    A window is `window` consecutive words; it is repeated if its words also start at any other place of any row. Windows
    are judged on the input. Null and empty texts have no words. Repeated rows repeat each other: of their windows nothing
    stays. Null ids are kept; an empty table gives an empty one. Equal texts are looked at once, with their number; texts
    count as equal if 96 bits of hashes are, and windows that very many texts share if 128 bits are."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"), text.alias("text"))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for k1, k2, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (k1, k2) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add((k1, k2))
                h, first, last = minimizers(words_of(t.as_py()), window)
                if len(h):
                    own = [pa.array(h), *(pa.repeat(pa.scalar(k, f), len(h)) for k, f in ((k1, pa.int64()), (k2, pa.int32())))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(first, pa.int32()), pa.array(last, pa.int32())], schema=OCCURRENCES)

    found = materialize(keyed.select("k1", "k2", "text").mapInArrow(occurrences, ddl(OCCURRENCES)), "minimizers")
    twice = materialize(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeated-minimizers")
    heavy, bound = few_enough(twice, shard_rows)
    # The occurrences of heavy minimizers never meet: these are told by a broadcast set, and the rest is joined without them.
    heavy = F.broadcast(heavy.select("h"))
    light = found.join(heavy, "h", "left_anti").join(twice.where(F.col("n") <= bound).select("h"), "h")
    texts = keyed.groupBy(KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for k1, k2, places, t, copies in zip(*b.columns):
                    words = words_of(t.as_py())
                    for p in places.as_py():
                        yield p["h"], b" ".join(words[p["first"] : p["last"] + window]), copies.as_py(), k1.as_py(), k2.as_py(), p["first"]

        yield from in_batches(rows(), SEGMENTS)

    def of_texts(places: DataFrame) -> DataFrame:
        own = places.groupBy(KEY).agg(F.collect_set(F.struct("h", "first", "last")).alias("places"))
        return own.join(texts, KEY).select("k1", "k2", "places", "text", "copies").mapInArrow(segments, ddl(SEGMENTS))

    in_shards = of_texts(light).repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: shards(it, window), ddl(SPANS))
    shared = heavy_spans(materialize(of_texts(found.join(heavy, "h", "left_semi")), "heavy-segments"), window, reference, shard_words)
    removed = in_shards.unionByName(shared).groupBy(KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def shown(kept: list[bytes]) -> str:
        whole = b" ".join(kept)
        return hashlib.sha256(whole).hexdigest() if digest else whole.decode("utf-8", "surrogatepass")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k1, k2, t, copies, removed in zip(*b.columns):
                words = words_of(t.as_py())
                n, stay = len(words), words
                if copies.as_py() > 1 and n >= window:
                    stay = []
                elif removed.is_valid:
                    stay, at = [], 0
                    for s in sorted(removed.as_py(), key=lambda s: s["start"]):
                        stay += words[at : max(at, s["start"])]
                        at = max(at, s["stop"])
                    stay += words[at:]
                rows.append((k1.as_py(), k2.as_py(), n, n - len(stay), shown(stay)))
            yield batch(rows, TEXTS)

    def cut_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(t.as_py())
                stay = [] if len(words) >= window else words
                rows.append((doc_id, len(words), len(words) - len(stay), shown(stay)))
            yield batch(rows, RESULT)

    done = texts.join(removed, KEY, "left").select("k1", "k2", "text", "copies", "spans").mapInArrow(cut, ddl(TEXTS))
    # Rows of texts with very many copies need nothing but their own text, and stay where they are.
    copied = materialize(keyed.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") > shard_rows), "copied-texts")
    copied = F.broadcast(few_enough(copied, shard_rows)[0].select(KEY))
    in_place = keyed.join(copied, KEY, "left_semi").select("doc_id", "text").mapInArrow(cut_copies, ddl(RESULT))
    result = keyed.select("doc_id", "k1", "k2").join(copied, KEY, "left_anti").join(done, KEY).select(RESULT.names).unionByName(in_place)
    return result.withColumnRenamed("kept", "kept_sha256") if digest else result
