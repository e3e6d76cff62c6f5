"""Best-fit packing of documents into training sequences, after a Martello-Toth dominance reduction.

Only the histogram of piece lengths is planned on the driver, at most `capacity` numbers however large the corpus is. A
step of the plan fixes many equal sequences at once: sets of pieces that dominate all alternatives for their largest
piece are fixed for good and leave the instance; best fit places what is left, the longest first. The plan says for each
length which ranks go where; the pieces get their rank within a length from counts per partition, without a sort.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import default_path, encoder, groups

#: Lengths of all partitions that are broadcast at most; beyond that the pieces are shuffled.
MOST_STARTS = 500_000
SEPARATOR = 0
CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; of several, the first is the short one."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int, keep_ids: bool) -> DataFrame:
    """A row for each piece; nth numbers the pieces of equal length within a partition, part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen, part = encoder(path), defaultdict(int), TaskContext.get().partitionId()
        for b in batches:
            doc_ids, at = b.column(0).to_pylist(), 0
            for texts in groups(x.as_py() for x in b.column(1)):
                rows = []
                for ids in tokens.encode(texts):
                    ids += SEPARATOR.to_bytes(4, "little")
                    for i, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        row = (doc_ids[at], i, start, length, zlib.crc32(own), part, seen[length])
                        rows.append((*row, np.frombuffer(own, "<i4")) if keep_ids else row)
                        seen[length] += 1
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.list_(pa.int32())][: 7 + keep_ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"][: 7 + keep_ids]
    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes from counts (length → pieces) what can be fixed without loss; (lengths in a sequence, so many sequences).

    For the largest piece j left, a set is fixed if any other that holds j can be exchanged for it: j alone if nothing fits
    beside it; j with the largest partner that fits, if they fill the sequence, or if no pair beside j is larger; j with
    two partners, if no three fit, the first is the largest possible and no pair has both above the second."""
    fixed = []
    changed = True
    while changed:
        changed = False
        sizes = sorted(x for x, n in counts.items() if n)
        for j in sizes[::-1]:
            while counts[j]:
                counts[j] -= 1
                left = [x for x in sizes if counts[x]]
                counts[j] += 1
                room = capacity - j
                k = bisect_left(left, room + 1)
                if not k:
                    chosen = (j,)
                else:
                    best = left[k - 1]
                    small = [x for x in left[:3] for _ in range(min(3, counts[x] - (x == j)))][:3]
                    if best == room or len(small) < 2 or sum(small[:2]) > room:
                        chosen = (j, best)
                    elif len(small) < 3 or sum(small) > room:
                        fits = left[: bisect_left(left, room - best + 1)]
                        if best in fits and counts[best] - (best == j) < 2:
                            fits = [x for x in fits if x != best]
                        above = [x for x in left if x > (fits[-1] if fits else 0)]
                        twice = [x for x in above for _ in range(min(2, counts[x] - (x == j)))][:2]
                        if len(twice) == 2 and sum(twice) <= room:
                            break
                        chosen = (j, best, fits[-1]) if fits else (j, best)
                    else:
                        break
                n = min(counts[x] // chosen.count(x) for x in chosen)
                for x in chosen:
                    counts[x] -= n
                fixed.append((chosen, n))
                changed = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: equal sequences are filled together. (lengths in a sequence, so many sequences)."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], n: int, room: int) -> None:
        if n:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append((lengths, n))

    for x in sorted((x for x, n in counts.items() if n), reverse=True):
        n = counts[x]
        while n:
            i = bisect_left(rooms, x)
            if i == len(rooms):
                each = capacity // x
                put((x,) * each, n // each, capacity - each * x)
                put((x,) * (n % each), int(n % each > 0), capacity - n % each * x)
                break
            room = rooms[i]
            lengths, m = by_room[room].pop()
            take = min(n, m)
            if m > take:
                by_room[room].append((lengths, m - take))
            elif not by_room[room]:
                rooms.pop(i)
            put((*lengths, x), take, room - x)
            n -= take
    return [e for entries in by_room.values() for e in entries]


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted; ranks from there on go to the sequences from there on."""
    counts = dict(counts)
    rows, used, sequence = [], defaultdict(int), 0
    for lengths, n in reduce_dominated(counts, capacity) + best_fit(counts, capacity):
        offset = 0
        for x in lengths:
            rows.append((x, used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with keep_ids also ids.

    docs (doc_id, text; further columns are ignored): ids of the text, then id 0. Longer than `capacity`: cut, the first
    piece the shorter. Null and empty texts are the lone id 0; null doc_ids and repeated rows are packed like others;
    an empty table gives an empty one. Of equally good places the choice is arbitrary but the number of sequences isn't.

    The broadcast plan has a few rows for each length of at most `capacity`; it doesn't grow with the corpus."""
    cut = materialize(pieces(docs, path or default_path(), capacity, keep_ids), "pieces")
    per_part = cut.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    steps = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    starts = F.broadcast(starts) if per_part.count() <= MOST_STARTS else starts
    sent = docs.sparkSession.sparkContext.broadcast(steps)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = sent.value
        keys = (steps[:, 0] << 44) + steps[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = steps[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            b = b.drop_columns(["rank"])
            yield b.append_column("sequence_id", pa.array(at[:, 2] + rank - at[:, 1])).append_column("offset", pa.array(at[:, 3]))

    ranked = cut.join(starts, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    kept = [c for c in cut.columns if c not in ("part", "nth")]
    kinds = dict(cut.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInArrow(place, schema)
