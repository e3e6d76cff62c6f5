"""Repair of the structure of conversations by a cheapest sequence of edits.

A conversation should have an optional system turn, then user and assistant turns by turns, ending with an assistant. An edit
is a letter: Keep a row, Rerole it, Delete it, Insert an empty one. The edits form a lattice of (rows done, state of the pattern),
in which a bidirectional Dijkstra search finds the cheapest way, and the first one in ASCII order among equal ones.

Only what the search needs of a row is looked at for it: the role's first letter, its faults and a hash; no texts are shuffled.
Rows are dealt by ranges, so that a conversation of any length is spread over tasks: a task that has a whole one finds its edits,
of a piece it finds the cheapest edits between each two states, and the pieces are put together afterwards. Texts are shuffled once,
when the edits are applied.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What a truncated row that isn't deleted costs in addition.
TRUNCATED = 3
#: States: nothing yet, after a system, user, assistant turn; where each letter of a role leads, and the role that is made where one is.
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
MADE = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
#: Rows of a piece of a long conversation; its lattice has four states for each.
PIECE_ROWS = 1024

#: A row for the search: first letter of its role, whether it has to go, whether it is truncated.
Row = tuple[str, bool, bool]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of each row, damaged by the crc32 of conv_id:turn modulo 20 (nulls: one space): 0 drops it
    (no copies), 1 empties the text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""
    ids = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    k = F.crc32(F.concat_ws(":", *ids).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(k == 0, 0).when(k == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(k == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copies"))


def last_sign(text: Column) -> Column:
    """The last sign that isn't blank, '' if there is none."""
    return F.right(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))


def hashed(rows: DataFrame) -> DataFrame:
    """rows with h1 and h2, 128 bits by which equal roles and texts are known, and the order of rows of one turn by role."""
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})


ORDER = ["turn", "role", "h1", "h2"]


def searched(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts: conv_id, turn, role, h1, h2, copies (none for a dropped row), blank, truncated, and again,
    whether an earlier turn has the same role and text.

    Equal rows are counted in the task that has them. The first turn of each text is a minimum, joined to its rows."""
    last = last_sign(F.col("text"))
    light = hashed(rows).select("conv_id", *ORDER, "copies", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    each = light.groupBy("conv_id", *ORDER, "blank", "truncated").agg(F.sum("copies").alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    first = each.where("copies > 0").groupBy("conv_id", "h1", "h2").agg(F.min(at).alias("first"))
    first = first.select(F.col("conv_id").alias("of"), F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first")
    joined = each.join(first, each["conv_id"].eqNullSafe(first["of"]) & (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    return joined.select("conv_id", *ORDER, "copies", "blank", "truncated", F.coalesce(F.col("first") < at, F.lit(False)).alias("again"))


def cheapest(rows: tuple[Row, ...], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and letters of the cheapest edits of rows that lead from state start to one of ends, the least letters of equal ones; None if none do.

    A search from the start and one from the ends, each with its heap. Nodes of equal cost are settled in the order of their rows,
    so that free edits come before what follows them and a settled node has its least letters. The searches go on until the next
    two nodes together cost more than the best way found: by then every way of that cost has an edge from a node settled from
    the start to one settled from the ends."""
    n = len(rows)
    best: list = [None]

    def edges(node, back):
        """(neighbour, cost, letter) of a node, of edges into it if back."""
        i, state = node
        found = []
        makers = [p for p, q in MADE.items() if q == state] if back else [MADE[state]]
        found += [((i, q), COST[INSERT], INSERT) for q in makers]
        j = i - 1 if back else i + 1
        if 0 <= j <= n:
            letter, gone, cut = rows[min(i, j)]
            found.append(((j, state), COST[DELETE], DELETE))
            if not gone:
                more = TRUNCATED if cut else 0
                keepers = [p for p, to in STEPS.items() if to.get(letter) == state] if back else [q for x, q in STEPS[state].items() if x == letter]
                found += [((j, q), more, KEEP) for q in keepers] + [((j, q), COST[REROLE] + more, REROLE) for q in makers]
        return found

    class Side:
        def __init__(self, back: bool, nodes):
            self.back, self.known, self.done = back, {x: (0, "") for x in nodes}, set()
            self.heap = [self.key(0, x) for x in nodes]
            heapq.heapify(self.heap)

        def key(self, cost, node):
            return (cost, n - node[0] if self.back else node[0], node)

        def top(self):
            while self.heap and self.heap[0][2] in self.done:
                heapq.heappop(self.heap)
            return self.heap[0][0] if self.heap else float("inf")

        def settle(self, other):
            cost, _, node = heapq.heappop(self.heap)
            if node in self.done:
                return
            self.done.add(node)
            own = self.known[node][1]
            if node in other.done:
                crossed(self, own, other.known[node], 0, "", cost)
            for to, price, letter in edges(node, self.back):
                if to in other.done:
                    crossed(self, own, other.known[to], price, letter, cost)
                new = (cost + price, letter + own if self.back else own + letter)
                if to not in self.known or new < self.known[to]:
                    if to not in self.known or new[0] < self.known[to][0]:
                        heapq.heappush(self.heap, self.key(new[0], to))
                    self.known[to] = new

    def crossed(side, own, met, price, letter, cost):
        total = cost + price + met[0]
        if best[0] is None or total <= best[0][0]:
            way = (total, met[1] + letter + own if side.back else own + letter + met[1])
            best[0] = way if best[0] is None else min(best[0], way)

    there, back = Side(False, [(0, start)]), Side(True, [(n, e) for e in ends])
    there.settle(back)
    for _ in ends:
        back.settle(there)
    while True:
        a, b = there.top(), back.top()
        if (best[0] is not None and a + b > best[0][0]) or a == b == float("inf"):
            return best[0]
        there.settle(back) if a <= b else back.settle(there)


@lru_cache(maxsize=1 << 15)
def whole_edits(rows: tuple[Row, ...]) -> tuple[int, str]:
    return cheapest(rows, 0, ENDS)


def piece_edits(rows: tuple[Row, ...]) -> list[dict]:
    """The cheapest edits of a piece between each two states."""
    found = {(p, q): cheapest(rows, p, (q,)) for p in STEPS for q in STEPS}
    return [{"start": p, "stop": q, "cost": x[0], "audit": x[1]} for (p, q), x in found.items() if x]


WAYS = "array<struct<start:int,stop:int,cost:long,audit:string>>"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
REPAIR = "conv_id {id}, " + ", ".join(f"{c} long" for c in COUNTS) + ", cost long, audit string"
PIECE = REPAIR + ", part long, whole boolean, first_letter string, last_letter string, low long, high long, last_turn long, first_turn long, turns long, ways " + WAYS


class Piece:
    """What is known of consecutive rows of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.turns = conv_id, [], 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_letter = self.last_letter = self.first_turn = self.last_turn = None
        self.seen = None

    def add(self, turn, role, blank, truncated, again) -> None:
        letter, duplicate = role[:1], not blank and again
        if self.last_letter is None:
            self.first_letter, self.first_turn = letter, turn
        elif self.last_letter + letter not in LEGAL:
            self.counts["illegal"] += 1
        self.counts["blank"] += blank
        self.counts["duplicate"] += duplicate
        self.counts["truncated"] += not blank and not duplicate and truncated
        self.turns += turn is not None and turn != self.seen
        self.seen, self.last_letter, self.last_turn = turn, letter, turn
        self.rows.append((letter, blank or duplicate, truncated))

    def row(self, part: int, whole: bool) -> dict:
        rows = tuple(self.rows)
        cost, audit = whole_edits(rows) if whole else (None, None)
        return self.counts | {
            "conv_id": self.conv_id, "part": part, "whole": whole, "cost": cost, "audit": audit, "ways": None if whole or not rows else piece_edits(rows), "turns": self.turns,
            **{k: getattr(self, k) for k in ("first_letter", "last_letter", "first_turn", "last_turn")},
        }


def gaps(low, high, turns) -> int:
    return high - low + 1 - turns if turns else 0


def pieces(rows: DataFrame) -> DataFrame:
    """rows of searched() as pieces of conversations in order; whole says that a piece surely is all of its conversation, with its edits."""
    schema = PIECE.format(id=rows.schema["conv_id"].dataType.simpleString())
    to = to_arrow_schema(T.StructType.fromDDL(schema))
    ordered = rows.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)

    def run(batches):
        import pyarrow as pa

        part = TaskContext.get().partitionId() << 33
        piece, sure = None, False  # sure: the piece's conversation begins with it
        low = high = None

        def done(p, whole):
            nonlocal part
            part += 1
            return p.row(part, whole) | {"low": low, "high": high} | ({"gaps": gaps(low, high, p.turns)} if whole else {})

        for batch in batches:
            out = []
            for conv_id, turn, role, _, _, copies, blank, truncated, again in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is not None and conv_id != piece.conv_id:
                    out.append(done(piece, sure))
                    piece, sure, low, high = Piece(conv_id), True, None, None
                elif piece is None:
                    piece = Piece(conv_id)
                for k in range(copies):
                    if len(piece.rows) >= PIECE_ROWS:
                        out.append(done(piece, False))
                        seen, piece, sure, low, high = piece.seen, Piece(conv_id), False, None, None
                        piece.seen = seen
                    piece.add(turn, role, blank, truncated, again or k > 0)
                    if turn is not None:
                        low, high = (turn if low is None else low), turn
            yield pa.RecordBatch.from_pylist(out, to)
        if piece is not None:
            yield pa.RecordBatch.from_pylist([done(piece, False)], to)

    return ordered.select("conv_id", *ORDER, "copies", "blank", "truncated", "again").mapInArrow(run, schema)


def edits(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one for each conversation of rows (conv_id, turn, role, text, copies)."""
    found = pieces(searched(rows))
    schema = REPAIR.format(id=rows.schema["conv_id"].dataType.simpleString())
    to = to_arrow_schema(T.StructType.fromDDL(schema))
    names = to.names

    def run(batches):
        import pyarrow as pa

        state = None

        def start(conv_id):
            return {"conv_id": conv_id, "ways": {0: (0, "")}, "low": None, "high": None, "turns": 0, "letter": None, "turn": None} | dict.fromkeys(COUNTS, 0)

        def extend(s, p):
            for c in COUNTS[1:]:
                s[c] += p[c]
            if p["ways"] is None:
                return
            if s["letter"] is not None and s["letter"] + p["first_letter"] not in LEGAL:
                s["illegal"] += 1
            s["turns"] += p["turns"]
            if p["fresh"] and s["turn"] is not None and s["turn"] == p["first_turn"]:
                s["turns"] -= 1
            s["low"] = p["low"] if s["low"] is None else s["low"]
            s["high"] = s["high"] if p["high"] is None else p["high"]
            s["letter"], s["turn"] = p["last_letter"], p["last_turn"]
            new = {}
            for w in p["ways"]:
                if w["start"] in s["ways"]:
                    cost, audit = s["ways"][w["start"]]
                    way = (cost + w["cost"], audit + w["audit"])
                    new[w["stop"]] = min(way, new.get(w["stop"], way))
            s["ways"] = new

        def row(s):
            cost, audit = min(s["ways"][e] for e in ENDS if e in s["ways"])
            return {"conv_id": s["conv_id"], "cost": cost, "audit": audit, "gaps": gaps(s["low"], s["high"], s["turns"])} | {c: s[c] for c in COUNTS[1:]}

        task = None
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if state is not None and p["conv_id"] != state["conv_id"]:
                    out.append(row(state))
                    state = None
                if p["whole"]:
                    out.append({k: p[k] for k in names})
                    continue
                state = state or start(p["conv_id"])
                # A piece of another task doesn't know the turn before it.
                p["fresh"], task = task != p["part"] >> 33, p["part"] >> 33
                extend(state, p)
            yield pa.RecordBatch.from_pylist(out, to)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row(state)], to)

    return found.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)


def applied(audit: str, at: int, state: int, role: str | None, text: str | None):
    """(turns, at, state) after the edits up to and with that of a row, or with no row the last ones; turns: (role, text)."""
    turns = []
    while at < len(audit) and audit[at] == INSERT:
        state = MADE[state]
        turns.append((ROLE[state], ""))
        at += 1
    if role is not None:
        edit = audit[at]
        if edit == KEEP:
            state = STEPS[state][role[:1]]
            turns.append((role, text))
        elif edit == REROLE:
            state = MADE[state]
            turns.append((ROLE[state], text))
        at += 1
    return turns, at, state


def with_texts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows and found, the edits() of their conversations, dealt by conversation, a conversation's edits before its rows in order."""
    texts = hashed(rows).where("copies > 0").select("conv_id", *ORDER, "text", "copies", *[F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c != "conv_id"])
    heads = found.select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in texts.select(*ORDER, "text", "copies").dtypes], *[c for c in found.columns if c != "conv_id"])
    both = texts.unionByName(heads).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.col("copies").isNotNull(), *ORDER)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, place, role, text): the repaired conversations of conversations (conv_id, turn, role, text), place from 0."""
    own = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", "turn", *own, F.lit(1).alias("copies"))
    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, place long, role string, text string"
    to = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        names, conv_id, place = to.names, None, 0
        for batch, events in repaired(batches):
            out = []
            for kind, value in events:
                if kind == "begin":
                    conv_id, place = value["conv_id"], 0
                elif kind == "turn":
                    out.append(dict(zip(names, (conv_id, place, *value))))
                    place += 1
            yield pa.RecordBatch.from_pylist(out, to)

    return with_texts(rows, edits(rows)).mapInArrow(run, schema)


def repaired(batches):
    """(batch, events) for the batches of with_texts(), and one more at the end: ("begin", its edits), ("turn", (role, text)) and ("end", None) of each conversation."""
    head, at, state = None, 0, 0

    def end():
        turns, _, _ = applied(head["audit"], at, state, None, None)
        return [*(("turn", t) for t in turns), ("end", None)]

    for batch in batches:
        events = []
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for i in range(batch.num_rows):
            if columns["copies"][i] is None:
                if head is not None:
                    events += end()
                head, at, state = {c: v[i] for c, v in columns.items()}, 0, 0
                events.append(("begin", head))
                continue
            for _ in range(columns["copies"][i]):
                turns, at, state = applied(head["audit"], at, state, columns["role"][i], columns["text"][i])
                events += [("turn", t) for t in turns]
        yield batch, events
    if head is not None:
        yield None, end()


def repair_digests(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one for each conversation of rows (conv_id, turn, role, text, copies).

    Rows are in order of turn, those without a number first, of one turn by role, then by hash. Rows with no copies are gone, but
    their conversation is reported; rows without conv_id are one conversation. blank, duplicate and truncated count each row's first
    fault. repaired_sha256 is of role:text of the repaired turns, joined by newlines; such a digest is made in order, so that the texts
    of a conversation pass through one task, which holds none of them. No rows: none."""
    found = edits(rows)
    schema = REPAIR.format(id=rows.schema["conv_id"].dataType.simpleString()) + ", repaired_sha256 string"
    to = to_arrow_schema(T.StructType.fromDDL(schema))
    names = to.names[:-1]

    def run(batches):
        import pyarrow as pa

        head = digest = None
        first = True
        for _, events in repaired(batches):
            out = []
            for kind, value in events:
                if kind == "begin":
                    head, digest, first = value, hashlib.sha256(), True
                elif kind == "turn":
                    digest.update(("" if first else "\n").encode() + f"{value[0]}:{value[1]}".encode())
                    first = False
                else:
                    out.append({k: head[k] for k in names} | {"repaired_sha256": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, to)

    return with_texts(rows, found).mapInArrow(run, schema)


def damaged_repairs(conversations: DataFrame) -> DataFrame:
    """repair_digests() of the damage() of conversations; further columns are ignored."""
    return repair_digests(damage(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")))
