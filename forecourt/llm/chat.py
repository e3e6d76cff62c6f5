r"""Conversations as training texts, assembled column by column.

A template marks each turn with a header and a trailer. Control strings inside texts get a backslash after their first sign
(and one more where they have some), which is undone on reading: `</s>` is written `<\/s>`, and `<\/s>` is written `<\\/s>`.

The rows of a batch become one Arrow buffer: the lengths of headers, texts and trailers give cumulative offsets, these give the
place of every byte, and numpy scatters headers and texts there. Rows are dealt by ranges of (conversation, turn), so that a
conversation of any length is spread over tasks; it is written as parts of whole turns, and most have one part.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of a part at most, but for a single turn that is longer, and bytes that are scattered at once.
PART_BYTES = 4 << 20

PART = "conv_id {id}, part long, n_turns long, whole boolean, formatted string, loss array<struct<start:int,stop:int>>"
DIGEST = "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Template:
    """marks: header and trailer of known roles. Of other roles, the header is named[0], the role and named[1], the trailer named[2].

    controls: what a text must not hold; every mark holds one, and none begins within another. trained: roles under the loss."""

    marks: dict[str, tuple[str, str]]
    named: tuple[str, str, str]
    controls: tuple[str, ...]
    trained: tuple[str, ...] = ("assistant",)

    def escaping(self, escaped: bool = False) -> str:
        """The pattern of control strings with any number of backslashes (one at least if escaped), as (first sign)(backslashes)(rest)."""
        by_sign: dict[str, list[str]] = {}
        for c in self.controls:
            by_sign.setdefault(c[0], []).append(re.escape(c[1:]))
        some = r"\\+" if escaped else r"\\*"
        return "|".join(rf"({re.escape(sign)})({some})({'|'.join(rest)})" for sign, rest in by_sign.items())

    def groups(self) -> int:
        return len({c[0] for c in self.controls})

    def escape(self, texts):
        """texts, an Arrow array of strings, with their control strings escaped."""
        import pyarrow.compute as pc

        n = self.groups()
        first, slashes, rest = ("".join(rf"\{3 * i + k}" for i in range(n)) for k in (1, 2, 3))
        return pc.replace_substring_regex(texts, pattern=self.escaping(), replacement=rf"{first}\\{slashes}{rest}")

    def unescape(self, text: str) -> str:
        if "\\" not in text:
            return text
        return re.sub(self.escaping(escaped=True), lambda m: "".join(g for g in m.groups() if g is not None).replace("\\", "", 1), text)

    def turns(self, formatted: str):
        """(role, text) of each turn of a formatted conversation or part."""
        headers = {header: (role, trailer) for role, (header, trailer) in self.marks.items()}
        known, at = re.compile("|".join(map(re.escape, headers))), 0
        while at < len(formatted):
            m = known.match(formatted, at)
            if m:
                (role, trailer), begin = headers[m[0]], m.end()
            elif formatted.startswith(self.named[0], at):
                end = formatted.index(self.named[1], at)
                role, trailer, begin = self.unescape(formatted[at + len(self.named[0]) : end]), self.named[2], end + len(self.named[1])
            else:
                raise ValueError(f"no header at {at}: {formatted[at : at + 40]!r}")
            end = formatted.index(trailer, begin)
            yield role, self.unescape(formatted[begin:end])
            at = end + len(trailer)


INSTRUCT = Template(
    marks={"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")},
    named=("<|role|>", "<|text|>", "<|end|>"),
    controls=("<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>", "[INST]", "[/INST]"),
)


def scatter(target, starts, lengths, pool, sources) -> None:
    """Copies pool[sources[i] : + lengths[i]] to target[starts[i] : + lengths[i]], through index arrays of about PART_BYTES entries at once."""
    import numpy as np

    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, before + PART_BYTES, "right")), at + 1)
        if stop == at + 1:  # one segment, perhaps a very long one
            target[starts[at] : starts[at] + lengths[at]] = pool[sources[at] : sources[at] + lengths[at]]
        else:
            n, within = lengths[at:stop], np.arange(ends[stop - 1] - before)
            within -= np.repeat(ends[at:stop] - n - before, n)
            target[np.repeat(starts[at:stop], n) + within] = pool[np.repeat(sources[at:stop], n) + within]
        at = stop


def assemble(roles, texts, template: Template):
    """(buffer, byte offset of every row's end, code points of every row, code points before and in its text) of Arrow arrays without nulls."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    coded = pc.dictionary_encode(roles)
    marks = []
    for role in coded.dictionary.to_pylist():
        own = template.marks.get(role)
        marks.append(own or (template.named[0] + template.escape(pa.array([role], pa.large_string()))[0].as_py() + template.named[1], template.named[2]))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pool = np.frombuffer("".join(m for pair in marks for m in pair).encode(), np.uint8)
    sizes = np.array([[len(m.encode()) for m in pair] for pair in marks], np.int64).reshape(-1, 2)
    places = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(-1, 2)
    points = np.array([[len(m) for m in pair] for pair in marks], np.int64).reshape(-1, 2)

    escaped = template.escape(texts)
    offsets = np.frombuffer(escaped.buffers()[1], np.int64)[escaped.offset : escaped.offset + len(escaped) + 1]
    data = np.frombuffer(escaped.buffers()[2] or b"", np.uint8)
    inner = np.diff(offsets)
    lengths = np.stack([sizes[code, 0], inner, sizes[code, 1]], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(-1, 3)
    starts = ends - lengths

    buffer = pa.allocate_buffer(int(ends[-1, 2]) if len(code) else 0)
    target = np.frombuffer(buffer, np.uint8)
    scatter(target, starts[:, ::2].ravel(), lengths[:, ::2].ravel(), pool, places[code].ravel())
    scatter(target, starts[:, 1], inner, data, offsets[:-1])
    chars = pc.utf8_length(escaped).to_numpy(zero_copy_only=False).astype(np.int64)
    return buffer, ends[:, 2], points[code, 0] + chars + points[code, 1], points[code, 0], chars


def parts_of(starts, row_bytes):
    """Ranges of rows of at most about PART_BYTES each that end where conversations do, if they can. starts: whether a row begins one."""
    import numpy as np

    ends, at, n = np.cumsum(row_bytes), 0, len(row_bytes)
    firsts = np.flatnonzero(starts)
    while at < n:
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")), at + 1)
        if stop < n:
            last = firsts[np.searchsorted(firsts, stop, "right") - 1] if len(firsts) else 0
            stop = int(last) if last > at else stop
        yield at, stop
        at = stop


def format_chats(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Rows (conv_id, part, n_turns, whole, formatted, loss): conversations (conv_id, turn, role, text; further columns are ignored) as
    texts, turns in order, those without a number first, equal ones by role and text; null roles and texts are empty.

    A conversation is the concatenation of its parts by part; whole says that this part surely is all of it, which
    isn't known at the ends of a task's range. loss: the code points of the part that are trained on, start to stop. Rows
    without conv_id are one conversation. No rows: no parts."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = PART.format(id=kind)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        key = TaskContext.get().partitionId() << 33
        held: list = []  # tables of the conversation that may go on
        state = {"part": 0, "cut": True}  # cut: the next part's first conversation may have begun before it

        def put(table, open_end: bool):
            ids = table["conv_id"].combine_chunks()
            new = np.ones(len(ids), bool)
            same = pc.equal(ids[1:], ids[:-1]).fill_null(False)
            both = pc.and_(pc.is_null(ids[1:]), pc.is_null(ids[:-1]))
            new[1:] = ~pc.or_(same, both).to_numpy(zero_copy_only=False)
            roles = table["role"].combine_chunks().cast(pa.large_string())
            texts = table["text"].combine_chunks().cast(pa.large_string())
            for at, stop in parts_of(new, pc.binary_length(texts).to_numpy(zero_copy_only=False) + 32):
                own = slice(at, stop)
                buffer, ends, points, before, chars = assemble(roles[own], texts[own], template)
                first = np.flatnonzero(new[own] | (np.arange(stop - at) == 0))
                bounds = np.append(first, stop - at)
                offsets = np.append(0, ends)[bounds]
                trained = pc.is_in(roles[own], pa.array(template.trained, pa.large_string())).to_numpy(zero_copy_only=False)
                row_of = np.repeat(np.arange(len(first)), np.diff(bounds))
                upto = np.cumsum(points) - points
                start = (upto - upto[first][row_of] + before)[trained].astype(np.int32)
                n_loss = np.append(0, np.cumsum(np.bincount(row_of[trained], minlength=len(first))))
                spans = pa.StructArray.from_arrays([pa.array(start), pa.array(start + chars[trained].astype(np.int32))], ["start", "stop"])
                whole = np.ones(len(first), bool)
                whole[0] &= bool(new[at]) and not (at == 0 and state["cut"])
                whole[-1] &= bool(new[stop]) if stop < len(new) else not open_end
                formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), buffer)
                numbers = np.arange(len(first)) + key + state["part"]
                state["part"] += len(first)
                columns = [ids[own].take(pa.array(first)), numbers, np.diff(bounds), pa.array(whole), formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(n_loss, pa.int32()), spans)]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["conv_id", "part", "n_turns", "whole", "formatted", "loss"])
            state["cut"] = open_end

        def last_start(table) -> int:
            ids, n = table["conv_id"], len(table)
            last = ids[n - 1]
            other = pc.is_valid(ids) if not last.is_valid else pc.invert(pc.equal(ids, last).fill_null(False))
            found = np.flatnonzero(other.to_numpy())
            return int(found[-1]) + 1 if len(found) else 0

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            at = last_start(table)
            rest = table[at:]
            if rest.nbytes >= PART_BYTES:
                yield from put(table, open_end=True)
                held = []
            else:
                if at:
                    yield from put(table[:at], open_end=False)
                held = [rest]
        if held:
            yield from put(held[0], open_end=True)

    return rows.mapInArrow(run, schema)


def digests(parts: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the parts of format_chats().

    turns_sha256 is of role, \\n, text, \\n of each turn, loss_sha256 of all text under the loss, unescaped. Whole conversations are
    digested where they are; of the others the parts are brought together and pass through a task one by one, as such
    digests are made in order; nothing is held but their state."""
    schema = DIGEST.format(id=parts.schema["conv_id"].dataType.simpleString())
    with_parts = f"{schema}, part long, formatted string, loss array<struct<start:int,stop:int>>"
    digest_arrow, part_arrow = (to_arrow_schema(T.StructType.fromDDL(ddl)) for ddl in (schema, with_parts))
    names = digest_arrow.names

    def add(state: dict, formatted: str, loss: list) -> None:
        for role, text in template.turns(formatted):
            state["n"] += 1
            state["turns"].update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = template.unescape(formatted[span["start"] : span["stop"]])
            state["loss_chars"] += len(text)
            state["loss"].update(text.encode())
        state["chars"] += len(formatted)

    def new() -> dict:
        return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}

    def row(conv_id, s: dict) -> dict:
        values = [conv_id, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"]]
        return dict(zip(names, values))

    def here(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if p["whole"]:
                    state = new()
                    add(state, p["formatted"], p["loss"])
                    out.append(row(p["conv_id"], state) | {"part": p["part"]})
                else:
                    out.append({k: p[k] for k in ("conv_id", "part", "formatted", "loss")})
            yield pa.RecordBatch.from_pylist(out, part_arrow)

    def together(batches):
        import pyarrow as pa

        open_id = state = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                p = batch.slice(i, 1).to_pylist()[0]
                if state is not None and p["conv_id"] != open_id:
                    out.append(row(open_id, state))
                    state = None
                if p["formatted"] is None:
                    out.append({k: p[k] for k in names})
                else:
                    state, open_id = state or new(), p["conv_id"]
                    add(state, p["formatted"], p["loss"])
            yield pa.RecordBatch.from_pylist(out, digest_arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row(open_id, state)], digest_arrow)

    own = parts.mapInArrow(here, with_parts)
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(together, schema)


#: What the query adds to the table: texts that are control strings all over.
PROBE = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def chat_digests(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """digests() of all conversations and of conversation -1, PROBE."""
    probe = conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return digests(format_chats(conversations.select("conv_id", "turn", "role", "text").unionByName(probe), template), template)
