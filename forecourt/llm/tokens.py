"""Token ids of whole texts by a public tokenizer, with a cache of the ids of space-separated chunks.

Ids are those of the library tokenizers, which reads names of special tokens in a text as these tokens; with plain, as any
other signs. Where the same vocabulary lies beside it as ranks, new chunks of Latin letters, for which both libraries cut
alike, are encoded by tiktoken, at a fifth of the time; tests hold one against the other.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"

#: A cut before a single space between two other characters never changes the ids of this byte-level pattern: a token
#: that holds the space begins with it. Python's white space includes all that the tokenizer takes for white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
LATIN = "\u0250"
RUN = re.compile(r" \s|\s |^ | $")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Ids as little-endian bytes. The cache holds `cached` chunks and one call's at most and is then begun anew."""

    def __init__(self, path: str, code: str = "I", plain: bool = False, cached: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, names)) if names and not plain else "(?!)")
        self.kind, self.cached = np.dtype(code).newbyteorder("<"), cached
        # The byte-level sign for a space: where a token begins with one, so does the chunk that follows a single space.
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.ranked = self.by_ranks(path.removesuffix("json") + "tiktoken")
        self.heads: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    @staticmethod
    def by_ranks(path: str):
        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def one_by_one(self, chunks: list[str]) -> Iterator[bytes]:
        return (np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False))

    def together(self, chunks: list[str], plain: bool) -> Iterator[bytes]:
        """Of chunks without a space in them, each after a single space: encoded as one text, cut where a space begins."""
        for i in range(0, len(chunks), 5000):
            text = " " + " ".join(chunks[i : i + 5000])
            ids = np.array(self.ranked(text) if plain and self.ranked else self.tokenizer.encode(text, add_special_tokens=False).ids)
            ends = (np.append(np.flatnonzero(self.spaced[ids])[1:], len(ids)) * self.kind.itemsize).tolist()
            raw, at = ids.astype(self.kind).tobytes(), 0
            for end in ends:
                yield raw[at:end]
                at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [(CUT.split(t) if RUN.search(t) else t.split(" ")) if t else [""] for t in texts]
        if len(self.heads) + len(self.rest) > self.cached:
            self.heads, self.rest = {}, {}
        heads, rest = self.heads, self.rest
        if new := list({c[0] for c in cut}.difference(heads)):
            heads.update(zip(new, self.one_by_one(new)))
        new = set()
        for c in cut:
            new.update(c[1:])
        new.difference_update(rest)
        if odd := [x for x in new if " " in x or self.special.search(x)]:
            rest.update(zip(odd, self.one_by_one([f" {x}" for x in odd])))
            new.difference_update(odd)
        plain = [x for x in new if x and max(x) < LATIN]
        for own, is_plain in ((plain, True), (list(new.difference(plain)), False)):
            if own:
                rest.update(zip(own, self.together(own, is_plain), strict=True))
        return [heads[c[0]] + b"".join(map(rest.__getitem__, c[1:])) for c in cut]


@lru_cache(maxsize=2)
def encoder(path: str, code: str = "I", plain: bool = False) -> Encoder:
    """The encoder of this Python worker: its cache outlives a task."""
    return Encoder(path, code, plain)


def groups(texts: Iterable[str | None], chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """texts in order, in lists of about so many characters: what is held at once stays bounded but for a longer single text."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "") + 64
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held
