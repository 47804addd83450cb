"""Byte-level BPE ids of whole texts, each word encoded once per worker.

Pre-tokenisation takes a single space between two words together with the word after
it, so a text without runs of white space is the join of its space-led words, and a
word has the same ids wherever it occurs. Ids are kept as little-endian uint32 bytes.
Other texts are encoded whole, and so are texts that spell out an added token.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "byte_bpe_50k"
LONG_CHUNK = 2000
_RUN = re.compile(r"\s\s|^\s|\s$")
_OPEN: dict[tuple, "ByteBpe"] = {}


class _Memo(dict):
    """Two generations of at most ``room`` words; the older one is dropped when the newer is full."""

    def __init__(self, encode, room: int):
        self.encode, self.room, self.old = encode, room, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(" " + word)
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class ByteBpe:
    """``folder`` holds byte_bpe_50k.json and byte_bpe_50k.tiktoken, one vocabulary in two formats.

    The rank file encodes short chunks (it is the faster library), the JSON file long
    ones; tests hold both against each other. An added token that a text spells out is
    text like any other if ``literal``; else the text goes to the JSON tokenizer at its
    defaults, which give the token its own id."""

    def __init__(self, folder: str, room: int = 300_000, literal: bool = True):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(os.path.join(folder, f"{VOCABULARY}.json"))
        self.full.encode_special_tokens = literal
        self.added = () if literal else tuple(t.content for t in self.full.get_added_tokens_decoder().values())
        with open(os.path.join(folder, f"{VOCABULARY}.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.short = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.memo = _Memo(self.chunk, room)

    def chunk(self, text: str) -> bytes:
        ids = self.short.encode_ordinary(text) if len(text) <= LONG_CHUNK else self.full.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32 bytes."""
        if not text:
            return b""
        if _RUN.search(text) or any(t in text for t in self.added):
            return np.asarray(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        memo = self.memo
        return self.chunk(first) + b"".join([memo[w] for w in rest])

    def decoder(self) -> list[bytes]:
        """The bytes of each id."""
        table = [b""] * (max(self.ranks.values()) + 1)
        for piece, i in self.ranks.items():
            table[i] = piece
        return table


def default_folder() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path(f"{VOCABULARY}.json"))


def open_bpe(folder: str | None = None, literal: bool = True) -> ByteBpe:
    """One instance of each kind per Python worker, kept between tasks."""
    key = (folder, literal)
    if key not in _OPEN:
        _OPEN[key] = ByteBpe(folder or default_folder(), literal=literal)
    return _OPEN[key]
