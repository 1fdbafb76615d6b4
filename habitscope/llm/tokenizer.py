"""The byte-level tokenizer of a public vocabulary, with the results of the tokenizers library.

Plain text goes through the rank encoder, which gives the same ids (tests compare both over every code
point); strings of the special tokens are cut out first, as the library does by default, and a long text that
holds a run of LONG_RUN characters of one kind goes through the library itself, which needs no deep recursion.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from functools import cached_property

import numpy as np

LONG_RUN = 1 << 16
_LOADED: dict[tuple[str, str], "Tokenizer"] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def load(paths: tuple[str, str]) -> "Tokenizer":
    """One instance for each process and vocabulary."""
    if paths not in _LOADED:
        _LOADED[paths] = Tokenizer(*paths)
    return _LOADED[paths]


def version(paths: tuple[str, str]) -> str:
    """A digest of the vocabulary and of what it is read with."""
    import tokenizers

    digest = hashlib.sha256(tokenizers.__version__.encode())
    with open(paths[0], "rb") as file:
        digest.update(file.read())
    return digest.hexdigest()


class Tokenizer:
    """Parts are loaded when first needed: decoding needs the pieces only, and few texts need the library."""

    def __init__(self, library_path: str, ranks_path: str):
        self.library_path = library_path
        with open(library_path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = {t["content"]: int(t["id"]) for t in described["added_tokens"]}
        del described
        with open(ranks_path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        size = max([*self.ranks.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        for text, rank in self.special.items():
            self.pieces[rank] = text.encode()
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self._parts = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)))
        half = LONG_RUN // 2
        self._long = re.compile(rf"\S{{{half}}}\S{{{half}}}|\s{{{half}}}\s{{{half}}}")

    @cached_property
    def plain(self):
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={}
        )

    @cached_property
    def library(self):
        import tokenizers

        loaded = tokenizers.Tokenizer.from_file(self.library_path)
        loaded.no_truncation()
        loaded.no_padding()
        return loaded

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """Plain stretches and special strings, in order; the id is None for a plain stretch."""
        if not any(s in text for s in self.special):
            return [(text, None)] if text else []
        found, at = [], 0
        for match in self._parts.finditer(text):
            if match.start() > at:
                found.append((text[at : match.start()], None))
            found.append((match.group(), self.special[match.group()]))
            at = match.end()
        if at < len(text):
            found.append((text[at:], None))
        return found

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        if len(text) >= LONG_RUN and self._long.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.plain.encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part, special in self.segments(text):
            ids.extend(self.encode_plain(part) if special is None else [special])
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", errors="replace")
