"""Byte-level BPE ids of whole texts, with a bounded cache of words."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

#: Words kept by one worker process.
CACHE_WORDS = 250_000
#: A blank with more white space beside it: such a text is encoded in one go.
_ODD = re.compile(r" \s|\s ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(self.before + word), "<u4").tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids


class Encoder:
    """Ids as a `tokenizers` file with a ByteLevel BPE model gives them, the strings of special tokens being ordinary
    text. The file's vocabulary, whose ids follow the merge order, is the rank table of the faster library."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", [])}
        byte = _bytes_of()
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        self.bpe = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.later = _Words(self.bpe.encode_ordinary, ""), _Words(self.bpe.encode_ordinary, " ")

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. No token spans a blank between two words, so words are
        encoded by themselves, each with the blank before it."""
        if not text:
            return b""
        if _ODD.search(text):
            return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker process."""
    return Encoder(path)
