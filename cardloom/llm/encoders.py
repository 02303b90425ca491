"""Encoders for public tokenizer files: each distinct stretch of a text is encoded once per process.

Both vocabularies cut a text into pre-tokens that are encoded independently. A text is cut at ASCII
white space here; each stretch is looked up, and the ids of unknown ones come from the tokenizers
library. A text of ASCII and Latin-1 letters alone is cut into pre-tokens at once; of other texts,
stretches that these rules do not cover, and texts with other white space or with an added token such
as <|endoftext|>, are given to the library as a whole. Ids are kept as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa

from cardloom.llm.common import worker_cache

CACHE = 300_000  # pre-tokens, or stretches, in each of two generations
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_PLAIN = re.compile("[!-~¡-¬®-ÿ]*")
_PLAIN_TEXT = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
_PLAIN_LOWER = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
_PLAIN_CASED = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\\s+(?!\\S)|\\s+")
_STRETCH = re.compile(rb" ?[^\x09-\x0d\x20]+|[\x09-\x0d\x20]+(?![^\x09-\x0d\x20])|[\x09-\x0d\x20]+")
_LOWER_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CASED_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in both vocabularies: printable ones for themselves, the others in order from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(other)}


_BYTE_LETTERS = _byte_letters()


class Learned(dict):
    """ids of what was met lately, in two generations; what is in neither comes from ``learn``."""

    def __init__(self, most: int, learn: Callable[[Any], bytes]):
        super().__init__()
        self.most, self.learn, self.old = most, learn, {}

    def __missing__(self, key) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.learn(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids


class Encoder:
    """ids of texts under a tokenizer file of the kind "word" (lower-cased words with ends) or "byte" (byte-level)."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = kind
        self.words, self.tokens = Learned(CACHE, self._stretch), Learned(CACHE, self._token)
        self.pattern = regex.compile(_LOWER_WORD if kind == "word" else _CASED_WORD)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _stretch(self, stretch: bytes) -> bytes:
        """ids of what stands between blanks, with a blank or white space before it."""
        t = stretch.decode("utf-8", "surrogatepass")
        if _PLAIN.fullmatch(t.strip(" \t\n\r\x0b\x0c")):
            return b"".join([self.tokens[x] for x in self.pattern.findall(t.lower() if self.kind == "word" else t)])
        return self.whole(t)

    def _token(self, token: str) -> bytes:
        """ids of a pre-token of plain letters: the model's merges over its byte letters."""
        letters = token if token.isascii() else token.encode().decode("latin-1")
        return array("I", [t.id for t in self.merge(letters.translate(_BYTE_LETTERS))]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """ids of each text as bytes; null gives none."""
        split = bytes.split if self.kind == "word" else _STRETCH.findall
        plain = _PLAIN_LOWER.findall if self.kind == "word" else _PLAIN_CASED.findall
        token, stretch = self.tokens.__getitem__, self.words.__getitem__
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif any([x in t for x in self.added]):
                out.append(self.whole(t))
            elif _PLAIN_TEXT.fullmatch(t):
                out.append(b"".join(map(token, plain(t.lower() if self.kind == "word" else t))))
            elif _WIDE_SPACE.search(t):
                out.append(self.whole(t))
            else:
                out.append(b"".join(map(stretch, split(t.encode("utf-8", "surrogatepass")))))
        return out


def encoder(path: str, kind: str) -> Encoder:
    """The encoder of this process for a file."""
    cache = worker_cache()
    if (path, kind) not in cache:
        cache[path, kind] = Encoder(path, kind)
    return cache[path, kind]


def encode_column(col: pa.Array, path: str, kind: str, end: int) -> list[bytes]:
    """ids of each text and then the id ``end``."""
    tail = np.array([end], "<u4").tobytes()
    return [x + tail for x in encoder(path, kind).encode(col.to_pylist())]
