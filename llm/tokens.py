"""Whole-text encoding through the `tokenizers` library with a bounded cache of pre-tokens.

Byte-pair encoders treat every pre-token on its own, so the ids of a text are the ids of its
pre-tokens in order.  Texts made only of characters whose class is the same in every Unicode
version are cut here and looked up; new pre-tokens go through the library's model once.
Any other text (and any text that may hold a special string) goes through the library whole.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import os
import re
from collections.abc import Iterable

import numpy as np

from llm.common import CACHES, enter

#: Letters and numbers of ASCII, Latin-1 and Latin Extended-A without U+0130 and U+0149 (fixed values).
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ňŊ-ſ"
NUMBERS = "0-9²³¹¼½¾"
SPACES = "\\t\\n\\r "
UNSAFE = re.compile("[^\\t\\n\\r -~¡-¬®-įı-ňŊ-ſ]|<\\|")
#: Pre-token rules of the two JSON vocabularies, for the safe characters (fixed values).
BYTE_LEVEL = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
WORD_END = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Cached pre-tokens of one worker process; the cache starts again when it is full.
CACHE_ENTRIES = 150_000
#: Longer pre-tokens are encoded each time.
LONGEST_CACHED = 48
#: The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest follow from U+0100 on.
PRINTABLE = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
BYTE_LETTERS = "".join(chr(b) if b in PRINTABLE else chr(0x100 + b - sum(p < b for p in PRINTABLE)) for b in range(256))
#: Bytes of ASCII that are safe.
SAFE_BYTES = bytes([9, 10, 13, *range(0x20, 0x7F)])


def vocabulary_path(name: str) -> str:
    """The place of a vocabulary file; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def load(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(8)
def version_digest(name: str) -> str:
    """SHA-256 of the vocabulary file and the library's version."""
    import tokenizers

    h = hashlib.sha256(tokenizers.__version__.encode() + b"\0")
    with open(vocabulary_path(name), "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            h.update(part)
    return h.hexdigest()


def is_safe(text: str) -> bool:
    if text.isascii():
        return "<|" not in text and not text.encode().translate(None, SAFE_BYTES)
    return UNSAFE.search(text) is None


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids, or counts them."""

    def __init__(self, name: str, counts: bool = False):
        self.tokenizer, self.counts, self.cache = load(name), counts, {}
        self.model = self.tokenizer.model
        kind = type(self.tokenizer.pre_tokenizer).__name__
        lower = self.tokenizer.normalizer is not None
        self.lower = lower
        self.pattern = WORD_END if kind == "Sequence" and lower else BYTE_LEVEL if kind == "ByteLevel" and not lower else None

    def _value(self, ids: list[int]):
        return len(ids) if self.counts else np.array(ids, "<u4").tobytes()

    def _whole(self, text: str):
        return self._value(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str):
        """A pre-token through the library's model, its bytes written as byte-level letters."""
        return self._value([t.id for t in self.model.tokenize(codecs.charmap_decode(word.encode(), "strict", BYTE_LETTERS)[0])])

    def encode(self, texts: Iterable[str]):
        """Yields a value for each text, in order."""
        for text in texts:
            if self.pattern is None or not is_safe(text):
                yield self._whole(text)
                continue
            words = self.pattern.findall(text.lower() if self.lower else text)
            found = list(map(self.cache.get, words))
            if None in found:
                if len(self.cache) > CACHE_ENTRIES:
                    self.cache.clear()
                for i, value in enumerate(found):
                    if value is None:
                        word = words[i]
                        found[i] = value = self._word(word)
                        if len(word) <= LONGEST_CACHED:
                            self.cache[word] = value
            yield sum(found) if self.counts else b"".join(found)


@functools.lru_cache(4)
def _encoder(name: str, counts: bool) -> Encoder:
    return Encoder(name, counts)


def encoder(name: str, counts: bool = False) -> Encoder:
    """One encoder, and so one cache, for each worker process, until it does other work."""
    enter("tokens")
    return _encoder(name, counts)


def _empty() -> None:
    _encoder.cache_clear()
    load.cache_clear()


CACHES["tokens"] = _empty
