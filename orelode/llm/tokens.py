"""Token ids of whole texts by a public tokenizer, with a cache of words."""

from __future__ import annotations


import re
import unicodedata
from array import array

import numpy as np

#: A text with one of these is encoded in one piece: added tokens, and characters that str.split drops but the tokenizer keeps.
_WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Words of assigned letters, marks, digits, punctuation and symbols up to the Armenian block are split here; others by the tokenizer itself.
_PLAIN = re.compile("[" + "".join(f"\\u{c:04x}" for c in range(0x21, 0x590) if unicodedata.category(chr(c))[0] in "LMNPS") + "]*")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Words(dict):
    """Ids by word, in two generations: what the younger one lacks is taken from the older one or made."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = self.make(word)
        self[word] = got
        return got

    def trim(self) -> None:
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()


class WordTokenizer:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    For the word-BPE file: it normalises (NFC, lower case), splits by a pattern
    that never crosses white space, and merges within the parts. The ids of a
    text are then those of its words one after another, and each distinct word
    and part is merged once. The cache holds about twice ``size`` words at most:
    those not seen since the last time that it was full go.
    """

    def __init__(self, path: str, size: int = 250_000):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts_of = regex.compile(split).findall
        self.letters = _byte_letters()
        self.words = _Words(self._word, size)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a part, which is also a word of its own."""
        got = self.words.get(part) or self.words.older.get(part)
        if got is None:
            letters = part if part.isascii() and part.isprintable() else "".join(map(self.letters.__getitem__, part.encode()))
            got = self.words[part] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return got

    def _word(self, word: str) -> bytes:
        if word.isascii():
            low = word.lower()
        elif _PLAIN.fullmatch(word) and unicodedata.is_normalized("NFC", word):
            low = "".join(map(str.lower, word))
        else:
            return self._whole(word)
        if low.isalpha():  # one part, the usual case
            return self._part(low)
        if low[:-1].isalpha():  # a part and one character after it
            return self._part(low[:-1]) + self._part(low[-1])
        return b"".join(map(self._part, self.parts_of(low)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode_one(t or "") for t in texts]

    def encode_one(self, text: str) -> bytes:
        if any(x in text for x in _WHOLE):
            return self._whole(text)
        self.words.trim()
        return b"".join(map(self.words.__getitem__, text.split()))


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process, kept between tasks."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
