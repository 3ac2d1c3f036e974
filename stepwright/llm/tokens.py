"""Token ids and counts of whole texts, as the tokenizers library gives them.

Text in the alphabets of most western languages is cut into the tokenizer's own
words by one regular expression, and each different word is handed to the
library's model once, so that frequent words cost a dictionary look-up. Where no
word holds white space, what stands between it is looked up first, and cut into
words only if it is new. Texts
with any other character, or with what may be a special string, go to the
library whole; so do all texts of a tokenizer whose rules aren't known here.
Tests hold both ways against each other.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

#: Words, or pieces between white space, that are kept at hand in a worker; past this those in use stay.
MEMO_WORDS = 200_000
#: Letters of the longest word that is kept.
MEMO_LETTERS = 64

# Letters that the Unicode versions in use agree on, are composed, and have one lower-case form.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
_PLAIN = re.compile(rf"[\t\n\r -~¡«»¿–—‘’“”…{_LETTERS}]*")

# The contractions of both tokenizers' word patterns.
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_WORDS = re.compile(
    rf"{_ENDINGS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_LOWER_WORDS = re.compile(rf"{_ENDINGS}|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it is visible, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Ids or count of each word, by the library's model; words in use stay when the others go."""

    def __init__(self, model, ids: bool):
        self.model, self.ids, self.letters, self.before = model, ids, _byte_letters(), {}

    def found(self, word: str):
        plain = word.isascii() and word.isalnum()  # such letters stand for themselves
        found = self.model.tokenize(word if plain else word.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in found]).tobytes() if self.ids else len(found)

    def __missing__(self, word: str):
        if len(self) >= MEMO_WORDS:
            self.before = dict(self)
            self.clear()
        out = self.before.get(word)
        if out is None:
            out = self.found(word)
        if len(word) <= MEMO_LETTERS:
            self[word] = out
        return out


class _Pieces(_Memo):
    """Ids of what stands between white space; a piece that is no word is put together from its words'."""

    def found(self, piece: str):
        if piece.isalpha():
            return super().found(piece)
        words = _LOWER_WORDS.findall(piece)
        return super().found(piece) if len(words) == 1 else b"".join(map(self.__getitem__, words))


class Encoder:
    """Ids or counts of texts, without added special tokens, truncation or padding."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        rules = json.loads(self.tokenizer.to_str())
        self.words, self.lower = self._known(rules), False
        if self.words is _LOWER_WORDS:
            self.lower = True
        self.special = [t["content"] for t in rules["added_tokens"]]
        model = self.tokenizer.model
        self.counts_of, self.ids_of = _Memo(model, False), _Memo(model, True)
        if self.lower:
            self.ids_of = _Pieces(model, True)

    @staticmethod
    def _known(rules: dict) -> re.Pattern | None:
        first, pre = rules["normalizer"], rules["pre_tokenizer"] or {}
        if any(t["normalized"] for t in rules["added_tokens"]) or rules["model"]["type"] != "BPE":
            return None
        if first is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return _BYTE_WORDS
        steps = [s["type"] for s in (first or {}).get("normalizers", [])]
        split = pre.get("pretokenizers", [{}])
        if steps == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in split] == ["Split", "ByteLevel"] \
                and split[0]["pattern"].get("Regex") == _ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" \
                and split[0]["invert"] and split[0]["behavior"] == "Removed" and not split[1]["use_regex"]:
            return _LOWER_WORDS
        return None

    def _plain(self, text: str) -> bool:
        return (self.words is not None and not any(s in text for s in self.special)
                and _PLAIN.fullmatch(text) is not None)

    def count(self, text: str) -> int:
        if self._plain(text):
            return sum(map(self.counts_of.__getitem__, self.words.findall(text.lower() if self.lower else text)))
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str) -> np.ndarray:
        if self._plain(text):
            pieces = text.lower().split() if self.lower else self.words.findall(text)
            found = map(self.ids_of.__getitem__, pieces)
            return np.frombuffer(b"".join(found), np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def version(path: str) -> str:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def file_of(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
