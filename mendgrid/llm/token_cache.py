"""Fast encoding with a public tokenizer: every white-space chunk is encoded once and then looked up."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from operator import attrgetter
from pathlib import Path

from tokenizers import Tokenizer

# The control characters that Python counts as white space and the tokenizers' patterns don't.
_UNLIKE = re.compile("[\x1c-\x1f]")
# A Latin word, and the marks that end it before white space, are chunks of their own. The letter left out is lowered
# to a letter and an accent, which a mark is not parted from.
_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]"
# The apostrophe isn't among the marks, as patterns join it with letters.
_MARKS = r"[!-&(-/:-@\[-`{-~]"
_WORD_AND_MARK = rf"{_LATIN}+(?={_MARKS}*(?:\s|\Z))|(?<={_LATIN}){_MARKS}+(?=\s|\Z)"
_SPACED = re.compile(rf" ?{_WORD_AND_MARK}| ?\S+|\s+(?!\S)|\s+")
_DROPPED = re.compile(rf"{_WORD_AND_MARK}|\S+")
# A chunk that the tokenizers' patterns keep whole, of letters that are lowered to one letter of these.
_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
# Outside this range, and for one letter in it, lower case isn't a matter of single characters.
_NOT_PLAIN = re.compile("[^\x00-\u024f]|\u0130")
# The pattern of tokenizers that drop white space under which a Latin word stays whole.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letters that a byte-level tokenizer's model sees for the characters of a Latin word with a space before it."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x20, 0x180)}


_LETTERS = _byte_letters()
_ID = attrgetter("id")


class _Chunks(dict[str, bytes]):
    """The ids of chunks, encoded when first asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = ids = self.encode(chunk)
        return ids


class CachedEncoder:
    """``ids(text)`` equals ``tokenizer.encode(text, add_special_tokens=False).ids``.

    Two kinds of tokenizer never merge across white space: byte-level ones without normalizer, where a
    chunk is a run of other characters with the one space before it, and those that turn white space
    into separators and drop it, where a chunk is such a run (in lower case, if they lower it). ASCII marks
    that end a Latin word are a chunk too. The chunks are encoded by the tokenizer
    when first seen; beyond ``entries`` chunks the cache starts anew. A Latin word passes the tokenizer's patterns whole,
    so it goes to the tokenizer's model at once, in the letters that the byte level has for it. Texts that hold a special token's string
    or one of four control characters, and all other tokenizers, are encoded whole.
    """

    def __init__(self, path: str, entries: int = 1_390_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.entries = entries
        self.tokenize = self.tokenizer.model.tokenize
        self.cache = _Chunks(self._encoded)
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre, normalizer = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        self.chunks, self.lower, self.words = None, False, False
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not normalizer:
            self.chunks, self.words = _SPACED.findall, True
        elif pre.get("type") == "Sequence" and normalizer.get("type") == "Sequence":
            split, rest = pre["pretokenizers"][0], normalizer["normalizers"]
            kinds = [n["type"] for n in rest]
            spaces = [n for n in rest if n["type"] == "Replace"]
            drops = split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"]
            if drops and set(kinds) <= {"NFC", "Replace", "Lowercase"} and all(n["pattern"] == {"Regex": r"\s+"} for n in spaces):
                self.chunks, self.lower = _DROPPED.findall, "Lowercase" in kinds
                level = pre["pretokenizers"][1:]
                plain = [p["type"] == "ByteLevel" and not p["use_regex"] and not p["add_prefix_space"] for p in level]
                self.words = split["pattern"] == {"Regex": _SPLIT} and plain == [True]
        self.words = self.words and not any(t["normalized"] for t in spec["added_tokens"])

    def _encoded(self, chunk: str) -> bytes:
        # One by one: a call of the batch methods costs more than the few chunks a text adds.
        if self.words and _WORD.fullmatch(chunk):
            word = chunk.lower() if self.lower else chunk
            letters = word.replace(" ", _LETTERS[0x20]) if word.isascii() else word.translate(_LETTERS)
            return array("I", map(_ID, self.tokenize(letters))).tobytes()
        return self._whole(chunk)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.chunks is None or any(s in text for s in self.special) or _UNLIKE.search(text):
            return self._whole(text)
        if self.lower and not _NOT_PLAIN.search(text):
            text = text.lower()
        if len(self.cache) > self.entries:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, self.chunks(text)))


@lru_cache(maxsize=4)
def encoder(path: str) -> CachedEncoder:
    """One encoder per file and Python worker."""
    return CachedEncoder(path)
