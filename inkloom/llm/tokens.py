"""Token ids by the tokenizers library, with a bounded memo of the pieces between spaces.

Ids are those of the library's plain call, encode(text, add_special_tokens=False): the string of an added token in a text
becomes that token's id. A byte-level pre-tokenizer only joins a space to what follows it, so a text may be cut before
any space that stands after a visible sign, and the ids of the pieces, one after another, are the ids of the text. Pieces
repeat, so their ids are kept; a new piece is cut into the pre-tokenizer's words, whose ids the library's BPE model gives.
Texts with a space after other white space or with an added token's string are encoded whole, and so is every text where
the file names another normaliser, pre-tokenizer or model.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from operator import attrgetter

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

DEFAULT_FILE = "byte_bpe_50k.json"
#: What a file must say for its texts to be cut: the pre-tokenizer that WORDS states, and no normaliser.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: The byte-level pre-tokenizer's pattern, in the syntax of the regex module (a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIMPLE_TAILS = frozenset(".,;:!?")
MOST_PIECES, MOST_WORDS = 600_000, 300_000
_ID = attrgetter("id")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself if visible in Latin-1, else the next one from 256 on."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b] = chr(more)
            more += 1
    return out


class _Uncuttable(Exception):
    """A space stands after other white space."""


class _Memo(dict):
    """At most `most` entries; it starts anew when full."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


class Encoder:
    """encode(text): the ids of a whole text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
        self.cuttable = (
            not said.get("normalizer")
            and not said.get("truncation")
            and {k: before.get(k, True) for k in BYTE_LEVEL} == BYTE_LEVEL
            and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        added = [t["content"] for t in said.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))).search if added else None
        self.letters = _byte_letters()
        self.cut = regex.compile(WORDS).findall
        self.words = _Memo(self._word, MOST_WORDS)
        self.pieces = _Memo(self._piece, MOST_PIECES)

    def _word(self, word: str) -> bytes:
        plain = word.removeprefix(" ")
        if plain.isascii() and plain.isalnum():  # letters that stand for themselves
            letters = word if plain is word else self.letters[ord(" ")] + plain
        else:
            letters = word.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", map(_ID, self.model.tokenize(letters))).tobytes()

    def _piece(self, rest: str) -> bytes:
        """Ids of a space and `rest`, before which and after which the text may be cut."""
        if not rest or rest[-1].isspace():
            raise _Uncuttable
        if rest.isalpha():
            return self.words[" " + rest]
        if rest[-1:] in SIMPLE_TAILS and rest[:-1].isalpha():
            return self.words[" " + rest[:-1]] + self.words[rest[-1]]
        return self._cut(" " + rest)

    def _cut(self, text: str) -> bytes:
        return b"".join([self.words[w] for w in self.cut(text)])

    def whole(self, text: str) -> bytes:
        """The library's own call, without the memo."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuttable or self.added and self.added(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        if not rest:
            return self._cut(first)
        last = rest.pop()
        if first[-1:].isspace():
            return self.whole(text)
        try:
            return self._cut(first) + b"".join(map(self.pieces.__getitem__, rest)) + (self._cut(f" {last}") if not last or last[-1].isspace() else self.pieces[last])
        except _Uncuttable:
            return self.whole(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)
