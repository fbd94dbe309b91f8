"""Which of many strings each text holds, as numeric kernels over the UTF-8 bytes of a whole batch of texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Marks an end of a string that no ASCII word sign may touch.
EDGE = "\0"
#: Bits of a number that are used: the sign is left alone.
BITS = 60
#: Bytes that are looked at together.
_CHUNK = 1 << 21
_WORD_SIGNS = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"))


def _code(b: bytes) -> int:
    return int.from_bytes(b[:4].ljust(4, b"\0"), "little")


def _hashed(codes: np.ndarray) -> np.ndarray:
    out = codes * np.uint32(2654435761)
    out >>= np.uint32(15)
    return out


def _within(data: np.ndarray, first: int, last: int) -> np.ndarray:
    """Whether bytes are in a range; smaller ones become great when `first` is taken from them."""
    return data - np.uint8(first) <= np.uint8(last - first)


class Finder:
    """Strings, sorted by their first bytes; those of four bytes or more by four."""

    def __init__(self, strings: Sequence[str]):
        plain = [s.strip(EDGE).encode() for s in strings]
        self.n, self.lengths = len(strings), np.array([len(b) for b in plain], np.int64)
        self.left = np.array([s.startswith(EDGE) for s in strings], bool)
        self.right = np.array([s.endswith(EDGE) for s in strings], bool)
        self.longest = max(map(len, plain), default=0)
        # the string's code at 4, 8, ... bytes from its start, and at last at 4 bytes from its end
        places = [[min(o, len(b) - 4) for o in range(4, len(b), 4)] for b in plain]
        self.steps = max(map(len, places), default=0)
        self.places, self.codes = np.zeros((self.n, self.steps), np.int64), np.zeros((self.n, self.steps), np.uint32)
        for k, (b, at) in enumerate(zip(plain, places)):
            self.places[k, : len(at)], self.codes[k, : len(at)] = at, [_code(b[o:]) for o in at]
        self.n_steps = np.array([len(at) for at in places], np.int64)
        self.by_length = []
        for size in (1, 2, 3, 4):
            own = sorted((_code(b), k) for k, b in enumerate(plain) if b and min(len(b), 4) == size)
            if own:
                codes, first = np.unique(np.array([c for c, _ in own], np.uint32), return_index=True)
                likely = np.zeros(1 << 17, bool)
                likely[_hashed(codes)] = True
                self.by_length.append((np.uint32((1 << 8 * size) - 1), likely, codes, np.append(first, len(own)), np.array([k for _, k in own])))

        # whether a string of one or two bytes may start with two bytes, and a longer one with three (hashed)
        self.short, self.long = np.zeros(1 << 16, bool), np.zeros(1 << 17, bool)
        for b in filter(None, plain):
            if len(b) > 2:
                self.long[_hashed(np.array([_code(b[:3])], np.uint32))] = True
            else:
                self.short[np.arange(256) * 256 + b[0] if len(b) == 1 else b[0] + 256 * b[1]] = True

    def pairs(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, string) for all places where a string starts; ends: where each text ends, and 0 before the first."""
        for a in range(0, len(data), _CHUNK):
            n = min(_CHUNK, len(data) - a)
            part = data[a : a + _CHUNK + self.longest + 4]
            part = np.concatenate([part, np.zeros(max(4, n + self.longest + 4 - len(part)), np.uint8)])
            here = np.ndarray(len(part) - 3, "<u4", part, strides=(1,))
            starts = here[:n].copy()
            # all numbers are in their tables: "wrap" only spares numpy a check of each
            short, long = (table.take(x, mode="wrap") for table, x in ((self.short, np.ndarray(n, "<u2", part, strides=(1,))), (self.long, _hashed(starts & np.uint32(0xFFFFFF)))))
            begun = {False: np.flatnonzero(short), True: np.flatnonzero(long)}
            for mask, likely, codes, first, strings in self.by_length:
                own = starts[begun[mask > 0xFFFF]] & mask
                at = np.flatnonzero(likely.take(_hashed(own), mode="wrap"))
                own, at = own[at], begun[mask > 0xFFFF][at]
                if not len(at):
                    continue
                k = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                same = codes[k] == own
                at, k = at[same], k[same]
                if len(strings) == len(codes):  # one string for each code
                    s = strings[k]
                else:
                    many = first[k + 1] - first[k]
                    at, s = np.repeat(at, many), strings[np.repeat(first[k], many) + np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)]
                ready = []
                for step in range(self.steps + 1):  # those whose last code was the one before are found
                    more = self.n_steps[s] > step
                    ready.append((at[~more], s[~more]))
                    at, s = at[more], s[more]
                    if not len(at):
                        break
                    same = here[np.minimum(at + self.places[s, step], len(here) - 1)] == self.codes[s, step]
                    at, s = at[same], s[same]
                at, s = (np.concatenate(x) for x in zip(*ready))
                at = at + a
                text = np.searchsorted(ends, at, "right") - 1
                end = at + self.lengths[s]
                keep = end <= ends[text + 1]
                k = np.flatnonzero(self.left[s])
                keep[k] &= ~((at[k] > ends[text[k]]) & _WORD_SIGNS[data[np.maximum(at[k] - 1, 0)]])
                k = np.flatnonzero(self.right[s])
                keep[k] &= ~((end[k] < ends[text[k] + 1]) & _WORD_SIGNS[data[np.minimum(end[k], len(data) - 1)]])
                yield text[keep], s[keep]

    def held(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row of numbers for each text: string k is bit k % BITS of number k // BITS."""
        n, width = len(ends) - 1, -(-self.n // BITS)
        bits = np.zeros((n, width * 64), bool)
        for text, s in self.pairs(data, ends):
            bits[text, s // BITS * 64 + s % BITS] = True
        return np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(n, width)


def n_words(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Matches of text.WORD in each text: runs of letters, digits, ' and - that hold a letter or digit."""
    alnum = _within(data | np.uint8(32), ord("a"), ord("z")) | _within(data, ord("0"), ord("9"))
    joint = (data == ord("'")) | (data == ord("-"))
    first = np.zeros(len(data) + 1, bool)
    first[ends] = True
    first = first[:-1]
    before = np.concatenate([[False], (alnum | joint)[:-1]]) & ~first
    begins = alnum & ~before
    d = np.flatnonzero(joint)
    if len(d):  # a letter behind signs begins a word if nothing but signs is before it in its run
        run = np.maximum.accumulate(np.where(first[d] | np.concatenate([[True], np.diff(d) != 1]), np.arange(len(d)), 0))
        led = ~first[d[run]] & alnum[np.maximum(d[run] - 1, 0)]
        follows = (d + 1 < len(data)) & ~led
        at = d[follows] + 1
        begins[at[alnum[at] & ~first[at]]] = True
    return _by_text(begins, ends)


def n_tokens(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Runs without white space in each text."""
    space = _within(data, ord("\t"), ord("\r")) | (data == ord(" "))
    before = np.concatenate([[True], space[:-1]])
    before[ends[:-1][ends[:-1] < len(data)]] = True
    return _by_text(~space & before, ends)


def _by_text(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if len(ends) > len(marks) >> 8:  # short texts
        return np.diff(np.searchsorted(np.flatnonzero(marks), ends))
    return np.array([np.count_nonzero(marks[a:b]) for a, b in zip(ends[:-1], ends[1:])], np.int64)


#: Any sign but those of which all engines of regular expressions think alike, given ASCII bounds and bounded(): printable ASCII,
#: tabs and line feeds, Latin letters whose lower case is one of them too, punctuation.
_UNLIKE = "[^\t\n -~¡-©«¬®-±´¶-¸»¿-įı-ſ‐-‧‰-‾€™−]"


def plain(texts: pa.Array) -> np.ndarray:
    """For each text whether it has only signs that all engines of regular expressions treat alike."""
    return ~pa.compute.match_substring_regex(texts, _UNLIKE).to_numpy(zero_copy_only=False).astype(bool)


def lower(texts: pa.Array, plain: np.ndarray) -> pa.Array:
    """The texts in lower case; those that aren't plain by the rules for whole texts (a letter may become two)."""
    low = pa.compute.utf8_lower(texts)
    if plain.all():
        return low
    others = [texts[int(k)].as_py().lower() for k in np.flatnonzero(~plain)]
    return pa.compute.replace_with_mask(low, pa.array(~plain), pa.array(others, texts.type))


def bounded(texts: pa.Array) -> pa.Array:
    """Plain texts whose accented letters are underscores, so that ASCII word bounds stand where they belong."""
    accented = pa.compute.invert(pa.compute.string_is_ascii(texts))
    others = texts.filter(accented)
    if not len(others):
        return texts
    data, ends = _bytes(others)
    at = np.flatnonzero(_within(data, 0xC3, 0xC5))
    at = at[(data[at] != 0xC3) | ((data[at + 1] != 0x97) & (data[at + 1] != 0xB7))]  # not the signs of times and division
    out, kept = data.copy(), np.ones(len(data), bool)
    out[at], kept[at + 1] = ord("_"), False
    ends = ends - np.searchsorted(at, ends)
    others = pa.LargeStringArray.from_buffers(len(others), pa.py_buffer(ends), pa.py_buffer(out[kept])).cast(texts.type)
    return pa.compute.replace_with_mask(texts, accented, others)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text ends and 0 before the first) of texts without nulls."""
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


@lru_cache(maxsize=8)
def finder(strings: tuple[str, ...]) -> Finder:
    return Finder(strings)


def summary(texts: pa.Array, strings: tuple[str, ...]) -> pa.Array:
    """list<int64> for each text (no nulls): n_words, n_tokens, then the numbers of Finder.held()."""
    find = finder(strings)
    data, ends = _bytes(texts)
    out, k = [], 0
    while k < len(texts):  # as many texts as make a chunk, or one longer text
        to = max(k + 1, int(np.searchsorted(ends, ends[k] + _CHUNK, "right")) - 1)
        own, at = data[ends[k] : ends[to]], ends[k : to + 1] - ends[k]
        if len(own):
            out.append(np.column_stack([n_words(own, at), n_tokens(own, at), find.held(own, at)]).astype(np.int64))
        else:
            out.append(np.zeros((to - k, 2 + -(-find.n // BITS)), np.int64))
        k = to
    width = 2 + -(-find.n // BITS)
    flat = np.concatenate(out).ravel() if out else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * width, pa.int32()), pa.array(flat))
