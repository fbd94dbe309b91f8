"""Vectorised hashed word n-grams shared by the learning operators.

Texts are taken as UTF-8. ASCII and Latin-1 capitals are folded, and the bytes are cut into tokens: runs of
letters (bytes above 0x7F count as letters), runs of digits and runs of other visible signs; white space and
control bytes separate. A token's hash is a polynomial over its folded bytes modulo 2**64, taken for all tokens
of a block at once from prefix sums, so no Python code runs per token.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LETTER, DIGIT, SIGN = 1, 2, 3
BLOCK_BYTES = 1 << 20


def _classes() -> np.ndarray:
    out = np.full(256, SIGN, np.uint8)
    out[:33] = 0
    out[127] = 0
    out[48:58] = DIGIT
    out[65:91] = out[97:123] = LETTER
    out[128:] = LETTER
    return out


CLASS = _classes()
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least n of each."""
    if _powers.get("p", np.empty(0)).size < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        size = max(n, BLOCK_BYTES + 4096)
        for key, x in (("p", BASE), ("q", inverse)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def fold(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 (two-byte UTF-8) capitals in lower case."""
    out = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
    if raw.size > 1:
        wide = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:] += wide * np.uint8(32)
    return out


def blocks(texts: Sequence[str | None], size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, encoded texts) with about `size` bytes each; a longer text is a block of its own. Null: empty."""
    start, held, n = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and n + len(raw) > size:
            yield start, held
            start, held, n = i, [], 0
        held.append(raw)
        n += len(raw) + 1
    if held:
        yield start, held


class Tokens:
    """Tokens of a block: `doc` (index in the block), `hash` (uint64), `kind`, and with shapes=True `shape` (uint64)."""

    def __init__(self, encoded: list[bytes], shapes: bool = False, words_only: bool = False):
        raw = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
        low = fold(raw)
        cls = CLASS[raw]
        if words_only:
            cls = np.where(cls == SIGN, 0, np.minimum(cls, 1)).astype(np.uint8)
        edge = np.flatnonzero(np.diff(cls)) + 1
        starts = np.concatenate(([0], edge))
        ends = np.concatenate((edge, [raw.size]))
        keep = cls[starts] > 0
        starts, ends = starts[keep], ends[keep]
        p, q = _tables(raw.size + 1)
        total = np.empty(raw.size + 1, np.uint64)
        total[0] = 0
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[: raw.size], out=total[1:])
        self.hash = mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))
        self.kind = cls[starts]
        self._total, self._inverse, self._starts, self._ends = total, q, starts, ends
        bounds = np.cumsum([len(x) + 1 for x in encoded])
        self.doc = np.searchsorted(bounds, starts, side="right")
        self.n_docs = len(encoded)
        if shapes:
            upper = ((raw >= 65) & (raw <= 90)).astype(np.int64)
            ups = np.concatenate(([0], np.cumsum(upper)))
            n = ends - starts
            up = ups[ends] - ups[starts]
            case = np.where(up == 0, 0, np.where((up == n) & (n > 1), 3, np.where(upper[starts] == 1, 1, 2)))
            length = np.minimum(np.log2(n + 1).astype(np.int64), 6)
            code = (self.kind.astype(np.int64) * 4 + case) * 8 + length
            # signs keep their identity: "|" and "!!" are shapes of their own
            self.shape = np.where(self.kind == SIGN, self.hash, mix(code.astype(np.uint64) + np.uint64(77)))

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of the first n bytes of every token that has more."""
        long = self._ends - self._starts > n
        at = self._starts[long]
        h = (self._total[at + n] - self._total[at]) * self._inverse[at]
        return self.doc[long], mix(h + np.uint64((n << 32) + 5))

    def grams(self, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of all runs of n tokens inside a document; values: a hash for each token."""
        if n == 1:
            return self.doc, values
        m = values.size - n + 1
        if m <= 0:
            return self.doc[:0], values[:0]
        same = self.doc[:m] == self.doc[n - 1 :]
        out = values[:m].copy()
        for k in range(1, n):
            out = out * BASE + values[k : m + k]
        return self.doc[:m][same], mix(out[same] + np.uint64(n))


def features(tokens: Tokens, orders: Sequence[int], shape_orders: Sequence[int], bits: int, prefixes: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(doc, feature id below 2**bits) for every n-gram and word beginning, repeats included."""
    docs, ids = [], []
    for n in orders:
        d, h = tokens.grams(tokens.hash, n)
        docs.append(d)
        ids.append(h)
    for n in shape_orders:
        d, h = tokens.grams(tokens.shape, n)
        docs.append(d)
        ids.append(mix(h + np.uint64(1)))
    for n in prefixes:
        d, h = tokens.prefixes(n)
        docs.append(d)
        ids.append(h)
    shift = np.uint64(64 - bits)
    return np.concatenate(docs), (np.concatenate(ids) >> shift).astype(np.int64)


def counted(doc: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, id, count) of the distinct pairs, sorted by doc and id."""
    keys, n = np.unique((doc.astype(np.int64) << bits) | ids, return_counts=True)
    return keys >> bits, keys & ((1 << bits) - 1), n


@lru_cache(maxsize=4096)
def token_hash(word: str) -> int:
    """The hash that Tokens gives to one token."""
    return int(Tokens([word.encode("utf-8")]).hash[0])
