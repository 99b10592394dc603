"""Word hashes, n-gram hashes and MinHash signatures of whole texts in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_list(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: bytes.split() parts at exactly the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at a time; a longer word is taken whole.
_CHUNK = 1 << 16


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    base, out = 0x9E3779B97F4A7C15, []
    for x in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    ups, downs = out
    return ups, downs


def text_codes(text: str | None) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """A hash for each word of a text, the text as UTF-8, and where its words start and end.

    A word's hash is a polynomial of its bytes, read from running sums over the text, so no word is made.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    codes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        begin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + _CHUNK, "right")))
        part = np.frombuffer(raw, np.uint8, int(ends[last - 1] - begin), int(begin)).astype(np.uint64) + np.uint64(1)
        ups, downs = _powers(max(_CHUNK, 1 << (len(part) - 1).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * ups[: len(part)], dtype=np.uint64)])
        s, e = starts[first:last] - begin, ends[first:last] - begin
        codes[first:last] = (sums[e] - sums[s]) * downs[s]
        first = last
    return mixed(codes), raw, starts, ends


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with all bits stirred."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, in order."""
    count = max(0, len(codes) - n + 1)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = h * _ODD + codes[k : count + k]
    return mixed(h)


def seeds(n: int, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """32-bit multipliers (odd) and summands of n hash functions; the first ones are the same for any n."""
    a = mixed(np.arange(start + 1, start + n + 1, dtype=np.uint64) * _ODD)
    return (a >> np.uint64(32)).astype(np.uint32) | np.uint32(1), a.astype(np.uint32)


def signature(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The 32-bit MinHash of a non-empty set for each hash function; shingles are mixed 64-bit hashes."""
    out = np.full(len(mul), np.iinfo(np.uint32).max, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(low), 1024):
        block = low[start : start + 1024]
        out = np.minimum(out, (block[None, :] * mul[:, None] + add[:, None]).min(axis=1))
    return out
