"""Hashes of the words and word shingles of many texts at once, in numpy, on UTF-8 bytes.

A word's hash is a polynomial over random byte values modulo 2^64, read off a prefix array, so the cost is a few
array passes per byte and nothing per word.  ``A-Z`` count as ``a-z``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
SPACE = b" \t\n\x0b\x0c\r"
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are hashed in one go; a longer text is taken alone and whole.
BLOCK = 1 << 20

_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(base: int, n: int) -> np.ndarray:
    """``base^0 .. base^(n-1)`` modulo 2^64, by doubling; kept by the worker."""
    had = _POWERS.get(base)
    if had is None or len(had) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        had = np.ones(size, dtype=np.uint64)
        filled = 1
        while filled < size:
            had[filled : 2 * filled] = had[:filled] * U(pow(base, filled, 1 << 64))
            filled *= 2
        _POWERS[base] = had
    return had[:n]


def byte_values() -> np.ndarray:
    """Random odd 64-bit values of the 256 bytes, upper case as lower."""
    values = mix(np.arange(1, 257, dtype=np.uint64)) | U(1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


VALUES = byte_values()


def separators(keep_punctuation: bool = True) -> np.ndarray:
    """Which bytes separate words: white space, or all ASCII that is neither letter nor digit."""
    table = np.zeros(256, dtype=bool)
    table[list(SPACE)] = True
    if not keep_punctuation:
        table[:128] = [not chr(b).isalnum() for b in range(128)]
    return table


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """``(first, last, bytes, offsets)``: runs of texts joined by line ends; text i starts at ``offsets[i]``."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > BLOCK:
            yield first, i, *_joined(held)
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, len(texts), *_joined(held)


def _joined(held: list[bytes]) -> tuple[bytes, np.ndarray]:
    offsets = np.zeros(len(held) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in held], out=offsets[1:])
    return b"\n".join(held) + b"\n", offsets


def word_hashes(raw: bytes, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, hashes)`` of the words of a run of texts, in byte positions."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = ~separator[data]
    change = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = change[::2], change[1::2]
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(VALUES[data] * powers(BASE, len(data)), out=prefix[1:])
    spans = (prefix[ends] - prefix[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts]
    return starts, ends, mix(spans + (ends - starts).astype(np.uint64) * U(0xA0761D6478BD642F))


def shingle(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; one of the whole sequence where there are fewer, none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = (out + hashes[j : n - width + 1 + j]) * U(BASE)
        out ^= out >> U(29)
    return mix(out)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, read off a prefix array: long runs cost no more than short ones."""
    n = len(hashes)
    if n < size:
        return hashes[:0]
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(BASE, n), out=prefix[1:])
    return mix((prefix[size:] - prefix[:-size]) * powers(BASE_INVERSE, n + 1)[: n - size + 1])


def shingle_sets(texts: list[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its shingles."""
    separator = separators()
    for _, _, raw, offsets in blocks(texts):
        starts, _, hashes = word_hashes(raw, separator)
        yield from _sets_within(hashes, np.searchsorted(starts, offsets), k)


def _sets_within(hashes: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sets of the texts whose words begin at ``bounds``; shingles over the end of a text are left out."""
    whole = shingle(hashes, k)
    spans = [(a, b, max(a, b - k + 1)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    for a, _, end in spans:
        whole[a:end].sort()
    again = np.zeros(len(whole) + 1, dtype=bool)
    again[1:-1] = whole[1:] == whole[:-1]
    again[bounds[:-1][bounds[:-1] < len(whole)]] = False
    before = np.concatenate(([0], np.cumsum(again))).tolist()
    for a, b, end in spans:
        if end == a:
            yield np.unique(shingle(hashes[a:b], k))
        elif before[end] == before[a]:
            yield whole[a:end]
        else:
            yield whole[a:end][~again[a:end]]


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """The smallest value of each of ``count`` hashes over each (non-empty) set: ``(sets, count)``."""
    out = np.empty((len(sets), count), dtype=np.uint64)
    multipliers = mix(np.arange(1000, 1000 + count, dtype=np.uint64)) | U(1)
    masks = mix(np.arange(5000, 5000 + count, dtype=np.uint64))
    at = 0
    while at < len(sets):
        upto, held = at, 0
        while upto < len(sets) and (held == 0 or held + len(sets[upto]) <= 1 << 15):
            held += len(sets[upto])
            upto += 1
        values = np.concatenate(sets[at:upto])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : upto - 1]], dtype=np.int64))).astype(np.int64)
        for k in range(count):
            out[at:upto, k] = np.minimum.reduceat((values ^ masks[k]) * multipliers[k], starts)
        at = upto
    return out
