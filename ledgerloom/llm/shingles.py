"""Word and shingle hashes of many texts at once, on the bytes of their UTF-8 form.

A word is hashed as a polynomial over its bytes: with running sums of byte values times powers of an odd
number, a word is the difference of two sums, so no step loops over words. Only A-Z are folded, and only
the six ASCII blanks separate words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WORDS = 5
#: Bytes hashed at a time, a longer word being taken whole, and bytes of texts gathered for one pass.
CHUNK, PART = 1 << 18, 1 << 21
_rng = np.random.default_rng(20240507)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(max(n, CHUNK), x, np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in ``data`` (uint8) and where each begins."""
    hashes, begins, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):  # cut behind a blank, the last inside or else the next
            gaps = np.flatnonzero(_BLANK[data[at:end]])
            while not len(gaps) and end < len(data):
                step = data[end : end + CHUNK]
                gaps = np.flatnonzero(_BLANK[step])[:1] + (end - at)
                end += len(step)
            end = at + int(gaps[-1]) + 1 if len(gaps) else len(data)
        part = data[at:end]
        inside = np.concatenate(([False], ~_BLANK[part], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edges[::2], edges[1::2]
        up, down = _powers(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[part] * up[:-1])))
        h = (sums[stop] - sums[start]) * down[start]
        h ^= (stop - start).astype(np.uint64) * _MIX[2]
        h ^= h >> np.uint64(32)
        h *= _MIX[3]
        h ^= h >> np.uint64(29)
        hashes.append(h)
        begins.append(start + at)
        at = end
    return np.concatenate(hashes), np.concatenate(begins)


def _mixed(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ words[i : i + n]) * _MIX[i]
        h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(32))


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    words, begin = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    first = np.searchsorted(begin, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    runs = _mixed(words, WORDS) if len(words) >= WORDS else words[:0]
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= WORDS:
            s = np.sort(runs[lo : hi - WORDS + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            yield _mixed(words[lo:hi], int(hi - lo)) if hi > lo else words[:0]


def shingle_sets(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than WORDS words are one shingle, none give none."""
    part, size = [], 0
    for t in texts:
        part.append(t or b"")
        size += len(part[-1])
        if size >= PART:
            yield from _sets(part)
            part, size = [], 0
    if part:
        yield from _sets(part)
