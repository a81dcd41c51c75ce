"""Words of many texts at once, as 64-bit hashes.

Texts are handled as UTF-8 bytes in numpy: a table says which bytes belong to words, so every byte costs a
few vector operations and no Python step. Work memory is bounded: short texts are taken together up to
``SEGMENT`` bytes, longer ones are cut between words. Only a single word longer than a segment needs more.

A word's hash is a polynomial of its bytes modulo 2**64, read off running sums of ``byte * base**position``,
and then mixed. Callers that must not err compare the words themselves afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (a public 64-bit finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes in the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


class Words:
    """Word boundaries and hashes for one definition of a word."""

    def __init__(self, is_word: np.ndarray):
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.lower = lower
        self.is_word = is_word
        self._grow(SEGMENT)

    def _grow(self, n: int) -> None:
        power = np.full(n, _BASE, dtype=np.uint64)
        inverse = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        power[0] = inverse[0] = 1
        self.power, self.inverse = np.cumprod(power), np.cumprod(inverse)

    def _segment(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(data) > len(self.power):
            self._grow(len(data))
        low = self.lower[data]
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = self.is_word[low]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
        return starts, ends, mix((sums[ends] - sums[starts]) * self.inverse[starts])

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts, byte ends and hashes of the words of one text of any length."""
        parts, at = [], 0
        while at < len(data) or not parts:
            end = min(at + SEGMENT, len(data))
            if end < len(data):
                end = self._cut(data, at, end)
            starts, ends, hashes = self._segment(data[at:end])
            parts.append((starts + at, ends + at, hashes))
            at = end
            if at >= len(data):
                break
        if len(parts) == 1:
            return parts[0]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _cut(self, data: np.ndarray, at: int, end: int) -> int:
        """A place between words: the last one before ``end``, else the first one after it."""
        gaps = np.flatnonzero(~self.is_word[self.lower[data[at:end]]])
        if len(gaps):
            return at + int(gaps[-1]) + 1
        while end < len(data):
            gaps = np.flatnonzero(~self.is_word[self.lower[data[end : end + SEGMENT]]])
            if len(gaps):
                return end + int(gaps[0]) + 1
            end += SEGMENT
        return len(data)

    def each(self, texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text in turn: its number, bytes, and the starts, ends and hashes of its words.

        Null counts as empty. The line feed must not be a word byte, as it parts the texts.
        """
        group: list[bytes] = []
        first, held = 0, 0
        for i, text in enumerate(texts):
            data = (text or "").encode()
            if group and held + len(data) > SEGMENT:
                yield from self._group(first, group)
                group, first, held = [], i, 0
            group.append(data)
            held += len(data) + 1
        if group:
            yield from self._group(first, group)

    def _group(self, first: int, group: list[bytes]):
        data = np.frombuffer(b"\n".join(group), dtype=np.uint8)
        starts, ends, hashes = self.of(data)
        at = np.zeros(len(group) + 1, dtype=np.int64)
        np.cumsum([len(x) + 1 for x in group], out=at[1:])
        bounds = np.searchsorted(starts, at)
        for k in range(len(group)):
            a, b = bounds[k], bounds[k + 1]
            yield first + k, data[at[k] : at[k + 1] - 1], starts[a:b] - at[k], ends[a:b] - at[k], hashes[a:b]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; one hash of all words if there are fewer, none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(k, n)
    out = hashes[: n - size + 1].copy()
    for j in range(1, size):
        out = out * _STEP + hashes[j : n - size + 1 + j]
    return mix(out + np.uint64(size))
