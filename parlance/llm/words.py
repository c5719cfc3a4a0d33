"""Vectorised word tables over UTF-8 bytes.

A chunk of whole texts is laid into one byte array, each text followed by a line feed. White space is ASCII only, and
those bytes never occur inside a multi-byte character, so words can be cut on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RANDOM = np.random.default_rng(20_240_601)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are laid out at once; one longer text makes a longer chunk of its own.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS = np.ones(64, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.ones(max(n, 2 * len(_POWERS)), np.uint64)
    if _POWERS[-1] == 1:
        with np.errstate(over="ignore"):
            _POWERS[1:] = _STEP
            _POWERS = np.cumprod(_POWERS, dtype=np.uint64)
    return _POWERS


class Chunk:
    """Texts ``first`` to ``last`` (exclusive) of a batch: bytes, words and hashes."""

    def __init__(self, texts: list[bytes], first: int, last: int, space: np.ndarray = SPACE):
        self.first, self.last = first, last
        own = texts[first:last]
        self.bytes = np.frombuffer(b"\n".join(own) + b"\n", np.uint8)
        ends = np.cumsum([len(x) + 1 for x in own])
        #: Where each text begins, and the end of the last.
        self.text_at = np.concatenate([[0], ends])
        self.space = space[self.bytes]
        edges = np.diff(self.space.astype(np.int8), prepend=1)
        self.starts = np.flatnonzero(edges == -1)
        self.ends = np.flatnonzero(edges == 1)
        #: The first word of each text, and the number of words.
        self.word_at = np.searchsorted(self.starts, self.text_at)

    def hashes(self, values: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word; values replace the bytes (such as lower-cased ones)."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        place = np.arange(len(self.bytes)) - np.repeat(self.starts, np.diff(np.append(self.starts, len(self.bytes))), axis=0) if self.starts[0] == 0 else self._places()
        place[self.space] = 0
        mixed = _BYTE[self.bytes if values is None else values] * _powers(int(lengths.max()) + 1)[place]
        mixed[self.space] = 0
        return mix(np.add.reduceat(mixed, self.starts) + lengths.astype(np.uint64) * _STEP)

    def _places(self) -> np.ndarray:
        place = np.zeros(len(self.bytes), np.int64)
        begin = self.starts[0]
        place[begin:] = np.arange(len(self.bytes) - begin) - np.repeat(self.starts - begin, np.diff(np.append(self.starts, len(self.bytes))))
        return place

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a byte array over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.text_at[1:]] - total[self.text_at[:-1]]

    def per_text_words(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a word array over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)])
        return total[self.word_at[1:]] - total[self.word_at[:-1]]


def chunks(texts: list[bytes], space: np.ndarray = SPACE) -> Iterator[Chunk]:
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > CHUNK:
            yield Chunk(texts, first, i, space)
            first, held = i, 0
        held += len(text) + 1
    if first < len(texts):
        yield Chunk(texts, first, len(texts), space)


def lowered(values: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    upper = (values >= 65) & (values <= 90)
    return values + (upper * np.uint8(32)).astype(np.uint8)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of ``width`` words; the array is ``width - 1`` shorter."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[i : i + n]
    return mix(out)
