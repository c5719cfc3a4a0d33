"""Token ids of whole texts by a public tokenizer, with a bounded cache of words.

The tokenizer drops white space and never joins across it, so a text's ids are those of its words, one after another; it
also cuts between a letter and marks after it. Words are cut on bytes, the distinct ones of a chunk are looked up once,
and their ids are laid out for all places at once. Each Python worker keeps the ids of the first ``CACHE`` words it meets;
other words are encoded once a chunk. A task of another operator drops them (``common.keep``).
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa

from parlance.llm.common import keep
from parlance.llm.words import SPACE

#: Words that a worker keeps at most (about 230 bytes each).
CACHE = 900_000
END = 2
#: Bytes of text that are looked up at once; one longer text makes a longer chunk of its own.
CHUNK = 4 << 20
#: ASCII characters that the tokenizer cuts off from letters before them, as one run; longer runs than ``RUN`` aren't cut off.
_MARKS, RUN = b".,!?;:*#%$&|", 8
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(_MARKS)] = True
#: Letters that are lower case and composed already, in UTF-8 (U+00DF to U+00FF without the division sign).
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: How the tokenizer's vocabulary spells the bytes of those letters that are no ASCII.
_SPELLED = {b: chr(b) for b in range(0x80, 0x100)} | {b: chr(0x122 + b - 0x80) for b in range(0x80, 0xA1)} | {0xAD: chr(0x143)}
_IS_AZ, _IS_SECOND = np.zeros(256, bool), np.zeros(256, bool)
_IS_AZ[97:123] = True
_IS_SECOND[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True


class _Held:
    """A tokenizer, its model for words that need neither normalisation nor cutting, and its words so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.words: dict[bytes, bytes] = {b"": b""}

    def pieces(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one piece each: plain letters, or marks only. The library's model takes them as they are."""
        tokenize = self.model.tokenize
        spelled = [w.decode() if w.isascii() else w.decode("latin-1").translate(_SPELLED) for w in words]
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in spelled]

    def alone(self, words: list[bytes]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.full.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        plain = [w.isalpha() and w.islower() or _PLAIN.fullmatch(w) is not None or not w.strip(_MARKS) for w in new]
        pieces = iter(self.pieces([w for w, own in zip(new, plain, strict=True) if own]))
        alone = iter(self.alone([w for w, own in zip(new, plain, strict=True) if not own]))
        return [next(pieces if own else alone) for own in plain]


_HELD: dict[str, _Held] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _cut(raw: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in bytes that end in white space; marks after a plain letter are words of their own."""
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    starts, stops = edges[::2], edges[1::2]
    own = _IS_MARK[raw[stops - 1]]
    first, at = starts[own], stops[own] - 1
    for _ in range(RUN):
        more = _IS_MARK[raw[at - 1]] & (at > first)
        if not more.any():
            break
        at = at - more
    letter = _IS_AZ[raw[at - 1]] | _IS_SECOND[raw[at - 1]] & (raw[at - 2] == 0xC3)
    at = at[letter & (at > first)]
    return np.sort(np.concatenate([starts, at]), kind="stable"), np.sort(np.concatenate([stops, at]), kind="stable")


def _encoded(held: _Held, own: list[bytes], cache: int) -> Iterable[bytes]:
    # the tokenizer lower-cases too, but finds its special tokens before it does
    raw = np.frombuffer(b"\n".join([x if b"|>" in x else x.lower() for x in own]) + b"\n", np.uint8)
    space = SPACE[raw]
    starts, stops = _cut(raw, space)
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~space])]).dictionary_encode()
    which = coded.indices.to_numpy()
    _, bounds, letters = coded.dictionary.buffers()
    bounds, letters = np.frombuffer(bounds, np.int32, len(coded.dictionary) + 1).tolist(), bytes(letters or b"")
    words = [letters[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    known = held.words
    ids = list(map(known.get, words))
    missing = [k for k, x in enumerate(ids) if x is None]
    if missing:
        new = [words[k] for k in missing]
        found = held.learn(new)
        known.update(islice(zip(new, found, strict=True), max(0, cache - len(known))))
        for k, x in zip(missing, found, strict=True):
            ids[k] = x
    size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
    count = size[which]
    before = np.concatenate([[0], np.cumsum(count)])
    place = np.repeat((np.cumsum(size) - size)[which] - before[:-1], count)
    place += np.arange(len(place))
    flat = np.frombuffer(b"".join(ids), "<u4")[place].tobytes()
    ends = (before[np.searchsorted(starts, np.cumsum([len(x) + 1 for x in own]))] * 4).tolist()
    return (flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))


def encode(texts: list[bytes], path: str, cache: int = CACHE) -> list[bytes]:
    """Little-endian 32-bit ids of each text, without an end id; a worker learns no more words than ``cache``."""
    if path not in _HELD:
        _HELD[path] = _Held(path)
    keep("tokens", _HELD.clear)
    held = _HELD[path]
    out: list[bytes] = []
    first, size = 0, 0
    for last, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK or last == len(texts) - 1:
            out += _encoded(held, texts[first : last + 1], cache)
            first, size = last + 1, 0
    return out
