"""Words, sentences and passages of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import joined_text

#: Bytes of text taken at a time; the arrays need some 60 times as much.
CHUNK_BYTES = 1 << 20

_LETTER = [b >= 0x80 or chr(b).isalnum() for b in range(256)]
#: Lower case for words, 10 for ends of sentences, 32 for all else.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if _LETTER[b] else 10 if chr(b) in ".!?\n" else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > limit:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def pieces(text: bytes, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a text in pieces of at most `limit` bytes, so that memory doesn't grow with the text.

    A piece ends at the end of a sentence; one without any ends behind a word, and one that is a
    single word anywhere.
    """
    at = 0
    while len(text) - at > limit:
        ends = [text.rfind(c, at, at + limit) + 1 for c in (b".", b"!", b"?", b"\n")]
        end = max(ends)
        if end <= at:
            end = max(text.rfind(c, at, at + limit) + 1 for c in (b" ", b"\t", b",", b"-"))
        if end <= at:
            end = at + limit
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a chunk of texts.

    hash: 64 bits of each folded word; start, end: its bytes; doc: its text's number;
    sentence: the number of its sentence within the chunk; starts: where each text begins.
    """

    def __init__(self, texts: list[bytes], gap: bytes = b"\n"):
        self.bytes, self.starts = joined_text(texts, gap)
        self.folded = np.frombuffer(self.bytes.tobytes().translate(FOLD), np.uint8)
        inside = np.concatenate(([False], self.folded > 32, [False]))
        turns = np.nonzero(inside[1:] != inside[:-1])[0]
        self.start, self.end = turns[::2], turns[1::2]
        length = self.end - self.start
        self.doc = np.searchsorted(self.starts, self.start, side="right") - 1
        if not len(length):
            self.hash, self.sentence = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        first = np.cumsum(length) - length
        letters = self.folded[inside[1:-1]].astype(np.uint64)
        place = np.arange(len(letters)) - np.repeat(first, length)
        power = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
        terms = (letters + np.uint64(1)) * power[place]
        self.hash = mixed(np.add.reduceat(terms, first))
        self._terms, self._place, self._first, self._length = terms, place, first, length
        stops = np.cumsum(self.folded == 10)
        at = stops[self.start]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (self.doc[1:] != self.doc[:-1])))
        self.sentence = np.cumsum(new) - 1

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the first n bytes, number of the word) of each word that is longer."""
        if not len(self.hash):
            return self.hash, np.zeros(0, np.int64)
        longer = np.nonzero(self._length > n)[0]
        sums = np.add.reduceat(np.where(self._place < n, self._terms, np.uint64(0)), self._first)
        return mixed(sums[longer] + np.uint64(n)), longer

    def n_docs(self) -> int:
        return len(self.starts) - 1


def code_points(text: bytes, offsets: list[int]) -> list[int]:
    """Byte offsets as code point offsets."""
    n = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [int(n[o]) for o in offsets]
