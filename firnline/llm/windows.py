"""Hashes of word windows over a batch of texts, computed on one byte buffer with numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are handled in pieces of about this many bytes (whole texts, so one longer text is a piece of its own).
PIECE_BYTES = 1_000_000

# The constants of the splitmix64 finaliser.
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words of up to this many bytes are numbers themselves; longer ones are hashed to 128 bits.
_SHORT = 7


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts, each text a byte string whose words are single-spaced.

    ``doc``: the text of each word; ``start`` and ``end``: its bytes in ``data``;
    ``left``: how many words of the same text follow, itself included.
    """

    def __init__(self, texts: list[bytes]):
        self.counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        self.data = b" ".join([t for t in texts if t])
        raw = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        n = int(self.counts.sum())
        self.start = np.concatenate([np.zeros(1, np.int64), gaps + 1])[:n]
        self.end = np.concatenate([gaps, np.array([len(raw)], np.int64)])[:n]
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        last = np.cumsum(self.counts)
        self.first = last - self.counts
        self.left = np.repeat(last, self.counts) - np.arange(n)
        self.place = np.arange(n) - np.repeat(self.first, self.counts)
        self._raw = raw

    @cached_property
    def _numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit numbers for each word; the first differs for any two words of up to _SHORT bytes, both are hashes of longer ones."""
        size = self.end - self.start
        padded = np.concatenate([self._raw, np.zeros(_SHORT, np.uint8)])
        one = size.astype(np.uint64)
        for k in range(_SHORT):
            one |= np.where(size > k, padded[self.start + k], 0).astype(np.uint64) << np.uint64(8 * k + 8)
        one, two = mix(one, 1), mix(one, 2)
        long = np.flatnonzero(size > _SHORT)
        data, digest = self.data, xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(self.start[long].tolist(), self.end[long].tolist())]), "<u8").reshape(-1, 2)
        one[long], two[long] = both[:, 0], both[:, 1]
        return one, two

    def _hashes(self, k: int, which: int) -> np.ndarray:
        """Numbers of k words, each times an odd number of its place, added up and mixed."""
        n, number = len(self.start), self._numbers[which]
        out = np.zeros(n, np.uint64)
        if n >= k:
            for i, factor in enumerate((mix(np.arange(k, dtype=np.uint64), 3 + which) | np.uint64(1)).tolist()):
                out[:n - k + 1] += number[i:n - k + 1 + i] * np.uint64(factor)
            out[:n - k + 1] = mix(out[:n - k + 1])
        return out

    def hashes(self, k: int) -> np.ndarray:
        """A hash of the k words from each word on; only valid where ``left`` is k or more."""
        return self._hashes(k, 0)

    def second(self, k: int) -> np.ndarray:
        """Another 16 bits of hash of the same words."""
        return (self._hashes(k, 1) >> np.uint64(48)).astype(np.uint16)

    def exact(self, at: np.ndarray, k: int) -> np.ndarray:
        """128-bit hashes, as two columns, of the k words from each word in ``at`` on."""
        data, digest = self.data, xxhash.xxh3_128_digest
        found = b"".join([digest(data[a:b]) for a, b in zip(self.start[at].tolist(), self.end[at + k - 1].tolist())])
        return np.frombuffer(found, ">i8").astype(np.int64).reshape(-1, 2)


def pieces(texts: pa.ChunkedArray | pa.Array, clean) -> Iterator[tuple[int, Words]]:
    """(index of the first text, words) of one piece after another; ``clean`` makes a text single-spaced."""
    group: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts.cast(pa.binary())):
        t = t.as_py()
        group.append(clean(t) if t else b"")
        size += len(group[-1])
        if size >= PIECE_BYTES:
            yield first, Words(group)
            group, size, first = [], 0, i + 1
    if group:
        yield first, Words(group)


def plain_words(text: bytes) -> bytes:
    """Words between runs of space, tab, line feed, vertical tab, form feed or carriage return."""
    return b" ".join(text.split())


# Every byte to itself if it belongs to a word of letters, digits and non-ASCII characters, in lower case; else to a space.
_ALNUM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def letter_words(text: bytes) -> bytes:
    """Words of ASCII letters (lowered), digits and non-ASCII characters."""
    return b" ".join(text.translate(_ALNUM).split())


def batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for r in rows:
        columns = [x if isinstance(x := r[f.name], pa.Array) else pa.array(x, f.type) for f in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
