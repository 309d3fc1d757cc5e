"""Words of whole batches of texts, and the hash buckets of their runs, as arrays.

The crc of a run follows from those of its words: appending L bytes to a text moves its crc by a linear
map that depends on L alone, so runs are never spelled out. Maps are tabled for words up to LONG bytes;
runs with longer words go through zlib one by one.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

LONG = 64
N_BUCKETS = 10_000
#: Bytes of text handled at once.
SLICE = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[128:] = True


@lru_cache(maxsize=1)
def _maps() -> tuple[np.ndarray, np.ndarray]:
    """The table of one byte's step, and for each number of bytes appended what it makes of each byte of a crc."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    moved = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    by_length = [moved]
    for _ in range(LONG + 1):
        moved = step[moved & 255] ^ (moved >> np.uint32(8))
        by_length.append(moved)
    return step, np.stack(by_length)


def _appended(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    maps = _maps()[1].reshape(-1)
    at = length.astype(np.intp) * 1024
    out = maps[at + (crc & 255)]
    for k in (1, 2, 3):
        out ^= maps[at + k * 256 + ((crc >> np.uint32(8 * k)) & 255)]
    return out


class Words:
    """The words of texts that lie end to end in ``data``, text i from ``offsets[i]`` on: their places, and
    ``text``, the text each is in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = _LOWER[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = _IN_WORD[self.low]
        breaks = np.zeros(len(data) + 1, bool)
        breaks[offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        self.start = np.flatnonzero(inside & (~before | breaks))
        end = np.flatnonzero(before & (~inside | breaks))
        self.length = end - self.start
        self.text = np.searchsorted(offsets, self.start, "right") - 1

    def crcs(self) -> np.ndarray:
        step = _maps()[0]
        order = np.argsort(-self.length, kind="stable")
        start, falling = self.start[order], -self.length[order]
        crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
        for k in range(min(LONG, -falling[0]) if len(order) else 0):
            n = np.searchsorted(falling, -k)  # the words longer than k bytes
            crc[:n] = step[(crc[:n] ^ self.low[start[:n] + k]) & 255] ^ (crc[:n] >> np.uint32(8))
        out = np.empty_like(crc)
        out[order] = ~crc
        for i in np.flatnonzero(self.length > LONG):
            out[i] = zlib.crc32(self._bytes(i))
        return out

    def _bytes(self, i: int) -> bytes:
        return self.low[self.start[i] : self.start[i] + self.length[i]].tobytes()

    def joined(self, first: np.ndarray, crc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The crcs of runs with crc ``first`` after a space and the words ``at``, whose own crcs are crc[at]."""
        length = self.length[at]
        short = np.minimum(length, LONG)
        space = np.full(len(at), zlib.crc32(b" "), np.uint32)
        out = _appended(first, short + 1) ^ _appended(space, short) ^ crc[at]
        for i in np.flatnonzero(length > LONG):
            out[i] = zlib.crc32(b" " + self._bytes(at[i]), int(first[i]))
        return out


def runs(words: Words, within: np.ndarray, across: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(owner, crc) of all runs of one to three consecutive words with one value of ``within``, its owner.
    With ``across``, of those runs only whose words have more than one value of that."""
    crc = words.crcs()
    two = np.flatnonzero(within[:-1] == within[1:])
    three = np.flatnonzero(within[:-2] == within[2:])
    if across is not None:
        two = two[across[two] != across[two + 1]]
        three = three[across[three] != across[three + 2]]
    pairs = words.joined(crc[two], crc, two + 1)
    triples = words.joined(words.joined(crc[three], crc, three + 1), crc, three + 2)
    one = np.arange(len(crc)) if across is None else np.zeros(0, np.int64)
    owner = np.concatenate([within[one], within[two], within[three]])
    return owner, np.concatenate([crc[one], pairs, triples])


def sliced(texts: pa.Array, size: int = SLICE):
    """(first row, bytes, offsets) of stretches of a text column of about ``size`` bytes; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        end = min(end, len(texts))
        yield begin, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def bucket_lists(owner: np.ndarray, crc: np.ndarray, n: int, n_buckets: int) -> pa.Array:
    """Per owner 0..n-1 its runs' buckets, two bytes each."""
    order = np.argsort(owner, kind="stable")
    buckets = (crc[order] % np.uint32(n_buckets)).astype("<u2")
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64) * 2
    large = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(buckets.tobytes())])
    return large.cast(pa.binary())


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of ``bucket_lists``, and where each list begins and the last ends."""
    if not len(lists):
        return np.zeros(0, "<u2"), np.zeros(1, np.int64)
    lists = lists.cast(pa.large_binary())
    offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1] // 2
    return np.frombuffer(lists.buffers()[2] or b"", "<u2")[offsets[0] : offsets[-1]], offsets - offsets[0]
