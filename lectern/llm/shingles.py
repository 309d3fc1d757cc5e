"""Word shingles as 64-bit hashes, vectorised over the bytes of many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
#: True for bytes that end a word: space, \t, \n, \v, \f, \r.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that all bits depend on all (splitmix64's constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE[_IS_SPACE] = 0
_BASE = _U(0xD1342543DE82EF95)
_PLACE = mixed(np.arange(1001, 1001 + 64, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_powers = np.ones(1, _U)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _BASE)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): hashes of all words of all texts in order, and where each text's end."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _IS_SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    starts, stops = edges[0::2], edges[1::2]
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    ends = np.searchsorted(starts, text_ends)
    if not len(starts):
        return np.zeros(0, _U), ends
    sizes = stops - starts
    powers = _powers_to(int(sizes.max()))
    at = np.flatnonzero(~space)
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(firsts, sizes)
    values = _BYTE[raw[at]] * powers[place]
    return mixed(np.add.reduceat(values, firsts) + sizes.astype(_U)), ends


def shingle_sets(texts: list[str | None], n: int = 5, chunk_bytes: int = 1 << 21) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-word shingles (A-Z lower-cased); shorter texts have their
    words as one shingle; no word, no shingle. Works through chunk_bytes at a time, whole texts."""
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode().lower())
        size += len(held[-1])
        if size >= chunk_bytes:
            yield from _chunk(held, n)
            held, size = [], 0
    if held:
        yield from _chunk(held, n)


def _chunk(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    words, ends = word_hashes(texts)
    starts = np.concatenate([[0], ends[:-1]])
    count = max(0, len(words) - n + 1)
    windows = np.zeros(count, _U)
    for k in range(n):
        windows += words[k : k + count] * _PLACE[k]
    windows = mixed(windows)
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a >= n:
            yield np.unique(windows[a : b - n + 1])
        elif b > a:
            yield mixed((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _U(b - a))
        else:
            yield words[:0]
