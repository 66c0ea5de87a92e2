"""Word shingles of texts as 64-bit hashes, computed over whole Arrow batches."""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once; what a batch takes in a worker is some 60 times as much.
BATCH = 1 << 18


@functools.lru_cache(maxsize=1)
def _all_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse. A worker keeps those of a batch; longer ones are made anew."""
    most = 2 * BATCH
    up, down = _all_powers(most) if n <= most else _all_powers.__wrapped__(n)
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop in bytes that end in a space."""
    edge = np.diff(np.concatenate([[True], _SPACE[data]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _hashes(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Shingles of each text in order; fewer words than ``width`` are one shingle, no word none."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    start, stop = word_edges(data)
    words = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(BASE))
    last = np.searchsorted(start, ends)
    first = np.concatenate([[0], last[:-1]])
    rows = max(0, len(words) - width + 1)
    full = np.zeros(rows, np.uint64)
    for j in range(width):
        full = full * np.uint64(BASE) + words[j : j + rows]
    full = mix(full)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= width:
            out.append(full[a : b - width + 1])
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * np.uint64(BASE) + w
            out.append(mix(np.array([h ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(texts: list[str | None], width: int = 5):
    """Yields each text's shingle hashes, in order, repeats included. A-Z are lower-cased, words are what stands between ASCII white space."""
    batch, size = [], 0
    for text in texts:
        data = (text or "").encode().lower()
        if batch and size + len(data) > BATCH:
            yield from _hashes(batch, width)
            batch, size = [], 0
        batch.append(data)
        size += len(data) + 1
    if batch:
        yield from _hashes(batch, width)


def word_codes(text: bytes, size: int) -> bytes:
    """``size`` bytes of hash for each word of a text."""
    return _hashes([text], 1)[0].view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
