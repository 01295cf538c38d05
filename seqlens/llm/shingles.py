"""Word shingles as 64-bit hashes, and minhashes over batches of documents (numpy inside tasks)."""

from __future__ import annotations

import numpy as np

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(31)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer than k words: one shingle; none: empty."""
    n = len(words)
    if n == 0:
        return words
    w = min(k, n)
    h = np.full(n - w + 1, np.uint64(w))
    for i in range(w):
        h = mix(h * _M1 + words[i:n - w + 1 + i])
    return np.unique(h)


def coefficients(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, count, dtype=np.uint64)


def minhashes(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(documents, functions) minima; every set must be non-empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), len(a)), np.uint64)
    for i in range(len(a)):
        x = flat * a[i] + b[i]
        out[:, i] = np.minimum.reduceat(x ^ (x >> _S), starts)
    return out


_TABLE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xC2B2AE3D27D4EB4F
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64; at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each text the hashes of its words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered; null has none."""
    texts = [t or b"" for t in texts]
    buf = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    start, _, h = hashed_runs(buf, (buf == 32) | (buf >= 9) & (buf <= 13))
    stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    cut = np.append(0, np.searchsorted(start, stop)).tolist()
    return [h[a:b] for a, b in zip(cut, cut[1:])]


def batched(rows, size, limit: int = 1_000_000):
    """Lists of rows whose ``size(row)`` adds up to about ``limit``."""
    part, held = [], 0
    for r in rows:
        part.append(r)
        held += size(r)
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part


def run_hashes(texts: list[bytes], batch: int = 1_000_000) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its runs of bytes other than 32, in order, by array operations."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t) + 1
        if held >= batch:
            out += _run_hashes(part)
            part, held = [], 0
    return out + _run_hashes(part) if part else out


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[:len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _M1)


def hashed_runs(buf: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the runs of ``buf`` between gaps; the last byte must be a gap."""
    before = np.append(True, gap[:-1])
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    return start, end, span_hashes(buf, start, end)


def _run_hashes(texts: list[bytes]) -> list[np.ndarray]:
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    start, _, h = hashed_runs(buf, buf == 32)
    stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    cut = np.append(0, np.searchsorted(start, stop)).tolist()
    return [h[a:b] for a, b in zip(cut, cut[1:])]
