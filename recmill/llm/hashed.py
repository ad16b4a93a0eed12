"""Hashed character and word features of texts, and linear models on them, over arrays of bytes."""

from __future__ import annotations

import numpy as np

#: Buckets of either kind of feature.
CHAR_BUCKETS, WORD_BUCKETS = 1 << 14, 1 << 14
_POWER = np.cumprod(np.append(1, np.full(63, 31, np.uint64)).astype(np.uint64), dtype=np.uint64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(char buckets, their text, word buckets, their text) of all texts at once; texts are numbered in order.

    A character feature is three consecutive bytes of the lower-cased text, a word feature a run of letters.
    """
    raw = [t.lower().encode("utf-8", "replace") + b"\n\n" for t in texts]
    a = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) for r in raw])
    if len(a) < 3:
        none = np.zeros(0, np.int32)
        return none, none, none, none
    x = a.astype(np.uint32)
    with np.errstate(over="ignore"):
        tri = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)
        tri = ((tri ^ (tri >> np.uint32(15))) & np.uint32(CHAR_BUCKETS - 1)).astype(np.int32)
        letter = ((a >= 97) & (a <= 122)) | (a >= 128)
        begin = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
        end = np.flatnonzero(letter & ~np.append(letter[1:], False)) + 1
        if not len(begin):
            return tri, owner[:-2], np.zeros(0, np.int32), np.zeros(0, np.int32)
        at = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a)))) if begin[0] == 0 else np.concatenate([np.zeros(begin[0], np.int64), np.arange(begin[0], len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))])
        sums = np.cumsum(np.where(letter, a.astype(np.uint64) * _POWER[np.minimum(at, 63)], np.uint64(0)), dtype=np.uint64)
        h = sums[end - 1] - np.where(begin > 0, sums[begin - 1], np.uint64(0))
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return tri, owner[:-2], (h & np.uint64(WORD_BUCKETS - 1)).astype(np.int32), owner[begin]


def scores(weights: np.ndarray, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean weight of every text's features, for each class; texts without a feature get zeros."""
    out = np.stack([np.bincount(owner, weights=weights[:, c][bucket], minlength=n) for c in range(weights.shape[1])], 1)
    return out / np.maximum(np.bincount(owner, minlength=n), 1)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(bucket: np.ndarray, owner: np.ndarray, target: np.ndarray, buckets: int, l2: float = 1e-6, rounds: int = 60, rate: float = 400.0) -> np.ndarray:
    """Softmax regression on mean feature counts with an L2 penalty, by gradient steps with momentum; zeros at the start."""
    n, k = target.shape
    w, v = np.zeros((buckets, k)), np.zeros((buckets, k))
    size = np.maximum(np.bincount(owner, minlength=n), 1)
    for _ in range(rounds):
        off = (softmax(scores(w, bucket, owner, n)) - target) / size[:, None] / max(n, 1)
        g = np.stack([np.bincount(bucket, weights=off[:, c][owner], minlength=buckets) for c in range(k)], 1) + l2 * w
        v = 0.9 * v - rate * g
        w += v
    return w


def fit_rows(x: np.ndarray, target: np.ndarray, l2: float = 1e-3, rounds: int = 400, rate: float = 0.5) -> np.ndarray:
    """Softmax regression on dense rows (a constant is added): weights of shape (columns + 1, classes)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((x.shape[1], target.shape[1]))
    for _ in range(rounds):
        w -= rate * (x.T @ (softmax(x @ w) - target) / max(len(x), 1) + l2 * w)
    return w
