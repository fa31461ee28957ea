"""Word shingles as 64-bit hashes, and what a chosen-path join needs of a set.

All numpy; the functions take a list of texts so that words are hashed once for
many texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

from loanlens.llm.tokenizing import spaced_chunks

WIDTH = 5
BINS = 128
_U = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                         0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)
#: Elements hashed at a time for one set.
CHUNK = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles; fewer
    words make one shingle, no words an empty set."""
    words = [spaced_chunks(t) for t in texts]
    flat = [w for own in words for w in own]
    if not flat:
        return [np.zeros(0, _U) for _ in texts]
    hashed = pd.util.hash_array(np.array(flat, dtype=object))
    n, total = len(hashed), np.zeros(len(hashed), _U)
    for k in range(min(width, n)):
        total[:n - k] += hashed[k:] * _MULTIPLIERS[k % 5] + _U(k // 5)
    rolled, out, at = mix(total), [], 0
    for own in words:
        if len(own) >= width:
            out.append(np.unique(rolled[at:at + len(own) - width + 1]))
        elif own:
            short = (hashed[at:at + len(own)] * _MULTIPLIERS[np.arange(len(own)) % 5]).sum(dtype=_U)
            out.append(mix(np.array([short + _U(len(own))])))
        else:
            out.append(np.zeros(0, _U))
        at += len(own)
    return out


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.md5(s.tobytes()).digest() if len(s) else None


def sketch(s: np.ndarray) -> bytes:
    """One byte for each of 128 hash ranges: of the least element there, 0 if none."""
    edges = np.arange(BINS, dtype=_U) << _U(57)
    at = np.searchsorted(s, edges)
    ends = np.append(at[1:], len(s))
    least = s[np.minimum(at, len(s) - 1)]
    return np.where(ends > at, 1 + mix(least) % _U(255), _U(0)).astype(np.uint8).tobytes()


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """For all rows of sketches ``a`` against ``b``: whether the estimated
    similarity is within five deviations of the threshold, or above."""
    in_a, in_b = (a != 0).astype(np.float32), (b != 0).astype(np.float32)
    in_both = in_a @ in_b.T
    filled = in_a.sum(axis=1)[:, None] + in_b.sum(axis=1)[None, :] - in_both
    # equal bytes, less the ranges that neither fills
    same = np.count_nonzero(a[:, None, :] == b[None, :, :], axis=2) - (a.shape[1] - filled)
    return same >= threshold * filled - 5 * np.sqrt(threshold * (1 - threshold) * filled)


def chosen_paths(s: np.ndarray, runs: int, levels: int, threshold: float, seed: int):
    """Per level, the path ids that set ``s`` goes down, and for each the
    position of its parent in the level before (its run at the first level).

    A path goes on through every element whose hash at that node lies below
    1 / (threshold * size): sets with similarity of the threshold share at least
    one such element on average, whatever their sizes."""
    bar = _U(min(2 ** 64 - 1, int(2 ** 64 / (threshold * len(s)))))
    nodes = mix(np.arange(1, runs + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))
    out = []
    step = max(1, CHUNK // len(s))
    for _ in range(levels):
        parents, elements = [], []
        for lo in range(0, len(nodes), step):
            hit = mix(mix(nodes[lo:lo + step])[:, None] ^ s[None, :]) < bar
            p, e = np.nonzero(hit)
            parents.append(p + lo)
            elements.append(e)
        p = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        e = np.concatenate(elements) if elements else np.zeros(0, np.int64)
        nodes = mix(nodes[p] + s[e] * _U(0xC2B2AE3D27D4EB4F)) if len(p) else np.zeros(0, _U)
        out.append((nodes, p))
    return out
