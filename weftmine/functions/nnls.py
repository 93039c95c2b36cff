"""Non-negative least squares for many right-hand sides with one matrix."""

from __future__ import annotations

import numpy as np


def nnls(gram: np.ndarray, target: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """z >= 0 that minimises z' gram z / 2 - target' z (Lawson and Hanson's active sets). gram = H'H, target = H'q."""
    n = len(target)
    z, passive = np.zeros(n), np.zeros(n, bool)
    limit = tolerance * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(10 * n + 10):
        slope = target - gram @ z
        slope[passive] = -np.inf
        if passive.all() or slope.max() <= limit:
            break
        passive[int(np.argmax(slope))] = True
        while True:
            own = np.flatnonzero(passive)
            best = np.zeros(n)
            best[own] = np.linalg.lstsq(gram[np.ix_(own, own)], target[own], rcond=None)[0]
            low = own[best[own] <= limit * 1e-3]
            if not len(low):
                break
            gap = z[low] - best[low]
            step = np.min(np.divide(z[low], gap, out=np.zeros_like(gap), where=gap > 0))
            z = z + step * (best - z)
            passive[own[z[own] <= 1e-14]] = False
            passive[low[z[low] <= 1e-14]] = False
            z[~passive] = 0
            if not passive.any():
                break
        if passive.any():
            z = np.where(passive, best, 0)
    return np.maximum(z, 0)


def nnls_rows(gram: np.ndarray, targets: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """``nnls`` of every row of targets, a step of all rows at a time: rows that have the same active set share one pseudo-inverse."""
    n = gram.shape[0]
    z, passive, inverses = np.zeros_like(targets), np.zeros(targets.shape, bool), {}
    if not targets.size:
        return z
    limit = tolerance * np.maximum(1.0, np.abs(targets).max(1))

    def inverse(own: np.ndarray) -> np.ndarray:
        """Of an active set, as wide as gram, with zeros elsewhere."""
        key = own.tobytes()
        if key not in inverses:
            if len(inverses) >= 4096:
                inverses.clear()
            inverses[key] = np.zeros((n, n))
            inverses[key][np.ix_(own, own)] = np.linalg.pinv(gram[np.ix_(own, own)], rcond=np.finfo(float).eps * len(own))
        return inverses[key]

    def solved(rows: np.ndarray) -> np.ndarray:
        packed = np.ascontiguousarray(np.packbits(passive[rows], axis=1))
        code = packed.view(f"V{packed.shape[1]}").ravel() if n > 32 else np.pad(packed, [(0, 0), (0, 4 - packed.shape[1])]).view(np.uint32).ravel()
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        sets = [np.flatnonzero(passive[rows[i]]) for i in first]
        if n <= 32:  # a small matrix for each row
            return np.matmul(np.array([inverse(own) for own in sets])[which], targets[rows][:, :, None])[:, :, 0]
        out = np.zeros((len(rows), n))
        order = np.argsort(which, kind="stable")
        for own, same in zip(sets, np.split(order, np.flatnonzero(np.diff(which[order])) + 1), strict=True):
            out[same] = targets[rows[same]] @ inverse(own).T
        return out

    left = np.arange(len(targets))
    for _ in range(10 * n + 10):
        slope = np.where(passive[left], -np.inf, targets[left] - z[left] @ gram.T)
        left = left[slope.max(1) > limit[left]]
        if not len(left):
            break
        slope = np.where(passive[left], -np.inf, targets[left] - z[left] @ gram.T)
        passive[left, slope.argmax(1)] = True
        open_ = left
        while len(open_):
            best = solved(open_)
            low = passive[open_] & (best <= limit[open_, None] * 1e-3)
            bad = low.any(1)
            z[open_[~bad]] = best[~bad]
            open_, best, low = open_[bad], best[bad], low[bad]
            gap = z[open_] - best
            ratio = np.where(low, np.divide(z[open_], gap, out=np.zeros_like(gap), where=gap > 0), np.inf)
            z[open_] += ratio.min(1, initial=np.inf)[:, None] * (best - z[open_]) if len(open_) else 0
            passive[open_] &= z[open_] > 1e-14
            z[open_] = np.where(passive[open_], z[open_], 0)
            open_ = open_[passive[open_].any(1)]
    return np.maximum(z, 0)
