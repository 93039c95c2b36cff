"""Small statistics on the driver: exact and approximate signed-rank p-values, bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def signed_rank_p(differences: Sequence[float]) -> tuple[float, float]:
    """W and the two-sided p of Wilcoxon's signed-rank test without zeros: exact for 50 or fewer untied differences, else normal with a correction for ties. Under two differences give p = 1."""
    d = np.array([x for x in differences if x], float)
    n = len(d)
    if n < 2:
        return 0.0, 1.0
    size = np.abs(d)
    values, counts = np.unique(size, return_counts=True)
    upto = np.cumsum(counts)
    rank = (upto - (counts - 1) / 2)[np.searchsorted(values, size)]
    plus = float(rank[d > 0].sum())
    w = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and len(values) == n:
        ways = [1]
        for r in range(1, n + 1):
            longer = ways + [0] * r
            for s, c in enumerate(ways):
                longer[s + r] += c
            ways = longer
        return w, min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - float((counts**3 - counts).sum()) / 48)
    return w, min(1.0, math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)))


def bootstrap_median(differences: Sequence[float], draws: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """The middle 95 % of medians of samples drawn with replacement."""
    d = np.asarray(differences, float)
    if not len(d):
        return math.nan, math.nan
    picks = np.random.default_rng(seed).integers(0, len(d), (draws, len(d)))
    low, high = np.percentile(np.median(d[picks], axis=1), [2.5, 97.5])
    return float(low), float(high)
