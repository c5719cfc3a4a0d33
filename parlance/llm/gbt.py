"""Gradient-boosted trees for a yes/no label, kept as flat numpy node arrays.

Each tree is a complete binary tree of fixed depth: row ``t`` of ``feature`` and ``threshold`` has its inner nodes in
heap order, row ``t`` of ``leaf`` its leaves. A row goes left where ``x <= threshold``. Nodes that were not split have
an infinite threshold. Fitting takes a bounded sample in memory; scoring is vectorised, or an SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return total

    def sql(self, names: list[str]) -> str:
        """The same log-odds as an SQL expression over columns."""

        def branch(t: int, node: int) -> str:
            inner = self.feature.shape[1]
            if node >= inner:
                return f"{float(self.leaf[t, node - inner])!r}D"
            if not np.isfinite(self.threshold[t, node]):
                return branch(t, 2 * node + 1)
            return f"CASE WHEN {names[self.feature[t, node]]} <= {float(self.threshold[t, node])!r}D THEN {branch(t, 2 * node + 1)} ELSE {branch(t, 2 * node + 2)} END"

        return " + ".join([f"{float(self.base)!r}D", *(f"({branch(t, 0)})" for t in range(len(self.leaf)))])


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Second-order boosting of the log loss with histograms.

    ``monotone`` maps a feature to 1 (the score may only rise with it) or -1 (only fall): splits against it are
    refused and both children are bounded by the middle of the two, so that deeper splits can't break it either.
    With no rows, or one class only, the trees are constant.
    """
    monotone = monotone or {}
    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    feature, threshold, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(feature, threshold, leaf, base)
    cuts = []
    codes = np.zeros((width, n), np.int64)
    for f in range(width):
        values = np.unique(x[:, f])
        middle = (values[:-1] + values[1:]) / 2
        if len(middle) > bins - 1:
            middle = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]))
        cuts.append(middle)
        codes[f] = np.searchsorted(middle, x[:, f], side="left")
    margin = np.full(n, base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        where = np.zeros(n, np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for node in range(inner):
            rows = np.flatnonzero(where == node)
            left = 2 * node + 1
            low[[left, left + 1]], high[[left, left + 1]] = low[node], high[node]
            if len(rows):
                best = (1e-6, -1, -1, 0.0, 0.0)
                gs, hs = g[rows], h[rows]
                total_g, total_h = gs.sum(), hs.sum()
                for f in range(width):
                    if not len(cuts[f]):
                        continue
                    code = codes[f][rows]
                    gl = np.cumsum(np.bincount(code, gs, len(cuts[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code, hs, len(cuts[f]) + 1))[:-1]
                    gr, hr = total_g - gl, total_h - hl
                    vl = np.clip(-gl / (hl + l2), low[node], high[node])
                    vr = np.clip(-gr / (hr + l2), low[node], high[node])
                    gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - (gr * vr + 0.5 * (hr + l2) * vr**2) - 0.5 * total_g**2 / (total_h + l2)
                    gain[(hl < least) | (hr < least)] = -np.inf
                    if f in monotone:
                        gain[(vr - vl) * monotone[f] < 0] = -np.inf
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
                _, f, k, vl, vr = best
                if f >= 0:
                    feature[t, node], threshold[t, node] = f, cuts[f][k]
                    if f in monotone:
                        middle = (vl + vr) / 2
                        if monotone[f] > 0:
                            high[left], low[left + 1] = middle, middle
                        else:
                            low[left], high[left + 1] = middle, middle
                    where[rows] = left + (codes[f][rows] > k)
                    continue
                where[rows] = left
        for k in range(leaves):
            rows = where == inner + k
            if rows.any():
                leaf[t, k] = rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low[inner + k], high[inner + k]))
        margin += leaf[t][where - inner]
    return Trees(feature, threshold, leaf, base)
