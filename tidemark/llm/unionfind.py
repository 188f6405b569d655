"""Union-find over NumPy arrays, inside one task."""

from __future__ import annotations

import numpy as np


def roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """The root (smallest position) of each of ``n`` positions after joining a[i] with b[i]."""
    p = np.arange(n) if parent is None else parent
    while len(a):
        ra, rb = p[a], p[b]
        go = ra != rb
        if not go.any():
            break
        a, b, ra, rb = a[go], b[go], ra[go], rb[go]
        np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q
    return p
