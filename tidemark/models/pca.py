"""Two principal components of median-centred features under a covariance shrunk to its diagonal."""

from __future__ import annotations

import numpy as np


def shrunk_covariance(centred: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The share of the diagonal target is the estimated noise of the off-diagonal over its size."""
    w = np.ones(len(centred)) if weight is None else weight
    total = w.sum()
    cov = (centred * w[:, None]).T @ centred / total
    target = np.diag(np.diag(cov))
    size = ((cov - target) ** 2).sum()
    if size == 0:
        return target
    # sum over rows of |x x' - cov|^2, from norms rather than outer products
    norms = (centred**2).sum(axis=1)
    apart = norms**2 - 2 * np.einsum("ni,ij,nj->n", centred, cov, centred) + (cov**2).sum()
    share = min(1.0, max(0.0, float((w * w * apart).sum() / total**2 / size)))
    return (1 - share) * cov + share * target


def oriented(cov: np.ndarray) -> np.ndarray:
    """The two leading axes as columns, each with its largest loading positive."""
    _, vectors = np.linalg.eigh(cov)
    top = vectors[:, ::-1][:, :2]
    return top * np.where(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])] < 0, -1.0, 1.0)


def two_components(x: np.ndarray) -> np.ndarray:
    """Scores; each component's largest loading is positive. One feature gives a zero second score."""
    if x.ndim != 2 or not x.size or not np.isfinite(x).all():
        raise ValueError("a finite, non-empty matrix is needed")
    centred = x - np.median(x, axis=0)
    scores = centred @ oriented(shrunk_covariance(centred))
    return scores if scores.shape[1] == 2 else np.column_stack([scores, np.zeros(len(x))])
