"""Weighted likelihood ratio for one change of rate inside a photon segment.

Follows Watkins and Yang, J. Phys. Chem. B 109 (2005) 617: the log-likelihood ratio of two rates
against one, standardised by its expectation and variance under a constant rate and weighted
towards the middle of the segment.
"""

from __future__ import annotations

import numpy as np

MAX_SEGMENT = 1000
CONFIDENCES = (69, 90, 95, 99)


def _harmonic(top: int) -> tuple[np.ndarray, np.ndarray]:
    j = np.arange(1, top + 1)
    return np.concatenate([[0.0], np.cumsum(1 / j)]), np.concatenate([[0.0], np.cumsum(1 / j**2)])


H1, H2 = _harmonic(MAX_SEGMENT)
_SHAPES: dict[int, tuple[np.ndarray, ...]] = {}


def segment_constants(n: int) -> tuple[np.ndarray, ...]:
    """``k = 2..n-2`` with expectation, deviation and weight of each; depends on ``n`` only."""
    if n not in _SHAPES:
        k = np.arange(2, n - 1)
        r = n - k
        h, q = H1[n - 1], H2[n - 1]
        expected = 2 * k * (H1[k - 1] - h) + 2 * r * (H1[r - 1] - h)
        covariance = np.pi**2 / 6 - q
        deviation = np.sqrt(
            4 * k**2 * (q - H2[k - 1]) + 4 * r**2 * (q - H2[r - 1]) - 8 * k * r * covariance
        )
        _SHAPES[n] = (k, expected, deviation, 0.5 * np.log(4 * k * r / n**2))
    return _SHAPES[n]


def series(times: np.ndarray) -> np.ndarray:
    """The ratio for every ``k`` of one segment (or of each row); zero at the ends."""
    times = np.asarray(times, dtype=float)
    n = times.shape[-1]
    k, expected, deviation, weight = segment_constants(n)
    span = times[..., -1:] - times[..., :1]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.clip((times[..., k] - times[..., :1]) / span, 1e-12, 1 - 1e-12)
    raw = -2 * k * np.log(share) - 2 * (n - k) * np.log1p(-share) + expected
    out = np.zeros(times.shape)
    out[..., 2 : n - 1] = raw / deviation + weight
    return out
