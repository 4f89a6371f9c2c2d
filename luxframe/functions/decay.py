"""Numerical helpers for one fluorescence decay (at most a few thousand timing channels)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from luxframe.config import FitSettings

FWHM_PER_SIGMA = 2.35482
EMPTY = 1e-3  # model counts below this are taken as this in the likelihood


def shift_circular(irf: np.ndarray, shift: float) -> np.ndarray:
    """Shift by a fractional number of channels, linearly interpolated, wrapping around."""
    whole = int(np.floor(shift))
    part = shift - whole
    return (1 - part) * np.roll(irf, whole) + part * np.roll(irf, whole + 1) if part else np.roll(irf, whole)


def gaussian_irf(fwhm_ns: float, width_ns: float, counts: np.ndarray) -> np.ndarray:
    """Gaussian response whose peak sits on, and is as high as, the peak of the decay."""
    sigma = fwhm_ns / width_ns / FWHM_PER_SIGMA
    channels = np.arange(len(counts))
    return counts.max() * np.exp(-((channels - int(np.argmax(counts))) ** 2) / (2 * sigma**2))


def convolved_exponential(irf: np.ndarray, ratio: float, block: int = 64) -> np.ndarray:
    """Response convolved with ``ratio**k``.

    Each value is the one before times ``ratio`` plus the response, taken a block at a time.  All
    terms keep their sign, so empty channels stay exactly empty, which a Fourier transform would
    blur and the likelihood could not stand.
    """
    rows = np.pad(irf, (0, -len(irf) % block)).reshape(-1, block)
    age = np.subtract.outer(np.arange(block), np.arange(block))
    out = rows @ np.where(age >= 0, ratio ** np.maximum(age, 0), 0.0).T
    fade = ratio ** np.arange(1, block + 1)
    for k in range(1, len(out)):
        out[k] += out[k - 1, -1] * fade
    return out.ravel()[: len(irf)]


@dataclass(frozen=True)
class Parameter:
    """Start value and bounds; a fixed one may move by 1e-4 either way."""

    start: float
    low: float
    high: float
    fixed: bool = False

    def bounds(self) -> tuple[float, float]:
        return (self.start - 1e-4, self.start + 1e-4) if self.fixed else (self.low, self.high)


@dataclass(frozen=True)
class FitModel:
    """What to fit: number of exponentials, method and parameters."""

    numexp: int = 1
    method: str = "ls"
    tau: tuple[Parameter, ...] = ()
    amp: tuple[Parameter, ...] = ()
    shift: Parameter = Parameter(0.0, -2000.0, 2000.0)
    fwhm: Parameter | None = None
    bg: float | None = None
    start_mode: str = "(Close to) max"
    start: int | None = None
    end: int | None = None
    auto_end: bool = True
    normalize_amps: bool = True
    settings: FitSettings = field(default_factory=FitSettings)

    def taus(self) -> tuple[Parameter, ...]:
        defaults = {1: (5.0,), 2: (1.0, 5.0), 3: (0.5, 2.0, 6.0)}[self.numexp]
        return self.tau or tuple(Parameter(v, 0.01, 100.0) for v in defaults)

    def amps(self) -> tuple[Parameter, ...]:
        top = 1.0 if self.method == "ml" else 100.0
        full = self.amp or tuple(Parameter(1.0 / self.numexp, 0.0, top) for _ in range(self.numexp))
        return full[: self.numexp - 1] if self.method == "ml" else full


@dataclass(frozen=True)
class Limits:
    """Channels to fit and backgrounds, found beforehand."""

    start: int
    end: int
    bg: float
    estimated_bg: float
    irf_bg: float = 0.0


def _jacobian(func, p, low, high):
    base_step = 1e-6 * np.maximum(np.abs(p), 1e-2)
    columns = []
    for i, step in enumerate(base_step):
        up, down = p.copy(), p.copy()
        up[i], down[i] = min(p[i] + step, high[i]), max(p[i] - step, low[i])
        gap = up[i] - down[i]
        columns.append((func(up) - func(down)) / gap if gap else np.zeros_like(func(p)))
    return np.column_stack(columns)


def bounded_fit(func, target, start, low, high, likelihood=False, project=None, rounds=200):
    """Damped Gauss-Newton inside a box.

    Minimises the squared distance, or with ``likelihood`` the multinomial deviance, whose
    Gauss-Newton step weighs each channel by the inverse of the model.
    Returns parameters and their covariance.
    """
    low, high = np.asarray(low, float), np.asarray(high, float)
    settle = lambda q: np.clip(q if project is None else project(np.clip(q, low, high)), low, high)
    p = settle(np.asarray(start, float))

    def cost(model):
        if not likelihood:
            return float(np.sum((target - model) ** 2))
        if not np.all(np.isfinite(model)):
            return np.inf
        used = target > 0
        return float(np.sum(target[used] * np.log(target[used] / np.maximum(model[used], EMPTY))))

    model = func(p)
    best, damping = cost(model), 1.0
    for _ in range(rounds):
        jac = _jacobian(func, p, low, high)
        if likelihood:
            level = np.maximum(model, EMPTY)
            gradient = jac.T @ ((target - model) / level)
            curvature = (jac.T * (np.maximum(target, level) / level**2)) @ jac
        else:
            gradient, curvature = jac.T @ (target - model), jac.T @ jac
        stuck = ((p <= low) & (gradient < 0)) | ((p >= high) & (gradient > 0))
        free = ~stuck & (np.diag(curvature) > 0)
        if not free.any():
            break
        improved = False
        while damping < 1e12:
            inner = curvature[np.ix_(free, free)]
            step = np.zeros_like(p)
            step[free] = np.linalg.lstsq(inner + damping * np.diag(np.diag(inner)), gradient[free], rcond=None)[0]
            trial = settle(p + step)
            trial_model = func(trial)
            value = cost(trial_model)
            if value < best:
                improved = True
                gain, moved = best - value, np.abs(trial - p)
                p, model, best = trial, trial_model, value
                damping = max(damping / 10, 1e-12)
                break
            damping *= 10
        if not improved or (gain <= 1e-12 * abs(best) and np.all(moved <= 1e-8 * (np.abs(p) + 1e-8))):
            break
    jac = _jacobian(func, p, low, high)
    scale = 1 / np.sqrt(np.maximum(model, EMPTY)) if likelihood else np.ones_like(model)
    _, singular, rotation = np.linalg.svd(jac * scale[:, None], full_matrices=False)
    kept = singular > np.finfo(float).eps * max(jac.shape) * singular[0]
    covariance = (rotation[kept].T / singular[kept] ** 2) @ rotation[kept]
    if not likelihood:
        covariance *= best / max(len(target) - len(p), 1)
    return p, covariance


def dw_bounds(points: int, numexp: int) -> tuple[float, float, float, float]:
    """Lower Durbin-Watson bounds at 5, 1, 0.3 and 0.1 %."""
    root = np.sqrt(points)
    values = [
        round(2 + sum(b / root**power for b, power in zip(DW_TERMS[level][numexp - 1], (1, 2, 3, 4))), 3)
        for level in (5, 1)
    ]
    deviation = np.sqrt(4 * points**2 * (points - 2) / ((points + 1) * (points - 1) ** 3))
    return values[0], values[1], round(2 - 3 * deviation, 3), round(2 - 3.28 * deviation, 3)


# Response surface of Turner (2020), doi 10.1080/13504851.2019.1691711, for one, two
# and three exponentials.
DW_TERMS = {
    5: [
        (-3.312097, -3.332536, -3.632166, 19.31135),
        (-3.447993, -4.229294, -28.91627, 80.00972),
        (-3.535331, -4.085190, -47.63654, 127.7127),
    ],
    1: [
        (-4.642915, -4.052984, 5.966592, 14.91894),
        (-4.655069, -7.296073, -5.300441, 60.11130),
        (-4.675041, -8.518908, -15.25711, 96.32291),
    ],
}


def model_curve(tau, amp, shift, irf, t, start, end, normalize=True, total=None, bg=0.0):
    """Sum of exponentials convolved with the shifted response, cut to the fit range."""
    shifted, step = shift_circular(irf, shift), t[1] - t[0]
    curve = sum(a * convolved_exponential(shifted, np.exp(-step / k)) for a, k in zip(amp, tau))
    curve = (curve + bg)[start:end]
    if normalize:
        curve = curve / curve.sum()
        if total is not None:
            curve = curve * total
    return curve


def fit_decay(counts, t, width_ns: float, model: FitModel, limits: Limits, irf=None) -> dict:
    """Fit one decay.  ``irf=None`` fits a Gaussian response of width ``model.fwhm``."""
    raw = np.asarray(counts, dtype=float)
    t = np.asarray(t, dtype=float)
    ml, k = model.method == "ml", model.numexp
    simulated = irf is None
    irf_bg, bg, start, end = limits.irf_bg, limits.bg, limits.start, limits.end
    start = max(start, 0)
    clean = raw if ml else np.maximum(raw - bg, 0)
    measured = clean[start:end]
    total = measured.sum()
    if total <= 0 or len(measured) <= 2 * k + 2:
        raise ValueError("not enough photons in the fit range")
    target = measured if ml else measured / total
    response = None
    if not simulated:
        response = np.asarray(irf, dtype=float) - irf_bg
        response = response / response.max()
        response = np.pad(response, (0, max(len(raw) - len(response), 0)))[: len(raw)]

    taus, amps = model.taus(), model.amps()
    parameters = [*taus, *amps, model.shift]
    if ml:
        # The background counts in units of the unscaled curve, so its start is put on that scale.
        area = (clean if simulated else response).sum() / (clean.max() if simulated else 1.0)
        area *= sum(a.start * p.start / width_ns for a, p in zip([*amps, Parameter(1, 0, 1)], taus))
        share = min(limits.estimated_bg * len(measured) / total, 0.5)
        parameters.append(Parameter(float(np.clip(share / (1 - share) * area / len(measured), 1e-6, 50.0)), 0.0, 50.0))
    if simulated:
        parameters.append(model.fwhm or Parameter(0.1, 0.05, 2.0))
    low, high = zip(*[p.bounds() for p in parameters])

    def unpack(p):
        tau, amp = p[:k], p[k : k + len(amps)]
        if ml:
            amp = np.append(amp, 1 - amp.sum())
        return tau, amp, p[k + len(amps)], (p[k + len(amps) + 1] if ml else 0.0), (p[-1] if simulated else None)

    def curve(p):
        tau, amp, shift, level, fwhm = unpack(p)
        shape = gaussian_irf(fwhm, width_ns, clean) if simulated else response
        out = model_curve(tau, amp, shift, shape, t, start, end, model.normalize_amps, total if ml else None, level)
        return out + (1 - amp.sum()) if not ml and k > 1 and model.normalize_amps else out

    def simplex(p):
        part = p[k : k + len(amps)]
        if part.sum() > 1:
            p = p.copy()
            p[k : k + len(amps)] = part / part.sum()
        return p

    best, covariance = bounded_fit(
        curve, target, [p.start for p in parameters], low, high, ml, simplex if ml and k > 1 else None
    )
    tau, amp, shift, level, fwhm = unpack(best)
    deviations = np.sqrt(np.maximum(np.diag(covariance), 0))
    tau_std, amp_std = deviations[:k], deviations[k : k + len(amps)]
    if ml and k > 1:
        amp_std = np.append(amp_std, amp_std[-1])
    elif k == 1:
        amp, amp_std = np.ones(1), np.zeros(1)
    fitted = curve(best) + (0.0 if ml else bg / total)
    observed = raw[start:end] / (1.0 if ml else total)
    scale = 1.0 if ml else total
    with np.errstate(divide="ignore", invalid="ignore"):
        residual = (fitted - observed) * scale / np.sqrt(np.abs(fitted * scale))
    residual = residual[np.isfinite(residual)]
    freedom = len(observed) - (2 * k) - 1  # lifetimes, all amplitudes but one, shift
    squares = float(np.sum(residual**2))
    bounds = dw_bounds(len(residual), k)
    if k == 1:
        average, average_std = float(tau[0]), float(tau_std[0])
    else:
        average = float(tau @ amp / amp.sum())
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = tau * amp * np.hypot(tau_std / tau, np.where(amp > 0, amp_std / amp, 0.0))
        average_std = float(np.sqrt(np.sum(terms**2)))
    return {
        "numexp": k,
        "method": model.method,
        "tau": tau.tolist(),
        "amp": amp.tolist(),
        "tau_std": tau_std.tolist(),
        "amp_std": amp_std.tolist(),
        "avtau": average,
        "avtau_std": average_std,
        "shift_ns": float(shift * width_ns),
        "shift_std_ns": float(deviations[k + len(amps)] * width_ns),
        "bg": float(level if ml else bg),
        "bg_std": float(deviations[k + len(amps) + 1]) if ml else None,
        "irf_bg": irf_bg,
        "fwhm": None if fwhm is None else float(fwhm),
        "chisq": squares / freedom if freedom > 0 else None,
        "dw": float(np.sum(np.diff(residual) ** 2) / squares) if squares else None,
        "dw_5": bounds[0],
        "dw_1": bounds[1],
        "dw_03": bounds[2],
        "dw_01": bounds[3],
        "start_ns": start * width_ns,
        "end_ns": end * width_ns,
        "num_points": len(observed),
        "photons_used": float(raw[start:end].sum()),
        "start_ch": int(start),
        "model": (fitted * scale).tolist(),
        "residual": residual.tolist(),
        "error": None,
    }
