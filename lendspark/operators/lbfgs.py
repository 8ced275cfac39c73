"""The limited-memory BFGS search of Spark's linear and perceptron fits, as a coroutine.

Spark's estimators hand their loss to Breeze's ``LBFGS`` with a strong Wolfe line search.
:func:`lbfgs` takes the same steps and stops by the same rules (iterations, the last 20
values, the gradient, a second failure), but asks for losses instead of calling a function:
searches that want losses of the same rows can be answered together in one pass over them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Sequence

import numpy as np

VALUES = 20               # function values that convergence looks back on
ZOOMS = TRIALS = 10       # steps of a line search
DECREASE, CURVATURE = 1e-4, 0.9
Answer = tuple[float, np.ndarray]


class _Failed(Exception):
    pass


def _direction(steps: list[np.ndarray], changes: list[np.ndarray], grad: np.ndarray) -> np.ndarray:
    """The approximate inverse Hessian, newest pair first, times the gradient, downhill."""
    out, scale = grad.copy(), 1.0
    if steps:
        sy = float(steps[0] @ changes[0])
        if not sy >= 0:
            raise _Failed
        with np.errstate(all="ignore"):
            scale = float(np.float64(sy) / (changes[0] @ changes[0]))
    rho, a = [], []
    for s, y in zip(steps, changes):
        rho.append(float(s @ y))
        with np.errstate(all="ignore"):
            a.append(float(np.float64(s @ out) / rho[-1]))
        if math.isnan(a[-1]):
            raise _Failed
        out -= a[-1] * y
    out *= scale
    for s, y, r, k in reversed(list(zip(steps, changes, rho, a))):
        out += (k - float(y @ out) / r) * s
    return -out


def _between(l, r) -> float:
    """Minimum of the cubic through two points (t, value, slope), kept off their ends."""
    with np.errstate(all="ignore"):
        (lt, lf, ld), (rt, rf, rd) = (map(np.float64, p) for p in (l, r))
        d1 = ld + rd - 3 * (lf - rf) / (lt - rt)
        d2 = np.sqrt(d1 * d1 - ld * rd)
        t = rt - (rt - lt) * (rd + d2 - d1) / (rd - ld + 2 * d2)
        low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return float(low if t < low else high if t > high else t)


def _line_search(value: float, slope: float, t: float, phi) -> Generator[np.ndarray, Answer, float]:
    """A step that meets the strong Wolfe conditions; the last point asked for is at it."""
    if slope > 0:
        raise _Failed
    low = (0.0, value, slope)
    hi = None
    for k in range(TRIALS):
        c = yield from phi(t)
        if math.isinf(c[1]) or math.isnan(c[1]):
            t /= 2.0
            continue
        if c[1] > value + DECREASE * t * slope or (c[1] >= low[1] and k > 0):
            hi = c
            break
        if abs(c[2]) <= CURVATURE * abs(slope):
            return c[0]
        if c[2] >= 0:
            low, hi = c, low
            break
        low = c
        t *= 1.5
    if hi is None:
        raise _Failed
    for _ in range(ZOOMS):
        c = yield from phi(_between(hi, low) if low[0] > hi[0] else _between(low, hi))
        if c[1] > value + DECREASE * c[0] * slope or c[1] >= low[1]:
            hi = c
        else:
            if abs(c[2]) <= CURVATURE * abs(slope):
                return c[0]
            if c[2] * (hi[0] - low[0]) >= 0:
                hi = low
            low = c
    raise _Failed


def lbfgs(x: np.ndarray, max_iter: int, tol: float,
          memory: int = 10) -> Generator[np.ndarray, Answer, tuple[np.ndarray, list[float]]]:
    """Yields the points whose (loss, gradient) it must be sent; returns the solution and
    the loss of every iteration, the starting one first."""
    value, grad = yield x
    first, history, recent = value, [value], [math.inf]
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    failed, n = False, 0
    while not (0 <= max_iter <= n or (len(recent) >= 2 and abs(value - max(recent)) <= tol * first)
               or np.linalg.norm(grad) <= max(tol * value, 1e-8)):
        last = None

        def phi(t: float):
            nonlocal last
            at = x + direction * t
            last = (yield at)
            return t, last[0], float(last[1] @ direction)

        try:
            direction = _direction(steps, changes, grad)
            with np.errstate(all="ignore"):
                start = float(1.0 / np.float64(np.linalg.norm(direction))) if n == 0 else 1.0
            t = yield from _line_search(value, float(grad @ direction), start, phi)
            if t * np.linalg.norm(grad) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                break
            failed, steps, changes = True, [], []
            history.append(value)
            continue
        failed = False
        new = x + direction * t
        steps, changes = [new - x, *steps][:memory], [last[1] - grad, *changes][:memory]
        x, (value, grad), n = new, last, n + 1
        recent = [*recent, value][-VALUES:]
        history.append(value)
    return x, history


def minimize_all(starts: Sequence[np.ndarray], losses: Callable[[dict[int, np.ndarray]], dict[int, Answer]],
                 max_iter: int, tol: float) -> list[tuple[np.ndarray, list[float]]]:
    """Searches from ``starts`` side by side: ``losses`` gets the points wanted now, by
    search, and answers all of them."""
    runs = [lbfgs(x, max_iter, tol) for x in starts]
    wanted = {k: next(run) for k, run in enumerate(runs)}
    found: list = [None] * len(runs)
    while wanted:
        answers = losses(wanted)
        wanted = {}
        for k, answer in answers.items():
            try:
                wanted[k] = runs[k].send(answer)
            except StopIteration as end:
                found[k] = end.value
    return found
