"""Numerical kernels on arrays: fits that no built-in aggregate expresses. No Spark in here."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

DFA_SCALES = (8, 13, 21, 34, 55)


def dfa(windows: np.ndarray, scales: tuple[int, ...] = DFA_SCALES) -> np.ndarray:
    """The exponent of each row: how the root mean square around straight lines through segments of its profile grows with their length."""
    profile = np.cumsum(windows - windows.mean(1, keepdims=True), 1)
    n = windows.shape[1]
    logs, sizes = [], []
    for s in scales:
        m = n // s
        if m < 4:
            continue
        t = np.arange(s) - (s - 1) / 2
        parts = profile[:, : m * s].reshape(len(windows), m, s)
        parts = parts - parts.mean(2, keepdims=True)
        slope = parts @ t / (t @ t)
        rest = (parts**2).mean((1, 2)) - (slope**2).mean(1) * (t @ t) / s
        logs.append(0.5 * np.log(np.maximum(rest, 1e-300)))
        sizes.append(math.log(s))
    if len(sizes) < 3:
        return np.full(len(windows), np.nan)
    x = np.array(sizes) - np.mean(sizes)
    out = np.stack(logs, 1) @ x / (x @ x)
    return np.where(windows.std(1) > 0, out, np.nan)


def nelder_mead(loss: Callable[[np.ndarray], float], start: np.ndarray, most: int = 400, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """A minimum by the downhill simplex."""
    n = len(start)
    points = np.tile(np.asarray(start, float), (n + 1, 1))
    for i in range(n):
        points[i + 1, i] = points[i + 1, i] * 1.05 if points[i + 1, i] else 0.00025
    values = np.array([loss(p) for p in points])
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if np.abs(points[1:] - points[0]).max() <= tol and np.abs(values[1:] - values[0]).max() <= tol:
            break
        middle = points[:-1].mean(0)
        away = 2 * middle - points[-1]
        at = loss(away)
        if at < values[0]:
            far = 3 * middle - 2 * points[-1]
            there = loss(far)
            points[-1], values[-1] = (far, there) if there < at else (away, at)
        elif at < values[-2]:
            points[-1], values[-1] = away, at
        else:
            near = 1.5 * middle - 0.5 * points[-1] if at < values[-1] else 0.5 * middle + 0.5 * points[-1]
            there = loss(near)
            if there < min(at, values[-1]):
                points[-1], values[-1] = near, there
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [loss(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], float(values[best])


def hawkes_loss(mu: float, ratio: float, decay: float, times: np.ndarray, horizon: float) -> float:
    """The negative log-likelihood of event times on [0, horizon] under exponential self-excitation."""
    excited, total, last = 0.0, 0.0, None
    for t in times.tolist():
        excited = 0.0 if last is None else math.exp(-decay * (t - last)) * (1 + excited)
        last = t
        rate = mu + ratio * decay * excited
        if rate <= 0:
            return 1e10
        total += math.log(rate)
    return mu * horizon + ratio * float((1 - np.exp(-decay * (horizon - times))).sum()) - total


def hawkes_branching(times: np.ndarray, horizon: float) -> float:
    """The branching ratio of the best of three fits; nan for fewer than ten events."""
    if len(times) < 10:
        return float("nan")
    rate = len(times) / horizon

    def loss(x: np.ndarray) -> float:
        if abs(x[0]) > 30 or abs(x[1]) > 30 or abs(x[2]) > 30:
            return 1e10
        return hawkes_loss(math.exp(x[0]), 1 / (1 + math.exp(-x[1])), math.exp(x[2]), times, horizon)

    best = min((nelder_mead(loss, np.array([math.log(rate * (1 - n)), math.log(n / (1 - n)), math.log(b)])) for n, b in ((0.3, 0.5), (0.7, 0.2), (0.5, 1.0))), key=lambda r: r[1])
    return 1 / (1 + math.exp(-best[0][1]))


def standardised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, size = x.mean(0), x.std(0)
    size = np.where(size > 0, size, 1.0)
    return (x - mean) / size, mean, size


def elastic_net(gram: np.ndarray, xy: np.ndarray, alpha: float, share: float, start: np.ndarray, most: int = 5000, tol: float = 1e-4) -> np.ndarray:
    """Coefficients by coordinate descent on second moments (over n) of centred columns: half the mean square error, plus alpha times the mixed penalty."""
    w = start.copy()
    grad = gram @ w
    for _ in range(most):
        moved = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            rho = xy[j] - grad[j] + gram[j, j] * w[j]
            new = math.copysign(max(abs(rho) - alpha * share, 0.0), rho) / (gram[j, j] + alpha * (1 - share))
            if new != w[j]:
                grad += gram[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved < tol:
            break
    return w


def elastic_net_cv(x: np.ndarray, y: np.ndarray, shares=(0.5, 1.0), alphas=tuple(np.logspace(-4, -0.5, 8))) -> tuple[np.ndarray, float]:
    """Coefficients and intercept for standardised columns, the penalty chosen by three forward-chained folds."""
    n = len(y)
    size = n // 4
    score = {}
    for test in (n - 3 * size, n - 2 * size, n - size):
        a, b = x[:test], y[:test]
        am, bm = a.mean(0), b.mean()
        gram, xy = (a - am).T @ (a - am) / test, (a - am).T @ (b - bm) / test
        for share in shares:
            w = np.zeros(x.shape[1])
            for alpha in sorted(alphas, reverse=True):
                w = elastic_net(gram, xy, alpha, share, w)
                error = y[test : test + size] - bm - (x[test : test + size] - am) @ w
                score[share, alpha] = score.get((share, alpha), 0.0) + float((error**2).mean())
    share, alpha = min(score, key=score.get)
    am, bm = x.mean(0), y.mean()
    w = elastic_net((x - am).T @ (x - am) / n, (x - am).T @ (y - bm) / n, alpha, share, np.zeros(x.shape[1]))
    return w, float(bm - am @ w)


def garch_path(p: np.ndarray, r: np.ndarray, asymmetric: bool) -> np.ndarray:
    """Variances of each day and, last, of the day after. p: mean, omega, alpha, beta (and gamma, of the logarithmic form)."""
    e = (r - p[0]).tolist()
    v = max(float(np.var(r)), 1e-12)
    out = [v]
    if asymmetric:
        mean_size, log_v = math.sqrt(2 / math.pi), math.log(v)
        for x in e:
            z = x * math.exp(-0.5 * log_v)
            log_v = min(50.0, max(-50.0, p[1] + p[2] * (abs(z) - mean_size) + p[4] * z + p[3] * log_v))
            out.append(math.exp(log_v))
    else:
        for x in e:
            v = p[1] + p[2] * x * x + p[3] * v
            out.append(v)
    return np.array(out)


def garch_fit(r: np.ndarray, asymmetric: bool) -> np.ndarray:
    """Parameters of most Gaussian likelihood; returns in percent."""
    v = max(float(np.var(r)), 1e-8)

    def unpack(x: np.ndarray) -> np.ndarray:
        if asymmetric:
            return np.array([x[0], x[1], x[2], math.tanh(x[3]), x[4]])
        sum_, part = 1 / (1 + math.exp(-x[2])), 1 / (1 + math.exp(-x[3]))
        return np.array([x[0], math.exp(min(x[1], 50.0)), sum_ * part, sum_ * (1 - part)])

    def loss(x: np.ndarray) -> float:
        if np.abs(x).max() > 60:
            return 1e10
        p = unpack(x)
        h = np.maximum(garch_path(p, r, asymmetric)[:-1], 1e-12)
        return float(0.5 * (np.log(h) + (r - p[0]) ** 2 / h).sum())

    start = [r.mean(), 0.1 * math.log(v), 0.1, 1.5, 0.0] if asymmetric else [r.mean(), math.log(0.1 * v), 2.2, -2.2]
    best, _ = nelder_mead(loss, np.array(start), 4000, 1e-6)
    return unpack(nelder_mead(loss, best, 4000, 1e-6)[0])  # anew from there, with a fresh simplex


def _densities(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * var)[..., None, :] + (x[:, None] - mean[..., None, :]) ** 2 / var[..., None, :])


def hmm_fit(x: np.ndarray, states: int = 3, restarts: int = 10, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Start, transitions, means, variances (states by rising mean) and log-likelihood of the best of several Gaussian chains, which run side by side."""
    rng = np.random.default_rng(seed)
    q = np.quantile(x, (np.arange(states) + 0.5) / states)
    mean = np.sort(q[None, :] + rng.normal(0, 0.25 * x.std(), (restarts, states)) * (np.arange(restarts) > 0)[:, None], 1)
    var = np.full((restarts, states), x.var() / states + 1e-4)
    trans = np.full((restarts, states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 - 0.05 / max(1, states - 1))
    trans /= trans.sum(2, keepdims=True)
    start = np.full((restarts, states), 1 / states)
    n, was = len(x), np.full(restarts, -np.inf)
    for _ in range(rounds):
        logs = _densities(x, mean, var)
        top = logs.max(2, keepdims=True)
        dens = np.exp(logs - top)
        alpha, scale = np.empty_like(dens), np.empty((restarts, n))
        a = start * dens[:, 0]
        for t in range(n):
            if t:
                a = (alpha[:, t - 1, None, :] @ trans)[:, 0] * dens[:, t]
            scale[:, t] = a.sum(1)
            alpha[:, t] = a / scale[:, t, None]
        like = np.log(scale).sum(1) + top.sum((1, 2))
        beta = np.ones_like(dens)
        for t in range(n - 2, -1, -1):
            beta[:, t] = (trans @ (dens[:, t + 1] * beta[:, t + 1])[:, :, None])[:, :, 0] / scale[:, t + 1, None]
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        pairs = np.einsum("rtj,rtk->rjk", alpha[:, :-1], dens[:, 1:] * beta[:, 1:] / scale[:, 1:, None]) * trans
        trans = (pairs + 1e-12) / (pairs + 1e-12).sum(2, keepdims=True)
        start = gamma[:, 0]
        mass = gamma.sum(1) + 1e-12
        mean = np.einsum("rtk,t->rk", gamma, x) / mass
        var = np.maximum(np.einsum("rtk,rtk->rk", gamma, (x[None, :, None] - mean[:, None, :]) ** 2) / mass, 1e-4)
        if (np.abs(like - was) < 1e-3).all():
            break
        was = like
    best = int(np.argmax(like))
    order = np.argsort(mean[best])
    return start[best][order], trans[best][np.ix_(order, order)], mean[best][order], var[best][order], float(like[best])


def hmm_filter(x: np.ndarray, start: np.ndarray, trans: np.ndarray, mean: np.ndarray, var: np.ndarray, smooth: bool = False) -> np.ndarray:
    """Probabilities of the states on each day, from the days up to it, or from all."""
    logs = _densities(x, mean, var)
    dens = np.exp(logs - logs.max(1, keepdims=True))
    out = np.empty_like(dens)
    a = start
    for t in range(len(x)):
        a = (a @ trans if t else a) * dens[t]
        a = a / max(a.sum(), 1e-300)
        out[t] = a
    if smooth:
        b = np.ones(len(mean))
        for t in range(len(x) - 2, -1, -1):
            b = trans @ (dens[t + 1] * b)
            b = b / b.sum()
            out[t] = out[t] * b / (out[t] * b).sum()
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Intercept and coefficients that minimise the logistic loss and half the squared coefficients, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(a.shape[1]), np.diag([0.0, *[penalty] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = a.T @ (p - y) + ridge @ w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge + 1e-10 * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def boosted_trees(x: np.ndarray, y: np.ndarray, trees: int = 300, depth: int = 3, rate: float = 0.05) -> Callable[[np.ndarray], np.ndarray]:
    """A predictor of summed regression trees, each fitted to what those before leave, split where the squared error falls most."""
    order = np.argsort(x, 0, kind="stable")
    model, base = [], float(y.mean())
    rest = y - base
    rows = np.arange(len(y))

    def grow(mask: np.ndarray, level: int):
        n, total = int(mask.sum()), float(rest[mask].sum())
        if level == depth or n < 2:
            return total / max(1, n)
        best = (1e-12, -1, 0.0)
        for j in range(x.shape[1]):
            o = order[:, j][mask[order[:, j]]]
            v, s = x[o, j], np.cumsum(rest[o])[:-1]
            left = np.arange(1, n)
            gain = np.where(v[1:] > v[:-1], s**2 / left + (total - s) ** 2 / (n - left) - total**2 / n, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[k] + v[k + 1]) / 2))
        if best[1] < 0:
            return total / n
        goes = x[:, best[1]] <= best[2]
        return best[1], best[2], grow(mask & goes, level + 1), grow(mask & ~goes, level + 1)

    def value(node, at: np.ndarray, out: np.ndarray, some: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[some] = node
            return
        goes = at[some, node[0]] <= node[1]
        value(node[2], at, out, some[goes])
        value(node[3], at, out, some[~goes])

    for _ in range(trees):
        tree = grow(np.ones(len(y), bool), 0)
        model.append(tree)
        out = np.zeros(len(y))
        value(tree, x, out, rows)
        rest = rest - rate * out

    def predict(at: np.ndarray) -> np.ndarray:
        total = np.full(len(at), base)
        for tree in model:
            out = np.zeros(len(at))
            value(tree, at, out, np.arange(len(at)))
            total += rate * out
        return total

    return predict
