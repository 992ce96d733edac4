"""Least squares on the unit simplex from cross-products (runs inside tasks).

The minimiser need not be unique (more donors than periods, donors in line with
others): ``closest_weights`` then names one, whatever the order of the work. The
other functions minimise ``w'Gw / 2 - c'w`` over ``w >= 0, sum(w) = 1``. The
working support only ever gains a column with a strictly negative reduced
gradient, so it stays affinely independent even when G is rank deficient
(more donors than periods, duplicated donors). Sizes and tolerances are taken
per donor, so one donor far larger than the rest does not hide the others.
"""

from __future__ import annotations

import zlib

import numpy as np

REL_TOL = 1e-11


def _on_face(G: np.ndarray, rhs: np.ndarray, support: list[int]) -> np.ndarray:
    """Stationary points with sum fixed by the last row of ``rhs``."""
    m = len(support)
    K = np.ones((m + 1, m + 1))
    K[:m, :m] = G[np.ix_(support, support)]
    K[m, m] = 0.0
    own = np.sqrt(np.diag(K)[:m])
    least = own[own > 0].min() if (own > 0).any() else 1.0
    unit = np.append(1.0 / np.where(own > 0, own, least), least)
    K *= np.outer(unit, unit)
    rhs = (rhs.T * unit).T
    try:
        z = np.linalg.solve(K, rhs)
    except np.linalg.LinAlgError:
        z = np.linalg.lstsq(K, rhs, rcond=None)[0]
    return (z.T * unit).T


def rounding(own: np.ndarray, fitted: np.ndarray, c: np.ndarray, cw: np.ndarray) -> np.ndarray:
    """Reduced gradients below this are noise, by donor: ``own`` and ``fitted``
    are the lengths of the donors' and of the fitted series."""
    return REL_TOL * ((own + fitted) * fitted + np.abs(c) + np.abs(cw))


def simplex_ls(
    G: np.ndarray, c: np.ndarray, start: np.ndarray | None = None
) -> tuple[np.ndarray, list[int]]:
    """Optimal weights and their support; ``start`` is any feasible point."""
    n = len(c)
    own = np.sqrt(np.diag(G))
    if start is None:
        w = np.zeros(n)
        w[int(np.argmin(np.diag(G) / 2 - c))] = 1.0
    else:
        w = start.copy()
    support = [int(j) for j in np.flatnonzero(w)]
    added = -1
    barred: list[int] = []
    for _ in range(20 * n + 100):
        while True:
            z = _on_face(G, np.append(c[support], 1.0), support)[:-1]
            if z.min() > 0:
                w[:] = 0.0
                w[support] = z
                break
            here = w[support]
            falling = z <= 0
            gap = here[falling] - z[falling]
            ratio = np.divide(here[falling], gap, out=np.zeros_like(gap), where=gap > 0)
            step = float(ratio.min())
            blocked = np.array(support)[falling][ratio <= step]
            if step == 0.0 and added in blocked:
                barred.append(added)  # its gain was rounding
            w[support] = here + step * (z - here)
            w[blocked] = 0.0
            support = [j for j in support if j not in set(blocked.tolist())]
        product = G @ w
        fitted = np.sqrt(max(float(w @ product), 0.0))
        reduced = product - c
        reduced -= reduced @ w
        reduced[support + barred] = 0.0
        entering = reduced < -rounding(own, fitted, c, c @ w)
        if not entering.any():
            break
        steepest = np.divide(reduced, own + fitted, out=np.zeros(n), where=entering & (own + fitted > 0))
        added = int(np.argmin(steepest))
        support.append(added)
    return w, support


def tie_costs(X: np.ndarray, y: np.ndarray, names: list[str]) -> np.ndarray:
    """What a unit of weight costs where fits tie: the donor's squared distance from
    the treated series, raised by up to a millionth by a hash of its name, so that
    equal donors differ."""
    spread = np.array([zlib.crc32(n.encode()) for n in names]) / 2.0**32
    return ((X - y) ** 2).sum(axis=1) * (1 + 1e-6 * spread)


def closest_weights(
    X: np.ndarray, G: np.ndarray, c: np.ndarray, w: np.ndarray, cost: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Of all minimisers the one with the least ``cost @ w``, given one of them.

    ``X`` holds the donors over the periods of the fit and ``w`` an optimal basic
    solution, as ``simplex_ls`` gives it. All minimisers have its fitted values and no
    weight outside the donors with a zero reduced gradient, so this is a linear program
    over those, solved by pivoting from ``w``. Also returns its prices (by period, then
    of the sum): a donor outside ``X`` with a zero reduced gradient would only enter if
    its cost were below its price.
    Without a tie the weights come back as they are.
    """
    own, product = np.sqrt(np.diag(G)), G @ w
    fitted = np.sqrt(max(float(w @ product), 0.0))
    reduced = product - c
    reduced -= reduced @ w
    face = np.flatnonzero((np.abs(reduced) <= 10 * rounding(own, fitted, c, c @ w)) | (w > 0))
    A = np.vstack([X[face].T, np.ones(len(face))])
    scale = max(float(np.abs(A[:-1]).max(initial=0.0)), 1e-300)
    A[:-1] /= scale
    v, price = w[face].copy(), cost[face]
    U, sizes, _ = np.linalg.svd(A, full_matrices=False)
    Q = U[:, sizes > sizes[0] * 1e-10]
    R, b = Q.T @ A, Q.T @ (A @ v)
    basis = _completed(R, [int(j) for j in np.flatnonzero(v)])
    stalled = 0
    while True:
        B = R[:, basis]
        v[:] = 0.0
        v[basis] = np.maximum(np.linalg.solve(B, b), 0.0)
        prices = np.linalg.solve(B.T, price[basis])
        gain = price - R.T @ prices
        gain[basis] = 0.0
        entering = np.flatnonzero(gain < -1e-9 * (price + np.abs(R.T) @ np.abs(prices)))
        if not len(entering):
            break
        # the steepest, or after moves of no length the first, which cannot cycle
        j = int(entering[np.argmin(gain[entering])]) if stalled < 20 else int(entering[0])
        fall = np.linalg.solve(B, R[:, j])
        falls = np.flatnonzero(fall > 1e-11)
        if not len(falls):
            break
        ratio = v[basis][falls] / fall[falls]
        last = falls[ratio <= ratio.min() * (1 + 1e-12)]
        leaves = int(min(last, key=lambda i: basis[i]))
        stalled = stalled + 1 if ratio.min() <= 1e-14 else 0
        basis[leaves] = j
    out = np.zeros(len(w))
    held = [int(face[i]) for i in basis if v[i] > 1e-12]
    if set(held) == set(np.flatnonzero(w).tolist()):
        out = w
    else:  # once more from the cross-products, so the result depends on the support alone
        z = _on_face(G, np.append(c[held], 1.0), held)[:-1]
        out[held] = z if z.min() > 0 else v[[i for i in basis if v[i] > 1e-12]]
        out /= out.sum()
    full = Q @ prices
    full[:-1] /= scale
    return out, full


def _completed(R: np.ndarray, basis: list[int]) -> list[int]:
    """Independent columns of R that begin with ``basis``, as many as R has rows."""
    left = R.copy()
    for at in range(len(R)):
        if at == len(basis):
            basis = [*basis, int(np.argmax((left**2).sum(axis=0)))]
        q = left[:, basis[at]]
        q = q / np.sqrt(q @ q)
        left = left - np.outer(q, q @ left)
        left = left - np.outer(q, q @ left)
        left[:, basis] = np.where(np.arange(len(basis)) <= at, 0.0, left[:, basis])
    return basis


def simplex_segments(
    G: np.ndarray, c0: np.ndarray, c1: np.ndarray, low: float, high: float
) -> list[tuple[float, float, list[int], np.ndarray, np.ndarray]]:
    """Weights for every ``c = c0 - theta * c1``, theta from ``low`` to ``high``.

    Returns ``(start, end, support, p, q)`` per linear run: the weights of the
    support are ``p + theta * q``. A run ends where a weight reaches zero or a
    donor outside becomes profitable; the next is solved for just beyond, so runs
    shorter than about 1e-9 of the range are passed over.
    """
    own = np.sqrt(np.diag(G))
    least = max(high - low, 1e-300) * 1e-9
    out: list[tuple[float, float, list[int], np.ndarray, np.ndarray]] = []
    w, probe, start, gap = None, low, low, least
    while True:
        w, support = simplex_ls(G, c0 - probe * c1, w)
        m = len(support)
        rhs = np.zeros((m + 1, 2))
        rhs[:m, 0], rhs[:m, 1], rhs[m, 0] = c0[support], -c1[support], 1.0
        line = _on_face(G, rhs, support)
        p, q = line[:m, 0], line[:m, 1]
        product = G[:, support] @ line[:m] - np.stack([c0, -c1], axis=1) + line[m]
        here = w[support]
        fitted = np.sqrt(max(float(here @ (G[np.ix_(support, support)] @ here)), 0.0))
        c = c0 - probe * c1
        level = product[:, 0] + probe * product[:, 1] + rounding(own, fitted, c, c[support] @ here)
        level[support] = np.inf
        falls = np.concatenate((q, product[:, 1]))
        height = np.concatenate((p + probe * q, level))
        ahead = np.divide(np.maximum(height, 0.0), -falls, out=np.full(len(falls), np.inf), where=(falls < 0) & np.isfinite(height))
        end = probe + float(ahead.min())
        if end >= high:
            out.append((start, high, support, p, q))
            return out
        out.append((start, end, support, p, q))
        gap = 2 * gap if end - start < 2 * gap else least
        start, probe = end, end + gap
        if probe >= high:
            out[-1] = (out[-1][0], high, support, p, q)
            return out
        w = np.zeros(len(c0))
        w[support] = np.where(p + end * q > 1e-13, p + end * q, 0.0)
        w /= w.sum()


def simplex_path(
    G: np.ndarray, c0: np.ndarray, c1: np.ndarray, thetas: np.ndarray
) -> tuple[np.ndarray, list[int]]:
    """Weights for every ``c = c0 - theta * c1`` (thetas sorted), one row each.

    For a fixed support the weights are linear in theta, so one solve serves
    every following theta at which that line stays feasible and optimal. Also
    returns the row numbers at which such a run starts or ends.
    """
    out = np.zeros((len(thetas), len(c0)))
    own = np.sqrt(np.diag(G))
    ends: list[int] = []
    w, at = None, 0
    while at < len(thetas):
        w, support = simplex_ls(G, c0 - thetas[at] * c1, w)
        out[at] = w
        ends.append(at)
        rest = thetas[at + 1 :]
        m = len(support)
        rhs = np.zeros((m + 1, 2))
        rhs[:m, 0], rhs[:m, 1], rhs[m, 0] = c0[support], -c1[support], 1.0
        line = _on_face(G, rhs, support)
        path = line[:m, 0] + rest[:, None] * line[:m, 1]
        product, c = path @ G[support], c0 - rest[:, None] * c1
        fitted = np.sqrt(np.maximum((product[:, support] * path).sum(axis=1), 0.0))[:, None]
        noise = rounding(own, fitted, c, (c[:, support] * path).sum(axis=1)[:, None])
        reduced = product - c + (line[m, 0] + rest * line[m, 1])[:, None]
        reduced[:, support] = 0.0
        good = (path > 0).all(axis=1) & (reduced >= -noise).all(axis=1)
        run = len(rest) if good.all() else int(np.argmin(good))
        if run:
            out[at + 1 : at + 1 + run, support] = path[:run]
            w = out[at + run].copy()
            ends.append(at + run)
        at += run + 1
    return out, ends
