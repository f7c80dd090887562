"""Generalised linear scans: null fits on the driver, score tests on batches of variants.

Each ``fit_*`` returns a small state; the matching ``score_*`` maps (G, state) to columns and is
meant for `packed.map_variants`. Rows of y, x and G are samples in one order.
"""

from __future__ import annotations

import math

import numpy as np

from lociframe.functions import specfun


def fit_logistic(y: np.ndarray, x: np.ndarray, firth: bool = False, rounds: int = 50) -> dict:
    """Null logistic model by iteratively reweighted least squares, with Firth's penalty if asked for."""
    beta = np.zeros(x.shape[1])
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    beta[0] = math.log(share / (1 - share))
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-x @ beta))
        w = np.maximum(mu * (1 - mu), 1e-10)
        info = x.T @ (w[:, None] * x)
        up = x.T @ (y - mu)
        if firth:
            hat = w * np.einsum("ij,jk,ik->i", x, np.linalg.inv(info), x)
            up = up + 0.5 * x.T @ (hat * (1 - 2 * mu))
        step = np.linalg.solve(info, up)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    mu = 1 / (1 + np.exp(-x @ beta))
    return {"y": y, "x": x, "mu": mu, "w": mu * (1 - mu), "beta": beta}


def _projected(g: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """G less its weighted regression on the design."""
    return g - x @ np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w[:, None] * g))


def score_logistic(g: np.ndarray, s: dict, spa_above: float = 2.0) -> dict[str, np.ndarray]:
    """Score test; beyond ``spa_above`` the tail comes from the saddlepoint approximation."""
    r = _projected(g, s["x"], s["w"])
    u, v = r.T @ (s["y"] - s["mu"]), (r * r * s["w"][:, None]).sum(axis=0)
    ok = v > 1e-10
    v = np.where(ok, v, 1.0)
    chi2 = np.where(ok, u * u / v, 0.0)
    p = specfun.chi2_sf(chi2, 1.0)
    for k in np.flatnonzero(chi2 > spa_above):
        q = saddlepoint(abs(u[k]), r[:, k], s["mu"]) + saddlepoint(abs(u[k]), -r[:, k], s["mu"])
        if np.isfinite(q) and q > 0:
            p[k] = min(q, 1.0)
    return {"beta": np.where(ok, u / v, np.nan), "se": np.where(ok, 1 / np.sqrt(v), np.nan), "chi2": chi2, "p": np.clip(p, specfun.FLOOR, 1)}


def saddlepoint(q: float, g: np.ndarray, mu: np.ndarray) -> float:
    """P(sum g (y - mu) >= q) for independent Bernoulli y, by Lugannani and Rice's formula."""
    center = float(g @ mu)

    def slope(t: float) -> float:
        e = mu * np.exp(np.clip(g * t, -700, 700))
        return float((g * e / (1 - mu + e)).sum()) - center

    low, high = 0.0, 1.0
    while slope(high) < q:
        low, high = high, high * 2
        if high > 1e4:
            return float("nan")
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) < q else (low, mid)
    t = (low + high) / 2
    e = mu * np.exp(np.clip(g * t, -700, 700))
    share = e / (1 - mu + e)
    k = float(np.log(1 - mu + e).sum()) - t * center
    curve = float((g * g * share * (1 - share)).sum())
    w, v = math.sqrt(max(2 * (t * q - k), 1e-300)), t * math.sqrt(max(curve, 1e-300))
    if w < 1e-6 or v < 1e-6:
        return float("nan")
    z = w + math.log(v / w) / w
    return float(specfun.norm_sf(z))


def fit_ordinal(y: np.ndarray, x: np.ndarray, rounds: int = 100) -> dict:
    """Proportional odds: thresholds and effects by Newton's method with a numerical Hessian.

    y counts from 0; x has no intercept, which the thresholds hold.
    """
    levels, c = int(y.max()) + 1, x.shape[1]
    share = np.clip([(y <= j).mean() for j in range(levels - 1)], 1e-3, 1 - 1e-3)
    theta = np.concatenate([np.log(share / (1 - share)), np.zeros(c)])

    def gradient(t: np.ndarray) -> np.ndarray:
        a, eta = t[: levels - 1], x @ t[levels - 1 :]
        cum = 1 / (1 + np.exp(-np.clip(a[None] - eta[:, None], -35, 35)))
        full = np.column_stack([np.zeros(len(y)), cum, np.ones(len(y))])
        at = np.arange(len(y))
        prob = np.maximum(full[at, y + 1] - full[at, y], 1e-12)
        d = np.column_stack([np.zeros(len(y)), cum * (1 - cum), np.zeros(len(y))])
        up, down = d[at, y + 1] / prob, d[at, y] / prob
        ga = np.array([up[y == j].sum() - down[y == j + 1].sum() for j in range(levels - 1)])
        return np.concatenate([ga, -(x * (up - down)[:, None]).sum(axis=0)])

    for _ in range(rounds):
        g = gradient(theta)
        h = np.column_stack([(gradient(theta + 1e-5 * e) - gradient(theta - 1e-5 * e)) / 2e-5 for e in np.eye(len(theta))])
        step = np.linalg.solve(h - 1e-8 * np.eye(len(theta)), g)
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    eta = x @ theta[levels - 1 :]
    return {"y": y, "x": x, "cum": 1 / (1 + np.exp(-(theta[: levels - 1][None] - eta[:, None]))), "theta": theta}


def score_ordinal(g: np.ndarray, s: dict) -> dict[str, np.ndarray]:
    """One degree of freedom; a positive u means higher categories with more copies."""
    cum, y, x, n = s["cum"], s["y"], s["x"], len(s["y"])
    full = np.column_stack([np.zeros(n), cum, np.ones(n)])
    prob = np.maximum(np.diff(full, axis=1), 1e-12)
    at = np.arange(n)
    # derivatives of the log likelihood by the linear predictor and by the thresholds
    residual = full[at, y + 1] + full[at, y] - 1
    w = (prob * (full[:, 1:] + full[:, :-1] - 1) ** 2).sum(axis=1)
    f = cum * (1 - cum)
    cross = f * (full[:, :-2] - full[:, 2:])
    k = cum.shape[1]
    inner = np.diag((f * f * (1 / prob[:, :-1] + 1 / prob[:, 1:])).sum(axis=0))
    for j in range(k - 1):
        inner[j, j + 1] = inner[j + 1, j] = -(f[:, j] * f[:, j + 1] / prob[:, j + 1]).sum()
    nuisance = np.block([[inner, cross.T @ x], [x.T @ cross, x.T @ (w[:, None] * x)]])
    c = np.hstack([g.T @ cross, g.T @ (w[:, None] * x)])
    u, v = g.T @ residual, (g * g * w[:, None]).sum(axis=0) - np.einsum("mk,kl,ml->m", c, np.linalg.pinv(nuisance), c)
    ok = v > 1e-10
    chi2 = np.where(ok, u * u / np.where(ok, v, 1.0), 0.0)
    return {"u": u, "chi2": chi2, "p": np.clip(specfun.chi2_sf(chi2, 1.0), specfun.FLOOR, 1)}


def fit_multinomial(y: np.ndarray, x: np.ndarray, rounds: int = 60) -> dict:
    """Baseline-category logits by Newton's method; y counts from 0, which is the baseline."""
    levels, c = int(y.max()) + 1, x.shape[1]
    beta = np.zeros((levels - 1, c))
    own = (y[:, None] == np.arange(1, levels)[None]).astype(float)
    for _ in range(rounds):
        e = np.exp(np.clip(x @ beta.T, -30, 30))
        pi = e / (1 + e.sum(axis=1, keepdims=True))
        grad = ((own - pi).T @ x).ravel()
        h = np.block([[(x * (pi[:, a] * ((a == b) - pi[:, b]))[:, None]).T @ x for b in range(levels - 1)] for a in range(levels - 1)])
        step = np.linalg.solve(h + 1e-9 * np.eye(len(h)), grad)
        beta = beta + step.reshape(beta.shape)
        if np.abs(step).max() < 1e-9:
            break
    return {"own": own, "x": x, "pi": pi}


def score_multinomial(g: np.ndarray, s: dict) -> dict[str, np.ndarray]:
    """Score test with one degree of freedom for each category but the baseline."""
    own, x, pi = s["own"], s["x"], s["pi"]
    k, c = pi.shape[1], x.shape[1]
    cov = [[pi[:, a] * ((a == b) - pi[:, b]) for b in range(k)] for a in range(k)]
    xx = np.block([[(x * cov[a][b][:, None]).T @ x for b in range(k)] for a in range(k)])
    inverse = np.linalg.inv(xx + 1e-9 * np.eye(k * c))
    chi2 = np.zeros(g.shape[1])
    for m in range(g.shape[1]):
        col = g[:, m]
        u = (own - pi).T @ col
        v = np.array([[(col * col * cov[a][b]).sum() for b in range(k)] for a in range(k)])
        gx = np.block([[((col * cov[a][b])[None] @ x) for b in range(k)] for a in range(k)])
        v = v - gx @ inverse @ gx.T
        chi2[m] = u @ np.linalg.pinv(v) @ u if np.trace(v) > 1e-10 else 0.0
    return {"chi2": chi2, "p": np.clip(specfun.chi2_sf(chi2, float(k)), specfun.FLOOR, 1)}


def fit_cox(time: np.ndarray, event: np.ndarray, x: np.ndarray, rounds: int = 50) -> dict:
    """Proportional hazards with Breslow ties; x has no intercept and may have no column."""
    order = np.argsort(-time, kind="stable")
    t, d, x = time[order], event[order].astype(float), x[order]
    # the risk set of a row is everything down to the last row of its time
    last = np.searchsorted(-t, -t, side="right") - 1
    beta = np.zeros(x.shape[1])
    for _ in range(rounds if x.shape[1] else 0):
        e = np.exp(x @ beta)
        s0, s1 = np.cumsum(e)[last], np.cumsum(e[:, None] * x, axis=0)[last]
        s2 = np.cumsum(e[:, None, None] * x[:, :, None] * x[:, None], axis=0)[last]
        mean = s1 / s0[:, None]
        h = (d[:, None, None] * (s2 / s0[:, None, None] - mean[:, :, None] * mean[:, None])).sum(axis=0)
        step = np.linalg.solve(h + 1e-10 * np.eye(len(h)), (d[:, None] * (x - mean)).sum(axis=0))
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    e = np.exp(x @ beta)
    return {"order": order, "event": d, "x": x, "e": e, "last": last}


def score_cox(g: np.ndarray, s: dict) -> dict[str, np.ndarray]:
    """Partial-likelihood score test of each column, adjusted for the covariates of the fit."""
    g, d, e, x, last = g[s["order"]], s["event"], s["e"], s["x"], s["last"]
    s0 = np.cumsum(e)[last][:, None]
    mean = np.cumsum(e[:, None] * g, axis=0)[last] / s0
    u = (d[:, None] * (g - mean)).sum(axis=0)
    v = (d[:, None] * (np.cumsum(e[:, None] * g * g, axis=0)[last] / s0 - mean * mean)).sum(axis=0)
    if x.shape[1]:
        mx = np.cumsum(e[:, None] * x, axis=0)[last] / s0
        xx = (d[:, None, None] * (np.cumsum(e[:, None, None] * x[:, :, None] * x[:, None], axis=0)[last] / s0[:, :, None] - mx[:, :, None] * mx[:, None])).sum(axis=0)
        gx = np.stack([(d[:, None] * (np.cumsum(e[:, None] * g * x[:, [k]], axis=0)[last] / s0 - mean * mx[:, [k]])).sum(axis=0) for k in range(x.shape[1])])
        v = v - np.einsum("km,kl,lm->m", gx, np.linalg.inv(xx), gx)
    ok = v > 1e-10
    chi2 = np.where(ok, u * u / np.where(ok, v, 1.0), 0.0)
    return {"beta": np.where(ok, u / np.where(ok, v, 1.0), np.nan), "chi2": chi2, "p": np.clip(specfun.chi2_sf(chi2, 1.0), specfun.FLOOR, 1)}


def score_interaction(g: np.ndarray, s: dict) -> dict[str, np.ndarray]:
    """Gene by environment: F tests of main effect given interaction, interaction, and both. State: y, x, z."""
    y, x, z = s["y"], s["x"], s["z"]
    n, c = x.shape
    q, _ = np.linalg.qr(x)
    ry = y - q @ (q.T @ y)
    a, b = g - q @ (q.T @ g), g * z[:, None]
    b = b - q @ (q.T @ b)
    aa, bb, ab, ay, by = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0), a.T @ ry, b.T @ ry
    det = aa * bb - ab * ab
    ok = det > 1e-9
    det = np.where(ok, det, 1.0)
    main, inter = (bb * ay - ab * by) / det, (aa * by - ab * ay) / det
    explained = main * ay + inter * by
    s2 = np.maximum(ry @ ry - explained, 1e-300) / (n - c - 2)
    f_main, f_inter, f_joint = main**2 * det / bb / s2, inter**2 * det / aa / s2, explained / 2 / s2
    keep = lambda v: np.where(ok, v, np.nan)
    df2 = float(n - c - 2)
    return {
        "beta_main": keep(main), "beta_interact": keep(inter), "p_main": keep(specfun.f_sf(np.nan_to_num(f_main), 1.0, df2)), "p_interact": keep(specfun.f_sf(np.nan_to_num(f_inter), 1.0, df2)),
        "stat_joint": keep(f_joint), "p_joint": keep(specfun.f_sf(np.nan_to_num(f_joint), 2.0, df2)),
    }


def score_multi_trait(g: np.ndarray, s: dict) -> dict[str, np.ndarray]:
    """Joint test of several traits: squared effects against the residual covariance, chi-square in their number. State: y (n x d), x."""
    y, x = s["y"], s["x"]
    q, _ = np.linalg.qr(x)
    ry, rg = y - q @ (q.T @ y), g - q @ (q.T @ g)
    cov = ry.T @ ry / (len(y) - x.shape[1])
    gg = (rg * rg).sum(axis=0)
    ok = gg > 1e-9
    beta = (rg.T @ ry) / np.where(ok, gg, 1.0)[:, None]
    stat = np.einsum("md,de,me->m", beta, np.linalg.pinv(cov), beta) * gg
    out = {"stat": np.where(ok, stat, np.nan), "p": np.where(ok, np.clip(specfun.chi2_sf(np.where(ok, stat, 0.0), float(y.shape[1])), specfun.FLOOR, 1), np.nan)}
    return out | {f"beta_d{k}": np.where(ok, beta[:, k], np.nan) for k in range(y.shape[1])}


def permutation_max(g: np.ndarray, y: np.ndarray, x: np.ndarray, n_perms: int, seed: int) -> np.ndarray:
    """Largest squared correlation over these columns under each permutation of the residuals (seeded, so blocks agree)."""
    q, _ = np.linalg.qr(x)
    ry, rg = y - q @ (q.T @ y), g - q @ (q.T @ g)
    scale = np.sqrt((rg * rg).sum(axis=0))
    rg = rg[:, scale > 1e-9] / scale[scale > 1e-9]
    rng = np.random.default_rng(seed)
    shuffled = np.stack([ry[rng.permutation(len(ry))] for _ in range(n_perms)])
    return ((shuffled @ rg) ** 2 / (ry @ ry)).max(axis=1, initial=0.0)
