"""Plain sequential FM coordinate descent in numpy: one feature at a time,
ascending ids.  Used only by the tests as an independent check of the
block-wise Spark learner."""

from __future__ import annotations

import math

import numpy as np


def predict(rows, w0, w, v, k0=True, k1=True):
    out = []
    for ids, xs in rows:
        p = w0 if k0 else 0.0
        if len(ids):
            if k1:
                p += float(np.dot(w[ids], xs))
            for f in range(v.shape[0]):
                vx = v[f, ids] * xs
                p += 0.5 * (vx.sum() ** 2 - (vx * vx).sum())
        out.append(p)
    return np.array(out)


def _new(theta, reg, seh, shh):
    denom = reg + shh
    if denom == 0:
        return theta
    t = -(seh - theta * shh) / denom
    if math.isnan(t) or math.isinf(t):
        return theta
    return t


def iteration(rows, y, w0, w, v, reg0=0.0, regw=0.0, regv=10.0, k0=True, k1=True):
    """rows: list of (ids int array, xs float array).  Returns w0, w, v, rmse_before."""
    w, v = w.copy(), v.copy()
    e = predict(rows, w0, w, v, k0, k1) - y
    rmse = math.sqrt(float(np.mean(e * e))) if len(e) else 0.0
    n = len(rows)
    if k0:
        new = _new(w0, reg0, float(e.sum()), float(n))
        if new != w0:
            e = e + (new - w0)
        w0 = new
    cols: dict[int, list[tuple[int, float]]] = {}
    for r, (ids, xs) in enumerate(rows):
        for i, x in zip(ids, xs):
            cols.setdefault(int(i), []).append((r, float(x)))
    order = sorted(cols)
    if k1:
        for i in order:
            col = cols[i]
            shh = sum(x * x for _, x in col)
            seh = sum(e[r] * x for r, x in col)
            new = _new(w[i], regw, seh, shh)
            if new != w[i]:
                for r, x in col:
                    e[r] += x * (new - w[i])
            w[i] = new
    for f in range(v.shape[0]):
        q = np.array([float(np.dot(v[f, ids], xs)) if len(ids) else 0.0 for ids, xs in rows])
        for i in order:
            col = cols[i]
            hs = [(r, x * q[r] - x * x * v[f, i]) for r, x in col]
            shh = sum(h * h for _, h in hs)
            seh = sum(e[r] * h for r, h in hs)
            new = _new(v[f, i], regv, seh, shh)
            if new != v[f, i]:
                for (r, h), (_, x) in zip(hs, col):
                    e[r] += h * (new - v[f, i])
                    q[r] += x * (new - v[f, i])
            v[f, i] = new
    return w0, w, v, rmse
