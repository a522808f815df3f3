"""A two-state linear-chain conditional random field over whole token arrays.

Many documents form one long chain; a reset at each first token makes them
independent. With two states a message is one ratio, and a step of the
recursion is a Moebius map, that is a 2x2 matrix. The chain is cut into rows
of equal length: the products of all rows are formed side by side, joined
one after the other, and then all rows are stepped through side by side.
"""

from __future__ import annotations

import numpy as np

_ROW = 64


def _ratios(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """r[t] = (a r[t-1] + b) / (c r[t-1] + d) for all t, where r[-1] = 1."""
    n = len(a)
    rows = -(-n // _ROW)
    pad = rows * _ROW - n

    def grid(x: np.ndarray, fill: float) -> np.ndarray:
        return np.ascontiguousarray(np.concatenate([x, np.full(pad, fill)]).reshape(rows, _ROW).T)

    a, b, c, d = grid(a, 1), grid(b, 0), grid(c, 0), grid(d, 1)
    p, q, r, s = a[0], b[0], c[0], d[0]
    for k in range(1, _ROW):
        p, q, r, s = a[k] * p + b[k] * r, a[k] * q + b[k] * s, c[k] * p + d[k] * r, c[k] * q + d[k] * s
        if k % 4 == 3:
            scale = 1 / np.maximum(np.maximum(p, q), np.maximum(r, s))
            p, q, r, s = p * scale, q * scale, r * scale, s * scale
    start = np.ones(rows)
    x = 1.0
    for k, (e, f, g, h) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        start[k] = x
        x = (e * x + f) / (g * x + h)
    out = np.empty((_ROW, rows))
    x = start
    for k in range(_ROW):
        x = (a[k] * x + b[k]) / (c[k] * x + d[k])
        out[k] = x
    return out.T.reshape(-1)[:n]


def messages(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (state 1 over state 0) of each token.

    unary: log-potential of state 1 less that of state 0. first: marks the first token of each document.
    trans: 2x2 log-potentials; a document starts as after state 0.
    """
    t = np.exp(trans)
    u = np.exp(np.clip(unary, -30, 30))
    a, b = u * t[1, 1], u * t[0, 1]
    c, d = np.full(len(u), t[1, 0]), np.full(len(u), t[0, 0])
    a[first], c[first] = 0, 0
    forward = _ratios(a, b, c, d)
    nxt = np.append(u[1:], 1.0)[::-1]
    a, b = nxt * t[1, 1], np.full(len(u), t[1, 0])
    c, d = nxt * t[0, 1], np.full(len(u), t[0, 0])
    last = np.append(first[1:], True)[::-1]
    a[last], b[last], c[last], d[last] = 0, 1, 0, 1
    return forward, _ratios(a, b, c, d)[::-1]


def marginals(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of state 1 at each token."""
    if not len(unary):
        return np.zeros(0)
    forward, backward = messages(unary, first, trans)
    odds = forward * backward
    return odds / (1 + odds)


def train(features: np.ndarray, label: np.ndarray, first: np.ndarray, size: int, steps: int = 60, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transitions that maximise the penalised conditional likelihood of the labels.

    features: an index below ``size`` for each token and kind of feature. Adagrad on the whole sample.
    """
    weight, trans, bias = np.zeros(size), np.array([[0.0, -2.0], [0.0, 0.0]]), -2.0
    seen, seen_t, seen_b = np.full(size, 1e-8), np.full((2, 2), 1e-8), 1e-8
    prior = np.append(0, label[:-1])
    prior[first] = 0
    real_t = np.bincount(2 * prior + label, minlength=4).reshape(2, 2).astype(float)
    scale = 1.0 / max(1, label.sum())
    flat, width = features.reshape(-1), features.shape[1]
    for _ in range(steps):
        unary = weight[features].sum(1) + bias
        forward, backward = messages(unary, first, trans)
        p = forward * backward
        p = p / (1 + p)
        before = np.append(0.0, forward[:-1])
        before[first] = 0
        t, up = np.exp(trans), np.exp(np.clip(unary, -30, 30)) * backward
        w00, w01, w10, w11 = t[0, 0], t[0, 1] * up, before * t[1, 0], before * t[1, 1] * up
        z = w00 + w01 + w10 + w11
        model_t = np.array([[np.sum(w00 / z), np.sum(w01 / z)], [np.sum(w10 / z), np.sum(w11 / z)]])
        off = label - p
        grad = np.bincount(flat, weights=np.repeat(off, width), minlength=size) * scale - decay * weight
        grad_t, grad_b = (real_t - model_t) * scale, off.sum() * scale
        seen += grad**2
        seen_t += grad_t**2
        seen_b += grad_b**2
        weight += rate * grad / np.sqrt(seen)
        trans = np.clip(trans + 0.2 * rate * grad_t / np.sqrt(seen_t), -6, 6)
        trans -= trans[0, 0]
        bias += 0.2 * rate * grad_b / np.sqrt(seen_b)
    return np.append(weight, bias), trans
