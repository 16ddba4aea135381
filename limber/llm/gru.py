"""A bidirectional gated recurrent network with attention pooling, forward and backward, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gru(xp: np.ndarray, u: np.ndarray, mask: np.ndarray | None, back: bool, cache: list | None = None) -> np.ndarray:
    """States (B, L, H) from the projected inputs (B, L, 3H; update, reset, candidate); padded places stay zero."""
    b, length, _ = xp.shape
    h = u.shape[0]
    state = np.zeros((b, h), dtype=xp.dtype)
    out = np.empty((b, length, h), dtype=xp.dtype)
    for t in reversed(range(length)) if back else range(length):
        hu = state @ u
        gates = sigmoid(xp[:, t, : 2 * h] + hu[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        n = np.tanh(xp[:, t, 2 * h :] + r * hu[:, 2 * h :])
        new = n + z * (state - n)
        if mask is not None:
            new *= mask[:, t, None]
        if cache is not None:
            cache.append((t, state, z, r, n, hu[:, 2 * h :]))
        out[:, t] = state = new
    return out


def gru_gradient(dout: np.ndarray, u: np.ndarray, mask: np.ndarray, cache: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``u``."""
    dxp = np.zeros((*dout.shape[:2], 3 * u.shape[0]), dtype=dout.dtype)
    du = np.zeros_like(u)
    dh = np.zeros_like(dout[:, 0])
    for t, state, z, r, n, hun in reversed(cache):
        d = (dh + dout[:, t]) * mask[:, t, None]
        dan = d * (1 - z) * (1 - n * n)
        daz = d * (state - n) * z * (1 - z)
        dar = dan * hun * r * (1 - r)
        dhu = np.concatenate([daz, dar, dan * r], axis=1)
        dxp[:, t] = np.concatenate([daz, dar, dan], axis=1)
        du += state.T @ dhu
        dh = d * z + dhu @ u.T
    return dxp, du


def pooled_logits(states: np.ndarray, mask: np.ndarray | None, p: dict[str, np.ndarray], cache: dict | None = None) -> np.ndarray:
    """Attention over the places of each window, then a linear score; a window without words scores the bias."""
    s = np.tanh(states @ p["att"])
    e = s @ p["att_v"]
    if mask is not None:
        e = np.where(mask > 0, e, -1e9)
    w = np.exp(e - e.max(axis=1, keepdims=True))
    if mask is not None:
        w *= mask
    w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
    pooled = np.einsum("bl,blh->bh", w, states)
    if cache is not None:
        cache |= {"s": s, "w": w, "pooled": pooled}
    return pooled @ p["out"] + p["out_b"][0]


def loss_gradient(x: np.ndarray, inverse: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Weighted cross-entropy of windows ``inverse`` (B, L; rows of ``x``), its gradients for ``p`` and for ``x``."""
    grads: dict[str, np.ndarray] = {}
    caches: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([gru((x @ p[f"w{d}"] + p[f"c{d}"])[inverse], p[f"u{d}"], mask, d == "b", caches[d]) for d in "fb"], axis=2)
    seen: dict[str, np.ndarray] = {}
    logits = pooled_logits(states, mask, p, seen)
    q = sigmoid(logits)
    loss = float(-(weight * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).sum() / weight.sum())
    dl = (weight * (q - y) / weight.sum()).astype(x.dtype)
    grads["out"], grads["out_b"] = seen["pooled"].T @ dl, np.array([dl.sum()], dtype=x.dtype)
    dp = dl[:, None] * p["out"]
    dw = np.einsum("blh,bh->bl", states, dp)
    de = seen["w"] * (dw - (seen["w"] * dw).sum(axis=1, keepdims=True))
    ds = de[:, :, None] * p["att_v"] * (1 - seen["s"] ** 2)
    grads["att_v"] = np.einsum("blk,bl->k", seen["s"], de)
    grads["att"] = np.einsum("blh,blk->hk", states, ds)
    dstates = seen["w"][:, :, None] * dp[:, None] + ds @ p["att"].T
    h = p["uf"].shape[0]
    dx = np.zeros_like(x)
    flat = inverse.ravel()
    order = np.argsort(flat, kind="stable")
    rows, first = np.unique(flat[order], return_index=True)
    for d, part in (("f", dstates[:, :, :h]), ("b", dstates[:, :, h:])):
        dxp, grads[f"u{d}"] = gru_gradient(part, p[f"u{d}"], mask, caches[d])
        summed = np.zeros((len(x), 3 * h), dtype=x.dtype)
        summed[rows] = np.add.reduceat(dxp.reshape(-1, 3 * h)[order], first, axis=0)
        grads[f"w{d}"], grads[f"c{d}"] = x.T @ summed, summed.sum(axis=0)
        dx += summed @ p[f"w{d}"].T
    return loss, grads, dx
