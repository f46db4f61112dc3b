"""A linear-chain conditional random field over dense features, trained by gradient steps in numpy."""

from __future__ import annotations

import numpy as np


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class CRF:
    """Weights of features by label, of transitions, and of the first label."""

    def __init__(self, n_features: int, n_labels: int):
        self.w = np.zeros((n_features, n_labels))
        self.t = np.zeros((n_labels, n_labels))
        self.s = np.zeros(n_labels)

    def _grad(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean log likelihood over padded sequences x [B,T,F], y [B,T], mask [B,T]."""
        b, steps, _ = x.shape
        k = len(self.s)
        e = x @ self.w
        alpha = np.zeros((b, steps, k))
        beta = np.zeros((b, steps, k))
        alpha[:, 0] = self.s + e[:, 0]
        for i in range(1, steps):
            nxt = lse(alpha[:, i - 1, :, None] + self.t[None], 1) + e[:, i]
            alpha[:, i] = np.where(mask[:, i, None], nxt, alpha[:, i - 1])
        for i in range(steps - 2, -1, -1):
            nxt = lse(self.t[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(mask[:, i + 1, None], nxt, beta[:, i + 1])
        z = lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        gold = np.eye(k)[y] * mask[:, :, None]
        gw = np.einsum("btf,btk->fk", x, gold - node) / b
        gs = (gold[:, 0] - node[:, 0]).sum(axis=0) / b
        gt = np.zeros_like(self.t)
        for i in range(1, steps):
            on = mask[:, i]
            if on.any():
                pair = np.exp(alpha[on, i - 1, :, None] + self.t[None] + (e[on, i] + beta[on, i])[:, None, :] - z[on, None, None])
                gt += (gold[on, i - 1][:, :, None] * gold[on, i][:, None, :] - pair).sum(axis=0) / b
        return [gw, gt, gs]

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = 80, rate: float = 0.15, l2: float = 1e-3) -> CRF:
        par = [self.w, self.t, self.s]
        m1 = [np.zeros_like(p) for p in par]
        m2 = [np.zeros_like(p) for p in par]
        for step in range(1, steps + 1):
            for p, g, a, v in zip(par, self._grad(x, y, mask), m1, m2):
                g = g - l2 * p
                a[...] = 0.9 * a + 0.1 * g
                v[...] = 0.99 * v + 0.01 * g * g
                p += rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, x: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The best labels of sequences laid end to end: x [N,F], lens [B]; sequences of one length run together."""
        e = x @ self.w
        out = np.zeros(len(x), dtype=np.int64)
        starts = np.cumsum(lens) - lens
        for n in np.unique(lens[lens > 0]):
            at = starts[lens == n]
            best = self.s + e[at]
            back = []
            for i in range(1, n):
                c = best[:, :, None] + self.t[None]
                back.append(c.argmax(axis=1))
                best = c.max(axis=1) + e[at + i]
            lab = best.argmax(axis=1)
            out[at + n - 1] = lab
            for i in range(n - 2, -1, -1):
                lab = back[i][np.arange(len(at)), lab]
                out[at + i] = lab
        return out


def pad(seqs: list[np.ndarray], labels: list[list[int]], longest: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences as padded arrays for training; longer ones are cut into runs of `longest`, of which none is left out."""
    cut = [(s[i : i + longest], y[i : i + longest]) for s, y in zip(seqs, labels) for i in range(0, len(s), longest)]
    seqs, labels = [s for s, _ in cut], [y for _, y in cut]
    steps, f = max(len(s) for s in seqs), seqs[0].shape[1]
    x = np.zeros((len(seqs), steps, f))
    y = np.zeros((len(seqs), steps), dtype=np.int64)
    mask = np.zeros((len(seqs), steps), dtype=bool)
    for i, (s, lab) in enumerate(zip(seqs, labels)):
        x[i, : len(s)], y[i, : len(s)], mask[i, : len(s)] = s, lab, True
    return x, y, mask
