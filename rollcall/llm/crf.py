"""Linear-chain conditional random field over batches of padded chains.

Chains are laid out position-major in pieces of at most ``width`` positions, so
one numpy step advances all pieces of a batch. ``marginals`` carries the messages
over the pieces of a chain (each piece is a labels x labels matrix between its
ends), so that a chain of any length is one chain; training takes the pieces as
they are.
"""

from __future__ import annotations

import numpy as np


def lay_out(length: np.ndarray, width: int):
    """Cuts runs of ``length`` consecutive items into chains of at most
    ``width``. Returns (row, column) of every item and the chains' lengths."""
    pieces = -(-length // width)
    size = np.full(int(pieces.sum()), width)
    last = np.cumsum(pieces)[pieces > 0] - 1
    size[last] = (length - (pieces - 1) * width)[pieces > 0]
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(int(size.sum())) - np.repeat(np.append(0, np.cumsum(size))[:-1], size)
    return row, col, size


def forward_backward(score: np.ndarray, size: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """``score``: positions x chains x labels (log); ``trans``: labels x labels.
    Returns the marginals, laid out alike; with ``pairs`` also the summed
    expected label pairs."""
    n, s, k = score.shape
    x = np.exp(score - score.max(axis=2, keepdims=True)) + 1e-30
    p = np.exp(trans).astype(x.dtype)
    a, b = np.empty_like(x), np.full_like(x, 1.0 / k)
    a[0] = x[0] / x[0].sum(axis=1, keepdims=True)
    for t in range(1, n):
        y = (a[t - 1] @ p) * x[t]
        a[t] = y / y.sum(axis=1, keepdims=True)
    for t in range(n - 2, -1, -1):
        y = (x[t + 1] * b[t + 1]) @ p.T
        y /= y.sum(axis=1, keepdims=True)
        inside = t < size - 1
        b[t][inside] = y[inside]
    g = a * b
    g /= g.sum(axis=2, keepdims=True)
    if not pairs:
        return g
    total = np.zeros((k, k))
    for t in range(1, n):
        live = t < size
        q = a[t - 1][live][:, :, None] * p[None] * (x[t] * b[t])[live][:, None, :]
        total += (q / q.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return g, total


def _unit(x: np.ndarray, axis) -> np.ndarray:
    return x / x.sum(axis=axis, keepdims=True)


def marginals(score: np.ndarray, size: np.ndarray, trans: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """As ``forward_backward``, over whole chains: ``pieces`` holds how many
    consecutive pieces each chain has; all but the last of a chain are full."""
    many = pieces[pieces > 0]
    if not len(many) or many.max() == 1:
        return forward_backward(score, size, trans)
    n, s, k = score.shape
    x = np.exp(score - score.max(axis=2, keepdims=True)) + 1e-30
    p = np.exp(trans).astype(np.float64)
    first = np.append(0, np.cumsum(many))[:-1]
    at = np.arange(s) - np.repeat(first, many)          # the piece's number in its chain
    left = np.repeat(many, many) - at - 1               # pieces after it
    # what a piece does to a message: into its first position, through to its last
    through = np.broadcast_to(p, (s, k, k)) * x[0][:, None, :]
    begin = _unit(x[0].astype(np.float64), 1)           # of a chain's first piece
    for t in range(1, n):
        live = (t < size)[:, None]
        through = np.where(live[:, :, None], _unit((through @ p) * x[t][:, None, :], (1, 2)), through)
        begin = np.where(live, _unit((begin @ p) * x[t], 1), begin)
    ahead = np.ones((s, k))                             # message into a piece, before its transition
    behind = np.full((s, k), 1.0 / k)                   # message back into its last position
    end = begin.copy()
    for j in range(1, int(many.max())):
        here = np.flatnonzero(at == j)
        ahead[here] = end[here - 1]
        end[here] = _unit(np.einsum("sk,skl->sl", ahead[here], through[here]), 1)
    for j in range(1, int(many.max())):
        here = np.flatnonzero(left == j)
        behind[here] = _unit(np.einsum("skl,sl->sk", through[here + 1], behind[here + 1]), 1)
    a, b = np.empty((n, s, k)), np.full((n, s, k), 1.0 / k)
    a[0] = _unit(np.where((at > 0)[:, None], ahead @ p, 1.0) * x[0], 1)
    for t in range(1, n):
        a[t] = _unit((a[t - 1] @ p) * x[t], 1)
    b[size - 1, np.arange(s)] = behind
    for t in range(n - 2, -1, -1):
        inside = t < size - 1
        b[t][inside] = _unit((x[t + 1] * b[t + 1]) @ p.T, 1)[inside]
    return _unit(a * b, 2)


class Adagrad:
    def __init__(self, shape, rate: float, decay: float = 0.0):
        self.w, self.g, self.rate, self.decay = np.zeros(shape), np.full(shape, 1e-8), rate, decay

    def step(self, grad: np.ndarray) -> None:
        grad = grad + self.decay * self.w
        self.g += grad * grad
        self.w -= self.rate * grad / np.sqrt(self.g)
