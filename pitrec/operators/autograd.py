"""Reverse-mode gradients of numpy expressions, and the optimiser of the learned models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Var:
    """An array with the steps that made it; `backward` leaves the gradient of a scalar in each array's `grad`."""

    def __init__(self, data, made_from: tuple = (), back: Callable | None = None):
        self.data = np.asarray(data)
        self.grad: np.ndarray | None = None
        self._from, self._back = made_from, back

    def backward(self) -> None:
        order, known, todo = [], set(), [(self, False)]
        while todo:
            v, done = todo.pop()
            if done:
                order.append(v)
            elif id(v) not in known:
                known.add(id(v))
                todo.append((v, True))
                todo += [(p, False) for p in v._from]
        for v in order:
            v.grad = None
        self.grad = np.ones_like(self.data)
        for v in reversed(order):
            if v._back is not None and v.grad is not None:
                for parent, g in zip(v._from, v._back(v.grad)):
                    if g is not None:
                        parent.grad = g if parent.grad is None else parent.grad + g

    def __add__(self, other):
        other = var(other)
        return Var(self.data + other.data, (self, other), lambda g: (_like(g, self.data), _like(g, other.data)))

    def __mul__(self, other):
        other = var(other)
        return Var(self.data * other.data, (self, other), lambda g: (_like(g * other.data, self.data), _like(g * self.data, other.data)))

    def __matmul__(self, other):
        a, b = self.data, other.data

        def back(g):
            return _like(g @ np.swapaxes(b, -1, -2), a), _like(np.swapaxes(a, -1, -2) @ g, b)

        return Var(a @ b, (self, other), back)

    def __neg__(self):
        return self * -1.0

    def __sub__(self, other):
        return self + -var(other)

    __radd__, __rmul__ = __add__, __mul__


def var(x) -> Var:
    return x if isinstance(x, Var) else Var(x)


def _like(g: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Sums a gradient over the axes along which an operand was repeated."""
    while g.ndim > to.ndim:
        g = g.sum(axis=0)
    for k, n in enumerate(to.shape):
        if n == 1 and g.shape[k] > 1:
            g = g.sum(axis=k, keepdims=True)
    return g


def total(x: Var, axis: int | None = None, keepdims: bool = False) -> Var:
    def back(g):
        if axis is not None and not keepdims:
            g = np.expand_dims(g, axis)
        return (np.broadcast_to(g, x.data.shape),)

    return Var(x.data.sum(axis=axis, keepdims=keepdims), (x,), back)


def relu(x: Var) -> Var:
    return Var(np.maximum(x.data, 0), (x,), lambda g: (g * (x.data > 0),))


def sigmoid(x: Var) -> Var:
    s = 0.5 * (1 + np.tanh(0.5 * x.data))
    return Var(s, (x,), lambda g: (g * s * (1 - s),))


def silu(x: Var) -> Var:
    return x * sigmoid(x)


def exp(x: Var) -> Var:
    e = np.exp(x.data)
    return Var(e, (x,), lambda g: (g * e,))


def concat(parts: list[Var]) -> Var:
    ends = np.cumsum([p.data.shape[-1] for p in parts])[:-1]
    return Var(np.concatenate([p.data for p in parts], axis=-1), tuple(parts), lambda g: tuple(np.split(g, ends, axis=-1)))


def swap(x: Var) -> Var:
    return Var(np.swapaxes(x.data, -1, -2), (x,), lambda g: (np.swapaxes(g, -1, -2),))


def reshape(x: Var, *shape: int) -> Var:
    return Var(x.data.reshape(shape), (x,), lambda g: (g.reshape(x.data.shape),))


def rows(table: Var, index: np.ndarray) -> Var:
    """Rows of a table; row 0 is padding, reads as it is and is never changed."""

    def back(g):
        width = table.data.shape[1]
        cells = (index.reshape(-1, 1) * width + np.arange(width)).ravel()
        out = np.bincount(cells, weights=g.ravel(), minlength=table.data.size).reshape(table.data.shape)
        out[0] = 0
        return (out,)

    return Var(table.data[index], (table,), back)


def taken(x: Var, index: np.ndarray) -> Var:
    """Rows of a matrix by place, any number of times; unlike `rows` without padding."""

    def back(g):
        width = x.data.shape[1]
        cells = (index.reshape(-1, 1) * width + np.arange(width)).ravel()
        return (np.bincount(cells, weights=g.ravel(), minlength=x.data.size).reshape(x.data.shape),)

    return Var(x.data[index], (x,), back)


def at(x: Var, index: np.ndarray) -> Var:
    """x[i, index[i]] of a batch of sequences."""
    n = np.arange(len(index))

    def back(g):
        out = np.zeros_like(x.data)
        out[n, index] = g
        return (out,)

    return Var(x.data[n, index], (x,), back)


def softmax(x: Var) -> Var:
    e = np.exp(x.data - x.data.max(axis=-1, keepdims=True))
    p = e / e.sum(axis=-1, keepdims=True)
    return Var(p, (x,), lambda g: (p * (g - (g * p).sum(axis=-1, keepdims=True)),))


def unit(x: Var, least: float = 1e-12) -> Var:
    n = np.maximum(np.sqrt((x.data**2).sum(axis=-1, keepdims=True)), least)
    y = x.data / n
    return Var(y, (x,), lambda g: ((g - y * (g * y).sum(axis=-1, keepdims=True)) / n,))


def centred(x: Var, least: float = 1e-5) -> Var:
    """Mean 0 and deviation 1 along the last axis."""
    d = x.data - x.data.mean(axis=-1, keepdims=True)
    s = np.sqrt((d**2).mean(axis=-1, keepdims=True) + least)
    y = d / s
    return Var(y, (x,), lambda g: ((g - g.mean(axis=-1, keepdims=True) - y * (g * y).mean(axis=-1, keepdims=True)) / s,))


def cross_entropy(logits: Var, target: np.ndarray) -> Var:
    """Mean over rows; masked cells hold -inf."""
    z = logits.data - logits.data.max(axis=-1, keepdims=True)
    e = np.exp(z)
    p, n = e / e.sum(axis=-1, keepdims=True), len(target)
    own = p[np.arange(n), target]

    def back(g):
        d = p.copy()
        d[np.arange(n), target] -= 1
        return (g * d / n,)

    return Var(-np.log(np.maximum(own, 1e-300)).mean(), (logits,), back)


def weighted_bce(logits: Var, y: np.ndarray, w: np.ndarray) -> Var:
    """Weighted mean of the logistic loss."""
    z, total_w = logits.data, w.sum()
    loss = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
    p = 0.5 * (1 + np.tanh(0.5 * z))
    return Var((loss * w).sum() / total_w, (logits,), lambda g: (g * (p - y) * w / total_w,))


def masked(logits: Var, mask: np.ndarray) -> Var:
    """-inf where the mask is set."""
    return Var(np.where(mask, -np.inf, logits.data), (logits,), lambda g: (np.where(mask, 0, g),))


class AdamW:
    """Steps with decoupled decay for the weight matrices alone: embeddings, biases and scales are a group without it."""

    def __init__(self, params: dict[str, Var], lr: float, decay: float, clip: float = 5.0):
        self.params, self.lr, self.decay, self.clip, self.n = params, lr, decay, clip, 0
        self.m = {k: np.zeros_like(v.data) for k, v in params.items()}
        self.v = {k: np.zeros_like(v.data) for k, v in params.items()}

    def state(self) -> dict[str, np.ndarray]:
        """Weights, moments and number of steps, as arrays that can be averaged."""
        return {f"p/{k}": v.data for k, v in self.params.items()} | {f"m/{k}": v for k, v in self.m.items()} | {f"v/{k}": v for k, v in self.v.items()} | {"n": np.float64(self.n)}

    def load(self, state: dict[str, np.ndarray]) -> AdamW:
        for k, p in self.params.items():
            p.data, self.m[k], self.v[k] = (np.array(state[f"{c}/{k}"]) for c in "pmv")
        self.n = float(state["n"])
        return self

    @staticmethod
    def decays(name: str) -> bool:
        return name.startswith("w_")

    def step(self) -> None:
        self.n += 1
        grads = {k: p.grad for k, p in self.params.items() if p.grad is not None}
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, self.clip / max(norm, 1e-12))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            move = self.m[k] / (1 - 0.9**self.n) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)
            p = self.params[k]
            p.data = p.data - self.lr * (move + (self.decay * p.data if self.decays(k) else 0.0))
            p.grad = None


def dense(rng: np.random.Generator, n: int, m: int) -> Var:
    return Var(rng.normal(0, np.sqrt(2.0 / n), (n, m)))


def embedding(rng: np.random.Generator, n: int, m: int, std: float = 0.05) -> Var:
    """A table whose row 0 is zero."""
    data = rng.normal(0, std, (n, m))
    data[0] = 0
    return Var(data)
