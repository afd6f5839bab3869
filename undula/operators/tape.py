"""Reverse-mode differentiation of the few array operations that the autoencoder needs."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


class Var:
    """An array and, for each array it came from, how a gradient goes back to it."""

    __slots__ = ("grad", "parents", "value")

    def __init__(self, value, parents=()):
        self.value, self.grad = np.asarray(value, float), None
        self.parents = tuple(p for p in parents if not isinstance(p[0], Fixed))  # nothing goes back to what is fixed

    def __add__(self, o):
        o = lift(o)
        return Var(self.value + o.value, ((self, lambda g: g), (o, lambda g: g)))

    def __mul__(self, o):
        o = lift(o)
        return Var(self.value * o.value, ((self, lambda g: g * o.value), (o, lambda g: g * self.value)))

    def __truediv__(self, o):
        o = lift(o)
        return Var(self.value / o.value, ((self, lambda g: g / o.value), (o, lambda g: -g * self.value / o.value**2)))

    def __neg__(self):
        return self * -1.0

    def __sub__(self, o):
        return self + -lift(o)

    def __getitem__(self, at):
        def back(g):
            out = np.zeros_like(self.value)
            out[at] = g
            return out

        return Var(self.value[at], ((self, back),))

    __radd__, __rmul__ = __add__, __mul__

    def map(self, f, slope):
        """f of every element, whose derivative is ``slope(value, f(value))``."""
        y = f(self.value)
        return Var(y, ((self, lambda g: g * slope(self.value, y)),))

    def square(self):
        return self.map(np.square, lambda x, y: 2 * x)

    def abs(self):
        return self.map(np.abs, lambda x, y: np.sign(x))

    def sqrt(self):
        return self.map(np.sqrt, lambda x, y: 0.5 / np.maximum(y, 1e-12))

    def relu(self):
        return self.map(lambda x: np.maximum(x, 0), lambda x, y: (x > 0).astype(float))

    def elu(self):
        return self.map(lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))), lambda x, y: np.where(x > 0, 1.0, y + 1))

    def floor(self, low: float):
        return self.map(lambda x: np.maximum(x, low), lambda x, y: (x > low).astype(float))

    def sum(self, axis=None, keepdims=False):
        kept = self.value.sum(axis=axis, keepdims=True)
        shape = kept.shape
        y = kept if keepdims else kept.reshape(()) if axis is None else kept.squeeze(axis)
        return Var(y, ((self, lambda g: np.broadcast_to(np.reshape(g, shape), self.value.shape)),))

    def mean(self, axis=None, keepdims=False):
        total = self.sum(axis, keepdims)
        return total * (1 / (self.value.size / total.value.size))


class Fixed(Var):
    """A constant."""

    __slots__ = ()


def lift(x) -> Var:
    return x if isinstance(x, Var) else Fixed(x)


@lru_cache(maxsize=256)
def _plan(spec: str) -> tuple:
    """How a product of two arrays is one of matrices: orders of axes, how many axes are shared by all three, alone and summed."""
    ins, out = spec.split("->")
    a, b = ins.split(",")
    every = [k for k in a if k in b and k in out]
    summed = [k for k in a if k in b and k not in out]
    rows, cols = [k for k in a if k not in b], [k for k in b if k not in a]
    made = every + rows + cols
    return [a.index(k) for k in every + rows + summed], [b.index(k) for k in every + summed + cols], [made.index(k) for k in out], len(every), len(rows), len(cols)


def product(spec: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``np.einsum`` of two arrays, every letter of which is in the other one or in the result, as a product of matrices."""
    of_a, of_b, of_out, every, rows, cols = _plan(spec)
    a, b = a.transpose(of_a), b.transpose(of_b)
    shared, tall, wide = a.shape[:every], a.shape[every : every + rows], b.shape[b.ndim - cols :]
    m, k, n = math.prod(tall), math.prod(a.shape[every + rows :]), math.prod(wide)
    return np.matmul(a.reshape(*shared, m, k), b.reshape(*shared, k, n)).reshape(*shared, *tall, *wide).transpose(of_out)


def einsum(spec: str, a, b) -> Var:
    """A product of two arrays; every letter of an operand is in the other one or in the result."""
    a, b = lift(a), lift(b)
    ins, out = spec.split("->")
    ia, ib = ins.split(",")
    return Var(
        product(spec, a.value, b.value),
        ((a, lambda g: product(f"{out},{ib}->{ia}", g, b.value)), (b, lambda g: product(f"{out},{ia}->{ib}", g, a.value))),
    )


def _fit(g: np.ndarray, shape: tuple) -> np.ndarray:
    """A gradient summed over the axes that were broadcast."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(i, keepdims=True)
    return g


def backward(loss: Var) -> None:
    """Fill ``grad`` of everything that ``loss`` came from."""
    order, seen, stack = [], set(), [(loss, False)]
    while stack:
        v, done = stack.pop()
        if done:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            stack.append((v, True))
            stack += [(p, False) for p, _ in v.parents]
    for v in order:
        v.grad = None
    loss.grad = np.ones_like(loss.value)
    for v in reversed(order):
        for p, back in v.parents:
            g = _fit(np.asarray(back(v.grad)), p.value.shape)
            p.grad = g if p.grad is None else p.grad + g
