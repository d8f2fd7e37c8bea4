"""Hashed n-gram features and small linear models, trained on the driver on bounded samples."""

from __future__ import annotations

import numpy as np
import regex

#: Characters of a text that are hashed at once; the parts overlap, so no n-gram is lost.
PART = 1 << 20

LETTER = regex.compile(r"\p{L}")

_FOLD: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """For each code point of the basic plane: itself if a letter, else a space."""
    if "letters" not in _FOLD:
        _FOLD["letters"] = np.array([i if chr(i).isalpha() else 32 for i in range(1 << 16)], dtype=np.uint32)
    return _FOLD["letters"]


def has_letter(text: str) -> bool:
    return LETTER.search(text) is not None


def char_counts(text: str, orders: tuple[int, ...], bits: int, letters_only: bool) -> np.ndarray:
    """How often each hashed character n-gram occurs: ``len(orders)`` blocks of 2 ** bits counts."""
    size = 1 << bits
    out = np.zeros(len(orders) * size, np.float64)
    for at in range(0, max(1, len(text)), PART):
        part = text[at : at + PART + max(orders) - 1].lower()
        points = np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        if letters_only:
            points = np.where(points < (1 << 16), letters()[np.minimum(points, (1 << 16) - 1)], points)
        for block, n in enumerate(orders):
            if len(points) < n:
                continue
            h = points[: len(points) - n + 1] * np.uint32(2654435761)
            for i in range(1, n):
                h = (h ^ points[i : len(points) - n + 1 + i]) * np.uint32(2246822519)
                h ^= h >> np.uint32(15)
            out[block * size : (block + 1) * size] += np.bincount(h >> np.uint32(32 - bits), minlength=size)
    return out


def normal(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, of length 1; zeros stay zeros."""
    x = np.sqrt(counts)
    n = np.sqrt(x @ x)
    return (x / n if n else x).astype(np.float32)


def thin(x: np.ndarray) -> tuple[bytes, bytes]:
    """The places (32 bits) and values (32 bits) of what is not zero."""
    at = np.flatnonzero(x)
    return at.astype(np.int32).tobytes(), x[at].astype(np.float32).tobytes()


class Sparse:
    """Rows of (places, values), as ``thin`` packs them."""

    def __init__(self, rows: list[tuple[bytes, bytes]], width: int) -> None:
        self.index = np.frombuffer(b"".join(i for i, _ in rows), np.int32)
        self.value = np.frombuffer(b"".join(v for _, v in rows), np.float32)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) // 4 for i, _ in rows])
        self.shape = (len(rows), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out, w = np.zeros(self.shape[0]), w.astype(np.float32)
        for i in self._stretches():
            first = self.row[i.start]
            part = np.bincount(self.row[i] - first, self.value[i] * w[self.index[i]])
            out[first : first + len(part)] += part
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out, r = np.zeros(self.shape[1]), r.astype(np.float32)
        for i in self._stretches():
            out += np.bincount(self.index[i], self.value[i] * r[self.row[i]], self.shape[1])
        return out

    def _stretches(self) -> list[slice]:
        return [slice(i, i + (1 << 19)) for i in range(0, len(self.index), 1 << 19)]


def fit(x: Sparse, y: np.ndarray, loss: str, penalty: float, rounds: int = 80, weight: np.ndarray | None = None, enough: float = 2e-3, memory: int = 8) -> tuple[np.ndarray, float]:
    """A linear model by L-BFGS: ``hinge`` (squared, a linear SVM) or ``log``; y is -1 or 1.

    It stops when the gradient is ``enough`` times as long as at the start.
    """
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / weight.sum()

    def at(z: np.ndarray) -> tuple[float, np.ndarray]:
        margin = y * (x.dot(z[:-1]) + z[-1])
        if loss == "hinge":
            short = np.maximum(0, 1 - margin)
            value, slope = short * short, -2 * short
        else:
            value, slope = np.logaddexp(0, -margin), -1 / (1 + np.exp(np.clip(margin, -30, 30)))
        r = weight * y * slope
        return float(weight @ value + penalty / 2 * (z[:-1] @ z[:-1])), np.append(x.back(r) + penalty * z[:-1], r.sum())

    z = np.zeros(x.shape[1] + 1)
    value, gradient = at(z)
    start, past = np.linalg.norm(gradient), []
    for _ in range(rounds):
        if np.linalg.norm(gradient) <= enough * start:
            break
        way, back = -gradient, []
        for s, t, rho in reversed(past):
            back.append(rho * (s @ way))
            way = way - back[-1] * t
        if past:
            s, t, rho = past[-1]
            way = way / (rho * (t @ t))
        for (s, t, rho), a in zip(past, reversed(back), strict=True):
            way = way + (a - rho * (t @ way)) * s
        step, slope = 1.0, gradient @ way
        while True:
            new_value, new_gradient = at(z + step * way)
            if new_value <= value + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, t = step * way, new_gradient - gradient
        if s @ t > 1e-12:
            past = [*past, (s, t, 1 / (s @ t))][-memory:]
        z, value, gradient = z + s, new_value, new_gradient
    return z[:-1], float(z[-1])


def platt(score: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities; y is -1 or 1.

    Targets are drawn in by one pseudo-count for each class.
    """
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))

    def loss(a: float, b: float) -> float:
        z = a * score + b
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * (a * a + b * b))

    a, b = 0.0, float(np.log((good + 1) / (bad + 1)))
    for _ in range(rounds):
        p = sigmoid(a * score + b)
        g, h = p - target, p * (1 - p)
        grad = np.array([(g * score).sum() + 1e-3 * a, g.sum() + 1e-3 * b])
        hess = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, grad)
        step, now = 1.0, loss(a, b)
        while step > 1e-6 and loss(a - step * da, b - step * db) > now:
            step /= 2
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
