"""Scores over vector columns, without Python in the rows' path."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero (M6)."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def translational(h: Column, r: Column, t: Column, p: int = 2) -> Column:
    """Minus the p-norm of h + r - t."""
    off = F.zip_with(F.zip_with(h, r, lambda x, y: x + y), t, lambda x, y: F.abs(x - y))
    return -(_sum(off) if p == 1 else F.sqrt(_sum(F.transform(off, lambda x: x * x))))


def bilinear(h: Column, r: Column, t: Column) -> Column:
    """Sum of h * r * t."""
    return dot(F.zip_with(h, r, lambda x, y: x * y), t)


def rotation(h: Column, phase: Column, t: Column) -> Column:
    """Minus the sum of moduli of h rotated by phase, less t; (re, im) pairs interleaved."""
    pair = F.sequence(F.lit(0), F.size(phase) - 1)

    def modulus(k):
        c, s = F.cos(F.get(phase, k)), F.sin(F.get(phase, k))
        re, im = F.get(h, 2 * k), F.get(h, 2 * k + 1)
        return F.sqrt(F.pow(re * c - im * s - F.get(t, 2 * k), F.lit(2)) + F.pow(re * s + im * c - F.get(t, 2 * k + 1), F.lit(2)))

    return -_sum(F.transform(pair, modulus))


def _scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def mobius_add(x: Column, y: Column, c: float = 1.0) -> Column:
    """Addition in the ball of curvature -c."""
    xy, x2, y2 = dot(x, y), dot(x, x), dot(y, y)
    low = F.greatest(1 + 2 * c * xy + c * c * x2 * y2, F.lit(1e-15))
    return F.zip_with(_scaled(x, (1 + 2 * c * xy + c * y2) / low), _scaled(y, (1 - c * x2) / low), lambda a, b: a + b)


def exp0(v: Column, c: float = 1.0) -> Column:
    """From the tangent space at the origin into the ball."""
    n, root = F.greatest(norm(v), F.lit(1e-15)), c**0.5
    return _scaled(v, F.tanh(root * n) / (root * n))


def log0(y: Column, c: float = 1.0) -> Column:
    n, root = F.greatest(norm(y), F.lit(1e-15)), c**0.5
    return _scaled(y, F.atanh(F.least(root * n, F.lit(1 - 1e-5))) / (root * n))


def poincare_distance(x: Column, y: Column, c: float = 1.0) -> Column:
    root = c**0.5
    apart = norm(mobius_add(F.transform(x, lambda a: -a), y, c))
    return 2 / root * F.atanh(F.least(root * apart, F.lit(1 - 1e-5)))


def circular_correlation(a: Column, b: Column) -> Column:
    """out[i] = sum over k of a[k] * b[(k + i) mod n]."""
    n = F.size(a)
    at = F.sequence(F.lit(0), n - 1)
    return F.transform(at, lambda i: _sum(F.transform(at, lambda k: F.get(a, k) * F.get(b, F.pmod(k + i, n)))))


def mixed_score(scores: list[Column], logits: list[float]) -> Column:
    """Scores weighted by the softmax of given logits."""
    from math import exp

    top = max(logits)
    e = [exp(x - top) for x in logits]
    return sum((s * (w / sum(e)) for s, w in zip(scores[1:], e[1:])), scores[0] * (e[0] / sum(e)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))
