"""Vector arithmetic on array columns of a known length.

Sums over elements are written out, so they compile into one generated
function; higher-order functions would be interpreted element by element.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG2E = math.log2(math.e)


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def tidy_by_arithmetic(c: Column, digits: int = 6) -> Column:
    """The same by arithmetic on doubles, which is far quicker than decimals; for numbers under 1e9 and many rows."""
    return F.rint(c * 10.0**digits) / F.lit(10.0**digits) + F.lit(0.0)


def dot(a: Column | str, b: Column | str, dim: int) -> Column:
    """Of two columns given by name the sum is one parsed expression, which is far quicker to build."""
    if isinstance(a, str) and isinstance(b, str):
        return F.expr(" + ".join(f"{a}[{i}] * {b}[{i}]" for i in range(dim)))
    return reduce(add, (a[i] * b[i] for i in range(dim)))


def cuboid_bound(q: str, hi: str, lo: str, dim: int) -> Column:
    """The greatest dot product of q with any vector between lo and hi, columns given by name."""
    return F.expr(" + ".join(f"greatest({q}[{i}] * {hi}[{i}], {q}[{i}] * {lo}[{i}])" for i in range(dim)))


def array_of(form: str, dim: int) -> Column:
    """An array of one expression for each element, ``{i}`` standing for its number."""
    return F.expr("array(" + ", ".join(form.replace("{i}", str(i)) for i in range(dim)) + ")")


def _scaled(x: Column, scale: Column, weight: list[float] | None = None) -> Column:
    """Elements times one scale, which is computed once; and times a literal weight each."""
    w = None if weight is None else F.array(*(F.lit(float(v)) for v in weight))
    times = (lambda s: lambda e, i: e * s["m"]) if w is None else (lambda s: lambda e, i: e * s["m"] * F.get(w, i))
    return F.transform(F.array(F.struct(x.alias("x"), scale.alias("m"))), lambda s: F.transform(s["x"], times(s)))[0]


def l2_normalize(x: Column, dim: int) -> Column:
    return _scaled(x, 1 / F.sqrt(dot(x, x, dim)))


def rms_norm(x: Column, weight: list[float], eps: float = 1e-5) -> Column:
    dim = len(weight)
    return _scaled(x, 1 / F.sqrt(dot(x, x, dim) / dim + eps), weight)


def rope(x: Column, pos: Column, dim: int, theta: float = 1e4, scale: float = 1.0, past: int = 0) -> Column:
    """Rotary position encoding of halves: element i turns with i +- dim/2 by the angle of i mod dim/2."""
    half = dim // 2
    angle = [(pos + past) * (theta ** (-2.0 * i / dim) / scale) for i in range(half)]
    first = [x[i] * F.cos(angle[i]) - x[i + half] * F.sin(angle[i]) for i in range(half)]
    second = [x[i + half] * F.cos(angle[i]) + x[i] * F.sin(angle[i]) for i in range(half)]
    return F.array(*first, *second)


def alibi_slope(head: Column, n_heads: int) -> Column:
    """2^(-8(h+1)/n) for the greatest power of two n up to the heads; the further heads in between."""
    n = 1 << (n_heads.bit_length() - 1)
    return F.when(head < n, F.pow(F.lit(2.0), -8.0 * (head + 1) / n)).otherwise(F.pow(F.lit(2.0), -4.0 * (2 * (head + 1 - n) - 1) / n))


def alibi_bias(head: Column, n_heads: int, q_pos: Column, kv_pos: Column) -> Column:
    return alibi_slope(head, n_heads) * (kv_pos - q_pos)


def linear(x: Column, matrix: list[list[float]]) -> Column:
    """x times a literal matrix given by rows: element j is the sum of x[i] * matrix[i][j]."""
    return F.array(*(reduce(add, (x[i] * float(row[j]) for i, row in enumerate(matrix))) for j in range(len(matrix[0]))))


def ceil_div(a: Column, b: int) -> Column:
    return F.call_function("div", a + (b - 1), F.lit(b))


def power_of_two(n: Column) -> Column:
    """The least power of two that is at least n."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.expr("1") * F.pow(F.lit(2), F.ceil(F.log2(n.cast("double"))))).cast("long")
