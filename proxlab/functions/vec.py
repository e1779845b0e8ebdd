"""Array-column algebra: dot products, norms and bias on ``array<double>`` columns.

For a fixed, small weight vector the dot product is unrolled into ``f[i] * w_i``
terms so it compiles into whole-stage codegen; above ``UNROLL_LIMIT`` it falls
back to ``zip_with`` + ``aggregate`` (higher-order functions, evaluated per element).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL_LIMIT = 256


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot_lit(features, weights: Sequence[float], skip_zeros: bool = False) -> Column:
    """features . w for a literal weight vector.

    ``skip_zeros`` leaves out features of weight 0 (a NaN there then does not show); it is one rule for every width.
    """
    f = _c(features)
    w = [float(v) for v in weights]
    if len(w) <= UNROLL_LIMIT:
        terms = [f.getItem(i) * F.lit(v) for i, v in enumerate(w) if v != 0.0 or not skip_zeros]
        if not terms:
            return F.lit(0.0)
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out
    warr = F.array(*[F.lit(v) for v in w])
    term = (lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a * b)) if skip_zeros else (lambda a, b: a * b)
    return F.aggregate(F.zip_with(f, warr, term), F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(features) -> Column:
    return F.aggregate(_c(features), F.lit(0.0), lambda acc, v: acc + v * v)


def l2_norm(features) -> Column:
    return F.sqrt(sq_norm(features))


def append_bias(features, value: float = 1.0) -> Column:
    return F.concat(_c(features), F.array(F.lit(float(value))))
