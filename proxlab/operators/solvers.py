"""Iterative solvers for  min 1/2 ||A x - b||^2 + lambda * R(x).

R is chosen by ``penalty``: ``"l1"`` (sum |x|), ``"l2"`` (1/2 ||x||^2) or ``"l_half"``
((1/2) sum |x|^(1/2), see :mod:`proxlab.functions.prox` for the scale).

All solvers talk to the data only through an operator from
:mod:`proxlab.operators.linalg` (``gv(v) = A^T A v``, ``c = A^T b``, ``bb``, ``m``), so the same
update runs on a Gram matrix (one Spark pass in total), on one fused Spark pass per
product, or on the COO column layout.  The n-dimensional updates run on the driver; no
m-length vector is ever materialized outside the executors.

ADMM keeps no per-row state: starting from p = y = 0 the multiplier and the split variable
stay of the form  p = A a + gamma b,  y = A d + eps b  (a, d in R^n; gamma, eps scalars).  With x its image
G x is carried; the images of all other vectors follow by the same linear updates, so an iteration costs one
product, and the norms of A x - y, x's change and the line search's move are scalar products of what is known.

Line search (FISTA ``line_search=True`` and ADMM ``line_search=True``): with d = x - z, the
sufficient-decrease test ||Ax-b||^2 <= ||Az-b||^2 + 2 d.g + ||d||^2/(2s) is exactly
||A d||^2 <= ||d||^2 / (2 s): one product a trial and no residual vectors.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.prox import check_penalty, prox_np


def penalty_value(penalty: str, x: np.ndarray) -> float:
    if penalty == "l1":
        return float(np.sum(np.abs(x)))
    if penalty == "l2":
        return 0.5 * float(x @ x)
    return 0.5 * float(np.sum(np.sqrt(np.abs(x))))


@dataclass
class SolverResult:
    x: np.ndarray
    z: np.ndarray
    step: float
    iterations: int
    history: list[dict] = field(default_factory=list)
    passes: int = 0
    op: object = field(default=None, repr=False)

    @functools.cached_property
    def rel_residual(self) -> float:
        """||A x - b|| / ||b|| from the rows; one pass, made when asked for."""
        return math.sqrt(self.op.residual_sq(self.x) / self.op.bb) if self.op.bb > 0 else float("nan")

    def weights_df(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([T.StructField("feat_id", T.IntegerType(), False),
                               T.StructField("weight", T.DoubleType(), False),
                               T.StructField("extrapolated", T.DoubleType(), False)])
        return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(self.x, self.z))],
                                     schema)

    def history_df(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([T.StructField("iter", T.IntegerType(), False),
                               T.StructField("objective", T.DoubleType(), True),
                               T.StructField("rel_residual", T.DoubleType(), True),
                               T.StructField("step", T.DoubleType(), True)])
        return spark.createDataFrame([(h["iter"], h.get("objective"), h.get("rel_residual"), h.get("step"))
                                      for h in self.history], schema)


def _residual_sq(op, v: np.ndarray, gv: np.ndarray) -> float:
    """||A v - b||^2 from the product G v already computed for v."""
    return max(float(v @ gv - 2.0 * op.c @ v + op.bb), 0.0)


def _progress(op, k: int, v: np.ndarray, gv: np.ndarray, lam: float, penalty: str, step: float) -> dict:
    """History entry from a product that the iteration has made anyway (accurate to rounding of b.b)."""
    r2 = _residual_sq(op, v, gv)
    return {"iter": k, "objective": 0.5 * r2 + lam * penalty_value(penalty, v),
            "rel_residual": math.sqrt(r2 / op.bb) if op.bb > 0 else None, "step": step}


def _converged(x, x_old, tol) -> bool:
    return tol > 0 and float(np.linalg.norm(x - x_old)) <= tol * max(float(np.linalg.norm(x_old)), 1.0)


def fista(op, lam: float, penalty: str = "l1", maxit: int = 100, step: float = 1.0,
          line_search: bool = True, shrink: float = 2.0, max_trials: int = 20,
          x0: np.ndarray | None = None, tol: float = 0.0) -> SolverResult:
    """V1: FISTA.  x = prox(z - s g, lambda s); momentum z = x + (t-1)/t' (x - x_old).

    With ``line_search`` the step is divided by ``shrink`` until ||A d||^2 <= ||d||^2/(2s)
    (at most ``max_trials`` times) and doubled on every 10th iteration; without it the
    step is constant.  Returns x (last proximal point) and z (extrapolated point).
    """
    check_penalty(penalty)
    n = op.n
    z = np.zeros(n) if x0 is None else np.asarray(x0, float).copy()
    x = z.copy()
    t_new, s = 1.0, float(step)
    hist = []
    k = 0
    for k in range(1, maxit + 1):
        gz = op.gv(z)
        g = gz - op.c
        hist.append(_progress(op, k, z, gz, lam, penalty, s))
        t, x_old = t_new, x
        trials = 0
        while True:
            x = prox_np(penalty, z - s * g, lam * s)
            if not line_search:
                break
            d = x - z
            dd = float(d @ d)
            if dd == 0.0 or float(d @ op.gv(d)) <= dd / (2.0 * s):
                break
            s /= shrink
            trials += 1
            if trials >= max_trials:
                break
        if line_search and k % 10 == 0:
            s *= 2.0
        t_new = 0.5 * (1.0 + math.sqrt(1.0 + 4.0 * t * t))
        z = x + (t - 1.0) / t_new * (x - x_old)
        if _converged(x, x_old, tol):
            break
    return SolverResult(x, z, s, k, hist, op.passes, op)


@dataclass
class _Pair:
    """The two sequences of accelerated proximal gradient: the averaged point and the prox point."""
    mean: np.ndarray
    prox: np.ndarray

    def at(self, weight: float) -> np.ndarray:
        return self.mean + weight * (self.prox - self.mean)


def momentum_weights(alpha: float):
    """1, then 2 / (1 + sqrt(1 + 4 alpha / previous^2)): the weights of the accelerated method with ratio ``alpha``."""
    weight = 1.0
    while True:
        yield weight
        weight = 2.0 / (1.0 + math.sqrt(1.0 + 4.0 * alpha / weight ** 2))


def apg_restart(op, lam: float = 1.0, penalty: str = "l1", alpha: float = 0.9, maxit: int = 100,
                step: float = 1e-3, tol: float = 0.0, x0: np.ndarray | None = None) -> SolverResult:
    """V2: accelerated proximal gradient with gradient restart (the published recurrence).

    The gradient is taken at the weighted mean of both sequences; the prox point moves against it; the
    mean follows by the momentum weight.  Where the mean moves uphill the prox point restarts from it.
    """
    check_penalty(penalty)
    start = np.zeros(op.n) if x0 is None else np.asarray(x0, float).copy()
    state = _Pair(start, start)
    hist = []
    for k, weight in zip(range(1, maxit + 1), momentum_weights(alpha)):
        y = state.at(weight)
        product = op.gv(y)
        slope = product - op.c
        hist.append(_progress(op, k, y, product, lam, penalty, step))
        moved = _Pair(state.mean, prox_np(penalty, state.prox - step * slope, lam * step))
        mean = moved.at(weight)
        uphill = float(slope @ (mean - state.mean)) > 0.0
        before, state = state.mean, _Pair(mean, mean if uphill else moved.prox)
        if _converged(mean, before, tol):
            break
    return SolverResult(state.mean, state.prox, step, len(hist), hist, op.passes, op)


#: of linearized ADMM: point and extrapolated point, the split's and the multiplier's coefficients, their images under G, A^T b
STATE = ("x", "z", "a", "d", "gx", "gz", "ga", "gd", "c")
SUMS = ("ee", "ege", "hh", "xx", "qgq", "cq")


@dataclass(frozen=True)
class Numbers:
    """The scalars of one ADMM iteration."""
    u: float        # step
    weight: float   # of A^T b in the slope
    push: float     # momentum


@dataclass(frozen=True)
class Updates:
    """The updates of linearized ADMM on vectors of any part of the features (numpy arrays by name).

    ``moved`` gives the proximal point ``w``; once its image under G is known, ``settled`` ends the iteration.
    """
    penalty: str
    lam: float
    beta: float

    def begin(self, c: np.ndarray, at: Numbers, x0: np.ndarray | None = None, gx0: np.ndarray | None = None) -> dict:
        first = {**dict.fromkeys(STATE, np.zeros(len(c))), "c": c}
        if x0 is not None:
            first |= {"x": x0, "z": x0, "gx": gx0, "gz": gx0}
        return {**first, "w": self.moved(first, at)["w"]}

    def moved(self, s: dict, at: Numbers) -> dict:
        """Coefficients after the split and multiplier steps, and the proximal point ``w``."""
        v, gv, beta = s["z"], s["gz"], self.beta
        a, ga = s["a"] + beta * (v - s["d"]), s["ga"] + beta * (gv - s["gd"])
        d, gd = (beta * v + a) / (1.0 + beta), (beta * gv + ga) / (1.0 + beta)
        slope = gv - gd + ga / beta + at.weight * s["c"]
        return {"a": a, "d": d, "ga": ga, "gd": gd, "w": prox_np(self.penalty, v - at.u * slope, self.lam * at.u / beta)}

    def settled(self, s: dict, gw: np.ndarray, at: Numbers, then: Numbers) -> dict:
        """The state after an iteration whose point's image is ``gw``, with the next point."""
        m = self.moved(s, at)
        x = m.pop("w")
        out = {**m, "x": x, "gx": gw, "z": x + at.push * (x - s["x"]), "gz": gw + at.push * (gw - s["gx"]), "c": s["c"]}
        out["w"] = self.moved(out, then)["w"]
        return out

    def sums(self, s: dict, gw: np.ndarray, at: Numbers) -> dict:
        """Scalar products: of the move from z and its image, of the change of x, and of v - d (A v - y = A (v - d) - eps b)."""
        m = self.moved(s, at)
        e, h, q = m["w"] - s["z"], m["w"] - s["x"], s["z"] - m["d"]
        return {"ee": e @ e, "ege": e @ (gw - s["gz"]), "hh": h @ h, "xx": s["x"] @ s["x"], "qgq": q @ (s["gz"] - m["gd"]), "cq": s["c"] @ q}


def admm_scalars(beta: float, momentum: bool) -> Iterator[tuple[float, float, float]]:
    """(weight of A^T b, momentum, eps) of one iteration after another: they depend on no data."""
    gamma = eps = 0.0
    t = 1.0
    while True:
        gamma -= beta * eps
        eps = (1.0 + gamma) / (1.0 + beta)
        before, t = t, 0.5 * (1.0 + math.sqrt(1.0 + 4.0 * t * t))
        yield gamma / beta - eps, (before - 1.0) / t if momentum else 0.0, eps


def too_far(sums, u: float) -> bool:
    """The drawback test: the move from v fails ||A e||^2 <= ||e||^2 / (2 u)."""
    return sums["ee"] != 0.0 and sums["ege"] > sums["ee"] / (2.0 * u)


def stops(sums, eps: float, bb: float) -> dict:
    """Norms of the primal residual A v - y and of the change of x, without a pass over the rows."""
    return {"primal": math.sqrt(max(0.0, sums["qgq"] - 2.0 * eps * sums["cq"] + eps * eps * bb)), "change": math.sqrt(max(0.0, sums["hh"]))}


def within(norms: dict, sums, bb: float, tol: float) -> bool:
    return tol > 0 and norms["primal"] <= tol * math.sqrt(bb) and norms["change"] <= tol * max(math.sqrt(sums["xx"]), 1.0)


def admm(op, lam: float, penalty: str = "l1", beta: float = 0.1, u: float = 1e-4, maxit: int = 100,
         tol: float = 0.0, momentum: bool = False, line_search: bool = False, shrink: float = 2.0,
         max_trials: int = 20, x0: np.ndarray | None = None, track: bool = False) -> SolverResult:
    """V3, V5, V7: linearized ADMM for min 1/2||y - b||^2 + lambda R(x)  s.t.  A x = y, from p = y = 0.

    p += beta (A v - y);  y = (beta A v + b + p) / (1 + beta);
    x = prox(v - u A^T (A v - y + p/beta), lambda u / beta)
    where v = x (plain) or the FISTA-extrapolated z (``momentum``).  ``line_search`` adds the
    step drawback (u /= shrink until ||A e||^2 <= ||e||^2/(2u), e = x - v; u doubled every
    10th iteration).  With ``tol`` it stops once ||A v - y|| <= tol ||b|| and ||x - x_old|| <= tol max(||x_old||, 1).
    The column layout's form is :func:`proxlab.operators.blocks.admm`.
    """
    updates = Updates(check_penalty(penalty), lam, beta)
    ahead = admm_scalars(beta, momentum)
    weight, push, eps = next(ahead)
    at = Numbers(u, weight, push)
    x0 = None if x0 is None else np.asarray(x0, float)
    state = updates.begin(np.asarray(op.c, float), at, x0, None if x0 is None else op.gv(x0))
    hist = []
    k = 0
    for k in range(1, maxit + 1):
        weight, push, eps_next = next(ahead)
        trials = 0
        while True:
            gw = op.gv(state["w"])
            sums = updates.sums(state, gw, at)
            if not line_search or not too_far(sums, u):
                break
            u /= shrink
            trials += 1
            if trials >= max_trials:
                break
            at = Numbers(u, at.weight, at.push)
            state["w"] = updates.moved(state, at)["w"]
        if line_search and k % 10 == 0:
            u *= 2.0
        then = Numbers(u, weight, push)
        state = updates.settled(state, gw, at, then)
        norms = stops(sums, eps, op.bb)
        entry = _progress(op, k, state["x"], state["gx"], lam, penalty, u) if track else {"iter": k, "step": u, "objective": None, "rel_residual": None}
        hist.append({**entry, **norms})
        at, eps = then, eps_next
        if within(norms, sums, op.bb, tol):
            break
    return SolverResult(state["x"], state["z"], u, k, hist, op.passes, op)
