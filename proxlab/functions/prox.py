"""Proximal scalar maps (soft, half, l2) as Spark Column expressions and numpy kernels.

All three take a value x and a threshold t and are applied elementwise.  The
Column forms stay inside whole-stage codegen; the numpy forms are used for the
n-dimensional driver updates of the iterative solvers.  Both forms are the same
formula, so a solver's result does not depend on where its update ran.

Scale note for ``half``: it is the exact minimizer of (x - v)^2 + t*|x|^(1/2)
(not of 1/2 (x - v)^2 + ...), so with the 1/2||Ax - b||^2 data term the solved
penalty is (lambda/2) * sum |x_j|^(1/2).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the half-thresholding formula (the L1/2 closed form):
#   cut-off   = 54^(1/3) / 4 * t^(2/3)
#   phi       = arccos(t / 8 * (|x| / 3)^(-3/2))
#   result    = 2/3 * x * (1 + cos(2/3 * (pi - phi)))
HALF_CUT_BASE = 54.0
HALF_CUT_DIV = 4.0
HALF_PHI_DIV = 8.0
HALF_ABS_DIV = 3.0
HALF_ABS_POW = -1.5

PENALTIES = ("l1", "l2", "l_half")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def soft_col(x, t) -> Column:
    x, t = _col(x), _col(t)
    return F.when(F.abs(x) > t, F.signum(x) * (F.abs(x) - t)).otherwise(F.lit(0.0))


def half_cutoff(t: float) -> float:
    return HALF_CUT_BASE ** (1.0 / 3.0) / HALF_CUT_DIV * t ** (2.0 / 3.0)


def half_col(x, t) -> Column:
    x, t = _col(x), _col(t)
    cut = F.pow(F.lit(HALF_CUT_BASE), F.lit(1.0 / 3.0)) / HALF_CUT_DIV * F.pow(t, F.lit(2.0 / 3.0))
    phi = F.acos(t / HALF_PHI_DIV * F.pow(F.abs(x) / HALF_ABS_DIV, F.lit(HALF_ABS_POW)))
    val = F.lit(2.0 / 3.0) * x * (F.lit(1.0) + F.cos(F.lit(2.0 / 3.0) * (F.lit(math.pi) - phi)))
    return F.when(F.abs(x) > cut, val).otherwise(F.lit(0.0))


def l2_col(x, t) -> Column:
    x, t = _col(x), _col(t)
    return x / (F.lit(1.0) + t)


def prox_col(penalty: str, x, t) -> Column:
    return {"l1": soft_col, "l2": l2_col, "l_half": half_col}[check_penalty(penalty)](x, t)


def check_penalty(penalty: str) -> str:
    if penalty not in PENALTIES:
        raise ValueError(f"unknown penalty {penalty!r}; expected one of {PENALTIES}")
    return penalty


def soft_np(x: np.ndarray, t: float) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    return np.where(np.abs(x) > t, np.sign(x) * (np.abs(x) - t), 0.0)


def half_np(x: np.ndarray, t: float) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    cut = half_cutoff(t)
    ax = np.abs(x)
    out = np.zeros_like(x)
    m = ax > cut
    if np.any(m):
        phi = np.arccos(t / HALF_PHI_DIV * np.power(ax[m] / HALF_ABS_DIV, HALF_ABS_POW))
        out[m] = 2.0 / 3.0 * x[m] * (1.0 + np.cos(2.0 / 3.0 * (math.pi - phi)))
    return out


def l2_np(x: np.ndarray, t: float) -> np.ndarray:
    return np.asarray(x, dtype=float) / (1.0 + t)


def prox_np(penalty: str, x: np.ndarray, t: float) -> np.ndarray:
    return {"l1": soft_np, "l2": l2_np, "l_half": half_np}[check_penalty(penalty)](x, t)
