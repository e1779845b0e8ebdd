"""SQL text for the DuckDB oracle of the iterative solvers.

The oracle repeats the solver updates in a recursive CTE over the moments
(G = A^T A, c = A^T b, b.b, m, trace) of the same design matrix, so a Spark solver result
can be compared with an engine-independent computation.  Only fixed-step variants are
expressible this way; line searches are checked by tests instead.
"""

from __future__ import annotations

import math

from ..functions.prox import HALF_ABS_DIV, HALF_ABS_POW, HALF_CUT_BASE, HALF_CUT_DIV, HALF_PHI_DIV


def d(v: float) -> str:
    """A DOUBLE literal (DuckDB reads bare 0.5 as DECIMAL)."""
    if math.isinf(v):
        return "CAST('inf' AS DOUBLE)" if v > 0 else "CAST('-inf' AS DOUBLE)"
    return f"CAST({float(v)!r} AS DOUBLE)"


def rnd(expr: str, digits: int = 6) -> str:
    """Round and normalize -0.0 to 0.0 (mirrors registry.rnd on the Spark side)."""
    r = f"round({expr}, {digits})"
    return f"(CASE WHEN {r} = 0 THEN {d(0.0)} ELSE {r} END)"


def g(i: int, j: int) -> str:
    return f"g_{min(i, j)}_{max(i, j)}"


def moments_cte(n: int, src: str = "A") -> str:
    gs = [f"sum(f{i} * f{j}) AS g_{i}_{j}" for i in range(n) for j in range(i, n)]
    cs = [f"sum(f{j} * label) AS c_{j}" for j in range(n)]
    tr = " + ".join(f"f{j} * f{j}" for j in range(n))
    return (f"P AS (SELECT {', '.join(gs + cs)}, sum(label * label) AS bb, count(*) AS m, "
            f"sum({d(0.0)} + {tr}) AS tr FROM {src})")


def gv(n: int, j: int, v: str) -> str:
    """(G v)_j with v given as column prefix (v0, v1, ...)."""
    return "(" + " + ".join(f"{g(j, i)} * {v}{i}" for i in range(n)) + ")"


def prox_sql(penalty: str, v: str, t: str) -> str:
    if penalty == "l1":
        return f"(CASE WHEN abs({v}) > {t} THEN sign({v}) * (abs({v}) - {t}) ELSE {d(0.0)} END)"
    if penalty == "l2":
        return f"({v} / ({d(1.0)} + {t}))"
    if penalty == "l_half":
        cut = f"(pow({d(HALF_CUT_BASE)}, {d(1.0 / 3.0)}) / {d(HALF_CUT_DIV)} * pow({t}, {d(2.0 / 3.0)}))"
        phi = f"acos({t} / {d(HALF_PHI_DIV)} * pow(abs({v}) / {d(HALF_ABS_DIV)}, {d(HALF_ABS_POW)}))"
        val = f"({d(2.0 / 3.0)} * {v} * ({d(1.0)} + cos({d(2.0 / 3.0)} * ({d(math.pi)} - {phi}))))"
        return f"(CASE WHEN abs({v}) > {cut} THEN {val} ELSE {d(0.0)} END)"
    raise ValueError(penalty)


def _cols(prefix: str, n: int) -> str:
    return ", ".join(f"{prefix}{j}" for j in range(n))


def _zeros(prefix: str, n: int) -> str:
    return ", ".join(f"{d(0.0)} AS {prefix}{j}" for j in range(n))


def _unpivot(n: int, src: str, cols: dict[str, str]) -> str:
    """n rows [feat_id, <name> = rnd(<prefix>j) ...] from the one-row ``src``."""
    parts = []
    for j in range(n):
        sel = ", ".join(f"{rnd(f'{p}{j}')} AS {name}" for name, p in cols.items())
        parts.append(f"SELECT CAST({j} AS INTEGER) AS feat_id, {sel} FROM {src}")
    return " UNION ALL ".join(parts)


def fista_sql(design: str, n: int, penalty: str, lam: str, step: str, maxit: int,
              history: bool = False, tail: str | None = None) -> str:
    """Fixed-step FISTA (``line_search=False``); ``lam``/``step`` are SQL over P's columns."""
    v = ", ".join(f"z{j} - s * ({gv(n, j, 'z')} - c_{j}) AS v{j}" for j in range(n))
    gz = ", ".join(f"{gv(n, j, 'z')} AS gz{j}" for j in range(n))
    nx = ", ".join(f"{prox_sql(penalty, f'v{j}', 'lam * s')} AS nx{j}" for j in range(n))
    newz = ", ".join(f"nx{j} + (t - {d(1.0)}) / tn * (nx{j} - x{j}) AS z{j}" for j in range(n))
    newx = ", ".join(f"nx{j} AS x{j}" for j in range(n))
    sql = f"""WITH RECURSIVE A AS ({design}), {moments_cte(n)},
Q AS (SELECT *, {step} AS s, {lam} AS lam FROM P),
it AS (
  SELECT 0 AS k, {_zeros('x', n)}, {_zeros('z', n)}, {d(1.0)} AS t
  UNION ALL
  SELECT k + 1 AS k, {newx}, {newz}, tn AS t FROM (
    SELECT k, t, tn, {_cols('x', n)}, {nx}, s, lam FROM (
      SELECT it.*, Q.s, Q.lam, {v},
             {d(0.5)} * ({d(1.0)} + sqrt({d(1.0)} + {d(4.0)} * t * t)) AS tn
      FROM it, Q WHERE it.k < {maxit}) q1) q2)"""
    if tail is not None:
        return sql + "\n" + tail.replace("{FINAL}", f"(SELECT * FROM it WHERE k = {maxit})")
    if not history:
        return sql + f"\n{_unpivot(n, f'(SELECT * FROM it WHERE k = {maxit})', {'weight': 'x', 'extrapolated': 'z'})}"
    pen = _penalty_sql(penalty, "z", n)
    zgz = " + ".join(f"z{j} * gz{j}" for j in range(n))
    cz = " + ".join(f"({d(2.0)} * c_{j}) * z{j}" for j in range(n))
    return sql + f""",
H AS (SELECT k, lam, bb, greatest(({zgz}) - ({cz}) + bb, {d(0.0)}) AS r2, {pen} AS pen
      FROM (SELECT it.*, Q.lam, Q.bb, {_cols_from_q(n)}, {gz} FROM it, Q WHERE it.k < {maxit}) h0)
SELECT CAST(k + 1 AS INTEGER) AS iter, {rnd(f'{d(0.5)} * r2 + lam * pen')} AS objective,
       {rnd('sqrt(r2 / bb)')} AS rel_residual FROM H"""


def _cols_from_q(n: int) -> str:
    gs = [f"Q.g_{i}_{j}" for i in range(n) for j in range(i, n)]
    cs = [f"Q.c_{j}" for j in range(n)]
    return ", ".join(gs + cs)


def _penalty_sql(penalty: str, p: str, n: int) -> str:
    if penalty == "l1":
        return "(" + " + ".join(f"abs({p}{j})" for j in range(n)) + ")"
    if penalty == "l2":
        return f"({d(0.5)} * (" + " + ".join(f"{p}{j} * {p}{j}" for j in range(n)) + "))"
    return f"({d(0.5)} * (" + " + ".join(f"sqrt(abs({p}{j}))" for j in range(n)) + "))"


def apg_sql(design: str, n: int, penalty: str, lam: str, step: str, alpha: float, maxit: int) -> str:
    """V2 with fixed ``step`` (SQL over P), theta-sequence and gradient restart."""
    y = ", ".join(f"({d(1.0)} - th) * x{j} + th * z{j} AS y{j}" for j in range(n))
    gr = ", ".join(f"{gv(n, j, 'y')} - c_{j} AS gr{j}" for j in range(n))
    zc = ", ".join(f"{prox_sql(penalty, f'(z{j} - s * gr{j})', 'lam * s')} AS zc{j}" for j in range(n))
    xn = ", ".join(f"({d(1.0)} - th) * x{j} + th * {prox_sql(penalty, f'(z{j} - s * gr{j})', 'lam * s')} AS xn{j}"
                   for j in range(n))
    dot = " + ".join(f"gr{j} * (xn{j} - x{j})" for j in range(n))
    outx = ", ".join(f"xn{j} AS x{j}" for j in range(n))
    outz = ", ".join(f"CASE WHEN ({dot}) > {d(0.0)} THEN xn{j} ELSE zc{j} END AS z{j}" for j in range(n))
    return f"""WITH RECURSIVE A AS ({design}), {moments_cte(n)},
Q AS (SELECT *, {step} AS s, {lam} AS lam FROM P),
it AS (
  SELECT 0 AS k, {_zeros('x', n)}, {_zeros('z', n)}, {d(1.0)} AS L, {d(math.inf)} AS th
  UNION ALL
  SELECT k + 1 AS k, {outx}, {outz}, Ln AS L, th FROM (
    SELECT *, {zc}, {xn} FROM (
      SELECT *, {gr} FROM (
        SELECT *, {y} FROM (
          SELECT it.k, {_cols('x', n)}, {_cols('z', n)}, it.L * {d(alpha)} AS Ln,
                 {d(2.0)} / ({d(1.0)} + sqrt({d(1.0)} + {d(4.0)} * ((it.L * {d(alpha)}) / it.L) / (it.th * it.th))) AS th,
                 {_cols_from_q(n)}, Q.s, Q.lam
          FROM it, Q WHERE it.k < {maxit}) q1) q2) q3) q4)
{_unpivot(n, f'(SELECT * FROM it WHERE k = {maxit})', {'weight': 'x', 'extrapolated': 'z'})}"""


def admm_sql(design: str, n: int, penalty: str, lam: str, beta: float, u: str, maxit: int,
             momentum: bool) -> str:
    """V3/V5 (rows) and V4/V6 (cols) -- same numbers -- with the (a, gamma, d, eps) state."""
    B = d(beta)
    v = ", ".join(f"{'z' if momentum else 'x'}{j} AS v{j}" for j in range(n))
    an = ", ".join(f"a{j} + {B} * (v{j} - dd{j}) AS an{j}" for j in range(n))
    dn = ", ".join(f"({B} * v{j} + (a{j} + {B} * (v{j} - dd{j}))) / ({d(1.0)} + {B}) AS dn{j}" for j in range(n))
    w = ", ".join(f"v{j} - dn{j} + an{j} / {B} AS w{j}" for j in range(n))
    gr = ", ".join(f"{gv(n, j, 'w')} + (gn / {B} - en) * c_{j} AS gr{j}" for j in range(n))
    xn = ", ".join(f"{prox_sql(penalty, f'(v{j} - u * gr{j})', f'(lam * u / {B})')} AS xn{j}"
                   for j in range(n))
    outx = ", ".join(f"xn{j} AS x{j}" for j in range(n))
    if momentum:
        outz = ", ".join(f"xn{j} + (t - {d(1.0)}) / tn * (xn{j} - x{j}) AS z{j}" for j in range(n))
    else:
        outz = ", ".join(f"xn{j} AS z{j}" for j in range(n))
    outa = ", ".join(f"an{j} AS a{j}" for j in range(n))
    outd = ", ".join(f"dn{j} AS dd{j}" for j in range(n))
    return f"""WITH RECURSIVE A AS ({design}), {moments_cte(n)},
Q AS (SELECT *, {lam} AS lam, {u} AS u FROM P),
it AS (
  SELECT 0 AS k, {_zeros('x', n)}, {_zeros('z', n)}, {_zeros('a', n)}, {_zeros('dd', n)},
         {d(0.0)} AS gm, {d(0.0)} AS ep, {d(1.0)} AS t
  UNION ALL
  SELECT k + 1 AS k, {outx}, {outz}, {outa}, {outd}, gn AS gm, en AS ep, tn AS t FROM (
    SELECT *, {xn} FROM (
      SELECT *, {gr} FROM (
        SELECT *, {w} FROM (
          SELECT *, {an}, {dn}, gm - {B} * ep AS gn, ({d(1.0)} + (gm - {B} * ep)) / ({d(1.0)} + {B}) AS en,
                 {d(0.5)} * ({d(1.0)} + sqrt({d(1.0)} + {d(4.0)} * t * t)) AS tn FROM (
            SELECT it.*, {v}, {_cols_from_q(n)}, Q.lam, Q.u FROM it, Q WHERE it.k < {maxit}) q0) q1) q2) q3) q4)
{_unpivot(n, f'(SELECT * FROM it WHERE k = {maxit})', {'weight': 'x', 'extrapolated': 'z'})}"""


# ---------------------------------------------------------------- line searches, on lists

def list_design(design: str, n: int) -> str:
    """A design of scalar columns f0.. as one of [f: DOUBLE[], label]."""
    return f"SELECT [{_cols('f', n)}] AS f, label FROM ({design}) q"


def list_moments_cte(n: int) -> str:
    """P: G (list of rows), c, bb, m, tr of A = [f, label]."""
    return f"""P AS MATERIALIZED (SELECT
  (SELECT list(r ORDER BY i) FROM (SELECT i, list(s ORDER BY j) AS r FROM (
     SELECT i, j, sum(f[i] * f[j]) AS s FROM A, range(1, {n + 1}) a(i), range(1, {n + 1}) b(j) GROUP BY i, j) q GROUP BY i) q2) AS G,
  (SELECT list(s ORDER BY j) FROM (SELECT j, sum(f[j] * label) AS s FROM A, range(1, {n + 1}) b(j) GROUP BY j) q) AS c,
  sum(label * label) AS bb, count(*) AS m, sum(list_dot_product(f, f)) AS tr FROM A)"""


def each(n: int, expr: str) -> str:
    """List of ``expr`` over i = 1 .. n."""
    return f"list_transform(range(1, {n + 1}), lambda i: {expr})"


def image(v: str) -> str:
    """G v of a list."""
    return f"list_transform(G, lambda r: list_dot_product(r, {v}))"


def _accepted(step: str, dd: str = "dd", dgd: str = "dgd") -> str:
    return f"({dd} = {d(0.0)} OR {dgd} <= {dd} / ({d(2.0)} * {step}))"


def _trial_end(step: str, shrink: float, max_trials: int) -> str:
    """ok, the step and number of trials after this one, and whether the iteration ends: columns of a trial."""
    ok = _accepted(step)
    return (f"CASE WHEN {ok} THEN {step} ELSE {step} / {d(shrink)} END AS s1, CASE WHEN {ok} THEN trials ELSE trials + 1 END AS trials1, "
            f"({ok} OR trials + 1 >= {max_trials}) AS done")


def _lists_out(n: int, src: str, cols: dict[str, str]) -> str:
    sel = ", ".join(f"{rnd(f'{p}[i]')} AS {name}" for name, p in cols.items())
    return f"SELECT CAST(i - 1 AS INTEGER) AS feat_id, {sel} FROM {src} f, range(1, {n + 1}) r(i)"


def fista_search_sql(design: str, n: int, penalty: str, lam: str, maxit: int, step: float = 1.0, shrink: float = 2.0, max_trials: int = 20) -> str:
    """FISTA with backtracking, one recursion step per trial; ``design`` gives [f: list, label]."""
    zero = each(n, d(0.0))
    return f"""WITH RECURSIVE A AS ({design}), {list_moments_cte(n)},
Q AS MATERIALIZED (SELECT *, {lam} AS lam FROM P),
it AS (
  SELECT 0 AS k, 0 AS trials, {d(step)} AS s, {d(1.0)} AS t, {zero} AS x, {zero} AS z
  UNION ALL
  SELECT CASE WHEN done THEN k + 1 ELSE k END AS k, CASE WHEN done THEN 0 ELSE trials1 END AS trials,
         CASE WHEN done AND (k + 1) % 10 = 0 THEN s1 * {d(2.0)} ELSE s1 END AS s,
         CASE WHEN done THEN tn ELSE t END AS t, CASE WHEN done THEN nx ELSE x END AS x,
         CASE WHEN done THEN {each(n, f'nx[i] + (t - {d(1.0)}) / tn * (nx[i] - x[i])')} ELSE z END AS z
  FROM (SELECT *, {_trial_end('s', shrink, max_trials)} FROM (
    SELECT *, list_dot_product(e, e) AS dd, list_dot_product(e, {image('e')}) AS dgd FROM (
      SELECT *, {each(n, 'nx[i] - z[i]')} AS e FROM (
        SELECT *, {each(n, prox_sql(penalty, 'v[i]', '(lam * s)'))} AS nx FROM (
          SELECT *, {each(n, 'z[i] - s * (gz[i] - c[i])')} AS v FROM (
            SELECT it.*, Q.G, Q.c, Q.lam, {image('z')} AS gz, {d(0.5)} * ({d(1.0)} + sqrt({d(1.0)} + {d(4.0)} * t * t)) AS tn
            FROM it, Q WHERE it.k < {maxit}) q1) q2) q3) q4) q5) q6)
{_lists_out(n, f'(SELECT * FROM it WHERE k = {maxit})', {'weight': 'x', 'extrapolated': 'z'})}"""


def admm_search_sql(design: str, n: int, penalty: str, lam: str, beta: float, u: str, maxit: int, shrink: float = 2.0, max_trials: int = 20) -> str:
    """ADMM with momentum and step drawback, one recursion step per trial; ``design`` gives [f: list, label]."""
    B, zero = d(beta), each(n, d(0.0))
    return f"""WITH RECURSIVE A AS ({design}), {list_moments_cte(n)},
Q AS MATERIALIZED (SELECT *, {lam} AS lam, {u} AS u0 FROM P),
it AS (
  SELECT 0 AS k, 0 AS trials, u0 AS u, {d(1.0)} AS t, {d(0.0)} AS gm, {d(0.0)} AS ep, {zero} AS x, {zero} AS z, {zero} AS a, {zero} AS dd_ FROM Q
  UNION ALL
  SELECT CASE WHEN done THEN k + 1 ELSE k END AS k, CASE WHEN done THEN 0 ELSE trials1 END AS trials,
         CASE WHEN done AND (k + 1) % 10 = 0 THEN s1 * {d(2.0)} ELSE s1 END AS u,
         CASE WHEN done THEN tn ELSE t END AS t, CASE WHEN done THEN gn ELSE gm END AS gm, CASE WHEN done THEN en ELSE ep END AS ep,
         CASE WHEN done THEN nx ELSE x END AS x,
         CASE WHEN done THEN {each(n, f'nx[i] + (t - {d(1.0)}) / tn * (nx[i] - x[i])')} ELSE z END AS z,
         CASE WHEN done THEN an ELSE a END AS a, CASE WHEN done THEN dn ELSE dd_ END AS dd_
  FROM (SELECT *, {_trial_end('u', shrink, max_trials)} FROM (
    SELECT *, list_dot_product(e, e) AS dd, list_dot_product(e, {image('e')}) AS dgd FROM (
      SELECT *, {each(n, 'nx[i] - z[i]')} AS e FROM (
        SELECT *, {each(n, prox_sql(penalty, f'(z[i] - u * (gw[i] + (gn / {B} - en) * c[i]))', f'(lam * u / {B})'))} AS nx FROM (
          SELECT *, {image('w')} AS gw FROM (
            SELECT *, {each(n, f'z[i] - dn[i] + an[i] / {B}')} AS w FROM (
              SELECT *, {each(n, f'({B} * z[i] + an[i]) / ({d(1.0)} + {B})')} AS dn, ({d(1.0)} + gn) / ({d(1.0)} + {B}) AS en FROM (
                SELECT it.*, Q.G, Q.c, Q.lam, {each(n, f'a[i] + {B} * (z[i] - dd_[i])')} AS an, gm - {B} * ep AS gn,
                       {d(0.5)} * ({d(1.0)} + sqrt({d(1.0)} + {d(4.0)} * t * t)) AS tn
                FROM it, Q WHERE it.k < {maxit}) q1) q2) q3) q4) q5) q6) q7) q8)
{_lists_out(n, f'(SELECT * FROM it WHERE k = {maxit})', {'weight': 'x', 'extrapolated': 'z'})}"""
