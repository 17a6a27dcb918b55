"""DuckDB twins of the exponential-smoothing job (oracle side only).

The expressions mirror ``civicflow.operators.forecast`` operation for operation
(same grid arithmetic, same fold, same closed-form solve) so both engines
produce the same doubles; ties are broken the same way.
"""

from __future__ import annotations

from civicflow.operators import smoothing as FC
from civicflow.functions.draws import draw_sql
from civicflow.operators.forecast import BOOT_SEED, HORIZON, N_BOOT


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def trend_fold(ys: str = "ys") -> str:
    fz = "(acc.lz + phi * acc.bz)"
    fu = "(acc.lu + phi * acc.bu)"
    fv = "(acc.lv + phi * acc.bv)"
    e0 = f"(y - {fz})"
    ab = "(alpha * beta)"
    body = ", ".join([
        f"'lz': {fz} + alpha * {e0}",
        f"'bz': phi * acc.bz + {ab} * {e0}",
        f"'lu': {fu} - alpha * {fu}",
        f"'bu': phi * acc.bu - {ab} * {fu}",
        f"'lv': {fv} - alpha * {fv}",
        f"'bv': phi * acc.bv - {ab} * {fv}",
        f"'see': acc.see + {e0} * {e0}",
        f"'sef1': acc.sef1 + {e0} * {fu}",
        f"'sef2': acc.sef2 + {e0} * {fv}",
        f"'sf11': acc.sf11 + {fu} * {fu}",
        f"'sf12': acc.sf12 + {fu} * {fv}",
        f"'sf22': acc.sf22 + {fv} * {fv}",
    ])
    z, one = _d(0.0), _d(1.0)
    init = (
        f"{{'lz': {z}, 'bz': {z}, 'lu': {one}, 'bu': {z}, 'lv': {z}, 'bv': {one}, "
        f"'see': {z}, 'sef1': {z}, 'sef2': {z}, 'sf11': {z}, 'sf12': {z}, 'sf22': {z}}}"
    )
    return f"list_reduce({ys}, lambda acc, y: {{{body}}}, {init})"


def _season_step(f: str, e: str, level: str, trend: str, season: str, m: int = FC.SEASON) -> dict[str, str]:
    """One step of a seasonal trajectory in the accumulator (season lists roll left)."""
    return {
        level: f"acc.{level} + acc.{trend} + alpha * {e}",
        trend: f"acc.{trend} + (alpha * beta) * {e}",
        season: f"list_concat(list_slice(acc.{season}, 2, {m}), [acc.{season}[1] + gamma * {e}])",
        f: f"list_append(acc.{f}, acc.{level} + acc.{trend} + acc.{season}[1])",
    }


def _struct(fields: dict[str, str]) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def seasonal_evaluated(grid: str, m: int = FC.SEASON) -> str:
    """``grid`` with least-squares initial states, sse, aic and end state of the seasonal model.

    The responses to a zero start, a unit level, a unit trend and a unit first season are
    folded; the other seasons' responses are shifts of the last. The normal equations of level,
    trend and m - 1 seasons (the last is minus their sum) are eliminated column by column."""
    one, z = _d(1.0), _d(0.0)
    zeros = f"list_transform(range(0, {m}), lambda i: {z})"
    unit = f"list_concat([{one}], list_transform(range(1, {m}), lambda i: {z}))"
    nothing = "CAST([] AS DOUBLE[])"
    init, body = {}, {}
    for name, level, trend, season in (("z", z, z, zeros), ("u", one, z, zeros), ("v", z, one, zeros), ("w", z, z, unit)):
        f = f"(acc.l{name} + acc.b{name} + acc.s{name}[1])"
        init |= {f"l{name}": level, f"b{name}": trend, f"s{name}": season, f"f{name}": nothing}
        body |= _season_step(f"f{name}", f"(y - {f})" if name == "z" else f"(-{f})", f"l{name}", f"b{name}", f"s{name}")
    last, rhs, free = m + 2, m + 3, m + 1  # last season, right-hand side, unknowns
    column = "CASE WHEN {0} = 1 THEN fu WHEN {0} = 2 THEN fv WHEN {0} = " + str(rhs) + " THEN e0 ELSE fw END"
    shift = "(CASE WHEN {0} BETWEEN 3 AND " + str(last) + " THEN {0} - 3 ELSE 0 END)"
    si, sj = shift.format("i"), shift.format("j")
    ci, cj = column.format("i"), column.format("j")
    over = f"greatest({si}, {sj})"
    f = "(acc.l + acc.b + acc.s[1])"
    final = _struct({
        "l": f"acc.l + acc.b + alpha * (y - {f})", "b": f"acc.b + (alpha * beta) * (y - {f})",
        "s": f"list_concat(list_slice(acc.s, 2, {m}), [acc.s[1] + gamma * (y - {f})])", "sse": f"acc.sse + (y - {f}) * (y - {f})"})
    return f"""
WITH RECURSIVE g AS MATERIALIZED (SELECT row_number() OVER () AS gid, g0.* FROM ({grid}) g0),
resp AS MATERIALIZED (
  SELECT gid, n, acc.fu AS fu, acc.fv AS fv, acc.fw AS fw, list_transform(ys, lambda y, i: y - acc.fz[i]) AS e0
  FROM (SELECT gid, n, ys, list_reduce(ys, lambda acc, y: {_struct(body)}, {_struct(init)}) AS acc FROM g) r0),
raw AS MATERIALIZED (
  SELECT gid, i, list(dot ORDER BY j) AS eq FROM (
    SELECT gid, ti.i AS i, tj.j AS j,
           list_dot_product(list_slice({ci}, 1 + {over} - {si}, n - {si}), list_slice({cj}, 1 + {over} - {sj}, n - {sj})) AS dot
    FROM resp, range(1, {last + 1}) ti(i), range(1, {rhs + 1}) tj(j)) d GROUP BY gid, i),
bound AS (
  SELECT r.gid, r.i, CASE WHEN r.i < 3 THEN r.eq ELSE list_transform(r.eq, lambda x, j: x - b.eq[j]) END AS eq
  FROM raw r JOIN raw b ON r.gid = b.gid AND b.i = {last} WHERE r.i < {last}),
sys AS (
  SELECT gid, i, list_transform(range(1, {free + 2}), lambda j: (
           CASE WHEN j < 3 THEN eq[j] WHEN j = {free + 1} THEN eq[{rhs}] ELSE eq[j] - eq[{last}] END)
           * (CASE WHEN j = i THEN {_d(1.0 + FC.RIDGE)} ELSE {one} END)) AS eq FROM bound),
elim AS (
  SELECT CAST(1 AS BIGINT) AS k, gid, i, eq FROM sys
  UNION ALL
  SELECT e.k + 1, e.gid, e.i,
         CASE WHEN e.i = e.k THEN list_transform(list_slice(e.eq, 2, len(e.eq)), lambda x: x / p.eq[1])
              ELSE list_transform(list_slice(e.eq, 2, len(e.eq)), lambda x, j: x - e.eq[1] * (p.eq[j + 1] / p.eq[1])) END
  FROM elim e JOIN elim p ON e.gid = p.gid AND p.i = e.k WHERE e.k <= {free}),
x AS (SELECT gid, list(eq[1] ORDER BY i) AS x FROM elim WHERE k = {free + 1} GROUP BY gid),
start AS (
  SELECT g.*, x[1] AS l0, x[2] AS b0, list_append(list_slice(x, 3, {free}), -list_sum(list_slice(x, 3, {free}))) AS season0
  FROM g JOIN x USING (gid)),
run AS (
  SELECT *, list_reduce(ys, lambda acc, y: {final}, {{'l': l0, 'b': b0, 's': season0, 'sse': {z}}}) AS acc FROM start)
SELECT * EXCLUDE (gid, acc), greatest(acc.sse, {_d(FC.MIN_SSE)}) AS sse, acc.l AS level, acc.b AS trend, acc.s AS season,
       CAST(n AS DOUBLE) * ln(greatest(acc.sse, {_d(FC.MIN_SSE)}) / CAST(n AS DOUBLE)) + {_d(2.0)} * {FC.N_PARAMS[FC.SEASONAL]} AS aic
FROM run"""


def _solved(src: str) -> str:
    """acc of a trend model -> l0, b0, sse, level, trend, aic."""
    ridge = f"({_d(FC.RIDGE)} * (acc.sf11 + acc.sf22))"
    det = f"((acc.sf11 + {ridge}) * (acc.sf22 + {ridge}) - acc.sf12 * acc.sf12)"
    l0 = f"((acc.sef1 * (acc.sf22 + {ridge}) - acc.sef2 * acc.sf12) / {det})"
    b0 = f"(((acc.sf11 + {ridge}) * acc.sef2 - acc.sf12 * acc.sef1) / {det})"
    k = f"CASE WHEN model = '{FC.ADD}' THEN {FC.N_PARAMS[FC.ADD]} ELSE {FC.N_PARAMS[FC.DAMPED]} END"
    return f"""
SELECT * EXCLUDE (acc2), CAST(n AS DOUBLE) * ln(sse / CAST(n AS DOUBLE)) + {_d(2.0)} * ({k}) AS aic FROM (
  SELECT * EXCLUDE (acc), acc AS acc2,
         acc.lz + l0 * acc.lu + b0 * acc.lv AS level,
         acc.bz + l0 * acc.bu + b0 * acc.bv AS trend,
         CAST(NULL AS DOUBLE[]) AS season, CAST(NULL AS DOUBLE[]) AS season0
  FROM (SELECT *, {l0} AS l0, {b0} AS b0,
               greatest(acc.see - {l0} * acc.sef1 - {b0} * acc.sef2, {_d(FC.MIN_SSE)}) AS sse
        FROM {src}) s1) s2"""


def _best(src: str, keys: str) -> str:
    return f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY aic, alpha, beta, phi, gamma) AS rn FROM ({src}) b0)
WHERE rn = 1"""


def fit_sql(arrays: str, only: str | None = None, seasonal: bool = True) -> str:
    """SQL of ``fit_models`` over a relation ``arrays`` (series_id, first_week, last_week, n, ys)."""
    per_model = FC.N_ALPHA * FC.N_BETA
    n_coarse = per_model * (1 + FC.N_PHI)
    keep = (lambda g: g) if only is None else (
        lambda g: f"SELECT * FROM ({g}) kg WHERE (series_id, model) IN (SELECT series_id, model FROM ({only}) o)"
    )
    pidx = f"(gid // {per_model})"
    pair = f"(gid % {per_model})"
    coarse_grid = f"""
SELECT * FROM (
  SELECT a.*, CASE WHEN {pidx} = 0 THEN '{FC.ADD}' ELSE '{FC.DAMPED}' END AS model,
         CAST(floor({pair} / {FC.N_BETA}) + 1 AS DOUBLE) * {_d(FC.COARSE_STEP)} AS alpha,
         CAST({pair} % {FC.N_BETA} AS DOUBLE) * {_d(FC.COARSE_STEP)} AS beta,
         CASE WHEN {pidx} = 0 THEN {_d(1.0)}
              ELSE {_d(FC.PHI_LO)} + CAST({pidx} - 1 AS DOUBLE) * {_d(FC.PHI_STEP)} END AS phi,
         {_d(0.0)} AS gamma
  FROM {arrays} a, range(0, {n_coarse}) t(gid)) g WHERE beta <= alpha"""

    def ev(g: str) -> str:
        return _solved(f"(SELECT *, {trend_fold()} AS acc FROM ({g}) gg)")

    coarse = _best(ev(keep(coarse_grid)), "series_id, model")
    w = 2 * FC.FINE_HALF + 1
    pw = 2 * FC.PHI_FINE_HALF + 1
    fine_grid = f"""
SELECT DISTINCT * FROM (
  SELECT series_id, first_week, last_week, n, ys, model,
         alpha + CAST(floor(gid / {w * pw}) - {FC.FINE_HALF} AS DOUBLE) * {_d(FC.FINE_STEP)} AS alpha,
         beta + CAST(floor((gid % {w * pw}) / {pw}) - {FC.FINE_HALF} AS DOUBLE) * {_d(FC.FINE_STEP)} AS beta,
         CASE WHEN model = '{FC.DAMPED}'
              THEN phi + CAST((gid % {pw}) - {FC.PHI_FINE_HALF} AS DOUBLE) * {_d(FC.PHI_FINE_STEP)}
              ELSE {_d(1.0)} END AS phi,
         {_d(0.0)} AS gamma
  FROM ({coarse}) c, range(0, {w * w * pw}) t(gid)) f
WHERE alpha > {_d(0.0)} AND alpha < {_d(1.0)} AND beta >= {_d(0.0)} AND beta <= alpha
  AND (model <> '{FC.DAMPED}' OR (phi >= {_d(FC.PHI_LO)} AND phi <= {_d(FC.PHI_MAX)}))"""
    best = _best(ev(fine_grid), "series_id, model")
    if not seasonal:
        return best
    nb, ng = len(FC.S_BETAS), len(FC.S_GAMMAS)
    betas = "[" + ", ".join(_d(b) for b in FC.S_BETAS) + "]"
    gammas = "[" + ", ".join(_d(x) for x in FC.S_GAMMAS) + "]"
    s_grid = f"""
SELECT * FROM (
  SELECT a.*, '{FC.SEASONAL}' AS model,
         CAST(floor(gid / {nb * ng}) + 1 AS DOUBLE) * {_d(FC.S_ALPHA_STEP)} AS alpha,
         {betas}[CAST(floor((gid % {nb * ng}) / {ng}) + 1 AS INTEGER)] AS beta,
         {_d(1.0)} AS phi,
         {gammas}[CAST((gid % {ng}) + 1 AS INTEGER)] AS gamma
  FROM {arrays} a, range(0, {FC.S_N_ALPHA * nb * ng}) t(gid) WHERE a.n >= {2 * FC.SEASON}) g
WHERE beta <= alpha AND gamma <= {_d(1.0)} - alpha"""
    s_best = _best(seasonal_evaluated(keep(s_grid)), "series_id, model")
    for step in FC.S_ROUNDS:
        near = f"""
SELECT * FROM (
  SELECT series_id, first_week, last_week, n, ys, model,
         alpha + CAST(gid // 9 - 1 AS DOUBLE) * {_d(step)} AS alpha, beta + CAST(gid // 3 % 3 - 1 AS DOUBLE) * {_d(step)} AS beta,
         {_d(1.0)} AS phi, gamma + CAST(gid % 3 - 1 AS DOUBLE) * {_d(step)} AS gamma
  FROM ({s_best}) c, range(0, 27) t(gid)) f
WHERE alpha > {_d(0.0)} AND alpha < {_d(1.0)} AND beta >= {_d(0.0)} AND beta <= alpha AND gamma >= {_d(0.0)} AND gamma <= {_d(1.0)} - alpha"""
        s_best = _best(seasonal_evaluated(near), "series_id, model")
    return f"SELECT * FROM ({best}) tb UNION ALL BY NAME SELECT * FROM ({s_best}) sb"


def select_sql(fits: str) -> str:
    return _best(fits, "series_id")


def forecast_sql(rows: str, horizon: int = HORIZON) -> str:
    one = _d(1.0)
    damp = (
        f"CASE WHEN phi = {one} THEN CAST(h AS DOUBLE) "
        f"ELSE phi * ({one} - pow(phi, h)) / ({one} - phi) END"
    )
    seas = f"CASE WHEN season IS NOT NULL THEN season[CAST((h - 1) % len(season) + 1 AS INTEGER)] ELSE {_d(0.0)} END"
    return f"""
SELECT series_id, model, CAST(h AS INTEGER) AS h, CAST(last_week + INTERVAL (h * 7) DAY AS DATE) AS week_start,
       level + ({damp}) * trend + ({seas}) AS forecast
FROM ({rows}) r, range(1, {horizon + 1}) t(h)"""


def residuals_sql(rows: str, m: int = FC.SEASON) -> str:
    """Twin of ``fitted_residuals``: one-step errors of the chosen model, as a list."""
    one, z = _d(1.0), _d(0.0)
    init_s = f"CASE WHEN model = '{FC.SEASONAL}' THEN season0 ELSE list_transform(range(0, {m}), lambda i: {z}) END"
    seas = f"CASE WHEN model = '{FC.SEASONAL}' THEN acc.s[1] ELSE {z} END"
    t = "(acc.l + phi * acc.b)"
    e = f"(y - ({t} + {seas}))"
    roll = (f"CASE WHEN model = '{FC.SEASONAL}' THEN list_concat(list_slice(acc.s, 2, {m}), [{seas} + gamma * {e}]) "
            f"ELSE acc.s END")
    body = (f"'l': {t} + alpha * {e}, 'b': phi * acc.b + (alpha * beta) * {e}, 's': {roll}, "
            f"'res': list_concat(acc.res, [{e}])")
    init = f"{{'l': l0, 'b': b0, 's': {init_s}, 'res': CAST([] AS DOUBLE[])}}"
    return f"SELECT series_id, model, list_reduce(ys, lambda acc, y: {{{body}}}, {init}).res AS residuals FROM ({rows}) r"


def bootstrap_sql(forecasts: str, residuals: str, cumulative: bool = True, n_boot: int = N_BOOT, seed: int = BOOT_SEED) -> str:
    """Twin of ``bootstrap_intervals`` over (series_id, model, h, week_start, forecast) and (series_id, model, residuals)."""
    if cumulative:
        pick = f"residuals[{draw_sql(seed, 'series_id', 'path', 'h')} % len(residuals) + 1]"
        noise = f"sum({pick}) OVER (PARTITION BY series_id, path ORDER BY h ROWS UNBOUNDED PRECEDING)"
    else:
        pick = f"residuals[{draw_sql(seed, 'series_id', 'path', 'h * 1000 + j')} % len(residuals) + 1]"
        noise = f"list_reduce(list_transform(range(1, h + 1), lambda j: {pick}), lambda a, x: a + x, {_d(0.0)})"
    q = {p: f"round(quantile_cont(sim, {p}), 1)" for p in (0.025, 0.1, 0.9, 0.975)}
    return f"""
SELECT series_id, model, h, week_start, round(forecast, 1) + {_d(0.0)} AS forecast,
       greatest({q[0.1]} + {_d(0.0)}, {_d(0.0)}) AS lo_80, {q[0.9]} + {_d(0.0)} AS hi_80, greatest({q[0.025]} + {_d(0.0)}, {_d(0.0)}) AS lo_95, {q[0.975]} + {_d(0.0)} AS hi_95
FROM (SELECT *, forecast + {noise} AS sim
      FROM (SELECT * FROM ({forecasts}) f JOIN ({residuals}) r USING (series_id, model)) fr, range(1, {n_boot + 1}) t(path) WHERE len(residuals) > 0) s
GROUP BY series_id, model, h, week_start, forecast"""
