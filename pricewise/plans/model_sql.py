"""SQL text of logistic fits for the twins: Newton steps as plain aggregates.

Every step is a chain of materialised CTEs over one table of rows and one row per model:
probabilities at the current coefficients, sums of gradient and Hessian, Gauss-Jordan
elimination of [Hessian | gradient] by a recursive CTE over lists (the Hessian of a
penalised fit is positive definite, so no pivoting), and the next coefficients.
"""

from __future__ import annotations


def _eliminate(name: str, source: str) -> str:
    """CTE ``name(mid, beta)``: beta - H^-1 g of ``source(mid, beta, m)``, m a list of rows [H | g]."""
    return f"""{name}_e AS (
  SELECT mid, beta, 1 AS p, m FROM {source}
  UNION ALL
  SELECT mid, beta, p + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = p
      THEN list_transform(m[p], lambda v: v / m[p][p])
      ELSE list_transform(range(1, len(m) + 2), lambda c: m[i][c] - m[i][p] * m[p][c] / m[p][p]) END)
  FROM {name}_e WHERE p <= len(m)),
{name} AS MATERIALIZED (SELECT mid, list_transform(range(1, len(m) + 1), lambda i: beta[i] - m[i][len(m) + 1]) AS beta
  FROM {name}_e WHERE p = len(m) + 1)"""


def newton_over_columns(prefix: str, rows: str, models: str, cols: list[str], steps: int) -> str:
    """CTEs up to ``{prefix}{steps}(mid, beta)``: fits of columns ``cols`` (the intercept comes last).

    ``rows``: table with ``y, w, fold`` and the columns; ``models``: table with ``mid, c, fold``
    (the fold left out, NULL for none)."""
    x = [f"r.{c}" for c in cols] + ["1e0"]
    d = len(x)
    z = " + ".join(f"{v} * b.beta[{i}]" for i, v in enumerate(x, 1))
    names = [*cols, "one"]
    ctes = [f"{prefix}0 AS MATERIALIZED (SELECT mid, list_transform(range({d}), lambda i: 0e0) AS beta FROM {models})"]
    for k in range(1, steps + 1):
        keep = ", ".join(f"{v} AS {n}" for v, n in zip(x, names))
        sums = [f"sum(h * {names[i]} * {names[j]})" for i in range(d) for j in range(i, d)]
        at = {(i, j): n for n, (i, j) in enumerate((i, j) for i in range(d) for j in range(i, d))}
        lists = ", ".join("[" + ", ".join(
            [f"c * s[{at[min(i, j), max(i, j)] + 1}]" + (" + 1" if i == j and i < d - 1 else "") for j in range(d)]
            + [f"c * g[{i + 1}]" + (f" + beta[{i + 1}]" if i < d - 1 else "")]) + "]" for i in range(d))
        ctes.append(f"""{prefix}p{k} AS (
  SELECT mid, y, w, {keep}, 1 / (1 + exp(-({z}))) AS p
  FROM {prefix}{k - 1} b JOIN {models} m USING (mid) JOIN {rows} r ON m.fold IS NULL OR r.fold <> m.fold),
{prefix}s{k} AS MATERIALIZED (
  SELECT mid, [{', '.join(sums)}] AS s, [{', '.join(f'sum(w * (p - y) * {n})' for n in names)}] AS g
  FROM (SELECT *, w * p * (1 - p) AS h FROM {prefix}p{k}) GROUP BY mid),
{prefix}m{k} AS MATERIALIZED (
  SELECT mid, beta, [{lists}] AS m FROM {prefix}s{k} JOIN {prefix}{k - 1} USING (mid) JOIN {models} USING (mid))""")
        ctes.append(_eliminate(f"{prefix}{k}", f"{prefix}m{k}"))
    return ",\n".join(ctes)


def newton_over_lists(prefix: str, rows: str, c: str, steps: int) -> str:
    """CTEs up to ``{prefix}{steps}(mid, beta)``: one fit over ``rows(x, y, w)``, ``x`` a list whose
    last entry is the constant 1; its length is known to the data only."""
    d = f"(SELECT max(len(x)) FROM {rows})"
    ctes = [f"{prefix}0 AS MATERIALIZED (SELECT 0 AS mid, list_transform(range({d}), lambda i: 0e0) AS beta)"]
    for k in range(1, steps + 1):
        ctes.append(f"""{prefix}p{k} AS MATERIALIZED (
  SELECT x, y, w, 1 / (1 + exp(-list_dot_product(x, beta))) AS p FROM {rows}, {prefix}{k - 1}),
{prefix}h{k} AS MATERIALIZED (
  SELECT i, j, {c} * sum(w * p * (1 - p) * x[i] * x[j]) + CASE WHEN i = j AND i < {d} THEN 1 ELSE 0 END AS v
  FROM {prefix}p{k}, range(1, {d} + 1) a(i), range(1, {d} + 1) b(j) GROUP BY i, j
  UNION ALL
  SELECT i, {d} + 1, {c} * sum(w * (p - y) * x[i]) + CASE WHEN i < {d} THEN any_value(beta)[i] ELSE 0 END
  FROM {prefix}p{k}, {prefix}{k - 1}, range(1, {d} + 1) a(i) GROUP BY i),
{prefix}m{k} AS MATERIALIZED (
  SELECT 0 AS mid, (SELECT beta FROM {prefix}{k - 1}) AS beta, list(line ORDER BY i) AS m
  FROM (SELECT i, list(v ORDER BY j) AS line FROM {prefix}h{k} GROUP BY i))""")
        ctes.append(_eliminate(f"{prefix}{k}", f"{prefix}m{k}"))
    return ",\n".join(ctes)


def stratified_folds(rows: str, label: str, order: str, folds: int) -> str:
    """CTEs ending in ``folded``: ``rows`` with ``fold``. Within a class, rows in ``order`` are cut
    into runs; class sizes per fold are those of every ``folds``-th place in the labels
    sorted by first appearance of their class."""
    return f"""
f_class AS (SELECT {label} AS k, count(*) AS n, row_number() OVER (ORDER BY min({order})) AS first_seen,
                   min({order}) = min(min({order})) OVER () AS leads FROM {rows} GROUP BY {label}),
f_start AS (SELECT k, n, coalesce(sum(n) OVER (ORDER BY leads DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS start FROM f_class),
f_size AS (SELECT k, f, (SELECT count(*) FROM range(start::BIGINT, (start + n)::BIGINT) t(j) WHERE j % {folds} = f) AS size
           FROM f_start, range({folds}) t(f)),
f_upto AS (SELECT k, f, sum(size) OVER (PARTITION BY k ORDER BY f) AS upto FROM f_size),
f_rank AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {order}) - 1 AS crank FROM {rows}),
folded AS MATERIALIZED (SELECT r.*, (SELECT min(f) FROM f_upto u WHERE u.k = r.{label} AND r.crank < u.upto) AS fold
                        FROM f_rank r)"""
