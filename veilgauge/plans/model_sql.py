"""Classifiers in DuckDB SQL: what forests, logistic and linear models compute, written out as common table expressions.

Sources have ``k`` (the table, or ``''``), ``row`` (text), ``x`` (a list of numbers) and ``y``.
"""

from __future__ import annotations

import math

from veilgauge.operators.forests import CUTS, DRAWS, LEAST_GAIN
from veilgauge.operators.mixtures import SPREAD
from veilgauge.plans.oracles import SEED, hashed, lst, num, unif


def _codes(width: int) -> str:
    return (
        f"list_transform(range(1, {width + 1}), lambda i: CASE WHEN x[i] IS NULL THEN -1 ELSE len(list_filter(cs[i], lambda c: c < x[i])) END)"
    )


def _looks(rel: str, keys: list[str], width: int, per_node: int, seed: int) -> str:
    """Adds ``looks``, the features that a node may use."""
    for n, j in enumerate(range(width - per_node, width)):
        t = f"CAST(floor({unif(hashed('feature', *keys, 'tree', 'node', str(j), seed=seed))} * {j + 1}) AS INTEGER)"
        rel = (
            f"(SELECT *, [{t}] AS l{n} FROM {rel})" if not n
            else f"(SELECT * EXCLUDE (l{n - 1}), list_append(l{n - 1}, CASE WHEN list_contains(l{n - 1}, {t}) THEN {j} ELSE {t} END) AS l{n} FROM {rel})"
        )
    return f"(SELECT * EXCLUDE (l{per_node - 1}), l{per_node - 1} AS looks FROM {rel})"


def forest(src: str, width: int, classes: int, trees: int, depth: int, keyed: bool = False, seed: int = SEED) -> list[str]:
    """CTEs ``cutmap(k, cs)``, ``s<level>(k, tree, node, f, b, split)`` and ``leaves(k, tree, node, counts)``."""
    keys, by = (["k"] if keyed else []), "k, tree, node"
    per_node = max(1, round(math.sqrt(width)))
    out = [
        f"vals AS (SELECT k, f, x[f + 1] AS v FROM {src}, (SELECT CAST(range AS INTEGER) AS f FROM range(0, {width})) WHERE x[f + 1] IS NOT NULL)",
        f"ranked AS (SELECT k, f, list_sort(list_distinct(list(v))) AS vs, list_sort(list_distinct(quantile_cont(v, {lst([j / CUTS for j in range(1, CUTS)])}))) AS qs FROM vals GROUP BY k, f)",
        f"cutmap AS MATERIALIZED (SELECT k, list(CASE WHEN len(vs) <= {CUTS} THEN vs[1 : len(vs) - 1] ELSE qs END ORDER BY f) AS cs FROM ranked GROUP BY k)",
        f"coded AS MATERIALIZED (SELECT s.k, row, y, {_codes(width)} AS codes FROM {src} AS s JOIN cutmap USING (k) WHERE y BETWEEN 0 AND {classes - 1})",
    ]
    weight = " + ".join(f"CAST(u >= {num(c)} AS INTEGER)" for c in DRAWS)
    u = unif(hashed("bootstrap", *keys, "row", "tree", seed=seed))
    out.append(
        f"a0 AS MATERIALIZED (SELECT * FROM (SELECT k, row, y, codes, tree, 1::BIGINT AS node, {weight} AS w FROM "
        f"(SELECT *, {u} AS u FROM coded, (SELECT range AS tree FROM range(0, {trees})))) WHERE w > 0)"
    )
    window = "OVER (PARTITION BY k, tree, node, f ORDER BY b ROWS UNBOUNDED PRECEDING)"
    whole = "OVER (PARTITION BY k, tree, node, f)"

    def total(p: str) -> str:
        return "(" + " + ".join(f"{p}{i}" for i in range(classes)) + ")"

    def purity(p: str) -> str:
        return f"(CASE WHEN {total(p)} > 0 THEN ({' + '.join(f'{p}{i} * {p}{i}' for i in range(classes))}) / {total(p)} ELSE 0e0 END)"

    for level in range(depth + 1):
        nodes = _looks(f"(SELECT DISTINCT {by} FROM a{level})", keys, width, per_node, seed)
        sums = ", ".join(f"sum(CASE WHEN y = {i} THEN w ELSE 0 END)::DOUBLE AS n{i}" for i in range(classes))
        out.append(f"n{level} AS MATERIALIZED (SELECT {by}, unnest(looks) AS f FROM {nodes})")
        out.append(f"c{level} AS (SELECT {by}, f, codes[f + 1] AS b, {sums} FROM a{level} JOIN n{level} USING ({by}) GROUP BY ALL)")
        left = ", ".join(f"sum(n{i}) {window} AS l{i}, sum(n{i}) {whole} AS t{i}" for i in range(classes))
        middle = "CAST(coalesce(ceil((b + lead(b) OVER (PARTITION BY k, tree, node, f ORDER BY b) - 1) / 2e0), b) AS INTEGER)"
        right = ", ".join(f"t{i} - l{i} AS r{i}" for i in range(classes))
        gain = f"CASE WHEN {total('r')} > 0 THEN {purity('l')} + {purity('r')} - {purity('t')} ELSE 0e0 END"
        out.append(
            f"s{level} AS MATERIALIZED (SELECT {by}, f, b, [{', '.join(f't{i}' for i in range(classes))}] AS counts, "
            f"(gain > {num(LEAST_GAIN)} AND {str(level < depth).lower()}) AS split FROM (SELECT *, {gain} AS gain FROM (SELECT *, {right} FROM "
            f"(SELECT * REPLACE ({middle} AS b), {left} FROM c{level}))) QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY gain DESC, f, b) = 1)"
        )
        if level < depth:
            out.append(
                f"a{level + 1} AS MATERIALIZED (SELECT k, row, y, codes, tree, 2 * node + CAST(codes[f + 1] > b AS BIGINT) AS node, w "
                f"FROM a{level} JOIN s{level} USING ({by}) WHERE split)"
            )
    out.append("leaves AS (" + " UNION ALL ".join(f"SELECT {by}, counts FROM s{i} WHERE NOT split" for i in range(depth + 1)) + ")")
    return out


def forest_shares(asked: str, width: int, classes: int, trees: int, depth: int) -> list[str]:
    """CTE ``probs(k, row, probs)`` for the rows ``k, row, x`` of ``asked``."""
    out = [
        f"r0 AS (SELECT q.k, row, {_codes(width)} AS codes, tree, 1::BIGINT AS node FROM {asked} AS q JOIN cutmap USING (k), (SELECT range AS tree FROM range(0, {trees})))"
    ]
    for level in range(depth):
        step = f"CASE WHEN s.split THEN 2 * r.node + CAST(codes[s.f + 1] > s.b AS BIGINT) ELSE r.node END"
        out.append(f"r{level + 1} AS (SELECT r.k, row, codes, r.tree, {step} AS node FROM r{level} AS r LEFT JOIN s{level} AS s ON s.k = r.k AND s.tree = r.tree AND s.node = r.node)")
    shares = ", ".join(f"avg(counts[{i + 1}] / list_sum(counts))" for i in range(classes))
    out.append(f"probs AS (SELECT k, row, [{shares}] AS probs FROM r{depth} JOIN leaves USING (k, tree, node) GROUP BY k, row)")
    return out


def best(probs: str) -> str:
    """Position from 0 of the first largest cell, rounded as the engine rounds before it compares."""
    rounded = f"list_transform({probs}, lambda p: round(p, 9))"
    return f"(list_position({rounded}, list_max({rounded})) - 1)"


def solved(name: str, system: str, size: int) -> str:
    """CTE ``name(k, z)``: solutions of the systems ``k, m`` in ``system``, lists of ``size`` equations with the right side last, by elimination."""
    row = (
        "CASE WHEN i = col THEN list_transform(r, lambda v: v / r[col]) "
        "ELSE list_transform(list_zip(r, m[col]), lambda t: t[1] - r[col] * t[2] / m[col][col]) END"
    )
    return (
        f"{name}_e AS (SELECT k, 1 AS col, m FROM {system} UNION ALL SELECT k, col + 1, list_transform(m, lambda r, i: {row}) FROM {name}_e WHERE col <= {size}), "
        f"{name} AS MATERIALIZED (SELECT k, list_transform(m, lambda r: r[{size + 1}]) AS z FROM {name}_e WHERE col = {size + 1})"
    )


def logistic(src: str, width: int, classes: int, steps: int, penalty: float = 1.0, weight: str = "1e0") -> list[str]:
    """CTE ``w<steps>(k, counts, w)``: Newton's method from zero; weights by class, each with its offset last."""
    d = width + 1
    size = classes * d
    counts = ", ".join(f"count(*) FILTER (WHERE y = {c})" for c in range(classes))
    out = [
        f"lr AS MATERIALIZED (SELECT k, list_append(x, 1e0) AS x, y, {weight} AS wt FROM {src} WHERE y BETWEEN 0 AND {classes - 1})",
        f"present AS (SELECT k, counts, list_filter(range({classes}), lambda c: counts[c + 1] > 0) AS p FROM (SELECT k, [{counts}] AS counts FROM lr GROUP BY k))",
        f"w0 AS (SELECT k, counts, CASE WHEN len(p) = 2 THEN [p[2]] WHEN len(p) > 2 THEN p ELSE [] END AS free, list_transform(range({size}), lambda i: 0e0) AS w FROM present)",
        f"idx AS MATERIALIZED (SELECT a, b, a // {d} AS c, a % {d} AS i, b // {d} AS e, b % {d} AS j FROM (SELECT range AS a FROM range(0, {size})), "
        f"(SELECT range AS b FROM range(0, {size + 1})) WHERE b >= a)",
    ]
    for s in range(steps):
        logit = f"list_transform(range({classes}), lambda c: CASE WHEN counts[c + 1] > 0 THEN list_dot_product(w[c * {d} + 1 : c * {d} + {d}], x) ELSE -1e300 END)"
        out.append(f"z{s} AS (SELECT lr.k, x, y, wt, {logit} AS z FROM lr JOIN w{s} USING (k))")
        out.append(f"q{s} AS (SELECT k, x, y, wt, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z{s})")
        out.append(f"p{s} AS MATERIALIZED (SELECT k, x, y, wt, list_transform(e, lambda v: v / list_sum(e)) AS p FROM q{s})")
        # Cells with b = size are the gradient.
        cell = (
            f"CASE WHEN b = {size} THEN (p[c + 1] - CAST(y = c AS INTEGER)) * x[i + 1] ELSE p[c + 1] * (CAST(c = e AS INTEGER) - p[e + 1]) * x[i + 1] * x[j + 1] END"
        )
        out.append(f"h{s} AS MATERIALIZED (SELECT k, a, b, c, i, e, j, sum(wt * ({cell})) AS v FROM p{s}, idx GROUP BY ALL)")
        both = f"(SELECT k, a, b, c, i, e, j, v FROM h{s} UNION ALL SELECT k, b, a, e, j, c, i, v FROM h{s} WHERE a <> b AND b < {size})"
        value = (
            f"CASE WHEN NOT list_contains(free, h.c) THEN CAST(h.a = h.b AS INTEGER) WHEN h.b = {size} THEN v + CASE WHEN i < {width} THEN {num(penalty)} * w[h.a + 1] ELSE 0e0 END "
            f"WHEN NOT list_contains(free, h.e) THEN 0e0 ELSE v + CASE WHEN h.a = h.b AND i < {width} THEN {num(penalty)} WHEN i = {width} AND j = {width} AND len(free) > 1 THEN 1e0 ELSE 0e0 END END"
        )
        out.append(f"m{s} AS (SELECT k, list(r ORDER BY a) AS m FROM (SELECT k, h.a, list({value} ORDER BY h.b) AS r FROM {both} AS h JOIN w{s} USING (k) GROUP BY k, h.a) GROUP BY k)")
        out.append(solved(f"d{s}", f"m{s}", size))
        out.append(f"w{s + 1} AS MATERIALIZED (SELECT w.k, counts, free, list_transform(range(1, {size + 1}), lambda i: w[i] - z[i]) AS w FROM w{s} AS w JOIN d{s} USING (k))")
    return out


def logistic_shares(asked: str, width: int, classes: int, steps: int) -> list[str]:
    """CTE ``probs(k, row, probs)`` for the rows ``k, row, x`` of ``asked``."""
    d = width + 1
    logit = f"list_transform(range({classes}), lambda c: CASE WHEN counts[c + 1] > 0 THEN list_dot_product(w[c * {d} + 1 : c * {d} + {d}], list_append(x, 1e0)) ELSE -1e300 END)"
    return [
        f"az AS (SELECT q.k, row, {logit} AS z FROM {asked} AS q JOIN w{steps} USING (k))",
        "ae AS (SELECT k, row, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM az)",
        "probs AS (SELECT k, row, list_transform(e, lambda v: v / list_sum(e)) AS probs FROM ae)",
    ]


def linear(src: str, columns: list[str], y: str) -> list[str]:
    """CTE ``lin(k, n, beta, means, my, rest)``: least squares of ``y`` on columns of ``src`` by ``k``; constant columns get 0. ``rest`` is the sum of squared residuals."""
    size = len(columns)
    live = [f"var_pop({c}) > 1e-18 * greatest({', '.join(f'var_pop({x})' for x in columns)})" for c in columns]
    rows = []
    for i, a in enumerate(columns):
        cells = [f"CASE WHEN {live[i]} AND {live[j]} THEN covar_pop({a}, {b}) ELSE {1 if i == j else 0} END" for j, b in enumerate(columns)]
        rows.append("[" + ", ".join([*cells, f"CASE WHEN {live[i]} THEN covar_pop({a}, {y}) ELSE 0 END"]) + "]")
    means = ", ".join(f"avg({c})" for c in columns)
    cov = ", ".join(f"covar_pop({c}, {y})" for c in columns)
    return [
        f"lin_m AS MATERIALIZED (SELECT k, count(*) AS n, [{means}] AS means, avg({y}) AS my, var_pop({y}) AS vy, [{cov}] AS cy, [{', '.join(rows)}] AS m FROM {src} GROUP BY k)",
        solved("lin_s", "lin_m", size),
        "lin AS (SELECT k, n, z AS beta, means, my, greatest(vy - list_dot_product(z, cy), 0) * n AS rest FROM lin_m JOIN lin_s USING (k))",
    ]


def factored(d: int) -> str:
    """Columns ``l<i>_<j>``: the lower triangle whose product with its transpose is ``s<i>_<j>`` (``i >= j``)."""
    out = []
    for i in range(d):
        for j in range(i + 1):
            rest = f"s{i}_{j}" + "".join(f" - l{i}_{m} * l{j}_{m}" for m in range(j))
            out.append(f"sqrt({rest}) AS l{i}_{j}" if i == j else f"({rest}) / l{j}_{j} AS l{i}_{j}")
    return ", ".join(out)


def mixture(src: str, d: int, components: int, steps: int, ridge: float, seed: int = SEED) -> list[str]:
    """CTE ``mx<steps>(k, n, fit, c, w, m<i>, s<i>_<j>)`` from ``k, id, x0, x1, …``: expectation maximisation from keyed means."""
    low = [(i, j) for i in range(d) for j in range(i + 1)]
    n = f"{components}"

    def first(i: int) -> str:
        parts = []
        for j in range(i + 1):
            u = unif(hashed("mixture", "c", str(j), seed=seed))
            parts.append(f"l{i}_{j} * ({f'({u} + c) / {n}' if j == 0 else u} * {num(2 * SPREAD)} - {num(SPREAD)})")
        return f"m{i} + {' + '.join(parts)} AS m{i}"

    own = ", ".join([*[f"avg(x{j}) AS m{j}" for j in range(d)], *[f"covar_pop(x{i}, x{j}) + {num(ridge) if i == j else '0e0'} AS s{i}_{j}" for i, j in low]])
    start = ", ".join([*[first(j) for j in range(d)], *[f"s{i}_{j} / ({n} * {n}) AS s{i}_{j}" for i, j in low]])
    out = [
        f"mx0 AS MATERIALIZED (SELECT k, c, n, 1e0 / {n} AS w, {start} FROM (SELECT *, {factored(d)} FROM (SELECT k, count(*) AS n, {own} FROM {src} GROUP BY k)), "
        f"(SELECT range AS c FROM range(0, {n})))"
    ]
    for t in range(steps):
        z = ", ".join(f"(x{i} - m{i}" + "".join(f" - l{i}_{j} * z{j}" for j in range(i)) + f") / l{i}_{i} AS z{i}" for i in range(d))
        dens = "ln(w) - " + " - ".join(f"ln(l{i}_{i})" for i in range(d)) + " - (" + " + ".join(f"z{i} * z{i}" for i in range(d)) + f") / 2 - {d} * ln(2 * pi()) / 2"
        xs = ", ".join(f"x{i}" for i in range(d))
        out.append(f"md{t} AS (SELECT k, id, n, c, {xs}, {dens} AS g FROM (SELECT *, {z} FROM {src} JOIN (SELECT *, {factored(d)} FROM mx{t}) USING (k)))")
        out.append(f"mt{t} AS (SELECT *, max(g) OVER (PARTITION BY k, id) AS top FROM md{t})")
        out.append(f"me{t} AS (SELECT *, top + ln(total) AS ll, exp(g - top) / total AS r FROM (SELECT *, sum(exp(g - top)) OVER (PARTITION BY k, id) AS total FROM mt{t}))")
        sums = ", ".join([*[f"sum(r * x{i}) / sum(r) AS m{i}" for i in range(d)], *[f"sum(r * x{i} * x{j}) / sum(r) AS q{i}_{j}" for i, j in low]])
        cov = ", ".join(f"q{i}_{j} - m{i} * m{j} + {num(ridge) if i == j else '0e0'} AS s{i}_{j}" for i, j in low)
        out.append(f"mx{t + 1} AS MATERIALIZED (SELECT *, {cov} FROM (SELECT k, c, n, avg(ll) AS fit, sum(r) / n AS w, {sums} FROM me{t} GROUP BY k, c, n))")
    return out
