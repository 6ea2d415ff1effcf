"""The registered queries in DuckDB SQL, over the same parquet tables."""

from __future__ import annotations

from dataclasses import replace
from itertools import combinations

from veilgauge.meta import INTEGER, TableMeta, bin_labels
from veilgauge.operators import features
from veilgauge.plans.catalogue import INFO_COLUMNS, LINK_ON, NETWORK, QUIDS, SEED
from veilgauge.plans.population import META, PRIORITY, SEGMENT, WIDE

NAMES = META.names
DISCRETE = [c.name for c in META.discrete]
NUMERIC = [c.name for c in META.numeric]
BINS = 10

POP = """pop AS (
  SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment,
         CAST(n_regionkey AS VARCHAR) AS region, CAST(year(o_orderdate) AS BIGINT) AS year, o_totalprice AS total,
         c_acctbal AS balance, n_name AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
POPN = POP + """,
popn AS (
  SELECT id, status, priority, CASE WHEN id % 17 <> 0 THEN segment END AS segment, region, year, total,
         CASE WHEN id % 13 <> 0 THEN balance END AS balance FROM pop)"""


def tab(src: str) -> str:
    return f"tab AS (SELECT *, status || '-' || CAST(year % 2 AS VARCHAR) AS dataset_id FROM {src})"


def num(x) -> str:
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def lst(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else num(v) for v in values) + "]"


def tidy(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 1e6 THEN round({x}, 6) ELSE round(({x}) / 1e6, 6) * 1e6 END + 0e0)"


def hashed(tag: str, *parts: str, seed: int = SEED) -> str:
    return f"md5(concat_ws(':', '{seed}', '{tag}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"


def unif(hexed: str, slot: int = 0) -> str:
    return f"(CAST(CAST(concat('0x', substr({hexed}, {1 + 12 * slot}, 12)) AS UBIGINT) AS DOUBLE) / 281474976710656e0)"


def code(name: str, labels, null: bool = False) -> str:
    labels = list(labels)
    if null:
        return f"CAST(coalesce(list_position({lst(labels + ['NaN'])}, coalesce({name}, 'NaN')), 0) - 1 AS BIGINT)"
    return f"CAST(coalesce(list_position({lst(labels)}, {name}), 0) - 1 AS INTEGER)"


def steps(x: str, edges, op: str) -> str:
    return " + ".join(f"CAST({x} {op} {num(e)} AS INTEGER)" for e in edges) or "0"


def left_bin(c, cap: bool = False) -> str:
    e = c.edges(BINS)
    above = f"WHEN {c.name} > {num(c.high)} THEN -1 " if cap else ""
    return f"CASE WHEN {c.name} IS NULL THEN NULL WHEN {c.name} < {num(e[0])} THEN -1 {above}ELSE {steps(c.name, e[1:-1], '>=')} END"


def bin_code(c, cap: bool = False) -> str:
    """Code of a column as generators count it; null for null."""
    if c.numeric:
        return left_bin(c, cap)
    return f"CASE WHEN {c.name} IS NOT NULL THEN {code(c.name, c.labels)} END"


def cut(name: str, edges) -> str:
    whens = "".join(f" WHEN {name} <= {num(hi)} THEN '{lab}'" for hi, lab in zip(edges[1:], bin_labels(edges)))
    return f"CASE WHEN {name} IS NULL OR {name} <= {num(edges[0])} OR {name} > {num(edges[-1])} THEN 'nan'{whens} ELSE 'nan' END"


def onehot(c) -> list[str]:
    return [f"CASE WHEN coalesce({c.name}, 'NaN') = '{lab}' THEN 1e0 ELSE 0e0 END" for lab in c.labels]


def wide(exprs, keep: str, src: str) -> str:
    return f"SELECT {keep}, " + ", ".join(f"round({e}, 9) AS v{i}" for i, e in enumerate(exprs)) + f" FROM {src}"


# ---- distributions ----------------------------------------------------------------------------------------------


def counted_cells(src: str, meta: TableMeta, keys: str = "") -> str:
    """CTE ``cells``: ``keys, attr, bin, n, size`` over the whole domain of every column."""
    k = f"{keys}, " if keys else ""
    parts = []
    for c in meta.columns:
        size = c.domain_size(BINS)
        tables = f"(SELECT DISTINCT {keys} FROM {src})" if keys else "(SELECT 1)"
        on = f"USING ({k}bin)"
        parts.append(
            f"SELECT {k}'{c.name}' AS attr, CAST(bin AS INTEGER) AS bin, coalesce(n, 0) AS n, {size} AS size "
            f"FROM {tables} AS t CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(0, {size})) AS d "
            f"LEFT JOIN (SELECT {k}{bin_code(c, True)} AS bin, count(*) AS n FROM {src} GROUP BY ALL) AS x {on}"
        )
    return "cells AS (" + " UNION ALL ".join(parts) + ")"


def shares(keys: str = "") -> str:
    by = f"{keys}, attr" if keys else "attr"
    return f"""shares AS (SELECT *, CASE WHEN total > 0 THEN n / CAST(total AS DOUBLE) ELSE 1e0 / size END AS prob,
      CASE WHEN total > 0 THEN cum / CAST(total AS DOUBLE) ELSE (bin + 1) / CAST(size AS DOUBLE) END AS cdf
      FROM (SELECT *, sum(n) OVER (PARTITION BY {by}) AS total, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS cum FROM cells))"""


def pick(cdf: str, u: str) -> str:
    return f"least(len(list_filter({cdf}, lambda c: c <= {u})), len({cdf}) - 1)"


def value_of(c, b: str, u: str) -> str:
    if not c.numeric:
        return f"{lst(c.labels)}[CAST({b} + 1 AS BIGINT)]"
    e = lst([float(x) for x in c.edges(BINS)])
    x = f"({e}[CAST({b} + 1 AS BIGINT)] + {u} * ({e}[CAST({b} + 2 AS BIGINT)] - {e}[CAST({b} + 1 AS BIGINT)]))"
    return f"CAST(round_even({x}, 0) AS BIGINT)" if c.kind == INTEGER else f"round({x}, 6)"


def histogram_rows(n: str, keys: str = "", copies: int = 1) -> str:
    """Rows drawn from ``shares``; ``n`` is a scalar SQL expression."""
    k = f"{keys}, " if keys else ""
    lists = ", ".join(f"list(cdf ORDER BY bin) FILTER (WHERE attr = '{c.name}') AS cdf_{c.name}" for c in META.columns)
    model = f"model AS (SELECT {k}{lists} FROM shares{' GROUP BY ' + keys if keys else ''})"
    parts = [keys] if keys else []
    hexes = ", ".join(f"{hashed('hist', *parts, 'copy', 'row', repr(c.name))} AS h_{c.name}" for c in META.columns)
    base = (
        f"base AS (SELECT *, {hexes} FROM model CROSS JOIN (SELECT range AS copy FROM range(0, {copies})) "
        f"CROSS JOIN (SELECT range AS row FROM range(0, {n})))"
    )
    us = ", ".join(f"{unif(f'h_{c.name}', 0)} AS u_{c.name}, {unif(f'h_{c.name}', 1)} AS w_{c.name}" for c in META.columns)
    drawn = f"drawn AS (SELECT *, {us} FROM base)"
    bins = ", ".join(f"{pick(f'cdf_{c.name}', f'u_{c.name}')} AS b_{c.name}" for c in META.columns)
    binned = f"binned AS (SELECT *, {bins} FROM drawn)"
    vals = ", ".join(f"{value_of(c, f'b_{c.name}', f'w_{c.name}')} AS {c.name}" for c in META.columns)
    return f"{model}, {base}, {drawn}, {binned}, made AS (SELECT {k}copy, row, {vals} FROM binned)"


# ---- networks ---------------------------------------------------------------------------------------------------

CODED = "coded AS (SELECT id, " + ", ".join(f"{bin_code(c)} AS b_{c.name}" for c in META.columns) + " FROM pop)"


def cell_table(attrs: list[str], noise: float | None) -> str:
    """Counts over the full domain of some columns: ``p`` (all but the last) and ``c`` (the last)."""
    sizes = [META[a].domain_size(BINS) for a in attrs]
    child, parents = attrs[-1], attrs[:-1]
    p = f"b_{parents[0]}" if parents else "0"
    psize = sizes[0] if parents else 1
    n = "coalesce(x.n, 0)"
    if noise is not None:
        u = unif(hashed("cell", repr(",".join(attrs)), "concat(d.p, ',', e.c)"))
        lap = f"-{num(noise)} * sign({u} - 0.5e0) * ln(greatest(1 - 2 * abs({u} - 0.5e0), 1e0 / 281474976710656e0))"
        n = f"greatest({n} + ({lap}), 0e0)"
    return (
        f"SELECT d.p, e.c, {n} AS n FROM (SELECT CAST(range AS BIGINT) AS p FROM range(0, {psize})) AS d "
        f"CROSS JOIN (SELECT CAST(range AS BIGINT) AS c FROM range(0, {sizes[-1]})) AS e LEFT JOIN "
        f"(SELECT {p} AS p, b_{child} AS c, count(*) AS n FROM coded WHERE b_{child} >= 0 GROUP BY ALL) AS x ON x.p = d.p AND x.c = e.c"
    )


def step_cells(noise: float | None = None) -> list[str]:
    """CTEs ``t0`` (first two columns) and ``t<s>``; then ``s<step>(p, c, n)`` for every step of the fixed network."""
    order = [c for c, _ in NETWORK]
    ctes = [f"t0 AS ({cell_table(order[:2], noise)})"]
    ctes += [f"t{s} AS ({cell_table([*ps, c], noise)})" for s, (c, ps) in enumerate(NETWORK) if s >= 2]
    ctes.append("s0 AS (SELECT 0 AS p, p AS c, sum(n) AS n FROM t0 GROUP BY p)")
    ctes.append("s1 AS (SELECT * FROM t0)")
    ctes += [f"s{s} AS (SELECT * FROM t{s})" for s in range(2, len(NETWORK))]
    return ctes


def step_dist(s: int) -> str:
    size = META[NETWORK[s][0]].domain_size(BINS)
    return f"""d{s} AS (SELECT p, c, n, CASE WHEN total > 0 THEN n / CAST(total AS DOUBLE) ELSE 1e0 / {size} END AS prob,
      CASE WHEN total > 0 THEN cum / CAST(total AS DOUBLE) ELSE (c + 1) / {num(size)} END AS cdf
      FROM (SELECT *, sum(n) OVER (PARTITION BY p) AS total, sum(n) OVER (PARTITION BY p ORDER BY c) AS cum FROM s{s}))"""


def network_rows(noise: float | None = None) -> str:
    ctes = [POP, CODED, *step_cells(noise)]
    for s in range(len(NETWORK)):
        ctes += [step_dist(s), f"m{s} AS (SELECT p, list(cdf ORDER BY c) AS cdf FROM d{s} GROUP BY p)"]
    ctes.append("r AS (SELECT 0 AS copy, range AS row FROM range(0, (SELECT count(*) FROM pop)))")
    prev = "r"
    for s, (child, parents) in enumerate(NETWORK):
        u = unif(hashed("net", "copy", "row", repr(child)))
        on = f"m{s}.p = q.b_{parents[0]}" if parents else f"m{s}.p = 0"
        ctes.append(f"u{s} AS (SELECT *, {u} AS u FROM {prev})")
        ctes.append(f"r{s} AS (SELECT q.* EXCLUDE (u), {pick(f'm{s}.cdf', 'q.u')} AS b_{child} FROM u{s} AS q JOIN m{s} ON {on})")
        prev = f"r{s}"
    ws = ", ".join(f"{unif(hashed('net', 'copy', 'row', repr(c.name)), 1)} AS w_{c.name}" for c in META.numeric)
    ctes.append(f"z AS (SELECT *, {ws} FROM {prev})")
    vals = ", ".join(f"{value_of(c, f'b_{c.name}', f'w_{c.name}')} AS {c.name}" for c in META.columns)
    return "WITH " + ",\n".join(ctes) + f"\nSELECT row, {vals} FROM z"


def information(cols) -> str:
    """CTE ``info(a, b, mi, hx, hy)`` for all column pairs, from ``coded``."""
    parts = []
    for a, b in combinations(cols, 2):
        parts.append(f"SELECT '{a}' AS a, '{b}' AS b, b_{a} AS x, b_{b} AS y, count(*) AS n FROM coded WHERE b_{a} >= 0 AND b_{b} >= 0 GROUP BY ALL")
    return (
        "joint AS (" + " UNION ALL ".join(parts) + "), info AS (SELECT a, b, sum(n / nn * ln(n * nn / (nx * ny))) AS mi, "
        "-sum(n / nn * ln(nx / nn)) AS hx, -sum(n / nn * ln(ny / nn)) AS hy FROM (SELECT a, b, CAST(n AS DOUBLE) AS n, "
        "CAST(sum(n) OVER (PARTITION BY a, b, x) AS DOUBLE) AS nx, CAST(sum(n) OVER (PARTITION BY a, b, y) AS DOUBLE) AS ny, "
        "CAST(sum(n) OVER (PARTITION BY a, b) AS DOUBLE) AS nn FROM joint) GROUP BY a, b)"
    )


def structure() -> str:
    edges = "edges AS (SELECT a AS child, b AS parent, round(mi, 12) AS mi FROM info UNION ALL SELECT b, a, round(mi, 12) FROM info)"
    names = "names AS (SELECT unnest(" + lst(NAMES) + ") AS name)"
    ctes = [POP, CODED, information(NAMES), edges, names]
    ctes.append(f"v0 AS (SELECT 0 AS step, name AS child, '' AS parents FROM names ORDER BY {hashed('root', 'name')}, name LIMIT 1)")
    for s in range(1, len(NAMES)):
        p = f"v{s - 1}"
        ctes.append(
            f"v{s} AS (SELECT * FROM {p} UNION ALL SELECT * FROM (SELECT {s} AS step, child, parent AS parents FROM edges "
            f"WHERE parent IN (SELECT child FROM {p}) AND child NOT IN (SELECT child FROM {p}) ORDER BY mi DESC, child, parent LIMIT 1))"
        )
    return "WITH " + ",\n".join(ctes) + f"\nSELECT step, child, parents FROM v{len(NAMES) - 1}"


def searched(degree: int, epsilon: float | None) -> str:
    """Network search with up to ``degree`` parents, by rounds; with ``epsilon`` each round draws its edge by the exponential mechanism (Gumbel noise keyed by edge)."""
    parts, sizes = [], range(1, degree + 1)
    for child in NAMES:
        for k in sizes:
            for ps in combinations([p for p in NAMES if p != child], k):
                ps = sorted(ps, key=NAMES.index)
                x = " || ',' || ".join(f"CAST(b_{p} AS VARCHAR)" for p in ps)
                known = " AND ".join(f"b_{c} >= 0" for c in (child, *ps))
                parts.append(
                    f"SELECT '{child}' AS child, {lst(ps)} AS ps, {lst([float(NAMES.index(p)) for p in ps])} AS pos, {x} AS x, b_{child} AS y, "
                    f"CAST(count(*) AS DOUBLE) AS n FROM coded WHERE {known} GROUP BY ALL"
                )
    few = ", ".join(f"CASE WHEN count(DISTINCT b_{c}) FILTER (WHERE b_{c} >= 0) + max(CAST(b_{c} IS NULL AS INTEGER)) <= 2 THEN '{c}' ELSE '' END" for c in NAMES)
    ctes = [
        POP, CODED, "j AS (" + " UNION ALL ".join(parts) + ")",
        "mi AS MATERIALIZED (SELECT child, ps, pos, round(sum(n / nn * ln(n * nn / (nx * ny))), 12) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY child, ps, x) AS nx, "
        "sum(n) OVER (PARTITION BY child, ps, y) AS ny, sum(n) OVER (PARTITION BY child, ps) AS nn FROM j) GROUP BY ALL)",
        f"facts AS (SELECT CAST(count(*) AS DOUBLE) AS n, [{few}] AS few FROM coded)",
        "names AS (SELECT unnest(" + lst(NAMES) + ") AS name)",
        f"v0 AS (SELECT 0 AS step, name AS child, CAST([] AS VARCHAR[]) AS ps FROM names ORDER BY {hashed('root', 'name')}, name LIMIT 1)",
    ]
    small = "(ln(n) / n + (n - 1e0) / n * ln(n / (n - 1e0)))"
    large = "(2e0 / n * ln((n + 1e0) / 2e0) + (1 - 1e0 / n) * ln(1 + 2e0 / (n - 1)))"
    for step in range(1, len(NAMES)):
        p = f"v{step - 1}"
        rank = "mi"
        if epsilon is not None:
            binary = "(list_contains(few, child) OR (len(ps) = 1 AND list_contains(few, ps[1])))"
            delta = f"({num(len(NAMES) - 1)} * CASE WHEN {binary} THEN {small} ELSE {large} END / {num(epsilon)})"
            u = f"({unif(hashed('edge', str(step), 'child', "array_to_string(ps, ',')"))} + {num(0.5 / 2**48)})"
            rank = f"mi / (2 * {delta}) - ln(-ln({u}))"
        ctes.append(
            f"v{step} AS MATERIALIZED (SELECT * FROM {p} UNION ALL SELECT * FROM (SELECT {step} AS step, child, ps FROM mi, facts WHERE len(ps) = {min(step, degree)} "
            f"AND child NOT IN (SELECT child FROM {p}) AND list_has_all((SELECT list(child) FROM {p}), ps) "
            f"ORDER BY {rank} DESC, child, pos LIMIT 1))"
        )
    return "WITH " + ",\n".join(ctes) + f"\nSELECT step, child, array_to_string(ps, ' ') AS parents FROM v{len(NAMES) - 1}"


def keyed_network_rows(n: str) -> str:
    """Rows of one network for each table, all along the fixed edges."""
    coded = "coded AS (SELECT dataset_id, " + ", ".join(f"{bin_code(c)} AS b_{c.name}" for c in META.columns) + " FROM tab)"
    ctes = [POP, tab("pop"), coded, "tabs AS (SELECT DISTINCT dataset_id FROM tab)", f"r AS (SELECT dataset_id, 0 AS copy, range AS row FROM tabs, range(0, {n}))"]
    prev = "r"
    for s, (child, parents) in enumerate(NETWORK):
        size = META[child].domain_size(BINS)
        p, psize = (f"b_{parents[0]}", META[parents[0]].domain_size(BINS)) if parents else ("0", 1)
        # The first two columns share a table, so the root's counts are of rows in which both are known.
        known = f"b_{child} >= 0 AND " + " AND ".join(f"b_{c} >= 0" for c in ([c for c, _ in NETWORK[:2]] if s < 2 else parents) or [child])
        ctes.append(
            f"c{s} AS (SELECT dataset_id, d.p, e.c, coalesce(n, 0) AS n FROM tabs CROSS JOIN (SELECT CAST(range AS BIGINT) AS p FROM range(0, {psize})) AS d "
            f"CROSS JOIN (SELECT CAST(range AS BIGINT) AS c FROM range(0, {size})) AS e LEFT JOIN (SELECT dataset_id, CAST({p} AS BIGINT) AS p, CAST(b_{child} AS BIGINT) AS c, count(*) AS n "
            f"FROM coded WHERE {known} GROUP BY ALL) AS x USING (dataset_id, p, c))"
        )
        ctes.append(
            f"m{s} AS (SELECT dataset_id, p, list(CASE WHEN total > 0 THEN cum / CAST(total AS DOUBLE) ELSE (c + 1) / {num(size)} END ORDER BY c) AS cdf FROM "
            f"(SELECT *, sum(n) OVER (PARTITION BY dataset_id, p) AS total, sum(n) OVER (PARTITION BY dataset_id, p ORDER BY c) AS cum FROM c{s}) GROUP BY dataset_id, p)"
        )
        u = unif(hashed("net", "dataset_id", "copy", "row", repr(child)))
        on = f"m{s}.p = q.b_{parents[0]}" if parents else f"m{s}.p = 0"
        ctes.append(f"u{s} AS (SELECT *, {u} AS u FROM {prev})")
        ctes.append(f"r{s} AS (SELECT q.* EXCLUDE (u), {pick(f'm{s}.cdf', 'q.u')} AS b_{child} FROM u{s} AS q JOIN m{s} ON m{s}.dataset_id = q.dataset_id AND {on})")
        prev = f"r{s}"
    ws = ", ".join(f"{unif(hashed('net', 'dataset_id', 'copy', 'row', repr(c.name)), 1)} AS w_{c.name}" for c in META.numeric)
    ctes.append(f"z AS (SELECT *, {ws} FROM {prev})")
    vals = ", ".join(f"{value_of(c, f'b_{c.name}', f'w_{c.name}')} AS {c.name}" for c in META.columns)
    return "WITH " + ",\n".join(ctes) + f"\nSELECT dataset_id, row, {vals} FROM z"


# ---- features ---------------------------------------------------------------------------------------------------


def naive_parts() -> list[str]:
    out = []
    d = len(NAMES)
    for i, c in enumerate(META.columns):
        if c.numeric:
            for s, e in enumerate((f"avg({c.name})", f"quantile_cont(CAST({c.name} AS DOUBLE), 0.5)", f"var_samp({c.name})")):
                out.append(f"SELECT dataset_id, {s * d + i} AS feature_idx, CAST({e} AS DOUBLE) AS value FROM tab GROUP BY dataset_id")
        else:
            k = f"(SELECT dataset_id, {code(c.name, c.labels)} AS k, count(*) AS n FROM tab GROUP BY ALL)"
            for s, order in enumerate(("n DESC, k", "n, k")):
                out.append(f"SELECT dataset_id, {s * d + i} AS feature_idx, CAST(k AS DOUBLE) AS value FROM {k} QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY {order}) = 1")
            out.append(f"SELECT dataset_id, {2 * d + i}, CAST(count(*) AS DOUBLE) FROM {k} GROUP BY dataset_id")
    return out


def histogram_parts(offset: int = 0, by_count: bool = False, meta: TableMeta = META) -> list[str]:
    out, at = [], offset
    tables = "(SELECT DISTINCT dataset_id FROM tab)"
    for c in [*meta.numeric, *meta.discrete]:
        if c.numeric:
            e = [c.low + i * (c.high - c.low) / BINS for i in range(BINS)] + [c.high]
            b = f"CASE WHEN {c.name} >= {num(e[0])} AND {c.name} <= {num(e[-1])} THEN {steps(c.name, e[1:-1], '>')} END"
            size = BINS
        else:
            b, size = code(c.name, c.labels), len(c.labels)
        full = (
            f"SELECT dataset_id, d.bin, coalesce(n, 0) AS n FROM {tables} CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(0, {size})) AS d "
            f"LEFT JOIN (SELECT dataset_id, {b} AS bin, count(*) AS n FROM tab GROUP BY ALL) AS x USING (dataset_id, bin)"
        )
        pos = "bin"
        if by_count and c.numeric:
            pos = "row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC) - 1"
        out.append(f"SELECT dataset_id, {at} + {pos} AS feature_idx, CAST(n AS DOUBLE) AS value FROM ({full})")
        at += size
    return out


def indicators() -> list[str]:
    return [f"CAST({c.name} AS DOUBLE)" for c in META.numeric] + [
        f"CASE WHEN {c.name} = '{lab}' THEN 1e0 ELSE 0e0 END" for c in META.discrete for lab in c.labels[1:]
    ]


def corr_ctes() -> str:
    cols = indicators()
    enc = ", ".join(f"{e} AS x{i}" for i, e in enumerate(cols))
    pairs = ", ".join(f"corr(x{i}, x{j})" for i, j in combinations(range(len(cols)), 2))
    return f"enc AS (SELECT dataset_id, {enc} FROM tab), cor AS (SELECT dataset_id, [{pairs}] AS r FROM enc GROUP BY dataset_id)"


def corr_part(offset: int = 0) -> str:
    n = len(indicators())
    total = n * (n - 1) // 2
    return (
        f"SELECT dataset_id, {offset} + i - 1 AS feature_idx, CASE WHEN r[i] IS NULL OR isnan(r[i]) THEN 0e0 ELSE r[i] END AS value "
        f"FROM cor CROSS JOIN (SELECT range AS i FROM range(1, {total + 1}))"
    )


def feature_query(src: str, parts: list[str], names: list[str], ctes: str = "") -> str:
    base = POPN if src == "popn" else POP
    extra = f", {ctes}" if ctes else ""
    body = " UNION ALL ".join(parts)
    return (
        f"WITH {base}, {tab(src)}{extra}, f AS ({body}) SELECT dataset_id, CAST(feature_idx AS INTEGER) AS feature_idx, "
        f"{lst(names)}[CAST(feature_idx + 1 AS BIGINT)] AS feature_name, {tidy('value')} AS value FROM f"
    )


# ---- sanitising -------------------------------------------------------------------------------------------------


def imputed(src: str, cols, keys: str = "", extra: str = "id", modes: tuple = ()) -> str:
    """CTE ``imp``: nulls filled with the mode of labels (and of columns in ``modes``) and the median of numbers."""
    ctes, joins, outs = [], [], []
    k = f"{keys}, " if keys else ""
    for c in cols:
        if c in DISCRETE or c in modes:
            part = f"PARTITION BY {keys} " if keys else ""
            ctes.append(
                f"f_{c} AS (SELECT {k}{c} AS v FROM (SELECT {k}{c}, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY ALL) "
                f"QUALIFY row_number() OVER ({part}ORDER BY n DESC, {c}) = 1)"
            )
        else:
            ctes.append(f"f_{c} AS (SELECT {k}quantile_cont(CAST({c} AS DOUBLE), 0.5) AS v FROM {src}{' GROUP BY ' + keys if keys else ''})")
        on = f"f_{c}.{keys} = s.{keys}" if keys else "true"
        joins.append(f"LEFT JOIN f_{c} ON {on}")
        outs.append(f"coalesce(s.{c}, f_{c}.v) AS {c}")
    lead = f"s.{keys}, " if keys and keys not in extra else ""
    ctes.append(f"imp AS (SELECT {lead}{', '.join(f's.{e}' for e in extra.split(', '))}, {', '.join(outs)} FROM {src} AS s {' '.join(joins)})")
    return ", ".join(ctes)


def capped(src: str, cols, q: float | None, keep: str, keys: str = "", name: str = "cap") -> str:
    whole = ", ".join(f"CAST(trunc({c}) AS BIGINT) AS {c}" for c in cols)
    if q is None:
        return f"{name} AS (SELECT {keep}, {whole} FROM {src})"
    caps = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {q}) AS c_{c}" for c in cols)
    k = f"{keys}, " if keys else ""
    outs = ", ".join(f"CASE WHEN w.{c} > c_{c} THEN CAST(trunc(c_{c}) AS BIGINT) ELSE w.{c} END AS {c}" for c in cols)
    on = f"c.{keys} = w.{keys}" if keys else "true"
    kept = ", ".join(f"w.{x}" for x in keep.split(", "))
    return (
        f"whole AS (SELECT {keep}, {whole} FROM {src}), caps AS (SELECT {k}{caps} FROM whole{' GROUP BY ' + keys if keys else ''}), "
        f"{name} AS (SELECT {kept}, {outs} FROM whole AS w JOIN caps AS c ON {on})"
    )


def sanitised(src: str, k: int, keys: str = "") -> str:
    """The whole pipeline: fill, truncate and cap, bin the year, drop labels seen once, drop small groups."""
    nums = ["total", "balance"]
    keep = ("dataset_id, " if keys else "") + "id, status, priority, segment, region, year"
    by = f"{keys}, " if keys else ""
    ctes = [imputed(src, NAMES, keys, modes=("year",)), capped("imp", nums, 0.99, keep, keys)]
    ctes.append(f"lab AS (SELECT * REPLACE ({cut('year', META['year'].bins)} AS year) FROM cap)")
    cats = [*DISCRETE, "year"]
    rare = ", ".join(f"count(*) OVER (PARTITION BY {by}{c}) AS n_{c}" for c in cats)
    ctes.append(f"cnt AS (SELECT *, {rare} FROM lab)")
    ctes.append("com AS (SELECT * EXCLUDE (" + ", ".join(f"n_{c}" for c in cats) + ") FROM cnt WHERE " + " AND ".join(f"n_{c} > 1" for c in cats) + ")")
    ctes.append(f"san AS (SELECT * FROM com QUALIFY count(*) OVER (PARTITION BY {by}{', '.join(QUIDS)}) >= {k})")
    return ", ".join(ctes)


# ---- sampling ---------------------------------------------------------------------------------------------------


def drawn(src: str, n: str, draws: int, tag: str, name: str = "dr") -> str:
    """CTE ``name``: the images of the first ``n`` positions under a keyed Feistel permutation of the rows in order of id."""

    def turn(v: str) -> str:
        left, right = f"({v} >> half)", f"({v} & mask)"
        for i in range(4):
            mixed = f"(CAST(CAST(concat('0x', substr({hashed(tag, 'draw', str(i), right)}, 1, 12)) AS UBIGINT) AS BIGINT) & mask)"
            left, right = right, f"xor({left}, {mixed})"
        return f"(({left} << half) | {right})"

    walk = f"list_reduce(list_prepend({turn('i')}, list_transform(range(128), lambda z: 0::BIGINT)), lambda v, z: CASE WHEN v < total THEN v ELSE {turn('v')} END)"
    return (
        f"{name}_p AS (SELECT *, (1::BIGINT << half) - 1 AS mask FROM (SELECT count(*) AS total, greatest(1, (length(bin(greatest(count(*) - 1, 1))) + 1) // 2)::INTEGER AS half FROM {src})), "
        f"{name}_w AS (SELECT draw, {walk} AS pos FROM (SELECT CAST(range AS INTEGER) AS draw FROM range(0, {draws})), (SELECT unnest(range(0, {n})) AS i), {name}_p), "
        f"{name} AS (SELECT s.* EXCLUDE (pos), draw FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM {src}) AS s JOIN {name}_w USING (pos))"
    )


def targets(n: int, src: str = "pop") -> str:
    return f"{drawn(src, str(n), 1, 'targets', 'td')}, tg AS (SELECT * EXCLUDE (draw) FROM td)"


TENTH = "greatest(1, (SELECT count(*) // 10 FROM pop))"


def members(draws: int, tag: str, src: str = "pop") -> str:
    """CTE ``mem``: rows of all drawn tables with and without each of three targets."""
    return ", ".join(
        [
            targets(3, src),
            f"rest AS (SELECT * FROM {src} WHERE id NOT IN (SELECT id FROM tg))",
            drawn("rest", TENTH, draws, tag),
            "va AS (SELECT 'OUT' AS target UNION ALL SELECT CAST(id AS VARCHAR) FROM tg)",
            "mem AS (SELECT *, CAST(draw AS VARCHAR) || ':' || target AS dataset_id, CAST(target <> 'OUT' AS INTEGER) AS label FROM ("
            "SELECT dr.*, target FROM dr CROSS JOIN va UNION ALL SELECT tg.*, draw, CAST(tg.id AS VARCHAR) AS target FROM tg "
            f"CROSS JOIN (SELECT CAST(range AS INTEGER) AS draw FROM range(0, {draws}))))",
        ]
    )


# ---- results ----------------------------------------------------------------------------------------------------

LINK_FACTS = (
    "facts AS (SELECT status AS dataset, region AS target_id, segment AS model, priority AS feature_set, CAST(year AS VARCHAR) AS run, "
    "CAST(id % 2 AS INTEGER) AS secret, CAST(total > 250000 AS INTEGER) AS guess FROM pop)"
)
GAINS = (
    "g AS (SELECT dataset, target_id, model, feature_set, run, avg(CAST(guess = 1 AS INTEGER)) FILTER (WHERE secret = 1) AS tp, "
    "avg(CAST(guess = 1 AS INTEGER)) FILTER (WHERE secret = 0) AS fp FROM facts GROUP BY ALL), "
    "gain AS (SELECT *, tp - fp AS advantage_syn, 1e0 AS advantage_raw, 1e0 - (tp - fp) AS privacy_gain FROM g)"
)
GAIN_ROWS = "SELECT dataset, target_id, model, feature_set, run, " + ", ".join(
    f"coalesce(round({c}, 9), -9e0) AS {c}" for c in ("tp", "fp", "advantage_syn", "advantage_raw", "privacy_gain")
) + " FROM gain"

UTIL_FACTS = (
    "facts AS (SELECT status AS dataset, segment AS task, priority AS model, year AS run, CASE WHEN id % 2 = 0 THEN 'OUT' ELSE region END AS target_id, "
    "region AS record_id, CAST(CAST(total > balance * 50 AS INTEGER) AS DOUBLE) AS score, CAST(id % 2 AS INTEGER) AS presence FROM pop)"
)

INFERENCE = f"""WITH {POP}, base AS (SELECT status AS dataset, region AS target_id, year AS run,
  CASE WHEN priority = '{PRIORITY[0]}' THEN 'Raw' ELSE priority END AS model, id % 2 AS presence, segment, total FROM pop),
facts AS (SELECT dataset, target_id, 'segment' AS attribute, run, model, presence,
    CASE WHEN segment = {lst(SEGMENT)}[CAST(target_id AS BIGINT) + 1] THEN 1e0 ELSE 0e0 END AS score FROM base
  UNION ALL SELECT dataset, target_id, 'total', run, model, presence, least(total / 300000e0, 1e0) FROM base),
rates AS (SELECT dataset, target_id, attribute, run, model, avg(score) FILTER (WHERE presence = 1) AS p_in,
  avg(score) FILTER (WHERE presence = 0) AS p_out FROM facts GROUP BY ALL),
o AS (SELECT s.dataset, s.target_id, s.attribute, s.run, s.model, r.p_in AS p_raw_in, r.p_out AS p_raw_out, r.p_in - r.p_out AS advantage_raw,
  s.p_in AS p_syn_in, s.p_out AS p_syn_out, s.p_in - s.p_out AS advantage_syn FROM rates AS s JOIN rates AS r
  ON s.dataset = r.dataset AND s.target_id = r.target_id AND s.attribute = r.attribute AND s.run = r.run WHERE r.model = 'Raw' AND s.model <> 'Raw')
SELECT dataset, target_id, attribute, run, model, {', '.join(f'coalesce(round({c}, 9), -9e0) AS {c}' for c in ('p_raw_in', 'p_raw_out', 'advantage_raw', 'p_syn_in', 'p_syn_out', 'advantage_syn'))},
  coalesce(round(advantage_raw - advantage_syn, 9), -9e0) AS privacy_gain FROM o"""


def linked(value: str, none: str) -> str:
    binned = f"pb AS (SELECT * REPLACE ({cut('year', META['year'].bins)} AS year) FROM pop)"
    on = " AND ".join(f"t.{c} = g.{c}" for c in LINK_ON)
    n = "greatest(1, (SELECT count(*) // 4 FROM pop))"
    return (
        f"WITH {POP}, {binned}, {drawn('pb', n, 1, 'probe')}, g AS (SELECT {', '.join(LINK_ON)}, count(*) AS n, max(balance) AS v FROM pb GROUP BY ALL) "
        f"SELECT t.id, coalesce(g.n, 0) AS group_size, CASE WHEN g.n = 1 THEN {value} ELSE {none} END AS linked FROM dr AS t LEFT JOIN g ON {on}"
    )


def camel(x: str) -> str:
    def join(sep: str) -> str:
        return f"array_to_string(list_transform(string_split({x}, '{sep}'), lambda s: upper(s[1]) || lower(s[2:])), '')"

    return f"CASE WHEN contains({x}, '_') THEN {join('_')} WHEN contains({x}, '-') THEN {join('-')} ELSE {x} END"


# Names with a space get an underscore in SQL.
WIDE_PLAIN = TableMeta(tuple(replace(c, name=c.name.replace(" ", "_")) for c in WIDE.columns))
LINES = POP + """,
lines AS (
  SELECT pop.*, CAST(l_linenumber AS BIGINT) AS line, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         l_returnflag AS returned, l_linestatus AS line_status, CAST(month(l_shipdate) AS VARCHAR) AS ship_month, CAST(s_nationkey AS VARCHAR) AS supplier_nation
  FROM lineitem JOIN pop ON l_orderkey = id JOIN supplier ON l_suppkey = s_suppkey)"""


def wide_information() -> str:
    codes = ", ".join(f"{bin_code(c, True)} AS b_{c.name}" for c in WIDE_PLAIN.columns)
    nmi = "round(CASE WHEN hx + hy > 0 THEN 2 * mi / (hx + hy) ELSE 1e0 END, 9)"
    return (
        f"WITH {LINES}, coded AS (SELECT {codes} FROM lines), {information(WIDE_PLAIN.names)} "
        f"SELECT replace(a, '_', ' ') AS a, replace(b, '_', ' ') AS b, round(mi, 9) AS mi, {nmi} AS nmi FROM info"
    )


def wide_cells() -> str:
    """Counts of each cell of the histogram features, for one table for each kind of return."""
    return (
        f"WITH {LINES}, tab AS (SELECT *, returned AS dataset_id FROM lines), f AS ({' UNION ALL '.join(histogram_parts(meta=WIDE_PLAIN))}) "
        "SELECT dataset_id, CAST(feature_idx AS INTEGER) AS cell, CAST(value AS BIGINT) AS n FROM f"
    )


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    cols = ", ".join(NAMES)
    q["load_typed"] = f"WITH {POP} SELECT id, {cols} FROM pop"
    q["encode_codes"] = f"WITH {POPN} SELECT id, " + ", ".join(f"{code(c.name, c.labels, True)} AS {c.name}" for c in META.discrete) + " FROM popn"
    q["decode_codes"] = f"WITH {POPN} SELECT id, " + ", ".join(f"coalesce({n}, 'NaN') AS {n}" for n in DISCRETE) + " FROM popn"
    q["union_decode"] = f"WITH {POPN} SELECT id, " + ", ".join(f"coalesce({n}, 'NaN') AS {n}" for n in DISCRETE) + " FROM popn"
    all_cols = [*NAMES, "nation"]
    kinds = {c.name: c.kind for c in META.columns} | {"nation": "Categorical"}
    parts = []
    for i, n in enumerate(all_cols, 1):
        if n in NUMERIC:
            parts.append(f"SELECT {i} AS position, '{n}' AS name, '{kinds[n]}' AS type, CAST(min({n}) AS DOUBLE) AS low, CAST(max({n}) AS DOUBLE) AS high, 0 AS size, '' AS labels FROM pop")
        else:
            parts.append(
                f"SELECT {i}, '{n}', '{kinds[n]}', 0e0, 0e0, CAST(count(DISTINCT {n}) AS INTEGER), string_agg(DISTINCT {n}, '|' ORDER BY {n}) FROM pop"
            )
    q["infer_metadata"] = f"WITH {POP}, m AS (" + " UNION ALL ".join([parts[4], *parts[:4], *parts[5:]]) + ") SELECT * FROM m"
    q["train_test_filter"] = (
        f"WITH {POP} SELECT id, year, CASE WHEN year <= 1997 THEN 'train' ELSE 'test' END AS part FROM pop WHERE year IN (1995, 1996, 1997, 1998, 1999)"
    )
    q["results_json_roundtrip"] = f"WITH {POP}, {LINK_FACTS} SELECT dataset, target_id, model, run, feature_set, secret, guess, count(*) AS n FROM facts GROUP BY ALL"
    q["load_results_linkage"] = q["linkage_gain"] = f"WITH {POP}, {LINK_FACTS}, {GAINS} {GAIN_ROWS}"

    vec = []
    for c in META.columns:
        vec += [f"CAST({c.name} AS DOUBLE)"] if c.numeric else ([f"CAST({code(c.name, c.labels, True)} AS DOUBLE)"] if c.kind == "Ordinal" else onehot(c))
    q["encode_onehot"] = f"WITH {POPN} " + wide(vec, "id", "popn")
    scaled = []
    for c in META.columns:
        if c.name != "segment":
            scaled += [f"({c.name} - {num(c.low)}) / ({num(c.high)} + 1e-12)"] if c.numeric else onehot(c)
    q["encode_scaled"] = f"WITH {POP} " + wide(scaled, "id", "pop")
    spans = ", ".join(f"CAST(min({n}) OVER w AS DOUBLE) AS lo_{n}, CAST(max({n}) OVER w AS DOUBLE) AS hi_{n}" for n in NUMERIC)
    ranged = f"rng AS (SELECT *, {spans} FROM tab WINDOW w AS (PARTITION BY dataset_id))"
    inferred = []
    for c in META.columns:
        inferred += [f"({c.name} - lo_{c.name}) / (hi_{c.name} + 1e-8)"] if c.numeric else onehot(c)
    q["encode_inferred_ranges"] = f"WITH {POP}, {tab('pop')}, {ranged} " + wide(inferred, "dataset_id, id", "rng")

    def back(n: str) -> str:
        return f"(({n} - lo_{n}) / (hi_{n} + 1e-8) * (hi_{n} + 1e-8) + lo_{n})"

    q["decode_scaled"] = (
        f"WITH {POP}, {tab('pop')}, {ranged} SELECT dataset_id, id, {', '.join(DISCRETE)}, CAST(trunc({back('year')}) AS BIGINT) AS year, "
        f"round({back('total')}, 6) AS total, round({back('balance')}, 6) AS balance FROM rng"
    )
    q["bin_quids"] = f"WITH {POP} SELECT id, {cut('year', META['year'].bins)} AS year, {cut('total', META['total'].bins)} AS total FROM pop"
    edge = "lo + i * ((hi - lo) / 10e0)"
    parts = []
    for c in META.numeric:
        e = f"CASE WHEN i = 10 THEN hi ELSE {edge} END"
        e = f"trunc({e})" if c.kind == INTEGER else e
        parts.append(
            f"SELECT dataset_id, '{c.name}' AS attr, CAST(i AS INTEGER) AS pos, round({e}, 6) AS edge FROM (SELECT dataset_id, CAST(min({c.name}) AS DOUBLE) AS lo, "
            f"CAST(max({c.name}) AS DOUBLE) AS hi FROM tab GROUP BY dataset_id) CROSS JOIN (SELECT range AS i FROM range(0, 11))"
        )
    q["bin_edges"] = f"WITH {POP}, {tab('pop')} " + " UNION ALL ".join(parts)
    q["bin_encode"] = f"WITH {POPN}, b AS (SELECT id, " + ", ".join(f"{bin_code(c)} AS {c.name}" for c in META.columns) + " FROM popn) SELECT id, " + ", ".join(
        f"CAST(CASE WHEN {n} IS NULL OR {n} < 0 THEN -9 ELSE {n} END AS INTEGER) AS {n}" for n in NAMES
    ) + " FROM b"
    q["centre"] = f"WITH {POP}, {tab('pop')} SELECT dataset_id, id, " + ", ".join(
        f"round({n} - avg({n}) OVER (PARTITION BY dataset_id), 4) AS {n}" for n in ("total", "balance")
    ) + " FROM tab"
    q["camel_names"] = (
        "WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat_ws('_', p_type, p_brand, p_name) WHEN p_partkey % 3 = 1 THEN concat_ws('-', p_type, p_brand) "
        f"ELSE p_type END AS x FROM part) SELECT p_partkey, {camel('x')} AS name FROM s"
    )
    q["candidate_key"] = (
        f"WITH {POP}, s AS (SELECT count(*) AS n, min(total) AS lo, max(total) AS hi FROM pop) SELECT i AS row, i AS whole, "
        "round(lo + i * ((hi - lo) / n), 6) AS real, 'key' || CAST(i AS VARCHAR) AS text FROM s CROSS JOIN (SELECT range AS i FROM range(0, (SELECT n FROM s)))"
    )

    q["impute"] = f"WITH {POPN}, {tab('popn')}, {imputed('tab', ['segment', 'balance'], 'dataset_id')} SELECT dataset_id, id, segment, round(balance, 6) AS balance FROM imp"
    bare = tab("popn").replace("SELECT *", "SELECT * REPLACE (CASE WHEN status <> 'F' OR year % 2 <> 0 THEN total END AS total, CASE WHEN status <> 'F' OR year % 2 <> 0 THEN balance END AS balance)")
    q["impute_null_table"] = (
        f"WITH {POPN}, {bare}, {imputed('tab', ['segment', 'total', 'balance'], 'dataset_id')} "
        "SELECT dataset_id, id, segment, round(total, 6) AS total, round(balance, 6) AS balance FROM imp"
    )
    q["quantiles_refined"] = f"WITH {POPN}, {tab('popn')} SELECT dataset_id, " + ", ".join(
        f"round(quantile_cont(balance, {p}), 6) AS q{i}" for i, p in enumerate((0, 0.01, 0.25, 0.5, 0.9, 0.99, 1))
    ) + " FROM tab GROUP BY dataset_id"
    q["sanitise_cap"] = f"WITH {POP}, {tab('pop')}, {capped('tab', ['year', 'total', 'balance'], 0.99, 'dataset_id, id', 'dataset_id')} SELECT dataset_id, id, year, total, balance FROM cap"
    q["sanitise_drop"] = (
        f"WITH {POPN}, {imputed('popn', ['status', 'priority', 'segment', 'total', 'balance'])}, "
        f"{capped('imp', ['total', 'balance'], None, 'id, status, priority, segment')} SELECT id, status, priority, segment, total, balance FROM cap"
    )
    q["sanitise_rare"] = (
        f"WITH {POP}, c AS (SELECT id, nation, concat_ws('/', status, priority, segment, nation) AS cell FROM pop) SELECT id, cell FROM c "
        "QUALIFY count(*) OVER (PARTITION BY cell) > 4 AND count(*) OVER (PARTITION BY nation) > 4"
    )
    q["sanitise_k_anonymity"] = (
        f"WITH {POP} SELECT id, status, priority, segment, nation FROM pop QUALIFY count(*) OVER (PARTITION BY status, priority, segment, nation) >= 5"
    )
    q["sanitise_full"] = f"WITH {POPN}, {sanitised('popn', 9)} SELECT id, {cols} FROM san"

    q["sample_members"] = f"WITH {POP}, {drawn('pop', TENTH, 3, 'draw')} SELECT draw, id FROM dr"
    q["drop_targets"] = f"WITH {POP}, {targets(5)} SELECT id FROM pop WHERE id NOT IN (SELECT id FROM tg)"
    q["game_members"] = f"WITH {POP}, {members(2, 'game')} SELECT dataset_id, id, label FROM mem"
    q["shadow_members"] = f"WITH {POP}, {members(4, 'shadow')} SELECT dataset_id, draw, target, id, label FROM mem"
    q["new_categories"] = (
        f"WITH {POPN} SELECT DISTINCT 'priority' AS attr, priority AS label FROM popn WHERE priority NOT IN ({', '.join(repr(p) for p in PRIORITY[:3])}) "
        f"UNION ALL SELECT DISTINCT 'segment', segment FROM popn WHERE segment NOT IN ({', '.join(repr(p) for p in SEGMENT[1:])})"
    )

    dist = f"WITH {POPN}, {tab('popn')}, {counted_cells('tab', META, 'dataset_id')}, {shares('dataset_id')}"
    lo = "CASE attr " + " ".join(f"WHEN '{c.name}' THEN {lst([float(e) for e in c.edges(BINS)])}[bin + 1]" for c in META.numeric) + " END"
    hi = lo.replace("[bin + 1]", "[bin + 2]")
    q["hist_distribution"] = (
        f"{dist} SELECT dataset_id, attr, bin, round({lo}, 6) AS lo, round({hi}, 6) AS hi, n, round(prob, 9) AS prob FROM shares WHERE attr IN ({', '.join(repr(n) for n in NUMERIC)})"
    )
    lab = "CASE attr " + " ".join(f"WHEN '{c.name}' THEN {lst(c.labels)}[bin + 1]" for c in META.discrete) + " END"
    q["cat_distribution"] = (
        f"{dist} SELECT dataset_id, attr, bin, {lab} AS label, n, round(prob, 9) AS prob FROM shares WHERE attr IN ({', '.join(repr(n) for n in DISCRETE)})"
    )
    q["cdf"] = f"WITH {POP}, {counted_cells('pop', META)}, {shares()} SELECT attr, bin, round(cdf, 9) AS cdf FROM shares"
    parts = []
    for c in META.columns:
        e = c.edges(BINS) if c.numeric else [0.0]
        parts.append(
            f"SELECT '{c.name}' AS attr, {c.domain_size(BINS)} AS size, count(*) FILTER (WHERE b >= 0) AS total, count(*) FILTER (WHERE b IS NULL) AS nulls, "
            f"count(*) FILTER (WHERE b < 0) AS outside, round(count(*) FILTER (WHERE b IS NULL) / CAST(count(*) AS DOUBLE), 9) AS missing_rate, {num(e[0])} AS low, {num(e[-1])} AS high "
            f"FROM (SELECT {bin_code(c, True)} AS b FROM popn)"
        )
    q["attr_profile"] = f"WITH {POPN} " + " UNION ALL ".join(parts)
    q["freq_full_domain"] = (
        f"WITH {POP}, {CODED}, x AS (SELECT b_status AS c0, b_year AS c1, b_total AS c2, b_balance AS c3, count(*) AS n FROM coded GROUP BY ALL) "
        "SELECT CAST(a.range AS INTEGER) AS c0, CAST(b.range AS INTEGER) AS c1, CAST(c.range AS INTEGER) AS c2, CAST(d.range AS INTEGER) AS c3, coalesce(n, 0) AS n "
        "FROM range(0, 3) AS a CROSS JOIN range(0, 10) AS b CROSS JOIN range(0, 10) AS c CROSS JOIN range(0, 10) AS d "
        "LEFT JOIN x ON x.c0 = a.range AND x.c1 = b.range AND x.c2 = c.range AND x.c3 = d.range"
    )
    q["normalise"] = (
        f"WITH {POP}, v AS (SELECT segment, priority, greatest(sum(balance - 4450), 0) AS m FROM pop GROUP BY ALL) SELECT segment, priority, "
        "round(CASE WHEN sum(m) OVER w > 0 THEN m / sum(m) OVER w ELSE 1e0 / count(*) OVER w END, 9) AS prob FROM v WINDOW w AS (PARTITION BY segment)"
    )
    info = f"WITH {POP}, {CODED}, {information(INFO_COLUMNS)}"
    q["mi_pairs"] = f"{info} SELECT a, b, round(mi, 9) AS mi FROM info"
    q["nmi_pairs"] = f"{info} SELECT a, b, round(CASE WHEN hx + hy > 0 THEN 2 * mi / (hx + hy) ELSE 1e0 END, 9) AS nmi FROM info"
    parts = []
    for ch in INFO_COLUMNS:
        for p1, p2 in combinations([p for p in INFO_COLUMNS if p != ch], 2):
            parts.append(
                f"SELECT '{ch}' AS child, '{p1} {p2}' AS parents, b_{p1} * 100 + b_{p2} AS x, b_{ch} AS y, CAST(count(*) AS DOUBLE) AS n FROM coded GROUP BY ALL"
            )
    q["mi_degree2"] = (
        f"WITH {POP}, {CODED}, j AS (" + " UNION ALL ".join(parts) + ") SELECT child, parents, round(sum(n / nn * ln(n * nn / (nx * ny))), 9) AS mi FROM (SELECT *, "
        "sum(n) OVER (PARTITION BY child, parents, x) AS nx, sum(n) OVER (PARTITION BY child, parents, y) AS ny, sum(n) OVER (PARTITION BY child, parents) AS nn FROM j) GROUP BY child, parents"
    )
    delta_large = "(2e0 / n * ln((n + 1e0) / 2e0) + (1 - 1e0 / n) * ln(1 + 2e0 / (n - 1)))"
    delta_small = "(ln(n) / n + (n - 1e0) / n * ln(n / (n - 1e0)))"
    q["exp_mechanism"] = (
        f"{info}, s AS (SELECT a, b, mi / (2 * ({len(INFO_COLUMNS) - 1} * (CASE WHEN b = 'segment' THEN {delta_small} ELSE {delta_large} END) / 0.5e0)) AS score "
        "FROM info CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM pop)) SELECT a, b, round(score, 6) AS score, "
        "round(exp(score - max(score) OVER w) / sum(exp(score - mx)) OVER w, 9) AS prob FROM (SELECT *, max(score) OVER (PARTITION BY a) AS mx FROM s) WINDOW w AS (PARTITION BY a)"
    )

    hist_names, corr_names, naive_names = features.histogram_names(META), features.correlation_names(META), features.naive_names(META)
    nh, nn = len(hist_names), len(naive_names)
    q["feat_naive"] = feature_query("popn", naive_parts(), naive_names)
    q["feat_naive_array"] = (
        "WITH x AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT label, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, "
        "round(var_pop(x), 6) AS variance FROM x WHERE NOT isnan(x) GROUP BY label"
    )
    q["feat_histogram"] = feature_query("popn", histogram_parts(), hist_names)
    q["feat_histogram_sorted"] = feature_query("popn", histogram_parts(by_count=True), hist_names)
    q["feat_corr"] = feature_query("popn", [corr_part()], corr_names, corr_ctes())
    q["corr_features"] = f"WITH {POP} SELECT id, " + ", ".join(f"{e} AS v{i}" for i, e in enumerate(indicators())) + " FROM pop"
    q["feat_bayes"] = feature_query("pop", [*histogram_parts(), corr_part(nh)], hist_names + corr_names, corr_ctes())
    q["feat_ensemble"] = feature_query("pop", [*naive_parts(), *histogram_parts(nn), corr_part(nn + nh)], naive_names + hist_names + corr_names, corr_ctes())

    q["synth_hist"] = f"WITH {POP}, {counted_cells('pop', META)}, {shares()}, {histogram_rows('(SELECT count(*) FROM pop)')} SELECT row, {cols} FROM made"
    q["publish_roundtrip"] = (
        f"WITH {POP}, {tab('pop')}, {counted_cells('tab', META, 'dataset_id')}, {shares('dataset_id')}, {histogram_rows(TENTH, 'dataset_id')} "
        f"SELECT dataset_id, CAST(copy AS INTEGER) AS copy, row, {cols} FROM made"
    )
    q["bayes_structure"] = structure()
    ctes = [POP, CODED, *step_cells(), *[step_dist(s) for s in range(len(NETWORK))]]
    rows = " UNION ALL ".join(
        f"SELECT {s} AS step, '{c}' AS child, {repr('') if s == 0 else 'CAST(p AS VARCHAR)'} AS parent_codes, CAST(c AS INTEGER) AS bin, CAST(n AS BIGINT) AS n, round(prob, 9) AS prob FROM d{s}"
        for s, (c, _) in enumerate(NETWORK)
    )
    q["cpt_fit"] = "WITH " + ", ".join(ctes) + " " + rows
    q["synth_bayes"] = network_rows()
    q["synth_bayes_many"] = keyed_network_rows(TENTH)
    q["bayes_structure_degree2"] = searched(2, None)
    q["bayes_structure_private"] = searched(1, 1.0)
    q["bayes_structure_private_degree2"] = searched(2, 1.0)
    noisy = " UNION ALL ".join(f"SELECT {s} AS tab, concat(p, ' ', c) AS codes, round(n, 6) AS n FROM t{s}" for s in [0, *range(2, len(NETWORK))])
    q["privbayes_counts"] = "WITH " + ", ".join([POP, CODED, *step_cells(24.0)]) + " " + noisy
    q["synth_privbayes"] = network_rows(24.0)

    q["link_unique_member"] = linked("1", "0")
    q["link_unique_attribute"] = linked("g.v", "-99999e0")
    q["inference_gain"] = q["load_results_inference"] = INFERENCE
    q["utility_gain"] = (
        f"WITH {POP}, {UTIL_FACTS} SELECT dataset, task, model, run, target_id, record_id, round(avg(score), 9) AS accuracy, 'record' AS level FROM facts GROUP BY ALL "
        "UNION ALL SELECT dataset, task, model, run, target_id, 'all' AS record_id, round(avg(score), 9), 'total' FROM facts GROUP BY ALL"
    )
    q["wide_nmi_pairs"] = wide_information()
    q["wide_distribution"] = wide_cells()
    q["load_results_totals"] = (
        f"WITH {POP}, {UTIL_FACTS}, runs AS (SELECT dataset, task, model, run, target_id, avg(score) AS accuracy FROM facts GROUP BY ALL) "
        "SELECT dataset, 'RandomForestClassifier' AS prediction_model, task AS label_var, model, target_id, count(*) AS runs, "
        "round(avg(accuracy), 9) AS accuracy FROM runs GROUP BY ALL"
    )
    q["load_results_utility"] = (
        f"WITH {POP}, {UTIL_FACTS} SELECT dataset, task, model, run, target_id, record_id, round(avg(score), 9) AS accuracy FROM facts GROUP BY ALL"
    )
    q["utility_advantage"] = (
        f"WITH {POP}, {UTIL_FACTS} SELECT task, model, round(avg(score) FILTER (WHERE presence = 1), 9) AS p_in, round(avg(score) FILTER (WHERE presence = 0), 9) AS p_out, "
        "round(avg(score) FILTER (WHERE presence = 1) - avg(score) FILTER (WHERE presence = 0), 9) AS utility_advantage FROM facts GROUP BY ALL"
    )
    q["prob_removed"] = f"WITH {POP} SELECT segment, round(1 - avg(CAST(total > 250000 AS INTEGER)) FILTER (WHERE balance > 2000), 9) AS prob_removed FROM pop GROUP BY segment"
    q["mia_gain_alt"] = (
        f"WITH {POP}, {LINK_FACTS}, a AS (SELECT model, avg(CAST(guess = secret AS INTEGER)) AS accuracy FROM facts GROUP BY model) "
        "SELECT model, round(accuracy, 9) AS accuracy, round(2 * (1 - accuracy), 9) AS gain FROM a"
    )
    q["avg_privacy_gain"] = (
        f"WITH {POP}, {LINK_FACTS}, {GAINS} SELECT model, target_id, round(avg(privacy_gain), 9) AS privacy_gain, count(*) AS games FROM gain "
        f"WHERE feature_set = '{PRIORITY[0]}' GROUP BY ALL"
    )
    quants = ", ".join(f"round(quantile_cont(accuracy, {v}), 9) AS q{int(v * 1000)}" for v in (0.125, 0.25, 0.5, 0.75, 0.875))
    q["avg_accuracy"] = (
        f"WITH {POP}, t AS (SELECT priority AS model, segment AS label_var, (balance + 1000) / 11000e0 AS accuracy FROM pop WHERE id % 2 = 0) "
        f"SELECT model, label_var, round(avg(accuracy), 9) AS mean, {quants} FROM t GROUP BY ALL"
    )

    made = f"WITH {POP}, {members(2, 'shadow')}, {counted_cells('mem', META, 'dataset_id')}, {shares('dataset_id')}, " + histogram_rows(
        "greatest(1, (SELECT count(*) // 20 FROM pop))", "dataset_id", 2
    )
    q["shadow_data"] = f"{made} SELECT dataset_id, CAST(copy AS INTEGER) AS copy, row, {cols}, CAST(dataset_id NOT LIKE '%:OUT' AS INTEGER) AS label FROM made"
    q["shadow_data_sanitised"] = (
        f"WITH {POPN}, {members(2, 'shadow', 'popn')}, {sanitised('mem', 3, 'dataset_id')} SELECT dataset_id, id, {cols}, "
        "CAST(dataset_id NOT LIKE '%:OUT' AS INTEGER) AS label FROM san"
    )
    q["attack_knn"] = (
        "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), near AS (SELECT a.id, b.label FROM e AS a JOIN e AS b ON a.id <> b.id "
        "QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) <= 5), votes AS (SELECT id, label, count(*) AS n FROM near GROUP BY ALL) "
        "SELECT id, label AS prediction, round(n / CAST(sum(n) OVER (PARTITION BY id) AS DOUBLE), 6) AS confidence FROM votes "
        "QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1"
    )
    return q
