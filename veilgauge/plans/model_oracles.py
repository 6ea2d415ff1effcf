"""The registered queries that train models, in DuckDB SQL."""

from __future__ import annotations

from veilgauge.operators.gaussian import REGULARISER
from veilgauge.operators.mixtures import RIDGE
from veilgauge.plans.catalogue import digits
from veilgauge.plans.model_sql import best, factored, forest, forest_shares, linear, logistic, logistic_shares, mixture
from veilgauge.plans.oracles import DISCRETE, NAMES, POP, POPN, TENTH, code, hashed, histogram_parts, imputed, lst, num, onehot, tab, tidy, unif
from veilgauge.plans.population import META

TOL = num(1e-12)
EARLY, LATE = "year <= 1998", "year > 1998"


def _with(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes)


def _label(name: str) -> str:
    return code(name, META[name].labels)


def _codes(meta_names: list[str]) -> str:
    """Codes of labels and plain numbers, as attacks see them."""
    return "[" + ", ".join(f"CAST({n if META[n].numeric else code(n, META[n].labels, True)} AS DOUBLE)" for n in meta_names) + "]"


def _inputs(label: str, reference: bool = False) -> list[str]:
    """Scaled numbers and one-hot labels, as tasks see them; with ``reference`` without the first label of each column."""
    out = []
    for c in META.columns:
        if c.name != label:
            out += [f"(CAST({c.name} AS DOUBLE) - {num(c.low)}) / ({num(c.high)} + {TOL})"] if c.numeric else onehot(c)[1 if reference else 0 :]
    return out


def attribute_forest(keyed: bool, trees: int, depth: int) -> str:
    known = [n for n in NAMES if n != "segment"]
    k = "dataset_id" if keyed else "''"
    rows = [
        POP, tab("pop"),
        f"src AS (SELECT {k} AS k, CAST(id AS VARCHAR) AS row, {_codes(known)} AS x, {_label('segment')} AS y FROM tab WHERE {EARLY})",
        f"asked AS (SELECT {k} AS k, CAST(id AS VARCHAR) AS row, {_codes(known)} AS x FROM tab WHERE {LATE})",
    ]
    ctes = [*rows, *forest("src", len(known), 5, trees, depth, keyed), *forest_shares("asked", len(known), 5, trees, depth)]
    key = "dataset_id, " if keyed else ""
    on = "probs.k = tab.dataset_id AND " if keyed else ""
    guess = f"{lst(META['segment'].labels)}[{best('probs')} + 1]"
    return (
        _with(*ctes) + f"\nSELECT {key}id, {guess} AS model_guess, CASE WHEN probs IS NOT NULL THEN round(coalesce(probs[{_label('segment')} + 1], 0e0) + 1e-9, 6) END AS likelihood "
        f"FROM tab LEFT JOIN probs ON {on}probs.row = CAST(tab.id AS VARCHAR) WHERE {LATE}"
    )


def _attack_tables() -> list[str]:
    early = "split_part(dataset_id, '-', 2) <= '1995'"
    return [
        POP, "tab AS (SELECT *, region || '-' || CAST(year AS VARCHAR) || '-' || priority || '-' || CAST(id % 4 AS VARCHAR) AS dataset_id FROM pop)",
        f"f AS ({' UNION ALL '.join(histogram_parts())})",
        "lab AS (SELECT dataset_id, CAST(max(CAST(status = 'P' AS INTEGER)) AS INTEGER) AS label FROM tab GROUP BY dataset_id)",
        "vec AS (SELECT dataset_id, label, list(value ORDER BY feature_idx) AS x FROM f JOIN lab USING (dataset_id) GROUP BY ALL)",
        f"src AS (SELECT '' AS k, dataset_id AS row, x, label AS y FROM vec WHERE {early})",
        f"asked AS (SELECT '' AS k, dataset_id AS row, x FROM vec WHERE NOT ({early}))",
    ]


WIDTH = sum(10 if c.numeric else len(c.labels) for c in META.columns)
P_IN = "probs[2]"
GUESS = f"CAST(round({P_IN}, 9) > 0.5 AS INTEGER)"
CONFIDENCE = f"round(CASE WHEN label = 1 THEN {P_IN} ELSE 1 - {P_IN} END + 1e-9, 5)"


def attack(kind: str, out: str) -> str:
    if kind == "forest":
        ctes = [*_attack_tables(), *forest("src", WIDTH, 2, 20, 8), *forest_shares("asked", WIDTH, 2, 20, 8)]
    else:
        ctes = [*_attack_tables(), *logistic("src", WIDTH, 2, 10), *logistic_shares("asked", WIDTH, 2, 10)]
    head = _with(*ctes, recursive=kind != "forest")
    table = "FROM vec JOIN probs ON probs.row = vec.dataset_id"
    if out == "confidence":
        return f"{head}\nSELECT dataset_id, label, {CONFIDENCE} AS confidence {table}"
    if out == "linkage":
        single = "list_sum(x[-5:]) = 1"
        return f"{head}\nSELECT dataset_id, label, CASE WHEN {single} THEN 1 ELSE {GUESS} END AS guess, CASE WHEN {single} THEN 'linkage' ELSE 'model' END AS guess_source {table}"
    return f"{head}\nSELECT dataset_id, label, {GUESS} AS guess, 'model' AS guess_source {table}"


def knn_attack() -> str:
    near = (
        "near AS (SELECT a.row, s.y FROM asked AS a JOIN src AS s ON true QUALIFY row_number() OVER (PARTITION BY a.row "
        "ORDER BY list_sum(list_transform(list_zip(a.x, s.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), s.row) <= 5)"
    )
    return (
        _with(*_attack_tables(), near, "votes AS (SELECT row, avg(y) AS p FROM near GROUP BY row)")
        + "\nSELECT dataset_id, label, CAST(p > 0.5 AS INTEGER) AS guess, 'model' AS guess_source FROM vec JOIN votes ON votes.row = vec.dataset_id"
    )


def task(kind: str, label: str, keyed: bool, **o) -> str:
    """Trained on early records, or on those of each region, with nulls filled by training values; scored on late records."""
    key = "dataset_id" if keyed else ""
    pop = POPN + ", popr AS (SELECT *, region AS dataset_id FROM popn)"
    fills = ["dataset_id"] if keyed else []
    train = f"trn AS (SELECT * FROM popr WHERE {EARLY})"
    fill = imputed("trn", NAMES, key, "id, dataset_id" if not keyed else "dataset_id, id")
    # Every late record under the fills of every table.
    values = ", ".join(f"coalesce(t.{c}, f_{c}.v) AS {c}" for c in NAMES if c != label)
    joins = " ".join(f"LEFT JOIN f_{c} ON {f'f_{c}.dataset_id = g.dataset_id' if keyed else 'true'}" for c in NAMES if c != label)
    groups = "(SELECT DISTINCT dataset_id FROM trn)" if keyed else "(SELECT '' AS dataset_id)"
    late = f"tst AS (SELECT g.dataset_id AS k, t.id, t.{label}, {values} FROM popr AS t CROSS JOIN {groups} AS g {joins} WHERE t.{LATE})"
    k = "dataset_id" if keyed else "''"
    x = _inputs(label, kind == "linear")
    y = f"CAST({label} AS DOUBLE)" if kind == "linear" else _label(label)
    ctes = [pop, train, fill, late]
    if kind == "linear":
        ctes += [f"src AS (SELECT {k} AS k, {', '.join(f'{e} AS x{i}' for i, e in enumerate(x))}, {y} AS y FROM imp)", *linear("src", [f"x{i}" for i in range(len(x))], "y")]
        guess = "my + list_dot_product(beta, list_transform(list_zip([" + ", ".join(x) + "], means), lambda p: p[1] - p[2]))"
        ctes.append(f"scores AS (SELECT k, id, {label} - ({guess}) AS score FROM tst JOIN lin USING (k))")
    else:
        classes = len(META[label].labels)
        ctes += [f"src AS (SELECT {k} AS k, CAST(id AS VARCHAR) AS row, [{', '.join(x)}] AS x, {y} AS y FROM imp)", f"asked AS (SELECT k, CAST(id AS VARCHAR) AS row, [{', '.join(x)}] AS x FROM tst)"]
        if kind == "forest":
            ctes += [*forest("src", len(x), classes, o["trees"], o["depth"], keyed), *forest_shares("asked", len(x), classes, o["trees"], o["depth"])]
        else:
            ctes += [*logistic("src", len(x), classes, o["steps"]), *logistic_shares("asked", len(x), classes, o["steps"])]
        ctes.append(f"scores AS (SELECT tst.k, id, CAST({best('probs')} = {y} AS INTEGER)::DOUBLE AS score FROM tst JOIN probs ON probs.k = tst.k AND probs.row = CAST(tst.id AS VARCHAR))")
    head = _with(*ctes, recursive=kind != "forest")
    if not keyed:
        return f"{head}\nSELECT id, round(score, 2) AS score FROM scores"
    return (
        f"{head}\nSELECT k AS dataset_id, 'all' AS record, round(sum(score), 1) AS score, count(*)::BIGINT AS n FROM scores GROUP BY k "
        "UNION ALL SELECT k, CAST(id AS VARCHAR), round(score, 1), 0 FROM scores WHERE id % 100 = 0"
    )


NUMBERS = META.numeric
SPANS = [c.high - c.low for c in NUMBERS]
MIDDLES = [(c.low + c.high) / 2 for c in NUMBERS]


def _mixtures(steps: int) -> list[str]:
    scaled = ", ".join(f"(CAST({c.name} AS DOUBLE) - {num(m)}) / {num(w)} AS x{i}" for i, (c, m, w) in enumerate(zip(NUMBERS, MIDDLES, SPANS)))
    src = f"src AS (SELECT dataset_id AS k, id, {scaled} FROM tab WHERE {' AND '.join(f'{c.name} IS NOT NULL' for c in NUMBERS)})"
    return [POPN, tab("popn"), src, *mixture("src", len(NUMBERS), 2, steps, RIDGE)]


def mixtures(steps: int) -> str:
    means = ", ".join(f"round(m{i} * {num(SPANS[i])} + {num(MIDDLES[i])}, 3) AS mean_{c.name}" for i, c in enumerate(NUMBERS))
    sds = ", ".join(f"round(sqrt(s{i}_{i}) * {num(SPANS[i])}, 3) AS sd_{c.name}" for i, c in enumerate(NUMBERS))
    return _with(*_mixtures(steps)) + f"\nSELECT k AS dataset_id, n, round(fit, 7) AS fit, c AS component, round(w, 7) AS weight, {means}, {sds} FROM mx{steps}"


def _normals(keys: list[str]) -> str:
    """Numeric columns of a generated row from means ``m<i>`` and factors ``l<i>_<j>``."""
    parts = []
    for c in NUMBERS:
        h = hashed("normal", *keys, "copy", "row", f"'{c.name}'")
        parts.append(f"sqrt(-2 * ln(1 - {unif(h)})) * cos(2 * pi() * {unif(h, 1)})")
    return ", ".join(f"round(m{i}" + "".join(f" + l{i}_{j} * {parts[j]}" for j in range(i + 1)) + f", {digits(c)}) AS {c.name}" for i, c in enumerate(NUMBERS))


def gaussian_rows() -> str:
    d = len(NUMBERS)
    cov = ", ".join(f"covar_pop({NUMBERS[i].name}, {NUMBERS[j].name}) + {num(REGULARISER) if i == j else '0e0'} AS s{i}_{j}" for i in range(d) for j in range(i + 1))
    means = ", ".join(f"avg({c.name}) AS m{i}" for i, c in enumerate(NUMBERS))
    rows = "(SELECT 0 AS copy, range AS row FROM range(0, (SELECT count(*) FROM pop)))"
    return _with(POP, f"mom AS (SELECT *, {factored(d)} FROM (SELECT {means}, {cov} FROM pop))") + f"\nSELECT copy, row, {_normals([])} FROM {rows}, mom"


def mixture_rows(steps: int) -> str:
    d = len(NUMBERS)
    means = ", ".join(f"m{i} * {num(SPANS[i])} + {num(MIDDLES[i])} AS m{i}" for i in range(d))
    cov = ", ".join(f"s{i}_{j} * {num(SPANS[i] * SPANS[j])} + {num(REGULARISER) if i == j else '0e0'} AS s{i}_{j}" for i in range(d) for j in range(i + 1))
    parts = f"parts AS (SELECT *, {factored(d)} FROM (SELECT k, c, w, sum(w) OVER (PARTITION BY k ORDER BY c) AS cdf, {means}, {cov} FROM mx{steps}))"
    rows = f"ask AS (SELECT k, 0 AS copy, range AS row FROM (SELECT DISTINCT k FROM parts), range(0, {TENTH}))"
    u = unif(hashed("component", "k", "copy", "row", "'component'"))
    which = f"which AS (SELECT k, copy, row, {u} >= cdf AS second FROM ask JOIN parts USING (k) WHERE c = 0)"
    return (
        _with(*_mixtures(steps), parts, rows, which)
        + f"\nSELECT k AS dataset_id, copy, row, {_normals(['k'])} FROM which JOIN parts USING (k) WHERE c = CAST(second AS INTEGER)"
    )


def linear_attack() -> list[str]:
    known = [n for n in NAMES if n != "total"]
    values = ", ".join(f"CAST({n if META[n].numeric else code(n, META[n].labels, True)} AS DOUBLE) AS x{i}" for i, n in enumerate(known))
    names = [f"x{i}" for i in range(len(known))]
    return [
        POP, tab("pop"), f"src AS (SELECT dataset_id AS k, id, total, {values} FROM tab)", *linear("src", names, "total"),
        f"fit AS (SELECT k, beta, means, my, n, rest / (n - {len(known)}) AS sigma FROM lin)",
        f"p AS (SELECT k, id, total, sigma, my + list_dot_product(beta, list_transform(list_zip([{', '.join(names)}], means), lambda q: q[1] - q[2])) AS guess FROM src JOIN fit USING (k))",
    ]


def oracle_sql() -> dict[str, str]:
    known = [n for n in NAMES if n != "total"]
    slopes = ", ".join(f"round(beta[{i + 1}], 4) AS slope_{n}" for i, n in enumerate(known))
    soft = (
        "mar AS (SELECT dataset_id AS k, (total - 250000) / 100000 + balance / 5000 AS m, CAST(priority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS y FROM tab), "
        "siz AS (SELECT k, sum(y) AS n1, count(*) AS n FROM mar GROUP BY k), "
        "sft AS (SELECT k, [m] AS x, CASE WHEN y = 1 THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n - n1 + 2) END AS t FROM mar JOIN siz USING (k) WHERE n1 > 0 AND n1 < n), "
        "src AS (SELECT k, x, 1 AS y, t AS wt FROM sft UNION ALL SELECT k, x, 0, 1 - t FROM sft)"
    )
    return {
        "attr_forest": attribute_forest(False, 10, 5),
        "attr_forest_many": attribute_forest(True, 10, 5),
        "mia_train_rf": attack("forest", "guess"),
        "mia_attack": attack("forest", "linkage"),
        "mia_confidence": attack("forest", "confidence"),
        "mia_train_logreg": attack("logistic", "guess"),
        "mia_confidence_logreg": attack("logistic", "confidence"),
        "mia_train_knn": knn_attack(),
        "util_forest": task("forest", "segment", False, trees=20, depth=8),
        "util_logreg": task("logistic", "segment", False, steps=6),
        "util_linreg": task("linear", "total", False),
        "util_forest_many": task("forest", "segment", True, trees=10, depth=5),
        "util_logreg_many": task("logistic", "priority", True, steps=6),
        "util_linreg_many": task("linear", "total", True),
        "attr_linreg": _with(*linear_attack(), recursive=True)
        + "\nSELECT k AS dataset_id, id, round(guess, 2) AS guess, round(exp(-(total - guess) * (total - guess) / (2 * sigma)) / sqrt(2 * pi() * sigma) * 1e6, 5) AS likelihood FROM p",
        "linreg_sigma": _with(*linear_attack(), recursive=True) + f"\nSELECT k AS dataset_id, {slopes}, {tidy('my')} AS mean, {tidy('sigma / 1e6')} AS sigma FROM fit",
        "synth_gaussian": gaussian_rows(),
        "mixture_many": mixtures(6),
        "synth_mixture_many": mixture_rows(6),
        "svc_calibration": _with(POP, tab("pop"), soft, *logistic("src", 1, 2, 10, 0.0, "wt"), recursive=True)
        + "\nSELECT k AS dataset_id, round(w[3], 6) AS slope, round(w[4], 6) AS offset FROM w10",
    }
