"""SQL that trains the models of the registered queries from the fact, split by split, and scores with them."""

from __future__ import annotations

import math

from checks.oracles import (
    _CATS, _LAG_NAMES, _LAGS, _ROLL_NAMES, _rolling, FACT, PRICED_B, REORDER_B, ROW, NAIVE, ORACLES, finish, forecast, put, rnd,
)
from stockloom.operators.stacking import COLUMNS, MODELS, QUICK, base_learners
from stockloom.operators.trees import GRID, HASH, Learner

KEYS = "sale_date, store_id, product_id"
DIGEST = "md5(concat_ws('|', CAST(sale_date AS VARCHAR), store_id, product_id))"
CALENDAR = """CAST(isodow(sale_date) - 1 AS INT) AS day_of_week, day(sale_date) AS day_of_month, month(sale_date) AS month,
    quarter(sale_date) AS quarter, year(sale_date) AS year, CASE WHEN isodow(sale_date) >= 6 THEN 1 ELSE 0 END AS is_weekend"""
LEARNERS = {lr.name: lr for lr in base_learners(QUICK)}


def _value(c: str) -> str:
    """A model column as a number: deviations in four digits, classes by index or mean."""
    if c.endswith("_mean") and c[:-5] in _CATS:
        return c
    if c in _CATS:
        return f"{c}_index"
    return f"round({c}, 4)" if "_std_" in c else c


# rows of three kinds: head (trained on), tail (validated on), ask (the day after the latest of each series)
ROWS = FACT + f""",
extended AS (
  SELECT *, 0 AS ask FROM retail_fact
  UNION ALL
  SELECT * REPLACE (CAST(sale_date + INTERVAL 1 DAY AS DATE) AS sale_date, NULL AS units_sold), 1 FROM retail_fact
  QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY sale_date DESC) = 1
),
series AS (SELECT *, {_LAGS}, {_rolling(-1)}, {CALENDAR} FROM extended),
complete AS (SELECT * FROM series WHERE ask = 1 OR ({" AND ".join(f"{c} IS NOT NULL" for c in _LAG_NAMES + _ROLL_NAMES)})),
train_days AS (SELECT sale_date, sum(count(*)) OVER (ORDER BY sale_date) - count(*) AS before FROM complete WHERE ask = 0 GROUP BY sale_date),
cut AS (SELECT max(sale_date) AS last_day FROM train_days WHERE before < (SELECT floor(count(*) * {QUICK.train_share}) FROM complete WHERE ask = 0)),
kinds AS MATERIALIZED (
  SELECT *, CASE WHEN ask = 1 THEN 'ask' WHEN sale_date <= (SELECT last_day FROM cut) THEN 'head' ELSE 'tail' END AS kind,
    CAST(floor(ln(1 + least(greatest(units_sold, 0), 1000)) * {GRID}.0 + 0.5) AS BIGINT) AS target,
    CAST('0x' || substr({DIGEST}, 1, 7) AS BIGINT) AS hash, row_number() OVER (ORDER BY {KEYS}) AS rid
  FROM complete
),
prior AS MATERIALIZED (SELECT floor(CAST(sum(target) AS DOUBLE) / count(*) + 0.5) AS p FROM kinds WHERE kind = 'head'),
classes AS MATERIALIZED (
  SELECT c, label, row_number() OVER (PARTITION BY c ORDER BY label) - 1 AS i FROM (
    {" UNION ".join(f"SELECT '{c}' AS c, {c} AS label FROM kinds WHERE ask = 0" for c in _CATS)})
),
means AS MATERIALIZED (
  SELECT c, label, (sum(target) + any_value(p)) / (count(*) + 1) AS mean FROM (
    {" UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS label, target FROM kinds WHERE kind = 'head'" for c in _CATS)}), prior GROUP BY c, label
),
encoded AS (
  SELECT k.*, {", ".join(f"coalesce(i_{c}.i, 0) AS {c}_index" for c in _CATS)}, {", ".join(
      f'''CASE WHEN kind = 'head' THEN (coalesce(sum(target) OVER (PARTITION BY kind, {c} ORDER BY {DIGEST}, {KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + p)
      / (count(*) OVER (PARTITION BY kind, {c} ORDER BY {DIGEST}, {KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1) ELSE coalesce(m_{c}.mean, p) END AS {c}_mean'''
      for c in _CATS)}
  FROM kinds k, prior {" ".join(f"LEFT JOIN classes i_{c} ON i_{c}.c = '{c}' AND i_{c}.label = k.{c} LEFT JOIN means m_{c} ON m_{c}.c = '{c}' AND m_{c}.label = k.{c}" for c in _CATS)}
),
listed AS MATERIALIZED (
  SELECT rid, kind, target, hash, [{", ".join(f"coalesce(CAST({_value(c)} AS DOUBLE), 0.0)" for c in COLUMNS)}] AS vs FROM encoded
),
long AS MATERIALIZED (SELECT rid, kind, unnest(range({len(COLUMNS)})) AS f, unnest(vs) AS v FROM listed),
placed AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS place, count(*) OVER (PARTITION BY f) AS n FROM long WHERE kind = 'head'),
edges AS MATERIALIZED (
  SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS i
  FROM (SELECT DISTINCT f, v FROM placed, range(1, {QUICK.bins}) t(k) WHERE place = n * k // {QUICK.bins})
),
rows_ AS MATERIALIZED (
  SELECT rid, any_value(kind) AS kind, any_value(target) AS target, any_value(hash) AS hash, list(bin ORDER BY f) AS bins FROM (
    SELECT x.rid, x.f, coalesce(e.i + 1, 0) AS bin FROM long x ASOF LEFT JOIN edges e ON x.f = e.f AND x.v > e.v)
  JOIN listed USING (rid) GROUP BY rid
)"""


def _shrunk(g: str, lr: Learner) -> str:
    g = f"CAST({g} AS DOUBLE)"
    return g if not lr.l1 else f"(sign({g}) * greatest(abs({g}) - {lr.l1 * GRID!r}::DOUBLE, 0.0))"


def _score(g: str, n: str, lr: Learner) -> str:
    t, weight = _shrunk(g, lr), f"(CAST({n} AS DOUBLE) + {lr.l2!r}::DOUBLE)"
    return f"CASE WHEN {weight} > 0 THEN {t} * {t} / {weight} ELSE 0.0 END"


def _leaf(lr: Learner) -> str:
    rate = lr.rate if lr.boosted else 1.0
    return f"CAST(floor(-{rate!r}::DOUBLE * {_shrunk('sum(w * g)', lr)} / (sum(w) + {lr.l2!r}::DOUBLE) + 0.5) AS BIGINT)"


def _bag(tree: str) -> str:
    return f"((hash * (2654435 * (2 * {tree} + 1) % {HASH}) + 12345 * {tree}) % {HASH})"


def _poisson_steps() -> list[int]:
    total, p, out = 0.0, math.exp(-1.0), []
    for k in range(8):
        total, p = total + p, p / (k + 1)
        out.append(math.floor(total * HASH))
    return out


def _allowed(lr: Learner, trees: range) -> str:
    """Which columns a tree may use: tree, column of the row, place among the learner's features."""
    rows = [f"({t}, {COLUMNS.index(lr.features[i])}, {i})" for t in trees for i in lr.tree_features(t)]
    return f"(VALUES {', '.join(rows)}) AS allowed(tree, f, pos)"


def _step(out: list[str], lr: Learner, name: str, source: str, base: str, trees: range, one: bool) -> None:
    """CTEs ``<name>s`` (the splits of a step) and ``<name>`` (each row's node after it)."""
    per = "" if one else "tree, node"
    group = "tree, node, pos"
    out.append(f"""{name}c AS MATERIALIZED (
  SELECT {group}, any_value(f) AS f, bin, sum(w * g) AS g, sum(w) AS n FROM (
    SELECT a.tree, a.node, r.w, r.g, unnest(range({len(COLUMNS)})) AS f, unnest(x.bins) AS bin
    FROM {source} a JOIN {base} r ON a.rid = r.rid AND a.tree = r.tree JOIN rows_ x ON a.rid = x.rid WHERE x.kind = 'head' AND r.w > 0)
  JOIN {_allowed(lr, trees)} USING (tree, f) GROUP BY {group}, bin)""")
    if lr.policy == "symmetric":
        grid = f"""(SELECT tree, node, pos, f, b AS bin FROM (SELECT DISTINCT tree, node, pos, f FROM {name}c), range({QUICK.bins}) t(b))"""
        summed = f"SELECT tree, node, pos, f, bin, coalesce(g, 0) AS g, coalesce(n, 0) AS n FROM {grid} LEFT JOIN {name}c USING (tree, node, pos, f, bin)"
    else:
        summed = f"SELECT * FROM {name}c"
    out.append(f"""{name}g AS MATERIALIZED (
  SELECT *, CASE WHEN ln >= {lr.least_leaf} AND n - ln >= {lr.least_leaf} AND n >= {lr.least_split} THEN
    {_score('lg', 'ln', lr)} + {_score('g - lg', 'n - ln', lr)} - {_score('g', 'n', lr)} ELSE 0.0 END AS gain
  FROM (SELECT {group}, f, bin, sum(g) OVER (PARTITION BY {group} ORDER BY bin) AS lg, sum(n) OVER (PARTITION BY {group} ORDER BY bin) AS ln,
    sum(g) OVER (PARTITION BY {group}) AS g, sum(n) OVER (PARTITION BY {group}) AS n FROM ({summed})))""")
    if lr.policy == "symmetric":
        out.append(f"""{name}s AS MATERIALIZED (
  SELECT a.tree, a.node, b.f, b.bin AS cut FROM (SELECT DISTINCT tree, node FROM {source}n) a,
    (SELECT f, pos, bin, sum(gain ORDER BY node) AS gain FROM {name}g GROUP BY f, pos, bin ORDER BY gain DESC, pos, bin LIMIT 1) b WHERE b.gain > 0)""")
    else:
        order = f"PARTITION BY {per}" if per else ""
        out.append(f"""{name}s AS MATERIALIZED (
  SELECT tree, node, f, bin AS cut FROM {name}g WHERE gain > 0 QUALIFY row_number() OVER ({order} ORDER BY gain DESC, node, pos, bin) = 1)""")
    out.append(f"""{name} AS MATERIALIZED (
  SELECT a.rid, a.tree, CASE WHEN s.node IS NULL THEN a.node ELSE 2 * a.node + CAST(x.bins[s.f + 1] > s.cut AS INT) END AS node
  FROM {source} a JOIN rows_ x USING (rid) LEFT JOIN {name}s s ON a.tree = s.tree AND a.node = s.node)""")
    out.append(f"""{name}n AS MATERIALIZED (
  SELECT n.tree, CASE WHEN s.node IS NULL THEN n.node ELSE 2 * n.node + side END AS node
  FROM {source}n n LEFT JOIN {name}s s USING (tree, node), range(2) t(side) WHERE side = 0 OR s.node IS NOT NULL)""")


def grown(lr: Learner) -> list[str]:
    """CTEs that fit a learner: ``<model>_nodes`` and ``<model>_margin``."""
    out: list[str] = []
    m = lr.name
    tables: list[str] = []
    rounds = [range(t, t + 1) for t in range(lr.trees)] if lr.boosted else [range(lr.trees)]
    margin = f"{m}_m0"
    start = "(SELECT CAST(p AS BIGINT) FROM prior)" if lr.boosted else "0"
    out.append(f"{margin} AS MATERIALIZED (SELECT rid, {start} AS margin FROM rows_)")
    for number, trees in enumerate(rounds):
        base, at = f"{m}_r{number}", f"{m}_a{number}"
        if lr.boosted:
            weight = "1" if lr.row_share >= 1 else f"CAST({_bag('tree')} < {math.floor(lr.row_share * HASH)} AS INT)"
        else:
            weight = " + ".join(f"CAST({_bag('tree')} >= {x} AS INT)" for x in _poisson_steps())
        out.append(f"""{base} AS MATERIALIZED (
  SELECT rid, tree, {'margin' if lr.boosted else '0'} - target AS g, {weight} AS w FROM {margin} JOIN rows_ USING (rid), range({trees.start}, {trees.stop}) t(tree))""")
        out.append(f"{at} AS MATERIALIZED (SELECT rid, tree, 1 AS node FROM {base})")
        out.append(f"{at}n AS MATERIALIZED (SELECT tree, 1 AS node FROM range({trees.start}, {trees.stop}) t(tree))")
        splits = []
        for step in range(lr.leaves - 1 if lr.policy == "leaf" else lr.depth):
            name = f"{at}_{step}"
            _step(out, lr, name, at if step == 0 else f"{m}_a{number}_{step - 1}", base, trees, lr.policy == "leaf")
            splits.append(f"SELECT * FROM {name}s")
        last = f"{at}_{len(splits) - 1}"
        out.append(f"""{at}l AS MATERIALIZED (
  SELECT n.tree, n.node, coalesce(v, 0) AS value, coalesce(k, 0) AS rows FROM {last}n n LEFT JOIN (
    SELECT a.tree, a.node, {_leaf(lr)} AS v, sum(w) AS k FROM {last} a JOIN {base} r ON a.rid = r.rid AND a.tree = r.tree JOIN rows_ x ON a.rid = x.rid
    WHERE x.kind = 'head' AND w > 0 GROUP BY a.tree, a.node) USING (tree, node))""")
        out.append(f"""{at}t AS MATERIALIZED (
  SELECT tree, node, f, cut, 0 AS value, (SELECT sum(l.rows) FROM {at}l l WHERE l.tree = s.tree AND l.node >> CAST(floor(log2(l.node)) - floor(log2(s.node)) AS INT) = s.node
    AND l.node > s.node) AS rows
  FROM ({' UNION ALL '.join(splits)}) s UNION ALL SELECT tree, node, NULL, NULL, value, rows FROM {at}l)""")
        tables.append(f"SELECT * FROM {at}t")
        margin = f"{m}_m{number + 1}"
        out.append(f"""{margin} AS MATERIALIZED (
  SELECT rid, any_value(p.margin) + CAST(sum(value) AS BIGINT) AS margin FROM {last} a JOIN {at}l l USING (tree, node) JOIN {m}_m{number} p USING (rid) GROUP BY rid)""")
    out.append(f"{m}_nodes AS MATERIALIZED ({' UNION ALL '.join(tables)})")
    share = f" / {lr.trees}.0" if not lr.boosted else ""
    out.append(f"{m}_out AS (SELECT rid, exp(margin{share} / {GRID}.0) - 1 AS {m} FROM {margin})")
    return out


def solved(source: str, inputs: tuple[str, ...], label: str, alpha: float, name: str = "solved") -> str:
    """A CTE of the ridge's one row: the normal equations by elimination without pivots, ``k0, k1, …`` and ``intercept``."""
    n = len(inputs)
    sums = ", ".join(
        [f"covar_pop({inputs[i]}, {inputs[j]}) * count(*)" + (f" + {alpha}" if i == j else "") + f" AS a{i}_{j}" for i in range(n) for j in range(n)]
        + [f"covar_pop({inputs[i]}, {label}) * count(*) AS a{i}_{n}" for i in range(n)]
        + [f"avg({c}) AS m{i}" for i, c in enumerate(inputs)] + [f"avg({label}) AS y"])
    sql = f"SELECT {sums} FROM {source}"
    for p in range(n):
        changed = [f"a{i}_{j} - a{i}_{p} / a{p}_{p} * a{p}_{j} AS a{i}_{j}" for i in range(p + 1, n) for j in range(p + 1, n + 1)]
        if changed:
            sql = f"SELECT * REPLACE ({', '.join(changed)}) FROM ({sql})"
    for i in reversed(range(n)):
        rest = "".join(f" - a{i}_{j} * k{j}" for j in range(i + 1, n))
        sql = f"SELECT *, (a{i}_{n}{rest}) / a{i}_{i} AS k{i} FROM ({sql})"
    return f"{name} AS MATERIALIZED (SELECT *, y{''.join(f' - m{i} * k{i}' for i in range(n))} AS intercept FROM ({sql}))"


def terms(inputs: tuple[str, ...], source: str = "solved") -> str:
    rows = [f"SELECT '{c}' AS term, round(k{i}, 5) AS coefficient FROM {source}" for i, c in enumerate(inputs)]
    return " UNION ALL ".join([*rows, f"SELECT 'intercept', round(intercept, 5) FROM {source}"])


def _with(*models: str) -> str:
    return ",\n".join([ROWS, *(cte for m in models for cte in grown(LEARNERS[m]))])


STACKED = ",\n".join([_with(*MODELS), f"""
estimated AS MATERIALIZED (
  SELECT k.*, exp(target / {GRID}.0) - 1 AS rough, exp(ln(1 + least(greatest(units_sold, 0), 1000))) - 1 AS actual, {", ".join(MODELS)}
  FROM kinds k {" ".join(f"JOIN {m}_out USING (rid)" for m in MODELS)}
),
meta_days AS (SELECT sale_date, sum(count(*)) OVER (ORDER BY sale_date) - count(*) AS before FROM estimated WHERE kind = 'tail' GROUP BY sale_date),
meta_cut AS (SELECT max(sale_date) AS last_day FROM meta_days WHERE before < (SELECT floor(count(*) * {QUICK.meta_share}) FROM estimated WHERE kind = 'tail')),
meta AS MATERIALIZED (SELECT * FROM estimated WHERE kind = 'tail' AND sale_date <= (SELECT last_day FROM meta_cut))""",
    solved("meta", MODELS, "actual", QUICK.ridge_alpha),
    f"combined AS MATERIALIZED (SELECT e.*, intercept{''.join(f' + {m} * k{i}' for i, m in enumerate(MODELS))} AS hybrid FROM estimated e, solved)"])

put("stacked_predictions", STACKED, f"SELECT {ROW}, {rnd(['actual', *MODELS, 'hybrid'], 4)} FROM combined WHERE kind = 'tail'")
put("stacking_coefficients", STACKED, terms(MODELS))
put("model_nodes", _with(*MODELS) + ",\nnamed AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(COLUMNS)) + ") t(f, feature))",
    " UNION ALL ".join(f"""SELECT '{m}' AS model, CAST(tree AS INT) AS tree, CAST(node AS BIGINT) AS node, feature, round(e.v, 6) AS threshold,
  CAST(value AS BIGINT) AS value, CAST(rows AS BIGINT) AS rows FROM {m}_nodes n LEFT JOIN named USING (f) LEFT JOIN edges e ON e.f = n.f AND e.i = n.cut""" for m in MODELS))
_FOREST = LEARNERS["random_forest"]
put("feature_importance", _with("random_forest") + f""",
gains AS (
  SELECT s.tree, s.f, g.gain FROM ({" UNION ALL ".join(f"SELECT s.tree, s.node, s.f, g.gain FROM random_forest_a0_{d}s s JOIN random_forest_a0_{d}g g ON s.tree = g.tree AND s.node = g.node AND s.f = g.f AND s.cut = g.bin" for d in range(_FOREST.depth))}) g
  JOIN (SELECT DISTINCT tree, f FROM random_forest_nodes WHERE f IS NOT NULL) s ON s.tree = g.tree AND s.f = g.f
),
shares AS (SELECT f, gain / sum(gain) OVER (PARTITION BY tree) AS share FROM gains),
named AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(COLUMNS))}) t(f, feature))""",
    f"""SELECT feature, round(sum(share) / {_FOREST.trees}, 6) AS importance FROM shares JOIN named USING (f) GROUP BY feature
ORDER BY sum(share) DESC, feature LIMIT 15""")
_DEEP = LEARNERS["boosted_deep"]
put("training_curve", _with("boosted_deep"), " UNION ALL ".join(
    f"""SELECT CAST({t} AS INT) AS iter, round(sqrt(sum(((margin - target) / {GRID}.0) ** 2) / count(*)), 6) AS rmse
FROM boosted_deep_m{t + 1} JOIN rows_ USING (rid) WHERE kind = 'tail'""" for t in range(_DEEP.trees)))
put("training_log", _with("boosted_deep"), " UNION ALL ".join(
    f"""SELECT CAST({t} AS INT) AS iter, round(sqrt(sum(((margin - target) / {GRID}.0) ** 2) / count(*)), 6) AS rmse, true AS time_passes,
  true AS time_runs_out FROM boosted_deep_m{t + 1} JOIN rows_ USING (rid) WHERE kind = 'tail'""" for t in range(_DEEP.trees)))
_R2 = "(SELECT 1 - sum((actual - hybrid) ** 2) / (var_pop(actual) * count(*)) FROM combined WHERE kind = 'tail')"
put("demand_model", STACKED + """,
est AS MATERIALIZED (
  SELECT sale_date, store_id, product_id, category, region, inventory_level, units_ordered, coalesce(units_sold, 0) AS units_sold, price,
    discount, competitor_price, weather, promotion, season, hybrid AS demand FROM combined WHERE kind = 'ask'
)""" + forecast("B") + PRICED_B + REORDER_B + finish("B").replace("0.5 * 30", f"{_R2} * 30"),
    f"SELECT {ROW}, round(demand, 3) AS demand, round(total_30day, 3) AS total_30day, order_quantity, urgency, health_score FROM done")
put("meta_split", ROWS + f""",
held AS MATERIALIZED (SELECT sale_date, store_id, product_id FROM kinds WHERE kind = 'tail'),
held_days AS (SELECT sale_date, sum(count(*)) OVER (ORDER BY sale_date) - count(*) AS before FROM held GROUP BY sale_date),
held_cut AS (SELECT max(sale_date) AS last_day FROM held_days WHERE before < (SELECT floor(count(*) * {QUICK.meta_share}) FROM held))""",
    f"""SELECT {ROW}, 'head' AS meta_part FROM held WHERE sale_date <= (SELECT last_day FROM held_cut)
UNION ALL SELECT {ROW}, 'tail' FROM held WHERE sale_date > (SELECT last_day FROM held_cut)""")
ORACLES["saved_model_demand"] = ORACLES["demand_model"]
put("ordered_means", FACT, f"""SELECT {ROW}, {", ".join(
    f'''round((coalesce(sum(q) OVER (PARTITION BY {c} ORDER BY {DIGEST}, {KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {GRID}.0)
  / (count(*) OVER (PARTITION BY {c} ORDER BY {DIGEST}, {KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1) / {GRID}.0, 6) AS {c}_mean''' for c in _CATS)}
FROM (SELECT *, CAST(floor(ln(1 + least(greatest(units_sold, 0), 1000)) * {GRID}.0 + 0.5) AS BIGINT) AS q FROM retail_fact)""")
put("bin_edges", FACT + """,
long AS (UNPIVOT (SELECT inventory_level, price, competitor_price, units_sold FROM retail_fact) ON inventory_level, price, competitor_price, units_sold INTO NAME feature VALUE v),
placed AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS place, count(*) OVER (PARTITION BY feature) AS n FROM long)""",
    """SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS bin, round(v, 9) AS edge
FROM (SELECT DISTINCT feature, v FROM placed, range(1, 64) t(k) WHERE place = n * k // 64)""")
_NAIVE = ("last_day", "last_week", "mean_week", "mean_month")
put("ridge_coefficients", NAIVE + ",\n" + solved("naive", _NAIVE, "actual", 1.0), terms(_NAIVE))
