"""DuckDB SQL for the registered queries, written from the rules and not from the Spark plans."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

FACT = """
retail_fact AS (
  SELECT CAST(l_shipdate AS DATE) AS sale_date,
    concat('S', lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0')) AS store_id,
    p_brand AS product_id,
    CASE CAST(replace(p_brand, 'Brand#', '') AS INT) % 5
      WHEN 0 THEN 'Groceries' WHEN 1 THEN 'Toys' WHEN 2 THEN 'Electronics' WHEN 3 THEN 'Clothing' ELSE 'Furniture' END
      AS category,
    r_name AS region,
    CAST(SUM(l_orderkey) % 500 AS DOUBLE) AS inventory_level,
    CAST(COUNT(*) * 25 AS DOUBLE) AS units_ordered,
    4 * SUM(l_quantity) AS units_sold,
    MIN(p_retailprice) / 10 AS price,
    CAST(ROUND(MAX(l_discount) * 100) AS DOUBLE) AS discount,
    MIN(p_retailprice) / 10 * (80 + 10 * (day(CAST(l_shipdate AS DATE)) % 5)) / 100 AS competitor_price,
    MAX(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS promotion,
    CASE MIN(l_partkey) % 4 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Rainy' WHEN 2 THEN 'Cloudy' ELSE 'Snowy' END AS weather,
    CASE WHEN month(CAST(l_shipdate AS DATE)) IN (12, 1, 2) THEN 'Winter'
      WHEN month(CAST(l_shipdate AS DATE)) BETWEEN 3 AND 5 THEN 'Spring'
      WHEN month(CAST(l_shipdate AS DATE)) BETWEEN 6 AND 8 THEN 'Summer' ELSE 'Autumn' END AS season
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
  GROUP BY CAST(l_shipdate AS DATE), n_nationkey, p_brand, r_name
)"""

RAW = FACT + """,
raw AS (
  SELECT CAST(sale_date AS VARCHAR) AS sale_date,
    CASE day(sale_date) WHEN 31 THEN 'NA' ELSE store_id END AS store_id,
    CASE day(sale_date) WHEN 30 THEN '' ELSE product_id END AS product_id,
    CASE day(sale_date) WHEN 29 THEN 'Footwear' WHEN 28 THEN 'null' ELSE category END AS category,
    CASE day(sale_date) WHEN 27 THEN 'abc' WHEN 26 THEN 'N/A' ELSE CAST(price AS VARCHAR) END AS price,
    CASE day(sale_date) WHEN 25 THEN 'NaN' WHEN 24 THEN '12.7' ELSE CAST(inventory_level AS VARCHAR) END AS inventory_level,
    CASE day(sale_date) WHEN 23 THEN '' ELSE CAST(units_sold AS VARCHAR) END AS units_sold,
    CAST(units_ordered AS VARCHAR) AS units_ordered,
    CASE day(sale_date) WHEN 22 THEN CAST(discount AS VARCHAR) || '%' WHEN 21 THEN 'none' ELSE CAST(discount AS VARCHAR) END
      AS discount,
    CASE day(sale_date) WHEN 20 THEN '' ELSE CAST(competitor_price AS VARCHAR) END AS competitor_price,
    CASE day(sale_date) WHEN 19 THEN 'yes' WHEN 18 THEN 'on' WHEN 17 THEN 'Yes' ELSE CAST(promotion AS VARCHAR) END AS promotion,
    CASE day(sale_date) WHEN 16 THEN 'Monsoon' WHEN 15 THEN '' ELSE season END AS season,
    CASE day(sale_date) WHEN 14 THEN 'Hot' ELSE weather END AS weather,
    concat_ws('|', CAST(sale_date AS VARCHAR), store_id, product_id) AS request_id,
    array_to_string(list_transform(string_split(lower(region), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS region
  FROM retail_fact
)"""

_NA = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
_BULK = (
    "store_id", "product_id", "category", "price", "inventory_level", "units_sold", "units_ordered", "discount",
    "competitor_price", "promotion", "season", "weather", "region",
)
_UPLOADED = (
    "store_id", "product_id", "category", "price", "inventory_level", "units_sold", "units_ordered", "discount",
    "competitor_price", "promotion", "season", "weather", "region",
)
UPLOAD = RAW + ",\nupload AS (SELECT sale_date, request_id, " + ", ".join(
    f"CASE WHEN trim({c}) NOT IN {_NA} THEN trim({c}) END AS {c}" for c in _BULK) + " FROM raw)"


def num(c: str) -> str:
    return (f"CASE WHEN regexp_full_match(trim({c}), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
            f"THEN TRY_CAST(trim({c}) AS DOUBLE) END")


BULK = UPLOAD + f""",
numbers AS (
  SELECT *, {num('price')} AS n_price, {num('inventory_level')} AS n_inventory, {num('units_sold')} AS n_units,
    {num('promotion')} AS n_promotion, {num('competitor_price')} AS n_competitor, {num('discount')} AS n_discount
  FROM upload
),
bulk AS (
  SELECT sale_date, request_id, CAST(to_json(struct_pack(sale_date := sale_date, """ + ", ".join(f"{c} := {c}" for c in _UPLOADED) + """)) AS VARCHAR) AS input_json,
    coalesce(store_id, 'UNKNOWN') AS store_id, coalesce(product_id, 'UNKNOWN') AS product_id,
    coalesce(category, 'General') AS category, coalesce(season, 'Normal') AS season,
    coalesce(n_price, 50.0) AS price,
    CAST(trunc(coalesce(n_inventory, 100)) AS INT) AS inventory_level,
    coalesce(n_competitor, n_price, 50.0) AS competitor_price,
    CAST(trunc(coalesce(n_promotion, 0)) AS INT) AS promotion,
    CAST(trunc(coalesce(n_units, 0)) AS INT) AS units_sold,
    coalesce(n_discount, 0.0) AS discount,
    nullif(concat_ws('; ',
      CASE WHEN inventory_level IS NOT NULL AND n_inventory IS NULL THEN 'inventory_level: ' || inventory_level END,
      CASE WHEN units_sold IS NOT NULL AND n_units IS NULL THEN 'units_sold: ' || units_sold END,
      CASE WHEN promotion IS NOT NULL AND n_promotion IS NULL THEN 'promotion: ' || promotion END,
      CASE WHEN price IS NOT NULL AND n_price IS NULL THEN 'price: ' || price END,
      CASE WHEN competitor_price IS NOT NULL AND n_competitor IS NULL THEN 'competitor_price: ' || competitor_price END,
      CASE WHEN discount IS NOT NULL AND n_discount IS NULL THEN 'discount: ' || discount END), '') AS reject_reason
  FROM numbers
)"""


RAW_INPUT = "to_json(struct_pack(" + ", ".join(
    f"{c} := CAST({c} AS VARCHAR)" if c == "sale_date" else f"{c} := {c}" for c in (
        "sale_date", "store_id", "product_id", "category", "region", "inventory_level", "units_ordered", "units_sold",
        "price", "discount", "competitor_price", "weather", "promotion", "season")) + "))"


def validated(source: str) -> str:
    """Zero or missing numbers of typed rows replaced by the defaults."""
    def filled(c: str, default: float) -> str:
        return f"coalesce(nullif(CAST({c} AS DOUBLE), 0.0), {default})"
    return f""",
valid AS (
  SELECT * REPLACE ({filled('inventory_level', 100.0)} AS inventory_level, {filled('units_sold', 40.0)} AS units_sold,
    {filled('price', 30.0)} AS price, {filled('discount', 10.0)} AS discount,
    {filled('competitor_price', 28.0)} AS competitor_price){", " + RAW_INPUT + " AS input_json" if source == "retail_fact" else ""}
  FROM {source}
),
est AS (
  SELECT *, greatest(10.0, units_sold * (1.0 - (price / 100) * 0.1) * (1.0 + (discount / 100) * 0.5)
    * CASE WHEN promotion <> 0 THEN 1.3 ELSE 1.0 END) AS demand
  FROM valid
)"""


EST = FACT + validated("retail_fact")
# the offline rules: no zero is replaced, classes outside the lists become the first
EST_B = FACT + """,
valid AS (
  SELECT * REPLACE (
    CASE WHEN category IN ('Groceries', 'Toys', 'Electronics', 'Clothing', 'Furniture') THEN category ELSE 'Groceries' END AS category,
    CASE WHEN region IN ('North', 'South', 'East', 'West') THEN region ELSE 'North' END AS region,
    CASE WHEN weather IN ('Sunny', 'Rainy', 'Cloudy', 'Snowy') THEN weather ELSE 'Sunny' END AS weather,
    CASE WHEN season IN ('Winter', 'Spring', 'Summer', 'Autumn') THEN season ELSE 'Winter' END AS season)
  FROM retail_fact
),
est AS (
  SELECT *, greatest(10.0, units_sold * (1.0 - (price / 100) * 0.1) * (1.0 + (discount / 100) * 0.5)
    * CASE WHEN promotion <> 0 THEN 1.3 ELSE 1.0 END) AS demand
  FROM valid
)"""
KEY = "sale_date, store_id, product_id"
AS_OF = "DATE '2024-01-01'"


def txt(x: str, k: int) -> str:
    """Fixed-point text of the exact binary value, half-even."""
    return f"format('{{:.{k}f}}', CAST({x} AS DOUBLE))"


_DAYS = f"(SELECT i, CAST({AS_OF} + i * INTERVAL 1 DAY AS DATE) AS d FROM range(30) r(i))"
_MONTHS = "[0.9, 0.85, 0.95, 1.0, 1.05, 1.1, 1.15, 1.1, 1.0, 1.05, 1.2, 1.3]"


def _md5(salt: str) -> str:
    return f"md5(concat_ws('|', store_id, product_id, CAST(sale_date AS VARCHAR), {salt}, '42'))"


def _word(digest: str, nth: int) -> str:
    return f"CAST(CAST(('0x' || substr({digest}, {1 + 8 * nth}, 8)) AS UBIGINT) AS DOUBLE)"


def unif(salt: str) -> str:
    return f"({_word(_md5(salt), 0)} / 4294967296.0)"


def norm(salt: str) -> str:
    m = _md5(salt)
    return (f"(sqrt(-2.0 * ln(({_word(m, 0)} + 0.5) / 4294967296.0))"
            f" * cos(2.0 * pi() * ({_word(m, 1)} / 4294967296.0)))")


def _day_word(nth: str) -> str:
    digest = _md5("'days' || (i // 4)")
    return f"CAST(CAST(('0x' || substr({digest}, CAST(1 + 8 * (2 * ((i // 2) % 2) + {nth}) AS INT), 8)) AS UBIGINT) AS DOUBLE)"


# day i takes the cosine or sine of pair i // 2, whose words come from digest i // 4
DAY_NORM = (f"(sqrt(-2.0 * ln(({_day_word('0')} + 0.5) / 4294967296.0)) * CASE WHEN i % 2 = 0"
            f" THEN cos(2.0 * pi() * ({_day_word('1')} / 4294967296.0)) ELSE sin(2.0 * pi() * ({_day_word('1')} / 4294967296.0)) END)")


def forecast(policy: str, noise: bool = False, source: str = "est") -> str:
    """CTEs ``days`` (one row per row and day) and ``fc`` (one row per row with lists and totals)."""
    if policy == "A":
        value = "demand * CASE WHEN isodow(d) >= 6 THEN 1.2 ELSE 1.0 END"
        if noise:
            value += f" * (1.0 + 0.15 * {DAY_NORM})"
        floor = "5.0"
    else:
        value = f"demand * CASE WHEN isodow(d) >= 6 THEN 0.9 ELSE 1.1 END * ({_MONTHS})[month(d)]"
        if noise:
            value += f" * greatest(0.7, least(1.3, 1.0 + 0.1 * {DAY_NORM}))"
        floor = "0.0"
    return f""",
days AS (
  SELECT {KEY}, i, d, inventory_level, greatest({floor}, round_even({value}, 2)) AS v FROM {source}, {_DAYS}
),
trended AS (SELECT *, lag(v) OVER (PARTITION BY {KEY} ORDER BY i) AS before FROM days),
grouped AS (
  SELECT {KEY},
    string_agg(CAST(d AS VARCHAR), ',' ORDER BY i) AS dates,
    string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS demands,
    string_agg(CASE WHEN v > before THEN 'Up' WHEN v < before THEN 'Down' ELSE 'Stable' END, ',' ORDER BY i) AS trends,
    list(struct_pack("date" := CAST(d AS VARCHAR), demand := v,
      trend := CASE WHEN v > before THEN 'Up' WHEN v < before THEN 'Down' ELSE 'Stable' END) ORDER BY i) AS listed,
    list(v ORDER BY i) AS vs, any_value(inventory_level) AS inv0,
    list(struct_pack(t := v, d := d, hit := CAST(NULL AS DATE)) ORDER BY i) AS steps
  FROM trended GROUP BY {KEY}
),
fc AS (
  SELECT {KEY}, dates, demands, trends, listed,
    {"round_even(list_reduce(vs, lambda a, x: a + x), 2)" if policy == "A" else "list_reduce(vs, lambda a, x: a + x)"} AS total_30day,
    list_reduce(vs[1:7], lambda a, x: a + x) AS lead,
    list_reduce(list_prepend(struct_pack(t := 0.0::DOUBLE, d := CAST(NULL AS DATE), hit := CAST(NULL AS DATE)), steps),
      lambda a, x: struct_pack(t := a.t + x.t, d := x.d,
        hit := coalesce(a.hit, CASE WHEN a.t + x.t > inv0 THEN x.d END))).hit AS stockout_date
  FROM grouped
)"""


IMPACT = """,
impact1 AS (SELECT *, -1.5 * ((new_price - price) / price) AS vol, demand * price AS rev0 FROM priced),
impact2 AS (SELECT *, demand * (1 + vol) * new_price AS rev1 FROM impact1),
priced2 AS (
  SELECT *, round_even(new_price, 2) AS recommended_price, round_even(vol * 100, 1) AS volume_change,
    round_even((rev1 - rev0) / rev0 * 100, 1) AS revenue_change, round_even(rev0, 2) AS old_revenue,
    round_even(rev1, 2) AS new_revenue
  FROM impact2
)"""

PRICED_A = """,
disc AS (
  SELECT *, price / nullif(competitor_price, 0) AS ratio,
    CASE WHEN demand > 100 THEN greatest(0.0, discount - 5) WHEN demand < 30 THEN least(30.0, discount + 10)
      WHEN price / nullif(competitor_price, 0) > 1.1 THEN least(20.0, discount + 5) ELSE discount END AS recommended_discount,
    CASE WHEN demand > 100 THEN 'PREMIUM_PRICING' WHEN demand < 30 THEN 'PROMOTIONAL_PRICING'
      WHEN price / nullif(competitor_price, 0) > 1.1 THEN 'COMPETITIVE_PRICING' ELSE 'MAINTAIN_PRICING' END AS pricing_strategy,
    CASE WHEN demand > 100 THEN 'High demand allows for premium pricing'
      WHEN demand < 30 THEN 'Low demand requires promotional pricing'
      WHEN price / nullif(competitor_price, 0) > 1.1 THEN 'Price is higher than competition, consider matching'
      ELSE 'Current pricing is competitive' END AS pricing_reasoning
  FROM est
),
priced AS (SELECT *, price * (1 - recommended_discount / 100) AS new_price FROM disc)""" + IMPACT

PRICED_B = f""",
disc0 AS (
  SELECT *, coalesce(price / nullif(competitor_price, 0) > 1.1, false) AS dear,
    CASE WHEN demand < 50 THEN least(30.0, discount + 10) WHEN demand > 150 THEN greatest(0.0, discount - 5)
      ELSE discount END AS by_demand
  FROM est
),
disc AS (
  SELECT *, CASE WHEN dear THEN greatest(by_demand, 15.0) ELSE by_demand END AS recommended_discount,
    CASE WHEN demand < 50 THEN 'PROMOTIONAL_PRICING' WHEN demand > 150 THEN 'PREMIUM_PRICING' ELSE 'COMPETITIVE_PRICING' END
      || CASE WHEN dear THEN '_WITH_PRICE_MATCH' ELSE '' END AS pricing_strategy,
    CASE WHEN demand < 50 THEN 'Low demand (' || {txt('demand', 0)} || ' units). Increase discounts to stimulate sales.'
      WHEN demand > 150 THEN 'High demand (' || {txt('demand', 0)} || ' units). Reduce discounts for better margins.'
      ELSE 'Moderate demand (' || {txt('demand', 0)} || ' units). Maintain competitive positioning.' END
      || CASE WHEN dear THEN ' Consider matching competitor prices.' ELSE '' END AS pricing_reasoning
  FROM disc0
),
priced AS (SELECT *, price * (1 - recommended_discount / 100) AS new_price FROM disc)""" + IMPACT

REORDER_A = f""",
r1 AS (SELECT *, greatest(0.0, inventory_level) AS inv, greatest(0.1, demand) AS need FROM priced2),
r2 AS (
  SELECT *, inv / need AS dos, 1.65 * (need * 0.25) * sqrt(7) AS safety,
    CASE WHEN price * 0.25 > 0 THEN sqrt((2 * (need * 365) * 50) / (price * 0.25)) ELSE need * 30 END AS eoq
  FROM r1
),
r3 AS (
  SELECT *, need * 7 + safety AS rop,
    CASE WHEN inv <= need * 7 THEN 'HIGH' WHEN dos <= 10 THEN 'MEDIUM' ELSE 'LOW' END AS urgency
  FROM r2
),
re AS (
  SELECT *, inv AS current_inventory, round_even(dos, 1) AS days_of_supply, round_even(rop, 0) AS reorder_point,
    round_even(safety, 0) AS safety_stock,
    round_even(CASE WHEN urgency = 'LOW' THEN 0.0 ELSE greatest(0.0, rop + eoq - inv) END, 0) AS order_quantity,
    CASE urgency WHEN 'HIGH' THEN 'IMMEDIATE_REORDER' WHEN 'MEDIUM' THEN 'SCHEDULE_REORDER' ELSE 'MONITOR' END AS reorder_action,
    CASE urgency WHEN 'HIGH' THEN 'Inventory below lead-time demand'
      WHEN 'MEDIUM' THEN 'Low days of supply (' || {txt('dos', 1)} || ')'
      ELSE 'Sufficient inventory (' || {txt('dos', 1)} || ')' END AS reorder_reasoning,
    CASE WHEN dos < 7 THEN 'High risk - stockout in ' || {txt('dos', 0)} || ' days'
      WHEN dos < 10 THEN 'Medium risk - monitor closely' ELSE 'Low risk - sufficient inventory' END AS stockout_risk
  FROM r3
)"""

REORDER_B = f""",
r1 AS (
  SELECT p.*, fc.lead, fc.stockout_date, fc.total_30day,
    CASE WHEN demand > 0 THEN inventory_level / demand ELSE 999.0 END AS dos,
    least(CASE WHEN price * 0.25 > 0 THEN sqrt((2 * (demand * 365) * 50) / (price * 0.25)) ELSE demand * 30 END, demand * 90) AS eoq
  FROM priced2 p JOIN fc USING ({KEY})
),
r2 AS (SELECT *, lead + 3 * demand AS rop FROM r1),
r3 AS (
  SELECT *, CASE WHEN inventory_level <= rop THEN 'HIGH' WHEN dos <= 10 THEN 'MEDIUM' ELSE 'LOW' END AS urgency FROM r2
),
re AS (
  SELECT *, inventory_level AS current_inventory, round_even(dos, 1) AS days_of_supply, round_even(rop, 0) AS reorder_point,
    round_even(lead, 0) AS lead_time_demand, round_even(eoq, 0) AS order_quantity,
    CASE urgency WHEN 'HIGH' THEN 'IMMEDIATE_REORDER' WHEN 'MEDIUM' THEN 'SCHEDULE_REORDER' ELSE 'MONITOR' END AS reorder_action,
    CASE urgency WHEN 'HIGH' THEN 'Current inventory (' || CAST(inventory_level AS VARCHAR) || ') below reorder point ('
        || {txt('rop', 0)} || ')'
      WHEN 'MEDIUM' THEN 'Low days of supply (' || {txt('dos', 1)} || ' days)'
      ELSE 'Sufficient inventory (' || {txt('dos', 1)} || ' days supply)' END AS reorder_reasoning,
    CASE WHEN stockout_date IS NOT NULL THEN 'High risk - Stockout expected around ' || CAST(stockout_date AS VARCHAR)
      ELSE 'Low risk - Sufficient inventory for 30+ days' END AS stockout_risk
  FROM r3
)"""


def finish(policy: str) -> str:
    """CTE ``done``: alerts as a list, health score and action plan."""
    named = "" if policy == "A" else " || product_id"
    qty = txt("order_quantity", 0) if policy == "A" else "CAST(order_quantity AS VARCHAR)"
    pricing = "💰 Pricing optimization opportunity" + (" detected" if policy == "A" else "")
    high = "📈 High demand detected" + ("" if policy == "A" else " for ")
    low = "📉 Low demand detected" if policy == "A" else "📉 Low demand for "
    low_action = "Consider promotions or discontinuation" + (" review" if policy == "A" else "")
    limit = 150 if policy == "A" else 200
    confidence = "15" if policy == "A" else "0.5 * 30"
    units = f"'Current demand: ' || {txt('demand', 0)} || ' units'"

    def alert(kind: str, severity: str, message: str, details: str, action: str) -> str:
        return (f"struct_pack(\"type\" := '{kind}', severity := '{severity}', message := {message}, "
                f"details := {details}, action := {action})")

    if policy == "A":
        plan = f"""concat_ws('; ',
      CASE WHEN recommended_discount <> discount THEN 'Change price to $' || {txt('recommended_price', 2)} END,
      CASE WHEN urgency IN ('HIGH', 'MEDIUM') THEN 'Order ' || {txt('order_quantity', 0)} || ' units' END,
      CASE WHEN demand > 150 THEN 'High demand period - watch inventory closely' END,
      CASE WHEN demand < 30 THEN 'Low demand - consider promotions or discontinuation' END)"""
    else:
        plan = f"""coalesce(nullif(concat_ws('; ',
      CASE WHEN recommended_discount <> discount THEN 'Adjust pricing to $' || CAST(recommended_price AS VARCHAR) || ' ('
        || CAST(recommended_discount AS VARCHAR) || '% discount)' END,
      CASE WHEN urgency IN ('HIGH', 'MEDIUM') THEN 'Order ' || {txt('order_quantity', 0)} || ' units of ' || product_id END,
      CASE WHEN demand > 150 THEN 'Monitor stock levels closely - high demand period'
        WHEN demand < 30 THEN 'Consider promotional activities to boost sales' END), ''),
      'Maintain current strategy - performance is optimal')"""
    return f""",
done AS (
  SELECT *, list_filter([
      CASE WHEN urgency = 'HIGH' THEN {alert('STOCKOUT_RISK', 'HIGH', "'🚨 IMMEDIATE REORDER NEEDED for ' || product_id",
        'reorder_reasoning', "'Order ' || " + qty + " || ' units immediately'")} END,
      CASE WHEN revenue_change > 5 THEN {alert('PRICING_OPPORTUNITY', 'MEDIUM', "'" + pricing + "'",
        "'Expected revenue increase: ' || CAST(revenue_change AS VARCHAR) || '%'",
        "'Adjust price to $' || CAST(recommended_price AS VARCHAR)")} END,
      CASE WHEN demand > {limit} THEN {alert('HIGH_DEMAND', 'MEDIUM', "'" + high + "'" + named, units,
        "'Consider increasing inventory and reviewing pricing'")} END,
      CASE WHEN demand < 20 THEN {alert('LOW_PERFORMANCE', 'LOW', "'" + low + "'" + named, units,
        "'" + low_action + "'")} END
    ], lambda a: a IS NOT NULL) AS alerts,
    CAST(least(100, greatest(0, round_even(50
      + CASE WHEN demand > 100 THEN 30 WHEN demand > 50 THEN 20 WHEN demand > 20 THEN 10 ELSE 0 END
      + CASE urgency WHEN 'LOW' THEN 20 WHEN 'MEDIUM' THEN 10 ELSE 0 END + {confidence}, 0))) AS INT) AS health_score,
    {plan} AS plan
  FROM re
)"""


DONE_A = EST + PRICED_A + REORDER_A + finish("A")
DONE_B = EST_B + forecast("B") + PRICED_B + REORDER_B + finish("B")
DONE_A_FC = EST + forecast("A") + PRICED_A + REORDER_A + finish("A")

_ID = "sha256(concat_ws('_', 'run1', store_id, product_id, CAST(sale_date AS VARCHAR)))"
_USER = "CAST(substr(store_id, 2) AS BIGINT) - 1"

HISTORY = DONE_A + f""",
history AS (
  SELECT {_ID} AS prediction_id, {_USER} AS user_id, store_id, product_id, category,
    round_even(demand, 2) AS demand_forecast, recommended_price, order_quantity AS reorder_quantity, health_score,
    CAST(sale_date AS TIMESTAMP) AS created_at
  FROM done
)"""

ALERTS = DONE_A + f""",
lines AS (
  SELECT {_ID} AS prediction_id, {_USER} AS user_id, store_id, product_id, CAST(sale_date AS TIMESTAMP) AS raised_at,
    unnest(list_concat(
      CASE WHEN urgency IN ('HIGH', 'MEDIUM') THEN [struct_pack("type" := 'REORDER', severity := urgency,
        message := 'Reorder needed for ' || product_id, details := reorder_reasoning, action := reorder_action)] ELSE [] END,
      list_filter(alerts, lambda a: a.severity IN ('HIGH', 'MEDIUM')))) AS a
  FROM done
),
raised AS (
  SELECT sha256(prediction_id || '_' || a."type") AS alert_id, user_id, prediction_id, store_id, product_id,
    a."type" AS alert_type, a.severity AS severity, a.message AS message, a.details AS details, raised_at
  FROM lines
),
state AS (
  SELECT alert_id, user_id, prediction_id, store_id, product_id, alert_type, severity, message, details,
    severity = 'MEDIUM' AS resolved, raised_at AS created_at,
    CASE WHEN severity = 'MEDIUM' THEN raised_at + INTERVAL 1 DAY END AS resolved_at
  FROM raised
)"""

_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def ts(c: str, alias: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {alias or c}"


def exact(sql: str) -> str:
    """``round_even(x, k)`` by way of fixed-point text: DuckDB's own scales first and so moves values across ties."""
    mark = "round_even("
    while mark in sql:
        start = sql.rindex(mark)
        depth, end = 1, start + len(mark)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x, k = sql[start + len(mark):end - 1].rsplit(",", 1)
        sql = f"{sql[:start]}CAST({txt(x, int(k))} AS DOUBLE){sql[end:]}"
    return sql


def put(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = exact(f"WITH {ctes.strip()}\n{select}")


DAY = "CAST(sale_date AS VARCHAR) AS sale_date"
ROW = f"{DAY}, store_id, product_id"
_HISTORY_COLUMNS = (
    "prediction_id, user_id, store_id, product_id, category, demand_forecast, recommended_price, reorder_quantity, "
    "health_score, " + ts("created_at")
)

_REQUEST_ID = "sha256('run1_' || concat_ws('|', strftime(created_at, '%Y-%m-%d'), store_id, product_id))"

# --- sources ---
put("scan_sales", FACT, f"""SELECT {ROW}, category, region, inventory_level, units_ordered, units_sold AS demand_forecast,
  price, discount, weather, CAST(promotion AS VARCHAR) AS promotion, competitor_price, season, units_sold FROM retail_fact""")
put("scan_bulk", UPLOAD, "SELECT * EXCLUDE (request_id) FROM upload")
put("scan_bulk_lines", UPLOAD, """SELECT sale_date, store_id, product_id, units_ordered,
  region || chr(10) || 'ordered "' || units_ordered || '"' AS note, CAST(NULL AS VARCHAR) AS malformed FROM upload""")
put("scan_history", HISTORY, f"SELECT {_HISTORY_COLUMNS} FROM history")
put("stream_score", HISTORY, f"""SELECT {_HISTORY_COLUMNS.replace('prediction_id', _REQUEST_ID + ' AS prediction_id')}
FROM history""")

# --- cleansing ---
put("bulk_mapped", UPLOAD, "SELECT " + ", ".join("CAST(NULL AS VARCHAR) AS weather" if c == "weather" else c for c in _BULK)
    + " FROM upload")
put("bulk_normalized", BULK, "SELECT * EXCLUDE (request_id, input_json) FROM bulk")


def _api(c: str, default: float) -> str:
    return f"coalesce(nullif(CASE WHEN {c} IS NOT NULL THEN coalesce({num(c)}, 0.0) END, 0.0), {default}) AS {c}"


put("validated", RAW, "SELECT CASE WHEN substr(sale_date, 9, 2) = '13' THEN '2024-01-01' ELSE sale_date END AS sale_date, "
    "store_id, product_id, category, season, weather, region, "
    + ", ".join([_api("inventory_level", 100.0), _api("units_ordered", 50.0), _api("units_sold", 40.0), _api("price", 30.0),
                 _api("discount", 10.0), _api("competitor_price", 28.0)]) + ", 40.0::DOUBLE AS demand_forecast FROM raw")
put("parse_percent", RAW, f"""SELECT sale_date, store_id, product_id, discount,
  coalesce({num("replace(discount, '%', '')")}, 10.0) AS discount_percent FROM raw""")
put("parse_flag", RAW, """SELECT sale_date, store_id, product_id, promotion,
  CASE WHEN promotion IN ('1', 'on', 'true') THEN 1 ELSE 0 END AS form_flag,
  CASE WHEN promotion IN ('1', 'yes', 'y', 'true') THEN 1 ELSE 0 END AS script_flag,
  CASE WHEN promotion IN ('Yes', '1') THEN 1 ELSE 0 END AS sales_flag FROM raw""")
put("domain_checked", RAW, """SELECT sale_date,
  CASE WHEN category IN ('Groceries', 'Toys', 'Electronics', 'Clothing', 'Furniture') THEN category ELSE 'Groceries' END AS category,
  CASE WHEN region IN ('North', 'South', 'East', 'West') THEN region ELSE 'North' END AS region,
  CASE WHEN weather IN ('Sunny', 'Rainy', 'Cloudy', 'Snowy') THEN weather ELSE 'Sunny' END AS weather,
  CASE WHEN season IN ('Winter', 'Spring', 'Summer', 'Autumn') THEN season ELSE 'Winter' END AS season FROM raw""")
_CALENDAR = """CAST(isodow(sale_date) - 1 AS INT) AS day_of_week, CAST(day(sale_date) AS INT) AS day_of_month,
  CAST(month(sale_date) AS INT) AS month, CAST(quarter(sale_date) AS INT) AS quarter, CAST(year(sale_date) AS INT) AS year,
  CASE WHEN isodow(sale_date) >= 6 THEN 1 ELSE 0 END AS is_weekend"""
put("calendar_features", FACT, f"SELECT {ROW}, {_CALENDAR} FROM retail_fact")
put("ratio_features", FACT, f"""SELECT {ROW}, price / (competitor_price + 0.001) AS guarded_ratio,
  price / nullif(competitor_price, 0) AS price_ratio, units_sold / (inventory_level + 1) AS inventory_turnover,
  discount * units_sold AS discount_effectiveness,
  CASE WHEN month(sale_date) IN (11, 12) THEN 1 ELSE 0 END AS is_holiday_season,
  CASE WHEN month(sale_date) IN (6, 7, 8) THEN 1 ELSE 0 END AS is_summer, units_sold AS sales_velocity FROM retail_fact""")
put("target_log1p", FACT, f"""SELECT {ROW}, round(ln(1 + least(greatest(units_sold, 0), 1000)), 6) AS target,
  round(exp(ln(1 + least(greatest(units_sold, 0), 1000))) - 1, 6) AS units FROM retail_fact""")
put("clean_names", FACT, """SELECT CAST(sale_date AS VARCHAR) AS "Date", store_id AS "Store_ID", product_id AS "Product_ID",
  category AS "Category", region AS "Region", inventory_level AS "Inventory_Level", units_ordered AS "Units_Ordered",
  units_sold AS "Units_Sold", price AS "Price", discount AS "Discount", competitor_price AS "Competitor_Pricing",
  promotion AS "Holiday/Promotion", weather AS "Weather_Condition", season AS "Seasonality" FROM retail_fact""")

# --- windows ---
_SERIES = "PARTITION BY store_id, product_id ORDER BY sale_date"
_LAGS = ", ".join(
    f"lag({src}, {k}) OVER ({_SERIES}) AS {name}_lag_{k}"
    for k in (1, 2, 3, 7, 14, 28) for src, name in (("units_sold", "units_sold"), ("inventory_level", "inventory")))
_LAG_NAMES = [f"{n}_lag_{k}" for k in (1, 2, 3, 7, 14, 28) for n in ("units_sold", "inventory")]
_ROLL_NAMES = [f"units_sold_rolling_{s}_{k}" for k in (7, 14, 30) for s in ("mean", "std", "median")]


def _rolling(last: int) -> str:
    parts = []
    for k in (7, 14, 30):
        end = "CURRENT ROW" if last == 0 else "1 PRECEDING"
        frame = f"({_SERIES} ROWS BETWEEN {k - 1 - last} PRECEDING AND {end})"
        parts += [f"avg(units_sold) OVER {frame} AS units_sold_rolling_mean_{k}",
                  f"stddev_samp(units_sold) OVER {frame} AS units_sold_rolling_std_{k}",
                  f"quantile_cont(units_sold, 0.5) OVER {frame} AS units_sold_rolling_median_{k}"]
    return ", ".join(parts)


def rnd(names: list[str], k: int = 6) -> str:
    return ", ".join(f"round({n}, {k}) AS {n}" for n in names)


SERIES = FACT + f",\nseries AS (SELECT *, {_LAGS}, {_rolling(0)} FROM retail_fact)"
put("lag_features", FACT, f"SELECT {ROW}, {_LAGS} FROM retail_fact")
put("rolling_features", SERIES, f"SELECT {ROW}, {rnd(_ROLL_NAMES)} FROM series")
put("past_rolling_features", FACT + f",\nseries AS (SELECT *, {_LAGS}, {_rolling(-1)} FROM retail_fact)",
    f"SELECT {ROW}, {', '.join(_LAG_NAMES)}, {rnd(_ROLL_NAMES)} FROM series")
_ALL = "ORDER BY store_id, product_id, sale_date"


def _filled(names: list[str], partition: str = "", digits: int | None = 6) -> str:
    out = []
    for n in names:
        value = (f"coalesce(first_value({n} IGNORE NULLS) OVER ({partition} {_ALL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
                 f"last_value({n} IGNORE NULLS) OVER ({partition} {_ALL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")
        out.append(f"{value} AS {n}" if digits is None else f"round({value}, {digits}) AS {n}")
    return ", ".join(out)


put("filled_features", SERIES, f"SELECT {ROW}, {_filled(_LAG_NAMES + _ROLL_NAMES)} FROM series")
put("series_filled_features", SERIES,
    f"SELECT {ROW}, {_filled(_LAG_NAMES, 'PARTITION BY store_id, product_id', None)} FROM series")
put("sales_velocity", FACT, f"""SELECT {ROW},
  round(avg(units_sold) OVER ({_SERIES} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS sales_velocity_7d,
  round(avg(units_sold) OVER ({_SERIES} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS sales_velocity_30d FROM retail_fact""")
put("latest_features", SERIES, f"""SELECT {ROW}, {', '.join(_LAG_NAMES)}, {rnd(_ROLL_NAMES)} FROM series
QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY sale_date DESC) = 1""")
put("train_split", FACT + f""",
placed AS (SELECT *, row_number() OVER ({_ALL}) - 1 AS position, count(*) OVER () AS n FROM retail_fact),
days AS (SELECT sale_date, sum(count(*)) OVER (ORDER BY sale_date) - count(*) AS before FROM retail_fact GROUP BY sale_date),
cut AS (SELECT max(sale_date) AS last_day FROM days WHERE before < (SELECT floor(count(*) * 0.8) FROM retail_fact))""",
    f"""SELECT {ROW}, position, CASE WHEN position < floor(n * 0.8) THEN 'head' ELSE 'tail' END AS part,
  CASE WHEN sale_date <= (SELECT last_day FROM cut) THEN 'head' ELSE 'tail' END AS date_part FROM placed""")

_SYNTH = """greatest(1.0, floor(mean_units * exp(-0.08 * (price - mean_price))
    * CASE WHEN promotion = 1 THEN 1.4 ELSE 1.0 END * CASE WHEN month(sale_date) IN (10, 11, 12) THEN 1.2 ELSE 0.95 END{noise}))"""


def _augmented(noise: str) -> str:
    return FACT + f""",
means AS (SELECT product_id, round(avg(units_sold), 9) AS mean_units FROM retail_fact GROUP BY product_id),
overall AS (SELECT round(avg(price), 9) AS mean_price FROM retail_fact),
augmented AS (
  SELECT sale_date, store_id, product_id, price, inventory_level, 0 AS source, units_sold FROM retail_fact
  UNION ALL
  SELECT sale_date, store_id, product_id, price, inventory_level, 1, {_SYNTH.format(noise=noise)}
  FROM retail_fact JOIN means USING (product_id), overall
)"""


_NOISE = norm("'synthetic'")
put("augmented_sales", _augmented(f" * (1.0 + 0.15 * {_NOISE})"), f"SELECT {ROW}, price, source, units_sold FROM augmented")
_PAIRS = "PARTITION BY store_id, product_id ORDER BY sale_date, source"
put("augmented_lags", _augmented(""), f"""SELECT {ROW}, source, lag(units_sold, 1) OVER ({_PAIRS}) AS units_sold_lag_1,
  lag(units_sold, 2) OVER ({_PAIRS}) AS units_sold_lag_2, lag(inventory_level, 7) OVER ({_PAIRS}) AS inventory_lag_7,
  round(avg(units_sold) OVER ({_PAIRS} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS units_sold_rolling_mean_7
FROM augmented""")
put("noisy_sales", FACT, f"""SELECT {ROW}, CAST(round_even(greatest(0.0, units_sold * (1.0 + 0.15 * {norm("'daily'")})
  * CASE WHEN discount > 0 THEN 0.7::DOUBLE + (1.2::DOUBLE - 0.7::DOUBLE) * {unif("'discount'")} ELSE 1.0 END
  * CASE WHEN {unif("'shock'")} < 0.02 THEN 1.3::DOUBLE + (2.0::DOUBLE - 1.3::DOUBLE) * {unif("'size'")} ELSE 1.0 END), 0) AS INT) AS units_sold
FROM retail_fact""")
put("keyed_noise", FACT, f"""SELECT {ROW}, round({unif("'u'")}, 9) AS uniform, round(1.0 + {norm("'n'")}, 9) AS normal
FROM retail_fact""")
put("product_mean_demand", FACT, "SELECT product_id, round(avg(units_sold), 6) AS mean_units_sold FROM retail_fact GROUP BY 1")

# --- encoding ---
_CATS = ("store_id", "product_id", "category", "region", "weather", "season")


def _long(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), 'nan') AS label FROM {source}" for c in _CATS)


DICTIONARY = f""",
dictionary AS (
  SELECT "column", label, CAST(row_number() OVER (PARTITION BY "column" ORDER BY label) - 1 AS INT) AS index
  FROM (SELECT DISTINCT * FROM ({_long('retail_fact')}))
)"""


def _index(c: str, source: str) -> str:
    return f"(SELECT coalesce(max(d.index), 0) FROM dictionary d WHERE d.\"column\" = '{c}' AND d.label = coalesce({source}.{c}, 'nan'))"


put("label_dictionary", FACT + DICTIONARY, "SELECT * FROM dictionary")
put("encoded_sales", FACT + DICTIONARY, f"SELECT {DAY}, units_sold, "
    + ", ".join(f"{_index(c, 'retail_fact')} AS {c}" for c in _CATS) + " FROM retail_fact")
put("encoded_scoring", RAW + DICTIONARY, "SELECT sale_date, " + ", ".join(
    f"{c}, {_index(c, 'raw')} AS {c}_index" for c in _CATS) + " FROM raw")
put("unseen_categories", RAW + DICTIONARY, f"""SELECT "column", label, count(*) AS rows FROM ({_long('raw')}) r
  WHERE NOT EXISTS (SELECT 1 FROM dictionary d WHERE d."column" = r."column" AND d.label = r.label) GROUP BY 1, 2""")
put("feature_matrix", SERIES + DICTIONARY, f"""SELECT {DAY}, round(ln(1 + least(greatest(units_sold, 0), 1000)), 6) AS target, """
    + ", ".join(f"{_index(c, 'series')} AS {c}" for c in _CATS)
    + ", " + rnd(["inventory_level", "units_ordered", "price", "discount", "competitor_price"]) + ", promotion, " + _CALENDAR
    + ", " + rnd(_LAG_NAMES + _ROLL_NAMES) + " FROM series WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _LAG_NAMES + _ROLL_NAMES))

# --- metrics ---
NAIVE = FACT + f""",
fixed AS (
  SELECT sale_date, store_id, product_id, units_sold AS actual, lag(units_sold, 1) OVER ({_SERIES}) AS last_day,
    lag(units_sold, 7) OVER ({_SERIES}) AS last_week,
    avg(units_sold) OVER ({_SERIES} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean_week,
    avg(units_sold) OVER ({_SERIES} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS mean_month
  FROM retail_fact
),
naive AS (SELECT * FROM fixed WHERE last_day IS NOT NULL AND last_week IS NOT NULL)"""
METRICS = NAIVE + """,
long AS (UNPIVOT naive ON last_day, last_week, mean_week, mean_month INTO NAME model VALUE predicted),
measured AS (
  SELECT model, 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) AS r2,
    sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs(actual - predicted)) AS mae,
    avg(abs((actual - predicted) / greatest(actual, 1e-6))) * 100 AS mape,
    sum(abs(actual - predicted)) / sum(actual) * 100 AS wape,
    100 * avg(2 * abs(predicted - actual) / (abs(actual) + abs(predicted) + 1e-8)) AS smape
  FROM long GROUP BY model
)"""
put("model_metrics", METRICS, f"SELECT model, {rnd(['r2', 'rmse', 'mae', 'mape', 'wape', 'smape'])} FROM measured")
put("wape_ratio", NAIVE, "SELECT round(sum(abs(actual - mean_week)) / (sum(abs(actual)) + 1e-8), 6) AS wape_ratio FROM naive")
_WEIGHTS = "SELECT model, round(greatest(0.0, r2) / sum(greatest(0.0, r2)) OVER (), 6) AS weight FROM measured"
put("ensemble_weights", METRICS, _WEIGHTS)
put("model_weights", METRICS, _WEIGHTS)


def _clipped(predicted: str) -> str:
    return NAIVE + f""",
upper AS (SELECT quantile_cont(actual, 0.99) AS u FROM naive),
clipped AS (
  SELECT sale_date, store_id, product_id, least(greatest(actual, 0.0), u) AS actual_clipped,
    least(greatest({predicted}, 0.0), u) AS predicted_clipped
  FROM naive, upper
)"""


put("residuals", _clipped("mean_week"), f"""SELECT {ROW}, {rnd(['actual_clipped', 'predicted_clipped'])},
  round(actual_clipped - predicted_clipped, 6) AS residual FROM clipped""")
put("demand_histogram", _clipped("last_day") + """,
cells AS (SELECT 'actual_clipped' AS series, actual_clipped AS v FROM clipped
  UNION ALL SELECT 'predicted_clipped', predicted_clipped FROM clipped),
bounds AS (SELECT series, min(v) AS lo, max(v) AS hi FROM cells GROUP BY series)""",
    """SELECT series, CAST(least(floor((v - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS rows
FROM cells JOIN bounds USING (series) GROUP BY 1, 2""")
put("dataset_profile", FACT, """SELECT count(*) AS rows, 14 AS columns, CAST(min(sale_date) AS VARCHAR) AS first_date,
  CAST(max(sale_date) AS VARCHAR) AS last_date, round(avg(units_sold), 6) AS target_mean,
  round(stddev_samp(units_sold), 6) AS target_std FROM retail_fact""")
put("scoring_fill", FACT, f"""SELECT {ROW}, round((SELECT avg(units_sold) FROM retail_fact), 6) AS units_sold_lag_30,
  round((SELECT avg(inventory_level) FROM retail_fact), 6) AS inventory_lag_1,
  round((SELECT avg(units_sold) FROM retail_fact), 6) AS units_sold_rolling_mean_7,
  round((SELECT stddev_samp(units_sold) FROM retail_fact), 6) AS units_sold_rolling_std_14 FROM retail_fact""")

# --- decisions ---
put("demand_heuristic", EST, f"""SELECT {ROW}, greatest(10.0, units_sold * (1.0 - (price / 100) * 0.1)
  * (1.0 + (discount / 100) * 0.5) * CASE WHEN promotion <> 0 THEN 1.3 ELSE 1.0 END
  * (0.9::DOUBLE + (1.1::DOUBLE - 0.9::DOUBLE) * {unif("'heuristic'")})) AS demand FROM valid""")
put("demand_naive", EST, f"SELECT {ROW}, greatest(10.0, units_sold * (0.8::DOUBLE + (1.2::DOUBLE - 0.8::DOUBLE) * {unif(chr(39) + 'naive' + chr(39))})) AS demand FROM valid")
put("forecast_a", EST + forecast("A", True), f"SELECT {ROW}, dates, demands, trends FROM fc")
put("forecast_b", EST_B + forecast("B", True), f"SELECT {ROW}, dates, demands, trends FROM fc")
put("forecast_trend", EST + forecast("A"), f"SELECT {ROW}, dates, trends FROM fc")
put("forecast_totals", EST_B + forecast("B"), f"SELECT {ROW}, round(total_30day, 6) AS total_30day, round(lead, 6) AS lead_time_demand FROM fc")
put("forecast_first7", EST + forecast("A"), f"""SELECT {ROW}, CAST(i AS INT) AS day, CAST(d AS VARCHAR) AS forecast_date,
  v AS forecast_demand FROM days WHERE i < 7""")
put("forecast_normalized", EST_B + forecast("B"), f"""SELECT {ROW}, CASE WHEN day(sale_date) % 3 = 2 THEN '' ELSE dates END AS dates,
  CASE WHEN day(sale_date) % 3 = 2 THEN '' ELSE demands END AS demands,
  CASE WHEN day(sale_date) % 3 = 2 THEN '' ELSE trends END AS trends FROM fc""")
_PRICE_COLUMNS = "recommended_discount, pricing_strategy, pricing_reasoning, recommended_price"
_REORDER_COLUMNS = "current_inventory, days_of_supply, reorder_point, order_quantity, urgency, reorder_action, reorder_reasoning"
put("pricing_a", DONE_A, f"SELECT {ROW}, {_PRICE_COLUMNS} FROM done")
put("pricing_b", DONE_B, f"SELECT {ROW}, {_PRICE_COLUMNS} FROM done")
put("price_impact", DONE_A, f"SELECT {ROW}, volume_change, revenue_change, old_revenue, new_revenue FROM done")
put("price_impact_b", DONE_B, f"SELECT {ROW}, volume_change, revenue_change, old_revenue, new_revenue FROM done")
put("reorder_a", DONE_A, f"SELECT {ROW}, {_REORDER_COLUMNS}, safety_stock FROM done")
put("reorder_b", DONE_B, f"SELECT {ROW}, {_REORDER_COLUMNS}, lead_time_demand FROM done")
put("health_a", DONE_A, f"SELECT {ROW}, health_score FROM done")
put("health_b", DONE_B, f"SELECT {ROW}, health_score FROM done")
put("health_band", DONE_A, f"""SELECT {ROW}, health_score,
  CASE WHEN health_score >= 80 THEN 'green' WHEN health_score >= 60 THEN 'yellow' ELSE 'red' END AS health_band FROM done""")
put("stockout_date", DONE_B, f"SELECT {ROW}, CAST(stockout_date AS VARCHAR) AS stockout_date FROM done")
put("stockout_risk", DONE_B + ", risk_a AS (WITH " + DONE_A.strip() + f" SELECT {KEY}, stockout_risk AS risk_a FROM done)",
    f"SELECT {ROW}, risk_a, stockout_risk AS risk_b FROM done JOIN risk_a USING ({KEY})")
put("eoq", EST, f"""SELECT {ROW}, sqrt((2 * (demand * 365) * 50) / (price * 0.25)) AS eoq_a,
  least(sqrt((2 * (demand * 365) * 50) / (price * 0.25)), demand * 90) AS eoq_b, demand * 30 AS eoq_free FROM est""")
_ALERT_FIELDS = 'a."type" AS "type", a.severity AS severity, a.message AS message, a.details AS details, a.action AS action'
put("alerts_a", DONE_A + ", lines AS (SELECT *, unnest(alerts) AS a FROM done)", f"SELECT {ROW}, {_ALERT_FIELDS} FROM lines")
put("alerts_b", DONE_B + ", lines AS (SELECT *, unnest(alerts) AS a FROM done)", f"SELECT {ROW}, {_ALERT_FIELDS} FROM lines")
_PLAN_A = "plan_a AS (" + "WITH " + DONE_A.strip() + f" SELECT {KEY}, plan AS plan_a FROM done)"
put("action_plan", DONE_B + ", " + _PLAN_A, f"SELECT {ROW}, plan_a, plan AS plan_b FROM done JOIN plan_a USING ({KEY})")


def _report(demand: str, confidence: float, total: str = "fc.total_30day") -> str:
    return f"""SELECT CAST(sale_date AS VARCHAR) AS sale_date, store_id, product_id, category, region,
  '2024-01-01 00:00:00' AS analysis_timestamp, {demand} AS immediate_demand, {total} AS total_30day_forecast,
  CAST({confidence} AS DOUBLE) AS confidence_score, price AS current_price, discount AS current_discount, recommended_price,
  recommended_discount, pricing_strategy AS strategy, volume_change AS expected_volume_change,
  revenue_change AS expected_revenue_change, old_revenue, new_revenue, current_inventory, days_of_supply, reorder_point,
  order_quantity AS recommended_order_quantity, urgency AS reorder_urgency, reorder_action, stockout_risk,
  array_to_string(list_transform(alerts, lambda a: a."type"), ',') AS alert_types,
  array_to_string(list_transform(alerts, lambda a: a.details), ',') AS alert_details,
  health_score AS overall_health_score FROM done"""


put("full_report", DONE_A_FC, _report("round_even(demand, 2)", 0.85) + f" JOIN fc USING ({KEY})")
put("full_report_b", DONE_B, _report("demand", 0.5, "total_30day"))
put("error_report", BULK, """SELECT sale_date, store_id, product_id, category, 'Unknown' AS region,
  '2024-01-01 00:00:00' AS analysis_timestamp, 50.0::DOUBLE AS immediate_demand, 1500.0::DOUBLE AS total_30day_forecast,
  0.5::DOUBLE AS confidence_score, price AS current_price, discount AS current_discount, price AS recommended_price,
  discount AS recommended_discount, 'MAINTAIN' AS strategy, 0.0::DOUBLE AS expected_volume_change,
  0.0::DOUBLE AS expected_revenue_change, 1500.0::DOUBLE AS old_revenue, 1500.0::DOUBLE AS new_revenue,
  CAST(inventory_level AS DOUBLE) AS current_inventory, 2.0::DOUBLE AS days_of_supply, 100.0::DOUBLE AS reorder_point,
  50.0::DOUBLE AS recommended_order_quantity, 'MEDIUM' AS reorder_urgency, 'MONITOR' AS reorder_action,
  'Unknown risk due to analysis error' AS stockout_risk, 'SYSTEM_ERROR' AS alert_types, reject_reason AS alert_details,
  50 AS overall_health_score FROM bulk WHERE reject_reason IS NOT NULL""")
put("bulk_results", BULK + validated("(SELECT * FROM bulk WHERE reject_reason IS NULL)") + PRICED_A + REORDER_A + finish("A"),
    """SELECT sale_date, sha256('run1_' || request_id) AS id, store_id, product_id, category, round_even(demand, 2) AS predicted_demand,
  order_quantity AS reorder_qty, recommended_price, health_score FROM done""")
put("bulk_history", BULK + validated("(SELECT * FROM bulk WHERE reject_reason IS NULL)") + PRICED_A + REORDER_A + finish("A"),
    """SELECT sha256('run1_' || request_id) AS prediction_id, CAST(1 AS BIGINT) AS user_id, store_id, product_id, category,
  input_json AS input_data, round_even(demand, 2) AS demand_forecast, recommended_price, order_quantity AS reorder_quantity,
  health_score FROM done""")
put("top_products", DONE_A, """SELECT product_id, sum(order_quantity) AS total_order_quantity,
  count(*) FILTER (WHERE urgency = 'HIGH') AS high_urgency_rows, round(avg(health_score), 6) AS mean_health_score
FROM done GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")

# --- history, alerts, exports ---
_REPORT_STRUCT = """struct_pack(
    product_info := struct_pack(store_id := store_id, product_id := product_id, category := category, region := region,
      analysis_timestamp := '2024-01-01 00:00:00'),
    demand_forecast := struct_pack(immediate_demand := round_even(demand, 2), total_30day_forecast := total_30day,
      confidence_score := 0.85::DOUBLE, daily_forecasts := listed),
    pricing_strategy := struct_pack(current_price := price, current_discount := discount, competitor_price := competitor_price,
      recommended_price := recommended_price, recommended_discount := recommended_discount,
      pricing_strategy := pricing_strategy, reasoning := pricing_reasoning,
      expected_impact := struct_pack(expected_volume_change := volume_change, expected_revenue_change := revenue_change,
        old_revenue := old_revenue, new_revenue := new_revenue)),
    inventory_management := struct_pack(current_inventory := current_inventory, days_of_supply := days_of_supply,
      reorder_point := reorder_point, safety_stock := safety_stock, recommended_order_quantity := order_quantity,
      reorder_urgency := urgency, reorder_action := reorder_action, reasoning := reorder_reasoning,
      stockout_risk := stockout_risk),
    business_alerts := alerts, overall_health_score := health_score)"""
REPORTS = DONE_A_FC + f",\nreports AS (SELECT *, {_ID} AS prediction_id FROM done JOIN fc USING ({KEY}))"
put("history_rows", REPORTS, f"""SELECT prediction_id, {_USER} AS user_id, store_id, product_id, category,
  CAST(input_json AS VARCHAR) AS input_data, CAST(to_json({_REPORT_STRUCT}) AS VARCHAR) AS prediction_result,
  round_even(demand, 2) AS demand_forecast, recommended_price, order_quantity AS reorder_quantity, health_score,
  strftime(sale_date, '%Y-%m-%d 00:00:00') AS created_at FROM reports""")
_HEADER = """export_info := struct_pack(exported_at := '2024-01-02 00:00:00', prediction_id := prediction_id,
      product_id := product_id, store_id := store_id),
    """
put("export_report_json", REPORTS, f"""SELECT prediction_id,
  CAST(to_json({_REPORT_STRUCT.replace('struct_pack(', 'struct_pack(' + _HEADER, 1)}) AS VARCHAR) AS export FROM reports""")


def _line(section: str, key: str, value: str = "NULL", extra: str = "NULL", more: str = "NULL") -> str:
    key = key if key.startswith(("d.", "a.")) else f"'{key}'"
    return (f"struct_pack(section := '{section}', key := {key}, value := CAST({value} AS VARCHAR), "
            f"extra := CAST({extra} AS VARCHAR), more := CAST({more} AS VARCHAR))")


_T, _I, _D = "RETAIL ANALYSIS EXPORT", "PRODUCT INFORMATION", "DEMAND FORECAST"
_P, _M, _B = "PRICING STRATEGY", "INVENTORY MANAGEMENT", "BUSINESS ALERTS"
_BEFORE = ", ".join([
    _line(_T, "Exported at", "'2024-01-02 00:00:00'"), _line(_T, "Prediction ID", "prediction_id"),
    _line(_T, "Product ID", "product_id"), _line(_T, "Store ID", "store_id"), _line(_I, "Store", "store_id"),
    _line(_I, "Product", "product_id"), _line(_I, "Category", "category"), _line(_I, "Region", "region"),
    _line(_I, "Analysis Timestamp", "'2024-01-01 00:00:00'"), _line(_I, "Health Score", "health_score"),
    _line(_D, "Immediate Demand", "round_even(demand, 2)"), _line(_D, "30-Day Forecast", "total_30day"),
    _line(_D, "Confidence Score", "0.85"),
])
_AFTER = ", ".join([
    _line(_P, "Current Price", "price"), _line(_P, "Recommended Price", "recommended_price"),
    _line(_P, "Current Discount", "discount"), _line(_P, "Recommended Discount", "recommended_discount"),
    _line(_P, "Strategy", "pricing_strategy"), _line(_P, "Expected Revenue Change", "revenue_change"),
    _line(_M, "Current Inventory", "current_inventory"), _line(_M, "Days of Supply", "days_of_supply"),
    _line(_M, "Reorder Point", "reorder_point"), _line(_M, "Recommended Order Quantity", "order_quantity"),
    _line(_M, "Reorder Urgency", "urgency"), _line(_M, "Stockout Risk", "stockout_risk"),
])
put("export_report_csv", REPORTS + f""",
written AS (
  SELECT prediction_id, list_concat([{_BEFORE}], [{_line('DAILY FORECAST (Next 7 Days)', 'Date', "'Forecasted Demand'")}],
    list_transform(listed[1:7], lambda d: {_line('DAILY FORECAST (Next 7 Days)', 'd."date"', 'd.demand')}), [{_AFTER}],
    CASE WHEN len(alerts) > 0
      THEN list_concat([{_line(_B, 'Type', "'Severity'", "'Message'", "'Action'")}],
        list_transform(alerts, lambda a: {_line(_B, 'a."type"', 'a.severity', 'a.message', 'a.action')}))
      ELSE [{_line(_B, 'No active alerts')}] END) AS ls
  FROM reports
)""", """SELECT prediction_id, array_to_string(list_transform(ls, lambda l: concat_ws(',',
""" + ",\n".join(f"""  coalesce(CASE WHEN regexp_matches(l.{c}, '[",\r\n]') THEN '"' || replace(l.{c}, '"', '""') || '"' ELSE l.{c} END, '')"""
                for c in ("section", "key", "value", "extra", "more")) + """)), chr(10)) AS export
FROM written""")
put("export_history", HISTORY, """SELECT prediction_id, user_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, store_id,
  product_id, category, demand_forecast, recommended_price, reorder_quantity, health_score FROM history""")
put("export_history_csv", HISTORY, """SELECT prediction_id, strftime(created_at, '%Y-%m-%d') AS date, store_id, product_id, category,
  demand_forecast, recommended_price, reorder_quantity, health_score FROM history""")
put("report_metrics_long", HISTORY, """SELECT prediction_id, 'Product ID' AS metric, product_id AS value FROM history
UNION ALL SELECT prediction_id, 'Store ID', store_id FROM history
UNION ALL SELECT prediction_id, 'Demand Forecast', CAST(demand_forecast AS VARCHAR) FROM history
UNION ALL SELECT prediction_id, 'Recommended Price', CAST(recommended_price AS VARCHAR) FROM history
UNION ALL SELECT prediction_id, 'Reorder Quantity', CAST(reorder_quantity AS VARCHAR) FROM history""")
put("alert_rows", ALERTS, f"""SELECT alert_id, user_id, prediction_id, store_id, product_id, alert_type, severity, message, details,
  'raise' AS event, {ts('raised_at', 'event_at')} FROM raised""")
put("alert_state", ALERTS, f"""SELECT alert_id, user_id, prediction_id, store_id, product_id, alert_type, severity, message, details,
  resolved, {ts('created_at')}, {ts('resolved_at')} FROM state""")
_BOTH = HISTORY + ", " + "state AS (WITH " + ALERTS.strip() + " SELECT * FROM state)"
put("history_with_alerts", _BOTH, f"""SELECT h.prediction_id, h.user_id, h.store_id, h.product_id, category, demand_forecast,
  recommended_price, reorder_quantity, health_score, {ts('h.created_at', 'created_at')}, alert_id, alert_type, severity, message,
  resolved FROM history h LEFT JOIN state s ON s.prediction_id = h.prediction_id""")
ORACLES["stored_history_with_alerts"] = ORACLES["history_with_alerts"]
_NEWEST = "row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, {id})"
put("recent_predictions", HISTORY, f"""SELECT user_id, prediction_id, store_id, product_id, demand_forecast, recommended_price,
  reorder_quantity, {ts('created_at')}, CAST(rank AS INT) AS rank
FROM (SELECT *, {_NEWEST.format(id='prediction_id')} AS rank FROM history) WHERE rank <= 5""")
put("recent_alerts", ALERTS, f"""SELECT user_id, alert_id, alert_type, severity, product_id, message,
  left(details, 60) || '...' AS preview, {ts('created_at')}, CAST(rank AS INT) AS rank
FROM (SELECT *, {_NEWEST.format(id='alert_id')} AS rank FROM state WHERE NOT resolved) WHERE rank <= 5""")
put("open_alerts_top10", ALERTS, f"""SELECT user_id, alert_id AS id, alert_type AS "type", severity, message, details,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, store_id, product_id, CAST(rank AS INT) AS rank
FROM (SELECT *, {_NEWEST.format(id='alert_id')} AS rank FROM state WHERE NOT resolved) WHERE rank <= 10""")


def _page(page: int) -> str:
    first, last = (page - 1) * 10 + 1, page * 10
    return f"""SELECT user_id, prediction_id, store_id, product_id, demand_forecast, reorder_quantity, {ts('created_at')}, CAST(rank AS INT) AS rank,
  total, {first} AS from_row, least({last}, total) AS to_row, CAST(ceil(total / 10) AS BIGINT) AS pages
FROM (SELECT *, {_NEWEST.format(id='prediction_id')} AS rank, count(*) OVER (PARTITION BY user_id) AS total FROM history)
WHERE rank BETWEEN {first} AND {last}"""


put("history_page", HISTORY, _page(2))
put("history_deep_page", HISTORY, _page(60))
put("history_summary", HISTORY + f""",
paged AS (SELECT * FROM (SELECT *, {_NEWEST.format(id='prediction_id')} AS rank FROM history) WHERE rank BETWEEN 11 AND 20)""",
    """SELECT user_id, count(*) FILTER (WHERE demand_forecast > 100) AS high_demand_items,
  count(*) FILTER (WHERE reorder_quantity > 0) AS reorder_recommendations,
  strftime(max(created_at), '%m/%d') AS last_analysis FROM paged GROUP BY 1""")
_TITLES = "Prediction ID,Date,Store ID,Product ID,Category,Demand Forecast,Recommended Price,Reorder Quantity,Health Score"
put("export_history_heads", HISTORY, f"""SELECT user_id, 'COMPLETE PREDICTION HISTORY EXPORT' AS title,
  '2024-01-02 00:00:00' AS exported_at, count(*) AS total_predictions, '{_TITLES}' AS column_titles FROM history GROUP BY 1""")
put("export_history_lines", HISTORY + f""",
heads AS (SELECT user_id, unnest(['COMPLETE PREDICTION HISTORY EXPORT', 'Exported at,2024-01-02 00:00:00', 'User,' || user_id,
  'Total Predictions,' || count(*), '', '{_TITLES}']) AS text, unnest([0, 1, 2, 3, 4, 5]) AS line FROM history GROUP BY user_id)""",
    """SELECT user_id, CAST(line AS INT) AS line, text FROM heads
UNION ALL SELECT user_id, NULL, concat_ws(',', prediction_id, strftime(created_at, '%Y-%m-%d'), store_id, product_id, category,
  CAST(demand_forecast AS VARCHAR), CAST(recommended_price AS VARCHAR), CAST(reorder_quantity AS VARCHAR), CAST(health_score AS VARCHAR))
FROM history""")
put("report_read", REPORTS, """SELECT prediction_id, store_id, round_even(demand, 2) AS immediate_demand, total_30day AS total_30day_forecast,
  health_score AS overall_health_score, dates, demands, trends,
  array_to_string(list_transform(alerts, lambda a: a."type"), ',') AS alert_types FROM reports""")
put("dashboard_counts", _BOTH, """SELECT user_id, total_predictions, high_demand_products, reorder_recommendations,
  coalesce(active_alerts, 0) AS active_alerts
FROM (SELECT user_id, count(*) AS total_predictions, count(*) FILTER (WHERE demand_forecast > 100) AS high_demand_products,
    count(*) FILTER (WHERE reorder_quantity > 0) AS reorder_recommendations FROM history GROUP BY 1) h
  LEFT JOIN (SELECT user_id, count(*) AS active_alerts FROM state WHERE NOT resolved GROUP BY 1) s USING (user_id)""")
put("report_by_id", HISTORY, f"""SELECT {_HISTORY_COLUMNS} FROM history
WHERE prediction_id = (SELECT min(prediction_id) FROM history)""")


# --- learned combinations of the fixed predictors ---
put("alert_stream_state", ALERTS, f"""SELECT alert_id, user_id, prediction_id, store_id, product_id, alert_type, severity, message, details,
  resolved, {ts('created_at')}, {ts('resolved_at')} FROM state""")
put("metrics_json", METRICS, f"SELECT model, {rnd(['r2', 'rmse', 'mae'])} FROM measured")
HYBRID = METRICS + """,
positive AS (SELECT model, greatest(0.0, r2) / sum(greatest(0.0, r2)) OVER () AS weight FROM measured),
w AS (SELECT max(weight) FILTER (WHERE model = 'last_day') AS wd, max(weight) FILTER (WHERE model = 'last_week') AS ww,
  max(weight) FILTER (WHERE model = 'mean_week') AS mw, max(weight) FILTER (WHERE model = 'mean_month') AS mm FROM positive),
combined AS (SELECT n.*, coalesce(last_day * wd + last_week * ww + mean_week * mw + mean_month * mm,
    (last_day + last_week + mean_week + mean_month) / 4) AS hybrid FROM naive n, w)"""
put("hybrid_weighted", HYBRID, f"SELECT {ROW}, round(actual, 4) AS actual, round(hybrid, 4) AS hybrid FROM combined")
put("trained_metrics", HYBRID + """,
all_long AS (UNPIVOT combined ON last_day, last_week, mean_week, mean_month, hybrid INTO NAME model VALUE predicted),
all_measured AS (
  SELECT model, 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) AS r2,
    sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs(actual - predicted)) AS mae,
    avg(abs((actual - predicted) / greatest(actual, 1e-6))) * 100 AS mape,
    sum(abs(actual - predicted)) / sum(actual) * 100 AS wape,
    100 * avg(2 * abs(predicted - actual) / (abs(actual) + abs(predicted) + 1e-8)) AS smape
  FROM all_long GROUP BY model
)""", f"SELECT model, {rnd(['r2', 'rmse', 'mae', 'mape', 'wape', 'smape'], 5)} FROM all_measured")
put("sample_series", NAIVE, f"""SELECT {ROW}, round(actual, 6) AS actual, round(mean_week, 6) AS predicted
FROM (SELECT * FROM naive ORDER BY sale_date, store_id, product_id LIMIT 200)""")
