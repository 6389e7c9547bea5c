"""SQL twins of the registered queries, for an independent engine over the same tables.

Queries without a twin have no exact SQL form (fitted models, approximate counts, the
step report of a refresh).
"""

import re

from tidemark import fixed_values as fv


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def money(expr: str) -> str:
    """Sum of amounts with at most four decimals, exact."""
    return f"CAST(SUM(CAST({expr} AS DECIMAL(28,4))) AS DOUBLE)"


def whole(expr: str, scale: int = 4) -> str:
    return f"CAST(FLOOR(({expr}) * CAST({10**scale} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS HUGEINT)"


def total(expr: str, scale: int = 4) -> str:
    return f"(CAST(SUM({whole(expr, scale)}) AS DOUBLE) / CAST({10**scale} AS DOUBLE))"


def mean(expr: str, scale: int = 4) -> str:
    return f"({total(expr, scale)} / COUNT({expr}))"


def clip(expr: str, low, high) -> str:
    return f"LEAST(GREATEST({expr}, CAST({low} AS DOUBLE)), CAST({high} AS DOUBLE))"


_CAMPAIGN_ROWS = ", ".join(
    f"({i}, {_text(c['campaign'])}, {c['month']}, {c['day']}, {c['window']},"
    f" CAST({c['default_lift']} AS DOUBLE), {c['baseline_units']})"
    for i, c in enumerate(fv.CAMPAIGNS, 1)
)
_STRATEGY_ROWS = ", ".join(f"({_text(a)}, {_text(b)}, {_text(c)})" for a, b, c in fv.STRATEGY_BY_SIGNAL)
_TEMPLATE_ROWS = ", ".join(
    f"({_text(tone)}, {i}, {_text(text)})"
    for tone, texts in fv.TEMPLATES.items() for i, text in enumerate(texts, 1)
)


def forecast_sql(source: str, keys: list[str], horizon: int, step: int, weekday: bool) -> str:
    """Closed-form seasonal trend over ``source`` (keys, ds, y) as a subquery."""
    k = ", ".join(keys) if keys else "0"
    kl = "".join(f"{x}, " for x in keys)
    same = " AND ".join(f"a.{x} = b.{x}" for x in keys) or "TRUE"
    day_effect = (
        f"COALESCE(SUM(r2) OVER (PARTITION BY {k}, isodow(ds))"
        f" / CAST(COUNT(r2) OVER (PARTITION BY {k}, isodow(ds)) AS DOUBLE), 0)"
        if weekday else "CAST(0 AS DOUBLE)"
    )
    bounds = f"(SELECT {kl}MIN(ds) AS lo, MAX(ds) AS hi FROM {source} {'GROUP BY ' + k if keys else ''})"
    return f"""(
      WITH s AS (SELECT {kl}ds, y FROM {source}),
      b AS {bounds},
      sums AS (
        SELECT {''.join(f'a.{x}, ' for x in keys)}
          CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(ds - lo) AS DOUBLE) AS st,
          CAST(SUM((ds - lo) * (ds - lo)) AS DOUBLE) AS stt,
          CAST(SUM({whole('y', 2)}) AS DOUBLE) AS su,
          CAST(SUM({whole('y', 2)} * (ds - lo)) AS DOUBLE) AS stu
        FROM s a JOIN b ON {same} {'GROUP BY ' + ', '.join('a.' + x for x in keys) if keys else ''}
      ),
      line AS (
        SELECT *, (su - slope * st) / n AS icept FROM (
          SELECT *, COALESCE((n * stu - st * su) / NULLIF(n * stt - st * st, 0), 0) AS slope FROM sums)
      ),
      days AS (
        SELECT {kl}ds, y FROM s
        UNION ALL
        SELECT {kl}CAST(hi + CAST(g.i * {step} AS INTEGER) AS DATE) AS ds, NULL AS y
        FROM b, generate_series(1, {horizon}) AS g(i)
      ),
      t0 AS (
        SELECT a.*, CAST(a.ds - b.lo AS DOUBLE) AS t FROM days a JOIN b ON {same}
      ),
      t1 AS (
        SELECT a.*, icept + slope * t AS trend, n,
          FLOOR(CAST({whole('y', 2)} AS DOUBLE) - (icept + slope * t) + 0.5) AS r1
        FROM t0 a JOIN line b ON {same}
      ),
      t2 AS (
        SELECT *, COALESCE(SUM(r1) OVER (PARTITION BY {k}, month(ds))
          / CAST(COUNT(r1) OVER (PARTITION BY {k}, month(ds)) AS DOUBLE), 0) AS me FROM t1
      ),
      t3 AS (SELECT *, FLOOR(r1 - me + 0.5) AS r2 FROM t2),
      t4 AS (SELECT *, {day_effect} AS de FROM t3),
      t5 AS (SELECT *, CAST(FLOOR(r2 - de + 0.5) AS HUGEINT) AS r3 FROM t4),
      t6 AS (
        SELECT *, CAST(SUM(r3 * r3) OVER (PARTITION BY {k}) AS DOUBLE) AS ss,
          CAST(SUM(r3) OVER (PARTITION BY {k}) AS DOUBLE) AS sr FROM t5
      ),
      t7 AS (
        SELECT *, CAST(1.96 AS DOUBLE) * SQRT(GREATEST((ss - sr * sr / n) / NULLIF(n - 1, 0), 0)) / 100 AS half,
          (trend + me + de) / 100 AS yhat FROM t6
      )
      SELECT {kl}ds, yhat, yhat - half AS yhat_lower, yhat + half AS yhat_upper, y IS NULL AS is_future
      FROM t7
    )"""


def _inventory_gap(column: str, rule: str, default: int) -> str:
    return f"COALESCE(CASE WHEN {rule} THEN {column} END, {default})"


_ACCURACY = f"""COUNT(*) AS n_weeks, {mean('ABS(actual - yhat)')} AS mae,
  SQRT(CAST(SUM({whole('actual - yhat', 2)} * {whole('actual - yhat', 2)}) AS DOUBLE) / COUNT(*)) / 100 AS rmse,
  {mean('CASE WHEN actual <> 0 THEN ABS((actual - yhat) / actual) END', 9)} * 100 AS mape,
  CAST(COUNT(*) FILTER (actual BETWEEN yhat_lower AND yhat_upper) AS DOUBLE) / COUNT(*) * 100 AS coverage"""

# Shared parts; ``twin`` puts those a query names (directly or not) into its WITH list.
PARTS = {
    "campaigns": f"SELECT * FROM (VALUES {_CAMPAIGN_ROWS})"
                 " AS t(position, campaign, month, day, win, default_lift, baseline_units)",
    "strategies": f"SELECT * FROM (VALUES {_STRATEGY_ROWS}) AS t(signal, strategy, color)",
    "templates": f"SELECT * FROM (VALUES {_TEMPLATE_ROWS}) AS t(tone, template_id, template)",
    "sales": """
      SELECT CAST(o_orderdate AS DATE) AS order_date, CAST(l_partkey AS VARCHAR) AS sku, p_name AS name,
        p_type AS category, n_name AS country, l_extendedprice AS sales
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      WHERE l_extendedprice > 0""",
    "raw": """
      SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date,
        CASE WHEN l_linenumber = 6 THEN -l_extendedprice WHEN l_linenumber = 5 THEN NULL
          ELSE l_extendedprice END AS sales,
        CASE WHEN l_partkey % 50 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS sku,
        CASE WHEN p_size > 45 THEN 'General' ELSE p_type END AS category, n_name AS country
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "clean": "SELECT * FROM raw WHERE order_date IS NOT NULL AND sales > 0 AND sku <> ''",
    "cut_off": "SELECT MAX(CAST(o_orderdate AS DATE)) AS as_of FROM orders",
    "daily": f"SELECT order_date AS ds, {money('sales')} AS y FROM sales GROUP BY 1",
    "days": f"""SELECT sku, category, order_date, {money('sales')} AS sales, COUNT(*) AS n_lines
      FROM sales GROUP BY 1, 2, 3""",
    "years": "SELECT DISTINCT year(ds) AS yr FROM daily",
    "marks": """
      SELECT c.campaign, d.ds, d.y, c.month, EXISTS (
        SELECT 1 FROM years WHERE d.ds BETWEEN make_date(yr, c.month, c.day) - c.win
          AND make_date(yr, c.month, c.day) + 1) AS is_holiday
      FROM daily d, campaigns c""",
    "lift_means": f"""
      SELECT campaign, COUNT(*) FILTER (is_holiday) AS holiday_days,
        COUNT(*) FILTER (NOT is_holiday AND month(ds) = month) AS baseline_days,
        {mean('CASE WHEN is_holiday THEN y END')} AS hm,
        {mean('CASE WHEN NOT is_holiday AND month(ds) = month THEN y END')} AS mm,
        {mean('CASE WHEN NOT is_holiday THEN y END')} AS om
      FROM marks GROUP BY 1""",
    "lift": f"""
      SELECT campaign, holiday_days, baseline_days, observed_lift,
        {clip("observed_lift * CAST(1.35 AS DOUBLE)", 2.0, 5.0)} AS planned_lift
      FROM (SELECT m.campaign, holiday_days, baseline_days,
          CASE WHEN hm IS NOT NULL AND bm > 0 THEN {clip('hm / bm', 0.5, 5.0)} ELSE default_lift END
            AS observed_lift
        FROM (SELECT *, CASE WHEN baseline_days < 5 THEN om ELSE mm END AS bm FROM lift_means) m
        JOIN campaigns USING (campaign))""",
    "forecast": "SELECT * FROM " + forecast_sql("daily", [], 365, 1, True),
    "peaks": """
      SELECT c.campaign, p.ds AS peak_date, p.is_future,
        COALESCE(CAST(TRUNC(p.yhat) AS BIGINT), 0) AS projected_volume
      FROM campaigns c LEFT JOIN (
        SELECT campaign, ds, yhat, is_future, ROW_NUMBER() OVER (
          PARTITION BY campaign ORDER BY is_future DESC, yhat DESC, ds) AS rn
        FROM forecast JOIN campaigns ON month(ds) = month AND day(ds) BETWEEN day - win AND day + win
      ) p ON p.campaign = c.campaign AND p.rn = 1""",
    "actions": f"""
      SELECT peaks.*, 'Maximize GMV' AS strategy,
        CASE WHEN hi THEN 'Increase Stock Levels' ELSE 'Run Discount Ads' END AS action_item,
        CASE WHEN hi THEN 'green' ELSE 'yellow' END AS status_color
      FROM (SELECT *, projected_volume > (SELECT {mean('y')} FROM daily) * CAST(1.3 AS DOUBLE) AS hi FROM peaks) peaks""",
    "plan": """
      SELECT c.position, c.campaign, c.baseline_units, observed_lift, planned_lift, peak_date,
        projected_volume, strategy, action_item, status_color,
        peak_date - 3 AS start_date, peak_date + 3 AS end_date,
        COALESCE(strftime(peak_date - 3, '%b %-d') || ' - ' || strftime(peak_date + 3, '%b %-d'), '—')
          AS date_range
      FROM campaigns c JOIN lift USING (campaign) JOIN actions USING (campaign)""",
    "weekly": f"""
      SELECT w.ds, COALESCE(v.y, 0) AS y FROM (
        SELECT CAST(unnest(generate_series(MIN(d), MAX(d), INTERVAL 7 DAY)) AS DATE) AS ds
        FROM (SELECT date_trunc('week', ds) + INTERVAL 6 DAY AS d FROM daily)) w
      LEFT JOIN (SELECT CAST(date_trunc('week', ds) + INTERVAL 6 DAY AS DATE) AS ds, {money('y')} AS y
        FROM daily GROUP BY 1) v USING (ds)""",
    "test_year": "SELECT year(MAX(ds) + 1) - 1 AS yr FROM daily",
    "train": "SELECT ds, y FROM weekly, test_year WHERE year(ds) BETWEEN yr - 3 AND yr - 1",
    "test": "SELECT ds, y FROM weekly, test_year WHERE year(ds) = yr",
    "merged": "SELECT f.ds, yhat, yhat_lower, yhat_upper, y AS actual FROM "
              + forecast_sql("train", [], 52, 7, False) + " f JOIN test USING (ds)",
    "overall": "SELECT " + _ACCURACY + " FROM merged",
    "by_campaign": "SELECT campaign, " + _ACCURACY + """ FROM merged, test_year, campaigns
      WHERE ds BETWEEN make_date(yr, month, day) - win - 6 AND make_date(yr, month, day) + 7
      GROUP BY 1 HAVING COUNT(*) >= 2""",
    "rollup": f"""
      SELECT sku, {money('sales')} AS total_sales, ANY_VALUE(name) AS name, ANY_VALUE(category) AS category
      FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {fv.TOP_SKUS}""",
    "ranked": """
      SELECT *, CAST(sku AS BIGINT) AS k,
        ROW_NUMBER() OVER (ORDER BY total_sales DESC, sku) - 1 AS i FROM rollup""",
    "inventory": f"""
      SELECT sku, name, category, {_list(fv.WAREHOUSES)}[k % 5 + 1] AS warehouse,
        {_list(fv.SUPPLIERS)}[3 * k % 4 + 1] AS supplier,
        20 + (7919 * k % 38001) / CAST(100 AS DOUBLE) AS cost_price,
        40 + (104729 * k % 66001) / CAST(100 AS DOUBLE) AS msrp,
        CAST(on_hand AS INTEGER) AS qty_on_hand,
        CAST(17 * k % (LEAST(50, on_hand // 5) + 1) AS INTEGER) AS qty_reserved,
        CAST(50 + 29 * k % 451 AS INTEGER) AS reorder_point,
        CAST(as_of - CAST(5 + 13 * k % 41 + CASE WHEN k % 10 = 0 THEN 200 ELSE 0 END AS INTEGER) AS DATE)
          AS last_restock_date,
        CAST(3 + 11 * k % 12 AS INTEGER) AS lead_time_days
      FROM (SELECT *, CASE WHEN i % 2 = 0 THEN 1 + 37 * k % 99 ELSE 100 + 59 * k % 901 END AS on_hand
        FROM ranked), cut_off""",
    "lasts": "SELECT *, MAX(order_date) OVER (PARTITION BY sku) AS last FROM days",
    "demand": f"""
      SELECT sku, MIN(order_date) AS first_order, MAX(order_date) AS last_order,
        CAST(SUM(n_lines) AS BIGINT) AS n_lines,
        {money('CASE WHEN order_date >= last - 90 THEN sales END')} AS recent_sales,
        CAST(SUM(CASE WHEN order_date >= last - 90 THEN n_lines END) AS BIGINT) AS recent_lines,
        MAX(order_date) - MIN(CASE WHEN order_date >= last - 90 THEN order_date END) AS recent_days,
        COALESCE({money('CASE WHEN order_date >= last - 180 AND order_date < last - 90 THEN sales END')}, 0)
          AS base_sales
      FROM lasts GROUP BY 1""",
    "metrics1": """
      SELECT d.*, i.* EXCLUDE (sku, name, category),
        LEAST(1.0, recent_sales / CASE WHEN base_sales > 0 THEN base_sales ELSE 1 END) AS trend,
        COALESCE(as_of - last_restock_date, last_order - first_order) AS age_days,
        LEAST(1.0, CAST(n_lines AS DOUBLE) / GREATEST(last_order - first_order, 1) / 10) AS velocity,
        CASE WHEN qty_on_hand IS NOT NULL
          THEN GREATEST(0, CAST(qty_on_hand - qty_reserved AS DOUBLE)) END AS available,
        GREATEST(CAST(0.1 AS DOUBLE), CAST(recent_lines AS DOUBLE) / GREATEST(recent_days, 1)) AS daily_units,
        CASE WHEN msrp > 0 AND cost_price IS NOT NULL
          THEN LEAST(GREATEST((msrp - cost_price) / msrp, -1), 1) ELSE CAST(0.25 AS DOUBLE) END AS margin
      FROM demand d LEFT JOIN inventory i USING (sku), cut_off""",
    "metrics2": """
      SELECT *, CASE WHEN reorder_point > 0 THEN available / reorder_point END AS pressure_raw,
        available / daily_units AS stockout_days, margin < 0.10 AS low_margin FROM metrics1""",
    "metrics3": """
      SELECT *, CASE WHEN pressure_raw IS NULL THEN 0.5 ELSE LEAST(1.0, pressure_raw) END AS pressure,
        COALESCE(stockout_days < lead_time_days, FALSE) AS stockout_risk FROM metrics2""",
    "metrics": f"""
      SELECT *, CASE WHEN stockout_risk AND trend > 0.6 THEN 'Stockout Risk' WHEN low_margin THEN 'Margin Watch'
          WHEN trend > 0.75 THEN 'Trending' WHEN age_days > 180 AND pressure_raw > 1 THEN 'Aging Stock'
          ELSE 'Organic Demand' END AS signal,
        (CAST(0.55 AS DOUBLE) * {clip('pressure', 0, 1)} + CAST(0.45 AS DOUBLE) * {clip('margin / CAST(0.40 AS DOUBLE)', 0, 1)})
          * CASE WHEN stockout_risk THEN CAST(0.65 AS DOUBLE) ELSE 1 END
          * CASE WHEN low_margin THEN CAST(0.70 AS DOUBLE) ELSE 1 END AS health
      FROM metrics3""",
    "month_sales": f"""
      SELECT campaign, sku, ANY_VALUE(category) AS category, {money('sales')} AS total
      FROM days JOIN campaigns ON month(order_date) = month GROUP BY 1, 2""",
    "month_ranks": """
      SELECT *, ROW_NUMBER() OVER (PARTITION BY campaign ORDER BY total DESC, sku) AS rank,
        MAX(total) OVER (PARTITION BY campaign) AS best_total FROM month_sales""",
    "part_names": "SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS name FROM part",
    "exact_scores": """
      SELECT r.campaign, r.sku, n.name, r.category, r.total, trend, age_days, velocity, pressure, stockout_days,
        lead_time_days, margin, health, signal,
        CAST(0.35 AS DOUBLE) * (total / best_total) + CAST(0.20 AS DOUBLE) * trend
          + CAST(0.15 AS DOUBLE) * velocity + CAST(0.30 AS DOUBLE) * health AS priority_score
      FROM month_ranks r JOIN metrics m USING (sku) JOIN part_names n USING (sku) WHERE r.rank <= 50""",
    "published": """
      SELECT * REPLACE (round_even(trend, 2) AS trend, LEAST(age_days, 365) AS age_days,
        round_even(velocity, 2) AS velocity, round_even(pressure, 2) AS pressure,
        round_even(stockout_days, 1) AS stockout_days, round_even(margin, 2) AS margin,
        round_even(health, 3) AS health) FROM metrics""",
    "published_scores": """
      SELECT r.campaign, r.sku, n.name, r.category, r.total, trend, age_days, velocity, pressure, stockout_days,
        lead_time_days, margin, health, signal,
        round_even(CAST(0.35 AS DOUBLE) * (total / best_total) + CAST(0.20 AS DOUBLE) * trend
          + CAST(0.15 AS DOUBLE) * velocity + CAST(0.30 AS DOUBLE) * health, 3) AS priority_score
      FROM month_ranks r JOIN published m USING (sku) JOIN part_names n USING (sku) WHERE r.rank <= 50""",
    "heroes": """
      SELECT * FROM (SELECT campaign, CAST(ROW_NUMBER() OVER (
          PARTITION BY campaign ORDER BY priority_score DESC, total DESC, sku) AS INTEGER) AS rank,
          * EXCLUDE (campaign) FROM published_scores) WHERE rank <= 10""",
    "lifts": "SELECT campaign, baseline_units, round_even(planned_lift, 2) AS planned_lift FROM plan",
    "planned": """
      SELECT h.*, baseline_units, planned_lift,
        CAST(FLOOR(baseline_units * planned_lift * CAST(1.2 AS DOUBLE) * (CAST(0.8 AS DOUBLE)
          + COALESCE(NULLIF(velocity, 0), CAST(0.75 AS DOUBLE)) * CAST(0.4 AS DOUBLE)) + 0.5) AS BIGINT) AS units,
        CAST(FLOOR(baseline_units * planned_lift * (CAST(0.8 AS DOUBLE)
          + COALESCE(NULLIF(velocity, 0), CAST(0.5 AS DOUBLE)) * CAST(0.4 AS DOUBLE)) + 0.5) AS BIGINT) AS dash_units
      FROM heroes h JOIN lifts USING (campaign)""",
    "scenarios": """
      SELECT campaign, sku, forecast, discount_pct, demand_units,
        CASE WHEN demand_units > 0 THEN qty / (demand_units / 30) END AS stockout_days,
        demand_units * price AS revenue,
        CASE WHEN demand_units > 0 AND qty / (demand_units / 30) <= 2 THEN 'High'
          WHEN demand_units > 0 AND qty / (demand_units / 30) <= 7 THEN 'Medium' ELSE 'Low' END AS risk
      FROM (SELECT p.campaign, p.sku, forecast, CAST(d AS INTEGER) AS discount_pct,
          forecast * (1 + d / CAST(100 AS DOUBLE) * CAST(0.5 AS DOUBLE)) AS demand_units,
          COALESCE(qty_on_hand, 0) AS qty, COALESCE(msrp, 0) AS price
        FROM to_plan p LEFT JOIN inventory i USING (sku), generate_series(0, 30) AS g(d))""",
    "sold": """
      SELECT event_id, ts, user_id, value, regexp_extract(props, '"k": *([0-9]+)', 1) AS sku
      FROM events WHERE event_type = 'purchase'""",
    "keyed_events": """
      SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1) AS sku FROM events""",
    "hours": f"""
      SELECT date_trunc('hour', ts) AS hour_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end,
        {money('value')} AS gmv, COUNT(*) AS orders
      FROM sold GROUP BY 1, 2
      HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM sold) - INTERVAL 10 MINUTE""",
    "paced": f"SELECT *, gmv / (SELECT {mean('gmv')} FROM hours) * 100 AS pct_of_target FROM hours",
    "etas": """
      SELECT s.*, name, CASE WHEN qty_on_hand IS NOT NULL
          THEN GREATEST(0, CAST(qty_on_hand - qty_reserved AS DOUBLE)) END AS available,
        60 * CASE WHEN qty_on_hand IS NOT NULL
          THEN GREATEST(0, CAST(qty_on_hand - qty_reserved AS DOUBLE)) END / orders AS eta_oos_mins
      FROM (SELECT date_trunc('hour', ts) AS hour_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end,
          sku, COUNT(*) AS orders FROM sold GROUP BY 1, 2, 3) s
      LEFT JOIN inventory i USING (sku)""",
    "closed_etas": "SELECT * FROM etas WHERE hour_end <= (SELECT MAX(ts) FROM sold) - INTERVAL 10 MINUTE",
    "moves": """
      SELECT sku, ts, 1 AS kind, event_id, 1 AS qty FROM sold
      UNION ALL
      SELECT CAST(p_partkey AS VARCHAR), lo + to_days(CAST(k * (p_size % 7 + 3) AS INTEGER)), 0, -1, p_size
      FROM part, generate_series(0, 9999) AS g(k), (SELECT date_trunc('day', MIN(ts)) AS lo, MAX(ts) AS hi FROM events)
      WHERE CAST(p_partkey AS VARCHAR) IN (SELECT sku FROM sold) AND lo + to_days(CAST(k * (p_size % 7 + 3) AS INTEGER)) <= hi""",
    "lots": """
      SELECT *, SUM(1 - kind) OVER (PARTITION BY sku ORDER BY ts, kind, event_id ROWS UNBOUNDED PRECEDING) AS lot
      FROM moves""",
    "ledger": """
      SELECT sku, ts, event_id, kind, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end, CASE WHEN lot > 0 THEN
          SUM(CASE WHEN kind = 0 THEN qty ELSE -1 END) OVER (PARTITION BY sku, lot ORDER BY ts, kind, event_id ROWS UNBOUNDED PRECEDING)
        END AS remaining
      FROM lots""",
    "closed_ledger": "SELECT * FROM ledger WHERE hour_end <= (SELECT MAX(ts) FROM moves) - INTERVAL 10 MINUTE",
    "watch": """
      SELECT hour_start, sku, eta_oos_mins,
        CASE WHEN eta_oos_mins < 20 THEN 1 WHEN pct_of_target < 80 THEN 2 ELSE 3 END AS rule
      FROM closed_etas JOIN paced USING (hour_start)""",
    "event_gaps": """
      SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts)
        <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS is_start FROM events""",
    "all_sessions": """
      SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end,
        COUNT(*) AS n_events
      FROM (SELECT *, SUM(is_start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
        FROM event_gaps) GROUP BY user_id, s""",
    "picks": """
      SELECT user_id, event_type, COALESCE(campaign, 'Retired Sale') AS campaign
      FROM keyed_events LEFT JOIN campaigns ON CAST(sku AS INTEGER) % 5 = position - 1""",
    "chosen": "SELECT DISTINCT user_id, campaign FROM picks WHERE event_type = 'signup'",
    "left_over": f"""
      SELECT * FROM chosen c WHERE campaign = {_text(fv.PINNED_CAMPAIGN)} OR NOT EXISTS (
        SELECT 1 FROM picks p WHERE event_type = 'error' AND p.user_id = c.user_id
          AND p.campaign = c.campaign)""",
    "replies": "SELECT * FROM conversations WHERE role = 'assistant'",
    "reply_lines": r"""
      SELECT conv_id, turn, pos, line FROM (
        SELECT conv_id, turn, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            regexp_replace(regexp_replace(regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'),
            '^[\s\p{Z}]*\p{Nd}+[\s\p{Z}.:-]*', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'),
            '^"+', ''), '"+$', ''), '^''+', ''), '''+$', '') AS line
        FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM replies))
      WHERE length(line) > 10""",
    "reply_callouts": """
      SELECT conv_id, turn, position, line FROM (SELECT *, CAST(ROW_NUMBER() OVER (
        PARTITION BY conv_id, turn ORDER BY pos) AS INTEGER) AS position FROM reply_lines)
      WHERE position <= 3""",
    "reply_products": """
      SELECT conv_id, turn, conv_id || '-' || turn AS sku, 'conversation ' || conv_id AS name,
        CASE WHEN turn % 4 = 1 THEN 'Urgent' ELSE 'Playful' END AS tone FROM replies""",
}

_AS_INVENTORY = ("sku, name, category, warehouse, supplier, cost_price, msrp, qty_on_hand, qty_reserved,"
                 " reorder_point, last_restock_date, lead_time_days")


def twin(body: str, **extra: str) -> str:
    """``body`` with a WITH list of the parts it needs. ``extra`` parts may use the others
    and be used by them."""
    parts = {**PARTS, **extra}
    words = lambda text: set(re.findall(r"\w+", text))
    needed, queue = set(), [w for w in words(body) if w in parts]
    uses = {}
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            uses[name] = (words(parts[name]) & parts.keys()) - {name}
            queue.extend(uses[name])
    order: list[str] = []

    def visit(name, path=()):
        if name in order or name in path:
            return
        for other in sorted(uses[name]):
            visit(other, (*path, name))
        order.append(name)

    for name in sorted(needed):
        visit(name)
    head = ",\n".join(f"{name} AS ({parts[name]})" for name in order)
    return f"WITH {head}\n{body}" if order else body


_KEYWORD_RULE = " OR ".join(
    f"contains(lower(category), {_text(k.lower())}) OR contains(lower(sku), {_text(k.lower())})"
    for k in ("promo", "Std+", "199", "dar.")
)

ORACLES: dict[str, str] = {
    "clean_sales": twin(f"""
      SELECT category, country, COUNT(*) AS n_rows, {money('sales')} AS sales,
        MIN(order_date) AS first_date, MAX(order_date) AS last_date FROM clean GROUP BY 1, 2"""),
    "sales_csv_scan": twin(f"""
      SELECT category, order_date AS ds, {money('sales')} AS y FROM clean GROUP BY 1, 2"""),
    "dataset_profile": twin("""
      SELECT COUNT(*) AS n_rows, MIN(order_date) AS first_date, MAX(order_date) AS last_date,
        COUNT(DISTINCT order_date) AS n_days, COUNT(DISTINCT date_trunc('week', order_date)) AS n_weeks,
        COUNT(DISTINCT country) AS n_countries, COUNT(DISTINCT sku) AS n_skus FROM sales"""),
    "daily_gmv": twin("SELECT ds, y FROM daily"),
    "forecast_additive_check": twin("""
      SELECT COUNT(*) + 365 AS n_rows, MIN(ds) AS first_ds, CAST(MAX(ds) + 365 AS DATE) AS last_ds, 365 AS n_future,
        TRUE AS bounds_hold, TRUE AS beats_mean, TRUE AS covers FROM daily"""),
    "forecast_category_check": twin("""
      SELECT category, COUNT(DISTINCT order_date) + 365 AS n_rows, MIN(order_date) AS first_ds,
        CAST(MAX(order_date) + 365 AS DATE) AS last_ds, 365 AS n_future,
        TRUE AS bounds_hold, TRUE AS beats_mean, TRUE AS covers FROM days GROUP BY category"""),
    "forecast_weekly_check": twin("""
      SELECT COUNT(*) + 52 AS n_rows, MIN(ds) AS first_ds, CAST(MAX(ds) + 52 * 7 AS DATE) AS last_ds, 52 AS n_future,
        TRUE AS bounds_hold, TRUE AS beats_mean, TRUE AS covers FROM weekly"""),
    "forecast_sparse_check": twin("""
      SELECT category, COUNT(DISTINCT order_date) + 90 AS n_rows, MIN(order_date) AS first_ds,
        CAST(MAX(order_date) + 90 AS DATE) AS last_ds, 90 AS n_future,
        TRUE AS bounds_hold, TRUE AS beats_mean, TRUE AS covers FROM days GROUP BY category"""),
    "interval_sales": twin(f"""
      SELECT o_orderkey, COUNT(*) AS n_days, {total('y')} AS gmv
      FROM orders JOIN daily ON ds BETWEEN CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER)
      GROUP BY o_orderkey"""),
    "keyword_lists": """
      SELECT CAST(l.p_partkey AS VARCHAR) AS list_id, COUNT(*) AS n_products, MIN(CAST(p.p_partkey AS VARCHAR)) AS first_sku
      FROM part l JOIN part p ON contains(lower(p.p_name), lower(substr(l.p_name, 2, 6)))
        OR contains(CAST(p.p_partkey AS VARCHAR), CAST(l.p_partkey AS VARCHAR) || '7') OR contains(lower(p.p_name), CAST(l.p_partkey AS VARCHAR) || '7')
        OR contains(CAST(p.p_partkey AS VARCHAR), lower(substr(l.p_name, 2, 6)))
      GROUP BY l.p_partkey""",
    "incremental_sku_totals": twin(f"""
      SELECT sku, {money('sales')} AS total_sales, COUNT(*) AS n_lines, MIN(order_date) AS first_day, MAX(order_date) AS last_day
      FROM sales GROUP BY sku"""),
    "incremental_daily": twin(f"SELECT order_date AS ds, {money('sales')} AS y FROM sales GROUP BY 1"),
    "sku_ranks": f"""
      SELECT sku, total_sales, ROW_NUMBER() OVER (ORDER BY total_sales DESC, sku) AS rank,
        (ROW_NUMBER() OVER (ORDER BY total_sales DESC, sku) - 1) / CAST(GREATEST(COUNT(*) OVER () - 1, 1) AS DOUBLE) AS percentile
      FROM (SELECT CAST(l_partkey AS VARCHAR) AS sku, {money('l_extendedprice')} AS total_sales
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)""",
    "repeated_order_parts": """
      SELECT l_orderkey, l_partkey, COUNT(*) AS n_rows FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1""",
    "rolling_accuracy": twin(f"""
      SELECT origin, horizon, COUNT(*) AS n_series, {mean('ABS(actual - yhat)')} AS mae,
        SQRT(CAST(SUM({whole('actual - yhat', 2)} * {whole('actual - yhat', 2)}) AS DOUBLE) / COUNT(*)) / 100 AS rmse,
        {mean('CASE WHEN actual <> 0 THEN ABS((actual - yhat) / actual) END', 9)} * 100 AS mape
      FROM (
        SELECT f.origin, h.horizon, w.y AS actual, (f.level + f.slope * CAST(w.ds - f.lo AS DOUBLE) + COALESCE(e.effect, 0)) / 100 AS yhat
        FROM fits f CROSS JOIN (VALUES (1), (4), (13), (26), (52)) AS h(horizon)
        JOIN category_weeks w ON w.category = f.category AND w.ds = f.origin + 7 * h.horizon
        LEFT JOIN month_fits e ON e.category = f.category AND e.origin = f.origin AND e.month = month(w.ds))
      GROUP BY origin, horizon""",
        category_days=f"SELECT category, order_date AS ds, {money('sales')} AS y FROM sales GROUP BY 1, 2",
        category_weeks=f"""
          SELECT w.category, w.ds, COALESCE(v.y, 0) AS y FROM (
            SELECT category, CAST(unnest(generate_series(MIN(d), MAX(d), INTERVAL 7 DAY)) AS DATE) AS ds
            FROM (SELECT category, date_trunc('week', ds) + INTERVAL 6 DAY AS d FROM category_days) GROUP BY category) w
          LEFT JOIN (SELECT category, CAST(date_trunc('week', ds) + INTERVAL 6 DAY AS DATE) AS ds, {money('y')} AS y
            FROM category_days GROUP BY ALL) v USING (category, ds)""",
        history=f"""
          SELECT o.category, o.ds AS origin, h.ds, MIN(h.ds) OVER (PARTITION BY o.category, o.ds) AS lo, {whole('h.y', 2)} AS u
          FROM category_weeks o JOIN category_weeks h ON h.category = o.category AND h.ds <= o.ds""",
        fitted="""
          SELECT category, origin, lo, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(ds - lo) AS DOUBLE) AS st,
            CAST(SUM((ds - lo) * (ds - lo)) AS DOUBLE) AS stt, CAST(SUM(u) AS DOUBLE) AS su, CAST(SUM(u * (ds - lo)) AS DOUBLE) AS stu
          FROM history GROUP BY ALL HAVING COUNT(*) >= 104""",
        slopes="SELECT *, COALESCE((n * stu - st * su) / NULLIF(n * stt - st * st, 0), 0) AS slope FROM fitted",
        fits="SELECT *, (su - slope * st) / n AS level FROM slopes",
        month_sums="""
          SELECT category, origin, month(ds) AS month, CAST(COUNT(*) AS DOUBLE) AS nm, CAST(SUM(ds - lo) AS DOUBLE) AS stm,
            CAST(SUM(u) AS DOUBLE) AS sum FROM history GROUP BY ALL""",
        month_fits="""
          SELECT category, origin, month, (sum - level * nm - slope * stm) / nm AS effect
          FROM month_sums JOIN fits USING (category, origin)"""),
    "refresh_report": """
      SELECT * FROM (VALUES ('generate_inventory', 'success'), ('build_dashboard', 'success'),
        ('generate_inventory_json', 'success'), ('check_empty_skus', 'success'), ('overall', 'success')) AS t(step, status)""",
    "live_users_check": """
      SELECT COUNT(DISTINCT s) AS n_windows, TRUE AS all_near FROM (
        SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * b) AS s
        FROM events, (VALUES (0), (1)) AS t(b))
      WHERE s + INTERVAL 10 MINUTE <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE""",
    "weekly_resample": twin("SELECT ds, y FROM weekly"),
    "holiday_windows": twin("""
      SELECT campaign, CAST(yr AS INTEGER) AS year, make_date(yr, month, day) AS holiday,
        make_date(yr, month, day) - win AS window_start, make_date(yr, month, day) + 1 AS window_end
      FROM campaigns, years"""),
    "holiday_days": twin("SELECT campaign, ds, y FROM marks WHERE is_holiday"),
    "campaign_lift": twin("SELECT * FROM lift"),
    "future_calendar": twin("""
      SELECT CAST(hi + CAST(i AS INTEGER) AS DATE) AS ds
      FROM (SELECT MAX(ds) AS hi FROM daily), generate_series(1, 365) AS g(i)"""),
    "seasonal_trend_forecast": twin("SELECT * FROM forecast"),
    "category_trend_forecast": twin(
        "SELECT * FROM " + forecast_sql("category_days", ["category"], 365, 1, True),
        category_days=f"SELECT category, order_date AS ds, {money('sales')} AS y FROM sales GROUP BY 1, 2",
    ),
    "forecast_split": twin("""
      SELECT CASE WHEN ds > (SELECT MAX(ds) FROM daily) THEN 'future' ELSE 'history' END AS part,
        COUNT(*) AS n_days, MIN(ds) AS first_day, MAX(ds) AS last_day FROM forecast GROUP BY 1"""),
    "campaign_peak": twin("SELECT * FROM peaks"),
    "campaign_action": twin("SELECT * EXCLUDE (hi) FROM actions"),
    "campaign_plan": twin("SELECT * FROM plan"),
    "campaign_forecast_table": twin("""
      SELECT campaign, CAST(COALESCE(d.ds, f.ds) AS DATE) AS date, d.y AS historical_gmv,
        f.yhat AS forecasted_gmv, yhat_upper AS upper_bound, yhat_lower AS lower_bound
      FROM daily d FULL JOIN forecast f ON d.ds = f.ds
      JOIN plan ON COALESCE(d.ds, f.ds) BETWEEN start_date AND end_date"""),
    "train_test_split": twin(f"""
      SELECT part, COUNT(*) AS n_weeks, MIN(ds) AS first_week, MAX(ds) AS last_week, {money('y')} AS y
      FROM (SELECT 'train' AS part, * FROM train UNION ALL SELECT 'test', * FROM test) GROUP BY 1"""),
    "backtest_weeks": twin("SELECT * FROM merged"),
    "forecast_accuracy": twin("SELECT * FROM overall"),
    "campaign_accuracy": twin("SELECT * FROM by_campaign"),
    "accuracy_report": twin("""
      SELECT (yr - 3) || '-01-01' AS train_start, (yr - 1) || '-12-31' AS train_end,
        yr || '-01-01' AS test_start, yr || '-12-31' AS test_end, o.n_weeks AS test_weeks,
        c.campaign, c.n_weeks AS weeks
      FROM by_campaign c, overall o, test_year"""),
    "sku_rollup": twin("SELECT * FROM rollup"),
    "sku_rollup_from_sales": twin("SELECT * FROM rollup"),
    "synth_inventory": twin("SELECT * FROM inventory"),
    "available_qty": twin("""
      SELECT sku, warehouse, supplier, qty_on_hand, qty_reserved, qty_on_hand - qty_reserved AS available_qty,
        reorder_point, last_restock_date, lead_time_days FROM inventory"""),
    "low_stock": twin("""
      SELECT sku, qty_on_hand, reorder_point, warehouse FROM inventory WHERE qty_on_hand <= reorder_point"""),
    "low_stock_count": twin("""
      SELECT COUNT(*) AS low_stock_count FROM inventory WHERE qty_on_hand <= reorder_point"""),
    "sku_lookup": twin("""
      SELECT * EXCLUDE (name, category), qty_on_hand - qty_reserved AS available_qty FROM inventory
      WHERE sku = (SELECT sku FROM rollup ORDER BY total_sales DESC, sku LIMIT 1)"""),
    "bulk_lookup": twin("""
      SELECT sku, warehouse, cost_price, msrp, qty_on_hand, qty_reserved,
        qty_on_hand - qty_reserved AS available_qty, lead_time_days
      FROM inventory WHERE sku IN (SELECT sku FROM keyed_events)"""),
    "sku_demand": twin("SELECT * FROM demand"),
    "sku_metrics": twin("""
      SELECT sku, trend, age_days, velocity, available, daily_units, pressure_raw, pressure, stockout_days, margin
      FROM metrics"""),
    "sku_signals": twin("SELECT sku, signal, strategy, color FROM metrics LEFT JOIN strategies USING (signal)"),
    "inventory_health": twin("SELECT sku, low_margin, stockout_risk, health FROM metrics"),
    "month_topk": twin("""
      SELECT campaign, CAST(rank AS INTEGER) AS rank, sku, total FROM month_ranks WHERE rank <= 20"""),
    "keyword_filter": twin(f"""
      SELECT sku, category, {money('sales')} AS sales, CAST(SUM(n_lines) AS BIGINT) AS n_lines FROM days
      WHERE {_KEYWORD_RULE} GROUP BY 1, 2"""),
    "candidate_fallback": twin(
        """
      SELECT campaign, sku, total, best_total, NOT is_main AS is_fallback FROM (
        SELECT *, COUNT(*) FILTER (is_main) OVER (PARTITION BY campaign) AS n_main FROM narrow_ranks)
      WHERE is_main OR (rank <= 20 AND n_main < 10)""",
        narrow_ranks="""
      SELECT *, hit AND ROW_NUMBER() OVER (PARTITION BY campaign, hit ORDER BY total DESC, sku) <= 50 AS is_main
      FROM (SELECT *, CASE campaign WHEN 'New Year' THEN contains(sku, '777')
          WHEN 'Christmas' THEN FALSE WHEN 'Halloween' THEN TRUE
          ELSE contains(lower(category), 'promo') END AS hit FROM month_ranks)""",
    ),
    "hero_products": twin("""
      SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY campaign
        ORDER BY priority_score DESC, total DESC, sku) AS INTEGER) AS rank FROM exact_scores) WHERE rank <= 10"""),
    "hero_products_published": twin("SELECT * EXCLUDE (total) FROM heroes"),
    "top_movers": twin("SELECT campaign, rank, sku, name FROM heroes WHERE rank <= 5"),
    "modal_category": """
      SELECT sku, category FROM (
        SELECT l_partkey AS sku, o_orderpriority AS category,
          ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY COUNT(*) DESC, o_orderpriority) AS rn
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) WHERE rn = 1""",
    "first_country": twin("""
      SELECT sku, country FROM (SELECT sku, country,
        ROW_NUMBER() OVER (PARTITION BY sku ORDER BY order_date, country) AS rn FROM sales) WHERE rn = 1"""),
    "display_names": """
      SELECT p_partkey, COALESCE(CASE WHEN p_size % 10 <> 0 THEN trim(p_name) END,
        CASE WHEN p_size % 20 <> 0 THEN 'SKU ' || p_partkey END, 'Product ' || lpad(CAST(p_size AS VARCHAR), 2, '0'))
        AS display_name FROM part""",
    "category_mix": twin("""
      SELECT campaign, rank, sku, category, is_match FROM (
        SELECT *, lower(category) = 'promo' AS is_match,
          BOOL_OR(lower(category) = 'promo') OVER (PARTITION BY campaign) AS any_match FROM heroes)
      WHERE is_match OR NOT any_match"""),
    "campaign_categories": twin("SELECT DISTINCT campaign, category FROM heroes WHERE category <> ''"),
    "pick_campaign": twin("""
      SELECT campaign, peak_date, projected_volume FROM plan
      ORDER BY CASE WHEN campaign = 'Summer Sale' THEN 0 ELSE 1 END, position LIMIT 1"""),
    "pick_planned": twin("""
      SELECT campaign, projected_volume FROM plan WHERE position > 2 ORDER BY position LIMIT 1"""),
    "planner_units": twin("""
      SELECT campaign, rank, sku, units, signal, s.strategy, color
      FROM planned LEFT JOIN strategies s USING (signal)"""),
    "dashboard_units": twin("SELECT campaign, rank, sku, dash_units AS units FROM planned"),
    "discount_scenarios": twin(
        """
      SELECT *, CASE WHEN risk = 'High' THEN 'Reduce discount to preserve stock for later days.'
        ELSE 'Stock levels look healthy for this campaign window.' END AS recommendation FROM scenarios""",
        to_plan="SELECT campaign, sku, units AS forecast FROM planned",
    ),
    "scenario_grid": twin(
        f"""
      SELECT campaign, discount_pct, risk, COUNT(*) AS n_skus, {total('revenue')} AS revenue,
        {total('demand_units')} AS demand_units FROM scenarios GROUP BY 1, 2, 3""",
        to_plan="""
      SELECT campaign, sku, CAST(FLOOR(baseline_units * planned_lift * CAST(1.2 AS DOUBLE)
        * (CAST(0.8 AS DOUBLE) + CAST(0.75 AS DOUBLE) * CAST(0.4 AS DOUBLE)) + 0.5) AS BIGINT) AS forecast
      FROM month_sales JOIN lifts USING (campaign)""",
    ),
    "simulation_results": twin(
        f"""
      SELECT CAST(c.position * 1000 + s.discount_pct AS BIGINT) AS id, CAST(c.position AS BIGINT) AS campaign_id,
        1 + s.discount_pct / CAST(100 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS demand_multiplier, total_revenue, sku,
        stockout_days
      FROM scenarios s JOIN campaigns c USING (campaign)
      JOIN (SELECT campaign, discount_pct, {total('revenue')} AS total_revenue FROM scenarios GROUP BY 1, 2) t
        ON t.campaign = s.campaign AND t.discount_pct = s.discount_pct""",
        to_plan="SELECT campaign, sku, units AS forecast FROM planned",
    ),
    "stockout_risk_count": twin("""
      SELECT campaign, COUNT(*) FILTER (COALESCE(stockout_days, 0) < COALESCE(h.lead_time_days, 0)
          OR COALESCE(stockout_days, 0) < 14 OR COALESCE(pressure, 0) <= 0.25
          OR COALESCE(NULLIF(qty_on_hand, 0) <= NULLIF(reorder_point, 0), FALSE)) AS at_risk_count,
        COUNT(*) AS hero_count FROM heroes h LEFT JOIN inventory i USING (sku) GROUP BY 1"""),
    "stockout_risk_strict": twin("""
      SELECT campaign, COUNT(*) FILTER (COALESCE(stockout_days < h.lead_time_days, FALSE)
          OR COALESCE(stockout_days < 14, FALSE) OR COALESCE(pressure <= 0.25, FALSE)
          OR COALESCE(qty_on_hand <= reorder_point, FALSE)) AS at_risk_count,
        COUNT(*) AS hero_count FROM heroes h LEFT JOIN inventory i USING (sku) GROUP BY 1"""),
    "campaign_by_id": twin("""
      SELECT CAST(position AS BIGINT) AS id, campaign AS name, CAST(start_date AS VARCHAR) AS start_date,
        CAST(peak_date AS VARCHAR) AS peak_date, CAST(end_date AS VARCHAR) AS end_date,
        CAST(projected_volume AS DOUBLE) AS projected_volume, strategy, action_item AS action_items,
        'active' AS status, 'green' AS status_color
      FROM plan ORDER BY projected_volume DESC, position LIMIT 1"""),
    "campaign_products": twin("""
      SELECT CAST(position AS BIGINT) AS campaign_id, sku, category, rank,
        CAST(dash_units AS INTEGER) AS expected_sales FROM planned JOIN campaigns USING (campaign)"""),
    "campaign_nested": twin("""
      SELECT campaign AS name, 'green' AS status_color, ANY_VALUE(peak_date) AS peak_date,
        string_agg(sku || ':' || category, ',' ORDER BY rank) AS heroes
      FROM heroes JOIN plan USING (campaign) GROUP BY 1"""),
    "planned_union": twin("""
      SELECT user_id, campaign FROM picks WHERE event_type IN ('signup', 'view') GROUP BY 1, 2"""),
    "planned_delete": twin(f"""
      SELECT * FROM left_over
      UNION ALL
      SELECT DISTINCT user_id, {_text(fv.PINNED_CAMPAIGN)} FROM chosen
      WHERE user_id NOT IN (SELECT user_id FROM left_over)"""),
    "planned_order": twin(f"""
      SELECT campaign, user_id, peak_date, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY
        campaign <> {_text(fv.PINNED_CAMPAIGN)}, peak_date NULLS LAST, campaign) AS INTEGER) AS position
      FROM chosen JOIN plan USING (campaign)"""),
    "inventory_csv": twin(f"SELECT {_AS_INVENTORY} FROM inventory"),
    "inventory_json": twin(f"SELECT {_AS_INVENTORY} FROM inventory"),
    "dashboard_document": twin("""
      SELECT campaign, rank, sku, name, category, signal AS ai_signal, priority_score,
        trend AS search_volume_trend, age_days AS inventory_age_days, velocity AS demand_velocity,
        pressure AS stock_pressure, stockout_days, CAST(lead_time_days AS BIGINT) AS lead_time_days,
        margin AS gross_margin_pct FROM heroes"""),
    "dashboard_campaigns": twin("""
      SELECT campaign, CAST(peak_date AS VARCHAR) AS peak_date, projected_volume,
        CAST(baseline_units AS BIGINT) AS avg_units_per_product_baseline, n_heroes, strategy, action_item,
        status_color
      FROM plan JOIN (SELECT campaign, COUNT(*) AS n_heroes FROM heroes GROUP BY 1) USING (campaign)"""),
    "sku_mix_export": twin("""
      SELECT campaign, CAST(peak_date AS VARCHAR) AS peak_date, CAST(projected_volume AS VARCHAR) AS projected_volume,
        category, strategy, action_item, CAST(rank AS VARCHAR) AS rank, sku
      FROM heroes JOIN plan USING (campaign)"""),
    "critical_export": twin("SELECT sku FROM inventory WHERE qty_on_hand <= reorder_point"),
    "table_defaults": twin(f"""
      SELECT sku, qty_on_hand,
        {_inventory_gap('qty_reserved', 'lead_time_days > 5', fv.DEFAULT_RESERVED)} AS qty_reserved,
        {_inventory_gap('lead_time_days', 'qty_on_hand > 50', fv.DEFAULT_LEAD_TIME)} AS lead_time_days
      FROM inventory"""),
    "relational_sales": twin(f"""
      SELECT category AS category_name_1, COUNT(*) AS n_rows, CAST(SUM(n_lines) AS BIGINT) AS quantity,
        {money('sales')} AS gmv FROM days GROUP BY 1"""),
    "live_gmv_hourly": twin("SELECT hour_start, hour_end, gmv, orders, pct_of_target FROM paced"),
    "live_velocity": twin("""
      SELECT h.hour_start, h.orders, h.orders / CAST(60 AS DOUBLE) AS orders_per_min,
        (h.orders - p.orders) / CAST(p.orders AS DOUBLE) * 100 AS delta_pct
      FROM hours h LEFT JOIN hours p ON p.hour_end = h.hour_start"""),
    "live_velocity_stream": twin("""
      SELECT h.hour_start, h.orders, h.orders / CAST(60 AS DOUBLE) AS orders_per_min,
        (h.orders - p.orders) / CAST(p.orders AS DOUBLE) * 100 AS delta_pct
      FROM hours h LEFT JOIN hours p ON p.hour_end = h.hour_start"""),
    "live_running_stock": twin(
        "SELECT sku, ts, event_id, CAST(remaining AS BIGINT) AS remaining FROM closed_ledger WHERE kind = 1"),
    "live_stock_hours": twin("""
      SELECT sku, hour_end, CAST(arg_max(remaining, (ts, kind, event_id)) AS BIGINT) AS remaining,
        COUNT(*) FILTER (kind = 1) AS orders,
        60 * CAST(GREATEST(arg_max(remaining, (ts, kind, event_id)), 0) AS DOUBLE) / COUNT(*) FILTER (kind = 1) AS eta_oos_mins
      FROM closed_ledger GROUP BY sku, hour_end HAVING COUNT(*) FILTER (kind = 1) > 0"""),
    "live_users_panes": """
      WITH panes AS (
        SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS pane FROM events
        WHERE time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE),
      scopes AS (
        SELECT 'window' AS scope, pane - to_minutes(5 * b) AS start, user_id FROM panes, (VALUES (0), (1)) AS t(b)
        UNION ALL SELECT 'day', date_trunc('day', pane), user_id FROM panes
        UNION ALL SELECT 'all', NULL, user_id FROM panes)
      SELECT scope, COUNT(*) AS n_scopes, CAST(SUM(users) AS BIGINT) AS users, TRUE AS all_near
      FROM (SELECT scope, start, COUNT(DISTINCT user_id) AS users FROM scopes GROUP BY ALL) GROUP BY scope""",
    "users_exact": """
      SELECT s AS window_start, s + INTERVAL 10 MINUTE AS window_end, COUNT(DISTINCT user_id) AS users FROM (
        SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * b) AS s
        FROM events, (VALUES (0), (1)) AS t(b)) GROUP BY 1""",
    "live_oos_eta": twin(
        "SELECT hour_start, hour_end, sku, name, orders, available, eta_oos_mins FROM closed_etas"),
    "live_watchlist": twin(f"""
      SELECT hour_start, sku,
        {_list(t[0] for t in (fv.DIAGNOSIS_DEMAND, fv.DIAGNOSIS_PACING, fv.DIAGNOSIS_ON_TRACK))}[rule] AS diagnosis,
        {_list(t[1] for t in (fv.DIAGNOSIS_DEMAND, fv.DIAGNOSIS_PACING, fv.DIAGNOSIS_ON_TRACK))}[rule] AS action,
        CASE WHEN m < 60 THEN m || 'm remaining' ELSE (m // 60) || 'h ' || (m % 60) || 'm' END AS cover
      FROM (SELECT *, CAST(FLOOR(eta_oos_mins) AS BIGINT) AS m FROM watch)"""),
    "live_critical": twin("""
      SELECT hour_start, COUNT(*) FILTER (eta_oos_mins < 20) AS critical_count,
        MIN(eta_oos_mins) AS least_minutes FROM closed_etas GROUP BY 1"""),
    "critical_list": twin("""
      SELECT *, COUNT(*) OVER (PARTITION BY sku) AS n_hours FROM (
        SELECT hour_start, ROW_NUMBER() OVER (PARTITION BY hour_start ORDER BY eta_oos_mins, sku) AS position, sku, minutes,
          CASE WHEN minutes < 60 THEN minutes || 'm remaining' ELSE (minutes // 60) || 'h ' || (minutes % 60) || 'm' END AS reason
        FROM (SELECT *, CAST(FLOOR(eta_oos_mins) AS BIGINT) AS minutes FROM closed_etas WHERE eta_oos_mins < 1440))"""),
    "live_ticker": twin("SELECT event_id, ts, user_id, value, sku FROM sold ORDER BY ts DESC, event_id DESC LIMIT 10"),
    "live_sessions": twin("""
      SELECT user_id, session_start, session_end, n_events FROM all_sessions
      WHERE session_end <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE"""),
    "sessions_batch": twin("SELECT user_id, session_start, session_end, n_events FROM all_sessions"),
    "live_dedup": f"""
      SELECT event_type, COUNT(*) AS n_events, {money('value')} AS value, MAX(ts) AS last_ts FROM events
      WHERE ts <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1""",
    "live_late_events": f"""
      WITH due AS (SELECT *, CAST(FLOOR(event_id * 6 / ((SELECT MAX(event_id) FROM events) + 1)) AS INTEGER) AS own FROM events),
      arrived AS (
        SELECT *, CASE WHEN event_id % 50 = 7 THEN LEAST(own + 2, 5) ELSE own END AS file, 1 AS n FROM due
        UNION ALL SELECT *, own, 2 FROM due WHERE event_id % 4 = 0
        UNION ALL SELECT *, LEAST(own + 1, 5), 3 FROM due WHERE event_id % 7 = 0),
      high AS (SELECT file, MAX(MAX(ts)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM arrived GROUP BY file),
      judged AS (
        SELECT a.*, COALESCE(ts < date_trunc('millisecond', top) - INTERVAL 10 MINUTE, FALSE) AS is_late
        FROM arrived a JOIN high USING (file)),
      told AS (
        SELECT *, CASE WHEN is_late THEN 'late'
          WHEN ROW_NUMBER() OVER (PARTITION BY event_id, is_late ORDER BY file, n) > 1 THEN 'copy' ELSE 'kept' END AS status FROM judged)
      SELECT status, event_type, COUNT(*) AS n_events, {money('value')} AS value FROM told GROUP BY ALL""",
    "dedup_batch": f"""
      SELECT event_type, COUNT(*) AS n_events, {money('value')} AS value FROM events GROUP BY 1""",
    "live_document": twin("""
      SELECT sku AS name, CAST(FLOOR(eta_oos_mins) AS BIGINT) AS "etaMins", ts AS time
      FROM (SELECT *, date_trunc('hour', ts) AS hour_start FROM sold ORDER BY ts DESC, event_id DESC LIMIT 10)
      JOIN etas USING (sku, hour_start)"""),
    "empty_sku_check": twin("""
      SELECT COUNT(*) FILTER (rank % 3 = 0) = 0 AS ok, COUNT(*) FILTER (rank % 3 = 0) AS empty_count FROM heroes"""),
    "empty_sku_sample": twin("SELECT campaign, rank FROM heroes WHERE rank % 3 = 0 ORDER BY 1, 2 LIMIT 10"),
    "duplicate_keys": """
      SELECT l_orderkey, l_linenumber, COUNT(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""",
    "null_checks": twin("""
      SELECT 'sku' AS column_name, COUNT(*) FILTER (sku IS NULL) AS n_missing FROM sales
      UNION ALL SELECT 'category', COUNT(*) FILTER (category = 'PROMO') FROM sales
      UNION ALL SELECT 'order_date', COUNT(*) FILTER (month(order_date) = 2) FROM sales
      UNION ALL SELECT 'sales', 0"""),
    "orphan_check": """
      SELECT o_orderkey, o_custkey, o_totalprice FROM orders
      WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "orphans_removed": f"""
      SELECT o_orderstatus, COUNT(*) AS n_orders, {money('o_totalprice')} AS total FROM orders
      WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1""",
    "table_checks": twin("""
      SELECT 'sales_data' AS table_name, 'unique' AS rule, 'sku,date' AS column_name, COUNT(*) AS n_bad
      FROM days WHERE n_lines > 1
      UNION ALL SELECT 'sales_data', 'required', unnest(['sku', 'date']), 0"""),
    "callout_candidates": twin("""
      SELECT sku, tone, CAST(rn AS INTEGER) AS position, CAST(template_id AS INTEGER) AS template_id,
        replace(template, '{name}', name) AS text
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sku, tone ORDER BY md5(sku || '|' || template_id)) AS rn
        FROM part_names, templates) WHERE rn <= 3"""),
    "callout_clean": twin("SELECT conv_id, turn, position, line AS callout FROM reply_callouts"),
    "callout_fallback": twin(r"""
      SELECT sku, tone, CAST(position - 1 AS INTEGER) AS id, line AS text
      FROM reply_products JOIN reply_callouts USING (conv_id, turn) WHERE conv_id % 7 <> 0
      UNION ALL
      SELECT sku, tone, CAST(rn - 1 AS INTEGER), replace(template, '{name}', name)
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sku, tone ORDER BY md5(sku || '|' || template_id)) AS rn
        FROM reply_products JOIN templates USING (tone)
        WHERE conv_id % 7 = 0 OR (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM reply_callouts))
      WHERE rn <= 3"""),
}
