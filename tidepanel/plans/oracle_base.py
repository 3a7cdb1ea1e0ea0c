"""SQL building blocks: named CTEs over the raw tables and a typed final projection.

The SQL here is written independently of the Spark operators (explicit spines, self joins, per-row date ranges) so
that a shared mistake is unlikely.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


_REF = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def _needed(sql: str, seen: list[str]) -> list[str]:
    for word in _REF.findall(sql):
        if word in CTES and word not in seen:
            _needed(CTES[word], seen)
            if word not in seen:
                seen.append(word)
    return seen


def with_ctes(sql: str) -> str:
    names = _needed(sql, [])
    if not names:
        return sql
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in names)
    return f"WITH {parts}\n{sql}"


def final(sql: str, spec: str) -> str:
    """Wrap a query in its typed projection: s text, d date, i integer, f double, b boolean."""
    casts = {
        "s": "{c}",
        "d": "CAST({c} AS VARCHAR)",
        "i": "CAST({c} AS BIGINT)",
        "f": "floor(CAST({c} AS DOUBLE) * 1e6 + 0.5) / 1e6",
        "b": "CAST({c} AS BOOLEAN)",
    }
    cols = ", ".join(casts[k].format(c=c) + f" AS {c}" for c, k in (w.split(":") for w in spec.split()))
    return with_ctes(f"SELECT {cols} FROM (\n{sql.strip()}\n) AS result")


cte("order_lines", """
SELECT CAST(l.l_shipdate AS DATE) AS date, CAST(o.o_orderdate AS DATE) AS order_date,
       l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_returnflag, l.l_partkey,
       c.c_mktsegment, r.r_name, p.p_brand, p.p_type, p.p_size
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
""")
_MEASURES = """
       CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'Industrial' ELSE 'Home' END AS channel,
       r_name AS region, p_type AS pack_type,
       floor(l_extendedprice / l_quantity + 0.5) AS price_unit,
       CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END AS promotion_flag,
       CAST(1 + l_linenumber % 5 AS DOUBLE) AS delivery_days,
       CAST(p_size AS DOUBLE) AS stock_available,
       CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END AS delivered_qty,
       l_quantity AS units_sold
"""
cte("sales_rows", f"""
SELECT date, p_brand AS sku, p_brand AS brand,
       'S' || CAST(CAST(substr(p_brand, 7) AS INTEGER) % 3 AS VARCHAR) AS segment,
       'C' || CAST(CAST(substr(p_brand, 7) AS INTEGER) % 5 AS VARCHAR) AS category, {_MEASURES},
       date_diff('day', order_date, date) AS ship_lag_days
FROM order_lines
""")
cte("launch_rows", f"""
SELECT date, 'P' || CAST(l_partkey AS VARCHAR) AS sku, p_brand AS brand,
       CASE WHEN p_size <= 15 THEN 'S' WHEN p_size <= 35 THEN 'M' ELSE 'L' END AS segment,
       p_type AS category, {_MEASURES}
FROM order_lines
""")
_DAILY = """
SELECT sku, channel, region, date, max(brand) AS brand, max(segment) AS segment, max(category) AS category,
       min(pack_type) AS pack_type, avg(price_unit) AS price_unit, max(promotion_flag) AS promotion_flag,
       avg(delivery_days) AS delivery_days, avg(stock_available) AS stock_available,
       sum(delivered_qty) AS delivered_qty, sum(units_sold) AS units_sold
FROM {rows} GROUP BY sku, channel, region, date
"""
cte("daily", _DAILY.format(rows="sales_rows"))
cte("launch_daily", _DAILY.format(rows="launch_rows"))


def weekly_ctes(prefix: str, daily: str) -> None:
    """Weekly panel with an explicit spine, for the fact table named ``daily``."""
    cte(f"{prefix}cells", f"""
SELECT sku, channel, region, CAST(date_trunc('week', date) AS DATE) AS week,
       sum(units_sold) AS units_sold, sum(delivered_qty) AS delivered_qty, avg(price_unit) AS price_unit,
       avg(stock_available) AS stock_available, max(promotion_flag) AS promotion_flag,
       avg(delivery_days) AS delivery_days
FROM {daily} GROUP BY ALL
""")
    cte(f"{prefix}spine", f"""
SELECT sku, channel, region, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
       INTERVAL 7 DAY)) AS DATE) AS week
FROM (SELECT sku, channel, region, min(week) AS lo, max(week) AS hi FROM {prefix}cells GROUP BY ALL)
""")
    cte(f"{prefix}weekly", f"""
SELECT s.sku, s.channel, s.region, s.week, coalesce(c.units_sold, 0) AS units_sold,
       coalesce(c.delivered_qty, 0) AS delivered_qty, c.price_unit, c.stock_available,
       coalesce(c.promotion_flag, 0) AS promotion_flag, c.delivery_days
FROM {prefix}spine s LEFT JOIN {prefix}cells c USING (sku, channel, region, week)
""")
    cte(f"{prefix}lagged", f"""
SELECT *, lag_1 - lag_2 AS momentum FROM (
  SELECT *, lag(units_sold, 1) OVER s AS lag_1, lag(units_sold, 2) OVER s AS lag_2,
         CASE WHEN row_number() OVER s > 4 THEN avg(units_sold) OVER p END AS rolling_mean_4,
         CASE WHEN row_number() OVER s > 4 THEN stddev_samp(units_sold) OVER p END AS rolling_std_4,
         lead(units_sold, 1) OVER s AS target_next_week
  FROM {prefix}weekly
  WINDOW s AS (PARTITION BY sku, channel, region ORDER BY week),
         p AS (PARTITION BY sku, channel, region ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
""")
    cte(f"{prefix}aged", f"""
SELECT l.*, date_diff('day', f.first_week, l.week) // 7 AS sku_age
FROM {prefix}lagged l
JOIN (SELECT sku, CAST(date_trunc('week', min(date)) AS DATE) AS first_week FROM {daily} GROUP BY sku) f USING (sku)
""")
    cte(f"{prefix}flagged", f"""
SELECT a.*, week(a.week) AS week_number, month(a.week) AS month, year(a.week) AS year,
       CASE WHEN month(a.week) IN (6, 7, 8) THEN 1 ELSE 0 END AS is_summer,
       CASE WHEN month(a.week) IN (1, 2, 12) THEN 1 ELSE 0 END AS is_winter,
       CASE WHEN a.sku_age <= 12 THEN 'Growth' WHEN a.sku_age <= 52 THEN 'Mature' ELSE 'Decline' END AS lifecycle_stage,
       coalesce(h.is_holiday_week, 0) AS is_holiday_week, coalesce(h.is_holiday_peak, 0) AS is_holiday_peak
FROM {prefix}aged a
LEFT JOIN (SELECT w.week, 1 AS is_holiday_week, max(CASE WHEN d.kind = 'peak' THEN 1 ELSE 0 END) AS is_holiday_peak
           FROM (SELECT DISTINCT week FROM {prefix}aged) w
           JOIN holiday_days d ON d.day BETWEEN w.week AND w.week + 6 GROUP BY w.week) h ON a.week = h.week
""")
    cte(f"{prefix}base", f"""
SELECT * FROM {prefix}flagged
WHERE rolling_std_4 IS NOT NULL AND momentum IS NOT NULL AND target_next_week IS NOT NULL
""")
    cte(f"{prefix}early", f"SELECT * FROM {prefix}flagged WHERE target_next_week IS NOT NULL")


# Easter by the anonymous Gregorian rule (the operators use the shorter Gauss form).
cte("easter_days", """
SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter
FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (
  SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM (
    SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM (
      SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT unnest(generate_series(1990, 2010)) AS y)))))
""")
cte("holiday_days", """
SELECT make_date(y, mm, dd) AS day, kind
FROM (SELECT unnest(generate_series(1990, 2010)) AS y),
     (VALUES (1, 1, 'peak'), (1, 6, 'minor'), (5, 1, 'minor'), (5, 3, 'minor'), (8, 15, 'minor'), (11, 1, 'minor'),
             (11, 11, 'minor'), (12, 24, 'peak'), (12, 25, 'peak'), (12, 26, 'peak')) AS v(mm, dd, kind)
UNION ALL
SELECT easter + o, kind FROM easter_days, (VALUES (0, 'peak'), (1, 'peak'), (60, 'minor')) AS v(o, kind)
""")
cte("event_days", """
SELECT make_date(y, mm, dd) AS day
FROM (SELECT unnest(generate_series(1990, 2010)) AS y),
     (VALUES (5, 1), (5, 3), (11, 1), (12, 24), (12, 25), (12, 26)) AS v(mm, dd)
UNION ALL SELECT easter FROM easter_days
""")
weekly_ctes("", "daily")
weekly_ctes("launch_", "launch_daily")

BASE_SPEC = ("sku:s week:d channel:s region:s units_sold:f stock_available:f promotion_flag:i price_unit:f "
             "delivery_days:f is_holiday_peak:i week_number:i month:i year:i is_holiday_week:i is_summer:i is_winter:i "
             "sku_age:i lifecycle_stage:s lag_1:f lag_2:f rolling_mean_4:f rolling_std_4:f momentum:f "
             "target_next_week:f")

def feature_ctes(prefix: str, daily: str) -> None:
    """Enrichment and feature table on top of ``weekly_ctes`` with the same prefix."""
    p = prefix
    cte(f"{p}attrs", f"SELECT DISTINCT sku, brand, segment, category FROM {daily}")
    cte(f"{p}internal", f"""
SELECT sku, channel, region, CAST(date_trunc('week', date) AS DATE) AS week, avg(price_unit) AS price_avg,
       avg(promotion_flag) AS promo_rate, avg(stock_available) AS stock_avg, count(delivery_days) AS deliveries
FROM {daily} GROUP BY ALL HAVING avg(price_unit) IS NOT NULL
""")
    cte(f"{p}event_scores", f"""
SELECT w.week, CASE WHEN min(abs(date_diff('day', w.week, d.day))) <= 7
                    THEN 1.0 - min(abs(date_diff('day', w.week, d.day))) / 7.0 * 0.15 ELSE 0.0 END AS event_score
FROM (SELECT DISTINCT week FROM {p}base) w, event_days d GROUP BY w.week
""")
    cte(f"{p}context", f"""
SELECT x.region, x.week,
       9.0 + 0.6 * rk + (9.0 + 0.5 * rk) * sin(2 * pi() * (dayofyear(x.week) - 172) / 365.25) AS avg_temp,
       160.0 * pow(1.018, date_diff('day', lo, x.week) / 7.0 / 52.0) AS inflation_index,
       CASE WHEN month(x.week) IN (7, 8) THEN 0 ELSE 1 END AS school_in_session, e.event_score
FROM (SELECT DISTINCT region, week FROM {p}base) x
JOIN (SELECT region, rank() OVER (ORDER BY region) - 1 AS rk FROM (SELECT DISTINCT region FROM {p}base)) r USING (region)
JOIN {p}event_scores e USING (week), (SELECT min(week) AS lo FROM {p}base)
""")
    cte(f"{p}labelled", f"SELECT b.*, a.brand, a.segment, a.category FROM {p}base b LEFT JOIN {p}attrs a USING (sku)")
    cte(f"{p}trend", f"""
SELECT category, region, week,
       avg(m) OVER w / nullif(first_value(m) OVER w, 0) AS category_trend
FROM (SELECT category, region, week, avg(units_sold) AS m FROM {p}labelled GROUP BY ALL)
WINDOW w AS (PARTITION BY category, region ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
    cte(f"{p}enriched", f"""
SELECT l.*, i.price_avg, i.promo_rate, i.stock_avg, i.deliveries, c.avg_temp, c.inflation_index, c.school_in_session,
       c.event_score, t.category_trend
FROM {p}labelled l LEFT JOIN {p}internal i USING (sku, channel, region, week)
LEFT JOIN {p}context c USING (region, week) LEFT JOIN {p}trend t USING (category, region, week)
""")
    cte(f"{p}features", f"""
SELECT *, price_unit / nullif(avg(price_unit) OVER (PARTITION BY category, week), 0) AS price_index,
       date_diff('day', max(CASE WHEN promotion_flag = 1 THEN week END) OVER (s ROWS UNBOUNDED PRECEDING), week) / 7
         AS promo_recency,
       avg(promotion_flag) OVER (s ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS rolling_promo_rate,
       units_sold / nullif(sum(units_sold) OVER (PARTITION BY sku, region, week), 0) AS cross_channel_demand_share
FROM {p}enriched WINDOW s AS (PARTITION BY sku, channel, region ORDER BY week)
""")


feature_ctes("", "daily")
# The same tables as they would have been built from history alone.
cte("hist_daily", _DAILY.format(rows="(SELECT * FROM sales_rows WHERE date < DATE '2001-10-01')"))
weekly_ctes("hist_", "hist_daily")
feature_ctes("hist_", "hist_daily")
ENRICHED_SPEC = (BASE_SPEC + " brand:s segment:s category:s price_avg:f promo_rate:f stock_avg:f deliveries:i "
                 "avg_temp:f inflation_index:f school_in_session:i event_score:f category_trend:f")
FEATURE_SPEC = ENRICHED_SPEC + " price_index:f promo_recency:f rolling_promo_rate:f cross_channel_demand_share:f"
