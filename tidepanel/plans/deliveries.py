"""Batch arrivals, rebuild parity, carried-forward values and input fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import arrivals, features, rollup
from tidepanel.plans.oracle_base import FEATURE_SPEC, cte
from tidepanel.plans.registry import query
from tidepanel.schema import DAILY_COLUMNS, FEATURE_TABLE_COLUMNS, WEEK_KEYS
from tidepanel.session import cut_lineage
from tidepanel.sources import sinks, tables

KEY_SPEC = "sku:s channel:s region:s week:d"
# Columns that depend on the item's own rows and the calendar; cross-item columns cannot be rebuilt from a delivery.
OWN_COLUMNS = [c for c in FEATURE_TABLE_COLUMNS if c not in WEEK_KEYS + ["category_trend", "price_index"]]
TEXT_COLUMNS = ["lifecycle_stage", "brand", "segment", "category"]


def _stored(spark, sf):
    return features.feature_table(tables.to_daily(tables.history_rows(spark, sf)))


@query("append_batches", "SELECT sku, channel, region, date, pack_type, price_unit, promotion_flag, delivery_days, stock_available, "
       "delivered_qty, units_sold, brand, segment, category FROM sales_rows",
       "sku:s channel:s region:s date:d pack_type:s price_unit:f promotion_flag:i delivery_days:f stock_available:f delivered_qty:f "
       "units_sold:f brand:s segment:s category:s")
def append_batches(spark, sf):
    return arrivals.append_batches(tables.history_rows(spark, sf), tables.batch_rows(spark, sf)).select(*DAILY_COLUMNS)


@query("new_weeks", "SELECT DISTINCT week FROM base EXCEPT SELECT DISTINCT week FROM hist_base", "week:d")
def new_weeks(spark, sf):
    full = rollup.labelled_weeks(tables.sales_daily(spark, sf))
    known = rollup.labelled_weeks(tables.to_daily(tables.history_rows(spark, sf)))
    return arrivals.new_weeks(full, known)


@query("carry_forward", """
SELECT sku, channel, region, week, last_value(price_unit IGNORE NULLS) OVER w AS price_unit,
       last_value(stock_available IGNORE NULLS) OVER w AS stock_available
FROM weekly WINDOW w AS (PARTITION BY sku, channel, region ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
       KEY_SPEC + " price_unit:f stock_available:f")
def carry_forward(spark, sf):
    weekly = rollup.weekly_rollup(tables.sales_daily(spark, sf))
    return arrivals.carry_forward(weekly, ["price_unit", "stock_available"], ["sku", "channel", "region"]).select(
        *WEEK_KEYS, "price_unit", "stock_available")


def _differs(c: str) -> str:
    if c in TEXT_COLUMNS:
        return f"h.{c} IS DISTINCT FROM f.{c}"
    return f"(h.{c} IS NULL) <> (f.{c} IS NULL) OR abs(h.{c} - f.{c}) > 1e-9"


@query("rebuild_parity", f"""
SELECT unnest([{', '.join(f"'{c}'" for c in OWN_COLUMNS)}]) AS column_name, n AS rows_compared,
       unnest([{', '.join(OWN_COLUMNS)}]) AS mismatches
FROM (SELECT count(*) AS n, {', '.join(f'count(*) FILTER ({_differs(c)}) AS {c}' for c in OWN_COLUMNS)}
      FROM hist_features h JOIN features f USING (sku, channel, region, week))
UNION ALL
SELECT '(missing rows)', (SELECT count(*) FROM hist_features h JOIN features f USING (sku, channel, region, week)), count(*)
FROM hist_features h ANTI JOIN features f USING (sku, channel, region, week)""",
       "column_name:s rows_compared:i mismatches:i")
def rebuild_parity(spark, sf):
    stored = cut_lineage(_stored(spark, sf))
    combined = tables.to_daily(arrivals.append_batches(tables.history_rows(spark, sf), tables.batch_rows(spark, sf)))
    rebuilt = arrivals.rebuilt_features(combined, arrivals.last_known_stats(stored))
    return arrivals.column_parity(stored, rebuilt, OWN_COLUMNS).withColumnRenamed("column", "column_name")


cte("last_origin", "SELECT max(week) AS lw FROM hist_base")
cte("frozen", """
SELECT t.category, t.region, t.category_trend, p.category_price FROM hist_trend t
JOIN (SELECT category, avg(price_unit) AS category_price FROM hist_labelled, last_origin WHERE week = lw GROUP BY category) p USING (category),
last_origin WHERE t.week = lw""")
_NAMES = ", ".join(FEATURE_TABLE_COLUMNS)
cte("new_panel", f"""
SELECT {_NAMES}, week + 7 AS label_week FROM (
  SELECT h.* EXCLUDE (target_next_week), f.target_next_week FROM hist_features h, last_origin
  LEFT JOIN features f ON (h.sku, h.channel, h.region, h.week) = (f.sku, f.channel, f.region, f.week) WHERE h.week = lw)
UNION ALL
SELECT {', '.join('z.category_trend' if c == 'category_trend' else 'f.price_unit / nullif(z.category_price, 0)' if c == 'price_index'
                  else f'f.{c}' for c in FEATURE_TABLE_COLUMNS)}, f.week + 7
FROM features f LEFT JOIN frozen z USING (category, region) WHERE f.week NOT IN (SELECT week FROM hist_base)""")


@query("batch_panel", "SELECT * FROM new_panel", FEATURE_SPEC + " label_week:d")
def batch_panel(spark, sf):
    history = cut_lineage(tables.history_rows(spark, sf))
    return arrivals.batch_panel(history, tables.batch_rows(spark, sf), features.feature_table(tables.to_daily(history)))


cte("arrival_files", """
SELECT f.batch_file, row_number() OVER (ORDER BY f.batch_file) AS i, f.file_week, f.through
FROM (SELECT batch_file, CAST(date_trunc('week', min(date)) AS DATE) AS file_week, max(date) AS through
      FROM (SELECT *, 'batch_' || CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS batch_file
            FROM sales_rows WHERE date >= DATE '2001-10-01') GROUP BY batch_file) f""")
cte("arrival_rows", """
SELECT a.i, w.week, c.sku, c.channel, c.region
FROM arrival_files a
JOIN (SELECT f.i, sku, channel, region, min(week) AS lo, max(week) AS hi FROM arrival_files f JOIN cells k ON k.week <= f.file_week
      GROUP BY ALL) c ON a.i = c.i
JOIN (SELECT DISTINCT week FROM weekly, last_origin WHERE week > lw) w ON w.week BETWEEN c.lo + 28 AND c.hi - 7
WHERE w.week + 13 <= a.through
UNION ALL
SELECT a.i, h.week, h.sku, h.channel, h.region FROM arrival_files a, hist_base h, last_origin WHERE h.week = lw""")


# An origin row exists once its series has a later row, so the cross-channel total of an origin may still grow while
# other channels catch up. Every other column is fixed when the origin becomes scorable.
cte("arrival_shares", """
SELECT r.i, f.cross_channel_demand_share AS final_share,
       r.u / nullif(sum(r.u) OVER (PARTITION BY r.i, r.sku, r.region, r.week), 0) AS partial_share
FROM (SELECT r.*, w.units_sold AS u FROM arrival_rows r JOIN weekly w USING (sku, channel, region, week), last_origin WHERE r.week > lw) r
JOIN features f USING (sku, channel, region, week)""")


@query("arrival_replay", """
SELECT a.i AS batches_available, a.batch_file AS last_file, a.through AS data_through, count(DISTINCT r.week) AS scorable_origins,
       count(r.week) AS n_rows, (SELECT count(*) FROM arrival_shares s WHERE s.i = a.i AND ((final_share IS NULL) <> (partial_share IS NULL)
         OR abs(final_share - partial_share) > 1e-9)) AS feature_mismatches
FROM arrival_files a LEFT JOIN arrival_rows r ON a.i = r.i GROUP BY a.i, a.batch_file, a.through""",
       "batches_available:i last_file:s data_through:d scorable_origins:i n_rows:i feature_mismatches:i")
def arrival_replay(spark, sf):
    history = cut_lineage(tables.history_rows(spark, sf))
    stored = features.feature_table(tables.to_daily(history))
    return arrivals.arrival_replay(history, tables.batch_rows(spark, sf), stored, OWN_COLUMNS)


# Every column of the source tables, in their order; doubles are compared as scaled integers.
SOURCES = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                        "l_linestatus", "l_shipdate"],
           "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
           "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
           "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
           "nation": ["n_nationkey", "n_name", "n_regionkey"],
           "region": ["r_regionkey", "r_name"]}
_SCALED = {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "c_acctbal", "p_retailprice"}


@query("input_fingerprint", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, sum(CAST(('0x' || substr(md5(concat_ws('|', " + ", ".join(
        f"coalesce(CAST({f'CAST(floor({c} * 1e6 + 0.5) AS BIGINT)' if c in _SCALED else c} AS VARCHAR), '~')" for c in cols)
    + f")), 1, 8)) AS BIGINT)) AS content_hash FROM {t}" for t, cols in SOURCES.items()),
       "table_name:s n_rows:i content_hash:d")
def input_fingerprint(spark, sf):
    """Of every column the source tables have, also of columns that are new."""
    out = None
    for t in SOURCES:
        part = sinks.fingerprint(tables.table(spark, sf, t), t)
        out = part if out is None else out.unionByName(part)
    return out


@query("run_manifest")
def run_manifest(spark, sf):
    return sinks.manifest(input_fingerprint(spark, sf), split={"initial_train_end": "1999-12-31"})
