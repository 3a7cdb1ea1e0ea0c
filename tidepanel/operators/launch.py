"""Launch records, donors known at a cutoff, analog search and cold-start scores.

Every "what was known by then" question is answered the same way: donor rows are first reduced to one row per
group and day, the days on which targets ask are added as empty rows, and a running window over the days of a group
gives each asking day its answer. The window therefore sees calendar-sized groups, and no donor ever meets a target
row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import forecast_metrics, named, ratio
from tidepanel.operators.features import item_table
from tidepanel.operators.rollup import recorded_base
from tidepanel.schema import LABEL, SERIES, STATIC_ATTRS, WEEK_KEYS

LABEL_DELAY_DAYS = 14
LAUNCH_DAYS = 7
OLDEST_AGE_BUCKET = 24
MIN_TRAIN_ITEMS = 10
#: Columns that launch records read.
RECORD_INPUTS = [*SERIES, "date", *STATIC_ATTRS, "units_sold"]

# Fallback order of the category baseline, most specific first.
FALLBACK_LEVELS = [
    ("category_channel_region", ["category", "channel", "region"]),
    ("category", ["category"]),
    ("channel_region", ["channel", "region"]),
    ("global", []),
]
# Weight of each matching attribute in the metadata analog.
MATCH_WEIGHTS = {"category": 4, "segment": 2, "brand": 1}


def latest_items(items: DataFrame, n: int) -> DataFrame:
    """The n most recently launched items: the held-out evaluation list, n rows by construction."""
    return items.orderBy(F.desc("first_seen"), F.desc("sku")).limit(n)


def launch_edges(items: DataFrame, n: int) -> DataFrame:
    """Earliest and latest n launches with their position."""
    def side(name: str, order: list[Column]) -> DataFrame:
        top = items.orderBy(*order).limit(n).select("sku", "first_seen")
        return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).withColumn("side", F.lit(name))

    return side("earliest", [F.asc("first_seen"), F.asc("sku")]).unionByName(
        side("latest", [F.desc("first_seen"), F.desc("sku")]))


def _with_calendar(records: DataFrame) -> DataFrame:
    return records.withColumns({"month": F.month("week"), "week_number": F.weekofyear("week"), "year": F.year("week")})


def _records(daily: DataFrame, inside: Column, start: Column, items: DataFrame | None) -> DataFrame:
    last = daily.agg(F.max("date")).scalar()
    # Items are far fewer than their days: a hash of them spares sorting the days.
    rows = daily.select(*SERIES, "date", "units_sold").join((item_table(daily) if items is None else items).hint("shuffle_hash"), "sku")
    kept = rows.filter(inside & (F.date_add(start, LAUNCH_DAYS) <= F.date_add(last, 1)))
    return kept.groupBy(*SERIES, "category", "segment", "brand", "first_seen").agg(
        F.sum("units_sold").alias("launch_units"), F.countDistinct("date").alias("observed_days"))


def launch_week_records(daily: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Units in the calendar week of the item's first sale, per active series; unfinished weeks are left out. ``items`` is the
    item table of ``daily``, if the caller has it."""
    week = F.trunc("first_seen", "week")
    records = _records(daily, F.trunc("date", "week") == week, week, items)
    return _with_calendar(records.withColumns({"week": week, "label_available_at": F.date_add(week, LAUNCH_DAYS)}))


def seven_day_launch_records(daily: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Units in [first sale, first sale + 7 days) per active series; windows past the last day are left out. ``items`` as above."""
    records = _records(daily, F.datediff("date", "first_seen").between(0, LAUNCH_DAYS - 1), F.col("first_seen"), items)
    return _with_calendar(records.withColumns({
        "week": F.col("first_seen"), "launch_window_start": F.col("first_seen"),
        "label_available_at": F.date_add("first_seen", LAUNCH_DAYS)}))


def early_history_table(daily: DataFrame) -> DataFrame:
    """Launch panel that keeps missing lags, with attributes and the number of observed days per week."""
    return recorded_base(daily, item_table(daily))


def observed_days(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """Distinct recorded days per weekly row (1:1 on the week key)."""
    days = daily.groupBy(*SERIES, F.trunc("date", "week").alias("week")).agg(
        F.countDistinct("date").alias("observed_days"))
    return weekly.join(days, WEEK_KEYS)


def launch_week_of(panel: DataFrame) -> DataFrame:
    """Launch Monday recovered from week and age; ``consistent`` is false when rows disagree."""
    origin = F.expr("date_sub(week, CAST(7 * sku_age AS INT))")
    return panel.groupBy("sku").agg(F.min(origin).alias("launch_week"), (F.min(origin) == F.max(origin)).alias("consistent"))


# ---------------------------------------------------------------- donors known at a cutoff

def _known_by(donors: DataFrame, targets: DataFrame, keys: list[str], state: dict[str, Column],
              running: dict[str, Column]) -> DataFrame:
    """(keys..., day, running columns) for the days on which targets ask.

    ``state`` reduces the donors of one group and day to one row; ``running`` combines those rows over the days up to
    and including the asking day through the window ``_known``.
    """
    daily_state = donors.groupBy(*keys, F.col("label_available_at").alias("day")).agg(
        *[c.alias(n) for n, c in state.items()]).withColumn("_asked", F.lit(None).cast("boolean"))
    blank = [F.lit(None).cast(daily_state.schema[n].dataType).alias(n) for n in state]
    asked = targets.select(*keys, F.col("week").alias("day"), *blank, F.lit(True).alias("_asked"))
    timeline = daily_state.unionByName(asked).groupBy(*keys, "day").agg(
        *[F.max(c).alias(c) for c in [*state, "_asked"]])
    return timeline.withColumns(running).filter("_asked").select(*keys, "day", *running)


def known_window(keys: list[str]) -> Window:
    """All days of the group up to the current one. Without keys this is one row per calendar day."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return w.orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)


def _pool_columns(keys: list[str]) -> tuple[dict[str, Column], dict[str, Column]]:
    w = known_window(keys)
    state = {"_n": F.count(F.lit(1)), "_units": F.sum("launch_units"), "_items": F.countDistinct("sku"),
             "_last": F.max("label_available_at")}
    running = {"donors": F.coalesce(F.sum("_n").over(w), F.lit(0)), "donor_units": F.sum("_units").over(w),
               "donor_items": F.coalesce(F.sum("_items").over(w), F.lit(0)), "last_label": F.max("_last").over(w)}
    return state, running


def eligible_donors(records: DataFrame, held_out: DataFrame) -> DataFrame:
    """Training pool of every launch: completed launches of other, not held-out items.

    A launch's own label arrives after its cutoff, so it never counts itself; an item has one launch day, so distinct
    items per day add up.
    """
    donors = records.join(held_out.select("sku"), "sku", "left_anti")
    state, running = _pool_columns([])
    pool = _known_by(donors, records, [], state, running)
    return records.select("sku", F.col("week").alias("day")).distinct().join(pool, "day").select(
        "sku", F.col("day").alias("cutoff"), "donors", "donor_items",
        ratio(F.col("donor_units"), F.nullif(F.col("donors"), F.lit(0))).alias("donor_mean"),
        F.col("last_label").alias("train_label_available_max"))


def hierarchical_mean(records: DataFrame, held_out: DataFrame) -> DataFrame:
    """Category baseline: mean launch units of the most specific level that has any eligible donor.

    The four levels travel through one pipeline as copies of each row whose unused keys are blank.
    """
    def by_level(df: DataFrame) -> DataFrame:
        levels = F.explode(F.array(*[
            F.struct(F.lit(i).alias("level"), *[(F.col(k) if k in keys else F.lit("")).alias(f"k_{k}")
                                                for k in ("category", "channel", "region")])
            for i, (_, keys) in enumerate(FALLBACK_LEVELS)]))
        return df.withColumn("_l", levels).select("*", "_l.*").drop("_l")

    keys = ["level", "k_category", "k_channel", "k_region"]
    donors = by_level(records.join(held_out.select("sku"), "sku", "left_anti"))
    targets = by_level(records.select(*WEEK_KEYS, "category"))
    state, running = _pool_columns(keys)
    pools = _known_by(donors, targets, keys, state, running).filter("donors > 0")
    found = targets.withColumnRenamed("week", "day").join(pools, [*keys, "day"])
    best = found.groupBy(*SERIES).agg(F.min(F.struct("level", "donors", "donor_units")).alias("best"))
    names = F.array(*[F.lit(n) for n, _ in FALLBACK_LEVELS])
    return records.join(best, SERIES, "left").select(
        *records.columns,
        ratio(F.col("best.donor_units"), F.col("best.donors")).alias("pred_category_mean"),
        F.get(names, F.col("best.level")).alias("baseline_level"),
        F.col("best.donors").alias("baseline_donors"))


def analog_metadata(records: DataFrame, held_out: DataFrame) -> DataFrame:
    """Most similar completed launch in the same channel and region, then the latest one, then item order.

    A score means a set of matching attributes. Walking the sets from the highest score down, the first set with any
    donor is the best score, so per set only the latest launch per day has to be kept.
    """
    attrs = list(MATCH_WEIGHTS)

    def by_match(df: DataFrame) -> DataFrame:
        sets = F.explode(F.array(*[
            F.struct(F.lit(score).alias("score"), *[
                (F.col(a) if score & MATCH_WEIGHTS[a] else F.lit("")).alias(f"k_{a}") for a in attrs])
            for score in range(sum(MATCH_WEIGHTS.values()) + 1)]))
        return df.withColumn("_s", sets).select("*", "_s.*").drop("_s")

    keys = ["score", "channel", "region"] + [f"k_{a}" for a in attrs]
    donors = by_match(records.join(held_out.select("sku"), "sku", "left_anti"))
    targets = by_match(records.select(*WEEK_KEYS, *attrs))
    state = {"_donor": F.min(F.struct("sku", "launch_units", "label_available_at"))}
    running = {"donor": F.last("_donor", ignorenulls=True).over(known_window(keys))}
    latest = _known_by(donors, targets, keys, state, running).filter(F.col("donor").isNotNull())
    found = targets.withColumnRenamed("week", "day").join(latest, [*keys, "day"])
    best = found.groupBy(*SERIES).agg(F.max(F.struct("score", "donor")).alias("best"))
    return records.join(best, SERIES, "left").select(
        *records.columns,
        F.col("best.donor.launch_units").alias("pred_zero_analog"),
        F.col("best.donor.sku").alias("analog_sku"),
        F.col("best.donor.label_available_at").alias("analog_label_available_at"),
        F.col("best.score").alias("match_score"))


def chronological_eligibility(records: DataFrame, held_out: DataFrame, min_train_items: int = MIN_TRAIN_ITEMS) -> DataFrame:
    """Status of every launch from dates and counts alone, never from outcomes."""
    if min_train_items < 1:
        raise ValueError(f"at least one earlier item is needed, not {min_train_items}")
    pool = eligible_donors(records, held_out)
    rows = records.groupBy("sku").agg(F.count(F.lit(1)).alias("evaluation_rows"))
    reserved = held_out.select("sku").withColumn("_reserved", F.lit(True))
    status = (F.when(F.col("_reserved"), "reserved_existing_test")
              .when(F.col("donor_items") >= min_train_items, "eligible").otherwise("insufficient_prior_launches"))
    return pool.join(rows, "sku").join(reserved, "sku", "left").select(
        "sku", "cutoff", F.col("donor_items").alias("prior_train_skus"), "evaluation_rows", status.alias("status"))


# ---------------------------------------------------------------- analogs by price

def _nearest(candidates: DataFrame, targets: DataFrame, keys: list[list[str]], scope: list[str]) -> DataFrame:
    """Per target: the candidate of the first tier that has one, then the nearest price, then item order.

    Both sides have ``sku``, ``price_unit``, the keys and the columns ``scope``, in which they must agree. A copy of each row per tier, sorted
    by price within tier, keys and scope, meets its neighbours in two running windows; equal prices are one candidate, so no
    candidate is paired with a target that is not next to it. Rows without a price take no part, nor those without a key in its tier.
    """
    names = sorted({k for tier in keys for k in tier})
    place = [*scope, "tier", *[f"k_{k}" for k in names]]

    def by_tier(df: DataFrame) -> DataFrame:
        tiers = F.array(*[F.struct(F.lit(i).alias("tier"), *[(F.col(k) if k in tier else F.lit("")).alias(f"k_{k}") for k in names])
                          for i, tier in enumerate([*keys, []])])
        return df.select("sku", "price_unit", *scope, F.inline(tiers)).dropna()

    asks = by_tier(targets)
    offers = by_tier(candidates).join(asks.select(*place).distinct(), place, "left_semi").groupBy(*place, "price_unit").agg(F.min("sku").alias("sku"))
    nothing = F.lit(None)
    both = offers.select(*place, "price_unit", F.struct("price_unit", "sku").alias("offer"), nothing.cast("string").alias("target")).unionByName(
        asks.select(*place, "price_unit", nothing.alias("offer"), F.col("sku").alias("target")))
    neighbours = F.array(*[F.last("offer", ignorenulls=True).over(Window.partitionBy(*place).orderBy(order).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)) for order in (F.asc("price_unit"), F.desc("price_unit"))])
    found = both.select("target", "tier", "price_unit", neighbours.alias("offers")).filter("target IS NOT NULL")
    found = found.select("target", "tier", "price_unit", F.explode("offers").alias("o")).filter("o IS NOT NULL")
    gap = F.abs(F.col("o.price_unit") - F.col("price_unit"))
    best = found.groupBy("target").agg(F.min(F.struct("tier", gap.alias("price_gap"), F.col("o.sku").alias("sku"))).alias("best"))
    return best.select(F.col("target").alias("sku"), F.col("best.sku").alias("analog_sku"), "best.tier", "best.price_gap")


def analog_tiered(attrs: DataFrame, held_out: DataFrame) -> DataFrame:
    """Nearest earlier-launched item: category+segment+pack, category+pack, category, any; then price, then item.

    "Earlier" is an equality: the days before a target are cut into blocks of 1, 2, 4, ... days by the binary digits of their
    number, and a candidate is in one block of each length.
    """
    targets = attrs.join(held_out.select("sku"), "sku", "left_semi")
    candidates = attrs.join(held_out.select("sku"), "sku", "left_anti")
    day = F.datediff("first_seen", candidates.agg(F.min("first_seen")).scalar())
    targets = targets.withColumn("_day", day).filter("_day > 0")
    top = F.floor(F.log2(targets.agg(F.max("_day")).scalar())).cast("int")
    block = F.call_function("shiftright", F.col("_day"), F.col("_digit"))

    def by_digit(df: DataFrame, odd: int) -> DataFrame:
        return df.withColumn("_digit", F.explode(F.sequence(F.lit(0), top))).filter(block % 2 == odd)

    # A target's block at a digit that is set is the even one before it; odd blocks are never asked for.
    targets = by_digit(targets, 1).withColumn("_block", block - 1)
    candidates = by_digit(candidates.withColumn("_day", day), 0).withColumn("_block", block)
    return _nearest(candidates, targets, [["category", "segment", "pack_type"], ["category", "pack_type"], ["category"]], ["_digit", "_block"])


def analog_launch(daily: DataFrame, held_out: DataFrame) -> DataFrame:
    """Analog from what was known at the target's launch Monday: candidate prices average only earlier days.

    The target's price is its first-day price. Pack type takes no part, it is not an item attribute. Candidates are reduced to
    running sums per item and week first; a state holds until the item's next week and is copied to the Mondays on which a
    target asks, whatever the number of targets.
    """
    items = item_table(daily)
    first_day = daily.join(held_out.select("sku", "first_seen"), "sku").filter(
        F.col("date") == F.col("first_seen"))
    prices = first_day.groupBy("sku").agg(F.avg("price_unit").alias("price_unit"))
    targets = items.join(prices, "sku").select(
        "sku", "category", "segment", "price_unit", F.trunc("first_seen", "week").alias("cutoff"))
    weekly = daily.join(held_out.select("sku"), "sku", "left_anti").groupBy("sku", F.date_add(F.trunc("date", "week"), 7).alias("known")).agg(
        F.sum("price_unit").alias("_sum"), F.count("price_unit").alias("_n"), F.min("category").alias("category"), F.min("segment").alias("segment"))
    by_week = Window.partitionBy("sku").orderBy("known")
    so_far = by_week.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mondays = targets.agg(F.collect_set("cutoff")).scalar()            # at most the weeks of the calendar
    states = weekly.select(
        "sku", "known", F.lead("known").over(by_week).alias("_until"), ratio(F.sum("_sum").over(so_far), F.sum("_n").over(so_far)).alias("price_unit"),
        F.min("category").over(so_far).alias("category"), F.min("segment").over(so_far).alias("segment")).withColumn("_mondays", mondays)
    holds = F.filter("_mondays", lambda m: (m >= F.col("known")) & (F.col("_until").isNull() | (m < F.col("_until"))))
    candidates = states.withColumn("cutoff", F.explode(holds))
    best = _nearest(candidates, targets, [["category", "segment"], ["category"]], ["cutoff"])
    return best.join(targets.select("sku", "cutoff"), "sku")


def label_known(panel: DataFrame, cutoff: Column, held_out: DataFrame) -> DataFrame:
    """Training rows whose label was fully observed by the cutoff, without the held-out items."""
    known = F.date_add("week", LABEL_DELAY_DAYS) <= cutoff
    return panel.filter(known).join(held_out.select("sku"), "sku", "left_anti")


def training_pool_sizes(panel: DataFrame, held_out: DataFrame) -> DataFrame:
    """Per held-out item: rows, items and latest label of the training data available at its launch Monday.

    A row of the panel is a week, or with ``n_weeks`` a run of that many weeks (``rollup.labelled_runs``). An item counts from
    its first week on, so weekly totals add up; a task sends one row per week and item at most. Where runs begin and end, the
    number of rows per week changes; it holds for the weeks up to the next change.
    """
    targets = held_out.select("sku", F.trunc("first_seen", "week").alias("week"))
    rows = panel.join(F.broadcast(held_out.select("sku")), "sku", "left_anti")
    if "n_weeks" in panel.columns:
        ends = F.array(F.struct("week", F.lit(1).alias("n")), F.struct(F.expr("date_add(week, CAST(7 * n_weeks AS INT))").alias("week"), F.lit(-1).alias("n")))
        by_week = Window.orderBy("week")                # one row per week of the calendar
        changes = rows.select(F.inline(ends)).groupBy("week").agg(F.sum("n").alias("n"))
        changes = changes.select("week", F.sum("n").over(by_week).alias("n"), F.lead("week").over(by_week).alias("_next"))
        weekly = changes.filter("n > 0").select(F.explode(F.expr("sequence(week, date_sub(_next, 7), INTERVAL 7 DAYS)")).alias("week"), "n")
    else:
        weekly = rows.groupBy("week").agg(F.count(F.lit(1)).alias("n"))
    new = rows.groupBy("sku").agg(F.min("week").alias("week")).groupBy("week").agg(F.count(F.lit(1)).alias("items"))
    rows = weekly.join(new, "week", "left").withColumn("label_available_at", F.date_add("week", LABEL_DELAY_DAYS))
    w = known_window([])
    state = {"_rows": F.sum("n"), "_items": F.sum("items"), "_last": F.max("label_available_at")}
    running = {"train_rows": F.sum("_rows").over(w), "train_skus": F.sum("_items").over(w), "train_label_available_max": F.max("_last").over(w)}
    pools = _known_by(rows, targets, [], state, running).filter("train_rows > 0")
    return targets.withColumnRenamed("week", "cutoff").join(pools.withColumnRenamed("day", "cutoff"), "cutoff").select(
        "sku", "cutoff", *running)


def analog_trajectory(panel: DataFrame, analogs: DataFrame) -> DataFrame:
    """Borrow the analog's next-week sales at the same channel, region and age, frozen at the target's launch.

    ``analogs`` has one row per held-out item (sku, analog_sku, cutoff). Labels that were not known at the cutoff
    stay NULL.
    """
    pairs = analogs.select("sku", "analog_sku", "cutoff")
    rows = panel.join(pairs, "sku")
    donor = panel.select(F.col("sku").alias("analog_sku"), "channel", "region", "sku_age",
                         F.date_add("week", LABEL_DELAY_DAYS).alias("_available"), F.col(LABEL).alias("pred_analog"))
    donor = donor.join(pairs.select("analog_sku").distinct(), "analog_sku", "left_semi")
    matched = rows.join(donor, ["analog_sku", "channel", "region", "sku_age"], "left")
    return matched.withColumn("pred_analog", F.when(F.col("_available") <= F.col("cutoff"), F.col("pred_analog"))).drop(
        "_available")


# ---------------------------------------------------------------- scores

def age_bucket(age: Column | str = "sku_age") -> Column:
    return F.least(F.col(age) if isinstance(age, str) else age, F.lit(OLDEST_AGE_BUCKET))


def age_window(age: str = "sku_age") -> Column:
    return F.when(F.col(age) < 4, "age 0-3").when(F.col(age) < 12, "age 4-11").otherwise("age 12+")


def _wide_scores(rows: DataFrame, by: list, actual: str, models: dict[str, str], extra: list[Column] = ()) -> DataFrame:
    """Long scores of several prediction columns on the rows where all of them exist, with coverage."""
    complete = F.lit(True)
    for c in models.values():
        complete = complete & F.col(c).isNotNull()
    rows = rows.withColumn("_shared", complete)
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.when(F.col("_shared"), F.col(c)).alias("prediction"))
                      for m, c in models.items()])
    long = rows.withColumn("_m", F.explode(items)).select("*", "_m.*").drop("_m")
    n = F.count("prediction")
    return long.groupBy(*by, "model").agg(
        n.alias("n"), F.count(F.lit(1)).alias("available_n"), ratio(n, F.count(F.lit(1))).alias("coverage"),
        *extra, *named(forecast_metrics(actual, "prediction")))


def scores_by_age(rows: DataFrame, models: dict[str, str]) -> DataFrame:
    """Scores per capped age and per age window, on common rows."""
    per_age = _wide_scores(rows, [age_bucket().cast("string").alias("bucket")], LABEL, models)
    per_window = _wide_scores(rows, [age_window().alias("bucket")], LABEL, models)
    return per_age.unionByName(per_window)


def cold_start_scores(predictions: DataFrame, models: dict[str, str]) -> DataFrame:
    """Common-row scores overall (scope all) and per item."""
    overall = _wide_scores(predictions, [F.lit("all").alias("scope")], "launch_units", models)
    return overall.unionByName(_wide_scores(predictions, [F.col("sku").alias("scope")], "launch_units", models))


def fallback_summary(predictions: DataFrame) -> DataFrame:
    """Rows, items and donor range per cohort and fallback level."""
    return predictions.groupBy("cohort", "baseline_level").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("sku").alias("n_skus"),
        F.min("baseline_donors").alias("min_donors"), F.max("baseline_donors").alias("max_donors"))


def history_gaps(panel: DataFrame, max_age: int = 3) -> DataFrame:
    """How incomplete the first weeks are: missing lags and partly observed weeks per age."""
    rows = panel.filter(F.col("sku_age").between(0, max_age))
    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0))
    return rows.groupBy("sku_age").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sku").alias("n_skus"),
        n(F.col("lag_1").isNull()).alias("missing_lag_1"), n(F.col("rolling_mean_4").isNull()).alias("missing_rolling_4"),
        n(F.col("observed_days") < 7).alias("partial_weeks"))
