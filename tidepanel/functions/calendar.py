"""Calendar expressions: weeks, holidays, event dates and seasons, each from the date alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Public holidays by month-day and whether each is a retail peak.
HOLIDAY_KINDS = [
    ("01-01", "peak"),
    ("01-06", "minor"),
    ("05-01", "minor"),
    ("05-03", "minor"),
    ("08-15", "minor"),
    ("11-01", "minor"),
    ("11-11", "minor"),
    ("12-24", "peak"),
    ("12-25", "peak"),
    ("12-26", "peak"),
]
# Days after Easter Sunday -> kind.
EASTER_KINDS = [(0, "peak"), (1, "peak"), (60, "minor")]
# Holidays that drive the event score, besides Easter Sunday.
EVENT_DATES = ["05-01", "05-03", "11-01", "12-24", "12-25", "12-26"]
EVENT_REACH_DAYS = 7
EVENT_DECAY = 0.15
SUMMER_MONTHS = [6, 7, 8]
WINTER_MONTHS = [1, 2, 12]
SCHOOL_BREAK_MONTHS = [7, 8]

def monday(day: Column | str) -> Column:
    """Monday that labels the left-closed week containing ``day``."""
    return F.trunc(F.col(day) if isinstance(day, str) else day, "week")


def easter(year: str) -> Column:
    """Easter Sunday of a year column by the Gauss rule of the Gregorian calendar; its two terms shift with the century."""
    c = f"({year} div 100)"
    m = f"((15 + {c} - {c} div 4 - (13 + 8 * {c}) div 25) % 30)"
    moon = f"((19 * ({year} % 19) + {m}) % 30)"
    sun = f"((2 * ({year} % 4) + 4 * ({year} % 7) + 6 * {moon} + (4 + {c} - {c} div 4) % 7) % 7)"
    late = f"({moon} = 29 AND {sun} = 6) OR ({moon} = 28 AND {sun} = 6 AND {year} % 19 > 10)"
    return F.expr(f"date_add(make_date({year}, 3, 22), cast({moon} + {sun} - CASE WHEN {late} THEN 7 ELSE 0 END AS int))")


def _dates(entries: list[str], years: list[Column]) -> list[Column]:
    return [F.make_date(y, *[F.lit(int(x)) for x in d.split("-")]) for d in entries for y in years]


def holiday_flags(df: DataFrame, week: str = "week") -> DataFrame:
    """Add ``is_holiday_week`` and ``is_holiday_peak`` of the seven days from the Monday ``week``; 0 where it is missing.

    Flags follow from the week alone, so there is no calendar to build or to join. Easter and what moves with it lie in one
    year; only fixed dates can fall into the year that a week reaches.
    """
    first, last = F.col(week), F.date_add(week, 6)
    df = df.withColumns({"_year": F.year(first), "_next": F.year(last)}).withColumn("_easter", easter("_year"))

    def any_of(kinds: tuple[str, ...]) -> Column:
        days = _dates([d for d, k in HOLIDAY_KINDS if k in kinds], [F.col("_year"), F.col("_next")])
        days += [F.date_add("_easter", o) for o, k in EASTER_KINDS if k in kinds]
        found = F.lit(False)
        for d in days:
            found = found | d.between(first, last)
        return F.coalesce(found, F.lit(False)).cast("int")

    return df.withColumns({"is_holiday_week": any_of(("peak", "minor")), "is_holiday_peak": any_of(("peak",))}).drop("_year", "_next", "_easter")


def event_score(df: DataFrame, week: str = "week") -> DataFrame:
    """Add ``event_score``: by the nearest event date within seven days of the Monday ``week``, 0 without one."""
    day = F.col(week)
    df = df.withColumns({"_year": F.year(day), "_last": F.year(F.date_sub(day, EVENT_REACH_DAYS))}).withColumn("_easter", easter("_year"))
    days = _dates(EVENT_DATES, [F.col("_year"), F.col("_last")]) + [F.col("_easter")]
    gap = F.least(*[F.abs(F.datediff(day, d)) for d in days])
    score = F.when(gap <= EVENT_REACH_DAYS, 1.0 - gap / EVENT_REACH_DAYS * EVENT_DECAY)
    return df.withColumn("event_score", F.coalesce(score, F.lit(0.0))).drop("_year", "_last", "_easter")


def calendar_flags(df: DataFrame, week: str = "week") -> DataFrame:
    """ISO week number, calendar month/year and season flags of the week's Monday."""
    month = F.month(week)
    return df.withColumns({
        "week_number": F.weekofyear(week),
        "month": month,
        "year": F.year(week),
        "is_summer": month.isin(SUMMER_MONTHS).cast("int"),
        "is_winter": month.isin(WINTER_MONTHS).cast("int"),
    })
