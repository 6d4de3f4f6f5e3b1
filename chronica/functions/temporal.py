"""Dates as intervals, calendars, ages and time buckets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.functions import vocab

EPOCH_JDN = 2440588  # Julian day number of 1970-01-01


def _div(a: Column, b) -> Column:
    """Floor division of whole numbers."""
    return F.floor(a / b).cast("int")


# --- calendars --------------------------------------------------------------
def calendar_kind(uri: Column) -> Column:
    """Calendar name from the last segment of a model URI; others stay unknown."""
    tail = F.substring_index(F.coalesce(uri, F.lit("")), "/", -1)
    return F.when(tail == vocab.JULIAN_ID, "julian").when(tail == vocab.GREGORIAN_ID, "gregorian").otherwise("unknown")


def calendar_code(code: Column) -> Column:
    """Calendar name from a letter, a word, an id or a model URI."""
    tail = F.lower(F.substring_index(F.trim(F.coalesce(code, F.lit(""))), "/", -1))
    return (
        F.when(tail.isin("j", "julian", vocab.JULIAN_ID.lower()), "julian")
        .when(tail.isin("g", "gregorian", vocab.GREGORIAN_ID.lower()), "gregorian")
        .otherwise("unknown")
    )


def day_number(year: Column, month: Column, day: Column, julian: Column) -> Column:
    """Julian day number of a civil date in either calendar, counted from a year
    that starts in March. Whole-number arithmetic, so it never fails on a row."""
    before_march = (month <= 2).cast("int")
    y = year + 4800 - before_march
    m = month + 12 * before_march - 3
    common = day + _div(m * 153 + 2, 5) + y * 365 + _div(y, 4)
    return (common + F.when(julian, -32083).otherwise(_div(y, 400) - _div(y, 100) - 32045)).cast("int")


def civil_date(year: Column, month: Column, day: Column, julian: Column) -> Column:
    """Proleptic Gregorian date of a civil date in either calendar."""
    return F.date_add(F.lit("1970-01-01").cast("date"), day_number(year, month, day, julian) - EPOCH_JDN)


def julian_to_gregorian(year: Column, month: Column, day: Column) -> Column:
    return civil_date(year, month, day, F.lit(True))


def month_days(year: Column, month: Column, julian: Column) -> Column:
    leap = (year % 4 == 0) & (julian | (year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def julian_month_days(year: Column, month: Column) -> Column:
    return month_days(year, month, F.lit(True))


def day_cycle(date: Column) -> Column:
    """Position of a civil day in the 60-day cycle."""
    return (F.date_diff(date, F.lit("1970-01-01").cast("date")) + EPOCH_JDN + 49) % 60


# --- intervals --------------------------------------------------------------
DATED = ("day", "month", "year")


def time_numbers(time: Column) -> Column:
    """Year, month and day text of a ``+YYYY-MM-DDT...`` value."""
    return F.split(F.ltrim(F.substring_index(time, "T", 1), F.lit("+")), "-")


def time_parts(time: Column, numbers: Column, precision: Column, calendar_uri: Column) -> Column:
    """A time value read into numbers, ready for ``with_interval``. ``numbers``
    is its :func:`time_numbers` as a column of its own, split once."""
    absent = time.isNull() | (time == "")
    return F.struct(
        absent.alias("absent"),
        F.get(numbers, F.lit(0)).try_cast("int").alias("y"),
        F.coalesce(F.get(numbers, F.lit(1)).try_cast("int"), F.lit(0)).alias("m"),
        F.coalesce(F.get(numbers, F.lit(2)).try_cast("int"), F.lit(0)).alias("d"),
        F.coalesce(precision, F.lit(0)).alias("p"),
        F.when(absent, "unknown").otherwise(calendar_kind(calendar_uri)).alias("calendar"),
    )


def with_parts(df: DataFrame, time: str, precision: str, calendar_uri: str, out: str = "parts") -> DataFrame:
    split = df.withColumn("__numbers", time_numbers(F.col(time)))
    parts = time_parts(F.col(time), F.col("__numbers"), F.col(precision), F.col(calendar_uri))
    return split.withColumn(out, parts).drop("__numbers")


def with_interval(df: DataFrame, parts: str) -> DataFrame:
    """Replace a ``time_parts`` column by ``lo``, ``hi``, ``label``, ``calendar``.

    Nothing coarser than a year is given a date, and Julian bounds come out as
    Gregorian days. Whoever wants dated rows only filters on ``label``, whose
    expression is small enough to be pushed down to the rows' source.
    """
    y, m, d, p = (F.col(f"{parts}.{c}") for c in "ymdp")
    julian = F.col(f"{parts}.calendar") == "julian"
    month_ok = m.between(1, 12)
    # A Julian day past its month's end rolls over; a Gregorian one is invalid.
    day_ok = month_ok & (d >= 1) & (julian | (d <= month_days(y, m, F.lit(False))))
    label = (
        F.when(F.col(f"{parts}.absent"), "unknown")
        .when(y.isNull() | (y <= 0) | (y > 9999), "unsupported")
        .when(p < 9, "coarse")
        .when(p == 9, "year")
        .when(month_ok & (p == 10), "month")
        .when(day_ok & (p > 10), "day")
        .otherwise("invalid")
    )
    year, day = F.col("label") == "year", F.col("label") == "day"
    staged = df.withColumn("label", label).withColumns(
        {
            "__m1": F.when(year, 1).otherwise(m),
            "__m2": F.when(year, 12).otherwise(m),
            "__d1": F.when(day, d).otherwise(1),
            "__d2": F.when(day, d).when(year, 31).otherwise(month_days(y, m, julian)),
        }
    )
    dated = F.col("label").isin(*DATED)
    return staged.withColumns(
        {
            "lo": F.when(dated, civil_date(y, F.col("__m1"), F.col("__d1"), julian)),
            "hi": F.when(dated, civil_date(y, F.col("__m2"), F.col("__d2"), julian)),
            "calendar": F.col(f"{parts}.calendar"),
        }
    ).drop("__m1", "__m2", "__d1", "__d2", parts)


def partial_interval(raw: Column) -> Column:
    """Interval of ``YYYY``, ``YYYY-MM`` or an ISO day; null bounds otherwise."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    size = F.length(text)
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    month = F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd")
    year = text.rlike(r"^\d{4}$") & (text != "0000")
    lo = (
        F.when(size >= 10, day)
        .when(size == 7, month)
        .when(year, F.try_to_date(F.concat(text, F.lit("-01-01")), "yyyy-MM-dd"))
    )
    hi = (
        F.when(size >= 10, day)
        .when(size == 7, F.last_day(month))
        .when(year, F.try_to_date(F.concat(text, F.lit("-12-31")), "yyyy-MM-dd"))
    )
    unit = F.when(size >= 10, "day").when(size == 7, "month").otherwise("year")
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(lo.isNotNull(), unit).alias("label"))


def partial_iso(time: Column, precision: Column) -> Column:
    """``YYYY``, ``YYYY-MM`` or a full day from a time value and its precision."""
    parts = F.split(F.substring_index(F.regexp_replace(time, r"^\++", ""), "T", 1), "-")
    size = F.size(parts)
    year = F.get(parts, F.lit(0)).try_cast("int")
    month = F.when(size > 1, F.get(parts, F.lit(1)).try_cast("int")).otherwise(1)
    day = F.when(size > 2, F.get(parts, F.lit(2)).try_cast("int")).otherwise(1)
    readable = year.between(1, 9999) & month.isNotNull() & day.isNotNull()
    return F.when(
        readable,
        F.when(precision == 9, F.format_string("%04d", year))
        .when(precision == 10, F.format_string("%04d-%02d", year, month))
        .otherwise(F.format_string("%04d-%02d-%02d", year, month, day)),
    )


def cutoff_end(raw: Column, month_rule: str = "month_end") -> Column:
    """Last day a partial date can mean; ``day28`` is the older month rule."""
    text = F.substring(raw, 1, 10)
    size = F.length(text)
    month = F.try_to_date(F.concat(F.substring(text, 1, 7), F.lit("-01")), "yyyy-MM-dd")
    month_end = F.date_add(month, 27) if month_rule == "day28" else F.last_day(month)
    return (
        F.when(size == 4, F.try_to_date(F.concat(text, F.lit("-12-31")), "yyyy-MM-dd"))
        .when(size == 7, month_end)
        .when(size == 10, F.try_to_date(text, "yyyy-MM-dd"))
    )


def add_years(date: Column, years) -> Column:
    """Same day some years later; 29 February falls back to the 28th."""
    years = years if isinstance(years, Column) else F.lit(years)
    return F.add_months(date, (years * 12).cast("int"))


# --- ages -------------------------------------------------------------------
def age_units(birth: Column, day: Column) -> Column:
    """Age in ten-thousandths of a year, a whole number both engines agree on."""
    return F.round(F.date_diff(day, birth) / F.lit(vocab.DAYS_PER_YEAR) * 10000).cast("bigint")


def age_years(birth: Column, day: Column) -> Column:
    return age_units(birth, day) / 10000


def with_ages(events: DataFrame, births: DataFrame) -> DataFrame:
    """Join births and add ``age_min``, ``age_max`` and ``age_mid``."""
    return age_columns(events.join(births, "person_id"))


def age_columns(joined: DataFrame) -> DataFrame:
    """The age columns of events that carry their person's ``birth_date``."""
    lo = age_units(F.col("birth_date"), F.col("date_min"))
    hi = age_units(F.col("birth_date"), F.col("date_max"))
    return joined.withColumns(
        {
            "age_min": lo / 10000,
            "age_max": hi / 10000,
            "age_mid": F.floor((lo + hi + 1) / 2) / 10000,
        }
    )


def midyear_age(birth: Column, year: Column) -> Column:
    """Age on 2 July of a year."""
    return age_years(birth, F.try_to_date(F.format_string("%04d-07-02", year), "yyyy-MM-dd"))


# --- buckets ----------------------------------------------------------------
def life_stage(age: Column) -> Column:
    out = None
    for lo, hi, name in vocab.STAGES:
        hit = (age >= lo) & (age < hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def era(year: Column) -> Column:
    out = None
    for lo, hi, name in vocab.ERAS:
        hit = year.between(lo, hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def year_floor(year: Column, width: int) -> Column:
    """First year of the ``width``-year block a year lies in."""
    return (F.floor(year / width) * width).cast("int")


def cyclic(position: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle."""
    angle = position * 2 * F.pi() / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
