"""Text to values: money, dates, labels, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of the article labels.
LABELS = {
    "game_no": r"Game #(\d+)",
    "print_run": r"(?i)Tickets?\s+printed\s*[-:]?\s*([\d,]+)",
    "overall_odds": r"(?i)OVERALL ODDS OF WINNING\s+1:\s*([\d,]+(?:\.\d+)?)",
    "on_sale": r"(?i)On Sale\s*[-:]?\s*([A-Za-z]+\s+\d{1,2},\s*\d{4})",
    "top_prize_value": r"(?i)Maximum Award:\s*\$?([\d,]+)",
}


def plain(x: Column) -> Column:
    """Non-breaking spaces as spaces, none at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank(x: Column) -> Column:
    return x.rlike(r"(?U)^\s*$")


def money(x: Column) -> Column:
    """Dollars; null if malformed."""
    return F.regexp_replace(plain(x), "[$,]", "").try_cast("double")


def percent(x: Column) -> Column:
    return F.regexp_replace(plain(x), "%", "").try_cast("double")


def integer(x: Column) -> Column:
    return F.regexp_replace(plain(x), ",", "").try_cast("bigint")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.lower(plain(x)), r"(?U)\s+", "-")


def label(x: Column, name: str) -> Column:
    """The text behind a label, or null."""
    return F.nullif(F.regexp_extract(x, LABELS[name], 1), F.lit(""))


def month_day(x: Column) -> Column:
    """`Month D, YYYY` as a date, or null."""
    return F.try_to_timestamp(F.regexp_replace(plain(x), r"\s+", " "), F.lit("MMMM d, yyyy")).cast("date")


def page_date(x: Column) -> Column:
    """The date of `Month D, YYYY h:mm AM`, or null."""
    return F.try_to_timestamp(plain(x), F.lit("MMMM d, yyyy h:mm a")).cast("date")


def after_as_of(x: Column) -> Column:
    at = F.locate("as of ", x)
    return F.when(at > 0, plain(F.substring(x, at + 6, F.length(x))))


def family(x: Column) -> Column:
    return F.lower(F.substring_index(x, "/", 1))


def listed(x: Column) -> Column:
    """A comma list without blanks."""
    return F.filter(F.transform(F.split(x, ","), lambda s: F.trim(s)), lambda s: s != "")


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("1", "true", "yes", "on")


def error_class(status: Column, body_code: Column) -> Column:
    """transient or terminal; a code in the body beats the status, unknown codes are terminal."""
    code = F.coalesce(F.when(body_code.rlike("^[0-9]+$"), body_code).try_cast("int"), status)
    return F.when(code.isin(408, 429, 502, 503), "transient").otherwise("terminal")
