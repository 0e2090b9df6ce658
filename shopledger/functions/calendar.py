"""Calendar columns of an invoice date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months of each season, and the first day of the November holiday period.
SEASON_MONTHS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
    "Fall": (9, 10, 11),
}
HOLIDAY_START_DAY = 25

SEASONS = tuple(SEASON_MONTHS)


def season(date: Column) -> Column:
    month = F.month(date)
    return (
        F.when(month.isin(*SEASON_MONTHS["Winter"]), "Winter")
        .when(month.isin(*SEASON_MONTHS["Spring"]), "Spring")
        .when(month.isin(*SEASON_MONTHS["Summer"]), "Summer")
        .when(month.isNotNull(), "Fall")
    )


def holiday_season(date: Column) -> Column:
    """December, or 25 November onward."""
    late_november = (F.month(date) == 11) & (F.dayofmonth(date) >= HOLIDAY_START_DAY)
    return (F.month(date) == 12) | late_november


def month_start(date: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(date, "month")
