"""Card dates, ages and local days, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAN, USA = "CCYYMMDD", "MMDDCCYY"


def date_order(country: Column, value: Column) -> Column:
    """The order of a card date: by country, else by the one half that looks like a year; null if that is unclear."""
    digits = F.trim(F.coalesce(value, F.lit("")))
    year = lambda at: F.substring(digits, at, 4).between("1900", "2099")  # noqa: E731  four digits sort as their numbers do
    guess = F.when(digits.rlike("^[0-9]{8}$"), F.when(year(1) & ~year(5), CAN).when(year(5) & ~year(1), USA))
    return F.when(country == "CAN", CAN).when(country == "USA", USA).otherwise(guess)


def card_date(value: Column, order: Column) -> Column:
    """The date of eight digits in an order; null for any other text and for days that don't exist."""
    text = F.trim(F.coalesce(value, F.lit("")))
    iso = F.when(order == CAN, F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).when(
        order == USA, F.concat_ws("-", F.substring(text, 5, 4), F.substring(text, 1, 2), F.substring(text, 3, 2))
    )
    return F.when(text.rlike("^[0-9]{8}$"), iso.try_cast("date"))


def age_on(born: Column, day: Column) -> Column:
    """Full years; who was born on 29 February has their day on 1 March in other years."""
    before = (F.month(day) * 100 + F.dayofmonth(day)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(day) - F.year(born) - before.cast("int")


def local_day(now: Column, tz: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(now, tz))
