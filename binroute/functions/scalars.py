"""Column expressions shared by the operators. All run inside codegen."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def bin_of(card_no: Column) -> Column:
    """First six characters; a shorter card number is returned whole."""
    return F.substring(card_no, 1, 6)


def bin_prefix(bin_no: Column) -> Column:
    return F.floor(bin_no / F.lit(1000)).cast("long")


def bin_suffix(bin_no: Column) -> Column:
    return F.pmod(bin_no, F.lit(1000)).cast("long")


def strip(text: Column) -> Column:
    """Drop leading and trailing ASCII white space, not blanks only."""
    return F.trim(text, F.lit(WHITESPACE))


def day(as_of: date | str | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")


def month_window(created_date: Column, as_of: date | str | Column | None = None) -> Column:
    """The whole calendar month before the one ``as_of`` lies in, half open."""
    today = day(as_of)
    return (created_date >= F.trunc(F.add_months(today, -1), "MM")) & (created_date < F.trunc(today, "MM"))


def trailing_month(created_date: Column, as_of: date | str | Column | None = None) -> Column:
    """From one month before ``as_of`` on, with no upper bound."""
    return created_date >= F.add_months(day(as_of), -1)


def safe_div(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def exact_percent(part: Column, whole: Column, digits: int) -> Column:
    """``part / whole`` in percent, rounded half up; NULL when ``whole`` is 0.

    The quotient is decimal, so a tie in the last digit rounds up exactly and
    does not depend on how a double happens to approximate it.
    """
    ratio = part.cast("decimal(20,0)") / F.nullif(whole, F.lit(0)).cast("decimal(20,0)")
    return F.round(ratio * 100, digits).cast("double")
