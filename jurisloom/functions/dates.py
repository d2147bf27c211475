"""Date expressions at the boundary of the corpus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_date(text: Column) -> Column:
    """A date written as year-month-day; null if empty, open-ended (2999), of another shape or impossible."""
    t = F.trim(text)
    return F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~t.startswith("2999-"), F.try_to_date(t, "yyyy-MM-dd"))


def date10(text: Column) -> Column:
    """The first ten characters, null where there are fewer."""
    head = F.substring(text, 1, 10)
    return F.when(F.length(head) == 10, head)


def days_before(moment: Column, days: int) -> Column:
    return moment - F.make_dt_interval(F.lit(days))
