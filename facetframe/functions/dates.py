"""Reading dates out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date spellings understood in text columns, with "-", "/" or "." between parts, or named months.
YEAR_FIRST_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"
CLOCK = "[ h:m[:s] a][ H:m[:s]]"
MONTH_FIRST = "M-d-yyyy" + CLOCK
DAY_FIRST = "d-M-yyyy" + CLOCK
NAMED_MONTH = "d-MMM-yyyy" + CLOCK
FULL_MONTH = "d-MMMM-yyyy" + CLOCK
DATE_SHAPE = (r"^\s*(\d{1,4}[-/.](\d{1,2}|[A-Za-z]{3,9})[-/.]\d{1,4}([T ].*)?|\d{4}-\d{1,2}"
              r"|([A-Za-z]{3,9}\.? \d{1,2}|\d{1,2} [A-Za-z]{3,9}),? \d{4}([T ].*)?)\s*$")
#: How other spellings become one with dashes and years of four digits; two-digit years are 1969 to 2068.
STEPS = ((r"^(?:([A-Za-z]{3,9})\.? (\d{1,2})|(\d{1,2}) ([A-Za-z]{3,9})),? (\d{4})", "$2$3-$1$4-$5"),
         (r"^(\d{1,4})[-/.](\w{1,9})[-/.](\d{1,4})", "$1-$2-$3"),
         (r"^(\d{1,2}-(?:\d{1,2}|[A-Za-z]{3,9})-)([0-5]\d|6[0-8])( |$)", "$120$2$3"),
         (r"^(\d{1,2}-(?:\d{1,2}|[A-Za-z]{3,9})-)(69|[7-9]\d)( |$)", "$119$2$3"),
         (r"^(\d{4}-\d{1,2})$", "$1-01"))


def _dashed(c: Column) -> Column:
    """The text in one spelling, null unless it looks like a date; only such text is parsed."""
    text = F.trim(c)
    for shape, spelled in STEPS:
        text = F.regexp_replace(text, shape, spelled)
    return F.when(c.rlike(DATE_SHAPE), text)


def _as(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


def month_first(c: Column) -> Column:
    return _as(_dashed(c), MONTH_FIRST)


def day_first(c: Column) -> Column:
    return _as(_dashed(c), DAY_FIRST)


def parse_text(c: Column, prefer_day_first: Column | bool = False) -> Column:
    """Timestamp for a text value, null when it is not a date.

    ``10/11/2024`` is ambiguous: month first unless the caller knows the column
    to be written day first (see ``semantic.detect_schema``).
    """
    text = _dashed(c)
    prefer = F.lit(prefer_day_first) if isinstance(prefer_day_first, bool) else prefer_day_first
    return (F.when(text.rlike(YEAR_FIRST_SHAPE), F.try_to_timestamp(text))
            .otherwise(F.coalesce(F.when(prefer, _as(text, DAY_FIRST)), _as(text, MONTH_FIRST),
                                  _as(text, DAY_FIRST), _as(text, NAMED_MONTH), _as(text, FULL_MONTH))))
