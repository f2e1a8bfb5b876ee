"""Date parsing without exceptions.

Each known layout is a pattern and a rewrite to ISO text, then ``try_cast``. A failed
``try_to_timestamp`` throws and catches inside the JVM for every bad cell; a pattern that
does not match costs nothing more than the match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"(?:[ T](\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)Z?)?"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# layout name -> (pattern, year group, month group, day group, clock group)
LAYOUTS = {
    "yyyy-MM-dd": (r"^(\d{4})-(\d{1,2})-(\d{1,2})" + _CLOCK + "$", 1, 2, 3, 4),
    "yyyy/MM/dd": (r"^(\d{4})/(\d{1,2})/(\d{1,2})" + _CLOCK + "$", 1, 2, 3, 4),
    "MM/dd/yyyy": (r"^(\d{1,2})/(\d{1,2})/(\d{4})" + _CLOCK + "$", 3, 1, 2, 4),
    "MM-dd-yyyy": (r"^(\d{1,2})-(\d{1,2})-(\d{4})" + _CLOCK + "$", 3, 1, 2, 4),
    "dd/MM/yyyy": (r"^(\d{1,2})/(\d{1,2})/(\d{4})" + _CLOCK + "$", 3, 2, 1, 4),
    "yyyy.MM.dd": (r"^(\d{4})\.(\d{1,2})\.(\d{1,2})" + _CLOCK + "$", 1, 2, 3, 4),
    "yyyyMMdd": (r"^(\d{4})(\d{2})(\d{2})" + _CLOCK + "$", 1, 2, 3, 4),
    "d MMM yyyy": (r"^(\d{1,2}) ([A-Za-z]{3})[a-z]*\.? (\d{4})" + _CLOCK + "$", 3, 2, 1, 4),
    "MMM d, yyyy": (r"^([A-Za-z]{3})[a-z]* (\d{1,2}),? (\d{4})" + _CLOCK + "$", 3, 1, 2, 4),
    "dd-MM-yyyy": (r"^(\d{1,2})-(\d{1,2})-(\d{4})" + _CLOCK + "$", 3, 2, 1, 4),
}
DEFAULT_LAYOUTS = list(LAYOUTS)
# Layouts whose cells also fit the other order of day and month.
DAY_FIRST = {"MM/dd/yyyy": "dd/MM/yyyy", "MM-dd-yyyy": "dd-MM-yyyy"}
_EITHER = r"^(\d{1,2})[/-](\d{1,2})[/-]\d{4}(?:[ T]|$)"


def parse_layout(c: Column, layout: str) -> Column:
    """Timestamp if the text has this layout and names a real day, else null."""
    pattern, year, month, day, clock = LAYOUTS[layout]
    text = F.trim(c)
    month_text = F.regexp_extract(text, pattern, month)
    if "MMM" in layout:
        found = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(month_text))
        month_text = found.cast("string")
    clock_text = F.regexp_extract(text, pattern, clock)
    iso = F.concat(
        F.regexp_extract(text, pattern, year),
        F.lit("-"),
        F.lpad(month_text, 2, "0"),
        F.lit("-"),
        F.lpad(F.regexp_extract(text, pattern, day), 2, "0"),
        F.when(clock_text != "", F.concat(F.lit(" "), clock_text)).otherwise(F.lit("")),
    )
    return F.when(text.rlike(pattern), iso.try_cast("timestamp_ntz"))


def day_first_vote(c: Column) -> Column:
    """1 for a cell that only day-first order explains, -1 for month-first only, else 0."""
    first, second = (F.regexp_extract(F.trim(c), _EITHER, i).try_cast("int") for i in (1, 2))
    return (
        F.when((first > 12) & second.between(1, 12), F.lit(1))
        .when((second > 12) & first.between(1, 12), F.lit(-1))
        .otherwise(F.lit(0))
    )


def coerce_date(
    c: Column, layouts: Sequence[str] = DEFAULT_LAYOUTS, day_first: Column | None = None
) -> Column:
    """First layout that parses wins; nothing parses gives null.

    Where ``day_first`` is true, 03/04/2024 is the third of April. A cell that the order of its
    source cannot explain is still read in the other one.
    """
    parsed = []
    for layout in layouts:
        twin = DAY_FIRST.get(layout)
        if day_first is not None and twin in layouts:
            parsed.append(F.when(day_first, parse_layout(c, twin)))
        parsed.append(parse_layout(c, layout))
    return F.coalesce(*parsed)


def layout_index(c: Column, layouts: Sequence[str] = DEFAULT_LAYOUTS) -> Column:
    """Position of the first layout that parses the text, -1 if none, null for null."""
    found = F.when(c.isNull(), F.lit(None).cast("int"))
    for i, layout in enumerate(layouts):
        found = found.when(parse_layout(c, layout).isNotNull(), F.lit(i))
    return found.otherwise(F.lit(-1))


def coerce_date_as(c: Column, index: Column, layouts: Sequence[str] = DEFAULT_LAYOUTS) -> Column:
    """Parse with the layout chosen per row by ``index`` (the strict, one-layout mode)."""
    parsed = F.lit(None).cast("timestamp_ntz")
    for i, layout in enumerate(layouts):
        parsed = F.when(index == i, parse_layout(c, layout)).otherwise(parsed)
    return parsed
