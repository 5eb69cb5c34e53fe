"""Statement dates as Column expressions. Years 2000 to 2099 if nothing else is said; two-digit years are 20xx."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bahikhata.functions.amounts import let

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_DAY_FIRST = r"^([0-9]{1,2})[/\-. ]([0-9]{1,2})[/\-. ]([0-9]{4}|[0-9]{2})$"
_NAMED = r"(?i)^([0-9]{1,2})[/\-. ,]*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[/\-. ,]*([0-9]{4}|[0-9]{2})$"
_ISO = r"^([0-9]{4})[/\-.]([0-9]{1,2})[/\-.]([0-9]{1,2})$"
_COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
_TIME = r"(?i)[ T]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?\s*(?:am|pm)?$"


def _made(year: Column, month: Column, day: Column, last: str) -> Column:
    year = F.when(F.length(year) <= 2, F.concat(F.lit("20"), year)).otherwise(year)
    date = F.concat_ws("-", year, month, day).try_cast("date")
    return F.when(year.between("2000", last), date)


def _direct(s: Column, last: str) -> Column:
    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    month = ((F.instr(F.lit(_MONTHS), F.lower(part(_NAMED, 2))) + 2) / 3).cast("int").cast("string")
    tries = [(_DAY_FIRST, 3, part(_DAY_FIRST, 2), 1), (_NAMED, 3, month, 1), (_ISO, 1, part(_ISO, 2), 3), (_COMPACT, 1, part(_COMPACT, 2), 3)]
    return F.coalesce(*[F.when(s.rlike(p), _made(part(p, y), m, part(p, d), last)) for p, y, m, d in tries])


def parse_date(raw: Column, last: str = "2099") -> Column:
    """A statement's date text as DATE of a year up to ``last``: as it stands, without a time, then with look-alike letters read as digits."""
    tries = let(F.regexp_replace(F.trim(raw), r"\s+", " "), lambda s: F.array(s, F.trim(F.regexp_replace(s, _TIME, "")), F.translate(s, "OoIlSB", "001158")))
    # A later reading is only tried where the ones before gave nothing; every form begins with a digit.
    found = F.aggregate(tries, F.lit(None).cast("date"), lambda date, s: F.when(date.isNotNull(), date).otherwise(_direct(s, last)))
    return F.when(raw.rlike(r"^\s*[0-9OoIlSB]"), found)


def excel_date(serial: Column) -> Column:
    """A sheet's serial day (36526 to 54789) as DATE."""
    return F.when(serial.between(36526, 54789), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")))


def tally_date(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd")


def fiscal_year(date: Column) -> Column:
    """First calendar year of the April-to-March year."""
    return F.year(F.add_months(date, -3)).cast("long")


def preset(name: str, today: Column) -> Column:
    """struct(first, last) of a named range of days; years run from April to March. Null for a name that isn't known."""
    fiscal = lambda back: F.make_date(fiscal_year(today).cast("int") - back, F.lit(4), F.lit(1))
    month = F.trunc(today, "month")
    ends = {"today": (today, today), "this_month": (month, F.last_day(today)), "last_month": (F.add_months(month, -1).cast("date"), F.date_sub(month, 1)),
            "current_fy": (fiscal(0), F.date_sub(fiscal(-1), 1)), "prev_fy": (fiscal(1), F.date_sub(fiscal(0), 1))}
    first, last = ends.get(name, (F.lit(None).cast("date"),) * 2)
    return F.struct(first.alias("first"), last.alias("last"))
