"""Dates as people write them, and the gates on them. A partial date is YYYY, YYYY-MM or YYYY-MM-DD."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first day that is too late, and the years that count as years.
CUTOFF, FIRST_YEAR, LAST_YEAR = "2022-12-01", 1000, 2100
#: Month names, longest first, and the patterns of written dates.
MONTH = "(september|february|november|december|january|october|august|march|april|sept|june|july|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
FULL, YEAR_MONTH, YEAR = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[^0-9]|$)", r"^([0-9]{4})-([0-9]{1,2})$", r"^([0-9]{4})$"
NUMBERS = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})$"
MONTH_FIRST = rf"\b{MONTH}\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?\s*,?\s+([0-9]{{4}})\b"
DAY_FIRST = rf"\b([0-9]{{1,2}})(?:st|nd|rd|th)?\.?\s+(?:of\s+)?{MONTH}\.?\s*,?\s+([0-9]{{4}})\b"
IN_PATH = r"/((?:19|20)[0-9]{2})/(0?[1-9]|1[0-2])(?:/(0?[1-9]|[12][0-9]|3[01]))?/"
_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"


def iso_status(created: Column, cutoff: str = CUTOFF) -> Column:
    """ok, post_cutoff, undated (null or blank) or unparseable, by the first ten characters of an ISO date as written."""
    day = F.regexp_extract(F.trim(created), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    month, of_month = F.substring(day, 6, 2), F.substring(day, 9, 2)
    fits = (day != "") & month.between("01", "12") & of_month.between("01", "31")
    return F.when(F.coalesce(F.trim(created), F.lit("")) == "", "undated").when(~fits, "unparseable").when(day < cutoff, "ok").otherwise("post_cutoff")


def _whole(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD, or null if the calendar has no such day."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    known = F.try_to_date(text, "yyyy-MM-dd").isNotNull() & F.lpad(year, 4, "0").between(str(FIRST_YEAR), str(LAST_YEAR))
    return F.when(known, text)


def _months(year: Column, month: Column) -> Column:
    fits = F.lpad(month, 2, "0").between("01", "12") & year.between(str(FIRST_YEAR), str(LAST_YEAR))
    return F.when(fits, F.concat_ws("-", year, F.lpad(month, 2, "0")))


def _named(name: Column) -> Column:
    return F.floor((F.instr(F.lit(_STARTS), F.substring(name, 1, 3)) + 2) / 3).cast("string")


def parsed(value: Column, month_first: bool = False) -> Column:
    """A partial date, or null: ISO, year and month, year, month names before or after the day (the earlier match counts), and
    all-number dates only where `month_first` says how to read them."""
    s = F.lower(F.trim(value))
    part = lambda pattern: [F.regexp_extract(s, pattern, i) for i in (1, 2, 3)]
    (y, m, d), (a, b, c), (mn, md, my), (dd, dn, dy) = (part(p) for p in (FULL, NUMBERS, MONTH_FIRST, DAY_FIRST))
    months, year = [F.regexp_extract(s, YEAR_MONTH, i) for i in (1, 2)], F.regexp_extract(s, YEAR, 1)
    month_at, day_at = F.regexp_instr(s, F.lit(MONTH_FIRST)), F.regexp_instr(s, F.lit(DAY_FIRST))
    return (
        F.when(y != "", _whole(y, m, d))
        .when(months[0] != "", _months(*months))
        .when(year != "", F.when(year.between(str(FIRST_YEAR), str(LAST_YEAR)), year))
        .when(c != "", _whole(c, a, b) if month_first else F.lit(None).cast("string"))
        .when((month_at > 0) & ((day_at == 0) | (month_at < day_at)), _whole(my, _named(mn), md))
        .when(day_at > 0, _whole(dy, _named(dn), dd))
    )


def host(url: Column) -> Column:
    """The host of an address without user, port and www.; empty if there is none."""
    found = F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://([^/?#]+)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "^.*@", ""), ":.*$", ""), r"^www\.", "")


def in_url(url: Column, own_host: str | None = None) -> Column:
    """The date in a path /YYYY/MM/ or /YYYY/MM/DD/, or null; with `own_host` only on hosts that hold it."""
    y, m, d = (F.regexp_extract(url, IN_PATH, i) for i in (1, 2, 3))
    found = F.when(y != "", F.when(d != "", _whole(y, m, d)).otherwise(_months(y, m)))
    return found if own_host is None else F.when(F.contains(host(url), F.lit(own_host.lower())), found)


def gate(partial: Column, cutoff: str = CUTOFF) -> Column:
    """ok if the latest day that a partial date can mean is before the cutoff, else post_cutoff."""
    latest = F.concat(partial, F.when(F.length(partial) == 4, "-12-31").when(F.length(partial) == 7, "-31").otherwise(""))
    return F.when(latest < cutoff, "ok").otherwise("post_cutoff")


def classified(value: Column, url: Column, own_host: str | None = None, month_first: bool = False, cutoff: str = CUTOFF) -> Column:
    """struct(status, date, basis): by the value, else by the address, else undated or unparseable. A value without a digit is no date."""
    missing = ~F.coalesce(value, F.lit("")).rlike("[0-9]")
    own, path = F.when(~missing, parsed(value, month_first)), in_url(url, own_host)
    date = F.coalesce(own, path)
    status = F.when(date.isNotNull(), gate(date, cutoff)).when(missing, "undated").otherwise("unparseable")
    return F.struct(status.alias("status"), date.alias("date"), F.when(own.isNotNull(), "field").when(path.isNotNull(), "url").alias("basis"))


def post_gate(created: Column, edited: Column, cutoff: str = CUTOFF) -> Column:
    """date_gate, date_missing or edit_gate of a post, or null."""
    own, edit = iso_status(created, cutoff), iso_status(edited, cutoff)
    return F.when(own == "post_cutoff", "date_gate").when(own != "ok", "date_missing").when(~edit.isin("ok", "undated"), "edit_gate")
