"""Dates, numbers, coordinates, phones and e-mail addresses in cleaned text."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import number_text

# --- Fixed values. ---
EXCEL_FIRST, EXCEL_LAST, EXCEL_DAY_0 = 20000, 60000, "1899-12-30"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: Region: country code, trunk prefix, national numbers.
PHONES = {
    "NG": ("234", "0", r"[789][01]\d{8}|1\d{7}"),
    "KE": ("254", "0", r"[17]\d{8}|20\d{6,7}"),
    "GH": ("233", "0", r"[235]\d{8}"),
    "US": ("1", "1", r"[2-9]\d{2}[2-9]\d{6}"),
    "GB": ("44", "0", r"7[1-9]\d{8}|[1-3]\d{8,9}|8\d{9}"),
    "IN": ("91", "0", r"[6-9]\d{9}|[1-5]\d{9}"),
}
#: Unit: what it measures and how many base units it is.
UNITS = {
    "mg": ("mass", 1e-6), "g": ("mass", 1e-3), "kg": ("mass", 1.0), "t": ("mass", 1000.0), "lb": ("mass", 0.45359237), "oz": ("mass", 0.028349523125),
    "mm": ("length", 1e-3), "cm": ("length", 1e-2), "m": ("length", 1.0), "km": ("length", 1000.0),
    "ml": ("volume", 1e-3), "l": ("volume", 1.0), "ha": ("area", 1.0),
    "s": ("time", 1.0), "sec": ("time", 1.0), "min": ("time", 60.0), "mins": ("time", 60.0), "hr": ("time", 3600.0), "hrs": ("time", 3600.0), "hour": ("time", 3600.0), "hours": ("time", 3600.0),
    "yr": ("time", 31557600.0), "yrs": ("time", 31557600.0),
}
# --- End of fixed values. ---

#: Names an intermediate result, so that what uses it many times doesn't repeat it. A plan makes a
#: column of it; `same` repeats it.
Let = Callable[[Column], Column]


def same(c: Column) -> Column:
    return c


DATE_PART = r"(\d{1,4})[./\- ](\d{1,2})[./\- ](\d{1,4})"


def _group(s: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(s, pattern, n)


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is none (years of one to four digits)."""
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def _full_year(y: Column, latest: int) -> Column:
    """Two digits as the latest year not after `latest`."""
    near = F.concat(F.lit("20"), F.lpad(y, 2, "0"))
    return F.when(F.length(y) > 2, y).when(near.try_cast("int") <= latest, near).otherwise(F.concat(F.lit("19"), F.lpad(y, 2, "0")))


def excel_day(s: Column, let: Let = same) -> Column:
    """The date of an Excel serial number; null for other text."""
    n = let(F.when(s.rlike(r"^\d{4,5}(\.\d+)?$"), s.try_cast("double")))
    return F.when((n >= EXCEL_FIRST) & (n <= EXCEL_LAST), F.date_add(F.to_date(F.lit(EXCEL_DAY_0)), F.floor(n).cast("int")))


def parse_date(s: Column, order: str = "MDY", latest: int | None = None, let: Let = same) -> Column:
    """A date from cleaned text: numeric in `order` (DMY, MDY or YMD; the year first if it has four
    digits; day and month swapped if only that is possible), or with a month's name. Null if neither.
    """
    latest = latest or datetime.date.today().year + 1
    bare = let(F.regexp_replace(s, r"[T ]\d{1,2}:\d{2}(:\d{2})?(\.\d+)?( ?[AaPp][Mm])?(Z|[+-]\d{2}:?\d{2})?$", ""))
    numeric = let(bare.rlike(f"^{DATE_PART}$"))
    parts = let(F.when(numeric, F.split(bare, r"[./\- ]")))
    a, b, c = (parts[k] for k in range(3))
    # which of the first two is the day, if the year comes last
    day, month = (a, b) if order == "DMY" else (b, a)
    swap = let((month.try_cast("int") > 12) & (day.try_cast("int") <= 12))
    last = _day(_full_year(c, latest), F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day))
    first = _day(_full_year(a, latest), b, c)
    by_number = F.when(F.length(a) == 4, first).when((F.length(a) <= 2) & (F.length(c).isin(2, 4)), first if order == "YMD" else last)
    if order == "YMD":
        by_number = F.when(F.length(a) == 4, first).when(F.length(c) == 4, _day(c, b, a)).when(F.length(a) <= 2, first)

    words = let(F.when(~numeric, F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), r"(?<=\d)(st|nd|rd|th)\b|\b(mon|tue|wed|thu|fri|sat|sun)[a-z]*\b|[,./-]", " "), r"\s+", " "))))
    name = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
    forms = [(rf"^(\d{{1,2}}) {name} (\d{{2}}|\d{{4}})$", 1, 2, 3), (rf"^{name} (\d{{1,2}}) (\d{{2}}|\d{{4}})$", 2, 1, 3), (rf"^(\d{{4}}) {name} (\d{{1,2}})$", 3, 2, 1), (rf"^{name} (\d{{4}})$", None, 1, 2)]
    by_name = F.lit(None).cast("date")
    for pattern, d, m, y in forms:
        month_no = _month(words, pattern, m)
        found = _day(_full_year(_group(words, pattern, y), latest), month_no, _group(words, pattern, d) if d else F.lit("1"))
        by_name = F.when(words.rlike(pattern), found).otherwise(by_name)
    return let(F.when(numeric, by_number).otherwise(by_name))


def _month(words: Column, pattern: str, group: int) -> Column:
    place = F.call_function("instr", F.lit(MONTHS), _group(words, pattern, group))
    return ((place + 2) / 3).cast("int").cast("string")


def parse_time(s: Column, let: Let = same) -> Column:
    """HH:mm:ss of a text that ends in a time of day; 00:00:00 without one; null if it is impossible."""
    p = r"[T ](\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)? ?([AaPp][Mm])?(?:Z|[+-]\d{2}:?\d{2})?$"
    half = F.lower(_group(s, p, 4))
    h = let(_group(s, p, 1).try_cast("int"))
    hour = let(F.when((half == "pm") & (h < 12), h + 12).when((half == "am") & (h == 12), F.lit(0)).otherwise(h))
    second = let(F.when(_group(s, p, 3) == "", F.lit("00")).otherwise(_group(s, p, 3)))
    ok = (hour <= 23) & (_group(s, p, 2).try_cast("int") <= 59) & (second.try_cast("int") <= 59)
    return F.when(~s.rlike(p), F.lit("00:00:00")).when(ok, F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), _group(s, p, 2), second))


def parse_number(s: Column, decimal: str = "dot", let: Let = same) -> Column:
    """The number in a text as a double: currency signs and % ignored, negative by a sign or
    brackets; of two kinds of separators the last is the decimal one; see `decimal` for one kind.
    dot: one comma before one or two digits is a decimal comma, all else groups thousands.
    comma: one comma is decimal, dots group thousands.
    """
    st = F.trim(s)
    negative = (st.startswith("(") & st.endswith(")")) | st.startswith("-") | st.startswith("−")
    t = let(F.regexp_replace(st, "[^0-9.,]", ""))
    commas, dots = let(F.length(F.regexp_replace(t, "[^,]", ""))), let(F.length(F.regexp_replace(t, "[^.]", "")))
    no = lambda x, ch: F.replace(x, F.lit(ch), F.lit(""))
    comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    as_comma = F.replace(no(t, "."), F.lit(","), F.lit("."))
    both = F.when(comma_last, as_comma).otherwise(no(t, ","))
    if decimal == "comma":
        one = F.when(commas > 1, no(t, ",")).when(commas == 1, as_comma).when(dots > 0, no(t, ".")).otherwise(t)
    else:
        one = F.when((commas == 1) & t.rlike(r",\d{1,2}$"), as_comma).when(commas > 0, no(t, ",")).when(dots > 1, no(t, ".")).otherwise(t)
    bare = let(F.when((commas > 0) & (dots > 0), both).otherwise(one))
    x = let(F.when(bare.rlike(r"^(\d+\.?\d*|\.\d+)$"), bare.try_cast("double")))
    return let(F.when(negative, -F.abs(x)).otherwise(x))


def parse_degrees(s: Column, let: Let = same) -> Column:
    """Decimal degrees of a signed decimal, with or without N, S, E, W, or of degrees, minutes and seconds."""
    plain = F.replace(s, F.lit(","), F.lit(""))
    p = r"""^([NSEWnsew])?\s*([-+]?\d+(?:\.\d+)?)\s*(?:°|deg|d|\s)?\s*(?:(\d+(?:\.\d+)?)\s*(?:'|′|m|\s)\s*)?(?:(\d+(?:\.\d+)?)\s*(?:"|″|''|s)?\s*)?([NSEWnsew])?$"""
    part = lambda k: F.coalesce(_group(s, p, k).try_cast("double"), F.lit(0.0))
    size = let(F.abs(part(2)) + part(3) / 60 + part(4) / 3600)
    side = F.upper(F.concat(_group(s, p, 1), _group(s, p, 5)))
    south = side.isin("S", "W") | _group(s, p, 2).startswith("-")
    dms = F.when(s.rlike(p), F.when(south, -size).otherwise(size))
    return let(F.coalesce(F.when(plain.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double")), dms))


def e164(s: Column, region: str | None, let: Let = same) -> Column:
    """A phone number as +<country><number>; null if it isn't valid for the region or, with +, any."""
    digits = let(F.regexp_replace(s, r"[^0-9]", ""))
    world = s.rlike(r"^\s*(\+|\(\+|00)")
    full = let(F.regexp_replace(digits, "^00", ""))
    known = F.lit(False)
    out = F.lit(None).cast("string")
    for code, trunk, national in PHONES.values():
        bare = F.regexp_replace(F.substr(full, F.lit(len(code) + 1)), f"^{trunk}(?=\\d{{7}})" if trunk == "0" else "^$", "")
        out = F.when(full.startswith(code) & bare.rlike(f"^(?:{national})$"), F.concat(F.lit("+" + code), bare)).otherwise(out)
        known = known | full.startswith(code)
    anywhere = F.coalesce(out, F.when(~known & full.rlike(r"^[1-9]\d{7,14}$"), F.concat(F.lit("+"), full)))
    if region not in PHONES:
        at_home = F.lit(None).cast("string")
    else:
        code, trunk, national = PHONES[region]
        home = F.regexp_replace(digits, f"^{trunk}", "")
        away = F.regexp_replace(F.regexp_replace(digits, f"^{code}", ""), f"^{trunk}", "")
        at_home = F.when(digits.rlike(f"^{trunk}?(?:{national})$"), F.concat(F.lit("+" + code), F.when(digits.rlike(f"^(?:{national})$"), digits).otherwise(home)))
        at_home = at_home.when(digits.startswith(code) & away.rlike(f"^(?:{national})$"), F.concat(F.lit("+" + code), away))
    letters = s.rlike(r"\p{L}")
    return let(F.when(letters, F.lit(None).cast("string")).when(world, anywhere).otherwise(at_home))


def is_email(s: Column) -> Column:
    """One @, a dotted domain, no spaces, and no dots at the ends of a part or twice in a row."""
    return s.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & ~s.rlike(r"^\.|\.@|@[.-]|\.\.|[.-]$|[()<>\[\],;:\\\"]") & (F.length(s) <= 254)


def rounded(x: Column, places: int = 6) -> Column:
    """A rounded double as a decimal literal: always with a point."""
    r = F.round(x, places)
    t = number_text(r)
    return F.when(t.contains("."), t).otherwise(F.concat(t, F.lit(".0")))
