"""Columns split, merged, and dates taken apart; all native.

Pass `let` (see plumbline.plans.plan.staged) where a part of an expression is used many times.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import values as V


def _clean(c: Column | str) -> Column:
    return X.collapse(X.string(c))


def split_by_delimiter(c: Column | str, delimiter: str = ",", maxsplit: int = 1) -> list[Column]:
    """maxsplit + 1 trimmed parts; null where the value has fewer."""
    parts = F.split(_clean(c), re.escape(delimiter), maxsplit + 1)
    return [X.collapse(F.get(parts, F.lit(i))) for i in range(maxsplit + 1)]


def split_name(c: Column | str, order: str = "first_last") -> tuple[Column, Column]:
    """(first, surname): `Surname, First` by its comma, else by the first space and `order`; title case."""
    v = _clean(c)
    comma = v.contains(",")
    before, after = F.trim(F.substring_index(v, ",", 1)), F.trim(F.regexp_replace(v, "^[^,]*,", ""))
    head, tail = F.substring_index(v, " ", 1), F.when(v.contains(" "), F.regexp_replace(v, "^[^ ]* ", "")).otherwise(F.lit(""))
    first, last = (tail, head) if order == "last_first" else (head, tail)
    return title(F.when(comma, after).otherwise(first)), title(F.when(comma, before).otherwise(last))


def title(c: Column) -> Column:
    """Upper case after anything that isn't a letter, lower case after a letter."""
    words = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")


NUMBER = r"[-+]?\d[\d,.]*"


def split_number_text(c: Column | str) -> tuple[Column, Column]:
    """(text, number): the first number without its commas, and what is left."""
    v = _clean(c)
    number = F.regexp_extract(v, f"({NUMBER})", 1)
    rest = X.collapse(F.regexp_replace(v, f"^(.*?){NUMBER}", "$1 "))
    return F.when(number == "", v).otherwise(rest), F.replace(number, F.lit(","), F.lit(""))


def merge_columns(columns: list[Column | str], sep: str = " ") -> Column:
    """The non-blank values joined."""
    return F.concat_ws(sep, *[F.when(_clean(c) != "", _clean(c)) for c in columns])


def date_part(c: Column | str, part: str = "year", order: str = "MDY", let: V.Let = V.same) -> Column:
    """The year, or the month as two digits; '' for blanks and what isn't a date."""
    v = let(_clean(c))
    day = let(F.coalesce(V.excel_day(v, let), V.parse_date(v, order, None, let)))
    return F.coalesce(F.date_format(day, "yyyy" if part == "year" else "MM"), F.lit(""))


def split_geopoint(c: Column | str, let: V.Let = V.same) -> tuple[Column, Column]:
    """(latitude, longitude) as decimal text of `6.45, 3.39`, `(6.45; 3.39)`, `6.45 3.39`; '' where there are none."""
    v = F.regexp_replace(_clean(c), r"^[()\[\] ]+|[()\[\] ]+$", "")
    parts = let(F.filter(F.split(v, r"[;,]|\s+"), lambda p: p != ""))
    n = let(F.size(parts))
    half = F.floor(n / 2).cast("int")

    def one(p: Column) -> Column:
        return F.when(n >= 2, F.coalesce(V.rounded(V.parse_degrees(let(p), let)), F.lit(""))).otherwise(F.lit(""))

    return one(F.array_join(F.slice(parts, F.lit(1), F.greatest(half, F.lit(1))), " ")), one(F.array_join(F.slice(parts, F.greatest(half, F.lit(1)) + 1, F.greatest(n, F.lit(1))), " "))
