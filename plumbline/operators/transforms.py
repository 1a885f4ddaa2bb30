"""The value transforms and their registry.

A transform is a function (raw, clean, let, **params) of two string columns, the value as it came
and cleaned, to (value, flagged, reason); `let` names an intermediate column. Nothing is guessed: what can't be decided is kept and
flagged with a reason. All of them are native expressions, so a plan is one projection.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import values as V
from plumbline.functions.values import Let

Parts = tuple[Column, Column, Column]
REGISTRY: dict[str, Callable[..., Parts]] = {}

# --- Fixed values. ---
GENDER = {"M": ("m", "male", "man", "1", "boy"), "F": ("f", "female", "woman", "2", "girl")}
BOOLEAN = {"Yes": ("yes", "y", "true", "1"), "No": ("no", "n", "false", "0")}
NAME_PARTICLES = ("de", "van", "von", "bin", "al", "el", "da", "di", "la")
SENTINEL_CODES = ("998", "999", "9999", "-99", "-999", "888", "-88", "9998")
SENTINEL_WORDS = ("don't know", "dont know", "refused", "no response", "not stated", "dk", "na")
STATE_SENTINELS = ("No State", "Unknown", "UNKNOWN", "State", "OTHERS")
#: Characters of Windows-1252 by the byte that Latin-1 has as a control character.
WINDOWS_1252 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
# --- End of fixed values. ---


def register(name: str, *aliases: str) -> Callable:
    """Registers a transform; the extension point for transforms of one's own."""

    def add(f: Callable[..., Parts]) -> Callable[..., Parts]:
        for n in (name, *aliases):
            REGISTRY[n] = f
        return f

    return add


def list_transforms() -> list[str]:
    return sorted([*REGISTRY, "resolve", "auto_categorical", "induce_vocabulary"])


def get_transform(name: str) -> Callable[..., Parts]:
    if name not in REGISTRY:
        raise KeyError(f"Unknown transform '{name}'. Known: {', '.join(list_transforms())}")
    return REGISTRY[name]


def pack(parts: Parts) -> Column:
    value, flagged, reason = parts
    return F.struct(value.alias("value"), F.coalesce(flagged, F.lit(False)).alias("flagged"), F.coalesce(reason, F.lit("")).alias("reason"))


def decide(*cases: tuple[Column, Column, str | Column], otherwise: tuple[Column, str | Column] | Column) -> Parts:
    """(value, flagged, reason) of the first case (condition, value, reason) that holds; a reason
    flags. `otherwise`: a value, or a value and a reason."""
    value, reason = otherwise if isinstance(otherwise, tuple) else (otherwise, "")
    reason = F.lit(reason) if isinstance(reason, str) else reason
    for test, v, r in reversed(cases):
        test = F.coalesce(test, F.lit(False))
        value = F.when(test, v).otherwise(value)
        reason = F.when(test, F.lit(r) if isinstance(r, str) else r).otherwise(reason)
    return value, reason != "", reason


def _digits(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(X.strip(raw), r"\.0$", ""), "[^0-9]", "")


@register("nin")
def nin(raw: Column, clean: Column, let: Let) -> Parts:
    d = let(_digits(raw))
    n = F.length(d)
    return decide((d == "", F.lit(""), "empty NIN"), (n != 11, d, F.format_string("NIN is %d digits, expected 11", n)), otherwise=d)


@register("fixed_id")
def fixed_id(raw: Column, clean: Column, let: Let, length: int = 0, keep_alnum: bool = False) -> Parts:
    """Digits only (letters too with keep_alnum), of `length` if that isn't 0."""
    d = let(F.regexp_replace(F.regexp_replace(X.strip(raw), r"\.0$", ""), "[^0-9A-Za-z]", "") if keep_alnum else _digits(raw))
    n, length = F.length(d), int(length or 0)
    wrong = (n != length) if length else F.lit(False)
    return decide((d == "", F.lit(""), "empty id"), (wrong, d, F.format_string(f"id is %d digits, expected {length}", n)), otherwise=d)


@register("phone")
def phone(raw: Column, clean: Column, let: Let, region: str | None = "US") -> Parts:
    found = V.e164(clean, region, let)
    return decide(
        (clean == "", F.lit(""), "empty phone"),
        (found.isNotNull(), found, ""),
        (~clean.rlike(r"\d"), raw, "could not parse phone number"),
        otherwise=(raw, "not a valid phone number"),
    )


@register("phone_ng")
def phone_ng(raw: Column, clean: Column, let: Let, region: str = "NG") -> Parts:
    return phone(raw, clean, let, region)


def _order(params: dict) -> str:
    return params.get("date_order") or ("DMY" if params.get("dayfirst") else "MDY")


@register("date_iso")
def date_iso(raw: Column, clean: Column, let: Let, min_year: int = 1900, max_year: int | None = None, **params) -> Parts:
    """ISO date; day and month by `date_order` (or dayfirst), Excel serials, impossible dates flagged."""
    latest = int(max_year or datetime.date.today().year + 1)
    serial, written = V.excel_day(clean, let), V.parse_date(clean, _order(params), latest, let)
    day = let(F.coalesce(serial, written))
    iso_like = clean.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    fits = F.year(day).between(int(min_year), latest)
    out_of = F.when(serial.isNotNull() | iso_like, F.lit("date out of range")).otherwise(F.lit("date out of plausible range"))
    return decide(
        (clean == "", F.lit(""), "empty date"),
        (day.isNull() & iso_like, raw, "impossible date (month/day out of range)"),
        (day.isNull(), raw, "could not parse date"),
        (~fits, raw, out_of),
        otherwise=F.date_format(day, "yyyy-MM-dd"),
    )


@register("datetime_iso")
def datetime_iso(raw: Column, clean: Column, let: Let, **params) -> Parts:
    day, time = V.parse_date(clean, _order(params), None, let), let(V.parse_time(clean, let))
    iso_like = clean.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{1,2}:\d{2}")
    found = F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), time)
    bad = day.isNull() | time.isNull()
    return decide(
        (clean == "", F.lit(""), "empty datetime"),
        (bad & iso_like, raw, "impossible datetime (out of range)"),
        (bad, raw, "unparseable datetime"),
        otherwise=found,
    )


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2))))


def _hyphened(w: Column) -> Column:
    return F.array_join(F.transform(F.split(w, "-", -1), _capital), "-")


@register("name")
def name(raw: Column, clean: Column, let: Let) -> Parts:
    """Capitalised words; O' and Mc names and hyphens respected, particles low within a name."""

    def word(w: Column, i: Column) -> Column:
        low = F.lower(w)
        rest = F.substr(w, F.lit(3))
        irish = F.concat(F.lit("O'"), F.when(F.lower(rest).startswith("mc") & (F.length(rest) > 2), F.concat(F.lit("Mc"), _capital(F.substr(rest, F.lit(3))))).otherwise(_hyphened(rest)))
        return (
            F.when(low.isin(*NAME_PARTICLES) & (i > 0), low)
            .when(low.startswith("o'") & (F.length(w) > 2), irish)
            .when(low.startswith("mc") & (F.length(w) > 2), F.concat(F.lit("Mc"), _capital(rest)))
            .otherwise(_hyphened(w))
        )

    return decide((clean == "", F.lit(""), "empty name"), otherwise=F.array_join(F.transform(F.split(clean, " "), word), " "))


@register("upper")
def upper(raw: Column, clean: Column, let: Let) -> Parts:
    return decide(otherwise=F.upper(clean))


def _mapped(raw: Column, clean: Column, let: Let, table: dict[str, tuple[str, ...]], empty: str, unknown: str) -> Parts:
    low = let(F.lower(clean))
    return decide((clean == "", F.lit(""), empty), *((low.isin(*variants), F.lit(to), "") for to, variants in table.items()), otherwise=(raw, unknown))


@register("gender")
def gender(raw: Column, clean: Column, let: Let) -> Parts:
    return _mapped(raw, clean, let, GENDER, "empty gender", "gender not recognised")


@register("boolean")
def boolean(raw: Column, clean: Column, let: Let) -> Parts:
    return _mapped(raw, clean, let, BOOLEAN, "empty boolean", "not a boolean")


@register("email")
def email(raw: Column, clean: Column, let: Let) -> Parts:
    return decide((clean == "", F.lit(""), "empty email"), (~V.is_email(clean), clean, "not a valid email"), otherwise=F.lower(clean))


@register("numeric")
def numeric(raw: Column, clean: Column, let: Let, decimal: str = "dot") -> Parts:
    x = V.parse_number(clean, decimal, let)
    value, flagged, reason = decide(
        (clean == "", F.lit(""), "empty numeric"),
        (~clean.rlike(r"\d"), raw, "not numeric (no digits)"),
        (x.isNull(), raw, "not numeric"),
        otherwise=X.number_text(x),
    )
    flagged = let(flagged)
    return value, flagged, F.when(~flagged & clean.endswith("%"), F.lit("read as percent value")).otherwise(reason)


@register("text_normalise")
def text_normalise(raw: Column, clean: Column, let: Let) -> Parts:
    return decide(otherwise=X.collapse(X.plain_marks(unscrambled(clean))))


@register("text_clean")
def text_clean(raw: Column, clean: Column, let: Let) -> Parts:
    return decide(otherwise=X.blank_missing(X.normalize_text(unscrambled(X.string(raw)))))


def unscrambled(c: Column) -> Column:
    """UTF-8 that was read as Windows-1252 or Latin-1 (Ã© for é) read rightly, where all of the text allows it."""
    latin = F.translate(c, "".join(WINDOWS_1252.values()), "".join(map(chr, WINDOWS_1252)))
    suspect = latin.rlike(r"[\u00C2-\u00F4][\u0080-\u00BF]") & ~latin.rlike(r"[^\x00-\xFF]")
    raw = F.encode(F.when(suspect, latin).otherwise(F.lit("")), "ISO-8859-1")
    again = F.try_validate_utf8(raw.cast("string"))
    return F.when(suspect & again.isNotNull(), again).otherwise(c)


@register("sentinel_na")
def sentinel_na(raw: Column, clean: Column, let: Let, codes: Iterable | None = None) -> Parts:
    known = [str(c).strip().lower() for c in codes] if codes else [*SENTINEL_CODES, *SENTINEL_WORDS]
    hit = F.lower(clean).isin(*known)
    return decide((clean == "", F.lit(""), ""), (hit, F.lit(""), F.concat(F.lit("refusal/DK sentinel code ('"), clean, F.lit("')"))), otherwise=clean)


@register("range_check")
def range_check(raw: Column, clean: Column, let: Let, min: float | None = None, max: float | None = None) -> Parts:
    bare = F.regexp_replace(clean, r"[,\s]", "")
    x = let(F.when(bare.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), bare.try_cast("double")))
    low = x < float(min) if min is not None else F.lit(False)
    high = x > float(max) if max is not None else F.lit(False)
    return decide(
        (clean == "", F.lit(""), ""),
        (x.isNull(), raw, "not a number (range check)"),
        (low, raw, f"below minimum {min}"),
        (high, raw, f"above maximum {max}"),
        otherwise=raw,
    )


@register("unit_numeric")
def unit_numeric(raw: Column, clean: Column, let: Let, to: str | None = None) -> Parts:
    """The number of `number unit`, converted to `to` if given."""
    pattern = r"^([-+]?\d[\d,.]*)\s*([a-zA-Zµ°%/]+)$"
    number = let(F.replace(F.regexp_extract(clean, pattern, 1), F.lit(","), F.lit("")).try_cast("double"))
    unit = let(F.regexp_extract(clean, pattern, 2))
    bare = let(F.regexp_replace(clean, r"[,\s]", ""))
    plain = let(F.when(bare.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), bare.try_cast("double")))
    cases = [(clean == "", F.lit(""), "empty"), (~clean.rlike(pattern) & plain.isNotNull(), X.number_text(plain), ""), (number.isNull(), raw, "no number found")]
    if not to:
        value, flagged, reason = decide(*cases, otherwise=X.number_text(number))
        flagged = let(flagged)
        removed = F.concat(F.lit("unit '"), unit, F.lit("' removed"))
        return value, flagged, F.when(~flagged & clean.rlike(pattern), removed).otherwise(reason)
    kind, size = V.UNITS.get(to, ("", 1.0))
    factor = F.lit(None).cast("double")
    for u, (k, n) in V.UNITS.items():
        if k == kind:
            factor = F.when(unit == u, F.lit(n / size)).otherwise(factor)
    failed = F.concat(F.lit("could not convert '"), unit, F.lit(f"' to '{to}'"))
    return decide(*cases, (factor.isNull(), V.rounded(number), failed), otherwise=V.rounded(let(number * factor), 4))


def _degrees(raw: Column, clean: Column, let: Let, what: str, most: float) -> Parts:
    d = V.parse_degrees(clean, let)
    return decide(
        (clean == "", F.lit(""), f"empty {what}"),
        (d.isNull(), raw, f"unparseable {what}"),
        (F.abs(d) > most, raw, F.concat(F.lit(f"{what} out of range ("), V.rounded(d, 10), F.lit(")"))),
        otherwise=V.rounded(d),
    )


@register("latitude")
def latitude(raw: Column, clean: Column, let: Let) -> Parts:
    return _degrees(raw, clean, let, "latitude", 90.0)


@register("longitude")
def longitude(raw: Column, clean: Column, let: Let) -> Parts:
    return _degrees(raw, clean, let, "longitude", 180.0)


def _lookup(table: dict[str, str]) -> Column:
    """A small table as a map literal."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _table(reference: str | Path | dict, key: str) -> dict:
    """A reference given as a table, or as the path of a JSON file that holds it under `key`."""
    if isinstance(reference, dict):
        return reference
    return json.loads(Path(reference).read_text(encoding="utf-8"))[key]


@register("state_ng", "state")
def state_ng(raw: Column, clean: Column, let: Let, reference: str | Path | dict | None = None, on_unrecognized: str = "flag") -> Parts:
    """A state by its names and variants: {canonical: [variant, ...]}, or a JSON file with that under `states`."""
    from plumbline.functions.reference import STATES

    table = {v: to for to, variants in _table(reference if reference is not None else STATES, "states").items() for v in variants}
    bare = let(X.collapse(F.regexp_replace(F.regexp_replace(raw, r"\(.*?\)", ""), r"[^A-Za-z\s-]", " ")))
    found = let(F.try_element_at(_lookup(table), bare))
    unknown = F.concat(F.lit("state not recognised: '"), bare, F.lit("'"))
    return decide(
        (bare.isin("", *STATE_SENTINELS), F.lit(""), "no usable state (blank or sentinel)"),
        (found.isNotNull(), found, ""),
        otherwise=(F.lit("") if on_unrecognized == "null" else raw, unknown),
    )


@register("lga_ng", "lga")
def lga_ng(raw: Column, clean: Column, let: Let, reference: str | Path | list | None = None) -> Parts:
    """A local government area by name or alias, or by the longest name that the value begins with.

    `reference`: [{canonical, aliases}], or a JSON file with that under `lgas`. The list is small,
    so the longest prefix is found by one scan of an array literal.
    """
    from plumbline.functions.reference import LGAS

    entries = LGAS if reference is None else reference if isinstance(reference, list) else _table(reference, "lgas")
    table = {}
    for e in entries:
        for v in (e["canonical"], *e["aliases"]):
            table["".join(ch for ch in v.strip().lower() if ch.isascii() and ch.isalnum())] = e["canonical"]
    k = let(X.key(raw))
    names = F.from_json(F.lit(json.dumps(sorted(table, key=len, reverse=True))), "array<string>")
    exact, first = let(F.try_element_at(_lookup(table), k)), let(F.get(F.filter(names, lambda n: F.startswith(k, n)), F.lit(0)))
    rest = F.concat(F.lit("de-concatenated; leftover '"), F.substr(k, F.length(first) + 1), F.lit("' dropped"))
    return decide(
        (k == "", F.lit(""), "empty LGA"),
        (exact.isNotNull(), exact, ""),
        (first.isNotNull(), F.try_element_at(_lookup(table), first), rest),
        otherwise=(raw, "LGA not recognised"),
    )
