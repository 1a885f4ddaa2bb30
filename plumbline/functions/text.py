"""Text expressions: cleaning, missing values, keys, masks and extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: characters and tokens that decide results. ---
ZERO_WIDTH = "​‌‍﻿⁠�"
UNICODE_SPACES = "               　"
PROFILE_MISSING = ("", "na", "n/a", "#n/a", "nan", "null", "none", "[null]", "[na]", "nil", "-", "--")
TEXT_MISSING = ("", "na", "n/a", "n.a.", "#n/a", "nan", "null", "none", "nil", "-", "--", "---", ".", "?", "unknown", "unk", "not available", "not applicable", "no data", "tbd", "tba", "xxx", "n\\a")
CELL_MISSING = ("", "..", "...", "na", "n/a", "n.a.", "null", "none", "nan", "nat", "-", "--", "n\\a")
SINGLE_QUOTES, DOUBLE_QUOTES, DASHES = "‘’′", "“”″", "–—−"
EXTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?:\+?234|0)\d[\d\s\-]{7,}\d",
    "date": r"\b\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}\b",
    "longnum": r"\b\d{10,11}\b",
}
# --- End of fixed values. ---

#: White space that isn't one plain space already; single spaces needn't be replaced.
SPACE = r"[\s\x1c-\x1f\x85]{2,}|[\t\n\x0b\f\r\x1c-\x1f\x85]"


def string(c: Column | str) -> Column:
    """The value as text; null is the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", "")


def collapse(c: Column) -> Column:
    """Stripped, with runs of white space as one space."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean(c: Column | str) -> Column:
    """Null as '', zero-width characters deleted, Unicode spaces plain, trimmed and collapsed."""
    return collapse(F.translate(string(c), UNICODE_SPACES + ZERO_WIDTH, " " * len(UNICODE_SPACES)))


def plain_marks(c: Column) -> Column:
    """Typographic quotes, primes and dashes as ASCII."""
    return F.translate(c, SINGLE_QUOTES + DOUBLE_QUOTES + DASHES, "'" * 3 + '"' * 3 + "-" * 3)


def normalize_text(c: Column | str) -> Column:
    """Cleaned, with control characters as spaces and plain quotes and dashes."""
    spaced = F.regexp_replace(F.translate(string(c), UNICODE_SPACES + ZERO_WIDTH, " " * len(UNICODE_SPACES)), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return collapse(plain_marks(spaced))


def blank_missing(c: Column, tokens: tuple[str, ...] = TEXT_MISSING) -> Column:
    """'' in place of a token that stands for a missing value."""
    return F.when(F.lower(strip(c)).isin(*tokens), F.lit("")).otherwise(c)


def is_missing(c: Column | str, tokens: tuple[str, ...] = PROFILE_MISSING) -> Column:
    return F.lower(strip(string(c))).isin(*tokens)


def norm_cell(c: Column | str) -> Column:
    """Key under which two cells count as equal: lower case, collapsed, missing tokens blank."""
    key = F.lower(collapse(string(c)))
    return F.when(key.isin(*CELL_MISSING), F.lit("")).otherwise(key)


def header_key(name: str) -> str:
    """Header without case and punctuation (driver side)."""
    return "".join(ch for ch in str(name).lower() if ch.isascii() and ch.isalnum())


def key(c: Column | str) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(strip(string(c))), "[^a-z0-9]+", "")


def spaced_key(c: Column | str) -> Column:
    """Lower-case letters and digits, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(strip(string(c))), "[^a-z0-9]+", " "))


def numbers_in(c: Column) -> Column:
    """The whole numbers of a text in order, without leading zeros: the part of it that never merges."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1), lambda n: F.regexp_replace(n, r"^0+(?=\d)", ""))


def canonical_key(c: Column | str) -> Column:
    """Equal for spellings of one category: a number by its value; else lower case, & as and,
    punctuation dropped, words sorted, numbers kept in order. '' for blanks."""
    text = strip(string(c))
    bare = F.replace(text, F.lit(","), F.lit(""))
    number = F.concat(F.lit("num:"), bare.try_cast("double").cast("string"))
    lowered = F.regexp_replace(F.lower(text), r"\s*&\s*|\s+and\s+", " and ")
    words = collapse(F.regexp_replace(lowered, r"[^\p{L}\p{N}_\s]", " "))
    parts = F.split(words, " ")
    # letters sort after digits and before others as code points do
    said = F.array_join(F.array_sort(F.filter(parts, lambda w: ~w.rlike(r"^\d+$"))), "|")
    other = F.when(words == "", F.lit("")).otherwise(F.concat(said, F.lit("#"), F.array_join(numbers_in(words), ",")))
    return F.when(bare.rlike(r"^[-+]?\d+(\.\d+)?$"), number).otherwise(other)


def label(c: Column | str) -> Column:
    """A category's display form: words capitalised, `and` as &, short acronyms kept."""
    words = F.split(collapse(string(c)), " ")
    one = lambda w: (
        F.when(F.lower(w) == "and", F.lit("&")).when((w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) <= 4), w).otherwise(F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2))))
    )
    return F.array_join(F.transform(words, one), " ")


def mask(c: Column | str) -> Column:
    """Digits as 9, upper case as X, lower case as x."""
    return F.mask(string(c), F.lit("X"), F.lit("x"), F.lit("9"))


def shape(c: Column | str) -> Column:
    """What a value looks like, without the value: [n digits], [n letters], [number], [mixed], [empty]."""
    s = strip(string(c))
    size = F.length(s).cast("string")
    return (
        F.when(s == "", F.lit("[empty]"))
        .when(s.rlike(r"^\d+$"), F.concat(F.lit("["), size, F.lit(" digits]")))
        .when(s.rlike(r"^\p{L}+$"), F.concat(F.lit("["), size, F.lit(" letters]")))
        .when(s.rlike(r"^[-+]?[\d,]*\.?\d+$"), F.lit("[number]"))
        .otherwise(F.lit("[mixed]"))
    )


def pseudonym(c: Column | str) -> Column:
    """The first 12 hex digits of the SHA-256 of the trimmed value; blanks stay blank."""
    s = strip(string(c))
    return F.when(s == "", F.lit("")).otherwise(F.substr(F.sha2(s.cast("binary"), 256), F.lit(1), F.lit(12)))


def extract(c: Column | str, kind: str) -> Column:
    """All distinct e-mails, phones, dates or long numbers of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(string(c), F.lit(f"({EXTRACT[kind]})"), 1))


def export_safe(c: Column | str) -> Column:
    """Text that can't break a CSV or a sheet: no carriage returns, line feeds as spaces, no control characters."""
    s = F.replace(F.replace(string(c), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.regexp_replace(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f�]", "")


def number_text(x: Column) -> Column:
    """A double as people write it: no exponent, no trailing zeros, integers without a point."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    long = F.rtrim(F.regexp_replace(x.try_cast("decimal(38,10)").cast("string"), "0+$", ""))
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(whole, x.try_cast("bigint").cast("string"))
        .when((F.abs(x) >= 1e7) | (F.abs(x) < 1e-3), F.regexp_replace(long, r"\.$", ""))
        .otherwise(x.cast("string"))
    )


def stripped_number(c: Column | str) -> Column:
    """A number written with separators, a currency sign or %, as a double; null for anything else."""
    bare = F.regexp_replace(string(c), "[,\\s%$₦£€]", "")
    return F.when(bare.rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"), bare.try_cast("double"))
