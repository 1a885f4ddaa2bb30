"""What the columns of a table mean, inferred from all of their values.

One aggregation computes every rate of every column, without a shuffle but for the partial sums;
distinct counts are sketches (`exact` asks for exact ones, which cost a shuffle). An ordered list of
rules then decides on the driver. Only the look-up of place names needs values: all distinct ones of
a column that no earlier rule has claimed, resolved in batches and summed up by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.reference import PLACES, STATE_NAMES
from plumbline.plans.plan import Mapping, Plan
from plumbline.plans.shared import spread

# --- Fixed values: patterns and words that decide types. ---
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE = r"^(\+?234|0)[1-9]\d{8,9}$"
NUMERIC = r"^-?\d+(\.\d+)?$"
TIME = r"\d{1,2}:\d{2}"
DATEISH = r"\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}|\d{4}-\d{2}-\d{2}"
UNIT = r"(?i)^[-+]?\d[\d,.]*\s*(g|kg|mg|lb|oz|t|ha|m|cm|mm|km|l|ml|hr|hrs|hour|hours|min|mins|sec|yr|yrs)$"
MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
DATE = rf"(?i)^(\d{{1,4}}[/\-. ]\d{{1,2}}[/\-. ]\d{{1,4}}|(19|20)\d{{6}}|\d{{1,2}}(st|nd|rd|th)?[ \-]{MONTH}[ \-,]*\d{{2,4}}|{MONTH} \d{{1,2}}(st|nd|rd|th)?,? \d{{2,4}}|{MONTH},? \d{{4}}|\d{{4}}[ \-]{MONTH}[ \-]\d{{1,2}})([ T]\d{{1,2}}:\d{{2}}.*)?$"
GENDERS = ("m", "f", "male", "female", "man", "woman", "boy", "girl")
YES, NO = ("yes", "true", "y", "1"), ("no", "false", "n", "0")
DATE_WORDS = ("date", "day", "created", "closed", "resolved", "time", "dob", "birth", "start", "end", "period", "month", "year", "timestamp")
ID_HEADER = r"(?i)(^|[^a-z])(id|ids|code|no|num|number|key|acct|account|pin|serial|ref|nin|bvn)([^a-z]|$)|(id|key|code)$"
HEADER_HINTS = (
    (r"(?:^|[_\s])(lat|latitude|gpslat|lat_?dd)(?:$|[_\s0-9])", "latitude"),
    (r"(?:^|[_\s])(lon|lng|long|longitude|gpslon|gpslng|lon_?dd)(?:$|[_\s0-9])", "longitude"),
    (r"(gps|geopoint|geo_?point|geo_?location|coord|coordinate|coordinates|location|lat_?long|latlon)", "geopoint"),
)
# --- End of fixed values. ---


@dataclass
class ColumnProfile:
    column: str
    semantic_type: str
    confidence: float
    transform: str | None
    params: dict = field(default_factory=dict)
    evidence: dict = field(default_factory=dict)


def _bare(v: Column) -> Column:
    return F.regexp_replace(v, "[,$£€₦%\\s]", "")


def _coordish(v: Column) -> Column:
    words = v.rlike(r"[A-Za-z]") & v.rlike(r"(?i)[A-Z&&[^NSEW]]")
    marks = v.rlike("[°'\"]")
    plain = F.replace(v, F.lit(","), F.lit(""))
    decimal = plain.rlike(r"^[-+]?\d+(\.\d+)?$")
    in_range = F.coalesce(F.abs(F.when(decimal, plain.try_cast("double"))) <= 180.0, F.lit(False))
    dms = (marks | v.rlike(r"(?i)[NSEW]")) & v.rlike(r"^[NSEWnsew]?\s*[-+]?\d")
    return ~words & ~(F.substr(v, F.lit(2)).contains("-") & ~marks) & (in_range | (~decimal & dms))


def rates(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """One row a column: column, n, distinct, and the shares and counts that the rules read.

    The table is turned into (column, value) rows within each task and aggregated by column, so the
    plan has one set of expressions however wide the table is, and a task sends one row a column.
    """
    columns = columns or df.columns
    df = spread(df.select(*[f"`{c}`" for c in columns]))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), X.string(f"`{c}`").alias("raw")) for c in columns])
    long = df.select(F.inline(cells)).select("column", X.strip(F.col("raw")).alias("raw")).select("column", F.lower("raw").alias("low"), "raw")
    long = long.select("column", "low", F.when(~F.col("low").isin(*X.PROFILE_MISSING), F.col("raw")).alias("v"))
    long = long.select("column", F.when(F.col("v").isNotNull(), F.col("low")).alias("low"), "v", _bare(F.col("v")).alias("b"), F.regexp_replace("v", "[^0-9]", "").alias("d"), F.regexp_replace("v", "[^0-9.,]", "").alias("kept"), F.col("v").rlike(r"\p{L}").alias("lettered"))
    v, b, d, low, kept, lettered = map(F.col, ("v", "b", "d", "low", "kept", "lettered"))
    numbered = d != ""  # a cheap test in front of dear ones: And stops at the first that fails
    share = lambda test: F.coalesce(F.avg(test.cast("double")), F.lit(0.0))  # noqa: E731  null values don't count
    count = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    digits = numbered & (v == d)
    phone = F.when(v.startswith("+"), v.rlike(PHONE)).otherwise(d.rlike(PHONE)) | F.regexp_replace(v, "[ -]", "").rlike(PHONE)
    dated = numbered & ~lettered & v.rlike(r"^(\d{1,4})[./-](\d{1,2})[./-](\d{1,4})$")
    first, middle = F.regexp_extract(v, r"^(\d+)", 1), F.regexp_extract(v, r"^\d+[./-](\d+)", 1)
    commas, dots = kept.contains(","), kept.contains(".")
    return long.groupBy("column").agg(
        F.count(v).alias("n"),
        (F.count_distinct(v) if exact else F.approx_count_distinct(v, 0.01)).alias("distinct"),
        share(numbered & _coordish(v)).alias("coord"),
        share(numbered & v.rlike("[,;]")).alias("point"),
        share(v.isin("0", "1")).alias("indicator"),
        share(numbered & v.contains(":") & v.rlike(TIME) & v.rlike(DATEISH)).alias("timestamp"),
        share(numbered & lettered & v.rlike(UNIT)).alias("unit"),
        F.coalesce(F.avg(F.length(v).cast("double")), F.lit(0.0)).alias("avg_len"),
        F.coalesce(F.avg(F.size(F.split(v, r"\s+")).cast("double")), F.lit(0.0)).alias("avg_tokens"),
        share(v.contains("@") & v.rlike(EMAIL)).alias("email"),
        share(numbered & phone).alias("phone"),
        share(d != "").alias("digit"),
        share(numbered & b.rlike(NUMERIC)).alias("numeric"),
        share(numbered & b.contains(".") & b.rlike(r"^-?\d+\.\d+$")).alias("decimal"),
        share(numbered & v.rlike(r"^[A-Za-z0-9]+$")).alias("alnum"),
        share(numbered & v.rlike(DATE) & ~(v.rlike(r"^-?\d+$") & (F.length(v) <= 6))).alias("date"),
        share(lettered).alias("letters"),
        share(numbered & ~lettered & v.rlike(r"^\d{5}(\.\d+)?$")).alias("serial"),
        share(digits).alias("digits_only"),
        count(digits & v.rlike(r"^0\d")).alias("leading_zero"),
        count(digits).alias("n_digits_only"),
        F.coalesce(F.mode(F.when(digits, F.length(v))), F.lit(0)).alias("digits_len"),
        F.coalesce(F.mode(F.when(d != "", F.length(d)), True), F.lit(0)).alias("id_len"),
        (F.count_distinct(F.when(b.rlike(r"^[-+]?\d+(\.\d+)?$"), v)) if exact else F.approx_count_distinct(F.when(b.rlike(r"^[-+]?\d+(\.\d+)?$"), v), 0.01)).alias("num_distinct"),
        share(lettered & F.regexp_replace(v, "[ '-]", "").rlike(r"^\p{L}+$")).alias("alpha"),
        share(low.isin(*GENDERS)).alias("gender"),
        share(low.isin(*YES, *NO)).alias("boolean"),
        share(low.isin(*YES)).alias("yes"),
        share(low.isin(*NO)).alias("no"),
        count(dated).alias("dates"),
        count(dated & (F.length(first) == 4)).alias("ymd"),
        count(dated & (F.length(first) < 4) & (first.try_cast("int") > 12)).alias("dmy"),
        count(dated & (F.length(first) < 4) & (first.try_cast("int") <= 12) & (middle.try_cast("int") > 12)).alias("mdy"),
        count(commas & dots & (F.instr(F.reverse(kept), ",") < F.instr(F.reverse(kept), "."))).alias("both_comma"),
        count(commas & dots & (F.instr(F.reverse(kept), ",") > F.instr(F.reverse(kept), "."))).alias("both_dot"),
        count(commas & ~dots & kept.rlike(r"^\d+,\d{1,2}$")).alias("short_comma"),
        count(commas | dots).alias("separated"),
    )


def id_length_shares(df: DataFrame, lengths: dict[str, int]) -> dict[str, float]:
    """Share of a column's values with digits that have exactly so many of them."""
    if not lengths:
        return {}
    each = []
    for c, n in lengths.items():
        d = F.regexp_replace(F.when(~X.is_missing(f"`{c}`"), X.string(f"`{c}`")), "[^0-9]", "")
        each.append(F.avg(F.when(d != "", (F.length(d) == n).cast("double"))))
    return {c: x or 0.0 for c, x in zip(lengths, df.agg(*each).first(), strict=True)}


def date_order(r: dict) -> str | None:
    """DMY, MDY or YMD, if over half of the numeric dates that tell say so."""
    votes = {"YMD": r["ymd"], "DMY": r["dmy"], "MDY": r["mdy"]}
    total = sum(votes.values())
    best = max(votes, key=votes.get)
    return best if total and votes[best] / total >= 0.51 else None


def decimal_convention(r: dict) -> str:
    """comma, if values with both separators end in a comma part more often than not, or (without
    such values) over half of those with a separator have one comma before one or two digits."""
    if r["both_comma"] + r["both_dot"]:
        return "comma" if r["both_comma"] > r["both_dot"] else "dot"
    return "comma" if r["separated"] >= 3 and r["short_comma"] / r["separated"] >= 0.51 else "dot"


def _hint(name: str) -> str | None:
    return next((kind for pattern, kind in HEADER_HINTS if re.search(pattern, name.lower())), None)


def decide(r: dict, consistency: float, geo: dict[str, float] | None) -> ColumnProfile | None:
    """The first rule that fits; None if it hangs on the place names, which `geo` doesn't have yet."""
    name, n, d = r["column"], r["n"], r["distinct"]
    evidence = {k: round(v, 3) if isinstance(v, float) else v for k, v in r.items() if k != "column"}
    made = lambda kind, conf, transform, **params: ColumnProfile(name, kind, conf, transform, params, evidence)
    if not n:
        return made("empty", 1.0, None)
    hint = _hint(name)
    if hint in ("latitude", "longitude") and r["coord"] >= 0.6:
        return made(hint, 0.9, hint)
    if hint == "geopoint" and r["point"] >= 0.6:
        return made("geopoint", 0.9, None)
    if r["indicator"] == 1:
        return made("indicator", 1.0, None)
    if r["timestamp"] >= 0.7:
        return made("datetime", r["timestamp"], "datetime_iso", **_ordered(r))
    if r["unit"] >= 0.7:
        return made("numeric", r["unit"], "unit_numeric")
    card = d / n
    if r["email"] >= 0.7:
        return made("email", r["email"], "email")
    if r["gender"] == 1 and d <= 6:
        return made("gender", 0.95, "gender")
    if r["boolean"] == 1 and 2 <= d <= 4 and r["yes"] and r["no"]:
        return made("boolean", 0.95, "boolean")
    if r["phone"] >= 0.7 and r["letters"] < 0.1:
        return made("phone", r["phone"], "phone_ng")
    if r["serial"] >= 0.9 and any(w in name.lower() for w in DATE_WORDS):
        return made("date", 0.85, "date_iso")
    if r["digits_only"] >= 0.8 and r["leading_zero"] / max(1, r["n_digits_only"]) >= 0.3:
        return made("identifier", 0.9, "fixed_id", length=r["digits_len"])
    if r["letters"] >= 0.15 and r["alnum"] >= 0.85 and r["numeric"] < 0.85 and r["date"] < 0.5:
        return made("identifier", 0.8, "fixed_id", keep_alnum=True)
    if r["numeric"] >= 0.85 and r["decimal"] >= 0.3:
        return made("numeric", r["numeric"], "numeric", decimal=decimal_convention(r))
    if r["alnum"] >= 0.8 and card >= 0.6 and consistency >= 0.6:
        if r["id_len"] <= 4 and r["numeric"] >= 0.85 and not re.search(ID_HEADER, name):
            return made("numeric", r["numeric"], "numeric", decimal=decimal_convention(r))  # short plain numbers: ages, counts
        if r["id_len"] == 11:
            return made("identifier", 0.9, "nin")
        return made("identifier", 0.85, "fixed_id", length=r["id_len"], **({"keep_alnum": True, "length": 0} if r["letters"] >= 0.15 else {}))
    if r["date"] >= 0.8:
        return made("date", r["date"], "date_iso", **_ordered(r))
    if r["letters"] >= 0.5 and d <= 5000:
        if geo is None:
            return None
        if geo.get(name, 0.0) >= 0.6:
            return made("geo", geo[name], "resolve", gazetteer="state")
    if (r["numeric"] >= 0.55 and r["num_distinct"] >= 6 and r["decimal"] < 0.3) or r["numeric"] >= 0.85:
        return made("numeric", r["numeric"], "numeric", decimal=decimal_convention(r))
    if r["alpha"] >= 0.8 and 1 < r["avg_tokens"] <= 3 and card >= 0.5:
        return made("name", 0.75, "name")
    if (d <= 60 and card <= 0.5 and r["avg_tokens"] <= 4) or (d <= 25 and n >= 20):
        return made("categorical", 0.8, "auto_categorical")
    if r["alpha"] >= 0.8 and r["avg_tokens"] <= 3 and card >= 0.5:
        return made("name", 0.7, "name")
    return made("free_text", 0.6, "text_normalise")


def _ordered(r: dict) -> dict:
    order = date_order(r)
    return {"date_order": order} if order else {}


def place_share(df: DataFrame, columns: list[str], states: list[str] | None = None, places: dict[str, str] | None = None) -> dict[str, float]:
    """Share of the distinct values of each column that name a state or a known place."""
    from plumbline.operators.resolve import EntityResolver

    resolver = EntityResolver(states or STATE_NAMES)
    places = PLACES if places is None else places

    def known(x: str) -> bool:
        return " ".join(re.sub("[^a-z0-9]+", " ", x.lower()).split()) in places or resolver.resolve(x)[4] in ("high", "review")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[len(re.sub("[^a-z0-9]+", "", x.lower())) >= 3 for x in pdf["v"]]]  # one or two letters are near to too many names
            yield pd.DataFrame({"column": pdf["column"], "known": pd.Series([known(x) for x in pdf["v"]], pdf.index, bool)})

    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), X.strip(X.string(f"`{c}`")).alias("v")) for c in columns])
    values = spread(df.select(F.inline(cells)).where(~X.is_missing("v")).distinct())
    shares = values.mapInPandas(kernel, "column string, known boolean").groupBy("column").agg(F.avg(F.col("known").cast("double")).alias("share"))
    found = {r["column"]: r["share"] for r in shares.collect()}  # one row a column
    return {c: found.get(c, 0.0) for c in columns}


def profile(df: DataFrame, columns: list[str] | None = None, gazetteer: bool = True, exact: bool = False, states: list[str] | None = None, places: dict[str, str] | None = None) -> list[ColumnProfile]:
    """A profile for each column, in order; `states` and `places` stand in for the ones that come with the library."""
    found = [r.asDict() for r in rates(df, columns, exact).collect()]  # one row a column
    found.sort(key=lambda r: (columns or df.columns).index(r["column"]))
    unsure = {r["column"]: r["id_len"] for r in found if r["n"] and r["alnum"] >= 0.8 and r["distinct"] / r["n"] >= 0.6}
    shares = id_length_shares(df, unsure)
    first = [decide(r, shares.get(r["column"], 0.0), None if gazetteer else {}) for r in found]
    open_ = [r["column"] for r, p in zip(found, first, strict=True) if p is None]
    geo = place_share(df, open_, states, places) if open_ else {}
    return [p or decide(r, shares.get(r["column"], 0.0), geo) for r, p in zip(found, first, strict=True)]


def profile_to_plan(profiles: list[ColumnProfile], name: str = "auto", references: dict | None = None) -> Plan:
    """A plan that cleans every column whose type has a transform; targets are the columns themselves."""
    out = []
    for p in profiles:
        if not p.transform or p.semantic_type in ("indicator", "empty", "geopoint", "organization", "place"):
            continue
        params = dict(p.params)
        if p.transform == "resolve":
            reference = (references or {}).get(params.pop("gazetteer", "state"))
            params = {"reference": reference} if reference else {}
        out.append(Mapping(p.column, p.column, p.transform, params))
    return Plan(out, name)




def with_types(df: DataFrame, profiles: list[ColumnProfile]) -> DataFrame:
    """`df` with each column's semantic type and confidence in its field's metadata, where plans and writers keep it."""
    found = {p.column: {"semantic_type": p.semantic_type, "confidence": float(p.confidence)} for p in profiles}
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={**df.schema[c].metadata, **found.get(c, {})}) for c in df.columns])
