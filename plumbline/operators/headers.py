"""Headers: readable names, plans proposed from headers, and predictions for a file's columns.

All but `predict_file` work on headers and profiles alone; that one counts a column's distinct values in Spark.
"""

from __future__ import annotations

import difflib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.reference import LGAS, STATE_NAMES
from plumbline.functions.text import header_key
from plumbline.operators import knowledge, resolve, vocabulary
from plumbline.operators.profile import ColumnProfile, profile

# --- Fixed values: words of headers. ---
ABBREVIATIONS = {"dob": "Date of Birth", "no": "Number", "num": "Number", "amt": "Amount", "qty": "Quantity", "addr": "Address", "tel": "Telephone", "ph": "Phone", "hh": "Household", "lga": "LGA", "id": "ID"}
ACRONYMS = {"nin", "bvn", "gps", "lga", "id", "ngo", "fct", "kyc", "atm", "pos", "sms", "url"}
SMALL = {"of", "the", "and", "in", "on", "for", "to", "a", "an", "at", "by"}
TYPE_NAMES = {"phone": "Phone Number", "email": "Email", "date": "Date", "datetime": "Date and Time", "gender": "Gender", "geo": "State", "latitude": "Latitude", "longitude": "Longitude", "geopoint": "Location", "name": "Name", "identifier": "ID", "boolean": "Yes/No", "numeric": "Number", "categorical": "Category", "free_text": "Notes"}
#: Header: (target field, transform, params).
ALIASES = {
    "nin": ("nin", "nin", {}), "ninnumber": ("nin", "nin", {}), "nationalid": ("nin", "nin", {}), "bvn": ("bvn", "fixed_id", {"length": 11}),
    "phone": ("phone", "phone_ng", {}), "phoneno": ("phone", "phone_ng", {}), "phno": ("phone", "phone_ng", {}), "gsm": ("phone", "phone_ng", {}), "mobile": ("phone", "phone_ng", {}), "telephone": ("phone", "phone_ng", {}),
    "surname": ("surname", "name", {}), "lastname": ("surname", "name", {}), "firstname": ("first_name", "name", {}), "othernames": ("other_names", "name", {}), "fullname": ("full_name", "name", {}), "name": ("full_name", "name", {}),
    "dob": ("date_of_birth", "date_iso", {"dayfirst": True}), "dateofbirth": ("date_of_birth", "date_iso", {"dayfirst": True}),
    "sex": ("sex", "gender", {}), "gender": ("sex", "gender", {}),
    "state": ("state", "state_ng", {}), "stateoforigin": ("state", "state_ng", {}), "lga": ("lga", "lga_ng", {}),
    "email": ("email", "email", {}), "emailaddress": ("email", "email", {}),
}
#: Field: words that a header of it may be.
SYNONYMS = {
    "phone": ("phone", "mobile", "gsm", "msisdn", "tel", "telephone", "phno"), "email": ("email", "mail"), "date": ("dob", "date", "birth", "birthday"), "gender": ("sex", "gender"),
    "name": ("name", "surname", "firstname", "lastname", "fullname", "othernames"), "identifier": ("id", "nin", "bvn", "code", "account", "enrollee"), "geo": ("state", "lga", "region", "province", "district", "city"),
    "numeric": ("amount", "price", "fee", "cost", "salary", "income", "balance", "score", "age", "size", "premium"), "boolean": ("active", "paid", "redeemed", "scholarship"), "latitude": ("lat", "latitude"), "longitude": ("lon", "lng", "long", "longitude"),
    "categorical": ("status", "type", "class", "plan", "tier", "crop", "programme", "category", "department"), "free_text": ("notes", "remarks", "comment", "description"),
}
FUZZY, HIGH = 0.82, 0.95
#: Field name: headers that say so.
FIELD_NAMES = {
    "NIN": ("nin", "ninnumber", "nationalid", "national id number"),
    "BVN": ("bvn", "bvnno", "bvnnumber", "bankverificationnumber"),
    "Phone (MSISDN)": ("phone", "phno", "phonenumber", "mobile", "gsm", "msisdn", "tel", "cell", "altphone"),
    "Email": ("email", "emailaddress", "mail"),
    "First Name": ("firstname", "othernames", "givenname", "forename"),
    "Last Name": ("surname", "lastname", "familyname"),
    "Full Name": ("fullname", "name"),
    "Gender": ("gender", "sex"),
    "Date of Birth": ("dob", "dateofbirth", "birthdate"),
    "State": ("state", "stateoforigin", "homestate", "facilitystate", "state of residence"),
    "LGA": ("lga", "localgovt", "localgovernment", "localgovernmentarea"),
    "Household ID": ("householdid", "hhid"),
    "Address": ("address", "residentialaddress", "homeaddress", "addr"),
}
#: Field name: (type, transform) that it stands for.
FIELD_TYPES = {
    "Phone (MSISDN)": ("phone", "phone_ng"), "NIN": ("identifier", "nin"), "BVN": ("identifier", "nin"), "Email": ("email", "email"),
    "First Name": ("name", "name"), "Last Name": ("name", "name"), "Full Name": ("name", "name"), "Gender": ("gender", "gender"),
    "Date of Birth": ("date", "date_iso"), "State": ("geo", "resolve"), "LGA": ("geo", "resolve"), "Address": ("free_text", "text_normalise"),
}
#: Type: what its values become.
STANDARDS = {
    "identifier": "digits only, fixed length (validated)", "phone": "+234XXXXXXXXXX  (E.164)", "email": "lowercase, valid address", "date": "ISO 8601  YYYY-MM-DD", "gender": "M / F", "boolean": "Yes / No",
    "geo": "official canonical value (e.g. one of 37 states, UPPERCASE)", "numeric": "number (decimal); units per field", "categorical": "one of a standardised set of categories", "name": "Title Case, trimmed", "free_text": "trimmed, whitespace-normalised",
}
SURE, PRIOR, SHOWN = 0.85, 0.8, 10
# --- End of fixed values. ---


def is_abnormal(header: str) -> bool:
    """Blank, a placeholder, a date, garbled, overlong, or mostly symbols."""
    h = str(header or "").strip()
    generic = re.fullmatch(r"(?i)(unnamed.*|column[ _]?\d+(_no_header)?|field\d*|col\d*|_c\d+|.*no_header.*)", h)
    return not h or bool(generic) or bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}.*", h)) or "�" in h or len(h) > 60 or sum(c.isalnum() for c in h) < len(h) / 2


def readable(header: str) -> str:
    """snake_case, camelCase and abbreviations as words in title case."""
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", str(header)).replace("_", " ").replace("-", " ").split()
    out = []
    for i, w in enumerate(words):
        low = w.lower().strip(".")
        out.append(low.upper() if low in ACRONYMS else ABBREVIATIONS.get(low) or (low if low in SMALL and i else w[:1].upper() + (w[1:].lower() if w.isupper() else w[1:])))
    return " ".join(out)


def propose_headers(profiles: list[ColumnProfile]) -> list[dict]:
    """{column, proposed, reason}: readable names, from the content where the header says nothing; all different."""
    out, used = [], {}
    for p in profiles:
        odd = is_abnormal(p.column)
        name = TYPE_NAMES.get(p.semantic_type, "Column") if odd else readable(p.column)
        used[name] = used.get(name, 0) + 1
        if used[name] > 1:
            name = f"{name} {used[name]}"
        out.append({"column": p.column, "proposed": name, "reason": "named from its content" if odd else "made readable" if name != p.column else "kept"})
    return out


def propose_plan(headers: list[str], aliases: dict | None = None) -> dict:
    """A plan from headers alone: {name, mappings (with confidence), unmapped}."""
    table = aliases or ALIASES
    mappings, unmapped = [], []
    for h in headers:
        k = header_key(h)
        near = [k] if k in table else difflib.get_close_matches(k, table, 1, FUZZY)
        if not near:
            unmapped.append(h)
            continue
        score = difflib.SequenceMatcher(None, k, near[0]).ratio()
        field, transform, params = table[near[0]]
        mappings.append({"source_column": h, "target_field": field, "transform": transform, "params": dict(params), "confidence": "high" if score >= HIGH else "medium"})
    return {"name": "proposed", "mappings": mappings, "unmapped": unmapped}


def predict_fields(profiles: list[ColumnProfile]) -> list[dict]:
    """{column, field, confidence, transform, question}: the header's word for a column overrides its
    values' type where that is unsure (0.85 or less)."""
    out = []
    for p in profiles:
        words = set(re.sub(r"([a-z])([A-Z])", r"\1 \2", p.column).lower().replace("_", " ").split()) | {header_key(p.column)}
        said = next((f for f, names in SYNONYMS.items() if words & set(names)), None)
        kind, conf = p.semantic_type, p.confidence
        if said and said != kind and conf <= 0.85 and kind not in ("empty", "indicator"):
            kind, conf = said, 0.8
        elif said == kind:
            conf = min(1.0, conf + 0.05)
        out.append({"column": p.column, "field": kind, "confidence": round(conf, 2), "transform": p.transform, "question": None if conf >= 0.75 else f"Is '{p.column}' a {kind} column?"})
    return out


def field_name(header: str) -> tuple[str, bool]:
    """(name, whether the header says it): one of FIELD_NAMES, else the header itself made tidy."""
    names = {header_key(h): name for name, headers in FIELD_NAMES.items() for h in headers}
    said = names.get(header_key(header))
    return said or " ".join(re.sub(r"[_.]", " ", str(header)).split()).title(), said is not None


def predict_file(df: DataFrame, corrections: knowledge.Corrections | None = None, gazetteers: dict[str, list[str]] | None = None) -> list[dict]:
    """For each column what it is taken for and what to ask about it: {column, name, type, transform, standard,
    confidence, details, questions}.

    A header that names a field decides its type where the values leave it unsure. details of places: how many
    distinct values there are, are learned from corrections, need review, stay unresolved and are in conflict, with
    SHOWN examples; of categories: the spellings and the categories that they fold into. gazetteers:
    {"state": names, "lga": names}.
    """
    corrections, lists = corrections or knowledge.Corrections(), {"state": list(STATE_NAMES), "lga": [e["canonical"] for e in LGAS], **(gazetteers or {})}
    out = []
    for p in profile(df):
        name, said = field_name(p.column)
        kind, transform, confidence = p.semantic_type, p.transform, p.confidence
        if said and name in FIELD_TYPES and FIELD_TYPES[name][0] != kind and confidence <= SURE:
            (kind, transform), confidence = FIELD_TYPES[name], max(confidence, PRIOR)
        domain = "lga" if name == "LGA" else "state"
        details = _places(df, p.column, domain, lists[domain], corrections) if kind == "geo" else _categories(df, p.column) if kind == "categorical" else {}
        if kind == "identifier":
            details = {"length": p.params.get("length", p.evidence.get("id_len"))}
        questions = ([] if said else [f"Call this field '{name}'?"]) + _questions(kind, details)
        out.append({"column": p.column, "name": name, "type": kind, "transform": transform, "standard": STANDARDS.get(kind, "standardised value"), "confidence": round(confidence, 2), "details": details, "questions": questions})
    return out


def _places(df: DataFrame, column: str, domain: str, names: list[str], corrections: knowledge.Corrections) -> dict:
    found = resolve.resolve_distinct(df, column, resolve.EntityResolver(names, memory=corrections.settled(domain))).where("trim(value) <> ''")
    told = knowledge.known(found, "value", domain, corrections.log(df.sparkSession))
    state = F.when(F.col("known_kind") == "conflict", "conflict").when(F.col("method") == "learned", "learned").otherwise(F.col("band"))
    told = told.select("value", state.alias("state"), "known_candidates").cache()
    n = {r["state"]: r["count"] for r in told.groupBy("state").count().collect()}  # five states
    some = lambda s: told.where(F.col("state") == s).orderBy("value").limit(SHOWN).collect()
    out = {"distinct": sum(n.values()), "learned": n.get("learned", 0), "needs_review": n.get("review", 0), "n_unresolved": n.get("unresolved", 0), "n_conflicts": n.get("conflict", 0)}
    out |= {"unresolved": [r["value"] for r in some("unresolved")], "conflicts": [(r["value"], list(r["known_candidates"])) for r in some("conflict")]}
    told.unpersist()
    return out


def _categories(df: DataFrame, column: str) -> dict:
    found = vocabulary.induce_vocabulary(df, column)
    n = found.agg(F.count("*"), F.count_distinct("label")).first()
    return {"spellings": n[0], "n_categories": n[1], "categories": [r[0] for r in found.select("label").distinct().orderBy("label").limit(SHOWN).collect()]}


def _questions(kind: str, d: dict) -> list[str]:
    if kind == "identifier":
        return ["Eleven digits: a NIN, a BVN, or some other identifier? Their form is the same."] if d["length"] == 11 else [f"Is this an identifier of {d['length']} digits?"]
    if kind == "geo":
        asked = [f"Of {d['distinct']} distinct values {d['learned']} are known from corrections; confirm the {d['needs_review']} that are close?"]
        asked += [f"Which places are these {d['n_unresolved']}: {', '.join(d['unresolved'])}?"] if d["n_unresolved"] else []
        return asked + [f"Which is right for {value}: {' or '.join(names)}?" for value, names in d["conflicts"]]
    if kind == "categorical":
        return [f"{d['spellings']} spellings fold into {d['n_categories']} categories ({', '.join(map(str, d['categories']))}): keep these labels?"]
    plain = {"date": "Does the day or the month come first?", "phone": "Write all numbers as +234 and flag foreign ones?", "numeric": "Is this a measure, and in which unit?", "name": "Write names in title case, and split first from last names?"}
    return [plain[kind]] if kind in plain else []
