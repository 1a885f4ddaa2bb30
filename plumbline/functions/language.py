"""The language of a text by its commonest words; native, and no model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X

# --- Fixed values: frequent words that few other languages share. ---
STOP_WORDS = {
    "de": ("der", "die", "und", "das", "von", "zu", "mit", "den", "für", "ist", "nicht", "ein", "eine", "auf", "dem"),
    "en": ("the", "of", "and", "to", "is", "that", "for", "it", "with", "as", "was", "on", "are", "by", "this"),
    "es": ("el", "los", "las", "que", "por", "con", "para", "una", "del", "se", "y", "un", "es", "su", "como"),
    "fr": ("le", "les", "des", "et", "est", "dans", "pour", "une", "du", "qui", "au", "avec", "sur", "pas", "la"),
    "ha": ("da", "ba", "ya", "ta", "na", "wannan", "wani", "daga", "cikin", "kuma", "shi", "ne", "ce", "mai", "sun"),
    "it": ("il", "di", "che", "per", "non", "sono", "della", "gli", "nel", "anche", "più", "questo", "essere", "dei", "alla"),
    "nl": ("het", "een", "van", "en", "niet", "zijn", "voor", "dat", "met", "aan", "ook", "maar", "wordt", "bij", "naar"),
    "pl": ("nie", "się", "jest", "na", "to", "że", "do", "jak", "ale", "po", "dla", "tym", "od", "przez", "oraz"),
    "pt": ("os", "não", "uma", "com", "em", "do", "da", "dos", "ao", "mais", "são", "pelo", "também", "muito", "ele"),
    "sv": ("och", "att", "det", "som", "en", "på", "är", "av", "för", "inte", "till", "ett", "jag", "om", "var"),
    "tr": ("ve", "bir", "bu", "için", "ile", "çok", "daha", "gibi", "olarak", "ne", "var", "ama", "kadar", "sonra", "değil"),
    "yo": ("ni", "ti", "si", "awọn", "fun", "naa", "pe", "ninu", "lati", "wọn", "kan", "yii", "àwọn", "nínú", "láti"),
}
# --- End of fixed values. ---

LEAST_CHARS = 12


def scores(c: Column | str, languages: tuple[str, ...] | None = None) -> Column:
    """array<struct<n, lang>>: how many words of a text each language's list has; of `languages`, or all."""
    lists = {lang: STOP_WORDS[lang] for lang in languages or STOP_WORDS}
    words = F.regexp_extract_all(F.lower(X.string(c)), F.lit(r"(\p{L}+)"), 1)
    listed = F.filter(words, lambda w: w.isin(*{w for stop in lists.values() for w in stop}))

    def counts(found: Column) -> Column:
        known = lambda stop: F.size(F.filter(found, lambda w: w.isin(*stop)))
        return F.array(*[F.struct(known(stop).alias("n"), F.lit(lang).alias("lang")) for lang, stop in lists.items()])

    # the transform binds the listed words, so that a text is cut into words once
    return F.transform(F.array(listed), counts)[0]


def detect(c: Column | str, languages: tuple[str, ...] | None = None) -> Column:
    """The language with the most words (ties: the later in the alphabet); null for short texts and for none."""
    best = F.array_max(scores(c, languages))
    return F.when((F.length(X.string(c)) >= LEAST_CHARS) & (best["n"] > 0), best["lang"])


def detect_column(df: DataFrame, column: str) -> str | None:
    """The language that most values of a column are in."""
    top = df.select(detect(f"`{column}`").alias("lang")).where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").first()
    return top["lang"] if top else None
