"""Cross-site line removal by the number of distinct sites a line appears on.

A line is cut at line feeds and compared without the white space around it. The sites (source) of
each line's hash go into a HyperLogLog sketch; sketches of the same line are merged by the
aggregation. A line whose estimate is `MARGIN` above the threshold is boilerplate, one as far
below isn't, and those between get an exact count of their distinct sites. Of boilerplate, the
first occurrence stays (smallest doc_id, then line) and all others go, so nothing is lost wholly.

Only hashes are shuffled to find the lines. The text moves once, to meet its removed line numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import row_key
from plumbline.plans.shared import materialize

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 5
#: Lines shorter than this many characters are never removed: only blank ones.
MIN_CHARS = 1
#: log2 of a sketch's registers: a standard error of 1.04 / sqrt(2 ** LG_K), 3.25 %.
LG_K = 10
#: Estimates this far from the threshold, over seven standard errors, are decided without a count.
MARGIN = 0.25


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, doc_id, site, line, h1, h2): every line long enough, by its hash."""
    k1, k2 = row_key("doc_id", "text")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("site"))
    keyed = slim.select("doc_id", "text", "site", k1.alias("k1"), k2.alias("k2"))  # before the lines: once a text, not once a line
    each = keyed.select("doc_id", "site", "k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    each = each.select("doc_id", "site", "k1", "k2", "line", F.btrim("raw", F.lit(" \t\r\f\x0b")).alias("raw")).where(F.length("raw") >= min_chars)
    return each.select("doc_id", "site", "k1", "k2", "line", F.xxhash64(F.lit(17), "raw").alias("h1"), F.xxhash64("raw", F.lit(91)).alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """(h1, h2, first): lines on `min_sites` or more distinct sites, and their first occurrence."""
    merged = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"),
        F.count("*").alias("n"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "line")).alias("first"),
    )
    # a line can't be on more sites than it has occurrences
    likely = materialize(merged.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites * (1 - margin))), "lines")
    sure = likely.where(F.col("sites") > min_sites * (1 + margin)).select("h1", "h2", "first")
    near = likely.where(F.col("sites") <= min_sites * (1 + margin)).select("h1", "h2", "first")
    pairs = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi"))


def remove_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` (doc_id, text, source and any other columns) with boilerplate lines cut out of `text`.

    Adds _n_lines and _n_removed. Every row stays, even if its text becomes empty. Lines left
    over are joined by line feeds again; a text that loses none is unchanged. A null text stays
    null, with no lines. Rows without a source are on no site, but lose boilerplate like others.
    Rows repeated with one doc_id and text are one document. Of a line's occurrences the first
    has the smallest doc_id (null after all others), then the smallest row key and line number.
    """
    lines = materialize(_lines(docs, min_chars), "line-hashes")  # no text; read three times
    found = boilerplate(lines, min_sites)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "line")
    gone = lines.join(found, ["h1", "h2"]).where(first != F.col("first"))
    gone = gone.groupBy("k1", "k2").agg(F.collect_set("line").alias("__gone")).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "__gone")
    k1, k2 = row_key(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    met = docs.withColumns({"__h1": k1, "__h2": k2}).join(gone, (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2")), "left")
    parts = F.split(F.col("text").cast("string"), "\n", -1)

    def left(lines: Column) -> Column:
        """What stays of the lines, in time linear in their number: a set difference of places, then one look-up each."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    # the transform binds the lines, so that the text is split once and not for every place
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.transform(F.array(parts), left)[0])
    counts = {"_n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("long"), "_n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}
    return met.withColumns(counts | {"text": text}).drop("__h1", "__h2", "__k1", "__k2", "__gone")
