"""URL filtering by policy rules and by association rules mined from labelled URLs.

Policy rules name a host (and its subdomains) and a path prefix; the longest that fits decides.
For all other URLs, FP-growth mines combinations of URL tokens from labelled ones; those that
imply the label `block` with enough confidence and support, and that no shorter rule covers,
are matched through an inverted index: each rule is listed under its rarest token, a URL's tokens
look up the rules listed under them, and a rule fires if the URL has all of its tokens.

Rules no part of which is a rule already never hold certain tokens, and FP-growth isn't given them,
so that long query strings shared by many URLs don't make sets without end: tokens that too few
blocked URLs hold, tokens that are rules alone, tokens that all URLs hold, and all but one of
the tokens that stand in the very same URLs (any of these fits in a rule in place of that one).
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import row_key
from plumbline.plans.shared import materialize

MIN_SUPPORT, MIN_CONFIDENCE, MIN_ROWS = 0.005, 0.8, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = "label=block"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: see `judge`."""
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    known = url.isNotNull() & (at > 0)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(F.lit("")), F.when(known, path).otherwise(F.lit(""))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels from the right, path segments (digits as #), query keys, fragment."""
    labels = F.reverse(F.split(host, r"\.", -1))
    of_host = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    of_path = F.transform(F.split(path, "/", -1), lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit("="), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    of_query = F.transform(F.split(query, "&", -1), lambda x: F.concat(F.lit("q="), F.substring_index(x, "=", 1)))
    rest = F.array(F.concat(F.lit("s="), F.substring_index(url, "://", 1)), F.concat(F.lit("f="), F.regexp_extract(url, "#(.*)", 1)))
    every = F.filter(F.concat(of_host, of_path, of_query, rest), lambda x: ~x.endswith("="))
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def policy(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of `rules` (verdict, host, path prefix) that fits, else nulls.

    Ties in length go to the longer host, then to `allow`. The list is a policy written by hand; it
    is compiled into the plan.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, name, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "allow")):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """Rules (rarest, items, members, confidence, support) from rows (tokens, block): combinations of
    any number of tokens held by at least min_support of all rows and by min_rows of them, of which
    min_confidence are labelled `block`. A rule is left out if a part of it is one already.

    items: the tokens; of tokens that stand in the very same rows only the least is named, and
    members has for each item all of them, at most as many as one row has tokens. A rule fits
    tokens that hold a member of each item; rarest is the item that fewest rows hold.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rarest string, items array<string>, members array<array<string>>, confidence double, support double")
    rows = labelled.where("block is not null and tokens is not null").select(F.monotonically_increasing_id().alias("id"), F.array_distinct("tokens").alias("tokens"), "block")
    rows = materialize(rows, "labelled-urls")
    n = rows.count()
    if not n or min_rows > n:
        return empty
    support = max(min_support, min_rows / n)
    fewest = support * min_confidence * n  # blocked rows that any token of a rule stands in
    is_rule = (F.col("hits") >= min_confidence * F.col("freq")) & (F.col("freq") >= min_rows) & (F.col("freq") >= support * n)
    measures = [(F.col("hits") / F.col("freq")).alias("confidence"), (F.col("freq") / n).alias("support")]

    each = rows.select("id", "block", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count("*").alias("freq"), F.count_if("block").alias("hits"), *(F.bit_xor(F.xxhash64(F.lit(seed), "id")).alias(f"x{seed}") for seed in (3, 8)))
    alike = held.where(F.col("hits") >= fewest).groupBy("freq", "hits", "x3", "x8").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("tokens"))
    alike = materialize(alike.select("item", "tokens", "freq", "hits"), "tokens")  # at most as many as blocked tokens / fewest
    alone = alike.where(is_rule).select(F.col("item").alias("rarest"), F.array("item").alias("items"), F.array("tokens").alias("members"), *measures)
    rest = alike.where(~is_rule & (F.col("freq") < n)).select("item", "freq", F.explode("tokens").alias("token"))

    baskets = each.join(rest.select("item", "token"), "token").groupBy("id", "block").agg(F.collect_set("item").alias("items")).where(F.size("items") > 1)
    baskets = materialize(baskets.select(F.when(F.col("block"), F.concat("items", F.array(F.lit(_BLOCK)))).otherwise(F.col("items")).alias("items")), "baskets")
    m = baskets.count()
    if m < fewest:
        return materialize(alone, "rules")
    sets = FPGrowth(itemsCol="items", minSupport=max(0.0, (math.ceil(fewest - 1e-9) - 0.5) / m), minConfidence=min_confidence).fit(baskets).freqItemsets
    sets = materialize(sets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    plain = sets.where(~F.array_contains("items", _BLOCK) & (F.size("items") > 1))
    blocked = sets.where(F.array_contains("items", _BLOCK) & (F.size("items") > 2)).select(F.array_remove("items", _BLOCK).alias("items"), F.col("freq").alias("hits"))
    rules = plain.join(blocked, "items").where(is_rule).select("items", *measures)
    named = rules.select("items", F.explode("items").alias("item")).join(alike.select("item", "freq", F.col("tokens").alias("own")), "item")
    named = named.groupBy("items").agg(F.min(F.struct("freq", "item"))["item"].alias("rarest"), F.transform(F.array_sort(F.collect_list(F.struct("item", "own"))), lambda x: x["own"]).alias("members"))
    rules = materialize(rules.join(named, "items").select("rarest", "items", "members", "confidence", "support"), "wide-rules")
    parts_ = rules.select(F.col("rarest").alias("one"), F.col("items").alias("part"))
    wider = rules.where(F.size("items") > 2).select("items", F.explode("items").alias("one")).join(parts_, "one")
    wider = wider.where((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0)).select("items").distinct()
    return materialize(alone.unionByName(rules.join(wider, "items", "left_anti")), "rules")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """One row for each row of `pages` (page_id, url): page_id, host, path, rule, verdict.

    Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there
    up to `?`, `#` or the end; a null url or one without `://` has both empty. rule and verdict:
    of the longest policy rule that fits; without one, rule is null and verdict is `block` if a
    mined rule fires, else `allow`. `labels` (doc_id, quality, toxic) label the page of the same
    id: of no quality or toxic is `block`; ids of contradicting labels and null ids don't count.
    Repeated rows each give a row; other columns are ignored; empty tables are allowed.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    slim = slim.withColumns({"host": host, "path": path})
    rule, verdict = policy(rules, F.col("host"), F.col("path"))
    k1, k2 = row_key("page_id", "url")
    judged = slim.withColumns({"rule": rule, "fixed": verdict, "k1": k1, "k2": k2, "tokens": tokens(F.col("url"), F.col("host"), F.col("path"))})

    bad = ((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("block")
    named = labels.where("doc_id is not null and (quality is not null or toxic is not null)").select(F.col("doc_id").cast("long").alias("label_id"), bad)
    named = named.groupBy("label_id").agg(F.min("block").alias("block"), F.max("block").alias("other")).where("block = other").drop("other")
    mined = mine(judged.join(named, F.col("page_id") == F.col("label_id")).select("tokens", "block"))

    open_ = judged.where("fixed is null").select("k1", "k2", "tokens", F.explode("tokens").alias("token"))
    listed = mined.select(F.explode(F.get("members", F.array_position("items", F.col("rarest")).cast("int") - 1)).alias("token"), "members")
    fits = F.forall("members", lambda m: F.arrays_overlap(m, F.col("tokens")))
    fired = open_.join(listed, "token").where(fits).select("k1", "k2").distinct().withColumn("fires", F.lit(True))
    return judged.join(fired, ["k1", "k2"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("fires"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")
    )
