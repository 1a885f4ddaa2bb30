"""Benchmark decontamination by winnowing.

Texts are words of lower-cased (A-Z) runs of letters, digits and non-ASCII characters. Over each
window of `WINDOW` consecutive words the least hash of its `GRAM`-word grams is kept (rightmost
of equals), with its place. Two texts that share a window keep the same gram at the same place in
it, so joining the kept hashes of documents and items finds every shared window. Each hit is then
extended to the item's window word by word, so a hash that agrees by chance hits nothing.
An item with fewer words than a window is one window of its own length, of which the whole is the
gram; documents keep every gram of such a length.

Hashes of a document that no item has are left out before the join by a Bloom filter of the
items' hashes. Its size is 16 MB at most; a fuller filter only lets more
hashes through to the join, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bloom import bloom, passes
from plumbline.llm.common import bounded, row_key, runs
from plumbline.llm.words import ALNUM, RUN, Words, mix
from plumbline.plans.shared import materialize

WINDOW, GRAM = 13, 8
#: Share of a document's words at which it counts as contaminated: hits * SHARE >= words.
SHARE = 20

_STEP = np.uint64(0xD6E8FEB86659FD93)


class Grams(Words):
    """Word grams of a run of texts."""

    def grams(self, size: int) -> np.ndarray:
        """Hash of the `size` words from each word on; the last size - 1 are left out."""
        n = max(0, len(self.hash) - size + 1)
        out = self.hash[:n].copy()
        for t in range(1, size):
            out *= _STEP
            out += self.hash[t : t + n]
        return mix(out + np.uint64(size))

    def whole(self, size: int) -> np.ndarray:
        """For each word that has `size - 1` words after it: do they belong to its text?"""
        n = max(0, len(self.hash) - size + 1)
        crossing = np.zeros(n + 1, np.int64)
        for cut in np.unique(self.first[1:-1]):  # windows over a border begin less than `size` words before it
            crossing[max(0, min(n, cut - size + 1))] += 1
            crossing[max(0, min(n, cut))] -= 1
        return np.cumsum(crossing[:-1]) == 0

    def kept(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window starts, place of the gram kept for each, hashes of all grams)."""
        grams = self.grams(gram)
        n = max(0, len(self.hash) - window + 1)
        best, place = grams[:n].copy(), np.arange(n)
        for t in range(1, window - gram + 1):
            other = grams[t : t + n]
            less = other <= best
            best = np.where(less, other, best)
            place[less] = np.flatnonzero(less) + t
        starts = np.flatnonzero(self.whole(window))
        return starts, place[starts], grams


def _windows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(item_id, h, rel, n, words): each window of each item and the hash kept for it."""
    for batch in runs(batches, most=RUN):
        ids, w = batch.column(0).to_pylist(), Grams(batch.column(1), ALNUM)
        starts, places, grams = w.kept(window, gram)
        owner = np.searchsorted(w.first, starts, "right") - 1
        rows = [(ids[o], int(grams[p].view(np.int64)), int(p - s), window, " ".join(w.text(s, s + window))) for o, s, p in zip(owner.tolist(), starts.tolist(), places.tolist(), strict=True)]
        for i, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist(), strict=False)):
            if 0 < b - a < window:
                rows.append((ids[i], int(w.grams(b - a)[a].view(np.int64)), 0, b - a, " ".join(w.text(a, b))))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["item_id", "h", "rel", "n", "words"])


_HITS = pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int32()), ("left", pa.int32()), ("words", pa.list_(pa.string()))]))


def _document_hits(batches: Iterator[pa.RecordBatch], bits, size: int, short: list[int], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Each document's key, word count, and kept hashes that the filter lets through, with the words around."""
    bits = bits.value
    for batch in runs(batches, most=RUN):
        w = Grams(batch.column(1), ALNUM)
        _, places, grams = w.kept(window, gram)
        found = [(gram, np.unique(places), grams)]
        found += [(n, np.flatnonzero(w.whole(n)), w.grams(n)) for n in short]
        hits: list[list] = [[] for _ in range(batch.num_rows)]
        for n, at, hashes in found:
            at = at[passes(hashes[at], bits, size)]
            reach, total = (window - gram, window) if n == gram else (0, n)
            for p, o in zip(at.tolist(), (np.searchsorted(w.first, at, "right") - 1).tolist(), strict=True):
                a, b = max(int(w.first[o]), p - reach), min(int(w.first[o + 1]), p + total)
                hits[o].append({"h": int(hashes[p].view(np.int64)), "p": p - int(w.first[o]), "left": p - a, "words": w.text(a, b)})
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(w.first), pa.int64()), pa.array(hits, _HITS)], ["doc_id", "k1", "k2", "n_words", "hits"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated, and the row's key k1, k2.

    A word is hit if it lies in an occurrence of a window of an item of `benchmark` (item_id,
    text). n_items: items with a window that occurs; items_sha256: of their ids, sorted as
    strings and joined by commas (of the empty string, if none). contaminated: n_hit > 0 and
    20 * n_hit >= n_words. Null texts have no words. Items of one repeated id are one item; items
    without an id hit words but aren't listed. Repeated rows get equal results; other columns are
    ignored; an empty table on either side is allowed.
    Sets the session's rows of an Arrow batch (`common.bounded`).
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = materialize(bounded(items).mapInArrow(lambda b: _windows(b, window, gram), "item_id long, h long, rel int, n int, words string"), "windows")
    short = [r[0] for r in windows.where(F.col("n") < window).select("n").distinct().collect()]  # fewer than `window` values
    bits, size = bloom(windows.select("h").distinct())
    shared = spark.sparkContext.broadcast(bits)
    k1, k2 = row_key("doc_id", "text")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    schema = "doc_id long, k1 long, k2 long, n_words long, hits array<struct<h: long, p: int, left: int, words: array<string>>>"
    told = materialize(bounded(slim).mapInArrow(lambda b: _document_hits(b, shared, size, short, window, gram), schema), "hits")

    w1, w2 = F.xxhash64(F.lit(17), "words"), F.xxhash64(F.lit(91), "words")
    distinct = windows.select("h", "rel", "n", "words", w1.alias("w1"), w2.alias("w2")).distinct()
    owners = windows.where("item_id is not null").select(w1.alias("w1"), w2.alias("w2"), "item_id").distinct()
    hit = told.where(F.size("hits") > 0).select("k1", "k2", F.explode("hits").alias("hit")).select("k1", "k2", "hit.h", "hit.p", "hit.left", F.col("hit.words").alias("around"))
    true = hit.join(distinct, "h").where("left >= rel and size(around) >= left - rel + n and array_join(slice(around, left - rel + 1, n), ' ') = words")
    true = materialize(true.select("k1", "k2", (F.col("p") - F.col("rel")).alias("a"), (F.col("p") - F.col("rel") + F.col("n")).alias("b"), "w1", "w2").distinct(), "true-hits")
    # the length of the union of the intervals [a, b) in order of a
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("a", "b"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["b"]).alias("upto")),
        lambda s: s["n"].cast("long"),
    )
    spans = true.groupBy("k1", "k2").agg(covered.alias("n_hit"))
    named = true.select("k1", "k2", "w1", "w2").distinct().join(owners, ["w1", "w2"]).select("k1", "k2", F.col("item_id").cast("string").alias("item")).distinct()
    lists = named.groupBy("k1", "k2").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        told.select("doc_id", "k1", "k2", "n_words")
        .join(spans.join(lists, ["k1", "k2"], "left"), ["k1", "k2"], "left")
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"), "k1", "k2")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that aren't contaminated; the columns stay as they are."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = row_key(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.join(bad, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")
