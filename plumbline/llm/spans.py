"""Substring dedup by sliding sentence spans.

Sentences end at a word that ends in . ! or ? (closing quotes and brackets may follow), at a line
feed, or with the text. A sentence of over `LONG` words is cut further after each word whose hash
is a multiple of `CUT`, so that a passage inside it is cut alike wherever it stands; with `window`,
after the word of the least hash in every `window` words of the text (of equals the last).

From every sentence on, the shortest run of at least `SENTENCES` sentences and `WORDS` words is
hashed (a sentence that has so many words and no place to cut it is one alone); the runs of all texts are joined on their hashes. The first occurrence of a repeated run
(smallest doc_id, then place) stays; the sentences of every other occurrence are removed. A
passage of over 50 words thus goes from every text but the first, apart from what of its outermost
sentences is joined to other text.

With `window`, the shortest such run that ends at each sentence counts too, so that every whole
sentence of a repeated run goes. It begins with the run that starts where it does, so only those
whose start is repeated are hashed. Runs of uncut sentences count beside those of their parts, as the words
around a passage have a say in the cuts near its ends: every repeated run of whole sentences goes. Wherever a passage of 50 words stands, `WINDOW` leaves at most
15 words before its first common cut and 14 after its last: of the 21 or more between, all are in runs.

With `whole`, repeated passages go whole and the first stays whole. What is left of a passage's outermost
sentences goes word by word, as far as up to `REACH` words on each side are those beside the first
occurrence of the run at that edge (which is found by 64 bits of its hash). An occurrence that overlaps
the first one in its own text loses only what stands behind that: of a word said a hundred times, one run
is left.

With `across`, a run that stands in one document alone isn't repeated, however often: a refrain or a
list is the document's own.

Runs are compared by 128 bits of hash of their lower-cased (A-Z) words. The first pass counts
64-bit hashes only; the second looks again at the runs whose hash is a repeated one, and groups those
by all bits. Up to `MOST_FILTERED` repeated hashes a broadcast Bloom filter spares the second pass the
other runs; beyond, where a filter of bounded size would let too much through, a semi-join does. Copies
of a text cost as many rows as they have runs, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bloom import bloom, passes
from plumbline.llm.common import bounded, row_key, runs
from plumbline.llm.words import DARK, RUN, Words, mix, powers
from plumbline.plans.shared import drop, materialize

#: A run has at least this many sentences and this many words.
SENTENCES, WORDS = 2, 20
#: Sentences of more words than LONG are cut after words whose hash is a multiple of CUT.
LONG, CUT = 12, 8
#: Words of a window of which the least is cut after: the widest that is sure of a common run in any 50 words.
WINDOW = 8

#: Words on each side of a run that are compared with those of its first occurrence: as many as can stand
#: beside the outermost common cuts of a passage, and one more.
REACH = 2 * WINDOW

#: Repeated hashes that the Bloom filter is made for: 11 of its bits for each.
MOST_FILTERED = 12_000_000

_STOP = np.isin(np.arange(256), list(b".!?"))
_CLOSING = np.isin(np.arange(256), list(b"\"')]}"))


class Runs(Words):
    """The sentences of some texts and their runs: run k covers bytes `begin[k]` to `stop[k]` of text `owner[k]`."""

    def __init__(self, texts: pa.Array, sentences: int, words: int, window: int = 0):
        super().__init__(texts, DARK)
        n = len(self.hash)
        self.owner = self.begin = self.stop = np.zeros(0, np.int64)
        self.run = self.check = self.lead = np.zeros(0, np.uint64)
        self.units, self.upto, self.a, self.z = [], [], self.owner, self.owner
        if not n:
            return
        ends = self._sentence_ends()
        lengths = np.diff(ends, prepend=-1)
        long = np.repeat(lengths > LONG, lengths)
        cut = long & (self._minima(window) if window else self.hash & np.uint64(CUT - 1) == 0)
        cut[ends] = True
        last = np.flatnonzero(cut)  # the last word of each piece
        self.units = [self._units(last), *([self._units(ends)] if window else [])]
        a, z = self._shortest(self.units[0], sentences, words, True)
        self.upto = [np.full(n, -1)]  # for each word, the last one of the shortest run that begins there
        self.upto[0][a] = z
        if window:
            b, y = self._shortest(self.units[1], sentences, words, False)
            self.upto.append(np.full(n, -1))
            self.upto[1][b] = y
            more = self.upto[0][b] != y
            a, z = np.concatenate((a, b[more])), np.concatenate((z, y[more]))
            order = np.argsort(a, kind="stable")
            a, z = a[order], z[order]
        self._place(a, z)
        self.lead = self.run

    def _units(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        head = np.concatenate(([0], last[:-1] + 1))
        return head, last, np.searchsorted(self.first, head, "right") - 1

    @staticmethod
    def _shortest(units: tuple, sentences: int, words: int, alone: bool) -> tuple[np.ndarray, np.ndarray]:
        head, last, owner = units
        k = np.arange(len(last))
        to = np.maximum(np.searchsorted(last, head + words - 1), k + sentences - 1)
        if alone:  # a long sentence that couldn't be cut is a run of its own
            to = np.where(last - head + 1 >= words, k, to)
        ok = to < len(last)
        ok[ok] = owner[to[ok]] == owner[ok]
        return head[ok], last[to[ok]]

    def _place(self, a: np.ndarray, z: np.ndarray) -> None:
        """The runs from word `a` to word `z`, sorted by `a`."""
        self.a, self.z, b = a, z, z + 1
        self.owner = np.searchsorted(self.first, a, "right") - 1
        after = np.append(self.start, len(self.raw))[b]  # up to the next word, so that white space goes along
        self.begin = self.start[a] - self.at[self.owner]
        self.stop = np.minimum(after, self.at[self.owner + 1]) - self.at[self.owner]
        self.run = self._spans(self.hash, a, b)
        self.check = self._spans(mix(self.hash ^ np.uint64(0x5BD1E9955BD1E995)), a, b)

    def with_endings(self, of: np.ndarray, sentences: int, words: int) -> None:
        """Keeps the runs `of`, and adds the shortest run that ends at each piece or sentence if it begins with one of them."""
        a, z, lead = [self.a[of]], [self.z[of]], [self.run[of]]
        for (head, last, owner), upto in zip(self.units, self.upto, strict=True):
            kept, hashes = self._leads(of, upto)
            end = np.arange(len(last))
            start = np.minimum(np.searchsorted(head, last - words + 1, "right") - 1, end - sentences + 1)
            ok = start >= 0
            ok[ok] = (owner[start[ok]] == owner[ok]) & kept[head[start[ok]]] & (upto[head[start[ok]]] < last[ok])
            begin = head[start[ok]]
            a, z, lead = [*a, begin], [*z, last[ok]], [*lead, hashes[begin]]
        a, z, lead = map(np.concatenate, (a, z, lead))
        order = np.lexsort((lead, z, a))
        a, z, lead = a[order], z[order], lead[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (z[1:] != z[:-1]) | (lead[1:] != lead[:-1])
        self._place(a[new], z[new])
        self.lead = lead[new]  # of an added run, the hash of the one that it begins with

    def _leads(self, of: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word whether one of the runs `of` goes from there to `upto`, and its hash."""
        of = of[self.z[of] == upto[self.a[of]]]
        kept, hashes = np.zeros(len(upto), bool), np.zeros(len(upto), np.uint64)
        kept[self.a[of]] = True
        hashes[self.a[of]] = self.run[of]
        return kept, hashes

    def _minima(self, window: int) -> np.ndarray:
        """Whether a word has the least hash of some `window` words of its text."""
        out = np.zeros(len(self.hash), bool)
        n = len(out) - window + 1
        if n < 1:
            return out
        least, at = self.hash[window - 1 :].copy(), np.full(n, window - 1)
        for k in range(window - 2, -1, -1):
            lower = self.hash[k : k + n] < least
            least[lower] = self.hash[k : k + n][lower]
            at[lower] = k
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        inside = text[:n] == text[window - 1 :]
        out[(np.arange(n) + at)[inside]] = True
        return out

    def _sentence_ends(self) -> np.ndarray:
        at = self.end - 1
        tail = self.raw[at]
        closing = _CLOSING[tail] & (self.end - self.start > 1)
        tail = np.where(closing, self.raw[np.maximum(at - 1, 0)], tail)
        ends = _STOP[tail]
        feeds = np.concatenate(([0], np.cumsum(self.raw == 10)))
        ends[:-1] |= feeds[self.start[1:]] > feeds[self.end[:-1]]
        ends[self.first[1:][self.first[1:] > 0] - 1] = True
        return np.flatnonzero(ends)

    @staticmethod
    def _spans(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.uint64)
        for k in range(0, len(a), RUN):
            i, j = a[k : k + RUN], b[k : k + RUN]
            low, high = int(i[0]), int(j.max())
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(hashes[low:high] * powers(high - low), out=sums[1:])
            out[k : k + RUN] = (sums[j - low] - sums[i - low]) * powers(high - low, back=True)[i - low]
        return mix(out + (b - a).astype(np.uint64))


def _hashes(batches: Iterator[pa.RecordBatch], sentences: int, words: int, window: int) -> Iterator[pa.RecordBatch]:
    """Hash of every run, once for each time it occurs."""
    for batch in runs(batches, text=0, most=RUN):
        r = Runs(batch.column(0), sentences, words, window)
        yield pa.RecordBatch.from_arrays([pa.array(r.run.view(np.int64))], ["h"])


def _candidates(batches: Iterator[pa.RecordBatch], bits, size: int, sentences: int, words: int, window: int) -> Iterator[pa.RecordBatch]:
    """The runs whose hash passes the filter (without one: all), and those that end with them."""
    bits = bits.value if bits else None
    for batch in runs(batches, most=RUN):
        r = Runs(batch.column(1), sentences, words, window)
        k = np.arange(len(r.run)) if bits is None else np.flatnonzero(passes(r.run, bits, size))
        if window:
            r.with_endings(k, sentences, words)
            k = np.arange(len(r.run))
        rows = pa.array(r.owner[k])
        found = [batch.column(i).take(rows) for i in (0, 2, 3)]
        found += [pa.array(v[k]) for v in (r.begin, r.stop, r.run.view(np.int64), r.check.view(np.int64), r.lead.view(np.int64))]
        yield pa.RecordBatch.from_arrays(found, ["doc_id", "k1", "k2", "begin", "stop", "h", "g", "lead"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text's overlapping and adjoining cuts one region, with the runs at its left (side 0) and right edge."""
    for whole in batches:
        for k in range(0, whole.num_rows, 100):
            batch = whole.slice(k, 100)
            cuts, lists = batch.column(2).flatten(), batch.column(2)
            owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            begin, stop, h = (cuts.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.lexsort((-stop, begin, owner))
            owner, begin, stop, h = owner[order], begin[order], stop[order], h[order]
            text = owner * (int(stop.max(initial=0)) + 1)
            upto = np.maximum.accumulate(text + stop)
            head = np.flatnonzero(np.concatenate(([True], (text + begin)[1:] > upto[:-1])))
            region = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(begin))))
            last = np.lexsort((begin, -stop, region))[head]
            rows = pa.array(np.concatenate((owner[head], owner[head])))
            n = np.zeros(len(head), np.int64)
            found = [np.concatenate(v) for v in ((begin[head], begin[head]), (stop[last], stop[last]), (n, n + 1), (n, begin[last]), (h[head], h[last]))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, found)], ["k1", "k2", "begin", "stop", "side", "inner", "h"])


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the words before (the nearest first) and after some runs of each text."""
    for batch in runs(batches, most=RUN):
        w = Words(batch.column(1), DARK)
        lists = batch.column(3)
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        h, begin, stop = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
        a, b = (np.searchsorted(w.start, w.at[owner] + at) for at in (begin, stop))
        rows = pa.array(owner)
        found = [pa.array(h), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(stop)]
        found += [_lists(w.hash, a - 1, np.minimum(a - w.first[owner], REACH), -1), _lists(w.hash, b, np.minimum(w.first[owner + 1] - b, REACH), 1)]
        yield pa.RecordBatch.from_arrays(found, ["h", "first_k1", "first_k2", "first_stop", "before", "after"])


def _lists(hashes: np.ndarray, start: np.ndarray, count: np.ndarray, step: int) -> pa.Array:
    ends = np.cumsum(count)
    k = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[np.repeat(start, count) + step * k].view(np.int64)))


def _extended(texts: pa.Array, cuts: list[list[dict]]) -> list[list[dict]]:
    """The cuts of each text, longer by the words in which the text goes on like the first occurrence of the run at that edge."""
    w, out = Words(texts, DARK), []
    hashes = w.hash.view(np.int64)
    for i, edges in enumerate(cuts):
        low, high, zero = int(w.first[i]), int(w.first[i + 1]), int(w.at[i])
        word = lambda at, zero=zero: int(np.searchsorted(w.start, zero + at))
        longer = []
        for c in edges:
            begin, stop, n, words = c["begin"], c["stop"], 0, c["words"] or []
            if c["side"] == 0:
                k = word(begin)
                room = k - (max(low, word(c["first_stop"])) if c["same"] else low)
                while n < min(len(words), room) and hashes[k - 1 - n] == words[n]:
                    n += 1
                begin = int(w.start[k - n]) - zero if n else begin
            else:
                k = word(stop)
                room = min(high - k, word(c["inner"]) - word(c["first_stop"])) if c["same"] else high - k
                while n < min(len(words), room) and hashes[k + n] == words[n]:
                    n += 1
                stop = (int(w.start[k + n]) if k + n < high else int(w.at[i + 1])) - zero if n else stop
            longer.append({"begin": begin, "stop": stop})
        out.append(longer)
    return out


def _without(text: str | None, cuts: list[dict] | None) -> tuple[str | None, int]:
    """`text` without the byte ranges, and how many bytes went."""
    if not cuts:
        return text, 0
    raw, out, upto, gone = text.encode(), [], 0, 0
    for a, b in sorted((c["begin"], c["stop"]) for c in cuts):
        if b > upto:
            out.append(raw[upto : max(a, upto)])
            gone += b - max(a, upto)
            upto = b
    return b"".join([*out, raw[upto:]]).decode(), gone


def _rebuilt(batches: Iterator[pa.RecordBatch], schema: pa.Schema, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches):
        cuts = batch.column(2).to_pylist()
        if whole and (cut := [i for i, c in enumerate(cuts) if c]):
            for i, c in zip(cut, _extended(batch.column(1).take(pa.array(cut)), [cuts[i] for i in cut]), strict=True):
                cuts[i] = c
        made = [_without(t, c) for t, c in zip(batch.column(1).to_pylist(), cuts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], schema=schema)


#: Lets Spark delete the shuffle files of a write when it has ended, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, label: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        return materialize(df, label)
    finally:
        conf.set(_CLEANUP, before)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeated_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, window: int = 0, across: bool = False, whole: bool = False) -> DataFrame:
    """(k1, k2, cuts): for each text with repeated runs the byte ranges `begin` to `stop` of all but their first
    occurrences. With `whole`, those of regions, once for each edge, and what `_extended` asks for."""
    spark = docs.sparkSession
    k1, k2 = row_key("doc_id", "text")
    slim = _slim(docs)
    hashes = bounded(slim.select("text")).mapInArrow(lambda b: _hashes(b, sentences, words, window), "h long")
    repeated = _written(hashes.groupBy("h").count().where("count > 1").select("h"), "repeated")
    shared, size = None, 0
    if few := repeated.count() <= MOST_FILTERED:
        bits, size = bloom(repeated)
        shared = spark.sparkContext.broadcast(bits)
    keyed = slim.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    found = bounded(keyed).mapInArrow(lambda b: _candidates(b, shared, size, sentences, words, window), "doc_id long, k1 long, k2 long, begin long, stop long, h long, g long, lead long")
    found = found if few else found.join(repeated.withColumnRenamed("h", "lead"), "lead", "left_semi")
    found = _written(found.select("doc_id", "k1", "k2", "begin", "stop", "h", "g"), "candidates")
    drop(repeated)
    # written, so that both sides of the join come from an exchange and a hot run's rows can be split
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "begin", "stop")
    # two documents differ in k1, but for a chance of 2 ** -64
    repeats = (F.min("k1") != F.max("k1")) if across else (F.count("*") > 1)
    firsts = found.groupBy("h", "g").agg(F.min(at).alias("first"), repeats.alias("repeats")).where("repeats")
    firsts = _written(firsts.select("h", "g", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("k1", "k2", "begin", "stop")]), "firsts")
    other = (F.col("k1") != F.col("first_k1")) | (F.col("k2") != F.col("first_k2"))
    later = found.join(firsts, ["h", "g"]).where(other | (F.col("begin") != F.col("first_begin")))
    if not whole:
        return later.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "stop")).alias("cuts"))
    begin = F.when(other, F.col("begin")).otherwise(F.greatest("begin", "first_stop")).alias("begin")
    later = later.select("k1", "k2", begin, "stop", "h").where("begin < stop")
    cuts = later.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "stop", "h")).alias("cuts"))
    edges = _written(bounded(cuts).mapInArrow(_edges, "k1 long, k2 long, begin long, stop long, side long, inner long, h long"), "edges")
    drop(found)
    asked = firsts.join(edges.select("h").distinct(), "h", "left_semi")
    asked = asked.groupBy(F.col("first_k1").alias("k1"), F.col("first_k2").alias("k2")).agg(F.collect_set(F.struct("h", "first_begin", "first_stop")).alias("at"))
    asked = keyed.join(asked, ["k1", "k2"]).select("k1", "text", "k2", "at")
    beside = bounded(asked).mapInArrow(_beside, "h long, first_k1 long, first_k2 long, first_stop long, before array<long>, after array<long>")
    beside = _written(beside.dropDuplicates(["h"]), "beside")
    drop(firsts)
    same = (F.col("k1") == F.col("first_k1")) & (F.col("k2") == F.col("first_k2"))
    words = F.when(F.col("side") == 0, F.col("before")).otherwise(F.col("after"))
    cut = F.struct("begin", "stop", "side", "inner", "first_stop", same.alias("same"), words.alias("words"))
    return edges.join(beside, "h", "left").groupBy("k1", "k2").agg(F.collect_set(cut).alias("cuts"))


def remove_repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, window: int = 0, across: bool = False, whole: bool = False) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, text without repeated passages, n_removed.

    n_removed: UTF-8 bytes that went. A text that loses nothing is unchanged; one that is wholly a
    repeat becomes empty (or the white space before its first word); a null text stays null. Rows
    of null doc_id come after all others. Rows repeated with one doc_id and text are one document.
    Texts without white space are one word and lose nothing. Other columns are ignored; an empty
    table gives an empty result.
    Sets the session's rows of an Arrow batch (`common.bounded`).
    """
    gone = repeated_spans(docs, sentences, words, window, across, whole)
    k1, k2 = row_key("doc_id", "text")
    met = _slim(docs).withColumns({"k1": k1, "k2": k2}).join(gone, ["k1", "k2"], "left").select("doc_id", "text", "cuts")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_removed", pa.int64())])
    return bounded(met).mapInArrow(lambda b: _rebuilt(b, schema, whole), "doc_id long, text string, n_removed long")
