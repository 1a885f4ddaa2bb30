"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Fitting (a bounded number of labelled rows, whole texts): near copies in the sample are dropped; words,
their prefixes and suffixes become features if toxic documents hold them far more often than
others, by a likelihood-ratio test. Words of toxic documents that carry such a feature are the
tokens labelled toxic, all others are not, and a two-state chain is fitted to these tokens by
regularised likelihood. The document score is a logistic regression on what the marginals add up
to. Texts are read by tasks only; the driver gets counts, segments as numbers, and sums.

Scoring (executors, whole texts): the scores of a word depend on the word alone, and all words
without a feature score alike, so the forward and backward passes cross a run of such words by a
power of one matrix. The marginals are those of the full passes over every word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, row_key, runs
from plumbline.llm.decontaminate import Grams
from plumbline.llm.words import ALNUM, mix
from plumbline.plans.shared import drop, materialize

#: The most labelled rows that are fitted to, of texts of any length; and the parts they are dealt to.
TRAIN_ROWS, TRAIN_PARTS = 8_000, 32
#: Score from which on a document is predicted toxic.
THRESHOLD = 0.3
#: A feature's least likelihood ratio statistic, over twice the log of the candidates; and how many times as common it is in toxic documents.
LEAST_RATIO, LEAST_LIFT = 4.0, 4.0
#: Words in a training segment.
SEGMENT = 32
#: Words beyond this many characters are named by a hash of theirs.
NAMED = 40
#: Words whose scores a worker remembers.
REMEMBER = 1 << 18

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    """A-Z to a-z and nothing else, so offsets stay."""
    return text.encode().lower().decode()


def features(word: str) -> list[str]:
    out = [f"w:{word}" if len(word) <= NAMED else f"h:{xxhash.xxh64_hexdigest(word.encode())}"]
    out += [f"p{n}:{word[:n]}" for n in (4, 5, 6) if len(word) > n]
    return out + [f"s{n}:{word[-n:]}" for n in (4, 5) if len(word) > n]


@dataclass
class Model:
    """weights: of features for the toxic state; step: log transitions [from][to] of states 0 (plain), 1 (toxic)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    step: tuple = ((0.0, 0.0), (0.0, 0.0))
    coef: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        """What the word's features add to the toxic state; 0 if it has none."""
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def score(self, mass: float, most: float) -> float:
        z = self.coef[0] + self.coef[1] * mass + self.coef[2] * most
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Chain:
    """Marginals of a model over a text, of which only the words with features are named."""

    def __init__(self, model: Model):
        self.step = np.exp(np.array(model.step))
        self.plain = self.step * np.array([1.0, math.exp(model.bias)])  # to a word without features
        self.bias = model.bias
        self.powers = {0: np.eye(2)}

    def over(self, n: int) -> np.ndarray:
        """The normalised product of n plain steps."""
        if n not in self.powers:
            half = self.over(n // 2)
            out = half @ half
            out = out @ self.plain if n % 2 else out
            out = out / out.sum()
            if len(self.powers) > 4096:
                return out
            self.powers[n] = out
        return self.powers[n]

    def marginals(self, at: list[int], emission: list[float], n: int) -> list[float]:
        """Probability of the toxic state at the words `at` (rising places among n), of these emissions."""
        forward, alpha, before = [], np.array([1.0, 1.0]), -1
        for k, (place, e) in enumerate(zip(at, emission, strict=True)):
            e = np.array([1.0, math.exp(min(60.0, self.bias + e))])
            if before < 0:  # the first word has no step into it
                alpha = e if place == 0 else (np.array([1.0, math.exp(self.bias)]) @ self.over(place - 1)) @ self.step * e
            else:
                alpha = (alpha @ self.over(place - before - 1)) @ self.step * e
            alpha = alpha / alpha.sum()
            forward.append(alpha)
            before = place
        out, beta, after = [0.0] * len(at), np.ones(2), n
        for k in range(len(at) - 1, -1, -1):
            if after == n:
                beta = self.over(n - 1 - at[k]) @ np.ones(2)
            else:
                e = np.array([1.0, math.exp(min(60.0, self.bias + emission[k + 1]))])
                beta = self.over(after - at[k] - 1) @ (self.step @ (e * beta))
            beta = beta / beta.sum()
            both = forward[k] * beta
            out[k] = float(both[1] / both.sum())
            after = at[k]
        return out


class Scorer:
    """A model applied to texts; remembers words' scores."""

    def __init__(self, model: Model):
        self.model, self.chain, self.known = model, Chain(model), {}

    def tagged(self, text: str) -> tuple[list[int], list[float], int]:
        """(places of words with features, their marginals, words)."""
        words = _WORD.findall(lower(text))
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self.model.emission(word)
        scores = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        at = np.flatnonzero(scores)
        if not len(at):
            return [], [], len(words)
        places = at.tolist()
        return places, self.chain.marginals(places, scores[at].tolist(), len(words)), len(words)

    def document(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """(score, [begin, end) character offsets of the words tagged toxic)."""
        places, marginal, _ = self.tagged(text)
        mass, most = summed(marginal)
        toxic = {p for p, m in zip(places, marginal, strict=True) if m >= 0.5}
        spans = [m.span() for k, m in enumerate(_WORD.finditer(lower(text))) if k in toxic] if toxic else []
        return self.model.score(mass, most), spans


def summed(marginal: list[float]) -> tuple[float, float]:
    """What a document's score rests on: -log of the chance of no toxic word (at most 20), and the largest marginal."""
    return min(20.0, sum(-math.log(max(1e-9, 1 - m)) for m in marginal)), max(marginal, default=0.0)


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, least): 8 minima of the hashes of each text's 5-word shingles; none for a text of fewer words."""
    for batch in runs(batches):
        w = Grams(batch.column(1), ALNUM)
        grams, out = w.grams(5), []
        for a, b in zip(w.first.tolist(), w.first[1:].tolist(), strict=False):
            own = grams[a : b - 4] if b - a >= 5 else grams[:0]
            out.append([int(mix(own ^ np.uint64(0x9E37 * (s + 1))).min().view(np.int64)) for s in range(8)] if len(own) else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "toxic", "least"])


def _apart(rows: list[tuple[int, int, list[int]]]) -> dict[int, int]:
    """{doc_id: toxic} without the near copies of earlier texts: those that share 3 of the 8 minima."""
    seen: list[dict] = [{} for _ in range(8)]
    out = {}
    for doc_id, toxic, least in sorted(rows):
        like = Counter(seen[s][m] for s, m in enumerate(least) if m in seen[s])
        if not like or max(like.values()) < 3:
            out[doc_id] = int(toxic)
            for s, m in enumerate(least):
                seen[s][m] = doc_id
    return out


def _ratio(a: int, b: int, n1: int, n0: int) -> float:
    """Likelihood-ratio statistic of a feature in a of n1 toxic and b of n0 other documents."""
    term = lambda x, n, p: (x * math.log(p) if x else 0.0) + ((n - x) * math.log(1 - p) if n - x else 0.0)
    p = (a + b) / (n1 + n0)
    return 2 * (term(a, n1, a / n1) + term(b, n0, b / n0) - term(a, n1, p) - term(b, n0, p))


def _each(batches: Iterator[pa.RecordBatch], keep: dict[int, int]) -> Iterator[list[tuple[list[str], int]]]:
    """(words, label) of the kept rows of (doc_id, text), some rows at a time."""
    for batch in runs(batches):
        once: dict[str, str] = {}  # one string for all occurrences of a word
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        yield [([once.setdefault(w, w) for w in _WORD.findall(lower(t))], keep[i]) for i, t in zip(ids, texts, strict=True) if i in keep]


def _feature_counts(batches: Iterator[pa.RecordBatch], keep: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """(f, a, b): in how many toxic and how many other documents a feature stands."""
    for docs in _each(batches, keep):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for words, y in docs:
            counts[y].update({f for w in set(words) for f in features(w)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[y][f] for f in names], pa.int64()) for y in (1, 0))], ["f", "a", "b"])


def _surroundings(batches: Iterator[pa.RecordBatch], keep: dict[int, int], strong: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """(f, before, after): the neighbours of words with strong features in toxic documents."""
    for docs in _each(batches, keep):
        around = set()
        for words, y in docs:
            for k, word in enumerate(words if y else ()):
                around |= {(f, words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else "") for f in features(word) if f in strong}
        cols = list(zip(*around, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["f", "before", "after"])


def _choose(sample: DataFrame, keep: dict[int, int]) -> list[str]:
    """The features that a likelihood-ratio test finds in toxic documents far more often than in others."""
    n1 = sum(keep.values())
    n0 = len(keep) - n1
    counts = bounded(sample).mapInArrow(lambda b: _feature_counts(b, keep), "f string, a long, b long")
    counts = materialize(counts.groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 3"), "features")
    # the more candidates, the further the best would go by chance alone
    least = LEAST_RATIO + 2 * math.log(max(1, counts.count()))
    lifted = counts.where(F.col("a") / n1 > LEAST_LIFT * (F.col("b") + 0.5) / n0).collect()
    strong = {r["f"]: (r["a"], r["b"]) for r in lifted if _ratio(r["a"], r["b"], n1, n0) >= least}
    if not strong:
        return []
    # a passage that toxic documents share brings its words along, always between the same neighbours
    names = frozenset(strong)
    around = bounded(sample).mapInArrow(lambda b: _surroundings(b, keep, names), "f string, before string, after string")
    around = {r["f"]: r["count"] for r in around.distinct().groupBy("f").count().collect()}
    out = []
    for f, (a, b) in strong.items():
        a = min(a, around.get(f, 0))
        if a / n1 > LEAST_LIFT * (b + 0.5) / n0 and _ratio(a, b, n1, n0) >= least:
            out.append(f)
    return sorted(out)


def _pieces(batches: Iterator[pa.RecordBatch], keep: dict[int, int], number: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(toxic, length, at, feature, n): segments as places 6 * word + k of features; those without any, which
    differ in length alone, as their number."""
    for docs in _each(batches, keep):
        found: Counter = Counter()
        for words, y in docs:
            got = [[number[f] for f in features(w) if f in number] for w in words]
            if y and not any(got):
                continue  # labelled toxic for something no feature names: its tokens have no label
            for k in range(0, len(words), SEGMENT):
                part = got[k : k + SEGMENT]
                at = tuple(6 * j + i for j, fs in enumerate(part) for i in range(len(fs)))
                found[y if at else 0, len(part), at, tuple(f for fs in part for f in fs)] += 1
        cols = list(zip(*found, strict=True)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(list(found.values()), pa.int64())], ["toxic", "length", "at", "feature", "n"])


def _segments(sample: DataFrame, keep: dict[int, int], names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features [segment, word, 6], labels, lengths, weights of segments); features are -1 where there are none."""
    number = {f: i for i, f in enumerate(names)}
    rows = bounded(sample).mapInArrow(lambda b: _pieces(b, keep, number), "toxic int, length int, at array<int>, feature array<int>, n long")
    rows = rows.groupBy("toxic", "length", "at", "feature").agg(F.sum("n").alias("n")).orderBy("toxic", "length", "at", "feature").collect()
    feats = np.full((len(rows), SEGMENT * 6), -1, np.int32)
    for i, r in enumerate(rows):
        feats[i, r["at"]] = r["feature"]
    feats = feats.reshape(len(rows), SEGMENT, 6)
    toxic = np.array([r["toxic"] for r in rows])
    marks = ((feats >= 0).any(axis=2) & (toxic == 1)[:, None]).astype(np.int8)
    return feats, marks, np.array([r["length"] for r in rows]), np.array([r["n"] for r in rows], float)


def fit_chain(feats, marks, lengths, weight, n_features: int, rounds: int = 120, ridge: float = 1.0) -> tuple[np.ndarray, float, np.ndarray]:
    """(feature weights, bias, log transitions) that maximise the segments' likelihood, by Adam on the whole sample."""
    theta = np.zeros(n_features + 5)
    theta[n_features] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total, used = weight.sum(), feats >= 0
    inside = np.arange(SEGMENT) < lengths[:, None]
    rows = np.arange(len(lengths))
    for t in range(1, rounds + 1):
        w, bias, step = theta[:n_features], theta[n_features], theta[n_features + 1 :].reshape(2, 2)
        lifted = np.append(w, 0.0)[feats].sum(axis=2) + bias
        e = np.stack((np.zeros_like(lifted), lifted), axis=2)
        alpha = np.empty_like(e)
        alpha[:, 0] = e[:, 0]
        for j in range(1, SEGMENT):
            alpha[:, j] = np.logaddexp(alpha[:, j - 1, :1] + step[0], alpha[:, j - 1, 1:] + step[1]) + e[:, j]
        beta = np.zeros_like(e)
        for j in range(SEGMENT - 2, -1, -1):
            x = e[:, j + 1] + beta[:, j + 1]
            beta[:, j] = np.where((j + 1 < lengths)[:, None], np.logaddexp(x[:, :1] + step[:, 0], x[:, 1:] + step[:, 1]), 0.0)
        z = np.logaddexp(*alpha[rows, lengths - 1].T)
        marginal = np.exp(np.clip(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], -50, 0)) * inside
        off = (marks - marginal) * inside * weight[:, None]
        grad = np.zeros_like(theta)
        grad[:n_features] = np.bincount(feats[used], (np.repeat(off[:, :, None], feats.shape[2], axis=2))[used], n_features)[:n_features]
        grad[n_features] = off.sum()
        both = inside[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                expected = np.exp(np.clip(alpha[:, :-1, a] + step[a, b] + e[:, 1:, b] + beta[:, 1:, b] - z[:, None], -50, 0)) * both
                seen = (marks[:, :-1] == a) & (marks[:, 1:] == b) & both
                grad[n_features + 1 + 2 * a + b] = ((seen - expected) * weight[:, None]).sum()
        grad -= ridge * theta
        grad /= total
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta += 0.2 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    step = theta[n_features + 1 :].reshape(2, 2)
    return theta[:n_features], float(theta[n_features]), step


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float, float]:
    """Newton's method for (intercept, two slopes, neither below zero)."""
    x = np.column_stack((np.ones(len(x)), x))
    theta = np.zeros(3)
    pull = np.array([1e-3, ridge, ridge])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        theta = theta + np.linalg.solve(hess, x.T @ (y - p) - pull * theta)
    return float(theta[0]), max(0.0, float(theta[1])), max(0.0, float(theta[2]))


def _sums(batches: Iterator[pa.RecordBatch], keep: dict[int, int], model: Model) -> Iterator[pa.RecordBatch]:
    """(toxic, mass, most) of the kept rows."""
    scorer = Scorer(model)
    for batch in runs(batches):
        rows = [(keep[i], *summed(scorer.tagged(t)[1])) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if i in keep]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.float64(), pa.float64()), strict=True)], ["toxic", "mass", "most"])


def fit(sample: DataFrame) -> Model:
    """A model from labelled texts (doc_id, text, toxic), at most some thousand rows, of distinct ids and no nulls.
    Without texts of both labels, every text scores the share of toxic ones."""
    keep = _apart([tuple(r) for r in bounded(sample).mapInArrow(_minima, "doc_id long, toxic int, least array<long>").collect()])  # 8 numbers a row
    toxic = sum(keep.values())
    share = (toxic + 0.5) / (len(keep) + 1)
    base = math.log(share / (1 - share)) if keep else -3.0
    if not 0 < toxic < len(keep) or not (names := _choose(sample, keep)):
        return Model(coef=(base, 0.0, 0.0))
    feats, marks, lengths, weight = _segments(sample, keep, names)
    w, bias, step = fit_chain(feats, marks, lengths, weight, len(names))
    model = Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, bias, tuple(map(tuple, step.tolist())))
    sums = np.array(sorted(map(tuple, bounded(sample).mapInArrow(lambda b: _sums(b, keep, model), "toxic int, mass double, most double").collect())))
    model.coef = _logistic(sums[:, 1:], sums[:, 0])
    return model


def _remainder(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from at most `rows` labelled documents, of any length.

    Held-out rows (crc32 of the id mod 4 is 2), null ids, texts and labels, and ids of contradicting
    labels are left out; the sample is the rows first in order of a hash of the id. Of texts
    repeated under one id the least counts.
    Sets the session's rows of an Arrow batch (`common.bounded`).
    """
    agreed = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    agreed = agreed.where(_remainder(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    drawn = agreed.select("doc_id", "toxic").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(rows)  # a bounded sample
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")
    sample = materialize(sample.repartition(TRAIN_PARTS), "labelled")
    model = fit(sample)
    drop(sample)
    return model


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model.value)
    spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    for batch in runs(batches):
        found = [scorer.document(t or "") for t in batch.column(1).to_pylist()]
        scores = pa.array([f[0] for f in found], pa.float64())
        marked = pa.array([[{"begin": a, "end": b} for a, b in f[1]] for f in found], spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), scores, marked], ["doc_id", "k1", "k2", "score", "spans"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, held_out, score, predicted, spans, k1, k2.

    score: 0 to 1, from the text alone; null and empty texts get the score of a text without toxic
    words. predicted: 1 if score >= threshold. spans: [begin, end) character offsets of the words
    tagged toxic. held_out: crc32 of the id as text mod 4 is 2 (a null id is never trained on:
    true). Equal texts get equal scores. Other columns are ignored; an empty table is allowed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features that passed a test on a bounded sample
    k1, k2 = row_key("doc_id", "text")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    out = bounded(slim).mapInArrow(lambda b: _scored(b, shared), "doc_id long, k1 long, k2 long, score double, spans array<struct<begin: int, end: int>>")
    held = F.coalesce(_remainder(F.col("doc_id")) == 2, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans", "k1", "k2")


def _civil(batches: Iterator[pa.RecordBatch], model, text: int, threshold: float) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model.value)
    for batch in runs(batches, text=text):
        kept = [scorer.model.score(*summed(scorer.tagged(t or "")[1])) < threshold for t in batch.column(text).to_pylist()]
        yield batch.filter(pa.array(kept, pa.bool_()))


def keep_civil(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that aren't predicted toxic; the columns stay as they are. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    return bounded(docs).mapInArrow(lambda b: _civil(b, shared, at, threshold), docs.schema)
