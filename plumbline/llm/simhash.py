"""SimHash near-duplicates: fingerprints linked by a self-join of a binary trie.

Fingerprint: A-Z lower-cased, words split at ASCII white space, `width`-word shingles (fewer
words: the whole sequence), XXH64 of each with seed 42; a bit is 1 if it is set in over half.

Linking at `budget` or fewer differing bits: the 64 bits are cut into budget + 2 blocks, so a
linked pair agrees wholly in two of them at least. For each pair of blocks the fingerprints are
rearranged to begin with these two, and a binary trie of them is joined with itself: pairs of nodes
are followed down together, differing bits are added up, and a pair is dropped once it exceeds its
budget, which is zero inside the leading blocks and `budget` below them. Only distinct fingerprints
take part (copies share one), and each task returns a spanning forest of the links it found, not
the links. Components of these forests are the classes.

A trie is dealt out by its leading bits, more of them the more fingerprints there are: at a budget
of 4 up to 21, so 10 ** 10 fingerprints make groups of about 5,000. A group beyond `group_rows`, which
only a crowd of like fingerprints makes, is dealt again into chunks by hash, and every pair of its
chunks is one task, so no task holds more than two chunks and no link is lost. The sizes of such
groups are a written table; the driver gathers nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, row_key, runs
from plumbline.plans.components import connected_components
from plumbline.plans.shared import materialize

WIDTH = 4
BUDGET = 4
#: Rows that a trie's group has on average, and the most that one chunk of a group may have.
MEAN_ROWS, GROUP_ROWS = 4_000, 40_000
#: Pairs compared at once inside a task, and node pairs followed at once.
COMPARE, FRONTIER, LEAF = 1 << 18, 1 << 15, 256


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The unsigned 64-bit SimHash of one text; null or no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 15):
        pairs = zip(starts[k : k + (1 << 15)].tolist(), ends[k : k + (1 << 15)].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in pairs], "<u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.nonzero(2 * count > len(starts))[0].tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches):
        prints = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
        signed = pa.array(np.array(prints, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), signed, batch.column(2), batch.column(3)], ["doc_id", "fp", "k1", "k2"])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, fp, k1, k2): fp the fingerprint's bits as a signed long, k1 and k2 the row's key."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    k1, k2 = row_key("doc_id", "text")
    return bounded(slim.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))).mapInArrow(lambda batches: _fingerprints(batches, width), "doc_id long, fp long, k1 long, k2 long")


def _forest_step(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the ends of the links (i, j) in `root`, which maps every row straight to its class."""
    apart = root[i] != root[j]
    a, b = root[i[apart]], root[j[apart]]
    if not len(a):
        return
    seen: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := seen.get(x, x)) != x:
            seen[x] = x = seen.get(y, y)
        return x

    for x, y in np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0).tolist():
        x, y = top(x), top(y)
        if x != y:
            seen[max(x, y)] = min(x, y)
    moved = np.fromiter((top(x) for x in seen), np.int64, len(seen))
    lut = np.arange(len(root))
    lut[np.fromiter(seen, np.int64, len(seen))] = moved
    root[:] = lut[root]


def trie_join(x: np.ndarray, exact_bits: int, budget: int, side: np.ndarray | None = None) -> np.ndarray:
    """Class of every row of `x` (sorted, distinct, unsigned) under links of at most `budget`
    differing bits and none among the leading `exact_bits`; with `side`, only links across sides.
    """
    n = len(x)
    root = np.arange(n)
    if n < 2:
        return root
    lead = x >> np.uint64(64 - exact_bits)
    cuts = np.flatnonzero(np.concatenate(([True], lead[1:] != lead[:-1], [True])))
    low, high = cuts[:-1], cuts[1:]
    keep = high - low > 1
    low, high = low[keep], high[keep]
    stack = [(low[k : k + FRONTIER], high[k : k + FRONTIER], low[k : k + FRONTIER], high[k : k + FRONTIER], np.zeros(len(low[k : k + FRONTIER]), np.int64), exact_bits) for k in range(0, len(low), FRONTIER)]
    while stack:
        al, ah, bl, bh, err, level = stack.pop()
        leaf = ((ah - al) * (bh - bl) <= LEAF) | (level == 64)
        if leaf.any():
            _compare(x, root, al[leaf], ah[leaf], bl[leaf], bh[leaf], budget, side)
            al, ah, bl, bh, err = (v[~leaf] for v in (al, ah, bl, bh, err))
        if not len(al):
            continue
        bit = np.uint64(1) << np.uint64(63 - level)
        below = ~((bit << np.uint64(1)) - np.uint64(1)) if level else np.uint64(0)
        am = np.clip(np.searchsorted(x, (x[al] & below) | bit), al, ah)
        bm = np.clip(np.searchsorted(x, (x[bl] & below) | bit), bl, bh)
        own = (al == bl) & (ah == bh)
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        parts.append(tuple(v[~own] for v in (am, ah, bl, bm, err + 1)))
        al, ah, bl, bh, err = (np.concatenate([p[k] for p in parts]) for k in range(5))
        alive = (al < ah) & (bl < bh) & (err <= budget) & ~((al == bl) & (ah == bh) & (ah - al < 2))
        al, ah, bl, bh, err = (v[alive] for v in (al, ah, bl, bh, err))
        stack += [(al[k : k + FRONTIER], ah[k : k + FRONTIER], bl[k : k + FRONTIER], bh[k : k + FRONTIER], err[k : k + FRONTIER], level + 1) for k in range(0, len(al), FRONTIER)]
    return root


def _compare(x, root, al, ah, bl, bh, budget, side) -> None:
    """Compares the rows of node pairs outright, some pairs at a time."""
    wide = bh - bl
    sizes = (ah - al) * wide
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + COMPARE, "right")))
        k = np.repeat(np.arange(first, last), sizes[first:last])
        at = np.arange(len(k)) - np.repeat(ends[first:last] - sizes[first:last] - done, sizes[first:last])
        i, j = al[k] + at // wide[k], bl[k] + at % wide[k]
        near = (np.bitwise_count(x[i] ^ x[j]) <= budget) & (i != j)
        if side is not None:
            near &= side[i] != side[j]
        _forest_step(root, i[near], j[near])
        first = last


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of budget + 2 blocks that cover 64 bits."""
    edges = [64 * k // (budget + 2) for k in range(budget + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _pairs(budget: int) -> list[tuple[int, int]]:
    return list(combinations(range(budget + 2), 2))


def _led_by(x: np.ndarray, pair: tuple[int, int], budget: int) -> tuple[np.ndarray, int]:
    """(fingerprints with the blocks of `pair` moved to the front, bits of the two)."""
    blocks, out = _blocks(budget), np.zeros_like(x)
    for k in (*pair, *(k for k in range(len(blocks)) if k not in pair)):
        low, bits = blocks[k]
        out = (out << np.uint64(bits)) | ((x >> np.uint64(low)) & np.uint64((1 << bits) - 1))
    return out, sum(blocks[k][1] for k in pair)


def _linked(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """The spanning forest of one group: rows (a, b) of fingerprints as signed longs."""
    prints = pdf["fp"].to_numpy(np.int64)
    x, bits = _led_by(prints.view(np.uint64), _pairs(budget)[int(pdf["pair"].iat[0])], budget)
    order = np.argsort(x)
    prints, x, side = prints[order], x[order], None
    if pdf["lo"].iat[0] != pdf["hi"].iat[0]:
        side = pdf["chunk"].to_numpy()[order]
    root = trie_join(x, bits, budget, side)
    i = np.flatnonzero(root != np.arange(len(x)))
    return pd.DataFrame({"a": prints[i], "b": prints[root[i]]})


def links(prints: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS, mean_rows: int = MEAN_ROWS) -> DataFrame:
    """Spanning edges (a, b) between distinct fingerprints `prints` (fp) at `budget` or fewer bits."""
    blocks, pairs = _blocks(budget), _pairs(budget)
    n = prints.count()
    lead = min(max(0, math.ceil(math.log2(max(1, n) / mean_rows))), min(blocks[i][1] + blocks[j][1] for i, j in pairs))
    block = lambda k: F.shiftrightunsigned("fp", blocks[k][0]).bitwiseAND(F.lit((1 << blocks[k][1]) - 1))
    parts = [F.shiftright(F.shiftleft(block(i), blocks[j][1]).bitwiseOR(block(j)), blocks[i][1] + blocks[j][1] - lead).cast("int") for i, j in pairs]
    dealt = prints.select("fp", F.posexplode(F.array(*parts)).alias("pair", "part"))
    keys = ["pair", "part"]
    if n > group_rows:  # else no group can be beyond it
        sizes = materialize(dealt.groupBy(*keys).count().where(F.col("count") > group_rows).select(*keys, F.ceil(F.col("count") / group_rows).cast("int").alias("q")), "crowds")
        dealt = dealt.join(sizes, keys, "left").withColumn("q", F.coalesce("q", F.lit(1)))
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("q")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
        dealt = dealt.select("fp", *keys, "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    else:
        dealt = dealt.select("fp", *keys, *(F.lit(0).alias(c) for c in ("chunk", "lo", "hi")))
    return dealt.groupBy(*keys, "lo", "hi").applyInPandas(lambda pdf: _linked(pdf, budget), "a long, b long")


def _classes(docs: DataFrame, budget: int, width: int, group_rows: int) -> DataFrame:
    """Rows (doc_id, fp, k1, k2, first): first is the (no_id, doc_id, k1, k2) that leads the row's class."""
    prints = materialize(fingerprints(docs, width), "simhash")
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    distinct = materialize(prints.groupBy("fp").agg(F.min(me).alias("least")), "distinct")
    tree = connected_components(links(distinct.select("fp"), budget, group_rows))
    rooted = materialize(distinct.join(tree, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "rooted")
    # written, so that both sides of the join come from an exchange and a large class can be split
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("first")), "named")
    return prints.join(rooted.join(named, "root").select("fp", "first"), "fp")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, width: int = WIDTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, fingerprint, component_id.

    fingerprint: 16 lowercase hex digits; component_id: the smallest doc_id reachable over
    links of at most `budget` bits, its own included. Null and empty texts, and texts of white
    space only, have fingerprint zero and are linked like any other. Repeated rows each give a
    row. Rows of null doc_id link others; only a class of nothing else has a null component_id.
    Columns beside doc_id and text are ignored; an empty table gives an empty result.
    Sets the session's rows of an Arrow batch (`common.bounded`).
    """
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return _classes(docs, budget, width, group_rows).select("doc_id", hexed, F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, budget: int = BUDGET, width: int = WIDTH) -> DataFrame:
    """The rows of `docs` that lead their class: one document of each; the columns stay as they are.

    The leader has the smallest doc_id (null after all others), then the smallest row key. Rows
    repeated with the same doc_id and text are one document and stay or go together.
    """
    found = _classes(docs, budget, width, GROUP_ROWS)
    lead = found.where((F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2"))).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = row_key(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.join(lead, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_semi")
