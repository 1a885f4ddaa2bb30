"""Decontamination, sentence spans, SimHash and line dedup against plain Python."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from oracle import DATA, both, views
from pyspark.sql import functions as F

from plumbline.llm import bloom, decontaminate, linededup, simhash, spans
from plumbline.llm.queries import ORACLE_SQL, QUERIES

SF = str(DATA / "sf0.01")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", ["op6_decontamination", "op10_line_dedup"])
def test_against_sql(spark, con, name):
    ours, theirs = both(spark, con, QUERIES[name], ORACLE_SQL[name], SF)
    assert ours == theirs


# --- decontamination ---
def contamination(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes, out = sorted({len(k) for k in windows}), []
    for i, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= owners - {None}
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("bits", [bloom.MOST_BITS, 10])
def test_contamination_by_brute_force(spark, docs, monkeypatch, bits):
    monkeypatch.setattr(bloom, "MOST_BITS", bits)  # a filter too small lets more through and changes nothing
    rng = np.random.default_rng(2)
    vocabulary = ["the", "a", "Éa", "x1", "Zed", "of", "run"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(rng.integers(1, 40)))) for i in range(30)] + [(100, None), (101, "..."), (None, "the a the"), (102, "the the the"), (102, "run run")]
    rows = [(i, text(60) + ", " + items[i % 30][1] + "! " + text(20)) for i in range(50)]
    rows += [(60, None), (61, ""), (62, "!!"), (63, "the " * 500), (63, "the " * 500), (None, items[3][1])]
    bench = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    df = docs(rows)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(df, bench).collect())
    assert got == contamination(rows, items)


def test_contamination_edges(edges, empty, docs):
    bench = docs([(1, "one two three")]).select(F.col("doc_id").alias("item_id"), "text")
    assert decontaminate.contamination(edges, bench).count() == edges.count()
    assert decontaminate.contamination(edges, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    kept = decontaminate.keep_clean(docs([(1, "one two three"), (2, "other text")]), bench)
    assert [r["doc_id"] for r in kept.collect()] == [2] and kept.columns == edges.columns


# --- SimHash ---
def fingerprint(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def classes(rows):
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.arange(len(rows))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    ids = {}
    for (i, _), c in zip(rows, label, strict=True):
        ids[c] = min((x for x in (ids.get(c), i) if x is not None), default=None)
    return sorted((str(i), f"{int(p):016x}", str(ids[c])) for (i, _), p, c in zip(rows, prints, label, strict=True))


def test_simhash_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op9_simhash"](spark, SF).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == classes(rows)


@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 50])
def test_simhash_edges_and_split_groups(docs, group_rows):
    rng = np.random.default_rng(4)
    base = [str(x) for x in rng.integers(0, 9, 60)]
    rows = [(i, " ".join(base[:k] + [f"w{i}"] + base[k + 1 :])) for i, k in enumerate(rng.integers(0, 60, 200).tolist())]
    rows += [(i + 1000, t) for i, t in [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (5, "ONE")]] + [(None, "one"), (None, "alone here")]
    got = simhash.near_duplicates(docs(rows), group_rows=group_rows).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == classes(rows)


def test_simhash_keeps_one(docs, edges, empty):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "x y z w v u t"), (None, "q r s t u v"), (None, "a b c d e")]
    kept = simhash.keep_one(docs(rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "3", "9", "None"] and kept.columns == edges.columns
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert simhash.near_duplicates(edges).count() == edges.count()


def test_trie_join_by_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(20):
        n = int(rng.integers(2, 600))
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        near = base[rng.integers(0, n, n)]
        for _ in range(4):
            near = near ^ ((np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) * (rng.random(n) < 0.8).astype(np.uint64))
        x = np.unique(np.concatenate([base, near]) if trial % 2 else base[0] ^ (rng.integers(0, 2**12, n, dtype=np.uint64) << np.uint64(rng.integers(0, 40))))
        root = simhash.trie_join(x, 13, 4)
        same = (x[:, None] >> np.uint64(51)) == (x[None, :] >> np.uint64(51))
        linked = same & (np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
        label = np.arange(len(x))
        while True:
            new = np.array([label[r].min() for r in linked])
            if (new == label).all():
                break
            label = new
        assert len(set(zip(root.tolist(), label.tolist(), strict=True))) == len(set(root.tolist())) == len(set(label.tolist()))


# --- line dedup ---
def cut_lines(rows, min_sites, min_chars):
    occurrences = {}
    for i, t, s in rows:
        for j, line in enumerate(t.split("\n") if t is not None else []):
            if len(x := line.strip(" \t\r\f\v")) >= min_chars:
                occurrences.setdefault(x, []).append(((i is None, i or 0, j), s))
    first = {x: min(o)[0] for x, o in occurrences.items() if len({s for _, s in o} - {None}) >= min_sites}
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((str(i), None, 0))
            continue
        lines = t.split("\n")
        kept = [x for j, x in enumerate(lines) if (k := x.strip(" \t\r\f\v")) not in first or first[k] == (i is None, i or 0, j)]
        out.append((str(i), "\n".join(kept), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_lines_by_brute_force(spark):
    rng = np.random.default_rng(8)
    pool = [f"boilerplate line number {k}" for k in range(12)] + ["short", "", "  padded line of text \t", "unique"]
    rows = [(i, "\n".join([*rng.choice(pool, 6).tolist(), f"own line of document {i}"]), f"site{int(rng.integers(0, 9))}" if i % 11 else None) for i in range(120)]
    rows += [(500, None, "site1"), (501, "", "site2"), (502, "\n\n", None), (None, pool[0], "site3")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, line int, h1 string")
    for min_sites in (1, 4, 6, 9, 10):
        got = sorted(((str(r["doc_id"]), r["text"], r["_n_removed"]) for r in linededup.remove_lines(df, min_sites).collect()), key=str)
        assert got == cut_lines(rows, min_sites, linededup.MIN_CHARS)


def test_near_threshold_lines_are_counted(spark):
    """With a coarse sketch the estimate errs; lines near the threshold are right all the same."""
    sites = [(f"a line on {n} sites here", f"s{k}") for n in range(30, 50) for k in range(n)]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(sites)], "doc_id long, text string, source string")
    lines = linededup._lines(df, 12)
    found = linededup.boilerplate(lines, 40, lg_k=4, margin=0.9)
    assert found.count() == sum(n >= 40 for n in range(30, 50))


def test_line_edges(edges, empty):
    out = linededup.remove_lines(edges)
    assert out.count() == edges.count() and out.where("_n_removed > 0").count() == 0
    assert linededup.remove_lines(empty).count() == 0


def test_a_text_of_200_000_lines(spark):
    """The work is linear in the lines of a text: looking each one up among the removed would take hours."""
    menu = [f"m{k}" for k in range(100_000)]
    rows = [(0, "\n".join(menu), "s0")] + [(i, "\n".join(x for k, m in enumerate(menu) for x in (m, f"own {i} {k}")), f"s{i}") for i in range(1, 5)]
    out = linededup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 5, min_chars=1)
    got = {r["doc_id"]: (r["_n_removed"], r["text"]) for r in out.collect()}
    assert got == {0: (0, rows[0][1])} | {i: (100_000, "\n".join(f"own {i} {k}" for k in range(100_000))) for i in range(1, 5)}


# --- sentence spans ---
def mixed(word):
    full, h, p = (1 << 64) - 1, 0, 1
    for b in word:
        h, p = (h + (b + 1) * p) & full, p * 0x9E3779B97F4A7C15 & full
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & full
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & full
    return h ^ (h >> 31)


def without_repeats(rows):
    occurrences, texts = {}, []
    for i, t in rows:
        raw = (t or "").encode()
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        pieces, sentence = [], []
        for k, (a, b) in enumerate(at):
            sentence.append(k)
            word = raw[a:b]
            bare = word[:-1] if word[-1:] in (b'"', b"'", b")", b"]", b"}") and len(word) > 1 else word
            if bare[-1:] in (b".", b"!", b"?") or k + 1 == len(at) or b"\n" in raw[b : at[k + 1][0]]:
                piece = []
                for j in sentence:
                    piece.append(j)
                    if len(sentence) > spans.LONG and mixed(raw[at[j][0] : at[j][1]].lower()) % spans.CUT == 0:
                        pieces.append(piece)
                        piece = []
                if piece:
                    pieces.append(piece)
                sentence = []
        for k in range(len(pieces)):
            j = k
            if len(pieces[k]) < spans.WORDS:
                while j < len(pieces) and (j - k + 1 < spans.SENTENCES or pieces[j][-1] - pieces[k][0] + 1 < spans.WORDS):
                    j += 1
            if j < len(pieces):
                a, b = pieces[k][0], pieces[j][-1]
                key = tuple(raw[x:y].lower() for x, y in at[a : b + 1])
                occurrences.setdefault(key, set()).add(((i is None, i or 0, at[a][0]), at[b + 1][0] if b + 1 < len(at) else len(raw)))
        texts.append((i, t))
    cuts = {}
    for found in occurrences.values():
        first = min(found)[0]
        for (none, i, a), b in found:
            if (none, i, a) != first:
                cuts.setdefault((none, i), []).append({"begin": a, "stop": b})
    return sorted(((str(i), *spans._without(t, cuts.get((i is None, i or 0)))) for i, t in texts), key=str)


PASSAGE = "This planted passage has quite many words, and it goes on for a while so that nobody can doubt it. A second sentence follows the first one without any delay. Then a third sentence of the passage says more about nothing at all (really). Finally the last sentence ends the whole thing here and now with care."


def test_spans_by_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").collect()]
    rows += [(1000, "Intro words. " + PASSAGE + " And after it."), (1001, "Other start. " + PASSAGE.upper() + "\nMore"), (1002, "zzz " + PASSAGE), (None, "x\n" + PASSAGE), (1003, None), (1004, ""), (1005, "of " * 80), (1006, "One two. " * 50), (1007, "É" * 50 + "\n" + PASSAGE)]
    got = sorted(((str(r["doc_id"]), r["text"], r["n_removed"]) for r in spans.remove_repeats(docs(rows)).collect()), key=str)
    assert got == without_repeats(rows)


def test_passages_go_and_clean_texts_stay(spark, docs):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9))))
    prose = lambda n: " ".join(w + ("." if rng.random() < 0.1 else "") for w in (word() for _ in range(n)))
    passages = [prose(60) for _ in range(20)]
    rows = [(i, prose(80) + (f"\n{passages[i % 20]}\n" if i < 100 else ". ") + prose(50)) for i in range(200)]
    out = {r["doc_id"]: r["text"] for r in spans.remove_repeats(docs(rows)).collect()}
    for i, t in rows:
        if i < 20 or i >= 100:
            assert out[i] == t
        else:
            left = set(out[i].split()) & set(passages[i % 20].split())
            assert len(left) <= 0.5 * len(set(passages[i % 20].split()))


def test_span_edges(edges, empty):
    out = spans.remove_repeats(edges)
    assert out.count() == edges.count() and spans.remove_repeats(empty).count() == 0
    assert out.where("text is null").count() == 1


def removed_by_query(spark, docs, tmp_path, rows):
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    return {r["doc_id"]: r["text"] for r in QUERIES["op8_sentence_spans"](spark, str(tmp_path)).collect()}


def test_last_short_sentence_of_a_passage_goes(spark, docs, tmp_path):
    sentence = lambda name, n: " ".join(f"{name}{k}" for k in range(n)) + "."
    passage = " ".join(sentence(name, n) for name, n in (("a", 12), ("b", 12), ("c", 4)))
    out = removed_by_query(spark, docs, tmp_path, [(1, f"{passage} {sentence('x', 11)}"), (2, f"{sentence('y', 9)} {passage} {sentence('z', 10)}")])
    assert out[1] == f"{passage} {sentence('x', 11)}" and out[2] == f"{sentence('y', 9)} {sentence('z', 10)}"


def test_runs_of_one_document_are_its_own(docs):
    refrain = "This line of the song comes back again and again. And so does that one, as everybody knows by now. "
    rows = [(1, refrain * 5 + PASSAGE), (2, "Something else. " + PASSAGE), (2, "Something else. " + PASSAGE)]
    out = {r["doc_id"]: r["text"] for r in spans.remove_repeats(docs(rows), window=spans.WINDOW, across=True).collect()}
    assert out == {1: rows[0][1], 2: "Something else. "}
    alone = spans.remove_repeats(docs(rows[:1])).first()
    assert alone["n_removed"] > 0 and spans.remove_repeats(docs(rows[:1]), across=True).first()["n_removed"] == 0


def test_a_passage_repeated_in_one_document_goes(spark, docs, tmp_path):
    own = "Here is what stands between them in nobody else's text. "
    rows = [(1, f"{PASSAGE} {own}{PASSAGE} The end."), (2, "la " * 100), (3, "Nothing of this one is said twice.")]
    out = removed_by_query(spark, docs, tmp_path, rows)
    assert out[1] == f"{PASSAGE} {own}The end." and out[3] == rows[2][1]
    assert spans.WORDS <= len(out[2].split()) < spans.WORDS + 2 * spans.WINDOW


@pytest.mark.parametrize("window", [0, spans.WINDOW])
def test_a_semi_join_does_what_the_filter_does(spark, docs, monkeypatch, window):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").collect()] + [(None, PASSAGE), (1000, "a " + PASSAGE)]
    found = []
    for most in (spans.MOST_FILTERED, 0):
        monkeypatch.setattr(spans, "MOST_FILTERED", most)
        found.append(sorted(map(tuple, spans.remove_repeats(docs(rows), window=window, across=True).collect()), key=str))
    assert found[0] == found[1] and any(r[2] for r in found[0])


def test_fifty_words_inside_long_sentences_are_found(spark, docs, tmp_path):
    plain = [w for w in (f"w{k}" for k in range(4000)) if mixed(w.encode()) % spans.CUT]
    rng = np.random.default_rng(10)
    rows, passages = [], [rng.choice(plain, 50).tolist() for _ in range(30)]
    for i in range(60):
        own = [f"{w}of{i}" for w in rng.choice(plain, 40)]
        rows.append((i, " ".join(own[: 1 + i % 20] + passages[i % 30] + own[20:])))
    out = removed_by_query(spark, docs, tmp_path, rows)
    for i, t in rows:
        assert out[i] == t if i < 30 else len(t.split()) - len(out[i].split()) >= 21


def test_fifty_words_inside_long_sentences_go_whole(spark, docs, tmp_path):
    rng = np.random.default_rng(11)
    rows, passages, left = [], [[f"w{k}" for k in rng.integers(0, 4000, 50)] for _ in range(30)], {}
    for i in range(90):
        own = [f"w{k}of{i}" for k in rng.integers(0, 4000, 40)] if i < 60 else []  # the last 30 are a passage alone
        twice = passages[i % 30] if i % 2 else []
        rows.append((i, " ".join(own[: i % 20] + passages[i % 30] + own[20:] + twice + own[5:10])))
        first = passages[i % 30] if i < 30 else []
        left[i] = " ".join(own[: i % 20] + first + own[20:] + own[5:10])
    out = removed_by_query(spark, docs, tmp_path, rows)
    assert {i: t.strip() for i, t in out.items()} == left


def test_two_whole_sentences_go_whatever_follows(spark, docs, tmp_path):
    rng = np.random.default_rng(12)
    prose = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 100_000, n)) + "."
    passages = [f"{prose(5)} {prose(16)}" for _ in range(200)]
    around = [(prose(15), prose(15)) for _ in range(400)]
    rows = [(i, f"{a} {passages[i % 200]} {b}") for i, (a, b) in enumerate(around)]
    out = removed_by_query(spark, docs, tmp_path, rows)
    assert out == {i: t if i < 200 else " ".join(around[i]) for i, t in rows}
