import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from oracle import DATA
from pyspark.sql import functions as F

from plumbline.llm import bpe, sharding, topk
from plumbline.llm.queries import QUERIES


# --- sharding ---
def test_shards_are_even_and_places_gapless(spark):
    rows = QUERIES["op1_sharding"](spark, str(DATA / "sf0.01")).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).collect()}
    assert len(rows) == len(texts)
    loads, places = [0] * 40, [[] for _ in range(40)]
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert max(loads) <= 1.02 * min(loads)
    assert all(sorted(p) == list(range(len(p))) for p in places)


def test_shard_edges(edges, empty):
    out = sharding.shard(edges, 3)
    assert out.count() == edges.count() and out.where("doc_id is null").count() == 2
    assert {r["size"] for r in out.where("doc_id in (1, 2)").collect()} == {16}
    for shard in range(3):
        got = sorted(r["slot"] for r in out.where(F.col("shard") == shard).collect())
        assert got == list(range(len(got)))
    assert sharding.shard(empty, 3).count() == 0


def test_map_versions(spark, docs, tmp_path):
    df = docs([(i, "x" * (i % 90)) for i in range(3000)])
    sizes, rows = sharding.slot_sums(df, 512)
    first = sharding.first_map(sizes, rows, 8)
    more = first.rebalanced(sizes, rows, 9)
    moved = [s for s in range(512) if first.shard_of[s] != more.shard_of[s]]
    assert more.version == 2 and set(more.shard_of) == set(range(9)) and max(more.loads()) <= 1.05 * sum(sizes) / 9
    assert sum(sizes[s] for s in moved) <= 0.2 * sum(sizes)
    fewer = more.rebalanced(sizes, rows, 6)
    assert set(fewer.shard_of) == set(range(6))
    path = str(tmp_path / "map")
    first.save(spark, path)
    more.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == more and sharding.SlotMap.load(spark, path, 1) == first
    used = sharding.shard(df, 9, slot_map=more, slots=512)
    assert used.count() == 3000 and {r[0] for r in used.select("map_version").distinct().collect()} == {2}


# --- BPE ---
def test_ids_are_those_of_the_library_and_decode_back(edges):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    out = bpe.encode_documents(edges, keep_ids=True)
    back = {(r["doc_id"], bytes(r["bytes"])) for r in bpe.decode_documents(out).collect()}
    texts = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert back == {(i, (t or "").encode()) for i, t in texts}
    want = sorted((str(i), len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()) == want


def test_pieces_are_cut_where_matches_end():
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    rng = np.random.default_rng(0)
    parts = ["word", " ", "  ", "\n", "\t\n ", "don't", "it'S", "123", "!?", "é", " ", "<|endoftext|>", "\U0001f600", "汉字"]
    for _ in range(60):
        text = "".join(rng.choice(parts, 400))
        assert "".join(bpe.pieces(text, 40)) == text
        assert bpe.encode(text, enc, piece=40).tolist() == enc.encode_ordinary(text)
    assert len(list(bpe.pieces("a" * 1000, 10))) == 1


def test_maps_are_kept_and_edited(spark, docs, tmp_path):
    """A second table finds the map of the first: as it is while the shards stay even, else its next version."""
    path = f"file://{tmp_path}/maps"
    rows = [(i, "x" * (50 + i % 7)) for i in range(3000)]
    first = sharding.shard(docs(rows), 4, map_path=path)
    assert first.select("map_version").distinct().collect()[0][0] == 1
    again = sharding.shard(docs(rows), 4, map_path=path)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect())) and sharding.SlotMap.versions(spark, path) == [1]
    one = sharding.SlotMap.load(spark, path)
    sharding.shard(docs(rows), 4, slot_map=one, map_path=path)
    assert len(sharding.SlotMap.load(spark, path).shard_of) == sharding.SLOTS  # no version is kept twice
    wider = sharding.shard(docs(rows), 5, map_path=path)
    sizes = [r["s"] for r in wider.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert sharding.SlotMap.versions(spark, path) == [1, 2] and len(sizes) == 5 and max(sizes) <= 1.021 * sum(sizes) / 5
    moved = wider.select("vslot", "shard").distinct().join(first.select("vslot", F.col("shard").alias("was")).distinct(), "vslot")
    assert moved.where("shard <> was and shard <> 4").count() == 0
    grown = [(i, "y" * (9000 if r["shard"] == 0 else 50)) for i, r in enumerate(first.orderBy("doc_id").collect())]
    after = sharding.shard(docs(grown), 5, map_path=path)
    assert sharding.SlotMap.versions(spark, path) == [1, 2, 3] and after.count() == 3000


def test_special_tokens_are_text():
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    assert isinstance(enc, tiktoken.Encoding)
    assert bpe.decode(bpe.encode("<|endoftext|>", enc), enc) == b"<|endoftext|>"


def test_encode_empty(empty):
    assert bpe.encode_documents(empty).count() == 0


# --- top-k ---
def brute(rows, every=50, k=5):
    good = [(i, [float(np.floor(256 * x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    found = {}
    for i, q in good:
        if i % every == 0:
            found.setdefault(i, set()).update((-int(np.dot(q, c)) if q else 0, j) for j, c in good if j != i and len(c) == len(q))
    return {(i, r + 1, j, -s) for i, f in found.items() for r, (s, j) in enumerate(sorted(f)[:k])}


@pytest.mark.parametrize("pack", [3, 1024])
def test_top_k_is_exact(spark, monkeypatch, pack):
    monkeypatch.setattr(topk, "PACK", pack)
    monkeypatch.setattr(topk, "ROUND_QUERIES", 2 * pack)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=20)]) for i in range(400)]
    rows += [(i, list(rows[i % 7][1])) for i in range(400, 460)]  # ties
    rows += [(600, [1.0] * 19 + [None]), (601, None), (650, [float("nan")] * 20), (None, [1.0] * 20), (7, [0.5, 0.5]), (700, [0.1, 0.2]), (750, []), (751, [])]
    rows += rows[:60]  # repeated rows
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, score string, query_id int")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df).collect()}
    assert got == brute(rows)
    assert topk.search(df.limit(0)).count() == 0
    alone = topk.search(df.where("vec_id = 50"))
    assert alone.count() == 0


def test_top_k_on_the_table(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(str(DATA / "sf0.01/embeddings.parquet")).collect()]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in QUERIES["op3_exact_top_k"](spark, str(DATA / "sf0.01")).collect()}
    assert got == brute(rows)
