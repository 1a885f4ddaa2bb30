"""The corpus operators as queries over whole tables, with the columns their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, htmltext, linededup, sharding, simhash, spans, topk, toxicity, urlfilter
from plumbline.llm.common import read
from plumbline.plans.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), shards=40, map_path=new_path(spark, "slot-map"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"))


#: (verdict, host, path prefix)
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), URL_RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_toxic_words"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("k1", "k2")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(read(spark, sf_dir, "pages"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(read(spark, sf_dir, "documents"), window=spans.WINDOW, whole=True)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.remove_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_byte_bpe,
        op3_exact_top_k,
        op4_url_rules,
        op5_toxicity,
        op6_decontamination,
        op7_html_text,
        op8_sentence_spans,
        op9_simhash,
        op10_line_dedup,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TOKENS = r"""
  list_distinct(list_filter(list_concat(
    list_transform(list_reverse(string_split(host, '.')), lambda x, i: 'h' || (i - 1) || '=' || x),
    list_transform(string_split(path, '/'), lambda x, i: 'p' || (i - 1) || '=' || regexp_replace(x, '[0-9]+', '#', 'g')),
    list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: 'q=' || split_part(x, '=', 1)),
    ['s=' || split_part(url, '://', 1), 'f=' || regexp_extract(url, '#(.*)', 1)]), lambda x: NOT ends_with(x, '=')))
"""

ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
    "op4_url_rules": f"""
        WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        p AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
        r(v, h, x) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
        best AS (SELECT page_id, url, max_by(h || x, length(h) + length(x)) AS rule, max_by(v, length(h) + length(x)) AS v FROM (SELECT DISTINCT page_id, url, host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x) GROUP BY 1, 2),
        t AS (SELECT *, CASE WHEN url IS NULL THEN [] ELSE {_TOKENS} END AS toks FROM p),
        l AS (SELECT doc_id, min(b) AS b FROM (SELECT doc_id, coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 AS b FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)) GROUP BY 1 HAVING min(b) = max(b)),
        b AS (SELECT row_number() OVER () AS id, toks, l.b FROM t JOIN l ON page_id = doc_id),
        n AS (SELECT count(*) AS n FROM b),
        one AS (SELECT id, b, unnest(toks) AS tok FROM b),
        sets AS (SELECT [tok] AS items, count(*) AS freq, count(*) FILTER (b) AS hits FROM one GROUP BY 1
                 UNION ALL SELECT [x.tok, y.tok], count(*), count(*) FILTER (x.b) FROM one x JOIN one y ON x.id = y.id AND x.tok < y.tok GROUP BY 1),
        rules AS (SELECT items FROM sets, n WHERE freq >= 5 AND freq >= {urlfilter.MIN_SUPPORT} * n AND hits >= {urlfilter.MIN_CONFIDENCE} * freq),
        fired AS (SELECT DISTINCT page_id, url FROM t JOIN rules ON list_has_all(toks, items))
        SELECT p.page_id, host, path, rule, coalesce(v, CASE WHEN f.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN best ON p.page_id = best.page_id AND p.url = best.url LEFT JOIN fired f ON p.page_id = f.page_id AND p.url = f.url
    """,
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        place AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hit AS (SELECT doc_id, item_id, place.n, i FROM place JOIN win ON place.x = win.x AND place.n = win.n),
        words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY 1),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM hit GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    # what the density finds, cut out of the test pages by the one article element that each has; a check of these
    # pages' results, not of the method
    "op7_html_text": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
        t AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1)>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS x FROM a),
        u AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS x FROM t),
        b AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS text FROM u)
        SELECT page_id, url, text, length(text) AS n_chars FROM b
    """,
    "op10_line_dedup": f"""
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS x FROM l),
        boil AS (SELECT x, min((doc_id, i)) AS first FROM t WHERE length(x) >= {linededup.MIN_CHARS} GROUP BY x HAVING count(DISTINCT source) >= {linededup.MIN_SITES}),
        m AS (SELECT doc_id, i, raw, first IS NOT NULL AND first <> (doc_id, i) AS gone FROM t LEFT JOIN boil USING (x))
        SELECT d.doc_id, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), any_value(CASE WHEN d.text IS NOT NULL THEN '' END)) AS text, count(i) AS n_lines, count(*) FILTER (gone) AS n_removed
        FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id
    """,
}
