import html
import math
import re

import numpy as np
import pytest
from oracle import DATA, both, views

from plumbline.llm import htmltext, toxicity, urlfilter
from plumbline.llm.queries import ORACLE_SQL, QUERIES, URL_RULES


# --- URLs ---
def verdict(url):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x", "http://example.com/en/6", "http://xexample.com/en/7", "x://a.net/de/1#f", "x://example.net/de/81", "x://sub.example.net/de/8", "x://net/de/", "x://org/es/", "x://b.org/es", "http://É.com/en/", "a://b.com://c/en/", "http://example.com?/en/", "http://example.com/en/7", "http://example.com/en/7"]
    pages = spark.createDataFrame([(i, u, "h", "z", "t") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, tokens string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = {r["page_id"]: r for r in urlfilter.judge(pages, lab, URL_RULES).collect()}
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            host, path, rule, v = verdict(u)
            r = got[i]
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, v or "allow")
    assert urlfilter.judge(pages.limit(0), labels, URL_RULES).count() == 0


def test_mined_rules_fire(spark):
    rows = [(i, f"http://{'spam' if i % 4 == 0 else 'good'}{i}.info/{'win' if i % 4 == 0 else 'read'}/{i}?{'ref' if i % 2 else 'q'}=1") for i in range(200)]
    pages = spark.createDataFrame([*rows, (900, "http://other.biz/win/3"), (901, "http://other.biz/read/3")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(200)] + [(3, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, labels, []).collect()}
    assert got[900] == "block" and got[901] == "allow" and all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(200))


def test_rules_of_three_tokens(spark):
    """No pair of the tokens a, b, c reaches the confidence, all three do; wider sets of them are left out."""
    rows = [(["a", "b", "c", "d", "e"], True)] * 10 + [([*two, "d", "e"], False) for two in (("a", "b"), ("a", "c"), ("b", "c")) for _ in range(10)]
    rows += [(["x", "y", "z", "u"], True)] * 6 + [(["x", "z", "u"], False)] * 6 + [(["y", "z", "u"], False)] * 6
    found = {tuple(sorted(r["items"])) for r in urlfilter.mine(spark.createDataFrame(rows, "tokens array<string>, block boolean")).collect()}
    assert found == {("a", "b", "c"), ("x", "y")}


def test_urls_against_sql(spark):
    sf = str(DATA / "sf0.01")
    ours, theirs = both(spark, views(sf), QUERIES["op4_url_rules"], ORACLE_SQL["op4_url_rules"], sf)
    assert ours == theirs


def test_mined_rules_of_the_table_against_sql(spark):
    """Labels that follow from the urls, by one token and by two, so that rules of both kinds fire."""
    sf = str(DATA / "sf0.1")
    con = views(sf)
    judged = "url LIKE '%utm_source%' OR url LIKE '%//blog.%/es/%'"
    labels = f"SELECT page_id AS doc_id, CAST(1 AS BIGINT) AS quality, CAST(coalesce({judged}, false) AS BIGINT) AS toxic FROM pages WHERE page_id % 3 > 0"
    frame = con.sql(labels).df()
    con.sql("CREATE OR REPLACE TEMP TABLE made AS " + labels)
    con.sql("CREATE OR REPLACE TEMP VIEW labels AS SELECT * FROM made")
    judge = lambda session, _: urlfilter.judge(session.read.parquet(f"{sf}/pages.parquet"), session.createDataFrame(frame), URL_RULES)
    ours, theirs = both(spark, con, judge, ORACLE_SQL["op4_url_rules"], sf)
    assert ours == theirs
    assert sum(rule == "None" and verdict == "'block'" for *_, rule, verdict in ours) > 50


def test_tokens_shared_by_the_same_urls_make_no_sets(spark):
    """Forty tokens that stand together in mixed labels: 2 ** 40 sets of them are frequent."""
    many = [f"q=k{k:02d}" for k in range(40)]
    rows = [(i, [*many, *(["a"] if i % 2 else []), *(["b"] if i % 3 else [])], bool(i % 2 and i % 3)) for i in range(60)] + [(i, ["c"], False) for i in range(60, 90)]
    found = urlfilter.mine(spark.createDataFrame([r[1:] for r in rows], "tokens array<string>, block boolean")).collect()
    assert {tuple(sorted(r["items"])) for r in found} == {("a", "b")}


# --- toxicity ---
def test_marginals_equal_the_full_passes():
    model = toxicity.Model({"w:bad": 3.0, "w:worse": 5.0}, -2.0, ((0.3, -1.0), (0.1, 0.9)), (0.0, 1.0, 1.0))
    rng, step = np.random.default_rng(0), np.exp(np.array(model.step))
    for _ in range(60):
        words = [str(x) for x in rng.choice(["a", "b", "bad", "worse"], int(rng.integers(1, 80)), p=[0.5, 0.4, 0.05, 0.05])]
        places, marginal, n = toxicity.Scorer(model).tagged(" ".join(words))
        e = [np.array([1.0, math.exp(model.bias + model.emission(w))]) for w in words]
        alpha, beta = [e[0]], [np.ones(2)]
        for x in e[1:]:
            alpha.append((alpha[-1] @ step) * x)
        for x in e[:0:-1]:
            beta.insert(0, step @ (x * beta[0]))
        full = [a[1] * b[1] / (a @ b) for a, b in zip(alpha, beta, strict=True)]
        assert n == len(words) and np.allclose([full[p] for p in places], marginal)


def test_chain_likelihood_gradient():
    rng = np.random.default_rng(1)
    feats = np.where(rng.random((40, toxicity.SEGMENT, 6)) < 0.05, rng.integers(0, 4, (40, toxicity.SEGMENT, 6)), -1).astype(np.int32)
    lengths = rng.integers(1, toxicity.SEGMENT + 1, 40)
    marks = ((feats == 2).any(axis=2) & (np.arange(toxicity.SEGMENT) < lengths[:, None])).astype(np.int8)
    w, bias, _ = toxicity.fit_chain(feats, marks, lengths, np.ones(40), 4)
    assert w[2] == max(w) and w[2] > 2 and bias < 0


def test_learns_words_and_prefixes(spark, docs):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(40)]
        if bad := i % 5 == 0:
            for _ in range(3):
                words.insert(int(rng.integers(0, 40)), "zzork" + word()[:2] if i % 2 else "vilething")
        rows.append((i, " ".join(words).capitalize()))
        labels.append((i, 1, int(bad)))
    df, lab = docs(rows), spark.createDataFrame([*labels, (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(df, toxicity.train(df, lab)).collect()}
    wrong = sum(out[i]["predicted"] != y for i, _, y in labels)
    assert wrong <= 3 and all(0 <= r["score"] <= 1 for r in out.values())
    text, spans = rows[10][1], out[10]["spans"]
    assert spans and all(text[s["begin"] : s["end"]].lower() == "vilething" for s in spans)
    assert toxicity.keep_civil(df, toxicity.train(df, lab)).columns == df.columns


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(edges, labels)
    out = toxicity.score(edges, model).collect()
    assert len(out) == edges.count() and all(r["predicted"] == 0 for r in out)
    assert all(r["held_out"] for r in out if r["doc_id"] is None)
    assert toxicity.score(empty, model).count() == 0 and toxicity.keep_civil(edges, model).count() == edges.count()


def test_scores_by_brute_force(spark):
    """Scores and tagged words of whole texts by forward and backward passes over every single word."""
    sf = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    step, texts = np.exp(np.array(model.step)), {r["doc_id"]: r["text"] for r in docs.collect()}
    tagged = 0
    for r in toxicity.score(docs, model).collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]] or "")
        words = [(m[0], m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
        lifts = [model.emission(w) for w, _ in words]
        e = [np.array([1.0, math.exp(min(60.0, model.bias + x))]) for x in lifts]
        alpha, beta = [], [np.ones(2)]
        for x in e:
            a = x if not alpha else (alpha[-1] @ step) * x
            alpha.append(a / a.sum())
        for x in e[:0:-1]:
            b = step @ (x * beta[0])
            beta.insert(0, b / b.sum())
        toxic = [(a[1] * b[1]) / (a @ b) for a, b in zip(alpha, beta, strict=False)]
        named = [m for m, x in zip(toxic, lifts, strict=True) if x]
        mass, most = min(20.0, sum(-math.log(max(1e-9, 1 - m)) for m in named)), max(named, default=0.0)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.coef[0] + model.coef[1] * mass + model.coef[2] * most))), rel=1e-6, abs=1e-9)
        spans = [span for (_, span), m, x in zip(words, toxic, lifts, strict=True) if x and m >= 0.5]
        assert [(s["begin"], s["end"]) for s in r["spans"]] == spans
        tagged += len(spans)
    assert tagged > 20


def test_long_texts_and_long_words_are_learned(spark, docs):
    """Toxic texts of over 16 KB, marked by a word of 60 letters."""
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(3000)]
    bad = "q" * 20 + "z" * 40
    rows = [(i, " ".join(rng.choice(vocabulary, 2500).tolist() + ([bad] if i % 4 == 0 else []) + rng.choice(vocabulary, 300).tolist())) for i in range(80)]
    df = docs(rows)
    model = toxicity.train(df, spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int"))
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in toxicity.score(df, model).collect())


def test_held_out_accuracy(spark):
    sf = str(DATA / "sf0.1")
    found = QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    caught = found[found.toxic == 1].predicted.mean()
    spared = 1 - found[found.toxic == 0].predicted.mean()
    assert len(found) > 500 and caught > 0.85 and spared > 0.98


# --- HTML ---
def article(page):
    body = page[page.index("<article>") : page.index("</article>")]
    body = re.sub("<[^>]+>", " ", re.sub(r"</?(p|h1|article)>", "\n", body))
    return "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in body.split("\n")) if x)


def test_articles_of_the_table(spark):
    sf = str(DATA / "sf0.1")
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op7_html_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


LONG = "Words of a long paragraph go on. " * 12
PAGES = {
    "soup": ("<body class='has-sidebar'><div id=header class=masthead><a href=/>Home</a><h1>Site</h1></div><div class=wrap><div class='main-nav'><a href=a>A</a><a href=b>B</a></div><div class=content><h2>Title</h2><p>" + LONG + "<p>" + LONG + "&eacute;<ul><li>One item<li>Two</ul><div class=share-buttons>Share</div><div id=comments><p>" + LONG + "</div></div><div class=sidebar>Side <a href=x>y</a></div></div><div class=cookie-notice>Cookies</div><footer>c</footer>", f"Title\n{LONG.strip()}\n{LONG.strip()} é\nOne item\nTwo".replace(". é", ". é")),
    "comments": ("<article><header><h1>T</h1></header><p>Short.</p><section class=comments><p>" + LONG * 3 + "</section><form><label>Name</label><input></form><footer>f</footer></article><aside><p>" + LONG + "</aside>", "T\nShort."),
    "bare": ("just text &amp; more &#233;", "just text & more é"),
    "script": ("<script>if (a<b) x='</p>';</script><style>p{}</style><p>Body<!-- gone --> text", "Body text"),
    "unclosed comment": ("<p>Body text</p><!-- never > ends", "Body text"),
    "white": ("<p>a\n\t b&nbsp; c<br>d</p>", "a b c d"),
    "none": (None, ""),
    "empty": ("<html></html>", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages(name):
    page, expected = PAGES[name]
    assert htmltext.extract(page) == expected


@pytest.mark.parametrize("page", ["<div>" * 20000 + "x", "<a b='x" * 20000 + "x", "<p><b>" * 20000 + "x", "</i>" + "<i>" * 20000 + "</b>" * 20000, "<" * 50000, "<li>" * 20000, "&" * 50000])
def test_broken_pages_take_little_time(page):
    assert isinstance(htmltext.extract(page), str)


def test_html_against_sql(spark):
    sf = str(DATA / "sf0.01")
    ours, theirs = both(spark, views(sf), QUERIES["op7_html_text"], ORACLE_SQL["op7_html_text"], sf)
    assert ours == theirs


def test_articles_by_density_alone(spark):
    """With plain div elements in place of article elements, the density sums pick the same texts."""
    pages = [r["html"] for r in spark.read.parquet(str(DATA / "sf0.01/pages.parquet")).select("html").collect()]
    for page in pages:
        assert htmltext.extract(page.replace("<article>", "<div>").replace("</article>", "</div>")) == article(page)


@pytest.mark.parametrize("name", ["related-note", "share-note", "alert-note", "skip-note", "dialog-note", "teaser-note"])
@pytest.mark.parametrize("tag", ["p", "div", "section"])
def test_a_class_that_only_holds_a_listed_word_stays(name, tag):
    page = f"<body><nav>menu</nav><article><h1>T</h1><p>{LONG}</p><{tag} class='{name}'>A short remark.</{tag}><p>{LONG}</p><div class='{name.split('-')[0]}-box'>gone</div><p class='ad'>gone</p></article></body>"
    assert htmltext.extract(page) == f"T\n{LONG.strip()}\nA short remark.\n{LONG.strip()}"


def test_parts_in_sibling_articles():
    part = lambda k: f"<article><h2>Part {k}</h2><p>{k} {LONG}</p><p>So {k}.</p></article>"
    page = f"<body><div class='site-header'><a href=/>Home</a></div><div>{part(1)}{part(2)}{part(3)}</div><div class=sidebar>x</div></body>"
    assert htmltext.extract(page) == "\n".join(f"Part {k}\n{k} {LONG.strip()}\nSo {k}." for k in (1, 2, 3))


def test_items_close_at_any_depth():
    for depth in (3, 7, 8, 9, 40):
        tree = htmltext.parse("<ul><li>" + "<div>" * depth + "one<li>two</ul>")
        ul = tree.kids[0]
        assert [k.tag for k in ul.kids] == ["li", "li"], depth


def test_densities_by_brute_force():
    """Densities, their sums and the core of random trees, computed top down by recursion over the tree."""
    rng = np.random.default_rng(12)

    def random_page(depth):
        out = []
        for _ in range(int(rng.integers(1, 5))):
            kind = int(rng.integers(0, 4)) if depth else 0
            words = " ".join("w" * int(rng.integers(1, 9)) for _ in range(int(rng.integers(1, 30))))
            out.append(words if kind == 0 else f"<a href=x>{words}</a>" if kind == 1 else f"<div>{random_page(depth - 1)}</div>")
        return "".join(out)

    def texts(node):  # (text, in a link) of the node and all below it
        return [t for k in node.kids for t in (texts(k) if isinstance(k, htmltext.Node) else [k])]

    def below(node):
        return [x for k in node.kids if isinstance(k, htmltext.Node) for x in [k, *below(k)]]

    def density(kids, inline, links, body):
        chars, linked = sum(len(" ".join(t.split())) for t, _ in kids), sum(len(" ".join(t.split())) for t, a in kids if a)
        if not chars:
            return 0.0
        share = sum(len(" ".join(t.split())) for t, a in body if a) / max(1, sum(len(" ".join(t.split())) for t, _ in body))
        base = np.log(chars / max(1, chars - linked) * linked + share * chars + np.e)
        return chars / max(1, inline) * np.log(1 + chars / max(1, linked) * max(1, inline) / max(1, links)) / max(1.0, base)

    for _ in range(40):
        nodes = htmltext._order(htmltext.parse("<body>" + random_page(4) + "</body>"))
        own = {x: (x.tags, x.link_tags) for x in nodes}
        htmltext._measure(nodes)
        body = texts(next(x for x in nodes if x.tag == "body"))
        whole = {x: density(texts(x), sum(own[y][0] + 1 for y in below(x)) + own[x][0], own[x][1] + sum(own[y][1] for y in below(x)), body) for x in nodes}
        for x in nodes:
            assert x.density == pytest.approx(whole[x])
            mine = [k for k in x.kids if not isinstance(k, htmltext.Node)]
            assert x.total == pytest.approx(sum(whole[k] for k in x.kids if isinstance(k, htmltext.Node)) + density(mine, *own[x], body))


def test_html_table_edges(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x</p>"), (2, "v", "<p>" + "w " * 100_000 + "</p>")]
    pages = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = htmltext.main_text(pages)
    assert out.count() == 4 and out.where("page_id = 2").first()["n_chars"] == 199_999 and out.where("page_id is null").first()["text"] == "x"
    assert htmltext.main_text(pages.limit(0)).count() == 0
