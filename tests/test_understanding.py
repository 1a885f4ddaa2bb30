"""Profiles, resolution, clustering, domains, corrections, headers, the classifier; and the quality floor."""

import numpy as np
import pytest

from plumbline.functions import kernels as K
from plumbline.functions import language
from plumbline.operators import clusters, domains, embeddings, flows, headers, knowledge, profile, resolve, typeclf
from plumbline.plans.plan import run_plan


def typed(spark, items, name="c"):
    return profile.profile(spark.createDataFrame([(x,) for x in items], f"`{name}` string"))[0]


CASES = [
    (["y", "", "y", "y"], "c", "categorical"),
    (["yes", "no", "yes"], "c", "boolean"),
    (["007", "012", "123", "099"], "c", "identifier"),
    (["23", "45", "31", "28", "52", "19"], "c", "numeric"),
    (["0001234567", "0001234568", "0001234569"], "c", "identifier"),
    (["08031234567", "+2348031234568", "0805 123 4567"], "c", "phone"),
    (["good service here and prompt", "very bad experience overall today"], "c", "free_text"),
    (["44197", "44562", "44300"], "c", "identifier"),
    (["44197", "44562", "44300"], "start date", "date"),
    (["Lagos", "Kano", "Kastina", "Ikeja"], "c", "geo"),
    (["3200g", "12 kg"], "c", "numeric"),
    (["6.45", "7.2"], "latitude", "latitude"),
    (["a@b.co", "c@d.org"], "c", "email"),
    (["M", "F", "male"], "c", "gender"),
    (["0", "1", "1"], "c", "indicator"),
    (["2020-01-02 10:30", "2020-01-03 11:00"], "c", "datetime"),
    (["3/9/1990", "25/12/1991"], "c", "date"),
    (["", "N/A"], "c", "empty"),
]


@pytest.mark.parametrize(("items", "name", "expected"), CASES)
def test_types(spark, items, name, expected):
    assert typed(spark, items, name).semantic_type == expected


def test_orders_and_conventions(spark):
    assert typed(spark, ["25/12/1991", "13/01/1990", "1/2/1990"]).params == {"date_order": "DMY"}
    assert typed(spark, ["12/25/1991", "1/13/1990"]).params == {"date_order": "MDY"}
    assert typed(spark, ["1/2/1990", "3/4/1990"]).params == {}
    assert typed(spark, ["1.234,56", "7,5", "1.000,10", "2,5"]).params.get("decimal", "comma") == "comma"


def test_auto_plan(spark):
    df = spark.createDataFrame([(f"BEN{i:04d}", f"0803123{i:04d}", ["Kano", "Kastina", "Lagos"][i % 3], ["Yes", "n"][i % 2]) for i in range(40)], "BenID string, Phone string, State string, Active string")
    plan = profile.profile_to_plan(profile.profile(df))
    assert [m.transform for m in plan.mappings] == ["fixed_id", "phone_ng", "resolve", "boolean"]
    run = run_plan(df, plan)
    assert run.table.where("State = 'KATSINA'").count() == 13 and run.table.where("flagged").count() == 0
    assert run.table.first()["BenID"].startswith("BEN")


def test_resolver():
    r = resolve.EntityResolver(profile.STATE_NAMES, memory={"Port Harcourt": "RIVERS"})
    for v, c in {"Kastina": "KATSINA", "kadna": "KADUNA", "Plateu": "PLATEAU", "Phlateau": "PLATEAU", "Nassarawa": "NASARAWA", "Zamfra": "ZAMFARA", "Adamewa": "ADAMAWA", "Akwaibom": "AKWA IBOM", "cross rivers": "CROSS RIVER", "port-harcourt": "RIVERS"}.items():
        assert r.resolve(v)[1] == c
    for v in ("Ibadan", "Onitsha", "xyz123", ""):
        assert r.resolve(v)[4] == "unresolved"


def test_kernels():
    assert K.ratio("", "") == 100.0 and K.ratio("abc", "abc") == 100.0 and K.ratio("ab", "cd") == 0.0
    assert K.token_set_ratio("a b", "b a c") == 100.0
    assert K.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert K.match_rating_codex("Byrne") == "BYRN" and K.metaphone("Knight") == "NT"


def test_clusters(spark):
    df = spark.createDataFrame([(x,) for x in ["Maize", "maize", "Maiz", "Rice", "6-10 years", "21-25 years", "Sorghum", "Sorgum", "Niger", "Nigeria"]], "v string")
    found = {frozenset(r["members"]): r for r in clusters.cluster_similar(df, "v").collect()}
    assert frozenset(["Maize", "maize", "Maiz"]) in found and not any("6-10 years" in m for m in found)
    d = domains.Domains()
    apart = clusters.cluster_similar(df, "v", same=lambda a, b: d.same("country", a, b))
    assert not any("Niger" in r["members"] for r in apart.collect())


@pytest.mark.parametrize("chunk", [2, 2000])
def test_cohesion_by_brute_force(spark, chunk):
    words = ["sorghum", "sorgum", "sorghm", "sorghums", "maize", "maiz", "maise", "rice 6", "rice 7"]
    rows = [(0 if i < 4 else 1 if i < 7 else 2, i, w, 1) for i, w in enumerate(words)]
    got = {r["component"]: (r["least"], r["mean"]) for r in clusters.cohesion(spark.createDataFrame(rows, "component long, id long, value string, n long"), chunk).collect()}
    for c in (0, 1, 2):
        own = [w for k, _, w, _ in rows if k == c]
        scores = [clusters.guarded(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
        assert got[c] == (min(scores), pytest.approx(sum(scores) / len(scores)))


def test_long_lists_are_resolved_by_parts(spark):
    names = ["Abuja North", "Kano", "Kano Municipal", "Katsina", "Kaduna", "Lagos Island", "Lagos", "Port Harcourt", "Zaria"]
    df = spark.createDataFrame([(x,) for x in ["kano", "Kastina", "lagos iland", "harcourt port", "taught", "", None, "xyz", "Lagos Mainland"]], "v string")
    resolver = resolve.EntityResolver(names, memory={"taught": "Zaria"})
    whole, parted = ({r["value"]: tuple(r) for r in resolve.resolve_distinct(df, "v", resolver, most).collect()} for most in (100, 2))
    assert whole == parted and whole["kano"][3] == "exact" and whole["taught"][1] == "Zaria"


def test_entity_types(spark):
    from plumbline.operators import entities

    df = spark.createDataFrame([(x,) for x in ["Ann Bell", "Bob Hill", "a long text about Ann", None, "", "42"]], "v string")
    tagger = lambda texts: [("PERSON", 8) if "Ann" in t or "Bob" in t else None for t in texts]
    assert entities.entity_type(df, "v", tagger) == ("name", 0.5)
    assert entities.entity_type(df, "v", lambda texts: [None] * len(texts)) == (None, 0.0) == entities.entity_type(df.limit(0), "v", tagger)


def test_more_languages(values):
    got = values(["o gato não está em casa com os cães", "och det är inte för sent att gå", "il cane non è nel giardino della casa"], language.detect)
    assert got == ["pt", "sv", "it"]


def test_links_do_not_hang_on_the_size(spark):
    """Beyond 1,500 values, a pair of which every word and 3-gram is common is linked as it is in a small table."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("bcdfghjklmnpqrstvwxyz", k=12))
    pair = ["Ahmed Musa", "Musa Ahmed"]
    many = [*pair, "Kano", "Kino", *(f"ahmed {word()}" for _ in range(320)), *(f"musa {word()}" for _ in range(320)), *(word() for _ in range(1000))]
    for values in (many[:60], many):
        v = clusters.values(spark.createDataFrame([(x,) for x in values], "v string"), "v")
        names = {r["id"]: r["value"] for r in v.collect()}
        found = {frozenset((names[r["a"]], names[r["b"]])): r["score"] for r in clusters.links(v, 0.72, K.similarity).collect()}
        assert found[frozenset(pair)] == 1.0 and found[frozenset(("Kano", "Kino"))] == 0.75


def test_links_by_brute_force(spark):
    import random

    rng = random.Random(6)
    values = sorted({" ".join("".join(rng.choices("aeknot", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 3))) for _ in range(250)} | {"?", "!!", "no no", "no"})
    v = clusters.values(spark.createDataFrame([(x,) for x in values], "v string"), "v")
    rows = sorted((r["id"], r["value"]) for r in v.collect())
    for threshold in (0.72, 0.85):
        want = {(a, b): s for k, (a, x) in enumerate(rows) for b, y in rows[k + 1 :] if (s := K.similarity(x, y)) >= threshold}
        got = clusters.links(v, threshold, K.similarity).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]): r["score"] for r in got} == want


def test_place_share_counts_all_values(spark):
    from plumbline.functions.reference import STATE_NAMES

    for n in (150, 1000):
        names = [f"{STATE_NAMES[k % 30]}{'!' * (1 + k // 30)}" if k % 100 < 57 else f"zq{k}xw vv{k}kj" for k in range(n)]
        df = spark.createDataFrame([(x, "..") for x in names], "v string, w string")
        want = sum(k % 100 < 57 for k in range(n)) / n
        assert profile.place_share(df, ["v", "w"]) == {"v": pytest.approx(want), "w": 0.0}


def test_embeddings(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Ikeja market", "Ikeja markt"), ("Groceries", "Provisions")], "a string, b string")
    got = [r[0] for r in df.select(embeddings.cosine(embeddings.lexical_vector(F.col("a")), embeddings.lexical_vector(F.col("b")))).collect()]
    assert got[0] > 0.5 and got[1] < 0.4


def test_domains_and_admin():
    d = domains.Domains()
    assert d.canonical("country", "NGA") == "Nigeria" and d.canonical("country", "naija") == "Nigeria" and d.same("country", "Niger", "Nigeria") is False
    assert d.detect(["male", "F", "woman"], "Sex") == "sex" and d.detect(["zzz"]) is None
    assert d.resolve("sex", "boy") == ("Male", True)
    a = domains.Places()
    assert a.check("Zaria Local Government Area", "lga")["kind"] == "lga" and a.check("Kano", "lga")["kind"] == "is_state"
    assert a.check("Zaria", "state")["kind"] == "is_lga" and a.check("Kastina", "state")["suggestion"] == "KATSINA"
    assert a.check("Nowhere at all", "lga")["kind"] == "unknown"


def test_corrections(tmp_path):
    said = knowledge.Corrections([knowledge.Entry("state", "abujajos", ("FCT", "PLATEAU"))], path=tmp_path / "u.jsonl")
    assert said.answers("state", "Abuja(Jos)") == ("FCT", "PLATEAU")
    said.say("state", "Port Harcourt", "RIVERS")
    assert knowledge.Corrections(path=tmp_path / "u.jsonl").answers("state", "PORT-harcourt (x)") == ("RIVERS",)
    said.say("state", "Abuja(Jos)", "FCT")
    assert said.answers("state", "Abuja(Jos)") == ("FCT",) and said.answers("state", "") == ()
    said.say("state", "Port Harcourt")
    assert said.answers("state", "Port Harcourt") == () and said.settled("state") == {"abujajos": "FCT"}


def test_seeded_corrections_as_a_table(spark, tmp_path):
    (tmp_path / "seed.json").write_text('{"confirmed": {"state": {"uyo": "AKWA IBOM", "jos": "PLATEAU"}}, "conflicts": {"state": {"abujajos": ["FCT", "PLATEAU"]}}}')
    said = knowledge.Corrections(knowledge.seeds(tmp_path / "seed.json"))
    said.say("state", "Jos", "PLATEAU STATE")
    log = said.log(spark)
    df = spark.createDataFrame([("Uyo (town)", 1), ("JOS", 2), ("Abuja(Jos)", 3), (None, 4), ("else", 5), ("", 6)], "v string, key int")
    got = {r["key"]: (r["known_kind"], r["known_canonical"], r["known_candidates"]) for r in knowledge.known(df, "v", "state", log).collect()}
    assert got[1] == ("canonical", "AKWA IBOM", ["AKWA IBOM"]) and got[2][1] == "PLATEAU STATE" and got[3] == ("conflict", None, ["FCT", "PLATEAU"])
    assert got[4] == got[5] == got[6] == (None, None, None)
    assert [tuple(r) for r in knowledge.counts(log).collect()] == [("state", 2, 1)]


def test_places_as_a_table(spark):
    values = ["Zaria LGA", "Kano", "Nowhere at all", "Kachea", "Sabon Gari / Other", " ", None, "Kastina"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for level in ("lga", "state"):
        got = {r["value"]: {k: r[k] for k in ("kind", "canonical", "suggestion", "note")} for r in domains.check_places(df, "v", level).collect()}
        assert got == {v: domains.Places().check(v, level) for v in values if v and v.strip()}


def test_currencies_countries_and_subdivisions(spark):
    codes = {"NG-KN": "Kano", "NG-KD": "Kaduna", "US-WA": "Washington", "XX-WA": "washington"}
    d = domains.Domains(spark=spark, subdivisions=codes)
    assert d.canonical("currency", "ngn") == "NGN" and d.canonical("currency", "US Dollar") == "USD" and d.canonical("currency", "840") == "USD" and d.canonical("currency", "shells") is None
    assert d.canonical("country", "BRA") == "Brazil" and d.canonical("country", "NG") == "Nigeria" and d.canonical("country", "brazil") == "Brazil"
    assert d.canonical("subdivision", "KANO") == "NG-KN" and d.resolve("subdivision", "kano") == ("Kano", True)
    assert d.resolve("subdivision", "Washington") == ("Washington", False) and d.same("subdivision", "Washington", "WASHINGTON") and d.same("subdivision", "Kano", "Kaduna") is False
    assert d.detect(["NGN", "usd", "Euro", "?"], "Curr") == "currency" and d.detect(["a", "b"], "Curr") is None
    df = spark.createDataFrame([(x,) for x in ["NGN", "USD", "EUR", "zzz", None, ""]], "Currency string")
    assert d.detect_column(df, "Currency") == "currency" and d.looks_like(df, "Currency", "currency") == 0.75
    assert d.looks_like(df.limit(0), "Currency", "currency") == 0.0 and d.detect_column(df.limit(0), "Currency") is None


def test_predict_file(spark):
    said = knowledge.Corrections()
    for raw, state in (("Port Harcourt", "RIVERS"), ("Ibadan", "OYO"), ("Onitsha", "ANAMBRA")):
        said.say("state", raw, state)
    said.say("state", "Abuja(Jos)", "FCT", "PLATEAU")
    places = ["Port Harcourt", "Ibadan", "Onitsha", "Lagos", "Abuja(Jos)", "Lagos", "Lagos", "Lagos"]
    rows = [(str(10_000_000_000 + i), ["M", "F", "1", "2"][i % 4], ["a@x.com", "b@y.org", "bad", "c@z.net"][i % 4], places[i % 8]) for i in range(40)]
    got = {f["column"]: f for f in headers.predict_file(spark.createDataFrame(rows, "NIN string, Sex string, Email string, `State of Origin` string"), said)}
    assert got["Sex"]["name"] == "Gender" and got["Sex"]["type"] == "gender" and got["Email"]["type"] == "email"
    assert got["NIN"]["type"] == "identifier" and any("NIN" in q and "BVN" in q for q in got["NIN"]["questions"])
    state = got["State of Origin"]
    assert state["name"] == "State" and state["type"] == "geo" and state["details"]["learned"] == 3 and state["details"]["conflicts"] == [("Abuja(Jos)", ["FCT", "PLATEAU"])]


@pytest.mark.parametrize("chunk", [3, 4096])
def test_close_pairs_by_brute_force(spark, chunk):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(100, [0.0, 0.0, 0.0]), (101, None), (None, [1.0, 0.0, 0.0]), (102, [1.0, None, 0.0]), (103, [1.0, 2.0]), (104, [2.0, 4.1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, vector array<double>, a string")
    good = {i: np.array(v) for i, v in rows if i is not None and v and all(x is not None for x in v) and any(v)}
    near = lambda a, b: len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.62
    assert {(r["a"], r["b"]) for r in embeddings.close_pairs(df, chunk=chunk).collect()} == {(a, b) for a in good for b in good if a < b and near(a, b)}
    asked = embeddings.close_pairs(df, queries=df.where("id % 5 = 0"), chunk=chunk)
    assert {(r["a"], r["b"]) for r in asked.collect()} == {(a, b) for a in good for b in good if a != b and a % 5 == 0 and near(a, b)}
    assert embeddings.close_pairs(df.limit(0)).count() == 0


def test_semantic_pairs(spark):
    df = spark.createDataFrame([(x,) for x in ["Ikeja market", "Ikeja markt", "Groceries", "Provisions", None, " "]], "v string")
    assert [(r["a"], r["b"]) for r in embeddings.semantic_pairs(df, "v").collect()] == [("Ikeja market", "Ikeja markt")]


def test_headers():
    assert headers.is_abnormal("column_3_no_header") and headers.is_abnormal("2020-01-01") and not headers.is_abnormal("Age")
    assert headers.readable("date_of_birth") == "Date of Birth" and headers.readable("hh_id") == "Household ID"
    plan = headers.propose_plan(["Ph No", "D.O.B", "Surnam", "weird"])
    assert [m["target_field"] for m in plan["mappings"]] == ["phone", "date_of_birth", "surname"] and plan["unmapped"] == ["weird"]
    assert len(flows.flow("outliers")) == 4 and len(flows.flow("else")) == 1


def test_language(values):
    got = values(["the cat and the dog of it", "der Hund und die Katze", "el perro y los gatos", "le chat et les chiens", "x"], language.detect)
    assert got == ["en", "de", "es", "fr", None]


def test_classifier_rescues_messy_numbers(spark):
    model = typeclf.train(spark, per_kind=40, trees=60)
    df = spark.createDataFrame([(x,) for x in ["23", "45", "n/a", "forty", "31", "28", "see note", "52", "19", "61", "x1", "33", "?", "27"]], "age string")
    found = typeclf.predict(model, typeclf.column_features(df)).first()
    assert found["kind"] in ("numeric", "identifier")
    soft = [profile.ColumnProfile("age", "categorical", 0.8, "auto_categorical", {}, {"id_len": 2})]
    out = typeclf.rescue(soft, typeclf.predict(model, typeclf.column_features(df)))
    assert out[0].semantic_type in ("numeric", "categorical", "identifier")
