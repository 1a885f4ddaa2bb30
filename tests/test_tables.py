import pytest
from pyspark.sql import functions as F

from plumbline.operators import distribution, duplicates, joins, names, outliers, privacy, quality, review, toolkit
from plumbline.plans.components import connected_components
from plumbline.plans.plan import run_plan
from plumbline.plans.ranks import numbered


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("Ann", "Lagos", 1.0), (" ann", "LAGOS ", 1.0), ("Bob", "", 2.0), ("", "..", None), ("", "NA", None), ("bob", None, 2.0)], "name string, state string, x double")


def test_duplicates_ignore_blank_rows(people):
    found, summary = duplicates.find_duplicates(people)
    assert summary == {"duplicate_groups": 2, "rows_involved": 4}
    assert {r["_dup_group"] for r in found.collect()} == {"G1 (exact)", "G2 (exact)"}


def test_dedupe(people):
    assert duplicates.dedupe_file(people)[1] == {"removed": 2, "remaining": 4}
    kept = {r["name"] for r in duplicates.dedupe(people, ["name"], "complete").collect()}
    assert "Bob" in kept and "bob" not in kept
    with pytest.raises(ValueError):
        duplicates.dedupe(people, keep="any")


def test_wide_sparse_rows_are_no_duplicates(spark):
    rows = [("A", "s1", "..", ".."), ("B", "s1", "..", ".."), ("C", "s1", "..", ".."), ("D", "s1", "..", "..")]
    df = spark.createDataFrame(rows, "country string, series string, y1 string, y2 string")
    assert duplicates.find_duplicates(df)[1]["duplicate_groups"] == 0
    assert duplicates.find_duplicates(df.unionByName(df.limit(1)))[1]["rows_involved"] == 2


def test_columns_and_fields(spark):
    assert duplicates.duplicate_columns(["Others (specify)", "Others (specify).1", "Age"]) == [["Others (specify)", "Others (specify).1"]]
    df = spark.createDataFrame([(f"a{i}", f"a{i}", f"q{i}") for i in range(6)], "RAW_name string, column_3_no_header string, other string")
    assert duplicates.duplicate_fields(df) == [{"columns": ["RAW_name", "column_3_no_header"], "keep": "RAW_name", "overlap": 1.0}]


def test_outliers(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([10, 11, 12, 10, 11, 12, 13, 9, 10, 11, 900])], "id int, income double")
    assert [r["id"] for r in outliers.find_outliers(df, ["income"]).collect()] == [10]
    e = outliers.evaluate(df, ["income"]).first()
    assert e["suggested_method"] == "IQR" and e["shape"] == "right-skewed" and e["count"] == 11
    assert outliers.treat(df, "income", "remove").count() == 10
    assert outliers.treat(df, "income", "cap").agg(F.max("income")).first()[0] == 15.0
    assert outliers.treat(df, "income", "keep").where("_outlier").count() == 1
    assert outliers.evaluate(df.limit(3), ["income"]).first()["note"]


def test_match_and_compare(spark):
    a, b = spark.createDataFrame([(1, 20), (2, 30), (3, 40)], "NIN int, age int"), spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "nin int, lga string")
    out, summary = toolkit.run("match", [a, b], how="inner")
    assert summary["key_detected"] == "NIN" and summary["rows"] == 2 and out.columns == ["_key", "age", "lga"]
    assert toolkit.run("match", [a, b])[1]["rows"] == 4
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), spark.createDataFrame([(2, "B"), (3, "c")], "id int, name string")
    assert toolkit.run("compare", [old, new], key="id")[1] == {"added": 1, "removed": 1, "changed": 1}
    with pytest.raises(Exception, match="repeated key"):
        joins.compare(old.unionByName(old), new, "id").collect()
    both = joins.combine([old, new.withColumn("more", F.lit("m"))])
    assert both.count() == 4 and both.columns[0] == "_source_file" and both.where("more = ''").count() == 2


def test_null_keys_match_as_text(spark):
    a = spark.createDataFrame([(None, 1)], "k string, x int")
    assert joins.match([a, a.withColumnRenamed("x", "y")], "inner", "k").count() == 1
    assert joins.match([a, a.withColumnRenamed("x", "y")], "inner", "k", null_matches=False).count() == 0


def test_validate_and_summarise(spark):
    df = spark.createDataFrame([("bad", " "), ("a@b.co", "x")], "email string, name string")
    found = quality.validate(df, [quality.Rule("email", "email"), quality.Rule("name", "required")], ["email"])
    assert {(r["column"], r["issue"]) for r in found.collect()} == {("email", "invalid email"), ("name", "required value missing")}
    s = {r["column"]: r for r in quality.summarise(df).collect()}
    assert s["name"]["missing_pct"] == 50.0 and s["name"]["example"] == "x"


def test_distribution(spark):
    df = spark.createDataFrame([("Lagos", "1"), ("Lagos", "2"), ("Lagos", "3"), ("Lagos", "2"), ("Kano", "1"), ("Kano", "2"), ("Oyo", "900"), ("-", "-")], "state string, score string")
    found = {p["column"]: p for p in distribution.distribution_profile(df)}
    assert found["score"]["kind"] == "numeric" and found["score"]["outliers"] == 1 and sum(b["count"] for b in found["score"]["histogram"]) == 7
    assert found["state"]["kind"] == "categorical" and found["state"]["top"][0] == {"value": "Lagos", "count": 4} and found["state"]["missing"] == 1
    assert distribution.histogram(spark.createDataFrame([(5.0,)] * 3, "x double"), "x").collect()[0]["count"] == 3


def test_review_and_decisions(spark):
    df = spark.createDataFrame([("ann", "x"), ("BOB", "x"), ("bob", "y")], "name string, kind string")
    plan = {"mappings": [{"source_column": "name", "target_field": "name", "transform": "name"}]}
    run = run_plan(df, plan)
    assert {(r["before"], r["after"]) for r in review.column_overview(run).collect()} == {("ann", "Ann"), ("BOB", "Bob"), ("bob", "Bob")}
    assert review.spotcheck(run, 2, 1).count() == 2
    out, audit = review.apply_decisions(df, plan, review.Decisions(set_all={"kind": "z"}, remove_duplicates=True))
    assert out.count() == 2 and len(audit) == 2
    assert review.apply_decisions(df, plan, review.Decisions(reject=["name"]))[0].where("name = 'BOB'").count() == 1
    ledger = review.Ledger()
    ledger.note_safe("trim", "name")
    ledger.propose("merge", "kind"), ledger.propose("merge", "name")
    assert ledger.summary()["needs_approval"] == 2 and len(ledger.pending()) == 2


def test_plan_run(spark):
    df = spark.createDataFrame([("1", "kano", "k1"), ("12345678901", "zzz", "k2")], "nin string, state string, other string")
    run = run_plan(df, {"name": "p", "mappings": [{"source_column": "nin", "target_field": "NIN", "transform": "nin"}, {"source_column": "state", "target_field": "State", "transform": "state_ng"}, {"source_column": "gone", "target_field": "x", "transform": "upper", "params": {"pivot": 1}}]})
    assert run.table.columns == ["NIN", "State", "other", "flagged"] and run.table.where("flagged").count() == 2
    report = run.report()
    assert report["errors"][0]["source_column"] == "gone" and {c["target_field"]: c["flagged"] for c in report["columns"]} == {"NIN": 1, "State": 1}


def test_privacy(spark):
    df = spark.createDataFrame([("0803-A",), ("0804-B",)], "phone string")
    assert privacy.build_column_query(df, "phone")["values"] == ["9999-X"]
    assert privacy.build_column_query(df, "phone", mode="labels_only")["values"] == []
    with pytest.raises(ValueError):
        privacy.build_column_query(df, ["phone"])


def test_gender_estimates(spark):
    df = spark.createDataFrame([("Ann Lee",), ("Zed Q",)], "full_name string")
    table = spark.createDataFrame([("ann", "F", 0.9), ("zed", "M", 0.5)], "name string, gender string, share double")
    out, _ = names.guess_gender(df, table)
    assert [r["full_name_gender_estimate"] for r in out.orderBy("full_name").collect()] == ["F", ""]
    assert "note" in names.guess_gender(df, None)[1]


def test_components_and_ranks(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    home = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert {home[i] for i in range(41)} == {0} and home[101] == 100 and 7 in home
    assert connected_components(chain.limit(0)).count() == 0
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r["v"] + 1 == r["n"] for r in numbered(df, [F.asc("v")], "n").collect())


def test_hub_edges_are_split_over_tasks(spark):
    """A third of all edges at one node: the join with the minima must not be one task's."""
    from plumbline.plans import components

    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        hub, rest = spark.range(1, 100_001, 1, 8), spark.range(1_000_000, 1_040_000, 1, 8).selectExpr("id + 1 AS a", "id AS b")
        for star, spokes in ((components._large_star, hub.selectExpr("id AS a", "0L AS b")), (components._small_star, hub.selectExpr("200000L AS a", "id AS b"))):
            out, _ = star(spokes.unionByName(rest))
            out.collect()
            assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_written_tables_are_deleted(spark, monkeypatch):
    from pathlib import Path

    from plumbline.plans import shared

    there = lambda df: Path(df._plumbline_path.removeprefix("file://")).exists()
    one, two = (shared.materialize(spark.range(3), label) for label in "ab")
    assert there(one) and one.count() == 3
    shared.drop(one)
    assert not there(one) and there(two)
    shared.release(spark)
    assert not there(two) and not shared._written


def test_a_cluster_must_name_its_shared_folder(spark):
    from types import SimpleNamespace

    from plumbline.plans import shared

    unset = SimpleNamespace(get=lambda *_: None)
    for master, fails in (("local[4]", False), ("local-cluster[2,1,1024]", True), ("spark://host:7077", True), ("yarn", True)):
        session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
        if fails:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                shared.shared_dir(session)
        else:
            assert shared.shared_dir(session)


def test_profiles_of_all_numeric_columns_at_once(spark):
    """Two passes for all columns say what the queries of each column say."""
    rows = [(i, float((i * 37) % 101) / 4, 5.0, None if i % 3 else float(i)) for i in range(90)] + [(1000, -50.0, 5.0, None)]
    df = spark.createDataFrame(rows, "a long, b double, same double, gaps double")
    got = {p["column"]: p for p in distribution.distribution_profile(df)}
    numeric = [c for c, p in got.items() if p["kind"] == "numeric"]
    assert {"b", "same"} <= set(numeric)
    for c in numeric:
        want = distribution.numeric_stats(df, c).first().asDict() | {"histogram": [r.asDict() for r in distribution.histogram(df, c).orderBy("bin").collect()]}
        assert {k: got[c][k] for k in want} == want
