"""Labelled cases by group, with the share that must be right: a floor under what the library understands."""

import pytest

from plumbline.operators.domains import Domains, Places
from plumbline.operators.duplicates import duplicate_groups
from plumbline.operators.profile import profile
from plumbline.operators.quality import scores
from plumbline.operators.resolve import EntityResolver
from plumbline.operators.vocabulary import induce_vocabulary


def rate(cases, f):
    return sum(f(x) == y for x, y in cases) / len(cases)


def test_countries(spark):
    d = Domains()
    cases = [("Nigeria", "Nigeria"), ("naija", "Nigeria"), ("NGA", "Nigeria"), ("Niger", "Niger"), ("ghana.", "Ghana"), (" GH ", "Ghana"), ("14 Market Road", None), ("No", None), ("Female", None), ("good morning", None), ("Epe", None)]
    df = spark.createDataFrame([(d.canonical("country", x), y) for x, y in cases], "p string, a string")
    r = scores(df, "p", "a").first()
    assert r["precision"] == 1.0 and r["recall"] >= 0.9 and r["accuracy"] >= 0.9


def test_states_and_areas():
    r = EntityResolver(Places().official["state"].values())
    assert rate([("kano", "KANO"), ("Kastina", "KATSINA"), ("Akwaibom", "AKWA IBOM"), ("Oyo state", "OYO"), ("Ibadan", None), ("xyz", None)], lambda v: r.resolve(v)[1]) >= 0.8
    a = Places()
    assert rate([("Zaria", "lga"), ("Zaria LGA", "lga"), ("Kano", "is_state"), ("Somewhere", "unknown")], lambda v: a.check(v, "lga")["kind"]) == 1.0


@pytest.mark.parametrize(("dates", "order"), [(["25/12/1991", "13/1/1990", "1/13/90"], "DMY"), (["12/25/1991", "1/30/1990"], "MDY"), (["1990/1/2", "1991/12/25"], "YMD"), (["1/2/1990", "3/4/1991"], None)])
def test_date_orders(spark, dates, order):
    p = profile(spark.createDataFrame([(x,) for x in dates], "d string"))[0]
    assert p.semantic_type == "date" and p.params.get("date_order") == order


def test_numbers_keep_apart(spark):
    df = spark.createDataFrame([(x,) for x in ("1-5 years", "6-10 years", "6-10 Years", "11+", "-1", "1", "7.0", "7")], "v string")
    assert induce_vocabulary(df, "v").select("key").distinct().count() == 6


def test_excel_dates_and_robust_cells(transformed, spark):
    assert [v for v, _, _ in transformed("date_iso", ["44197", "44562.5", "20000", "123"])] == ["2021-01-01", "2022-01-01", "1954-10-03", "123"]
    df = spark.createDataFrame([("A", "x"), (" a ", "X"), ("b", "y")], "k string, v string")
    assert duplicate_groups(df).count() == 1
