import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import reshape
from plumbline.functions import text as X
from plumbline.functions import values as V
from plumbline.operators import transforms as T

FLAGGED = {
    "nin": ([" 123 456 789 01 ", "3456789", None], [("12345678901", False), ("3456789", True), ("", True)], {}),
    "fixed_id": (["ENR168029", "12", ""], [("168029", False), ("12", True), ("", True)], {"length": 6}),
    "phone_ng": (["08031234567", "+234 803 123 4567", "2348031234567", "8031234567", "12345", "abc", ""], [("+2348031234567", False)] * 4 + [("12345", True), ("abc", True), ("", True)], {}),
    "phone": (["0712345678", "+14155552671"], [("+254712345678", False), ("+14155552671", False)], {"region": "KE"}),
    "state_ng": (["Kastina", "abuja", "Kaduna(Kastina)", "Atlantis", "No State"], [("KATSINA", False), ("FCT", False), ("KADUNA", False), ("Atlantis", True), ("", True)], {}),
    "lga_ng": (["sabongari", "ZariaTudunWada", "zzz", ""], [("Sabon Gari", False), ("Zaria", True), ("zzz", True), ("", True)], {}),
    "date_iso": (["3/9/1990", "1998-04-12", "2021-13-01", "44562.5", "2 Jan 1999", "x", ""], [("1990-09-03", False), ("1998-04-12", False), ("2021-13-01", True), ("2022-01-01", False), ("1999-01-02", False), ("x", True), ("", True)], {"dayfirst": True}),
    "datetime_iso": (["2021-02-03 4:05", "2021-13-01 10:00", "3/4/2020 1:02:03 PM"], [("2021-02-03 04:05:00", False), ("2021-13-01 10:00", True), ("2020-03-04 13:02:03", False)], {}),
    "name": (["MARY-JANE", "o'brien", "  abiola   t. ", "ludwig VAN beethoven", "mcdonald", ""], [("Mary-Jane", False), ("O'Brien", False), ("Abiola T.", False), ("Ludwig van Beethoven", False), ("McDonald", False), ("", True)], {}),
    "gender": (["Male", "GIRL", "x", ""], [("M", False), ("F", False), ("x", True), ("", True)], {}),
    "boolean": (["y", "FALSE", "maybe"], [("Yes", False), ("No", False), ("maybe", True)], {}),
    "email": (["A@B.co ", "bad", "a..b@c.de"], [("a@b.co", False), ("bad", True), ("a..b@c.de", True)], {}),
    "numeric": (["1 200,50", "₦2,500.00", "(200)", "45%", "42.959", "-81.0", "free", "1,234,567"], [("1200.5", False), ("2500", False), ("-200", False), ("45", False), ("42.959", False), ("-81", False), ("free", True), ("1234567", False)], {}),
    "sentinel_na": (["999", "-99", "don't know", "5"], [("", True), ("", True), ("", True), ("5", False)], {}),
    "range_check": (["200", "-5", "50", "x", ""], [("200", True), ("-5", True), ("50", False), ("x", True), ("", False)], {"min": 0, "max": 120}),
    "latitude": (["6°27'N", "200", "x"], [("6.45", False), ("200", True), ("x", True)], {}),
    "longitude": (["30.123W", "190"], [("-30.123", False), ("190", True)], {}),
    "text_normalise": (["Ã©cole", "“x”—y", "école â"], [("école", False), ('"x"-y', False), ("école â", False)], {}),
    "text_clean": (["N/A", " a ​ b "], [("", False), ("a b", False)], {}),
}


@pytest.mark.parametrize("name", sorted(FLAGGED))
def test_anchors(transformed, name):
    items, expected, params = FLAGGED[name]
    assert [(v, f) for v, f, _ in transformed(name, items, **params)] == expected


def test_flags_have_reasons(transformed):
    assert all(bool(r) == f for _, f, r in transformed("nin", ["1", "12345678901", ""]))


def test_units(transformed):
    assert transformed("unit_numeric", ["3200g", "banana", "12"])[0][:2] == ("3200", False)
    assert [v for v, _, _ in transformed("unit_numeric", ["3200g"], to="kg")] == ["3.2"]
    assert transformed("unit_numeric", ["5 l"], to="kg")[0][1]


def test_decimal_comma(transformed):
    assert [v for v, _, _ in transformed("numeric", ["1.234,56", "12,5", "1.234"], decimal="comma")] == ["1234.56", "12.5", "1234"]


def test_unknown_transform():
    with pytest.raises(KeyError):
        T.get_transform("nope")
    assert len(T.list_transforms()) >= 23


def test_own_transform(transformed):
    @T.register("reversed")
    def backwards(raw, clean, let):
        return T.decide(otherwise=F.reverse(clean))

    assert transformed("reversed", ["abc"]) == [("cba", False, "")]


def test_text(values):
    assert values(["Ab-12"], X.mask) == ["Xx-99"]
    assert values(["123", "abc", "1.5", "a1", ""], X.shape) == ["[3 digits]", "[3 letters]", "[number]", "[mixed]", "[empty]"]
    assert values(["a\nb", "c\rd\x01"], X.export_safe) == ["a b", "cd"]
    assert values(["call 08031234567, a@b.com, a@b.com"], lambda c: X.extract(c, "email")) == [["a@b.com"]]
    keys = values(["Drinks, Water & Wine", "drinks water and wine", "6-10 years", "21-25 years", "7.0", "7", "-1", "1"], X.canonical_key)
    assert keys[0] == keys[1] and keys[2] != keys[3] and keys[4] == keys[5] and keys[6] != keys[7]
    assert values(["drinks and NGO food"], X.label) == ["Drinks & NGO Food"]
    assert values(["12345678.5", "100", "0.00001", "42.959"], lambda c: X.number_text(c.cast("double"))) == ["12345678.5", "100", "0.00001", "42.959"]


def test_dates(values):
    got = values(["25/03/1990", "12.05.99", "Mar 5, 2020", "5th March 71", "March 2020", "31/02/2020"], lambda c: V.parse_date(X.clean(c), "DMY", 2030))
    assert got == [datetime.date(1990, 3, 25), datetime.date(1999, 5, 12), datetime.date(2020, 3, 5), datetime.date(1971, 3, 5), datetime.date(2020, 3, 1), None]


def test_reshape(spark):
    df = spark.createDataFrame([("ADEYEMI, Tunde", "Musa 34", "(6.45; 3.39)", "Lagos, Nigeria"), ("Tunde Adeyemi", "1,200 kg", "6.45 3.39", "Lagos")], "a string, b string, c string, d string")
    row = df.select(*reshape.split_name("a"), *reshape.split_number_text("b"), *reshape.split_geopoint("c"), *reshape.split_by_delimiter("d"), reshape.merge_columns(["d", F.lit(" "), "b"], "/")).collect()
    assert tuple(row[0]) == ("Tunde", "Adeyemi", "Musa", "34", "6.45", "3.39", "Lagos", "Nigeria", "Lagos, Nigeria/Musa 34")
    assert tuple(row[1]) == ("Tunde", "Adeyemi", "kg", "1200", "6.45", "3.39", "Lagos", None, "Lagos/1,200 kg")
