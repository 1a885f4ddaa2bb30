import json

import pytest
from pyspark.sql import functions as F

from plumbline import api
from plumbline.__main__ import main
from plumbline.sources import export, files, router, sniff
from plumbline.streaming import streams


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_banner_semicolons_and_ragged_rows(spark, tmp_path):
    df, report = router.read_any(spark, put(tmp_path, "a.csv", "Report 2020\n\nid;full name;state;empty\n1;Ann;Lagos;\n2;Bob\n3;\"C;d\";Kano;\n"))
    assert df.columns == ["id", "full name", "state"] and report.delimiter == ";" and report.header_row == 3 and report.skipped_rows[0] == ["Report 2020"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "Ann", "Lagos"), ("2", "Bob", ""), ("3", "C;d", "Kano")]


def test_utf16_and_two_header_rows(spark, tmp_path):
    df, report = router.read_any(spark, put(tmp_path, "b.csv", "name,age\nÉva,3\nZoë,4\n".encode("utf-16")))
    assert sorted(r["name"] for r in df.collect()) == ["Zoë", "Éva"] and report.encoding == "utf-16"
    df, _ = router.read_any(spark, put(tmp_path, "c.csv", "Region,Sales,,Staff\n,total,part,total\nNorth,10,2,5\nSouth,20,3,6\nEast,30,4,7\n"))
    assert df.columns == ["Region", "Sales - total", "Sales - part", "Staff - total"] and df.count() == 3


def test_json(spark, tmp_path):
    nested = {"rows": [{"id": 1, "person": {"name": "A", "age": 3}}, {"id": 2, "person": {"name": "B"}}]}
    df, _ = router.read_any(spark, put(tmp_path, "d.json", json.dumps(nested)))
    assert df.columns == ["id", "person.age", "person.name"] and df.where("`person.age` = ''").count() == 1
    assert router.read_any(spark, put(tmp_path, "e.ndjson", '{"a":1}\n{"a":2}\n'))[0].count() == 2


def test_workbook_round_trip(spark, tmp_path):
    people = spark.createDataFrame([("1", "A & <b>"), ("2", "B")], "id string, name string")
    ledger = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "code string, amt string")
    path = str(tmp_path / "w.xlsx")
    export.to_xlsx({"people": people, "ledger": ledger, "notes": spark.createDataFrame([("n",)], "note string")}, path)
    sheets = files.read_all_sheets(spark, path)
    assert list(sheets) == ["people", "ledger", "notes"] and sheets["people"][0].where("name = 'A & <b>'").count() == 1 and sheets["ledger"][0].count() == 3
    assert files.read_excel(spark, path)[1].sheet == "ledger"
    export.to_docx(people, str(tmp_path / "w.docx"))
    assert export.sheet_names(["a" * 40, "A" * 40]) == ["a" * 31, "A" * 29 + "_2"]
    with pytest.raises(ValueError):
        router.read_any(spark, "x.pdf")
    with pytest.raises(ValueError):
        export.export(people, "x", "odt")


def test_sniffing():
    assert sniff.orientation([["Name", "A", "B", "C", "D", "E"], ["Age", "1", "2", "3", "4", "5"], ["City", "x", "y", "z", "u", "v"]]) == "transposed"
    assert sniff.orientation([["Name:", ""], ["", ""], ["Phone:", ""], ["", ""], ["Email:", ""]]) == "form"
    assert sniff.orientation([["a", "b"], ["1", "2"], ["3", "4"]]) == "normal"
    assert sniff.names(["a", "", "a", "44197", "a"]) == ["a", "column_1_no_header", "a_1", "2021-01-01", "a_2"]


def test_clean_workflow_and_command_line(spark, tmp_path, capsys):
    path = put(tmp_path, "people.csv", "BenID,Phone,Active\n" + "".join(f"B{i:03d},0803123{i:04d},{'yes' if i % 2 else 'no'}\n" for i in range(30)))
    session = api.clean(spark, path, "NG")
    assert session.run.table.where("Phone like '+234%'").count() == 30 and session.overview().count() > 0
    plan = put(tmp_path, "plan.json", json.dumps({"name": "p", "mappings": [{"source_column": "Phone", "target_field": "phone", "transform": "phone_ng", "params": {}}]}))
    assert main(["clean", path, "--plan", plan, "--out", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out" / "people_audit.json").exists()
    assert main(["clean", str(tmp_path / "nope.csv"), "--plan", plan]) == 2
    assert main(["transforms"]) == 0 and "phone_ng" in capsys.readouterr().out
    assert api.structure(session.table)["rows"] == 30 and api.get_region("??").key == "GENERIC"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(50).select(F.col("id"), F.concat(F.lit(" a"), F.col("id") % 5).alias("v"), F.timestamp_seconds(F.col("id") * 60).alias("ts")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    plan = {"mappings": [{"source_column": "v", "target_field": "V", "transform": "upper"}]}
    streams.run_plan_stream(stream, plan, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("V like 'A%'").count() == 50
    kept = streams.dedupe_stream(stream, ["v"], "ts", "10 hours").writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    kept.awaitTermination()
    assert spark.table("kept").count() == 5
    with pytest.raises(ValueError):
        streams.plan_stream(stream, {"mappings": [{"source_column": "v", "target_field": "v", "transform": "auto_categorical"}]})
    streams.vocabulary_sink("v", str(tmp_path / "voc"))(spark.read.parquet(src), 0)
    assert spark.read.parquet(str(tmp_path / "voc")).count() == 5
