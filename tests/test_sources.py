import json
import zipfile

import pytest

from kinmesh.plans import runner
from kinmesh.sources import readers, sinks
from kinmesh.streaming.windows import sliding_counts


def workbook(path, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cell = lambda c, r, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else ""
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>")


def test_formats(spark, tmp_path):
    head = "account_id,email,phone,first_name,last_name,dob,device_id,city,country"
    (tmp_path / "app_users.csv").write_text("﻿" + head + '\nA1,a@x.test,1,"Ada\nsecond ""line""",L,,d,c,IN\nA1,b@x.test,,,,,,,\n', encoding="utf-8")
    df = readers.read_source(spark, str(tmp_path), "app_users").orderBy("record_ordinal").collect()
    assert [(r.record_ordinal, r.source_record_id) for r in df] == [(1, "A1"), (2, "A1")] and df[0].first_name == 'Ada\nsecond "line"'
    (tmp_path / "ticketing.jl").write_text('{"booking_id":"B1","account_id":"1","full_name":"x","email":"e","phone":"p","device_id":"d","city":"c"}\n\n')
    assert readers.read_source(spark, str(tmp_path), "ticketing").count() == 1
    (tmp_path / "social_logins.json").write_text(json.dumps([{"provider": "google", "identity_payload": {"provider_id": "g1", "verified_email": "v@x.test"}}, {"provider": "x", "identity_payload": {"provider_id": "g2", "phone": "1"}}]))
    flat = readers.flat(readers.read_source(spark, str(tmp_path), "social_logins"), "social_logins")
    assert {r.source_record_id: (r["identity_payload.verified_email"], r["identity_payload.phone"], r["identity_payload.city"]) for r in flat.collect()} == {"g1": ("v@x.test", None, None), "g2": (None, "1", None)}
    workbook(tmp_path / "subscriptions.xlsx", {"notes": [["n"]], "subscriptions": [["title"], ["subscription_id", "email", "subscriber_name", "billing_name", "payment_token", "country"], ["S1", "e", "n", None, "t", "IN"], [None, None]]})
    got = readers.read_source(spark, str(tmp_path), "subscriptions").collect()
    assert [(r.source_record_id, r.billing_name, r.country) for r in got] == [("S1", None, "IN")]
    (tmp_path / "app_users.csv").write_text("account_id,email\n1,2\n")
    with pytest.raises(readers.SourceError, match="missing"):
        readers.read_source(spark, str(tmp_path), "app_users")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, ["a", "b"]) for i in range(50)], "i int, x array<string>")
    assert sinks.content_hash(df) == sinks.content_hash(df.repartition(7)) != sinks.content_hash(df.where("i > 0"))
    sinks.export_csv(df, str(tmp_path / "out"), ["i"])
    sinks.export_csv(df, str(tmp_path / "one"), ["i"], single=True)
    assert len(list((tmp_path / "one").glob("*.gz"))) == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().x == "a;b"
    sinks.write_manifest(spark, str(tmp_path / "m.json"), {"a": 0})
    sinks.write_manifest(spark, str(tmp_path / "m.json"), {"a": 1})
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1}
    assert sinks.remove_stale(spark, str(tmp_path / "m.json"), str(tmp_path / "none")) == [str(tmp_path / "m.json")] and not (tmp_path / "m.json").exists()
    text = sinks.report("R", {"a": df.limit(1), "b": "words"})
    assert text.startswith("# R") and "| i | x |" in text and "## b" in text and sinks.markdown_table([{"a": "x|y"}]).endswith("| x\\|y |")


def test_plan(spark, sf_dir, tmp_path):
    runner.check_plan(runner.plan())
    assert all(r == {"planned": True} for r in runner.execute(spark, sf_dir, dry=True).done.values())
    with pytest.raises(runner.PlanError):
        runner.check_plan(runner.plan()[::-1])
    steps = [runner.Step("a", lambda s: 1), runner.Step("b", lambda s: 1 / 0), runner.Step("c", lambda s: 1)]
    with pytest.raises(runner.PlanError, match="b failed"):
        runner.execute(spark, sf_dir, str(tmp_path / "m.json"), steps)
    assert list(json.loads((tmp_path / "m.json").read_text())["steps"]) == ["a", "b"]


def test_stream(spark, tmp_path):
    rows = [("a", f"2026-01-01 00:{m:02d}:00") for m in (0, 1, 2, 30)]
    spark.createDataFrame(rows, "source string, t string").selectExpr("source", "cast(t as timestamp) ts").write.parquet(str(tmp_path / "in"))
    stream = sliding_counts(spark.readStream.schema("source string, ts timestamp").parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg({"n": "max"}).first()[0] == 3
