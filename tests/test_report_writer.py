"""The report source: one atomic document, nothing left behind."""

import json
import os

import pytest
from codeloom.sources import report_writer as rw
from pyspark.sql import functions as F


def results(spark, n, parts=5):
    rows = [(f"r{i % 3}" if i % 7 else None, json.dumps({"ruleId": i, "text": "é\n\"x\""}, ensure_ascii=False)) for i in range(n)]
    return spark.createDataFrame(rows, "rule_id string, result string").repartition(parts)


def test_sarif_and_findings(spark, tmp_path):
    path = str(tmp_path / "r.sarif")
    rw.write_report(results(spark, 40), path, tool="t", version="2")
    run = json.load(open(path))["runs"][0]
    assert sorted(r["ruleId"] for r in run["results"]) == list(range(40)) and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["", "r0", "r1", "r2"]
    rw.write_report(results(spark, 10).repartitionByRange(3, "result").sortWithinPartitions("result"), path, layout="findings")
    doc = json.load(open(path))
    assert [f["ruleId"] for f in doc["findings"]] == list(range(10)) and doc["statistics"]["total"] == 10 and sum(doc["statistics"]["by_rule"].values()) == 10
    assert os.listdir(tmp_path) == ["r.sarif"]


def test_empty_and_null_results(spark, tmp_path):
    path = str(tmp_path / "e.json")
    rw.write_report(results(spark, 3).limit(0), path)
    assert json.load(open(path))["runs"][0]["results"] == []
    rw.write_report(results(spark, 3).withColumn("result", F.lit(None).cast("string")), path, layout="findings")
    assert json.load(open(path))["findings"] == []


def test_a_failed_task_leaves_the_old_report(spark, tmp_path):
    path = str(tmp_path / "r.json")
    rw.write_report(results(spark, 4), path)
    before = open(path).read()
    broken = results(spark, 30).withColumn("result", F.when(F.length("result") > 0, F.concat("result", F.when(F.rand() >= 0, F.raise_error(F.lit("stop"))).cast("string"))))
    with pytest.raises(Exception, match="stop"):
        rw.write_report(broken, path)
    assert open(path).read() == before and os.listdir(tmp_path) == ["r.json"]


def test_existing_reports_and_links(spark, tmp_path):
    path = str(tmp_path / "r.json")
    rw.write_report(results(spark, 1), path)
    with pytest.raises(Exception, match="FileExists"):
        rw.write_report(results(spark, 2), path, mode="append")
    os.symlink(path, tmp_path / "link.json")
    with pytest.raises(Exception, match="is a link"):
        rw.write_report(results(spark, 2), str(tmp_path / "link.json"))
    with pytest.raises(Exception, match="layout"):
        rw.write_report(results(spark, 2), path, layout="other")
    assert len(json.load(open(path))["runs"][0]["results"]) == 1
