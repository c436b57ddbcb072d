"""Index folders of failed, missing and null languages, and whole documents."""

from codeloom.sources import function_index as fi

UNITS = "language string, id string, name string, code string, unit_type string, start int, end int, class_name string"


def test_round_trip_and_stale_languages(spark, tmp_path):
    folder = str(tmp_path / "index")
    outcomes = spark.createDataFrame([("a", True), ("b", False), ("c", True), (None, True)], "language string, ok boolean")
    assert fi.read_index(spark, folder, outcomes).count() == 0
    fi.write_index(spark.createDataFrame([("a", "x", "n", "c\nd", None, 1, 2, ""), ("b", "y", None, None, "m", None, None, "K"), (None, "z", None, None, "m", None, None, "K"), ("d", "w", "n", "", None, 1, 1, None)], UNITS), folder)
    got = {r.id: r for r in fi.read_index(spark, folder, outcomes).collect()}
    assert set(got) == {"x", "z"} and got["z"].language is None
    assert tuple(got["x"].function) == ("n", "c\nd", True, "function", 1, 2, None) and tuple(got["z"].function) == ("", "", True, "m", 0, 0, "K")


def test_documents(spark):
    docs = spark.createDataFrame([('{"functions": {"a:f": {"name": "f", "startLine": 3}}}',), ("{}",), ("bad",), (None,)], "json string")
    rows = fi.functions_of_documents(docs).collect()
    assert [(r.id, r.function.name, r.function.startLine, r.function.className) for r in rows] == [("a:f", "f", 3, None)]
