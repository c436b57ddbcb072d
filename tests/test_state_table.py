"""The versioned state table: identity, resets, conflicts, corrupt rows and manifests."""

import glob
import json

import pytest
from codeloom.operators import state_table as st


def rows(spark, *r):
    return spark.createDataFrame(list(r), "unit string, code_digest string, state string, is_error boolean")


def held(table):
    return {r.unit: (r.code_digest, r.state, r.version) for r in table.read().collect()}


def test_versions_and_resume(spark, tmp_path):
    t = st.StateTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="sync"):
        t.append(rows(spark, ("a", "1", "x", False)))
    assert t.sync("A") == "new" and t.sync("A") == "match" and held(t) == {}
    assert t.append(rows(spark, ("a", "1", "x", False), ("b", "1", None, True), ("c", None, "z", None), (None, "1", "x", False))) == 2
    assert t.append(rows(spark, ("a", "2", "y", False))) == 3
    assert held(t) == {"a": ("2", "y", 3), "b": ("1", None, 2), "c": (None, "z", 2)}
    units = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "unit string, code_digest string")
    assert {(r.unit, r.code_digest): (r.status, r.state) for r in t.resume(units).collect()} == {("a", "2"): ("adopted", "y"), ("a", "1"): ("changed", None), ("b", "1"): ("failed", None), ("c", None): ("adopted", "z"), ("d", "1"): ("new", None)}
    assert [r.unit for r in t.gone(units.where("unit <> 'b'")).collect()] == ["b"]


def test_another_identity_archives(spark, tmp_path):
    t = st.StateTable(spark, str(tmp_path / "t"))
    t.sync("A")
    t.append(rows(spark, ("a", "1", "x", False)))
    assert t.sync("B") == "reset" and held(t) == {}
    assert len(t.latest().archived) == 1 and glob.glob(f"{tmp_path}/t/data/{t.latest().archived[0]}/*.parquet")
    t.append(rows(spark, ("b", "1", "y", False)))
    assert t.sync("A") == "reset" and held(t) == {} and len(t.latest().archived) == 2


def test_legacy_rows_are_adopted(spark, tmp_path):
    t = st.StateTable(spark, str(tmp_path / "t"))
    t.sync("A")
    t.append(rows(spark, ("a", "1", "x", False)))
    for f in glob.glob(f"{tmp_path}/t/log/*") + glob.glob(f"{tmp_path}/t/log/.*.crc"):
        __import__("os").unlink(f)
    assert t.sync("B") == "legacy" and list(held(t)) == ["a"] and t.sync("B") == "match"


def test_an_unreadable_manifest_lends_nothing(spark, tmp_path):
    t = st.StateTable(spark, str(tmp_path / "t"))
    t.sync("A")
    t.append(rows(spark, ("a", "1", "x", False)))
    for text in ("{", "[]", json.dumps({"identity": "A"})):
        (tmp_path / "t" / "log" / f"{t.latest().number + 1:012d}.json").write_text(text)
        assert held(t) == {}
        with pytest.raises(ValueError, match="sync"):
            t.append(rows(spark, ("b", "1", "x", False)))
        assert t.sync("A") == "reset" and held(t) == {} and len(t.latest().archived) == 1


def test_corrupt_rows_are_pending_again(spark, tmp_path):
    t = st.StateTable(spark, str(tmp_path / "t"))
    t.sync("A")
    t.append(rows(spark, ("a", "1", "x", False), ("b", "1", "y", False)))
    name = t.latest().snapshots[0]
    changed = spark.read.schema(st.SCHEMA).parquet(f"{tmp_path}/t/data/{name}").replace({"y": "forged"}, subset=["state"]).collect()
    spark.createDataFrame(changed, st.SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/t/data/{name}")
    assert list(held(t)) == ["a"] and [r.unit for r in t.corrupt().collect()] == ["b"]


def test_two_writers_cannot_publish_one_version(spark, tmp_path):
    one, two = (st.StateTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.sync("A")
    seen = two.latest()
    one.append(rows(spark, ("a", "1", "x", False)))
    two.latest = lambda: seen
    with pytest.raises(st.Conflict):
        two.append(rows(spark, ("b", "1", "y", False)))
    assert list(held(one)) == ["a"]
