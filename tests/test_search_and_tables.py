"""The trigram index and the table functions on small cases."""

import json
import random
import re

from codeloom.functions import table_functions as tf
from codeloom.operators import search_index as si


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("abcAB \n(é😀.") for _ in range(rng.choice((0, 2, 3, 40, 300))))) for i in range(80)] + [(200, None), (None, "abc"), (3, "second abc text of a node"), (201, "x" * 70_000 + "needle" + "y" * 70_000)]
    index = si.build(spark.createDataFrame(texts, "node long, text string"), str(tmp_path / "i"), pieces=65_537)
    asked = [("q1", "abc", None), ("q2", "Ab", None), ("q3", "zzz", None), ("q4", "a(", "a\\(b?"), ("q5", "needle", "x{5}needle"), ("q6", "é😀", None), ("q7", "😀é.", None), ("q8", "", "B B"), ("q9", None, "a"), ("q10", "abca", "(?i)abca")]
    queries = spark.createDataFrame(asked, "query string, literal string, pattern string")
    got = sorted(tuple(r) for r in si.search(index, queries).collect())
    hit = lambda t, lit, p: lit in t if p is None else re.search(p, t) is not None and (len(lit) < 3 or lit.lower() in t.lower())
    assert got == sorted((q, n) for q, lit, p in asked if lit is not None for n, t in texts if n is not None and t is not None and hit(t, lit, p))
    assert {r.gram for r in index.postings.where("node = 201").select("gram").collect()} >= {"xxn", "eed", "ley"}
    empty = si.build(spark.createDataFrame([], "node long, text string"), str(tmp_path / "e"))
    assert si.search(empty, queries).count() == 0


def test_usages_by_index(spark, tmp_path):
    texts = [(1, "run()\nrunner()\nx.run (1)\nrun(\nrun()"), (2, "rerun()"), (3, "a.b(1)\naxb(2)")]
    index = si.build(spark.createDataFrame(texts, "node long, text string"), str(tmp_path / "u"))
    names = spark.createDataFrame([("run",), ("a.b",), ("none",), (None,)], "name string")
    assert {(r.name, r.node): r.lines for r in si.usages(index, names).collect()} == {("run", 1): [1, 3, 4], ("a.b", 3): [1]}


def test_code_functions_in_sql(spark):
    tf.register(spark)
    code = "def run(x):\n    run (1); rerun()\n\nclass Runner:\n  fn run\n    a.run()\n    run()"
    spark.createDataFrame([(1, code), (2, None), (3, "")], "id int, code string").createOrReplaceTempView("t_code")
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert rows("SELECT id, u.* FROM t_code, LATERAL code_usages(code, 'run') u") == [(1, 1, "def run(x):"), (1, 2, "run (1); rerun()"), (1, 6, "a.run()")]
    assert rows("SELECT id, d.line, d.name FROM t_code, LATERAL code_definitions(code, 'run', true) d") == [(1, 1, "run"), (1, 5, "run")]
    assert rows("SELECT id, d.name FROM t_code, LATERAL code_definitions(code, 'RUN', false) d") == [(1, "run"), (1, "Runner"), (1, "run")]
    assert rows("SELECT id, s.* FROM t_code, LATERAL code_section(code, -3, 2) s") == [(1, 1, "def run(x):"), (1, 2, "    run (1); rerun()"), (3, 1, "")]
    assert rows("SELECT s.line FROM t_code, LATERAL code_section(code, 6, 99) s") == [(6,), (7,)]


def test_signals_in_batches(spark):
    def provider(rows):
        if any(r["code"] == "fail" for r in rows):
            raise RuntimeError("down")
        if any(r["code"] == "prose" for r in rows):
            return "no json"
        good = [{"unit_id": r["unit_id"], "kind": "entry_point", "confidence": "high", "reason": f"{len(rows)}" + "x" * 600} for r in rows]
        return json.dumps({"signals": [*good, {"unit_id": "stranger", "kind": "entry_point", "confidence": "high"}, {"unit_id": rows[0]["unit_id"], "kind": "magic", "confidence": "high"}, {"unit_id": rows[0]["unit_id"], "kind": "entry_point", "confidence": "sure"}]})

    rows = [("a", f"u{i:02}", "ok") for i in range(60)] + [("b", "u60", "fail"), ("b", "u61", "ok"), ("c", "u62", "prose"), (None, "u63", None)]
    units = spark.createDataFrame(rows, "bucket string, unit_id string, code string")
    got = tf.unit_signals(units, provider).collect()
    calls = sorted((r.bucket or "", r.call, r.unit_id, r.reason.rstrip("x")) for r in got if r.error is None)
    assert calls == sorted([("a", i // 25, f"u{i:02}", "25" if i < 50 else "10") for i in range(60)] + [("", 0, "u63", "1")])
    assert max(len(r.reason) for r in got if r.reason) == 500
    assert sorted((r.bucket, r.error.split(":")[0]) for r in got if r.error) == [("b", "RuntimeError"), ("c", "JSONDecodeError")]
    assert {r.call for r in tf.unit_signals(units.where("bucket = 'a'"), provider, batch=0).collect()} == {0}
    tf.register_signals(spark, provider, 2, "small_signals")
    units.createOrReplaceTempView("t_units")
    assert spark.sql("SELECT max(call) AS c FROM small_signals(TABLE(SELECT * FROM t_units WHERE bucket = 'a') PARTITION BY bucket ORDER BY unit_id)").first().c == 29


def test_index_tasks_grow_with_the_table(spark, tmp_path, monkeypatch):
    """Postings and joined texts are dealt to more tasks as they grow, and a gram of two pieces counts once."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(si, "POSTINGS_A_TASK", 200)
    monkeypatch.setattr(si, "CHARS_A_TASK", 400)
    texts = [(i, f"text {i} of {i * i} needle{i % 3}") for i in range(150)] + [(900, "needl" + "x" * 70_000 + "eedle1")]
    index = si.build(spark.createDataFrame(texts, "node long, text string"), str(tmp_path / "g"))
    sizes = [r.n for r in index.postings.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 800
    queries = spark.createDataFrame([("q", "needle1", None), ("r", "text 7", None)], "query string, literal string, pattern string")
    found = si.search(index, queries)
    assert sorted(map(tuple, found.collect())) == sorted((q, n) for q, lit in (("q", "needle1"), ("r", "text 7")) for n, t in texts if lit in t)
