"""Sources, sinks, streams and the operators without a query, on small cases."""

import json

from pyspark.sql import functions as F

from codeloom.functions import text as fx
from codeloom.operators import graph as g
from codeloom.operators import remediation as rm
from codeloom.sources import documents, languages, python_units, sinks, tree
from codeloom.streaming import live

MAIN = '''import os
from pkg import util
from pkg.util import helper as h, gone

@app.route("/run", methods=["GET", "POST"])
def run(request):
    """Runs."""
    h(request.args)
    local()
    missing()
    return util.helper(1)

def local():
    return only_here()

class A:
    def go(self):
        return self.stop()
    def stop(self):
        return local()

pick = lambda x: x
run(None)
'''
UTIL = "def helper(x):\n    return x\n"
OTHER = "def only_here():\n    return 1\n\ndef test_it():\n    pass\n"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def repo(tmp_path):
    files = {"main.py": MAIN, "pkg/util.py": UTIL, "other.py": OTHER, "node_modules/deep/x.js": "x", "a/node_modules/y.js": "y", "tests/test_a.py": "x = 1\n", "README.md": "hi", "bad.py": b"\xff\xfe", "tool": "#!/usr/bin/env python3\nx = 1\n", "build.py": "y = 2\n", "broken.py": "def f(:\n"}
    for name, text in files.items():
        write(tmp_path / "r" / name, text)
    return str(tmp_path / "r")


def test_tree(spark, tmp_path):
    all_files = tree.files(spark, repo(tmp_path))
    found = {r.rel: r.language for r in tree.sources(all_files).collect()}
    assert found == {"main.py": "python", "pkg/util.py": "python", "other.py": "python", "tool": "python", "build.py": "python", "broken.py": "python"}
    assert "tests/test_a.py" in {r.rel for r in tree.sources(all_files, tests=True).collect()}
    assert [tuple(r) for r in tree.skipped_folders(all_files, examples=1).collect()] == [("node_modules", 2, 2, ["a/node_modules"], True)]
    assert {r.reason: r.n for r in tree.unreadable(all_files).collect()} == {"not_utf8": 1}
    assert [tuple(r)[:2] for r in tree.scan_statistics(tree.sources(all_files)).collect()] == [("python", 6)]
    assert {r.extension: r.language for r in languages.registry(spark).collect()} == languages.EXTENSIONS


def test_units_routes_and_edges(spark, tmp_path):
    units = python_units.units(tree.sources(tree.files(spark, repo(tmp_path)))).cache()
    kinds = {r.unit_id: r.unit_type for r in units.collect()}
    assert kinds["main.py:run"] == "route_handler" and kinds["main.py:A.go"] == "method" and kinds["main.py:__module__"] == "module_level"
    assert kinds["other.py:test_it"] == "test" and "main.py:pick" in kinds and not any(k.startswith("broken") for k in kinds)
    run = units.where("unit_id = 'main.py:run'").first()
    assert (run.start_line, run.end_line, run.docstring, run.parameters) == (5, 11, "Runs.", ["request"])
    assert {(r.method, r.path) for r in python_units.routes(units).collect()} == {("GET", "/run"), ("POST", "/run")}
    edges = {(r.src, r.dst) for r in python_units.call_edges(units).collect()}
    assert edges == {
        ("main.py:run", "pkg/util.py:helper"), ("main.py:run", "main.py:local"), ("main.py:local", "other.py:only_here"),
        ("main.py:A.go", "main.py:A.stop"), ("main.py:A.stop", "main.py:local"), ("main.py:__module__", "main.py:run"),
    }
    why = units.select("unit_id", python_units.entry_reasons(F.col("unit_type"), F.col("name"), F.col("decorators"), F.col("code")).alias("w"))
    assert {r.unit_id: r.w for r in why.collect() if r.w} == {"main.py:run": ["unit_type:route_handler", "decorator", "input_pattern:request.args"]}
    assert {r.unit_type for r in python_units.unit_statistics(units).collect()} >= {"method", "function"}


DIFF = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +5,3 @@ def f\n a\n+b\n@@ -9 +11,0 @@\n-z\n--- a/y.py\n+++ b/y.py\t2024\n@@ -1 +1 @@\n-a\n+b\n--- a/z\n+++ /dev/null\n@@ -1 +0,0 @@\n"
JUNIT = '<testsuite><testcase classname="c" name="a"/><testcase classname="c" name="b"><failure/></testcase><testcase name="d"><error/></testcase><testcase name="e"><skipped/></testcase></testsuite>'


def test_documents(spark, tmp_path):
    d = spark.createDataFrame([(1, DIFF), (2, None), (3, "")], "id int, text string")
    assert {tuple(r) for r in documents.diff_hunks(d, "id", "text").collect()} == {(1, "x.py", 5, 7), (1, "y.py", 1, 1)}
    t = spark.createDataFrame([(JUNIT,), ("no xml",), (None,), ('<testsuites><testsuite tests="5" failures="1" errors="x"/></testsuites>',)], "x string")
    got = [r.c and tuple(r.c) for r in t.select(documents.test_counts(F.col("x"), "junit").alias("c")).collect()]
    assert got == [(1, 1, 1, 1, ["c::b", "d"], "full"), None, None, (4, 1, 0, 0, [], "counts_only")]
    t = spark.createDataFrame([("1..3\nok 1 - a\nnot ok 2 - b\nok 3 # SKIP no",), ("nothing",)], "x string")
    got = [r.c and tuple(r.c) for r in t.select(documents.test_counts(F.col("x"), "tap").alias("c")).collect()]
    assert got == [(1, 1, 0, 1, ["b"], "full"), None]
    md = spark.createDataFrame([('a\r\n<!--\n```json\n{"schema":"t","n":0}\n```\n-->\n```json\n{bad\n```\n```json\n{"schema":"t","n":1}\n```\n',), ("none",)], "x string")
    got = [r.c for r in md.select(documents.first_json_block(F.col("x"), "t").alias("c")).collect()]
    assert json.loads(got[0])["n"] == 1 and got[1] is None
    j = spark.createDataFrame([('say {"a": "}"} ok',), ("{1} {2}",), ('{"a":1} and {"b":2}',), (None,)], "x string")
    assert [r.c for r in j.select(documents.json_object(F.col("x")).alias("c")).collect()] == ['{"a": "}"}', None, None, None]
    cve = {"id": "CVE-1", "weaknesses": [{"description": [{"lang": "en", "value": "CWE-89"}, {"lang": "es", "value": "x"}, {"lang": "en", "value": "CWE-89"}]}], "metrics": {"cvssMetricV2": [{"cvssData": {"baseScore": 5.0}, "baseSeverity": "medium"}]}, "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": f"c{i}"} for i in range(7)]}]}], "references": [{"url": "u"}]}
    rows = documents.advisories(spark.createDataFrame([(1, json.dumps(cve)), (2, "{}")], "k int, text string"), "k", "text").orderBy("k").collect()
    assert tuple(rows[0])[1:] == ("CVE-1", ["CWE-89"], "5.0", "MEDIUM", [f"c{i}" for i in range(5)], ["u"])
    assert (rows[1].score, rows[1].severity, rows[1].cwes, rows[1].products) == ("N/A", "UNKNOWN", [], [])
    for name, text in {"a": '{"id":"1","status":"ok"}', "b": '{"id":"1","status":"late"}', "c": "{broken", "d": '{"status":"x"}'}.items():
        write(tmp_path / "c" / f"{name}.json", text)
    assert [(r.id, r.status) for r in documents.checkpoints(spark, str(tmp_path / "c")).collect()] == [("1", "late")]


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("a.py", "=f", "vulnerable", 'say "x"\nnow|', 0), ("b.py", "g", "safe", None, None)], "file string, function string, verdict string, message string, start_line int")
    out = sinks.findings_csv(f.withColumn("unit_id", F.col("function")))
    assert tuple(out.columns) == sinks.CSV_COLUMNS and {r.unit_id for r in out.collect()} == {"'=f", "g"}
    sinks.write_csv(f.withColumn("unit_code", F.col("message")), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r.unit_code for r in back.collect()} == {'say "x"\nnow|', None}
    doc = json.loads(sinks.sarif_document(sinks.sarif_results(f, F.lit("error")), "codeloom", "1").first().document)
    run = doc["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["safe", "vulnerable"] and {r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in run["results"]} == {1}
    assert {r.line for r in sinks.markdown_table(f.where("message IS NOT NULL"), ["file", "message"]).collect()} == {'| a.py | say "x"\nnow\\| |'}


def test_streams(spark, tmp_path):
    path = tmp_path / "log"
    write(path / "1.json", "\n".join(json.dumps({"job": "a", "at": i, "line": f"l{i}"}) for i in (2, 1, 3)))
    stream = live.capped_log(live.json_stream(spark, str(path), "job string, at long, line string"), most_lines=4)
    run = lambda: stream.writeStream.format("memory").queryName("capped").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    q = run().start()
    q.awaitTermination(120)
    assert {(r["index"], r.line) for r in spark.table("capped").collect()} == {(0, "l1"), (1, "l2"), (2, "l3")}
    assert [r["index"] for r in live.replay(spark.table("capped"), 1).collect()] == [2] and live.replay(spark.table("capped"), None).count() == 3
    e = spark.createDataFrame([("p", "2024-01-01 00:00:10", None), ("p", "2024-01-01 00:00:00", 90)], "provider string, at string, retry_after int").withColumn("at", F.to_timestamp("at"))
    base = e.agg(F.min(F.unix_timestamp("at"))).first()[0]
    assert [tuple(r) for r in live.backoff_deadline(e).collect()] == [("p", base + 90)]
    left = spark.range(1).select(live.remaining_seconds(F.lit(10.0), F.lit(5), F.lit(0), F.lit(9)).alias("a"), live.remaining_seconds(F.lit(10.0), F.lit(5), F.lit(5), F.lit(9)).alias("b")).first()
    assert (left.a, left.b) == (8.0, None)
    p = live.progress(e.selectExpr("'j' AS job", "at", "'error' AS status", "1.5D AS cost"))
    assert [tuple(r)[1:] for r in p.collect()] == [("j", 2, 2, 3.0)]


def test_class_orders_and_chains(spark):
    b = spark.createDataFrame([("O", []), ("A", ["O"]), ("B", ["O"]), ("C", ["A", "B"]), ("X", ["A", "Ext"]), ("Y", ["A", "O"]), ("Z", ["O", "A"]), ("L", ["L"]), ("M", ["Z"])], "node string, bases array<string>")
    got = {r.node: r.chain for r in g.method_orders(b).collect()}
    assert got == {"O": ["O"], "A": ["A", "O"], "B": ["B", "O"], "C": ["C", "A", "B", "O"], "X": ["X", "A", "O", "Ext"], "Y": ["Y", "A", "O"], "Z": ["Z", "O", "A"], "L": None, "M": ["M", "Z", "O", "A"]}
    p = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 9), (6, 7), (7, 6), (8, 7)], "node long, parent long")
    got = {r.node: (r.root, r.steps, r.cyclic) for r in g.lineage(p).collect()}
    assert got == {1: (1, 0, False), 2: (1, 1, False), 3: (1, 2, False), 4: (1, 3, False), 5: (9, 1, False), 6: (None, None, True), 7: (None, None, True), 8: (None, None, True)}
    near = {r.node: r.value for r in g.nearest_ancestor(p, spark.createDataFrame([(1, 10), (3, 30)], "node long, value long")).collect()}
    assert near == {1: 10, 2: 10, 3: 30, 4: 30, 5: None, 6: None, 7: None, 8: None}
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 1)], "src long, dst long")
    assert {r.node: r.path for r in g.entry_paths(e, spark.createDataFrame([(1,)], "node long"), 15).collect()} == {1: [1], 2: [1, 2], 4: [1, 4], 3: [1, 2, 3]}
    assert {r.node for r in g.entry_paths(e, spark.createDataFrame([(1,)], "node long"), 1).collect()} == {1, 2, 4}


def test_text_shapes(spark):
    def one(column, x):
        return spark.createDataFrame([(x,)], "x string").select(column(F.col("x"))).first()[0]

    assert one(fx.redacted, "api_key=abcdefgh1 Bearer abcdefghijkl1 sk-ant-abcdefghijklmnopqrst disk-space AIza" + "a" * 32) == "api_key=***REDACTED*** Bearer ***REDACTED*** ***REDACTED*** disk-space ***REDACTED***"
    assert one(fx.collapsed, "a\r\nb\u2028c\td\n") == "a b c\td"
    assert one(fx.boundary_parts, f"a\n# {fx.BOUNDARY}\nb") == ["a\n", "\nb"]
    for raw, want in (("git@Host.com:o/r.git", "https://host.com/o/r"), ("https://u:p@Host.com:8080/o/r.git?x#y", "https://host.com/o/r"), ("C:\\x", ""), ("user:pass@host:p", ""), ("", ""), ("plain", "")):
        assert one(fx.remote_identity, raw) == want
    assert one(lambda x: fx.stage1_verdict(x, F.lit("safe"), F.lit("a"), F.lit("b")), "Changed from vulnerable to safe") == "vulnerable"
    assert one(lambda x: fx.stage1_verdict(x, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("b")), None) == "b"
    assert [one(lambda x: fx.duration(x.cast("double")), s) for s in ("59", "65", "3725")] == ["59s", "1m05s", "1h02m"]
    assert [one(lambda x: fx.cost(x.cast("double")), s) for s in ("0.0012", "3.456")] == ["$0.0012", "$3.46"]
    h = spark.range(1).select(rm.repaired_header(F.lit("@@ -1,9 +2,9 @@ f"), F.array(F.lit(" a"), F.lit("-b"), F.lit("+c"), F.lit("+d"))).alias("h"), rm.is_empty_hunk(F.array(F.lit(" a"))).alias("e")).first()
    assert (h.h, h.e) == ("@@ -1,2 +2,3 @@ f", True)


def test_functions_of_brace_languages(spark):
    from codeloom.sources import brace_units as bu

    c = 'int decl(int a);\nstatic char *\nname(int a)\n{\n  /* { */ s = "}"; if (a) { b(); }\n}\n#define X 1\nint two() { return name(1); }\n'
    assert [(n, a, b) for n, _, a, b, _ in bu.functions_of(c, "c")] == [("name", 2, 6), ("two", 8, 8)]
    go = "func (s *Server) Run(a int) error {\n\treturn s.stop()\n}\nfunc main() { f := func() {} }\n"
    assert [(n, r) for n, r, *_ in bu.functions_of(go, "go")] == [("Run", "Server"), ("main", None)]
    rust = "trait T { fn must(&self); }\nfn long<'a>(x: &'a str) -> char { 'x' }\n"
    assert [n for n, *_ in bu.functions_of(rust, "rust")] == ["long"]
    assert [n for n, *_ in bu.functions_of("<?php class A { public function go($x) { return 1; } }", "php")] == ["go"]
    assert bu.functions_of("", "c") == bu.functions_of("x", "cobol") == []
    hidden = bu.blanked('a("x\\"(y") // b(\n/* c( */ d(')
    assert hidden.count("\n") == 1 and len(hidden) == len('a("x\\"(y") // b(\n/* c( */ d(') and "b(" not in hidden and "d(" in hidden
    files = spark.createDataFrame([("a.c", "c", c), ("b.go", "go", go), ("n.c", "c", None)], "path string, language string, code string")
    found = bu.units(files).withColumn("id", F.concat_ws(":", "path", "name")).cache()
    assert {r.id for r in found.collect()} == {"a.c:name", "a.c:two", "b.go:Run", "b.go:main"}
    assert {tuple(r) for r in bu.call_edges(found).collect()} == {("a.c:two", "a.c:name")}


def test_provider_hook_keeps_rows_of_a_failing_batch(spark):
    from codeloom.operators import investigation as iv

    def provider(rows):
        if any(r["n"] == 3 for r in rows):
            raise ValueError("no answer")
        return [{"twice": r["n"] * 2} for r in rows]

    got = {r.n: (r.twice, r.provider_error) for r in iv.hooked(spark.range(6).coalesce(1).withColumnRenamed("id", "n"), provider, "twice long", batch=2).collect()}
    assert got == {0: (0, None), 1: (2, None), 2: (None, "ValueError: no answer"), 3: (None, "ValueError: no answer"), 4: (8, None), 5: (10, None)}


def test_retries_and_empty_tables(spark):
    from codeloom.operators import reports as rp
    from codeloom.operators import verification as ve

    ran = []

    def step(rows, i):
        ran.append(i)
        return rows.select("node", F.lit(i).alias("round"), (F.col("node") > i).alias("failed"))

    rows = spark.range(3).withColumnRenamed("id", "node")
    assert {(r.node, r.round, r.failed) for r in rp.retried(rows, step, F.col("failed"), 1).collect()} == {(0, 0, False), (1, 1, False), (2, 1, True)} and ran == [0, 1]
    none = spark.createDataFrame([], "error boolean, incomplete boolean, agree boolean, rewritten boolean, finding string, verdict string, stage1_finding string")
    assert set(ve.verification_outcomes(none).first()) == {0}
    assert ve.verified_recount(none).count() == 0
