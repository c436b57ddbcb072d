"""Distributed prefixes, packing, dyadic interval joins and class hierarchies against plain Python."""

import random

from codeloom.operators import accounting as ac
from codeloom.operators import inheritance as ih
from codeloom.operators import intervals as iv
from codeloom.operators import investigation as inv
from codeloom.operators import prefix
from pyspark.sql import functions as F


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice((None, rng.randrange(-5, 50))), rng.randrange(9)) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, v long, k int")
    at = prefix.ordered(df, F.col("k"), F.col("id"))
    got = {r.id: (r.n, r.s, r.m) for r in prefix.carried(at, {"n": F.lit(1), "s": F.col("v")}, {"m": F.col("v")}).collect()}
    n = s = 0
    best = None
    for i, v, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        n, s = n + 1, s + (v or 0)
        assert got[i] == (n, s, best)
        best = v if best is None else best if v is None else max(best, v)
    assert prefix.numbered(df.limit(0), "n", F.col("id")).count() == 0
    assert "row_number" not in prefix.numbered(df, "n", F.col("id"))._jdf.queryExecution().toString()


def test_next_fit_packing(spark):
    rng = random.Random(2)
    rows = [(job, f"{i:03}" + "p" * rng.randrange(30), rng.choice((0, rng.randrange(400), 5000 if i % 20 == 0 else 3))) for job in ("a", "b", None) for i in range(150 if job == "a" else 7)]
    rows.append(("one", "x", 9))
    got = {(r.job, r.path): r.batch for r in inv.file_batches(spark.createDataFrame(rows, "job string, path string, size long"), 1000).collect()}
    for job in ("a", "b", None, "one"):
        batch = used = 0
        for _, path, size in sorted((r for r in rows if r[0] == job), key=lambda r: (r[2], r[1])):
            cost = size + len(path) + 50
            if used and used + cost > 1000:
                batch, used = batch + 1, 0
            used += cost
            assert got[job, path] == batch
    assert inv.file_batches(spark.createDataFrame([], "job string, path string, size long"), 10).count() == 0


def test_merged_intervals(spark):
    rng = random.Random(3)
    rows = [(a := rng.randrange(2000), a + rng.randrange(20)) for _ in range(150)] + [(5, 900), (7, 7), (None, 3), (4, None)]
    want = []
    for a, b in sorted(r for r in rows if None not in r):
        if want and a <= want[-1][1]:
            want[-1] = (want[-1][0], max(b, want[-1][1]), want[-1][2] + 1)
        else:
            want.append((a, b, 1))
    assert sorted(map(tuple, prefix.merged_intervals(spark.createDataFrame(rows, "start long, end long")).collect())) == want


def test_dyadic_blocks_tile_the_range(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a - 1, 40)] + [(0, 2**40), (2**40 - 3, 2**40 + 5), (1, 1)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", iv.blocks(F.col("a"), F.col("b")).alias("x")).collect():
        if r.a > r.b:
            assert r.x is None
            continue
        spans = sorted((x.block << x.level, (x.block + 1 << x.level) - 1) for x in r.x)
        assert spans[0][0] == r.a and spans[-1][1] == r.b and all(p[1] + 1 == q[0] for p, q in zip(spans, spans[1:]))
        assert len(spans) <= 2 * (r.b - r.a + 1).bit_length()


def test_overlap_and_containment(spark):
    rng = random.Random(4)
    cut = lambda n: [(rng.choice("hhha") if i else None, rng.choice((None, s := rng.randrange(300))) if i % 9 == 0 else (s := rng.randrange(300)), s + rng.choice((-1, 0, 3, 40, 250))) for i in range(n)]
    units = [(i, *x) for i, x in enumerate(cut(120))] + [(0, "h", 5, 9), (200, "h", 0, 100_000)]
    hunks = cut(12) + [("h", 50, 49), ("a", None, 4)]
    u = spark.createDataFrame(units, "id int, file string, start int, end int")
    h = spark.createDataFrame(hunks, "file string, a int, b int")
    ok = lambda *x: None not in x
    meets = [(i, f, s, e) for i, f, s, e in units if ok(f, s, e) and s <= e and any(f == g and ok(a, b) and a <= b and s <= b and e >= a for g, a, b in hunks)]
    assert all(sorted(map(tuple, ac.overlapping(u, h, few).collect())) == sorted(meets) for few in (0, 1000))
    ends = [(i, f, s, e) for i, f, s, e in units if ok(f, s, e) and any(f == g and any(x is not None and s <= x <= e for x in (a, b)) for g, a, b in hunks)]
    assert all(sorted(map(tuple, ac.containing_an_end(u, h, few).collect())) == sorted(ends) for few in (0, 1000))
    first = {(r.file, r.line): r.value for r in iv.first_range(h, u, "a", "start", "end", "id", "start").collect()}
    assert first == {(g, a): min((i, s) for i, f, s, e in units if ok(f, s, e) and f == g and s <= a <= e)[1] for g, a, _ in hunks if ok(g, a) and any(ok(f, s, e) and f == g and s <= a <= e for _, f, s, e in units)}
    assert ac.overlapping(u, h.limit(0)).count() == 0 and ac.containing_an_end(u.limit(0), h).count() == 0


def test_containing_or_nearest_function(spark):
    rng = random.Random(6)
    functions = [(rng.choice("abc"), i, f"n{i}", s := rng.choice((None, rng.randrange(60))), None if s is None or i % 5 == 0 else s + rng.randrange(9)) for i in range(40)]
    hits = [(i, rng.choice("abcz"), rng.randrange(-5, 70)) for i in range(60)] + [(99, None, 3), (98, "a", None)]
    got = {r.hit: (r.name, r.how) for r in inv.containing_functions(spark.createDataFrame(hits, "hit int, file string, line int"), spark.createDataFrame(functions, "file string, ordinal int, name string, start int, end int")).collect()}
    for hit, file, line in hits:
        own = [f for f in functions if f[0] == file and f[3] is not None and line is not None]
        inside = [f for f in own if f[4] is not None and f[3] <= line <= f[4]]
        want = (min(inside, key=lambda f: f[1])[2], "contains") if inside else (min(own, key=lambda f: (abs(f[3] - line), f[3], f[1]))[2], "nearest") if own else (None, "none")
        assert got[hit] == want


def test_first_matching_file(spark):
    files = ["src/a.py", "lib/src/a.py", "a.py", "xa.py", "b/c.py", "", None]
    paths = ["a.py", "repo/src/a.py", "c.py", "nothing", "", None, "zzz/xa.py"]
    got = {r.path: r.file for r in iv.first_file(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(f, i) for i, f in enumerate(files)], "file string, ordinal int")).collect()}
    want = {p: next((f for f in files if f and (f.endswith(p) or p.endswith(f))), None) for p in paths if p}
    assert got == {p: f for p, f in want.items() if f}


def test_receivers_and_super(spark):
    classes = spark.createDataFrame([("m:Base", "m", "Base"), ("m:Child", "m", "Child"), ("n:Other", "n", "Other"), ("n:Twin", "n", "Twin"), ("m:Twin", "m", "Twin"), ("x:Gone", "x", "Gone")], "cls string, file string, name string")
    imports = spark.createDataFrame([("k", "Alias", "m", "Child"), ("k", "Gone", "outside", None), ("k", "Base", "m", None)], "file string, name string, target_file string, target_name string")
    calls = spark.createDataFrame([(1, "m", "Child"), (2, "k", "Alias"), (3, "k", "Gone"), (4, "k", "Other"), (5, "k", "Twin"), (6, "k", None), (7, "k", "Base"), (8, "y", "Gone")], "call int, file string, receiver string")
    assert {r.call: r.cls for r in ih.receiver_types(calls, classes, imports).collect()} == {1: "m:Child", 2: "m:Child", 3: None, 4: "n:Other", 5: None, 6: None, 7: "m:Base", 8: "x:Gone"}
    bases = spark.createDataFrame([("O", []), ("A", ["O"]), ("B", ["O"]), ("C", ["A", "B"]), ("L", ["L"])], "node string, bases array<string>")
    methods = spark.createDataFrame([("O", "f", "O.f"), ("B", "f", "B.f"), ("C", "g", "C.g"), ("A", "g", "A.g"), ("L", "f", "L.f")], "cls string, method string, id string")
    calls = spark.createDataFrame([(1, "C", "f", False), (2, "C", "g", True), (3, "C", "g", None), (4, "B", "f", True), (5, None, "f", False), (6, "C", "zz", False), (7, "L", "f", False), (8, "A", "f", False)], "call int, cls string, method string, is_super boolean")
    got = {r.call: r.id for r in ih.inherited_calls(calls, ih.places(ih.method_orders(bases)), methods).collect()}
    assert got == {1: "B.f", 2: "A.g", 3: "C.g", 4: "O.f", 5: None, 6: None, 7: "L.f", 8: "O.f"}


def test_calls_walk_a_shared_order_once(spark):
    """Forty classes with one order behind them: their calls meet that order once, not once a class."""
    rng = random.Random(11)
    chain = [f"b{i}" for i in range(25)]
    orders = {f"c{i}": [f"c{i}", *chain] for i in range(40)} | {b: chain[i:] for i, b in enumerate(chain)} | {"odd": ["odd", "b3", "b7"], "lone": None}
    methods = [(c, f"f{rng.randrange(30)}", f"id{i}") for i, c in enumerate(rng.choices([*orders, "gone"], k=60))] + [("lone", "f1", "x"), ("gone", "f2", "y"), ("b3", "f3", None)]
    calls = [(i, rng.choice([*orders, "gone", None]), rng.choice([None, *(f"f{j}" for j in range(30))]), rng.choice([True, False, None])) for i in range(3000)]
    places = ih.places(spark.createDataFrame(list(orders.items()), "node string, chain array<string>"))
    out = ih.inherited_calls(spark.createDataFrame(calls, "call int, cls string, method string, is_super boolean"), places, spark.createDataFrame(methods, "cls string, method string, id string"))
    own = {}
    for c, f, i in methods:
        own.setdefault((c, f), []).append(i)
    want = {}
    for call, c, f, up in calls:
        line = [] if c not in orders else (orders[c] or [c])[1 if up else 0 :]
        at = next((x for x in line if (x, f) in own), None)
        want[call] = (at, min((i for i in own[at, f] if i is not None), default=None) if at else None)
    assert {r.call: (r.defined_in, r.id) for r in out.collect()} == want
    # the order behind a class is known by its hash when calls are brought to it
    assert "xxhash64(1, behind" in out._jdf.queryExecution().optimizedPlan().toString()


def test_nested_intervals(spark):
    rng = random.Random(5)
    parent = {i: (rng.randrange(max(1, i // 4)) if i % 13 else None) for i in range(1, 90)} | {0: None} | {100 + i: 0 for i in range(60)}
    parent |= {500: 999, 501: 500, 600: 601, 601: 600, 602: 601, 603: 603}  # an unknown parent, cycles and what hangs on them
    labels = ih.nested_intervals(spark.createDataFrame(list(parent.items()), "node long, parent long")).cache()
    got = {r.node: (r.lo, r.hi, r.depth) for r in labels.collect()}
    assert set(got) == set(parent) - {600, 601, 602, 603}

    def above(x):
        out = [x]
        while parent.get(x) is not None and parent[x] in parent:
            x = parent[x]
            out.append(x)
        return out

    nodes = sorted(got)
    for x in nodes:
        assert got[x][2] == len(above(x)) - 1
        assert {y for y in nodes if got[y][0] <= got[x][0] < got[y][1]} == set(above(x))
    pairs = spark.createDataFrame([(1, 0), (0, 1), (105, 0), (105, 105), (777, 0), (600, 601)], "sub long, base long")
    assert {(r.sub, r.base): r.is_subtype for r in ih.is_subtype(pairs, labels).collect()} == {(1, 0): 0 in above(1), (0, 1): False, (105, 0): True, (105, 105): True, (777, 0): False, (600, 601): False}
    assert ih.nested_intervals(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long")).count() == 0


def test_closure_of_several_bases_and_cycles(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("z", None)]
    got = {tuple(r) for r in ih.inherit_closure(spark.createDataFrame(edges, "node string, base string")).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "d"), ("a", "e"), ("b", "e"), ("c", "e"), ("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}


def test_ranges_are_cut_once_and_only_in_files_with_lines(spark):
    """5,000 equal ranges of a hot file are one, ranges of files without a line are none, whether the files are sent or not."""
    units = spark.range(15_000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('cold', id)) AS file", "3 AS start", "9 AS end")
    lines = spark.createDataFrame([("hot", 4, 5), ("hot", 4, 4), ("none", 3, 3), (None, 1, 1)], "file string, a int, b int")
    assert [tuple(r) for r in iv.distinct_ranges(units, lines, "start", "end").collect()] == [("hot", 3, 9)]
    assert iv.of_files(units, lines, 1).count() == 15_000 and iv.of_files(units, lines, 2).count() == 5_000
    assert [tuple(r) for r in iv.first_range(lines, units, "a", "start", "end", "id", "id").collect()] == [("hot", 4, 0)]
    assert ac.overlapping(units, lines, 0).count() == ac.containing_an_end(units, lines, 0).count() == 5_000
    cut = iv.cut(spark.createDataFrame([(3, 9), (9, 3), (None, 1), (-5, 2**40)], "start long, end long"))
    want = cut.select("start", "end").distinct().select("start", "end", F.inline(iv.blocks(F.col("start"), F.col("end"))))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, want.collect())) and cut.count() == 7


def test_innermost_symbols(spark):
    from codeloom.operators import remediation as rm

    rng = random.Random(8)
    symbols = [(rng.choice("hhha") if i else None, rng.choice((None, f"s{i % 9}")), s := rng.randrange(-20, 90), s + rng.choice((-1, 0, 3, 40))) for i in range(70)] + [("h", "twin", 10, 60), ("h", "also", 10, 60), ("h", "x", None, 9)]
    hits = [(i % 50, rng.choice("hhaz"), rng.randrange(-25, 130)) for i in range(90)] + [(7, None, 3), (8, "h", None)]
    got = rm.innermost(spark.createDataFrame(hits, "hit_id int, file string, line int"), spark.createDataFrame(symbols, "file string, symbol string, start int, end int")).collect()
    holding = lambda f, x: [(b - a, n is None, n or "", n) for g, n, a, b in symbols if None not in (f, x, g, a) and f == g and a <= x <= b]
    text = lambda rows: sorted(rows, key=repr)
    assert text(tuple(r) for r in got) == text((i, min(held)[3] if (held := holding(f, x)) else None) for i, f, x in hits)


def test_piled_up_ranges_and_hits_do_not_multiply(spark):
    """20,000 hits on a line which 20,000 symbols hold: by pairs, 400 million rows."""
    import time

    from codeloom.operators import remediation as rm

    hits = spark.range(20_000).selectExpr("id AS hit_id", "'f' AS file", "id % 3 AS line")
    symbols = spark.range(20_000).selectExpr("'f' AS file", "concat('s', id) AS symbol", "id % 2 - 1 AS start", "9 + id % 5 AS end")
    began = time.time()
    assert {(r.line, r.symbol) for r in rm.innermost(hits, symbols).join(hits, "hit_id").select("line", "symbol").distinct().collect()} == {(x, "s10005") for x in range(3)}
    assert time.time() - began < 60


def test_hunks_mark_units_by_their_own_lines(spark):
    """Units that share an id are judged by their own lines, with few and with many hunks."""
    units = spark.createDataFrame([(1, "a", 1, 2), (1, "a", 5, 9), (2, "a", None, 4), (3, "c", 1, 9), (4, None, 1, 2), (5, "b", None, None), (6, "a", 9, 8)], "id int, file string, start int, end int")
    changed = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "file string")
    hunks = spark.createDataFrame([("a", 6, 7), ("a", 6, 7), ("a", 3, 2), ("c", 2, 2), (None, 1, 2)], "file string, a int, b int")
    want = sorted([(1, 1, False), (1, 5, True), (2, None, True), (3, 1, False), (4, 1, False), (5, None, True), (6, 9, False)], key=repr)
    for few in (0, 1000):
        out = ac.diff_selected(units, changed, hunks, few)
        assert out.columns == ["id", "file", "start", "end", "diff_selected"]
        assert sorted(((r.id, r.start, r.diff_selected) for r in out.collect()), key=repr) == want


def test_dominant_language_weighs_places(spark):
    """One file more is worth a million places, as in the SQL: beyond that the earlier language wins."""
    rows = [(1, 5, "go"), (1, 2_000_009, "c"), (1, 2_000_013, "c"), (2, 5, "go"), (2, 900_000, "c"), (2, 900_001, "c"), (3, 1, None), (4, 7, "go"), (4, 3, "c")]
    got = inv.dominant_language(spark.createDataFrame(rows, "repo int, place long, language string")).collect()
    assert {r.repo: r.language for r in got} == {1: "go", 2: "c", 3: "unknown", 4: "c"}
