"""The tree source: pruning, refusal of links and escapes, slices, pushed filters."""

import os

import pytest
from codeloom.sources import tree_source as ts


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    outside = top / "outside"
    (outside / "deep").mkdir(parents=True)
    (outside / "secret.py").write_text("secret = 1\n")
    (outside / "deep" / "x.py").write_text("x = 1\n")
    r = top / "root"
    for name, text in {"a.py": "a = 1\n", "src/b.py": "b = 1\n", "src/deep/er/c.go": "package c\n", "src/node_modules/x.js": "x", "node_modules/y.js": "y", "vendor/z.py": "z", "empty/.keep": "", "big.py": "b" * 5000, "bin": "\x00\x01"}.items():
        p = r / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (r / "flat").mkdir()
    for i in range(60):
        (r / "flat" / f"f{i}.txt").write_text(str(i))
    (r / "bad.py").write_bytes(b"\xff\xfe")
    os.symlink(outside, r / "linked")
    os.symlink(outside / "secret.py", r / "leak.py")
    os.symlink(r / "src", r / "inside")
    os.symlink("..", r / "src" / "loop")
    os.symlink(r / "nothing", r / "dangling.py")
    os.mkfifo(r / "src" / "pipe.py")
    return str(r)


def rows(df):
    return {r.rel: r.state for r in df.collect()}


STATES = {
    "": "directory", "a.py": "regular", "src": "directory", "src/b.py": "regular", "src/deep": "directory", "src/deep/er": "directory", "src/deep/er/c.go": "regular", "src/node_modules": "excluded",
    "node_modules": "excluded", "vendor": "excluded", "empty": "directory", "empty/.keep": "regular", "big.py": "too_large", "bin": "regular", "bad.py": "regular", "flat": "directory",
    "linked": "symlink", "leak.py": "symlink", "inside": "symlink", "src/loop": "symlink", "dangling.py": "symlink", "src/pipe.py": "unsafe", **{f"flat/f{i}.txt": "regular" for i in range(60)},
}


@pytest.mark.parametrize("plan", [1, 3, 256])
def test_states_do_not_depend_on_the_plan(spark, root, plan):
    tree = ts.entries(spark, root, max_bytes=1000, plan_directories=plan, slice_entries=7)
    got = tree.collect()
    assert len(got) == len(STATES) and rows(tree) == STATES
    assert {r.rel: bytes(r.content) for r in got if r.content is not None}["src/b.py"] == b"b = 1\n"
    assert all(b"secret" not in bytes(r.content or b"") for r in got)
    if plan == 256:
        assert tree.rdd.getNumPartitions() > 10


def test_oversize_and_no_contents(spark, root):
    cut = ts.entries(spark, root, max_bytes=1000, oversize="truncate").where("rel = 'big.py'").first()
    assert (cut.state, cut.length, len(cut.content)) == ("too_large", 5000, 1000)
    assert ts.entries(spark, root, contents="false").where("content IS NOT NULL").count() == 0


def test_filters_are_taken_over(spark, root):
    tree = ts.entries(spark, root, max_bytes=1000)
    all_rows = spark.createDataFrame(tree.collect(), tree.schema).cache()
    for condition in ("extension IN ('.go', '.js')", "extension = '.py' AND state = 'regular' AND startswith(rel, 's')", "state = 'symlink' AND length IS NULL"):
        assert rows(tree.where(condition)) == rows(all_rows.where(condition)), condition
    reader = ts.TreeReader({"path": root})
    assert list(reader.pushFilters([ts.StringStartsWith(("rel",), "src/deep"), ts.EqualTo(("extension",), ".go"), ts.EqualTo(("length",), 3)])) == [ts.EqualTo(("length",), 3)]
    assert sorted({p.rel for p in reader.partitions()}) == ["", "src", "src/deep", "src/deep/er"]


def test_statistics_examples_and_excluded(spark, root):
    tree = ts.entries(spark, root, max_bytes=1000)
    s = ts.statistics(tree).first()
    assert (s.directories_scanned, s.directories_excluded, s.symlinks_skipped, s.unsafe, s.too_large, s.unreadable, s.files) == (6, 3, 5, 1, 1, 0, 66)
    assert {(r.state, r.rel) for r in ts.examples(tree, 2).collect()} == {("excluded", "node_modules"), ("excluded", "src/node_modules"), ("symlink", "dangling.py"), ("symlink", "inside"), ("unsafe", "src/pipe.py"), ("too_large", "big.py")}
    assert {r["name"]: (r.n, r.examples) for r in ts.excluded(tree, 1).collect()} == {"node_modules": (2, ["node_modules"]), "vendor": (1, ["vendor"])}
    odd = spark.createDataFrame([(f"p/{i}/{n}", n, "excluded") for i, n in enumerate(["a", "b", "c", "a", "é", "x" * 101, "build"])], "rel string, name string, state string")
    assert {r["name"]: r.n for r in ts.excluded(odd, 2, 2).collect()} == {"a": 2, "b": 1, "build": 1, None: 3}


def test_reading_below(root):
    assert ts.read_below(root, "src/b.py", 100) == b"b = 1\n"
    assert ts.read_below(root, "gone.py", 100) is None
    assert ts.read_below(root, "big.py", 10, truncate=True) == b"b" * 10
    for rel in ("leak.py", "inside/b.py", "linked/secret.py", "../outside/secret.py", "/etc/passwd", "src/pipe.py", "src", "dangling.py", "big.py"):
        with pytest.raises(ts.UnsafePath):
            ts.read_below(root, rel, 100)
    assert [ts.path_state(root, x) for x in ("a.py", "gone", "dangling.py", "src", "src/pipe.py")] == ["regular", "absent", "unsafe", "unsafe", "unsafe"]


def test_a_missing_root_fails_and_an_empty_one_is_one_row(spark, tmp_path):
    with pytest.raises(Exception, match="nothing"):
        ts.entries(spark, str(tmp_path / "nothing")).collect()
    assert rows(ts.entries(spark, str(tmp_path))) == {"": "directory"}
