"""Source trees as a Python data source: planned partitions, pruning before descent, no links followed.

`spark.read.format("codeloom_tree").option("path", root).load()` gives one row for each directory
scanned and each entry met: rel (below the root), name, extension, state, length, content, detail.

| state | entry |
|---|---|
| directory | was listed |
| regular | a file; content is there unless the option `contents` is false |
| excluded | a directory whose bare name is in `skip`: not descended |
| symlink | a link, to whatever: never followed, never read |
| unsafe | neither file nor directory (pipe, device, socket): never opened |
| too_large | a file of more than `max_bytes`: no content, or its first `max_bytes` where `oversize` is truncate |
| unreadable | what the system refused to list, stat or read; `detail` says why |

So nothing is dropped in silence: what was not read is counted by its state.  Every open goes from the
root component by component with O_NOFOLLOW, so that a directory swapped for a link meanwhile is
refused too.

The driver lists breadth-first until there are enough directories, so that planning is bounded by
`plan_directories` listings.  Directories listed by then give their own entries in slices of
`slice_entries` (by a hash of the name: a flat directory of any size is read by many tasks); what lies
below them is walked by the tasks.  Filters on extension, on the beginning of rel and on state
are taken over by the source (with spark.sql.python.filterPushdown.enabled): files are not opened, and
directories outside the prefix not listed.  The root must be mounted where executors run.
"""

from __future__ import annotations

import os
import stat
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from codeloom.sources import languages as lang

NAME = "codeloom_tree"
SCHEMA = "rel string, name string, extension string, state string, length long, content binary, detail string"
ARROW = pa.schema([("rel", pa.string()), ("name", pa.string()), ("extension", pa.string()), ("state", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("detail", pa.string())])
NO_FOLLOW = getattr(os, "O_NOFOLLOW", 0)


class UnsafePath(Exception):
    """The path leaves the tree, passes a link, or is no regular file."""


def path_state(root: str, rel: str) -> str:
    """'absent', 'regular' or 'unsafe' (a link, also a dangling one, a directory, anything else)."""
    try:
        mode = os.lstat(os.path.join(root, rel)).st_mode
    except FileNotFoundError:
        return "absent"
    except OSError:
        return "unsafe"
    return "regular" if stat.S_ISREG(mode) else "unsafe"


def open_below(root: str, rel: str, flags: int = os.O_RDONLY) -> int:
    """A descriptor of root/rel that no link and no '..' led to."""
    parts = [p for p in rel.split("/") if p]
    if rel.startswith("/") or ".." in parts:
        raise UnsafePath(f"{rel} leaves the tree")
    at = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        for i, part in enumerate(parts):
            last = i == len(parts) - 1
            try:
                # a pipe must not block the open
                below = os.open(part, (flags | os.O_NONBLOCK if last else os.O_RDONLY | os.O_DIRECTORY) | NO_FOLLOW, dir_fd=at)
            except OSError as e:
                if os.path.islink(os.path.join(root, *parts[: i + 1])):
                    raise UnsafePath(f"{rel} passes a link") from e
                raise
            os.close(at)
            at = below
        return at
    except BaseException:
        os.close(at)
        raise


def read_below(root: str, rel: str, max_bytes: int, truncate: bool = False) -> bytes | None:
    """The bytes of a regular file, at most so many; null if absent; UnsafePath if it must not be read."""
    if path_state(root, rel) == "absent":
        return None
    fd = open_below(root, rel)
    try:
        if not stat.S_ISREG(os.fstat(fd).st_mode):
            raise UnsafePath(f"{rel} is no regular file")
        with os.fdopen(fd, "rb", closefd=False) as f:
            data = f.read(max_bytes + 1)
    finally:
        os.close(fd)
    if len(data) > max_bytes and not truncate:
        raise UnsafePath(f"{rel} has more than {max_bytes} bytes")
    return data[:max_bytes]


def extension_of(name: str) -> str:
    stem, dot, last = name.rpartition(".")
    return (dot + last).lower() if stem and last else ""


@dataclass
class Part(InputPartition):
    """A directory and what is below it (slices 0), or one slice of a listed directory's own entries."""

    rel: str
    slice: int
    slices: int


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.skip = frozenset(x for x in options.get("skip", ",".join(lang.SKIP_DIRS)).split(",") if x)
        self.max_bytes = int(options.get("max_bytes", 10 << 20))
        self.contents = options.get("contents", "true").lower() == "true"
        self.truncate = options.get("oversize", "skip") == "truncate"
        self.plan_directories = int(options.get("plan_directories", 256))
        self.slice_entries = int(options.get("slice_entries", 4096))
        self.extensions: frozenset | None = None
        self.states: frozenset | None = None
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            match f:
                case EqualTo(("extension",), value) if isinstance(value, str):
                    self.extensions = frozenset([value]) if self.extensions is None else self.extensions & {value}
                case In(("extension",), values) if all(isinstance(v, str) for v in values):
                    self.extensions = frozenset(values) if self.extensions is None else self.extensions & set(values)
                case EqualTo(("state",), value) if isinstance(value, str):
                    self.states = frozenset([value]) if self.states is None else self.states & {value}
                case StringStartsWith(("rel",), value):
                    self.prefixes.append(value)
                case _:
                    yield f

    def _wanted(self, rel: str, name: str, state: str | None = None) -> bool:
        return (
            all(rel.startswith(p) for p in self.prefixes)
            and (self.extensions is None or extension_of(name) in self.extensions)
            and (state is None or self.states is None or state in self.states)
        )

    def _may_hold(self, rel: str) -> bool:
        """Whether something below this directory can have the wanted beginning."""
        below = rel + "/" if rel else ""
        return all(below.startswith(p) or p.startswith(below) for p in self.prefixes)

    def _list(self, rel: str) -> tuple[list[tuple[str, int]], str | None]:
        """(name, mode) of the entries by name, mode -1 where the system refuses to say; or why there are none."""
        try:
            fd = open_below(self.root, rel, os.O_RDONLY | os.O_DIRECTORY)
        except (OSError, UnsafePath) as e:
            return [], type(e).__name__
        out = []
        try:
            for name in sorted(os.listdir(fd)):
                try:
                    out.append((name, os.stat(name, dir_fd=fd, follow_symlinks=False).st_mode))
                except OSError:
                    out.append((name, -1))
        except OSError as e:
            return [], type(e).__name__
        finally:
            os.close(fd)
        return out, None

    def _descends(self, rel: str, name: str, mode: int) -> bool:
        return mode >= 0 and stat.S_ISDIR(mode) and name not in self.skip and self._may_hold(rel)

    def partitions(self) -> list[Part]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        flat, queue = [], [""]
        while queue and len(flat) + len(queue) <= self.plan_directories:
            rel = queue.pop(0)
            entries, _ = self._list(rel)
            slices = -(-len(entries) // self.slice_entries) or 1
            flat += [Part(rel, i, slices) for i in range(slices)]
            for name, mode in entries:
                if self._descends(below := f"{rel}/{name}" if rel else name, name, mode):
                    queue.append(below)
        return flat + [Part(rel, 0, 0) for rel in queue]

    def _row(self, rel: str, name: str, mode: int) -> tuple | None:
        """The row of an entry that is not descended."""
        row = lambda state, length=None, content=None, detail=None: (rel, name, extension_of(name), state, length, content, detail) if self._wanted(rel, name, state) else None
        if mode < 0:
            return row("unreadable", detail="no stat")
        if stat.S_ISLNK(mode):
            return row("symlink")
        if stat.S_ISDIR(mode):
            return row("excluded") if name in self.skip else None
        if not stat.S_ISREG(mode):
            return row("unsafe")
        if not self._wanted(rel, name) or (self.states is not None and not self.states & {"regular", "too_large", "unreadable", "unsafe"}):
            return None
        try:
            size = os.lstat(os.path.join(self.root, rel)).st_size
            if size > self.max_bytes:
                return row("too_large", size, read_below(self.root, rel, self.max_bytes, True) if self.truncate and self.contents else None)
            return row("regular", size, read_below(self.root, rel, self.max_bytes) if self.contents else None)
        except UnsafePath as e:
            return row("unsafe", detail=str(e))
        except OSError as e:
            return row("unreadable", detail=type(e).__name__)

    def _rows(self, part: Part) -> Iterator[tuple]:
        stack = [part.rel]
        while stack:
            rel = stack.pop()
            entries, why = self._list(rel)
            if part.slice == 0:
                name = rel.rpartition("/")[2]
                state = "directory" if why is None else "unreadable"
                if self._wanted(rel, name, state):
                    yield rel, name, extension_of(name), state, None, None, why
            deeper = []
            for name, mode in entries:
                below = f"{rel}/{name}" if rel else name
                if mode >= 0 and stat.S_ISDIR(mode) and name not in self.skip:
                    if part.slices == 0 and self._descends(below, name, mode):
                        deeper.append(below)
                elif part.slices < 2 or zlib.crc32(name.encode("utf-8", "surrogateescape")) % part.slices == part.slice:
                    if (row := self._row(below, name, mode)) is not None:
                        yield row
            stack += reversed(deeper)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in self._rows(partition):
            # names need not be UTF-8
            held.append(tuple(x.encode("utf-8", "surrogateescape").decode("utf-8", "replace") if isinstance(x, str) else x for x in row))
            size += 200 + len(row[5] or b"")
            if size >= 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def entries(spark: SparkSession, root: str, **options) -> DataFrame:
    """The rows of the tree; see the module for the options."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).options(path=root, **options).load()


def statistics(tree: DataFrame) -> DataFrame:
    """One row: what was scanned, pruned and refused."""
    count = lambda state: F.count_if(F.col("state") == state)
    names = {"directory": "directories_scanned", "excluded": "directories_excluded", "unreadable": "unreadable", "symlink": "symlinks_skipped", "unsafe": "unsafe", "too_large": "too_large", "regular": "files"}
    return tree.agg(*(count(s).alias(n) for s, n in names.items()), F.coalesce(F.sum(F.when(F.col("state") == "regular", F.col("length"))), F.lit(0)).alias("bytes"))


def examples(tree: DataFrame, k: int = 5) -> DataFrame:
    """state, rel, detail: the first k gaps of each kind by path."""
    gaps = tree.where("state NOT IN ('regular', 'directory')").select("state", "rel", "detail")
    return gaps.withColumn("place", F.row_number().over(Window.partitionBy("state").orderBy("rel"))).where(F.col("place") <= k).drop("place")


def excluded(tree: DataFrame, n_examples: int = 2, n_names: int = 12, reserved: tuple[str, ...] = lang.SKIP_DIRS) -> DataFrame:
    """name, n, examples (least paths) of pruned directories; the null name counts what is not named.

    Named are reserved names and the first `n_names` others by path; names of other than printable ASCII
    or of more than 100 characters are only counted, paths of more than 200 are no examples.
    """
    gone = tree.where("state = 'excluded'").select("rel", F.when(F.col("name").rlike("^[\\x20-\\x7e]{1,100}$"), F.col("name")).alias("key"))
    per = gone.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rel").alias("first"))
    others = per.where(F.col("key").isNotNull() & ~F.col("key").isin(*reserved)).orderBy("first", "key").limit(n_names).select(F.col("key").alias("o_key"))
    shown = gone.where(F.col("key").isNotNull() & F.col("rel").rlike("^[\\x20-\\x7e]{1,200}$"))
    shown = shown.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("rel"))).where(F.col("place") <= n_examples)
    shown = shown.groupBy(F.col("key").alias("e_key")).agg(F.array_sort(F.collect_list("rel")).alias("examples"))
    known = per.join(F.broadcast(others), F.col("key") == F.col("o_key"), "left").join(shown, F.col("key") == F.col("e_key"), "left")
    named = F.col("key").isin(*reserved) | F.col("o_key").isNotNull()
    return known.groupBy(F.when(named, F.col("key")).alias("name")).agg(F.sum("n").alias("n"), F.max(F.when(named, F.coalesce("examples", F.array().cast("array<string>")))).alias("examples"))
