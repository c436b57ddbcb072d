"""Benchmark decontamination by template canonicalisation and a hash join of template windows.

Every word becomes a template token: numbers, names (capitalised inside a sentence) and units
(right after a number) become typed placeholders that remember their value as a slot; other words
are lower-cased and stripped of outer punctuation.

1. Every benchmark item gives its windows of `width` template tokens, a table of (hash, item, place).
2. A bitmap of those hashes (at most `most_bits` bits, so bounded; three probes) goes to the
   executors and only spares the join rows that cannot match.
3. The windows of documents that pass are hash-joined with the items' windows by Spark.  A hit is a
   diagonal: document, item, document place minus item place.
4. Each document and item that share a diagonal are aligned on it word for word: slots must be
   consistent, each item value standing for one document value and the other way round.  A document
   leaks an item if an alignment has `run` windows in a row or covers `coverage` of the item's
   windows.  A re-parameterised question has other slot values and still aligns; `reparameterised`
   says so.

Windows with less than half plain words (heavy windows: number series, conversions, lists of
names) have no telling template.  They are joined by their words themselves, so verbatim copies
match; on a diagonal that another window anchors they match by template as well.

A document is known by a 128-bit hash of its text, so copies are joined and aligned once.

Defined results: null and empty texts and items match nothing; an item shorter than `width` is
one window of its own length if it has `least` words, and matches nothing below that; repeated rows
give repeated results, whatever their doc_id (null and repeated ids are judged by their own text);
empty tables give empty results; further columns are ignored, and `drop_leaks` passes them through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NUMBER = re.compile(r"[+\-]?\d[\d.,:/]*")
UNITS = frozenset("mm cm m km in ft mi mg g kg t oz lb ml cl l s ms sec min h hr hrs hour hours day days week weeks month months year years w kw mw v a hz khz mhz ghz c f k pa bar j kj cal kcal b kb mb gb tb usd eur gbp dollars euros cents percent pct".split())
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


Parsed = tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray]


class Templates(dict):
    """Words to template hashes and slot values; what a word gives is remembered up to a bound.

    As a dict: each known word's place in the arrays of what words give, so that a text's places are
    looked up without a step of Python a word, and the rest is arithmetic on arrays."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound
        self.num, self.unit, self.name = (xxhash.xxh3_64_intdigest(x) for x in (b"\x00num", b"\x00unit", b"\x00name"))
        self.values: list[str] = []
        self.hashes, self.kinds, self.ends = np.empty(1024, np.uint64), np.empty(1024, np.uint64), np.empty(1024, bool)

    def __missing__(self, raw: bytes) -> int:
        at = len(self.values)
        if at == len(self.hashes):
            self.hashes, self.kinds, self.ends = (np.concatenate([x, np.empty_like(x)]) for x in (self.hashes, self.kinds, self.ends))
        self.hashes[at], value, self.kinds[at], self.ends[at] = self._word(raw)
        self.values.append(value)
        self[raw] = at
        return at

    def _word(self, raw: bytes) -> tuple[int, str, int, bool]:
        """hash, value, hash of the placeholder that it may be (0: none), ends a sentence."""
        text = raw.decode("utf-8", "replace")
        ends = text.rstrip("\"')]»”’")[-1:] in ".!?:"
        core = EDGE.sub("", text)
        low = core.lower()
        kind = 0
        if m := NUMBER.match(core):
            rest = low[m.end() :]
            kind = self.num if not rest or rest in UNITS else 0
        elif low in UNITS:
            kind = self.unit
        elif core[:1].isupper() and core[1:].islower():
            kind = self.name
        return (xxhash.xxh3_64_intdigest((low or text).encode()), low, kind, ends)

    def read(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Template hashes, which tokens are placeholders, the words' own hashes (stripped, lower-cased), and the places of their values."""
        words = text.split()
        if len(self) > self.bound:
            self.clear()
            self.values.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        plain, kind, ends = self.hashes[at], self.kinds[at], self.ends[at]
        num = kind == np.uint64(self.num)
        after_end, after_num = np.concatenate([[True], ends[:-1]])[: len(at)], np.concatenate([[False], num[:-1]])[: len(at)]
        held = num | (kind == np.uint64(self.name)) & ~after_end | (kind == np.uint64(self.unit)) & after_num
        return np.where(held, kind, plain), held, plain, at

    def of(self, text: bytes) -> Parsed:
        """Template hashes, slot values, which tokens are placeholders, and the words' own hashes."""
        h, held, plain, at = self.read(text)
        return h, [self.values[i] if x else None for i, x in zip(at.tolist(), held.tolist())], held, plain


def heavy_windows(held: np.ndarray, width: int) -> np.ndarray:
    """Which windows have too few plain words for their template to be evidence."""
    c = np.concatenate([[0], np.cumsum(held)])
    return 2 * (c[width:] - c[:-width]) > width


def consistent(pairs: list[tuple[str, str]]) -> bool:
    """Each value on either side stands for one value on the other."""
    return len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(set(pairs))


def window_keys(text: bytes, t: Templates, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes by which windows are joined, and their places: all by template, heavy ones by their words too.

    A name at the start of a window may be the plain first word of an item, so such windows have a
    second hash."""
    h, held, plain, _ = t.read(text)
    keys, at = [], []
    for size in sizes:
        w = common.window_hashes(h, size)
        if not len(w):
            continue
        keys.append(w)
        at.append(np.arange(len(w)))
        named = np.flatnonzero(h[: len(w)] == np.uint64(t.name))
        if len(named):
            windows = h[named[:, None] + np.arange(size)]
            windows[:, 0] = plain[named]
            keys.append(common.window_hashes(windows.ravel(), size)[::size])
            at.append(named)
        heavy = np.flatnonzero(heavy_windows(held, size))
        if len(heavy):
            keys.append(common.window_hashes(plain, size, seed=1)[heavy])
            at.append(heavy)
    return (np.concatenate(keys), np.concatenate(at)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


def align(item: Parsed, doc: Parsed, shift: int, size: int, run: int, coverage: float) -> tuple[int, int, int, bool] | None:
    """Windows of the item, those matched consistently at this shift, the longest run, other values; None: no leak."""
    (own, own_slots, own_held, own_words), (h, slots, _, words) = item, doc
    total, lo, hi = len(own) - size + 1, max(0, -shift), min(len(own), len(h) - shift)
    if hi - lo < size:
        return None

    def whole(differ: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(differ)])
        return c[size:] == c[:-size]

    verbatim = own_words[lo:hi] != words[lo + shift : hi + shift]
    same, heavy = whole(verbatim & (own[lo:hi] != h[lo + shift : hi + shift])), heavy_windows(own_held[lo:hi], size)
    light = same & ~heavy
    matched = light | heavy & (whole(verbatim) | (same if light.any() else False))
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    ok = now = longest = 0
    last, other = -2, False
    for p in (np.flatnonzero(matched) + lo).tolist():
        new = [(a, b) for a, b in zip(own_slots[p : p + size], slots[p + shift : p + shift + size]) if a is not None and b is not None]
        if not consistent(new) or any(there.get(a, b) != b or back.get(b, a) != a for a, b in new):
            continue
        there.update(new)
        back.update((b, a) for a, b in new)
        other = other or any(a != b for a, b in new)
        ok, now = ok + 1, now + 1 if p == last + 1 else 1
        last, longest = p, max(longest, now)
    return (total, ok, longest, other) if longest >= run or ok >= coverage * total else None


def item_windows(items: DataFrame, width: int, least: int) -> DataFrame:
    """key (of the join), item_key, at, size: every window by which an item is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates()
        for batch in batches:
            for item, text in zip(batch.column("item_key").to_pylist(), batch.column("text")):
                h, held, plain, _ = t.read(text.as_buffer().to_pybytes())
                if len(h) < least:
                    continue
                size = min(width, len(h))
                heavy = heavy_windows(held, size)
                key = np.where(heavy, common.window_hashes(plain, size, seed=1), common.window_hashes(h, size))
                n = len(key)
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(key)), pa.array(np.full(n, item)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, size, np.int32))], names=["key", "item_key", "at", "size"])

    return items.select("item_key", "text").mapInArrow(run, "key long, item_key long, at int, size int")


PROBES = 3
SLICES = 16


def _probes(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for i in range(PROBES):
        yield common.mix(keys + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(bits - 1)


def bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """One boolean a bit, packed: which bits the windows' keys set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits, bool)
        for batch in batches:
            for at in _probes(batch.column("key").to_numpy().view(np.uint64), bits):
                out[at.astype(np.int64)] = True
        packed = np.packbits(out, bitorder="little")
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array([x.tobytes() for x in np.split(packed, SLICES)], pa.binary())], names=["slice", "bits"])

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for x in batch.column("bits"):
                part = np.frombuffer(x.as_buffer(), np.uint8)
                out = part.copy() if out is None else out | part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([out.tobytes()], pa.binary())], names=["slice", "bits"])

    kind = "slice long, bits binary"
    rows = windows.select("key").mapInArrow(mark, kind).groupBy("slice").applyInArrow(join, kind).collect()
    out = np.zeros(bits // 8, np.uint8).reshape(SLICES, -1)
    for r in rows:
        out[r.slice] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


KEYS = ["_dc_k1", "_dc_k2"]
#: Texts that hit a window, and leaks, are broadcast up to so many rows (about 60 bytes each), joined by shuffle beyond.
BROADCAST_HITS = 300_000


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the hash of each text (null without one)."""
    hashes = [F.xxhash64("text"), F.xxhash64(F.lit(29), "text")]
    return docs.withColumns({k: F.when(F.col("text").isNotNull(), h) for k, h in zip(KEYS, hashes)})


def _leaks(docs: DataFrame, benchmark: DataFrame, width: int, least: int, run: int, coverage: float, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """Leaks by the hashes of text and item, and the items (item_key, item_id)."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "leaks")
    named = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("item_key"))
    items = scratch.store(named.groupBy("item_key").agg(F.first("text").alias("text")), "items")
    windows = scratch.store(item_windows(items, width, least), "windows")
    count, sizes = windows.agg(F.count(F.lit(1)), F.collect_set("size")).first()
    sizes, bits = tuple(sorted(sizes)), 1 << 12
    while bits < min(64 * count, most_bits):
        bits *= 2
    shared = spark.sparkContext.broadcast(bitmap(windows, bits))
    texts = _keyed(docs.select("text")).where("text IS NOT NULL").select(*KEYS, F.col("text").cast("binary").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, t, done = shared.value, Templates(), set()
        for batch in batches:
            k1, k2, keys, places = [], [], [], []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (a, b) in done:
                    continue
                if len(done) < 1_000_000:
                    done.add((a, b))
                key, at = window_keys(text.as_buffer().to_pybytes(), t, sizes)
                for i in range(PROBES):
                    if not len(key):
                        break
                    bit = next(x for j, x in enumerate(_probes(key, bits)) if j == i).astype(np.int64)
                    hit = np.flatnonzero(marks[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    key, at = key[hit], at[hit]
                if len(key):
                    k1.append(np.full(len(key), a))
                    k2.append(np.full(len(key), b))
                    keys.append(key)
                    places.append(at)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k1)), pa.array(np.concatenate(k2)), pa.array(common.signed(np.concatenate(keys))), pa.array(np.concatenate(places).astype(np.int32))], names=[*KEYS, "key", "place"])

    passed = texts.mapInArrow(emit, f"{KEYS[0]} long, {KEYS[1]} long, key long, place int")
    hits = passed.join(common.small(windows, BROADCAST_HITS), "key").select(*KEYS, "item_key", "size", (F.col("place") - F.col("at")).alias("shift")).distinct()
    hits = scratch.store(hits.groupBy(*KEYS, "item_key", "size").agg(F.collect_set("shift").alias("shifts")), "hits")  # no more shifts than places
    known = common.small(hits.select(*KEYS).distinct(), BROADCAST_HITS)
    asked = texts.join(known, KEYS).groupBy(*KEYS).agg(F.first("text").alias("text"))
    pairs = hits.join(items.withColumnRenamed("text", "item"), "item_key").join(asked, KEYS).select(*KEYS, "item_key", "size", "shifts", "item", "text").sortWithinPartitions(*KEYS)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, last, doc, items = Templates(), None, None, {}
        for batch in batches:
            rows = []
            for a, b, item_key, size, shifts, item, text in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), batch.column(6)):
                if last != (a, b):
                    last, doc = (a, b), t.of(text.as_buffer().to_pybytes())
                if item_key not in items:
                    if len(items) > 5000:
                        items.clear()
                    items[item_key] = t.of(item.as_buffer().to_pybytes())
                found = [x for s in sorted(shifts) if (x := align(items[item_key], doc, s, size, run, coverage))]
                if found:
                    rows.append((a, b, item_key, *max(found, key=lambda x: x[1])))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 6 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[*KEYS, "item_key", "item_windows", "matched_windows", "longest_run", "reparameterised"])

    out = pairs.mapInArrow(verify, f"{KEYS[0]} long, {KEYS[1]} long, item_key long, item_windows long, matched_windows long, longest_run long, reparameterised boolean")
    out = scratch.store(out, "found")
    scratch.drop("items", "windows", "hits")
    return out, named.select("item_key", "item_id")


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, least: int = 5, run: int = 6, coverage: float = 0.5, most_bits: int = 1 << 27) -> DataFrame:
    """One row per document and item that it leaks."""
    found, named = _leaks(docs, benchmark, width, least, run, coverage, most_bits)
    found = common.small(found.join(named, "item_key"), BROADCAST_HITS)
    return _keyed(docs.select("doc_id", "text")).select("doc_id", *KEYS).join(found, KEYS).select("doc_id", "item_id", "item_windows", "matched_windows", "longest_run", "reparameterised")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, least: int = 5, run: int = 6, coverage: float = 0.5, most_bits: int = 1 << 27) -> DataFrame:
    """The documents that leak no item, columns untouched; each row is judged by its own text."""
    found, _ = _leaks(docs, benchmark, width, least, run, coverage, most_bits)
    bad = common.small(found.select(*KEYS).distinct(), BROADCAST_HITS)
    return _keyed(docs).join(bad, KEYS, "left_anti").select(*docs.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
