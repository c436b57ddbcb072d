"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes it links.

A node is a distinct shingle set, known by the hash of its sorted shingle hashes; exact copies
share a node and are never paired.  Shingles have one global order: rising count of the hash
bucket they fall in (counted over all documents), then hash.  A node's prefix for l matches has
size - ceil(threshold * size) + l shingles; two nodes above the threshold share at least
min(l1, l2) of them.  Each node picks the l in 1..`most_matches` with the least estimated cost of
scanning its prefix and checking its candidates.

Links are found in two rounds, so that a group of near copies never yields all its pairs:
1. every prefix shingle held by two nodes or more links its nodes to those which, in each band of
   sizes, hold it at the earliest place, if the exact check agrees; components are found by large-star/small-star;
2. nodes in different components that were compared with one hub are joined on the shingles in
   which they differ from it: near copies of one text that do not link share few of those;
   for shingles whose nodes still lie in several components and have several hubs, nodes that hold
   it early enough are paired with those of other components and hubs; pairs with min(l1, l2)
   shared shingles, at places and with sizes that allow a link, are checked exactly.
Pairs inside a component cannot change the classes and are left out; nothing else is.

Defined results: a null or wordless text has no shingles and is linked with nothing; a text with
fewer words than `width` is one shingle; repeated rows are exact copies; rows with a null doc_id
keep their class but do not name it unless they are alone in it (then null); an empty table gives
an empty result.  Node ids are 64-bit hashes of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SLICES = 64
#: Documents to check are broadcast up to this many (about 100 bytes each), joined by shuffle beyond.
BROADCAST_IDS = 500_000
#: Labels and anchors of nodes likewise (24 bytes each).
BROADCAST_NODES = 1_000_000
#: A shingle has a hub for each band of set sizes, each so many times the last.
BAND = 1.5


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = common.word_hashes(words)
    return np.unique(common.window_hashes(h, min(width, len(h)), seed=min(width, len(h))))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), 1) - (1 << 63)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes | None]]:
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield doc_id, (text.as_buffer().to_pybytes() if text.is_valid else None)


def bucket_counts(docs: DataFrame, width: int, buckets: int) -> np.ndarray:
    """How many shingles of all documents fall in each hash bucket: `buckets` numbers in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            held = [shingle_set(t, width) for _, t in _texts(batch)]
            if held:
                total += np.bincount((np.concatenate(held) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        for i, part in enumerate(np.array_split(total, SLICES)):
            kind = np.uint16 if part.max(initial=0) < 1 << 16 else np.uint64
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.astype(kind).tobytes()], pa.binary())], names=["slice", "counts"])

    sizes = [len(x) for x in np.array_split(np.zeros(buckets, np.uint8), SLICES)]

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sizes[key[0].as_py()], np.uint64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.uint16 if len(x.as_buffer()) == 2 * len(total) else np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])

    rows = common.ordered_lang_free(docs).mapInArrow(count, "slice long, counts binary").groupBy("slice").applyInArrow(add, "slice long, counts binary").collect()
    parts = {r.slice: np.frombuffer(r.counts, np.uint64) for r in rows}
    return np.concatenate([parts[i] for i in range(SLICES)]) if parts else np.zeros(buckets, np.uint64)


def prefix(shingles: np.ndarray, counts: np.ndarray, floor: int, percent: int, most_matches: int) -> tuple[np.ndarray, int]:
    """The node's prefix shingles and its number of required matches."""
    n = len(shingles)
    c = counts[(shingles % np.uint64(len(counts))).astype(np.int64)].astype(np.int64)
    need = -(-percent * n // 100)
    longest = n - need + min(most_matches, need)
    order = np.lexsort((shingles, c))[:longest]
    partners = np.cumsum(np.maximum(c[order] - floor, 0) + 0.5)  # about how many rows the prefix meets
    best, cost = 1, None
    for l in range(1, min(most_matches, need) + 1):
        met = float(partners[n - need + l - 1])
        now = met + 200.0 * met / l**3 + 4.0 * l  # rows read, checks that remain, own rows sent
        if cost is None or now < cost:
            best, cost = l, now
    return shingles[order[: n - need + best]], best


def packed(n: str, at: str, matches: str) -> Column:
    """A node's size (32 bits), the place of a shingle in its prefix (26) and its required matches (4) as one long."""
    return F.shiftleft(F.col(n), 30) + F.shiftleft(F.col(at).cast("long"), 4) + F.col(matches)


def size_of(info: str) -> Column:
    return F.shiftright(F.col(info), 30)


def place(info: str) -> Column:
    return F.shiftright(F.col(info), 4).bitwiseAND(F.lit((1 << 26) - 1))


def wanted(info: str) -> Column:
    return F.col(info).bitwiseAND(F.lit(15))


def band(info: str) -> Column:
    """Sizes of one band differ by less than a factor of `BAND`, so that half of two sets' union can be common; there are at most 55."""
    return F.floor(F.log(size_of(info).cast("double")) / F.lit(float(np.log(BAND)))).cast("int")


def may_link(ia: str, ib: str, percent: int) -> Column:
    """Whether sizes and places of a shared shingle allow a link.

    If it is the k-th that two nodes share, at least at_a + at_b - 2 (k - 1) shingles before it and
    |rest_a - rest_b| after it are in one of them only, and a link allows (100 - percent) / (100 + percent) of both sizes.  The first
    min(l1, l2) that a linked pair shares have k <= min(l1, l2) and all pass."""
    n = size_of(ia) + size_of(ib)
    fits = 100 * F.least(size_of(ia), size_of(ib)) >= percent * F.greatest(size_of(ia), size_of(ib))
    apart = place(ia) + place(ib) - 2 * (F.least(wanted(ia), wanted(ib)) - 1) + F.abs((size_of(ia) - place(ia)) - (size_of(ib) - place(ib)))
    return fits & ((100 + percent) * apart <= (100 - percent) * n)


def is_early(info: str, percent: int) -> Column:
    """True wherever the node may hold the shingle at the earlier place of a pair that may_link passes."""
    return 2 * percent * (place(info) - wanted(info) + 1) <= (100 - percent) * size_of(info)


def components(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, label) of every linked node, label being the least node of its component.

    Alternating large-star and small-star until the edges are stable stars; each round's edges are
    checkpointed.  An error if a bound is given and they are not stable after it."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = edges.checkpoint()
    before, rounds = None, 0
    while True:
        if most_rounds is not None and rounds >= most_rounds:
            raise RuntimeError(f"components not stable after {most_rounds} rounds")
        rounds += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m", "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = small.checkpoint()
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


HELD = "a long, salt int, tail boolean, node long, shingles binary"
COMPARED = "a long, b long, linked boolean, size long, only_b array<long>, only_a array<long>"


def _compare(pairs: DataFrame, docs: DataFrame, ids: DataFrame, scratch: common.Scratch, name: str, width: int, percent: int, salts: int = 16) -> DataFrame:
    """a, b, linked (the exact test) and how b differs from a: size (of b), only_b, only_a.

    The last two are null where the sets have less than half of their union in common.  Each set is
    computed where one of its documents lies and goes once to each of its comparisons: the set of a
    first, then those of its partners b, in as many groups as a hot a has salts.  Sets that only
    rows with a null doc_id hold are found among those rows by their hash."""
    salt = F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int").alias("salt")
    jobs = pairs.select(F.col("a").alias("node"), "a", salt, F.lit(False).alias("tail")).distinct().unionByName(pairs.select(F.col("b").alias("node"), "a", salt, F.lit(True).alias("tail")))
    jobs = jobs.groupBy("node").agg(F.collect_list(F.struct("a", "salt", "tail")).alias("jobs"))  # no more than the node has prefix shingles and salts
    at = scratch.store(ids.groupBy("node").agg(F.min("doc_id").alias("_nd_doc")).join(jobs, "node"), f"{name}-jobs")
    nameless = at.where("_nd_doc IS NULL")
    by_doc = at.where("_nd_doc IS NOT NULL").groupBy("_nd_doc").agg(F.collect_list(F.struct("node", "jobs")).alias("asked"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # repeated rows are sent once a task
        for batch in batches:
            rows: list[tuple] = []
            for (_, text), asked in zip(_texts(batch), batch.column(2)):
                s = shingle_set(text, width)
                node = node_of(s) if len(s) else None
                if node is None or node in done:
                    continue
                if len(done) < 2_000_000:
                    done.add(node)
                data = s.tobytes()
                for x in asked.as_py():
                    if x["node"] == node:
                        rows += [(j["a"], j["salt"], j["tail"], node, data) for j in x["jobs"]]
                if len(rows) > 500:
                    yield _held(rows)
                    rows = []
            yield _held(rows)

    text = F.col("text").cast("binary").alias("text")
    held = docs.select("doc_id", text).join(common.small(by_doc, BROADCAST_IDS), F.col("doc_id") == F.col("_nd_doc")).select("doc_id", "text", "asked").mapInArrow(sets_of, HELD)
    if not nameless.isEmpty():
        others = common.ordered_lang_free(docs.where("doc_id IS NULL")).mapInArrow(_named_sets(width), "node long, shingles binary").dropDuplicates(["node"])
        held = held.unionByName(others.join(nameless.select("node", F.explode("jobs").alias("j")), "node").select("j.a", "j.salt", "j.tail", "node", "shingles"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, x = None, None
        for batch in batches:
            out: list[tuple] = []
            for a, salt, tail, node, data in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                y = np.frombuffer(data.as_buffer(), np.uint64)
                if not tail:
                    group, x = (a, salt), y.copy()
                    continue
                if group != (a, salt):
                    raise RuntimeError(f"the set of node {a} is missing")
                both = np.intersect1d(x, y, assume_unique=True)
                near = 2 * len(both) >= len(x) + len(y) - len(both)
                differ = [common.signed(np.setdiff1d(p, both, assume_unique=True)) if near else None for p in (y, x)]
                out.append((a, node, 100 * len(both) >= percent * (len(x) + len(y) - len(both)), len(y), *differ))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split(" ")[0] for x in COMPARED.split(", ")])

    out = scratch.store(held.repartition("a", "salt").sortWithinPartitions("a", "salt", "tail").mapInArrow(test, COMPARED), name)
    scratch.drop(f"{name}-jobs")
    return out


def _held(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split(" ")[0] for x in HELD.split(", ")])


def _named_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [x for x in (shingle_set(t, width) for _, t in _texts(batch)) if len(x)]
            for i in range(0, len(s), 1000):
                part = s[i : i + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in part], pa.int64()), pa.array([x.tobytes() for x in part], pa.binary())], names=["node", "shingles"])

    return run


def _anchored(compared: DataFrame) -> DataFrame:
    """node, anchor, size, ups, downs: each node's difference from one hub, that which most nodes were compared with."""
    near = compared.where("only_b IS NOT NULL")
    asked = near.groupBy("a").agg(F.count(F.lit(1)).alias("asked"))
    return near.join(asked, "a").groupBy(F.col("b").alias("node")).agg(F.max_by(F.struct(F.col("a").alias("anchor"), "size", F.col("only_b").alias("ups"), F.col("only_a").alias("downs")), F.struct("asked", "a")).alias("own")).select("node", "own.*")


def _differ_alike(anchored: DataFrame, label: DataFrame, percent: int, scratch: common.Scratch) -> DataFrame:
    """Pairs (a, b) of nodes with one anchor and different labels that may link.

    Nodes A, B with anchor H differ in |dA| + |dB| - 2 |dA & dB| shingles, dX being how X differs from
    H.  If dA and dB have nothing in common and A, B link, then both link with H, hence have one
    label.  So the join is on shared elements of the differences, rarest first, with the bound on
    their places: the first shared one has at_a + at_b + |rest_a - rest_b| <= the allowed difference."""
    who = anchored.join(label, "node", "left").select("node", "anchor", "size", F.coalesce("label", "node").alias("label"), F.size("ups").alias("n_up"), F.size("downs").alias("n_down"), "ups", "downs")
    # the element of a difference: a shingle with the sign of the difference in the last bit of its hash
    signed = F.concat(F.transform("ups", lambda x: F.xxhash64(x, F.lit(1))), F.transform("downs", lambda x: F.xxhash64(x, F.lit(0))))
    rows = who.select("node", "anchor", "label", "size", (F.col("n_up") + F.col("n_down")).cast("long").alias("d"), F.explode(signed).alias("element"))
    often = rows.groupBy("anchor", "element").agg(F.count(F.lit(1)).alias("often"), F.min("label").alias("low"), F.max("label").alias("high"))
    rows = rows.join(often, ["anchor", "element"]).withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("often", "element")).cast("long") - 1)
    most = (100 - percent) * F.col("size")  # percent times the most that a linked node may differ
    rows = rows.where((F.col("low") < F.col("high")) & (percent * F.col("at") <= most)).select("anchor", "element", "node", "label", "size", "d", "at", (2 * percent * F.col("at") <= most).alias("early"))
    rows = scratch.store(rows, "differences")
    named = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "size", "d", "at", "early")]
    met = rows.where("early").select("anchor", "element", *named("a")).join(rows.select("anchor", "element", *named("b")), ["anchor", "element"])
    apart = F.col("at_a") + F.col("at_b") + F.abs((F.col("d_a") - F.col("at_a")) - (F.col("d_b") - F.col("at_b")))
    met = met.where((F.col("label_a") != F.col("label_b")) & (~F.col("early_b") | (F.col("node_a") < F.col("node_b"))) & ((100 + percent) * apart <= (100 - percent) * (F.col("size_a") + F.col("size_b"))))
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicate_classes(docs: DataFrame, width: int = 5, percent: int = 80, most_matches: int = 6, buckets: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, node, component_id for every row of docs."""
    out = _classes(docs, width, percent, most_matches, buckets)
    return out.select("doc_id", "n_shingles", "node", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _classes(docs: DataFrame, width: int, percent: int, most_matches: int = 6, buckets: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, node, class (its least node) and the class's least doc_id for every row of docs."""
    spark = docs.sparkSession
    counts = bucket_counts(docs, width, buckets)
    floor = int(np.median(counts)) if len(counts) else 0
    shared = spark.sparkContext.broadcast((counts, floor))
    texts = common.ordered_lang_free(docs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, floor = shared.value
        done: set[int] = set()
        for batch in batches:
            node, size, pre, match = [], [], [], []
            for _, text in _texts(batch):
                s = shingle_set(text, width)
                size.append(len(s))
                node.append(node_of(s) if len(s) else None)
                if not len(s) or node[-1] in done:  # copies met before in this task send no prefix
                    pre.append(None)
                    match.append(0)
                    continue
                if len(done) < 2_000_000:
                    done.add(node[-1])
                p, l = prefix(s, counts, floor, percent, most_matches)
                pre.append(common.signed(p))
                match.append(l)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(match, pa.int32()), pa.array(pre, pa.list_(pa.int64()))],
                names=["doc_id", "node", "n_shingles", "matches", "prefix"],
            )

    scratch = common.Scratch(spark, "jaccard")
    all_docs = scratch.store(texts.mapInArrow(emit, "doc_id long, node long, n_shingles long, matches int, prefix array<long>"), "prefix")
    ids = scratch.store(all_docs.select("doc_id", "n_shingles", "node"), "ids")
    rows = all_docs.where("prefix IS NOT NULL").select(F.posexplode("prefix").alias("at", "token"), "node", "n_shingles", "matches")
    rows = rows.select("token", "node", packed("n_shingles", "at", "matches").alias("info"))
    many = rows.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    # one row per shingle and node: a node that several tasks have sent counts once
    met = scratch.store(rows.join(many, "token").dropDuplicates(["token", "node"]), "met")
    scratch.drop("prefix")
    # round 1: each shingle's nodes against that which holds it at the earliest place
    # of its own size band, and with the hubs of other bands whose sizes allow a link
    hubs = met.groupBy("token", band("info").alias("band")).agg(F.min(F.struct(place("info").alias("at"), "node", "info")).alias("hub"), F.count(F.lit(1)).alias("held"))
    hubs = hubs.groupBy("token").agg(F.collect_list(F.struct("band", F.col("hub.node").alias("a"), F.col("hub.info").alias("ia"))).alias("hubs"), F.sum("held").alias("held")).where("held > 1").drop("held")
    star = met.select("token", F.col("node").alias("b"), F.col("info").alias("ib")).join(hubs, "token").select("b", "ib", band("ib").alias("band"), F.explode("hubs").alias("hub"))
    sizes = 100 * F.least(size_of("hub.ia"), size_of("ib")) >= percent * F.greatest(size_of("hub.ia"), size_of("ib"))
    star = star.where((F.col("hub.a") != F.col("b")) & ((F.col("hub.band") == F.col("band")) | sizes)).select("b", "ib", "hub.a", "hub.ia")
    # also those that can't link, if half of their union may be common: round 2a needs how they differ from the hub
    first = star.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least(wanted("ia"), wanted("ib"))).alias("want"))
    # a star counts only the shingles whose hub is a; pairs it is unsure of are left to round 2
    first = scratch.store(first.where("shared >= greatest(2, want)").select("a", "b"), "pairs")
    compared = _compare(first, docs, ids, scratch, "compared", width, percent)
    links = scratch.store(compared.where("linked").select("a", "b"), "links")
    label = scratch.store(components(links), "label")
    near_label = common.small(label, BROADCAST_NODES)
    # round 2a: nodes with one anchor, by what they do not share with it
    anchored = scratch.store(_anchored(compared), "anchored")
    scratch.drop("compared")
    alike = scratch.store(_differ_alike(anchored, near_label, percent, scratch), "alike")
    # round 2b: shingles whose nodes differ in component and anchor; those of the commonest anchor never meet each other
    placed = met.join(near_label, "node", "left").join(common.small(anchored.select("node", "anchor"), BROADCAST_NODES), "node", "left")
    placed = placed.select("token", "node", "info", F.coalesce("label", "node").alias("label"), F.coalesce("anchor", "node").alias("anchor"), is_early("info", percent).alias("early"))
    shares = placed.groupBy("token", "anchor").agg(F.count(F.lit(1)).alias("held"), F.min("label").alias("low"), F.max("label").alias("high"))
    shares = shares.groupBy("token").agg(F.max_by("anchor", F.struct("held", "anchor")).alias("main"), F.count(F.lit(1)).alias("anchors"), F.min("low").alias("low"), F.max("high").alias("high"))
    placed = placed.join(shares.where("anchors > 1 AND low < high").select("token", "main"), "token").withColumn("other", F.col("anchor") != F.col("main"))
    placed = scratch.store(placed.drop("main"), "split")
    scratch.drop("met", "differences", "anchored")
    left = placed.where("early").select("token", F.when(F.col("other"), 0).otherwise(1).alias("side"), F.col("node").alias("a"), F.col("info").alias("ia"), F.col("label").alias("la"), F.col("anchor").alias("ha"))
    sides = F.when(F.col("other") & ~F.col("early"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    right = placed.select("token", F.explode(sides).alias("side"), F.col("node").alias("b"), F.col("info").alias("ib"), F.col("label").alias("lb"), F.col("anchor").alias("hb"), (F.col("early") & F.col("other")).alias("eb"))
    cross = left.join(right, ["token", "side"]).where((F.col("la") != F.col("lb")) & (F.col("ha") != F.col("hb")) & may_link("ia", "ib", percent) & (~F.col("eb") | (F.col("a") < F.col("b"))))
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least(wanted("ia"), wanted("ib")).alias("want"), (size_of("ia") + size_of("ib")).alias("n"), (place("ia") + place("ib")).alias("at"))
    cross = cross.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("want").alias("want"), F.max("n").alias("n"), F.max("at").alias("at"))
    # the passed shingles are the first that a pair shares, so the last of them bounds the difference best
    cross = cross.where((F.col("shared") >= F.col("want")) & ((100 + percent) * (F.col("at") - 2 * (F.col("shared") - 1)) <= (100 - percent) * F.col("n"))).select("a", "b")
    cross = cross.unionByName(alike).distinct().join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    cross = scratch.store(cross, "cross")
    scratch.drop("split", "alike", "pairs")
    more = scratch.store(_compare(cross, docs, ids, scratch, "compared-again", width, percent).where("linked").select("a", "b"), "more")
    scratch.drop("compared-again", "cross")
    if not more.isEmpty():
        near_label = common.small(scratch.store(components(links.unionByName(more)), "label-again"), BROADCAST_NODES)
    out = ids.join(near_label, "node", "left").withColumn("class", F.coalesce("label", "node"))
    # copies meet by node before classes do, so that a hot class is a few rows by then
    names = out.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    names = names.join(out.where("class IS NOT NULL").select("node", "class").distinct(), "class").select("node", "class", "least")
    return ids.join(common.small(names, BROADCAST_NODES), "node", "left")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class stays, one of those with the least doc_id (null last).  Rows without shingles stay."""
    known = common.stored(_classes(docs, width, percent).select("doc_id", "node", "class", "least"), "jaccard-classes")
    again = common.stored(known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_nd_spare")), "jaccard-again")
    spare = known.where("least <> doc_id").select(F.col("doc_id").alias("_nd_spare"))
    repeated = not again.isEmpty()
    if not repeated and known.where("doc_id IS NULL").isEmpty():
        return docs.join(spare, F.col("doc_id") == F.col("_nd_spare"), "left_anti")
    # an id that is null or repeated does not tell rows apart: such rows go by their own hash and a number
    clear = docs.where("doc_id IS NOT NULL").join(spare.unionByName(again), F.col("doc_id") == F.col("_nd_spare"), "left_anti")
    odd = docs.where("doc_id IS NULL")
    if repeated:
        odd = odd.unionByName(docs.join(again, F.col("doc_id") == F.col("_nd_spare"), "left_semi"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_buffer().to_pybytes() if x.is_valid else None, width) for x in batch.column("_nd_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_nd_row"), batch.column("_nd_doc"), pa.array([node_of(x) if len(x) else None for x in sets], pa.int64())], names=["_nd_row", "_nd_doc", "node"])

    odd = common.stored(odd.withColumn("_nd_row", F.monotonically_increasing_id()), "jaccard-odd")
    rows = odd.select("_nd_row", F.col("doc_id").alias("_nd_doc"), F.col("text").cast("binary").alias("_nd_text")).mapInArrow(named, "_nd_row long, _nd_doc long, node long")
    rows = rows.join(known.where("node IS NOT NULL").select("node", "class", "least").distinct(), "node", "left")
    first = F.min_by("_nd_row", F.struct(F.col("_nd_doc").isNull(), "_nd_doc", "_nd_row"))
    best = rows.where("class IS NOT NULL AND _nd_doc <=> least").groupBy("class").agg(first.alias("_nd_row")).select("_nd_row")
    stay = best.unionByName(rows.where("class IS NULL").select("_nd_row"))
    return clear.unionByName(odd.join(stay, "_nd_row", "left_semi").select(*docs.columns))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(common.table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


OP5_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2)::BIGINT)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS label FROM n UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node AND r.label < e.b),
c AS (SELECT node, min(label) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
