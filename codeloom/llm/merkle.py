"""Merkle manifest of a dataset: one tree for each language, one tree over their roots, and proofs.

Leaves are numbered within their language by a sorted range shuffle and a prefix over its partitions.
The tree is a sparse forest: what a partition cannot yet resolve stays as open nodes keyed by (tree,
level, index).  Sizes are known beforehand, hence the arity of every sibling run, so joining two
forests is associative and commutative: a run becomes its parent as soon as its last sibling is there.
Partitions resolve their own leaves and write the nodes; treeReduce joins the few open nodes that
each leaves at its two ends (at most 14 a level).

Proofs go down from the root, `STEP` levels a join: blocks of 8^STEP nodes meet the path of the node
above them, so a path travels once a block, and no group holds more than a block.

The driver sees one row for each (partition, language) and the open nodes: neither grows with the
rows of a partition.  The number of languages must fit the driver.

Defined results: every field may be null; leaves of a language ascend by doc_id, null first, those of
equal doc_id by digest; repeated rows are leaves of their own with the same digest and their own
proofs; null and '' are two languages; an empty table has no leaf, no root and no proof; further
columns are ignored, whatever their names; a text of any length is one leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
STEP = 2
BLOCK = ARITY**STEP
PATH = "array<struct<left:string,right:string>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: dict[str, Column]) -> Column:
    """The digest of the fields in the order of FIELDS, each with its length in bytes, '-' for null."""
    text = [fields[f].cast("string") for f in FIELDS]
    return F.sha2(F.concat(*(F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in text)).cast("binary"), 256)


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    h = 0
    while size > 1:
        size, h = -(-size // ARITY), h + 1
    return h


class Forest:
    """Open sibling runs {(tree, level, parent's index): {place: digest}} and the nodes made of whole runs."""

    def __init__(self, sizes: list[int]):
        self.sizes, self.open, self.made = sizes, {}, []

    def add(self, tree: int, level: int, index: int, value: str) -> None:
        top = height(self.sizes[tree])
        if level == 0 == top:
            self.made.append((tree, 0, 0, value))
        while level < top:
            key = (tree, level, index // ARITY)
            run = self.open.setdefault(key, {})
            run[index % ARITY] = value
            width = -(-self.sizes[tree] // ARITY**level)
            if len(run) < min(ARITY, width - ARITY * key[2]):
                return
            del self.open[key]
            level, index, value = level + 1, key[2], digest([run[i] for i in sorted(run)])
            self.made.append((tree, level, index, value))

    def nodes(self) -> Iterator[tuple[int, int, int, str]]:
        for (tree, level, parent), run in self.open.items():
            for place, value in run.items():
                yield tree, level, ARITY * parent + place, value

    def join(self, other: Forest) -> Forest:
        """Both forests' nodes; associative and commutative, with the empty forest as its unit."""
        if len(self.open) < len(other.open):
            self, other = other, self
        self.made += other.made
        for node in other.nodes():
            self.add(*node)
        return self


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by language: their partition, and their place in their language in it."""
    part, begun, last, at = TaskContext.get().partitionId(), False, None, 0
    for batch in batches:
        place = np.empty(batch.num_rows, np.int64)
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            if not begun or lang != last:
                begun, last, at = True, lang, 0
            place[i] = at
            at += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)], names=[*batch.schema.names, "part", "place"])


NODE = "tree int, level int, index long, digest string, is_open boolean"


def _resolver(sizes: list[int]):
    def rows(nodes, is_open: bool) -> pa.RecordBatch:
        tree, level, index, value = zip(*nodes)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((tree, level, index, value, [is_open] * len(tree)), kinds)], names=["tree", "level", "index", "digest", "is_open"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(sizes)
        for batch in batches:
            for tree, index, value in zip(*(batch.column(c).to_pylist() for c in ("tree", "index", "leaf"))):
                forest.add(tree, 0, index, value)
            if forest.made:
                yield rows(forest.made, False)
                forest.made = []
        if left := list(forest.nodes()):
            yield rows(left, True)

    return resolve


def _levels(values: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root over these nodes, and for each level what stands left and right of each node in its run."""
    out = []
    while len(values) > 1:
        runs = [values[i : i + ARITY] for i in range(0, len(values), ARITY)]
        out.append([("".join(r[:i]), "".join(r[i + 1 :])) for r in runs for i in range(len(r))])
        values = [digest(r) for r in runs]
    return values[0], out


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, index, doc_id, leaf, claimed; nodes: all of levels 1 and up (and lone leaves);
    trees: tree, lang, n_leaves, subroot and its path to the root; root: None if there is no leaf."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    sizes: list[int]
    root: str | None


def build(leaves: DataFrame, leaves_per_partition: int = 200_000) -> Manifest:
    """leaves: lang, doc_id, leaf, claimed (a digest to be proved, which takes no part in the tree)."""
    spark = leaves.sparkSession
    scratch = common.Scratch(spark, "merkle")
    leaves = scratch.store(leaves.select("lang", "doc_id", "leaf", "claimed"), "digests")
    order = [F.col(c).asc_nulls_first() for c in ("lang", "doc_id", "leaf")]
    cut = leaves.repartitionByRange(common.partitions_for(spark, leaves.count(), leaves_per_partition), *order).sortWithinPartitions(*order)
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
    numbered = scratch.store(cut.mapInArrow(_number, f"lang string, doc_id {kinds['doc_id']}, leaf string, claimed string, part int, place long"), "numbered")
    scratch.drop("digests")

    counts = sorted(((r.lang is not None, (r.lang or "").encode(), r.part, r.n, r.lang) for r in numbered.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda r: r[:3])
    langs, sizes, begins = [], [], []
    for _, _, part, n, lang in counts:
        if not langs or lang != langs[-1]:
            langs.append(lang)
            sizes.append(0)
        begins.append((part, lang, len(langs) - 1, sizes[-1]))
        sizes[-1] += n
    where = spark.createDataFrame(begins, "b_part int, b_lang string, tree int, begin long")
    on = (F.col("part") == F.col("b_part")) & F.col("lang").eqNullSafe(F.col("b_lang"))
    placed = numbered.join(F.broadcast(where), on).select("tree", (F.col("place") + F.col("begin")).alias("index"), "doc_id", "leaf", "claimed")

    nodes = scratch.store(placed.select("tree", "index", "leaf").mapInArrow(_resolver(sizes), NODE), "nodes")

    def gather(rows) -> Iterator[Forest]:
        forest = Forest(sizes)
        for r in rows:
            forest.add(*r)
        yield forest

    still_open = nodes.where("is_open").select("tree", "level", "index", "digest").rdd.mapPartitions(gather)
    forest = still_open.treeReduce(Forest.join) if still_open.getNumPartitions() else Forest(sizes)
    if forest.open:
        raise RuntimeError(f"{len(forest.open)} sibling runs have not met their last node")
    spine = spark.createDataFrame(forest.made, "tree int, level int, index long, digest string")
    tops = spark.createDataFrame([(i, height(n)) for i, n in enumerate(sizes)], "t_tree int, t_level int")
    nodes = nodes.where("NOT is_open").drop("is_open").unionByName(spine)
    subroots = dict(nodes.join(F.broadcast(tops), (F.col("tree") == F.col("t_tree")) & (F.col("level") == F.col("t_level"))).select("tree", "digest").collect())

    root, above = _levels([subroots[i] for i in range(len(sizes))]) if sizes else (None, [])
    path = lambda i: [level[i // ARITY**k] for k, level in enumerate(above)]
    trees = spark.createDataFrame([(i, lang, n, subroots[i], path(i)) for i, (lang, n) in enumerate(zip(langs, sizes))], f"tree int, lang string, n_leaves long, subroot string, path {PATH}")
    return Manifest(placed, nodes, trees, sizes, root)


def _descender(heights: list[int], level: int, payload: list[str], schema: pa.Schema):
    """Sorted rows: for each block its path (index -1) and then its nodes, which get theirs."""

    def paths(rows: list[dict], above: list[dict]) -> Iterator[list[dict]]:
        values = [r["digest"] for r in rows]
        steps = []
        for _ in range(min(STEP, heights[rows[0]["tree"]] - level)):
            runs = [values[i : i + ARITY] for i in range(0, len(values), ARITY)]
            steps.append([{"left": "".join(r[:i]), "right": "".join(r[i + 1 :])} for r in runs for i in range(len(r))])
            values = [digest(r) for r in runs]
        for i in range(len(rows)):
            yield [s[i // ARITY**k] for k, s in enumerate(steps)] + above

    def out(rows: list[dict], above: list[dict]) -> pa.RecordBatch:
        found = [{c: r[c] for c in ("tree", "index", "digest", *payload)} | {"path": p} for r, p in zip(rows, paths(rows, above))]
        return pa.RecordBatch.from_pylist(found, schema)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, above, rows = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["tree"], r["block"]) != key:
                    if rows:
                        yield out(rows, above)
                    key, above, rows = (r["tree"], r["block"]), r["path"], []
                else:
                    rows.append(r)
        if rows:
            yield out(rows, above)

    return descend


def proofs(m: Manifest) -> DataFrame:
    """tree, index, digest (the leaf), doc_id, claimed and its path: for each level up to the root,
    the joined digests left and right of the node in its run."""
    heights = [height(n) for n in m.sizes]
    spark = m.leaves.sparkSession
    doc_type = m.leaves.schema["doc_id"].dataType.simpleString()
    above = None
    known = spark.createDataFrame([(i, h) for i, h in enumerate(heights)], "h_tree int, height int")
    for level in range((max([1, *heights]) - 1) // STEP * STEP, -1, -STEP):
        payload = ["doc_id", "claimed"] if level == 0 else []
        if level:
            nodes = m.nodes.where(F.col("level") == level).select("tree", "index", "digest")
        else:
            nodes = m.leaves.select("tree", "index", F.col("leaf").alias("digest"), *payload)
        # the subroot is a block of its own where no level lies above it
        ends = m.trees.join(F.broadcast(known), F.col("tree") == F.col("h_tree")).where((F.col("height") <= level + STEP) & ((F.col("height") > level) | (F.lit(level) == 0)))
        heads = ends.select("tree", F.lit(0).cast("long").alias("block"), "path")
        if above is not None:
            heads = heads.unionByName(above.select("tree", F.col("index").alias("block"), "path"))
        inner = nodes.join(F.broadcast(known), F.col("tree") == F.col("h_tree")).where((F.col("height") > level) | (F.lit(level) == 0)).drop("h_tree", "height")
        rows = inner.withColumn("block", F.floor(F.col("index") / BLOCK).cast("long")).unionByName(heads.withColumn("index", F.lit(-1).cast("long")), allowMissingColumns=True)
        extra = "".join(f", {c} {doc_type if c == 'doc_id' else 'string'}" for c in payload)
        fields = [pa.field("tree", pa.int32()), pa.field("index", pa.int64()), pa.field("digest", pa.string())]
        kinds = {"doc_id": {"bigint": pa.int64(), "int": pa.int32()}.get(doc_type, pa.string()), "claimed": pa.string()}
        fields += [pa.field(c, kinds[c]) for c in payload]
        schema = pa.schema([*fields, pa.field("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))])
        n = common.partitions_for(spark, sum(-(-s // ARITY**level) for s in m.sizes), 100_000)
        dealt = rows.repartition(n, "tree", "block").sortWithinPartitions("tree", "block", "index")
        above = dealt.mapInArrow(_descender(heights, level, payload, schema), f"tree int, index long, digest string{extra}, path {PATH}")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    fields = {f: F.col(f) for f in FIELDS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    claimed = F.when(tampered, leaf_digest(fields | {"text": common.ascii_lower(F.col("text"))})).otherwise(leaf_digest(fields))
    m = build(docs.select("lang", "doc_id", leaf_digest(fields).alias("leaf"), claimed.alias("claimed")))
    found = proofs(m).join(F.broadcast(m.trees.select(F.col("tree").alias("t_tree"), "subroot")), F.col("tree") == F.col("t_tree"))
    folded = fold(F.col("claimed"), F.col("path"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END" for c in (*FIELDS[:-1], text)) + ")"


# crc32 goes through the bits of the decimal doc_id; steps of a proof are texts 'left|right'
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, {_sql_leaf("text")} AS leaf, {_sql_leaf(f"translate(text, '{common.UPPER}', '{common.LOWER}')")} AS lowered,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, [((ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1)::BIGINT for i in range(8 * length(doc_id::VARCHAR))]),
      lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS claimed FROM d),
nodes(tree, level, idx, digest, n) AS (
  SELECT tree, 0, idx, leaf, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), max((n + 7) // 8) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8),
subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
tops(level, idx, digest, n) AS (
  SELECT 0, tree, digest, (SELECT count(*) FROM subroots) FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), max((n + 7) // 8) FROM tops WHERE n > 1 GROUP BY level, idx // 8),
placed AS (SELECT tree, level, idx, digest, n FROM nodes UNION ALL SELECT -1, level, idx, digest, n FROM tops),
steps AS (
  SELECT tree, level, idx,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' ||
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
  FROM placed WHERE n > 1),
chains AS (
  SELECT l.tree, l.idx, coalesce(list(s.step ORDER BY s.tree < 0, s.level) FILTER (s.step IS NOT NULL), []) AS chain
  FROM leaves l LEFT JOIN steps s ON (s.tree = l.tree AND s.idx = CAST(floor(l.idx / pow(8, s.level)) AS BIGINT)) OR (s.tree = -1 AND s.idx = CAST(floor(l.tree / pow(8, s.level)) AS BIGINT))
  GROUP BY l.tree, l.idx),
folded AS (
  SELECT l.*, sha256(replace(array_to_string(c.chain, ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(l.claimed, c.chain), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM leaves l JOIN chains c USING (tree, idx))
SELECT f.doc_id, f.leaf, s.digest AS subroot, r.digest AS root, f.proof_sha256, f.folded_root, f.folded_root = r.digest AS verified
FROM folded f JOIN subroots s USING (tree), (SELECT digest FROM tops WHERE n = 1) r
"""
