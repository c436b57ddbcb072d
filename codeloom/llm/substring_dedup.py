"""Substring dedup on a compacted de Bruijn graph of token k-mers.

A window of `k` words is an edge of the graph (its first and last k-1 words are its nodes).
Repeated edges are found and compacted as follows.

1. An edge's minimiser is the least hash among its word `M`-grams; equal edges have equal
   minimisers.  Only minimisers that occur twice or more can lie in repeated edges, so their
   occurrences are counted first, in a shuffle of one small row each.
2. Consecutive edges of one minimiser are one nonbranching stretch: a row with its coordinates
   (document, start) and its edges' hashes.  Stretches meet by minimiser; of equal edges the
   earliest coordinates are the source, later ones become paths (document, start, edges, source
   document, source start), where edges and sources advance together.
3. Paths are compacted through Spark: a path continues another if document, end and source
   coordinates fit, which a window over the document's paths joins into maximal repeated spans.

An edge is known by two independent 64-bit hashes, of its words and of its minimiser.  Rows of a
very common passage are combined before every shuffle: a slab of texts sends each of its edges
once and settles later copies itself.

A document is known by its doc_id and two hashes of its text.  While each doc_id has one text, doc_id
is the number it goes by; else all documents are numbered in the order of doc_id (null first) and
hashes, by a range shuffle and a prefix over its partitions.

Defined results: a null text has no words; texts shorter than `k` words lose nothing; rows that repeat
doc_id and text are one document (judged alike, no copies of each other); different texts under one
doc_id, or under none, are different documents, the one of smaller hashes first; a null doc_id counts
as the least; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators import prefix

from . import common

M = 8
PATHS = "doc_id long, start int, edges int, src_doc long, src_start int"


def slabs(batch: pa.RecordBatch, most_bytes: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each, one row at least."""
    size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")], np.int64)
    at, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > most_bytes:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def _docs(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        yield doc_id, (text.as_buffer().to_pybytes().split() if text.is_valid else [])


def edges_of(words: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of k words: place and hash of its minimiser, and the hash of the window."""
    if len(words) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = common.word_hashes(words)
    grams = common.window_hashes(h, min(M, k))
    at = np.lib.stride_tricks.sliding_window_view(grams, k - min(M, k) + 1).argmin(1)
    at += np.arange(len(at))
    return at, grams[at], common.window_hashes(h, k, seed=1)


def _firsts(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, mini: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (edge, document, place), and for each place in it the place of the edge's first."""
    order = np.lexsort((pos, doc, mini, key))
    k, m = key[order], mini[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _paths(doc: np.ndarray, pos: np.ndarray, sdoc: np.ndarray, spos: np.ndarray) -> pa.RecordBatch:
    """Copies (one edge each) as paths: runs in which place and source advance together."""
    o = np.lexsort((pos, doc))
    doc, pos, sdoc, spos = doc[o], pos[o], sdoc[o], spos[o]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (sdoc[1:] != sdoc[:-1]) | (spos[1:] != spos[:-1] + 1)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(doc)))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[at]), pa.array(pos[at].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(sdoc[at]), pa.array(spos[at].astype(np.int32))],
        names=["doc_id", "start", "edges", "src_doc", "src_start"],
    )


def _cat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _announce(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Minimiser occurrences: place >= 0 asks, -2 tells that the key is repeated, -1 carries known places."""
        for batch in batches:
            for slab in slabs(batch):
                docs, places, keys = [], [], []
                for doc, words in _docs(slab):
                    at, mini, _ = edges_of(words, k)
                    if len(at):
                        p, i = np.unique(at, return_index=True)
                        docs.append(np.full(len(p), doc))
                        places.append(p)
                        keys.append(mini[i])
                doc, place, key = _cat(docs, np.int64), _cat(places, np.int64), _cat(keys, np.uint64)
                uniq, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
                known = n[inverse] > 1
                told = uniq[n > 1]
                ask = ~known
                empty = [[]]
                out_key, out_doc, out_place, out_known = [common.signed(key[ask]), common.signed(told)], [doc[ask], np.zeros(len(told), np.int64)], [place[ask], np.full(len(told), -2)], empty * (int(ask.sum()) + len(told))
                if known.any():
                    d, p = doc[known], place[known]
                    cut = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                    lists = np.split(p, cut[1:])
                    out_key.append(common.signed(common.mix(d[cut].astype(np.uint64))))
                    out_doc.append(d[cut])
                    out_place.append(np.full(len(cut), -1))
                    out_known += [x.tolist() for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_key)), pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_place).astype(np.int32)), pa.array(out_known, pa.list_(pa.int32()))],
                    names=["key", "doc_id", "place", "known"],
                )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' places of minimisers that occur twice or more; a partition holds whole keys."""
    keys, docs, places = [], [], []
    for b in batches:
        place = b.column("place").to_numpy()
        ask = place != -1
        if not ask.all():
            some = b.filter(pa.array(~ask))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("known")], names=["doc_id", "places"])
        keys.append(b.column("key").to_numpy()[ask])
        docs.append(b.column("doc_id").to_numpy()[ask])
        places.append(place[ask])
    key, doc, place = _cat(keys, np.int64), _cat(docs, np.int64), _cat(places, np.int32)
    if not len(key):
        return
    o = np.argsort(key, kind="stable")
    key, doc, place = key[o], doc[o], place[o]
    same = key[1:] == key[:-1]
    twice = (np.append(False, same) | np.append(same, False)) & (place >= 0)
    doc, place = doc[twice], place[twice]
    for i in range(0, len(doc), 50_000):  # a row a place: rows follow the input, whatever the number of partitions
        d, p = doc[i : i + 50_000], place[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32)), pa.array(p, pa.int32()))], names=["doc_id", "places"])


def _stretches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of first-in-slab edges (edges > 0: hashes), and paths of later ones (packed)."""
        for batch in batches:
            for slab in slabs(batch):
                docs, pos, mini, edge, at_ = [], [], [], [], []
                for (doc, words), places in zip(_docs(slab), slab.column("places")):
                    at, m, e = edges_of(words, k)
                    flat = [x for p in places.as_py() for x in p]
                    held = np.zeros(len(words) + 1, bool)
                    held[flat] = True
                    i = np.flatnonzero(held[at]) if len(at) else np.empty(0, np.int64)
                    docs.append(np.full(len(i), doc))
                    pos.append(i)
                    mini.append(m[i])
                    edge.append(e[i])
                    at_.append(at[i])
                doc, pos, mini, edge, at = _cat(docs, np.int64), _cat(pos, np.int64), _cat(mini, np.uint64), _cat(edge, np.uint64), _cat(at_, np.int64)
                if not len(doc):
                    continue
                order, first = _firsts(edge, doc, pos, mini)
                is_first = first == np.arange(len(order))
                later, source = order[~is_first], order[first[~is_first]]
                # the same document row repeated: the same coordinates are no earlier start
                differ = (doc[later] != doc[source]) | (pos[later] != pos[source])
                later, source = later[differ], source[differ]
                keep = np.sort(order[is_first])
                new = np.ones(len(keep), bool)
                new[1:] = (doc[keep][1:] != doc[keep][:-1]) | (pos[keep][1:] != pos[keep][:-1] + 1) | (at[keep][1:] != at[keep][:-1])
                cut = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(common.signed(mini[keep][cut])), pa.array(doc[keep][cut]), pa.array(pos[keep][cut].astype(np.int32)), pa.array(np.zeros(len(cut), np.int32)),
                        pa.array(np.zeros(len(cut), np.int64)), pa.array(np.zeros(len(cut), np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.append(cut, len(keep)).astype(np.int32)), pa.array(common.signed(edge[keep]))),
                    ],
                    names=["key", "doc_id", "start", "edges", "src_doc", "src_start", "hashes"],
                )
                if len(later):
                    p = _paths(doc[later], pos[later], doc[source], pos[source])
                    key = common.signed(common.mix(p.column("doc_id").to_numpy().astype(np.uint64) + p.column("start").to_numpy().astype(np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(key), *p.columns, pa.nulls(p.num_rows, pa.list_(pa.int64()))], names=["key", *p.schema.names, "hashes"])

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of all edges that are not the first of their kind; a partition holds whole keys."""
    docs, pos, mini, edge = [], [], [], []
    for b in batches:
        path = b.column("edges").to_numpy() > 0
        if path.any():
            yield b.filter(pa.array(path)).select(["doc_id", "start", "edges", "src_doc", "src_start"])
        b = b.filter(pa.array(~path))
        if b.num_rows:
            lists = b.column("hashes")
            n = np.diff(lists.offsets.to_numpy())
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            docs.append(np.repeat(b.column("doc_id").to_numpy(), n))
            pos.append(np.repeat(b.column("start").to_numpy().astype(np.int64), n) + step)
            mini.append(np.repeat(b.column("key").to_numpy(), n))
            edge.append(lists.flatten().to_numpy())
    if not docs:
        return
    doc, pos, mini, edge = (np.concatenate(x) for x in (docs, pos, mini, edge))
    order, first = _firsts(edge, doc, pos, mini)
    copy = first != np.arange(len(order))
    later, source = order[copy], order[first[copy]]
    differ = (doc[later] != doc[source]) | (pos[later] != pos[source])
    later, source = later[differ], source[differ]
    if len(later):
        yield _paths(doc[later], pos[later], doc[source], pos[source])


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows doc_id (the document's number), own_id (its doc_id) and text, and how numbers name ids where they are not the ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("_sd_a", F.xxhash64("text")).withColumn("_sd_b", F.xxhash64(F.lit(1), "text", F.col("text").isNull()))
    key = F.struct("_sd_a", "_sd_b")
    odd = rows.groupBy("own_id").agg(F.min(key).alias("least"), F.max(key).alias("most")).where("own_id IS NULL OR least <> most")
    if odd.isEmpty():
        return rows.select(F.col("own_id").alias("doc_id"), "own_id", "text"), None
    names = prefix.numbered(rows.select("own_id", "_sd_a", "_sd_b").distinct(), "number", F.col("own_id"), F.col("_sd_a"), F.col("_sd_b"))
    names = common.stored(names.select(F.col("own_id").alias("n_id"), F.col("_sd_a").alias("n_a"), F.col("_sd_b").alias("n_b"), "number"), "names")
    on = F.col("own_id").eqNullSafe(F.col("n_id")) & (F.col("_sd_a") == F.col("n_a")) & (F.col("_sd_b") == F.col("n_b"))
    return rows.join(names, on).select(F.col("number").alias("doc_id"), "own_id", "text"), names.select("number", "n_id")


def _paths_of(texts: DataFrame, k: int) -> DataFrame:
    """doc_id, start, edges, src_doc, src_start: windows start..start+edges-1 of doc_id also start earlier."""
    texts = texts.select("doc_id", "text")
    asked = texts.mapInArrow(_announce(k), "key long, doc_id long, place int, known array<int>")
    places = asked.repartition("key").mapInArrow(_repeated, "doc_id long, places array<int>")
    places = common.stored(places.groupBy(F.col("doc_id").alias("_sd_doc")).agg(F.collect_list("places").alias("places")), "minimisers")
    held = texts.join(places, F.col("doc_id") == F.col("_sd_doc")).select("doc_id", "text", "places")
    rows = held.mapInArrow(_stretches(k), f"key long, {PATHS}, hashes array<long>")
    return rows.repartition("key").mapInArrow(_settle, PATHS)


def _compacted(paths: DataFrame, k: int) -> DataFrame:
    """Maximal spans doc_id, start, n_words, src_doc, src_start: a path joins the one before it in its
    document if it begins where that ends or before, and their sources lie as far apart as they do."""
    own = Window.partitionBy("doc_id", "src_doc", F.col("start") - F.col("src_start")).orderBy("start")
    end = F.max(F.col("start") + F.col("edges")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    runs = paths.withColumn("new", F.when(F.col("start") <= end, 0).otherwise(1))
    runs = runs.withColumn("span", F.sum("new").over(own))
    out = runs.groupBy("doc_id", "src_doc", (F.col("start") - F.col("src_start")).alias("shift"), "span").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("edges")).alias("end"))
    return out.select("doc_id", "start", (F.col("end") - F.col("start") + k - 1).alias("n_words"), "src_doc", (F.col("start") - F.col("shift")).alias("src_start"))


def repeated_spans(docs: DataFrame, k: int = 20) -> DataFrame:
    """Maximal spans: doc_id, start, n_words, src_doc, src_start, compacted from the paths."""
    texts, names = identified(docs)
    spans = _compacted(_paths_of(texts, k), k)
    if names is None:
        return spans
    named = spans.join(names, F.col("doc_id") == F.col("number")).withColumn("own_id", F.col("n_id")).drop("number", "n_id").join(names, F.col("src_doc") == F.col("number"))
    return named.select(F.col("own_id").alias("doc_id"), "start", "n_words", F.col("n_id").alias("src_doc"), "src_start")


def remove_repeats(docs: DataFrame, k: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by a blank) for every row of docs."""
    texts, _ = identified(docs)
    spans = _compacted(_paths_of(texts, k), k).groupBy(F.col("doc_id").alias("_sd_doc")).agg(F.collect_list(F.struct("start", "n_words")).alias("cut"))
    spans = common.stored(spans, "spans")
    held = texts.join(spans, F.col("doc_id") == F.col("_sd_doc"), "left").select(F.col("own_id").alias("doc_id"), "text", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch):
                n, gone, kept, sha = [], [], [], []
                for (_, words), cut in zip(_docs(slab), slab.column("cut").to_pylist()):
                    n.append(len(words))
                    if cut:
                        lost = np.zeros(len(words) + 1, np.int64)
                        np.add.at(lost, [c["start"] for c in cut], 1)
                        np.add.at(lost, [c["start"] + c["n_words"] for c in cut], -1)
                        stay = np.cumsum(lost)[:-1] == 0
                        words = [words[i] for i in np.flatnonzero(stay)]
                    gone.append(n[-1] - len(words))
                    text = b" ".join(words)
                    sha.append(hashlib.sha256(text).hexdigest())
                    kept.append(text)
                yield pa.RecordBatch.from_arrays([slab.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return held.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1)::BIGINT)) AS i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM h),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(0, 20) t(j) WHERE n > 1),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT p.doc_id, count(*) FILTER (g.p IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY p.p) FILTER (g.p IS NULL) AS kept
  FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
