"""Toxicity by the nearest labelled examples under exact cosine of class-weighted TF-IDF.

Terms are words and their openings of four and five letters, lower-cased; every term of the
labelled sample is kept.  A term's IDF is scaled by how surely the toxic class prefers it:
`floor` for terms that tell nothing, up to 1 + `floor` with a growing log-likelihood ratio g
(g / (g + `half_g`)).  The scale never drops a term, so a copy of an example has cosine 1 with it.
The examples stand in an inverted index; terms that a tenth of the examples hold are summed as one
dense product for a batch of texts, the rest by their posting lists.  Every example is compared
(no block is skipped), so the neighbours are exact and are returned as evidence.  Their distance-weighted votes, shrunk to the base rate, are mapped
to a probability by bins fitted on leave-one-out votes of the examples.

The sample holds at most `max_examples` labelled rows (least hashes of doc_id; toxic rows may fill
half of it), less near copies (Jaccard of `alike` over word windows, same label); index and terms
are bounded by that and go to the executors whole.

Defined results: a text that is null, empty or without known terms has no neighbours and gets the
rate of such examples, shrunk to the least score that the bins give; labels that are null or absent teach nothing; several labels of one
document count as the highest; without both classes every score is the base rate (0.0 with no
label); ties among neighbours go to the earlier example; repeated rows score alike; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LETTERS = re.compile(r"[^\W\d_]+")
TOGETHER = 64  # texts of one dense product
#: Words and texts that a scorer remembers at once, before it forgets them all; an idle worker keeps what they took.
MOST_WORDS, MOST_TEXTS = 100_000, 10_000


def terms_of(word: str) -> tuple[str, ...]:
    return (word, "4" + word[:4], "5" + word[:5]) if len(word) > 5 else (word, "4" + word[:4]) if len(word) > 4 else (word,)


@dataclass
class Model:
    terms: dict[str, int]
    idf: np.ndarray  # scaled by class
    labels: np.ndarray
    starts: np.ndarray  # of each term's postings, and their end
    who: np.ndarray
    weight: np.ndarray
    base: float
    base_empty: float
    cuts: np.ndarray
    values: np.ndarray
    k: int
    ids: np.ndarray  # doc_id of each example

    def __getstate__(self) -> dict:
        return {x: v for x, v in self.__dict__.items() if x not in ("place", "dense")}

    @property
    def postings(self) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Per term: examples, weights, how many."""
        return [(self.who[a:b], self.weight[a:b], int(b - a)) for a, b in zip(self.starts, self.starts[1:])]

    @cached_property
    def place(self) -> np.ndarray:
        """Per term its row of the dense part, or -1."""
        common_terms = np.flatnonzero(10 * np.diff(self.starts) >= max(10, len(self.labels)))
        out = np.full(len(self.idf), -1, np.int64)
        out[common_terms] = np.arange(len(common_terms))
        return out

    @cached_property
    def dense(self) -> np.ndarray:
        out = np.zeros((int(self.place.max(initial=-1)) + 1, len(self.labels)))
        for t in np.flatnonzero(self.place >= 0):
            a, b = self.starts[t], self.starts[t + 1]
            out[self.place[t], self.who[a:b]] = self.weight[a:b]
        return out

    def weighted(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[ids]
        return w / np.sqrt((w**2).sum()) if len(w) else w

    def vector(self, counts: Counter) -> tuple[tuple[int, ...], np.ndarray]:
        ids = tuple(sorted(counts))
        return ids, self.weighted(np.array(ids, np.int64), np.array([counts[i] for i in ids], float))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) the examples and cosines of the k nearest, exactly."""
        n, out = len(self.labels), []
        for at in range(0, len(queries), TOGETHER):
            part = queries[at : at + TOGETHER]
            q = np.zeros((len(part), len(self.dense)))
            for row, (ids, w) in zip(q, part):
                p = self.place[ids]
                row[p[p >= 0]] = w[p >= 0]
            for j, (acc, (ids, w)) in enumerate(zip(q @ self.dense, part)):
                rare = self.place[ids] < 0
                ids, w = ids[rare], w[rare]
                lo, size = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
                ends = np.cumsum(size)
                if len(ids) and ends[-1]:
                    flat = np.arange(ends[-1]) + np.repeat(lo - ends + size, size)
                    acc = acc + np.bincount(self.who[flat], self.weight[flat] * np.repeat(w, size), n)
                acc = np.round(acc, 12)  # whatever the order of the sums
                if skip is not None:
                    acc[skip[at + j]] = 0
                least = max(np.partition(acc, n - self.k)[n - self.k], 1e-12) if n > self.k else 1e-12
                i = np.flatnonzero(acc >= least)
                i = i[np.argsort(-acc[i], kind="stable")[: self.k]]
                out.append((i, acc[i]))
        return out

    def neighbours(self, ids: tuple[int, ...], w: np.ndarray, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest, exactly."""
        return self.nearest([(np.array(ids, np.int64), w)], None if skip is None else [skip])[0]

    def vote(self, who: np.ndarray, cosine: np.ndarray) -> float:
        weight = 1 / (1.05 - np.minimum(cosine, 1.0))
        return float(((weight * self.labels[who]).sum() + self.base) / (weight.sum() + 1))

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, self.cuts, self.values))


def _counts(text: str, terms: dict[str, int]) -> Counter:
    return Counter(terms[t] for w in LETTERS.findall(text.lower()) for t in terms_of(w) if t in terms)


def without_copies(rows: list[tuple], seeds: int = 4, width: int = 5, alike: float = 0.8) -> list[tuple]:
    """The first of each group of near copies: same label, Jaccard of `alike` over word windows.

    Rows that share a least hash of windows are compared.  Copies would lend their chance words the
    support of many examples."""
    seen: dict[tuple[int, int, int], list[int]] = {}
    out, sets = [], []
    for row in rows:
        text, label = row[:2]
        words = common.word_hashes((text or "").encode().lower().split())
        w = np.unique(common.window_hashes(words, min(width, len(words)) or 1))
        keys = [(s, label, int(common.mix(w ^ np.uint64(s * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min())) for s in range(1, seeds + 1)] if len(w) else [(0, label, 0)]

        def copies(other: np.ndarray) -> bool:
            if min(len(w), len(other)) < alike * max(len(w), len(other)):
                return False
            both = len(np.intersect1d(w, other, assume_unique=True))
            return both >= alike * (len(w) + len(other) - both)

        if not any(copies(sets[i]) for i in sorted({i for k in keys for i in seen.get(k, ())})):
            for k in keys:
                seen.setdefault(k, []).append(len(out))
            out.append(row)
            sets.append(w)
    return out


def learn(rows: list[tuple], k: int = 15, floor: float = 0.02, half_g: float = 30.0, bins: int = 20) -> Model:
    """rows: (text, 0 or 1), in a fixed order; a doc_id may follow, else the place among the rows stands for it."""
    rows = [(*r[:2], r[2] if len(r) > 2 else i) for i, r in enumerate(rows)]
    rows = without_copies(rows)
    y = np.array([r[1] for r in rows], float)
    first: dict[str, int] = {}
    ids, counts, ends = array("i"), array("i"), [0]  # of all rows, one after another: many small arrays would leave the driver's memory in pieces
    for text, *_ in rows:
        own = [first.setdefault(t, len(first)) for w in LETTERS.findall((text or "").lower()) for t in terms_of(w)]
        for all_rows, part in zip((ids, counts), np.unique(np.array(own, np.int32), return_counts=True)):
            all_rows.frombytes(part.astype(np.int32).tobytes())
        ends.append(len(ids))
    names = sorted(first)
    terms = {t: i for i, t in enumerate(names)}
    again = np.empty(len(first), np.int32)
    again[np.fromiter(map(first.get, names), np.int64, len(names))] = np.arange(len(names))
    del first
    ids, counts = again[np.frombuffer(ids, np.int32)], np.frombuffer(counts, np.int32).copy()
    own = [slice(a, b) for a, b in zip(ends, ends[1:])]
    for at in own:
        o = np.argsort(ids[at])
        ids[at], counts[at] = ids[at][o], counts[at][o]
    df, toxic = np.zeros(len(names)), np.zeros(len(names))
    for at, label in zip(own, y):
        df[ids[at]] += 1
        toxic[ids[at]] += label
    lean = np.zeros(len(names))
    if y.any() and not y.all():
        part, clean = y.mean(), df - toxic
        more = toxic > part * df
        g = 2 * (toxic * np.log(np.maximum(toxic, 1) / (df * part)) + clean * np.log(np.maximum(clean, 1) / (df * (1 - part))))
        lean[more] = g[more] / (g[more] + half_g)
        # an opening that one word explains says nothing more than that word
        for i in np.flatnonzero(lean):
            w = names[i]
            for d in "45" if not w[0].isdigit() else "":
                if len(w) > int(d) and toxic[i] >= 0.8 * toxic[terms[d + w[: int(d)]]]:
                    lean[terms[d + w[: int(d)]]] = 0
    m = Model(terms, np.log1p(len(rows) / df) * (floor + lean), y, np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0), float(y.mean()) if len(y) else 0.0, 0.0, np.array([0.0, 1.0]), np.array([0.0, 1.0]), k, np.array([r[2] for r in rows], np.int64))
    weight = np.empty(len(ids))
    for at in own:
        weight[at] = m.weighted(ids[at], counts[at])
    sizes = np.diff(ends)
    empty = sizes == 0
    if len(rows):
        order = np.argsort(ids, kind="stable")
        m.who = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[order]
        m.weight = weight[order]
        m.starts = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(names)))])
        del order
    known = np.flatnonzero(~empty)
    found = m.nearest([(ids[own[d]], weight[own[d]]) for d in known], [int(d) for d in known])
    m.__dict__.pop("dense", None)  # the executors make their own
    votes = [(m.vote(*x), y[d]) for d, x in zip(known, found)]
    if len({b for _, b in votes}) == 2:  # bins of equal counts, then made monotone by pooling
        votes.sort()
        pools: list[list[float]] = []
        for part in np.array_split(np.array(votes), min(bins, len(votes))):
            pools.append([part[:, 0].mean(), part[:, 1].sum() + m.base, len(part) + 1])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                x, z = pools.pop(), pools.pop()
                pools.append([(x[0] * x[2] + z[0] * z[2]) / (x[2] + z[2]), x[1] + z[1], x[2] + z[2]])
        m.cuts = np.array([0.0, *(p[0] for p in pools), 1.0])
        v = [p[1] / p[2] for p in pools]
        m.values = np.array([v[0], *v, v[-1]])
    prior = m.values[0] if y.any() and not y.all() else m.base
    m.base_empty = float((y[empty].sum() + prior) / (empty.sum() + 1))
    return m


def sample(docs: DataFrame, labels: DataFrame, max_examples: int) -> list[tuple[str, int, int]]:
    """Labelled texts: toxic ones up to half of the bound, the rest clean, by least hash."""
    taught = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_tx_doc")).agg(F.max("toxic").cast("int").alias("toxic"))
    place = F.xxhash64(F.lit(3), "_tx_doc")
    picked = None
    for label, most in ((1, max_examples // 2), (0, max_examples // 2)):
        own = taught.where(F.col("toxic") == label).orderBy(place, "_tx_doc").limit(most)
        picked = own if picked is None else picked.unionByName(own)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_tx_doc"))
    got = {(r._tx_doc, r.toxic): r.text or "" for r in rows.select("_tx_doc", "toxic", "text").toLocalIterator()}
    return [(text, int(label), doc) for (doc, label), text in sorted(got.items(), key=lambda x: x[0])]


class Scorer:
    """score, neighbours and cosines of texts; equal texts are scored once, up to a bound."""

    def __init__(self, model: Model):
        self.m, self.done, self.kinds = model, {}, {}

    def _read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        own: list[int] = []
        kinds, terms = self.kinds, self.m.terms
        for w in LETTERS.findall(text.lower()):
            hit = kinds.get(w)
            if hit is None:
                if len(kinds) >= MOST_WORDS:
                    kinds.clear()
                hit = kinds[w] = tuple(terms[t] for t in terms_of(w) if t in terms)
            own += hit
        ids, counts = np.unique(np.array(own, np.int64), return_counts=True)
        return ids, self.m.weighted(ids, counts)

    def __call__(self, column: pa.Array) -> list[tuple[float, np.ndarray, np.ndarray]]:
        out, m, done = [], self.m, self.done
        for at in range(0, len(column), TOGETHER):
            texts = [x or "" for x in column.slice(at, TOGETHER).to_pylist()]
            keys = [xxhash.xxh3_128_digest(x.encode()) for x in texts]
            if len(done) > MOST_TEXTS:
                done.clear()
            new = {key: self._read(x) for key, x in dict(zip(keys, texts)).items() if key not in done}
            done |= {key: (m.base_empty, np.empty(0, np.int64), np.empty(0)) for key, (ids, _) in new.items() if not len(ids)}
            new = {key: x for key, x in new.items() if len(x[0])}
            for key, (who, cosine) in zip(new, m.nearest(list(new.values()))):
                done[key] = (m.calibrated(m.vote(who, cosine)), who, np.minimum(cosine, 1.0))
            out += [done[key] for key in keys]
        return out


EVIDENCE = "array<struct<doc_id:long,cosine:double,toxic:int>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the evidence: the nearest examples with cosines and labels, their number, the best cosine."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        scorer = Scorer(m)
        for batch in batches:
            out = scorer(batch.column(1))
            size = np.array([len(who) for _, who, _ in out], np.int32)
            who, cosine = (np.concatenate([x[i] for x in out]) if out else np.empty(0) for i in (1, 2))
            who = who.astype(np.int64)
            near = pa.StructArray.from_arrays([pa.array(m.ids[who]), pa.array(cosine.astype(float)), pa.array(m.labels[who].astype(np.int32))], names=["doc_id", "cosine", "toxic"])
            evidence = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), near)
            best = pa.array([float(c[0]) if len(c) else 0.0 for *_, c in out], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array(size), best, evidence], names=["doc_id", "score", "n_neighbours", "best_cosine", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, score double, n_neighbours int, best_cosine double, evidence {EVIDENCE}")


def learned(docs: DataFrame, labels: DataFrame, max_examples: int = 6000) -> Model:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return learn(sample(docs, labels.where(fold != 0), max_examples))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose own text scores below 0.5, columns untouched, whatever their doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))
    common.trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([x[0] < 0.5 for x in scorer(batch.column("text"))], pa.bool_()))
        del scorer
        common.trim()

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(docs, common.table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
