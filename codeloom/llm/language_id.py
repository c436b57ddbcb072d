"""Language ID of words by a linear-chain conditional random field, and of documents by its marginals.

A word is a run of letters, lower-cased.  Its emission score for a language is the sum of learned
weights of its features, all hashed into one table: character n-grams of 1 to 3 with word edges
(those at an edge are the affixes, with those of 4), and the word itself (the lexicon).  Learned
transitions join neighbouring words.  Forward-backward over chains of `CHAIN` consecutive words
gives each word's language probabilities: `label_spans` returns the runs of words of one language,
`predict` the mean over a document.

Learning: from at most `per_language` documents a language (least hashes of doc_id), spliced into
chains that change language now and then, so that transitions see switches; full-gradient AdaGrad
on the conditional log-likelihood, on the driver, on that bounded sample only.

Defined results: a null text, or one without letters, is `und` with score 0; with no labelled row
all is `und`; with one language that language has score 1; ties go to the language first by code
point; repeated rows are predicted alike; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LETTERS = re.compile(r"[^\W\d_]+")
CHAIN = 128
SLOTS = 1 << 18


def featurise(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of all words, and where each word's begin."""
    joined = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(words)), size)
    inside = np.arange(len(joined)) - start[owner]
    slots, owners = [], []
    h = np.full(len(joined), np.uint64(1469598103934665603))
    whole = np.zeros(len(words), np.uint64)
    place = common.mix(joined * np.uint64(0x9E3779B97F4A7C15) + inside.astype(np.uint64))
    if len(words):
        whole = np.add.reduceat(place, start[:-1])
    for n in range(1, 5):
        h = h[: len(joined) - n + 1] * np.uint64(1099511628211) ^ joined[n - 1 :]
        fits = inside[: len(h)] + n <= size[owner[: len(h)]]
        if n == 4:  # affixes only
            fits &= (inside[: len(h)] == 0) | (inside[: len(h)] + n == size[owner[: len(h)]])
        keep = np.flatnonzero(fits)
        slots.append(common.mix(h[keep] + np.uint64(n)))
        owners.append(owner[keep])
    slots.append(common.mix(whole + np.uint64(77)))
    owners.append(np.arange(len(words)))
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return (slots[order] % np.uint64(SLOTS)).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])[:-1]


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    if not words:
        return np.zeros((0, weights.shape[1]))
    slots, start = featurise(words)
    return np.add.reduceat(weights[slots], start, axis=0)


def forward_backward(e: np.ndarray, mask: np.ndarray, t: np.ndarray, pairs: bool = False):
    """Marginals of chains e (chains, steps, labels), of exp scores; mask marks real words.

    With pairs, the expected number of each transition too.
    """
    n, steps, k = e.shape
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = e[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for s in range(1, steps):
        a = (alpha[:, s - 1] @ t) * e[:, s]
        a /= a.sum(1, keepdims=True)
        alpha[:, s] = np.where(mask[:, s, None], a, alpha[:, s - 1])
    for s in range(steps - 2, -1, -1):
        b = (e[:, s + 1] * beta[:, s + 1]) @ t.T
        b /= b.sum(1, keepdims=True)
        beta[:, s] = np.where(mask[:, s + 1, None], b, beta[:, s + 1])
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    if not pairs:
        return p
    expected = np.zeros((k, k))
    for s in range(1, steps):
        x = alpha[:, s - 1, :, None] * t[None] * (e[:, s] * beta[:, s])[:, None, :]
        x /= x.sum((1, 2), keepdims=True)
        expected += x[mask[:, s]].sum(0)
    return p, expected


def chains(ids: np.ndarray, starts: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emission tensors of runs of words cut into chains: rows of `scores` by id, and the mask.

    starts: where each document's words begin in ids (and the end)."""
    at = [np.arange(a, b, CHAIN) for a, b in zip(starts[:-1], starts[1:])]
    ends = [np.minimum(x + CHAIN, b) for x, b in zip(at, starts[1:])]
    at, ends = np.concatenate(at), np.concatenate(ends)
    place = at[:, None] + np.arange(CHAIN)[None]
    mask = place < ends[:, None]
    return np.where(mask[..., None], scores[ids[np.minimum(place, len(ids) - 1)]], 0.0), mask


def learn(texts: list[tuple[str, str]], rounds: int = 12, rate: float = 0.25, ridge: float = 1e-6, piece: int = 24) -> tuple[list[str], np.ndarray, np.ndarray]:
    """texts: (text, language).  Languages, feature weights and log transitions."""
    langs = sorted({x for _, x in texts})
    k = len(langs)
    words, known, pieces = [], {}, []
    for text, lang in texts:
        ids = [known.setdefault(w, len(known)) for w in LETTERS.findall(text.lower())]
        pieces += [(langs.index(lang), ids[i : i + piece]) for i in range(0, len(ids), piece)]
    words = list(known)
    weights, trans = np.zeros((SLOTS, k)), np.zeros((k, k))
    if k < 2 or not words:
        return langs, weights, trans
    # two pieces of a document stay together, then the next document's may be of another language
    order = np.random.default_rng(11).permutation(-(-len(pieces) // 2))
    pieces = [p for i in order for p in pieces[2 * i : 2 * i + 2]]
    ids = np.concatenate([p for _, p in pieces]).astype(np.int64)
    gold = np.concatenate([np.full(len(p), y) for y, p in pieces])
    slots, start = featurise(words)
    owner = np.repeat(np.arange(len(words)), np.diff(np.concatenate([start, [len(slots)]])))
    bounds = np.array([0, len(ids)])
    onehot = np.eye(k)
    held, mask = chains(np.arange(len(ids)), bounds, onehot[gold])
    ys = held.argmax(2)
    step = mask[:, 1:]
    seen = np.zeros((k, k))
    np.add.at(seen, (ys[:, :-1][step], ys[:, 1:][step]), 1)
    at = np.minimum(np.arange(0, len(ids), CHAIN)[:, None] + np.arange(CHAIN)[None], len(ids) - 1)
    g2w, g2t = np.full((SLOTS, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(rounds):
        score = np.add.reduceat(weights[slots], start, axis=0)
        e, _m = chains(ids, bounds, score)
        p, expected = forward_backward(np.exp(e - e.max(2, keepdims=True)), mask, np.exp(trans), pairs=True)
        diff = (onehot[ys] - p) * mask[..., None]
        by_word = np.stack([np.bincount(ids[at].ravel(), diff[..., j].ravel(), len(words)) for j in range(k)], 1)
        grad = np.stack([np.bincount(slots, by_word[owner, j], SLOTS) for j in range(k)], 1) - ridge * len(ids) * weights
        g2w += grad**2
        weights += rate * grad / np.sqrt(g2w)
        gt = seen - expected
        g2t += gt**2
        trans += rate * gt / np.sqrt(g2t)
    return langs, weights.astype(np.float32), trans


def sample(docs: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """(text, lang) of the documents with the least hashes, at most `per_language` of each."""
    taught = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r.n for r in taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_003))
    near = F.lit(False)
    for lang, n in counts.items():
        near = near | ((F.col("lang") == lang) & (place <= int(1_000_003 * min(1.0, 1.3 * per_language / n))))
    rows: dict[str, list] = {}
    for r in taught.where(near).select("lang", place.alias("p"), "doc_id", "text").orderBy("p", "doc_id").toLocalIterator():
        if len(own := rows.setdefault(r.lang, [])) < per_language:
            own.append((r.text, r.lang))
    return [x for lang in sorted(rows) for x in rows[lang]]


def marginals(texts: list[list[str]], model: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Language probabilities of every word of some texts, one after the other, and where each text's begin (and the end)."""
    langs, weights, trans = model
    known: dict[str, int] = {}
    ids = [known.setdefault(w, len(known)) for words in texts for w in words]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    if not ids or not langs:
        return np.zeros((len(ids), max(1, len(langs)))), starts
    score = emissions(list(known), weights)
    score = np.exp(score - score.max(1, keepdims=True))
    e, mask = chains(np.array(ids), starts, score)
    e[~mask] = 1.0
    return forward_backward(e, mask, np.exp(trans))[mask], starts


SPAN = "struct<start:int,length:int,n_words:int,lang:string,score:double>"


def label_spans(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and spans: runs of words of one language, by code points, with their mean probability.

    A text without words, or a model without languages, has no spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = []
            for text in batch.column(1):
                found = list(LETTERS.finditer(text.as_py() or "")) if model[0] else []
                p, _ = marginals([[m.group().lower() for m in found]], model)
                spans = []
                for m, row in zip(found, p):
                    lang = model[0][int(row.argmax())]
                    if not spans or spans[-1]["lang"] != lang:
                        spans.append({"start": m.start(), "length": 0, "n_words": 0, "lang": lang, "score": 0.0})
                    own = spans[-1]
                    own["length"], own["n_words"], own["score"] = m.end() - own["start"], own["n_words"] + 1, own["score"] + float(row.max())
                out.append([x | {"score": min(1.0, x["score"] / x["n_words"])} for x in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], slab_words: int = 200_000) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: list[str | None], model) -> Iterator[tuple[str, float]]:
        langs = model[0]
        p, starts = marginals([LETTERS.findall(x.lower()) if x else [] for x in texts], model)
        flat = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
        total = flat[starts[1:]] - flat[starts[:-1]]
        for row, n in zip(total, np.diff(starts)):
            yield (langs[int(row.argmax())], float(min(1.0, row.max() / n))) if n and langs else ("und", 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                held, chars, end = [], 0, at
                while end < batch.num_rows and (end == at or chars < 6 * slab_words):
                    held.append(texts[end].as_py())
                    chars += len(held[-1] or "")
                    end += 1
                out = list(scored(held, model))
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["doc_id", "lang_pred", "score"])
                at = end

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str, per_language: int = 150) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = learn(sample(docs.where(fold != 1), per_language))
    return predict(docs, model).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")
