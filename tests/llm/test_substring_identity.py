"""Substring dedup where doc_ids are null, repeated, or both, against plain Python."""

import random

import pytest

from codeloom.llm import substring_dedup as sd


def removed(docs, k):
    """docs: distinct (order, words) in order; the kept words of each."""
    seen, kept = set(), []
    for words in docs:
        gone = set()
        for i in range(len(words) - k + 1):
            w = tuple(words[i : i + k])
            if w in seen:
                gone |= set(range(i, i + k))
            seen.add(w)
        kept.append([x for i, x in enumerate(words) if i not in gone])
    return kept


@pytest.mark.parametrize("ids", [[None, None], [7, 7], [None, 7], [1, 1, None, None, 2, 2]])
def test_texts_under_one_id_or_none(spark, ids):
    rng = random.Random(len(ids))
    common = [f"c{i}" for i in range(30)]
    texts = [[f"d{j}w{i}" for i in range(rng.choice((25, 230)))] for j in range(len(ids))]
    for t in texts[::2]:
        t[10:10] = common
    rows = [(i, " ".join(t), "x", 1) for i, t in zip(ids, texts)]
    rows += rows[:1]  # a row that is there twice is one document
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_id string, number int")
    got = sorted((tuple(r) for r in sd.remove_repeats(docs, 20).select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)
    # which of two texts under one id comes first is up to their hashes: any order by id is right
    by_text = {" ".join(t): i for i, t in zip(ids, texts)}
    order = sorted(by_text, key=lambda t: (by_text[t] is not None, by_text[t] or 0))
    assert sorted((r[0], r[1]) for r in got if r[0] is not None) == sorted((i, len(t)) for i, t in [*zip(ids, texts), (ids[0], texts[0])] if i is not None)
    with_common = [t for t in order if common[0] in t.split()]
    lost = [r for r in got if r[2]]
    assert all(r[2] == 30 for r in lost)
    copies = len(with_common) - 1
    assert len({r[3] for r in lost}) == copies
    first_id = by_text[with_common[0]]
    assert any(r[0] == first_id and r[2] == 0 and common[0] in r[3].split() for r in got)
    spans = sd.repeated_spans(docs, 20).select("n_words").distinct().collect()
    assert [r.n_words for r in spans] == ([30] if copies else [])


def test_a_text_without_repeats_under_a_repeated_id_loses_nothing(spark):
    a, b = " ".join(f"a{i % 30}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(7, a), (7, b), (None, b + " tail"), (None, None), (None, "")], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): r.n_removed for r in sd.remove_repeats(docs, 20).collect()}
    assert got[(None, 61)] == 0 and got[(None, 0)] == 0
    assert sorted(r.n_removed for r in sd.remove_repeats(docs, 20).collect() if r.doc_id == 7) == [30, 60]


def test_unique_ids_agree_with_plain_python(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(40)}" for _ in range(200)]
    texts = [base[i : i + rng.randrange(5, 90)] + [f"u{j}"] + base[: rng.randrange(60)] for j, i in enumerate(rng.randrange(150) for _ in range(25))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in sd.remove_repeats(docs, 8).collect()}
    assert got == {i: " ".join(t) for i, t in enumerate(removed(texts, 8))}
    assert sd.remove_repeats(docs.limit(0), 8).count() == 0
