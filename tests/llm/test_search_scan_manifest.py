"""Hard negatives, license scans and the Merkle manifest against brute force and on edge cases."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from codeloom.llm import hard_negatives, license_scan, merkle

LONG = 2**63 - 1


# ------------------------------------------------------------- hard negatives


def mined(rows, scale=256, k=5):
    """(id, label, vector) rows to the expected result, by comparing all with all."""
    good = []
    for i, (vid, label, v) in enumerate(rows):
        if vid is not None and label is not None and v is not None and all(x is not None and math.isfinite(x * float(scale)) for x in v):
            good.append((i, vid, label, [math.floor(x * scale) for x in v]))
    out = []
    for i, vid, label, v in good:
        if vid % 100:
            continue
        score = lambda w: max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(v, w))))
        near = sorted(((score(w), o) for _, o, lab, w in good if lab == label and o != vid), key=lambda r: (-r[0], r[1]))[:k]
        for p, pid in near:
            inside = sorted(((s, o) for s, o in ((score(w), o) for _, o, lab, w in good if lab != label) if 80 * p <= 100 * s <= 100 * p), key=lambda r: (-r[0], r[1]))[:k]
            out += [(vid, pid, rank, o, p, s) for rank, (s, o) in enumerate(inside, 1)]
    return sorted(out)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, vector array<double>")


@pytest.mark.parametrize("bucket_rows,block_bytes", [(2048, 8 << 20), (7, 200)])
def test_hard_negatives_are_exact(spark, bucket_rows, block_bytes):
    rng = random.Random(bucket_rows)
    rows = []
    for i in range(400):
        size = rng.choice((0.1, 0.5, 1, 4))  # norms far apart, so that buckets are pruned
        centre = i % 3
        v = [size * ((d == centre) + rng.gauss(0, 0.4)) for d in range(6)]
        rows.append((i, (centre if rng.random() < 0.7 else rng.randrange(3)), v))
    rows += [(1000 + i, i % 3, rows[100][2]) for i in range(30)]  # copies: ties by id
    rows += [(1100, 1, [0.0] * 6), (1200, 2, []), (1300, 0, [1.0, 2.0])]
    rows += [(1400, None, [1.0] * 6), (1401, 1, None), (1402, 1, [None] + [1.0] * 5), (1403, 1, [float("nan")] + [1.0] * 5), (1404, 1, [float("inf")] * 6), (None, 1, [1.0] * 6)]
    rows += [rows[200], (300, 2, [0.3] * 6)]  # a repeated row, and an id with another label
    got = hard_negatives.mine(vectors_of(spark, rows), F.col("id") % 100 == 0, bucket_rows=bucket_rows, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_hard_negatives_of_huge_components_and_of_none(spark):
    rows = [(0, 0, [1e9, 1.0]), (1, 0, [1e9 + 0.01, 3.0]), (2, 1, [1e9 - 5, 2.0]), (3, 1, [1e300, 1e300]), (100, 1, [1e300, 0.0]), (5, 1, [-1.0, 0.0])]
    got = hard_negatives.mine(vectors_of(spark, rows), F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows)
    assert hard_negatives.mine(vectors_of(spark, []), F.col("id") % 100 == 0).count() == 0
    alone = [(0, 0, [1.0]), (1, 1, [1.0])]
    assert hard_negatives.mine(vectors_of(spark, alone), F.col("id") % 100 == 0).count() == 0


def test_hard_negative_query_has_a_relabelled_anchor_and_ignores_other_columns(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(8)], rng.randrange(10), "x") for i in range(300)] + [(700, [0.1] * 8, 9, "x")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string").write.parquet(f"{tmp_path}/embeddings.parquet")
    held = [(r.vec_id, r.label, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    want = mined([(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in held])
    assert sorted(map(tuple, hard_negatives.op11_hard_negatives(spark, str(tmp_path)).collect())) == want
    assert want


# ------------------------------------------------------------- license scans


def scanned(text, templates, tenths=9, window=256):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    cut = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", x)
    words = cut(lower)
    places = [(i, label) for i in range(len(words)) for p, label in license_scan.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    base = {label for _, label in places}
    best, found = 0.0, set(base)
    for para in re.split("\n[ \t\n\x0b\f\r]*\n", lower):
        w = cut(para)
        for i in range(0, max(1, len(w) - window // 2), window // 2):
            block = set(w[i : i + window])
            for label, t in templates:
                tokens = set(cut("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)))
                if tokens and 10 * len(tokens & block) >= tenths * len(tokens):
                    found.add(label)
                    best = max(best, len(tokens & block) / len(tokens))
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(found)), 1.0 if places else best)


def test_license_scan_is_exact(spark):
    rng = random.Random(3)
    pool = sorted({w for _, t in license_scan.TEMPLATES for w in re.findall("[a-z0-9]+", t.lower())}) + [f"w{i}" for i in range(60)]
    texts = [None, "", " \n\n \n", "mit license", "MIT-License mit license MIT\n\nLicense", "cc by cc by", "gnu general public license gnu general public", "über Ä mit_license"]
    for _, t in license_scan.TEMPLATES:
        w = t.split()
        texts += [t, t.upper(), "# " + t.replace(" ", "\n# "), " ".join(x for i, x in enumerate(w) if i % 12 != 5), " ".join(x for i, x in enumerate(w) if i % 6 != 5)]
        texts.append(" ".join(rng.choice(pool) for _ in range(rng.randrange(400))) + " " + t + " " + " ".join(rng.choice(pool) for _ in range(rng.randrange(700))))
        texts.append(" ".join(w[: len(w) // 2]) + "\n \n" + " ".join(w[len(w) // 2 :]))
    texts += [" ".join(rng.choice(pool) for _ in range(n)) for n in (128, 129, 255, 256, 257, 385, 20_000)]
    texts += [license_scan.TEMPLATES[5][1]] * 3
    docs = spark.createDataFrame([(i if i % 9 else None, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, label string, row int, paras string")
    got = sorted(map(tuple, license_scan.scan(docs).collect()), key=repr)
    assert got == sorted(((i if i % 9 else None, *scanned(t, license_scan.TEMPLATES)) for i, t in enumerate(texts)), key=repr)
    assert sum(r[-1] > 0 for r in got) > 40


def test_license_scan_with_other_templates_thresholds_and_no_rows(spark):
    texts = ["a b c d e f", "f e d", "a b c x y", "c", "a b c d e f g h i j"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    templates = [("one", "a b c d"), ("two", "d e f"), ("none", "--"), ("three", "a b c d"), ("four", "c")]
    for tenths in (5, 7, 10):
        got = sorted(map(tuple, license_scan.scan(docs, templates, tenths, window=4).collect()))
        assert got == [(i, *scanned(t, templates, tenths, 4)) for i, t in enumerate(texts)]
    assert license_scan.scan(docs.limit(0)).count() == 0
    assert [r.labels for r in license_scan.scan(docs, []).collect()] == [""] * 5


def test_license_scan_runs_in_the_jvm(spark):
    plan = license_scan.scan(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------------------- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(digests):
    """The root, and the siblings of every leaf level by level as (left, right)."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, pos in enumerate(at):
            run = digests[pos // 8 * 8 : pos // 8 * 8 + 8]
            paths[i].append(("".join(run[: pos % 8]), "".join(run[pos % 8 + 1 :])))
        at = [pos // 8 for pos in at]
        digests = [h(*digests[i : i + 8]) for i in range(0, len(digests), 8)]
    return digests[0], paths


def manifest_of(rows):
    """rows: doc_id, text, lang, source, n_chars; the expected rows of the query."""
    by_lang = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = leaf_of(doc_id, source, lang, n_chars, text)
        claimed = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
            claimed = leaf_of(doc_id, source, lang, n_chars, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        by_lang.setdefault(lang, []).append((doc_id, leaf, claimed))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by_lang[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    below = {x: tree([r[1] for r in by_lang[x]]) for x in langs}
    root, above = tree([below[x][0] for x in langs]) if langs else (None, [])
    out = []
    for i, x in enumerate(langs):
        for (doc_id, leaf, claimed), path in zip(by_lang[x], below[x][1]):
            steps, acc = path + above[i], claimed
            for left, right in steps:
                acc = h(left, acc, right)
            out.append((doc_id, leaf, below[x][0], root, h(*(left + right for left, right in steps)), acc, acc == root))
    return sorted(out, key=repr)


def run_manifest(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, root string, tree int, part int"
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {None: 1, "": 2}, {"en": 8, "de": 9, None: 1, "": 3}, {"en": 600, "é": 64, "z": 65, "de": 513, **{f"l{i}": 1 + i % 3 for i in range(20)}}])
def test_manifest(spark, tmp_path, sizes):
    rng, rows = random.Random(len(sizes)), []
    for lang, n in sizes.items():
        for _ in range(n):
            doc_id = len(rows)
            rows.append((doc_id if rng.random() > 0.02 else None, rng.choice((None, "", "Text A", "lower", "Ünïcode É A", "A" * 9000)), lang, rng.choice((None, "", "s")), rng.choice((None, doc_id))))
    if len(rows) > 20:
        rows += rows[3:6] + [(rows[0][0], "other text", *rows[0][2:])]  # repeated rows, and an id with two texts
        rng.shuffle(rows)
    got = run_manifest(spark, tmp_path, rows)
    assert got == manifest_of(rows)
    if len(rows) > 20:
        assert {r[-1] for r in got} == {True, False}


def test_forest_joins_in_any_order():
    sizes = [100, 9, 1, 8]
    leaves = [(t, 0, i, h(str(t), str(i))) for t, n in enumerate(sizes) for i in range(n)]
    want = {t: tree([x[3] for x in leaves if x[0] == t])[0] for t in range(4)}
    for seed in range(5):
        rng = random.Random(seed)
        rng.shuffle(leaves)
        parts = []
        for i in range(0, len(leaves), 17):
            f = merkle.Forest(sizes)
            for x in leaves[i : i + 17]:
                f.add(*x)
            parts.append(f)
        while len(parts) > 1:
            parts.append(parts.pop(rng.randrange(len(parts))).join(parts.pop(rng.randrange(len(parts)))))
        assert not parts[0].open
        assert {t: v for t, level, _, v in parts[0].made if level == merkle.height(sizes[t])} == want
