"""Every stage of the corpus pipeline on a small corpus with planted cases, against plain Python."""

import os
import random
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline
from codeloom.llm import catalog, common, near_dup

WORDS = [f"w{i}" for i in range(500)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(77)
    item = "how many islands does the great northern archipelago have when the tide is low in autumn"
    texts = [prose(rng, 60) + (" vile rotten" if i % 2 else "") for i in range(80)]  # 0-79, odd ones toxic
    texts += [prose(rng, 70) for _ in range(20)]  # 80-99 clean
    texts += [f"share this page\n{prose(rng, 40)}\n SHARE this page " for _ in range(12)]  # 100-111 with a common line
    near = texts[85].split()
    near[30] = "other"
    texts += [texts[84], " ".join(near), prose(rng, 20) + " " + item + " " + prose(rng, 20), "", None]  # 112-116
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, prose(rng, 30), None, "s0", 1), (None, "vile rotten vile", None, "s0", 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    columns, texts = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, folder)
        if name != "mixing":
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = common.stored(out, f"test-{name}")
        after = docs.collect()
        ids = Counter(r.doc_id for r in after)
        if name == "toxicity":
            assert Counter(map(tuple, after)) == Counter(tuple(r) for r in before if "vile" not in (r.text or ""))
        if name == "line_dedup":
            key = lambda x: x.strip(common.BLANKS).lower()
            df = Counter(k for r in before for k in {key(x) for x in (r.text or "").split("\n")} - {""})
            want = Counter((r.doc_id, "\n".join(x for x in (r.text or "").split("\n") if not key(x) or df[key(x)] < 10)) for r in before)
            assert Counter((r.doc_id, r.text or "") for r in after) == want
            assert all(r.n_chars == len(r.text) for r in after if r.doc_id in range(100, 112)) and len(after) == len(before)
        if name == "ngram_jaccard":
            sets = {i: set(near_dup.shingle_set((r.text or "").encode(), 5).tolist()) for i, r in enumerate(before)}
            same = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            rank = sorted(sets, key=lambda i: (before[i].doc_id is None, before[i].doc_id))
            own = {i: i for i in sets}
            for a in rank:
                for b in rank:
                    if own[a] != own[b] and same(a, b):
                        low, high = sorted((own[a], own[b]), key=rank.index)
                        own = {i: low if x == high else x for i, x in own.items()}
            assert Counter(map(tuple, after)) == Counter(tuple(before[i]) for i in set(own.values()))
            assert 84 in ids and 85 in ids and 112 not in ids and 113 not in ids
        if name == "decontamination":
            assert Counter(map(tuple, after)) == Counter(tuple(r) for r in before if r.doc_id != 114)
        if name == "mixing":
            assert Counter((r.doc_id, r.size) for r in after) == Counter((r.doc_id, len((r.text or "").split())) for r in before)
            assert all(0 <= r.taken <= 2 * r.size for r in after)
    assert rows_of(corpus_pipeline.run(spark, folder)) == rows_of(docs)


def test_stages_of_an_empty_table(spark, folder):
    none = common.table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert rows_of(got) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
