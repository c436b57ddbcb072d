"""The registered quality query against brute force, its held-out verdicts, and clashing columns."""

import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import common, quality_rules

SF = "/root/testdata/sf0.01"


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed by the words of the contract."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    cover = {k for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, r = len(w), len(cover)
    return n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), dup, r, n < 20 or 100 * r > 30 * n


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in quality_rules.op4_quality_rules(spark, SF).collect()}
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    assert got.keys() == texts.keys()
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    rules = quality_rules.fit(docs, labels)
    features = {r[0]: np.array([r[1:]], float) for r in quality_rules.with_statistics(docs).select("doc_id", *quality_rules.FEATURES).collect()}
    for i, t in texts.items():
        want = base(t)
        assert tuple(got[i])[1:7] == want
        assert got[i].kept == (not want[5] and not any(r.covers(features[i])[0] for r in rules))


def held_out(spark, sf):
    """(right, all) of base-passing labelled rows of each quality; rules come from the rows of other remainders."""
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    apart = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    rules = quality_rules.fit(docs, labels.where(~apart))
    rows = quality_rules.with_statistics(docs.select("doc_id", "text").join(labels.where(apart).select("doc_id", "quality"), "doc_id"))
    rows = rows.select("quality", quality_rules.base_failed().alias("failed"), quality_rules.decision_list(rules).alias("kept")).collect()
    out = {}
    for q in (0, 1):
        own = [r.kept == bool(q) for r in rows if r.quality == q and not r.failed]
        out[q] = (sum(own), len(own))
    return out


def test_held_out_verdicts(spark):
    got = held_out(spark, SF)
    assert got[1][0] >= 0.95 * got[1][1] > 0


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "one two", "mine", "other"), (None, None, None, "other")], "doc_id long, text string, N_Words string, more string")
    got = quality_rules.with_statistics(rows)
    assert sorted(c.lower() for c in got.columns).count("n_words") == 1
    assert sorted((r.n_words, r.more) for r in got.select(F.col("n_words"), "more").collect()) == [(0, "other"), (2, "other")]
