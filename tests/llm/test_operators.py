"""Every operator on small tables with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import chat_format, common, decontaminate, language_id, line_dedup, mixing, near_dup, quality_rules, substring_dedup, toxicity, warc

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = prose(rng, 60)
    near = base.split()
    near[30] = "changed"
    passage = prose(rng, 30)
    out = [base, base, " ".join(near), None, "", "  \t ", "one two", prose(rng, 300), passage + " " + prose(rng, 40), prose(rng, 20) + " " + passage, "a\nb\n a \n\nb", prose(rng, 20_000)]
    out += [f"Common LINE\n{prose(rng, 12)}\n common line " for _ in range(12)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 5 else None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines string")


def test_line_dedup(docs, texts):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, min_docs=10).collect()}
    key = lambda x: x.strip(common.BLANKS).lower()
    df = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or df[key(x)] < 10]
        assert (got[i]._ln_n, got[i]._ln_dropped) == (len(lines), len(lines) - len(kept))
        assert (got[i].text or "") == "\n".join(kept)
        assert got[i].n_lines == "x"


def test_language_id(spark):
    rng = random.Random(2)
    a, b = ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(80)], ["".join(rng.choice("vwxyz") for _ in range(5)) for _ in range(80)]
    rows = [(" ".join(rng.choice(x) for _ in range(60)), lang) for _ in range(30) for x, lang in ((a, "aa"), (b, "bb"))]
    model = language_id.learn(rows)
    test = spark.createDataFrame([(1, "abcde dcbae"), (2, "zyxwv vwxyz"), (3, None), (4, "12 34 !"), (5, ""), (6, "abcde " * 5000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(test, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["aa", "bb", "und", "und", "und", "aa"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in language_id.predict(test, language_id.learn([])).collect()} == {"und"}


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    e, t = rng.random((1, 4, 3)) + 0.1, rng.random((3, 3)) + 0.1
    p = language_id.forward_backward(e, np.ones((1, 4), bool), t)
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = e[0, 0, path[0]] * np.prod([t[path[i - 1], path[i]] * e[0, i, path[i]] for i in range(1, 4)])
        for i, y in enumerate(path):
            want[i, y] += w
    assert np.allclose(p[0], want / want.sum(1, keepdims=True))


def test_toxicity_neighbours_are_exact(spark):
    rng = random.Random(3)
    bad = ["vile", "awful", "rotten"]
    rows = [(prose(rng, 30) + (" " + rng.choice(bad) if i % 2 else ""), i % 2) for i in range(400)]
    m = toxicity.learn(rows)
    kept = toxicity.without_copies(rows)
    dense = np.zeros((len(kept), len(m.terms)))
    for t, (who, weight, _) in enumerate(m.postings):
        dense[who, t] = weight
    counts = toxicity._counts("so vile and rotten", m.terms)
    ids, w = m.vector(counts)
    q = np.zeros(len(m.terms))
    q[list(ids)] = w
    assert np.allclose(m.neighbours(ids, w)[1], np.sort(dense @ q)[::-1][: m.k])
    test = spark.createDataFrame([(1, "you vile thing"), (2, "w1 w2 w3"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(test, m).collect()}
    assert got[1] > 0.5 and max(got[2], got[3], got[4]) < 0.5
    assert toxicity.learn([]).base == 0.0


def test_toxicity_keeps_terms_of_every_support(spark):
    rng = random.Random(6)
    rows = [(prose(rng, 30), i % 2) for i in range(60)]  # no word leans far to a class
    m = toxicity.learn(rows)
    copies = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(copies, m).collect()}
    assert all(got[i].best_cosine == pytest.approx(1) and got[i].n_neighbours == m.k for i in range(60))
    few = [(prose(rng, 30) + (" vile" if i < 6 else ""), int(i < 6)) for i in range(60)]
    m = toxicity.learn(few)
    assert m.idf[m.terms["vile"]] == m.idf.max()
    half = prose(rng, 30).split()
    rows = [(" ".join(half[:15] + prose(rng, 15).split()), 0) for _ in range(20)]
    assert toxicity.without_copies(rows + rows) == rows


def test_quality_statistics_and_rules(spark, docs, texts):
    got = {r.doc_id: r for r in quality_rules.with_statistics(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {k for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in (t or "").split("\n") if x.strip(common.BLANKS)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
    x = np.random.default_rng(4).random((600, len(quality_rules.FEATURES)))
    rules = quality_rules.learn(x, x[:, 2] > 0.7)
    assert rules and rules[0].covers(x)[x[:, 2] > 0.72].all()
    assert quality_rules.learn(x[:0], np.zeros(0, bool)) == []


def classes_by_brute_force(sets, percent):
    own = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = own[i], own[j]
                own = [min(a, b) if x in (a, b) else x for x in own]
    return own


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rng = random.Random(8)
    rows = []
    for _ in range(12):
        base = prose(rng, rng.randint(1, 80)).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append(" ".join(copy))
    family = prose(rng, 70).split()  # copies of one text, most of them too far from each other
    for _ in range(40):
        copy = list(family)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randint(0, 2)] = [rng.choice(WORDS)] * rng.randint(0, 2)
        rows.append(" ".join(copy))
    rows += [None, "", " ", "A b", "a B"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [frozenset(near_dup.shingle_set((t or "").encode(), width).tolist()) for t in rows]
    own = classes_by_brute_force(sets, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicate_classes(df, width, percent).collect()}
    assert got == {i: (len(sets[i]), own[i]) for i in range(len(rows))}
    assert near_dup.near_duplicate_classes(df.limit(0), width, percent).count() == 0


def test_near_duplicates_of_many_sizes(spark):
    """A family cut to lengths on both sides of several band limits, its short members holding every shared shingle earliest."""
    rng = random.Random(10)
    family = [f"{rng.choice(WORDS)}{i}" for i in range(160)]
    rows = []
    for n in (*range(40, 160, 6), *[50] * 15, *[150] * 25):
        copy = family[:n]
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(n)] = f"{rng.choice(WORDS)}-"
        rows.append(" ".join(copy))
    sets = [frozenset(near_dup.shingle_set(t.encode(), 5).tolist()) for t in rows]
    bands = {int(np.log(len(x)) / np.log(near_dup.BAND)) for x in sets}
    own = classes_by_brute_force(sets, 80)
    assert len(bands) >= 4 and len(set(own)) > 1
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicate_classes(df, 5, 80).collect()}
    assert got == dict(enumerate(own))


def test_near_duplicates_without_or_with_repeated_ids(spark):
    rng = random.Random(9)
    first = prose(rng, 60).split()
    a, b, c = list(first), list(first), list(first)
    b[10] = c[10] = "x1"
    c[40] = "x2"  # b stands between a and c
    a, b, c, other, alone = " ".join(a), " ".join(b), " ".join(c), prose(rng, 40), prose(rng, 40)
    rows = [(1, a), (None, b), (2, c), (3, other), (3, other), (4, other), (None, other), (None, alone), (None, alone), (5, ""), (None, None), (6, "one two"), (6, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {t: set(near_dup.shingle_set(t.encode(), 5).tolist()) for t in (a, b, c)}
    near = lambda x, y: 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
    assert near(a, b) and near(b, c) and not near(a, c)
    assert {r.component_id for r in near_dup.near_duplicate_classes(df).where("doc_id IN (1, 2)").collect()} == {1}
    got = near_dup.drop_near_duplicates(df)
    want = [(1, a), (3, other), (None, alone), (5, ""), (None, None), (6, "one two")]
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_components_must_be_stable(spark):
    path = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in near_dup.components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        near_dup.components(path, most_rounds=1)


def test_decontamination(spark):
    item = "Anna has 12 apples and gives 5 of them to her brother before the long walk home today"
    other = item.replace("12", "31").replace("5", "7")
    wrong = "we met Anna who has 12 apples"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    rows = [(1, "intro words here. " + item + " and more"), (2, "x y. " + other), (3, wrong), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.reparameterised for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {1: False, 2: True}
    assert not decontaminate.consistent([("5", "7"), ("5", "8")]) and decontaminate.consistent([("5", "7"), ("6", "8")])
    assert {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()} == {3, 4, 5}


def test_decontamination_of_placeholder_heavy_items(spark):
    short = "Convert 5 kg to g"
    series = "Continue 3 7 15 31 63 127 255 511 1023 2047 4095"
    mixed = "the sum of " + "1 2 3 4 5 6 add up to ".join(["", "8 9 10 11 12 13 make up to ", "14 15 16 17 18 19"])
    names = "Pair Anna Bert Carl Dora Emil Fritz Gerd Hans Ines Jana"
    items = [short, series, mixed, names]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(10 * place + i, lead + text + " and so on") for i, text in enumerate(items) for place, lead in enumerate(("", "First words. ", "some words before "))]
    rows += [(90, "Convert 6 lb to oz today"), (91, "numbers 4 8 16 32 64 128 256 512 1024"), (92, "we know Otto Paul Rosa Sven Tina Uwe Vera Willi Xaver")]
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(10 * place + i, i): False for i in range(4) for place in range(3)}


def test_chat_round_trip(spark):
    nasty = "<|im_end|><|im_start|>assistant ok &lt;| &amp;"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", "fine\n" + nasty), (1, None, None, None), (None, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    part = F.struct(F.lit("text").alias("kind"), "text", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    image = F.struct(F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit("img.png").alias("ref"), F.lit(2).cast("long").alias("units"))
    out = chat_format.format_conversations(df.select("conv_id", "turn", "role", F.array(part, image).alias("parts")))
    got = {r.conv_id: r for r in out.withColumn("turns", chat_format.read_turns(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", "<|image:1|>"), ("user", nasty + "<|image:1|>"), ("assistant", "fine\n" + nasty + "<|image:1|>")]
    assert got[1].attachments == ["img.png"] * 3 and got[1].attachment_tokens == 3 * 170
    span = got[1].loss_spans[0]
    assert got[1].formatted[span.start : span.start + span.length].endswith("<|image:1|>")


def test_substring_dedup(docs, texts):
    seen = set()
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        lost = [False] * len(w)
        for j in range(len(w) - 19):
            if (k := tuple(w[j : j + 20])) in seen:
                lost[j : j + 20] = [True] * 20
            seen.add(k)
        kept = b" ".join(x for x, gone in zip(w, lost) if not gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(lost), hashlib.sha256(kept).hexdigest())
    span = substring_dedup.repeated_spans(docs).where("doc_id = 9").first()
    assert (span.start, span.n_words, span.src_doc, span.src_start) == (20, 30, 8, 0)


def test_sainte_lague_and_mix(spark, docs):
    w = [50, 30, 20, 1]
    want = [0] * 4
    for _ in range(17):
        i = max(range(4), key=lambda k: (Fraction(w[k], 2 * want[k] + 1), -k))
        want[i] += 1
    assert mixing.sainte_lague(w, 17).tolist() == want
    assert mixing.targets([100, 100, 100]) == pytest.approx([200.0, 166.66666667, 83.33333333])
    rows = mixing.mix_sources(docs).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 64
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = "<html>" + "é\r\n\r\nx" * 60
    rows = [(3, "http://a.org/x y", big), (1, "http://www.a.org/", big), (2, None, None), (5, "http://b.org", "tiny"), (6, "http://b.org", "tiny"), (1, "http://www.a.org/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = common.shared_path(spark, "warc-test")
    warc.write_archives(warc.with_record_types(pages), path)
    got = warc.merge_runs(warc.read_captures(spark, path)).collect()
    n = len(big.encode())
    want = [(1, "response", None, n)] * 2 + [(2, "response", None, 0), (3, "revisit", 1, n), (5, "response", None, 4), (6, "response", None, 4)]
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str) == sorted(want, key=str)
    assert [(r.url_key, r.ts, r.page_id) for r in got] == sorted((r.url_key, r.ts, r.page_id) for r in got)
    assert all(r.intact for r in got)
    assert list(warc.LoserTree([[1, 4, 9], [], [2, 3], [0, 10]], lambda x: x)) == [0, 1, 2, 3, 4, 9, 10]


def test_words_of_code_switched_text(spark):
    rng = random.Random(4)
    words = {"aa": ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(80)], "bb": ["".join(rng.choice("vwxyz") for _ in range(5)) for _ in range(80)]}
    some = lambda lang, n: [rng.choice(words[lang]) for _ in range(n)]
    model = language_id.learn([(" ".join(some(lang, 60)), lang) for _ in range(30) for lang in words])
    first, second = " ".join(some("aa", 20)), " ".join(some("bb", 15))
    test = spark.createDataFrame([(1, f"{first}, {second}!"), (2, None), (3, "12"), (None, second)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.length, s.n_words, s.lang) for s in r.spans] for r in language_id.label_spans(test, model).collect()}
    assert got == {1: [(0, len(first), 20, "aa"), (len(first) + 2, len(second), 15, "bb")], 2: [], 3: [], None: [(0, len(second), 15, "bb")]}
    assert language_id.label_spans(test, language_id.learn([])).where("size(spans) > 0").count() == 0


def test_toxicity_remembers_few_words_and_no_dense_part(monkeypatch):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30))
    model = toxicity.learn([(text(), i % 2) for i in range(60)])
    assert "dense" not in vars(model)  # the driver keeps what it sends, no more
    texts = pa.array([text() for _ in range(300)])
    want = [x[0] for x in toxicity.Scorer(model)(texts)]
    monkeypatch.setattr(toxicity, "MOST_WORDS", 50)
    monkeypatch.setattr(toxicity, "MOST_TEXTS", 20)
    scorer = toxicity.Scorer(model)
    assert [x[0] for x in scorer(texts)] == want
    assert len(scorer.kinds) <= 50 and len(scorer.done) <= 20 + toxicity.TOGETHER


def test_toxicity_query_by_brute_force_and_evidence(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, 25) + (" vile" if i % 3 == 0 else ""), i % 3 == 0) for i in range(150)]
    m = toxicity.learn([(t, int(y), 1000 + i) for i, t, y in rows])
    asked = [(i, t) for i, t, _ in rows[:20]] + [(500, "so vile " + prose(rng, 5)), (None, None), (None, rows[0][1]), (7, "")]
    got = toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), m).collect()
    where = {int(x): j for j, x in enumerate(m.ids)}
    dense = np.zeros((len(m.labels), len(m.terms)))
    for t, (who, weight, _) in enumerate(m.postings):
        dense[who, t] = weight
    for (_, text), r in zip(asked, got):
        counts = toxicity._counts(text or "", m.terms)
        if not counts:
            assert (r.score, r.n_neighbours, r.evidence) == (m.base_empty, 0, [])
            continue
        q = np.zeros(len(m.terms))
        ids, w = m.vector(counts)
        q[list(ids)] = w
        cosine = np.round(dense @ q, 12)
        best = sorted((j for j in range(len(cosine)) if cosine[j] > 1e-12), key=lambda j: (-cosine[j], j))[: m.k]
        weight = 1 / (1.05 - np.minimum(cosine[best], 1.0))
        vote = ((weight * m.labels[best]).sum() + m.base) / (weight.sum() + 1)
        assert [where[e.doc_id] for e in r.evidence] == best and r.score == pytest.approx(float(np.interp(vote, m.cuts, m.values)))
        assert [e.toxic for e in r.evidence] == m.labels[best].astype(int).tolist()


def test_rows_are_dropped_by_their_own_text(spark):
    rng = random.Random(21)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, prose(rng, 20) + (" vile" if i % 2 else ""), "x") for i in range(60)]
    rows += [(None, "vile vile vile", "x"), (None, "w1 w2 w3 w4", "y"), (99, "vile vile", "x"), (99, "w5 w6 w7", "y"), (None, None, "y"), (98, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")  # a clashing column
    got = toxicity.drop_toxic(df, labels)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in got.where("score = 'y'").collect() if r.text is not None) == [(-1, "w1 w2 w3 w4"), (98, ""), (99, "w5 w6 w7")]
    assert not [r for r in got.collect() if "vile" in (r.text or "")]
    assert toxicity.drop_toxic(df.limit(0), labels).count() == 0
    item = "what is the capital city of the far away island kingdom that we learned about"
    bench = spark.createDataFrame([(1, item), (1, item + " in school"), (None, "x")], "item_id long, text string")
    leaks = spark.createDataFrame([(None, item), (None, "clean words"), (5, "so " + item), (5, "more clean words"), (6, None)], "doc_id long, text string")
    assert sorted((r.text or "") for r in decontaminate.drop_leaks(leaks, bench).collect()) == ["", "clean words", "more clean words"]
    assert decontaminate.find_leaks(leaks, bench).count() == 4
    assert decontaminate.find_leaks(leaks.limit(0), bench).count() == 0 and decontaminate.find_leaks(leaks, bench.limit(0)).count() == 0


def test_decontamination_against_alignment_of_all_pairs(spark):
    rng = random.Random(17)
    items = [prose(rng, rng.randint(3, 30)) for _ in range(15)] + ["If Anna buys 3 pens at 4 dollars each and 2 books at 9 dollars how much does Anna pay in all"]
    docs = [prose(rng, 50) for _ in range(20)]
    for i, item in enumerate(items):  # whole, in part, and with other values
        words = item.split()
        docs += [f"{prose(rng, 10)} {item} {prose(rng, 10)}", " ".join(words[: len(words) // 2]) + " " + prose(rng, 20)]
    docs.append("Now: " + items[-1].replace("Anna", "Peter").replace("3", "8").replace("9", "12"))
    docs.append("Now: " + items[-1].replace("Anna", "Peter", 1))  # one name for two is not consistent everywhere
    t = decontaminate.Templates()
    want = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            a, b = t.of(item.encode()), t.of(doc.encode())
            if len(a[0]) < 5:
                continue
            size = min(8, len(a[0]))
            if any(decontaminate.align(a, b, s, size, 6, 0.5) for s in range(-len(a[0]), len(b[0]))):
                want.add((d, i))
    got = decontaminate.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and (len(docs) - 2, 15) in want


def test_mixing_takes_whole_selected_blocks(spark, docs):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 120)), f"s{i % 3}") for i in range(120)] + [(None, prose(rng, 500), "s0"), (None, prose(rng, 30), None), (5, None, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, block_tokens=8, shard_tokens=900)
    keyed = df.select("doc_id", "source", common.word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(7), "doc_id", "text").alias("at"))
    shards = {r.source: max(1, -(-r.s // 900)) for r in keyed.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    n = F.element_at(F.create_map(*[x for k, v in shards.items() for x in (F.lit(k or "-"), F.lit(v))]), F.coalesce("source", F.lit("-")))
    held = keyed.withColumn("shard", F.pmod(F.xxhash64(F.lit(8), "at"), n)).collect()
    goal = {r.source: r.target for r in got.collect()}
    order = sorted(goal, key=lambda s: (s is None, s or ""))
    blocks = dict(zip(order, mixing.sainte_lague([goal[s] for s in order], int(sum(goal.values()) // 8)).tolist()))
    want = {}
    for s in order:
        own = {k: sorted((r for r in held if r.source == s and r.shard == k), key=lambda r: r["at"]) for k in range(shards[s])}
        own = {k: v for k, v in own.items() if v}
        sizes = [sum(r["size"] for r in v) for v in own.values()]
        quota = [min(int(q), 2 * -(-x // 8)) for q, x in zip(mixing.sainte_lague(sizes, blocks[s]), sizes)]
        spare = blocks[s] - sum(quota)
        for i, x in enumerate(sizes):
            give = min(spare, 2 * -(-x // 8) - quota[i])
            quota[i], spare = quota[i] + give, spare - give
        for (k, v), q, x in zip(own.items(), quota, sizes):
            there = -(-x // 8)
            if not there:
                continue
            a, c = mixing.permutation(there, f"7 {s} {k}")
            times = [q // there + ((a * b + c) % there < q % there) for b in range(there)]
            assert sum(times) == q  # a permutation: the quota to the block
            token = 0
            for r in v:
                want[r["at"]] = sum(times[i // 8] for i in range(token, token + r["size"]))
                token += r["size"]
    sums = Counter()
    for r in held:
        sums[r.doc_id, r.source, r["size"]] += want.get(r["at"], 0)
    have = Counter()
    for r in got.collect():
        have[r.doc_id, r.source, r["size"]] += r.taken
    assert have == sums


def test_line_runs_are_merged_in_order_and_without_shuffle(spark):
    rng = random.Random(31)
    store, seen = line_dedup.LineRuns(spark, min_docs=4, buckets=3), Counter()
    for _ in range(5):
        keys = [(rng.randrange(40), 7) for _ in range(60)]
        seen.update(keys)
        store.add(spark.createDataFrame(keys, "_ln_h1 long, _ln_h2 long"))
    a, b = store.levels[2][0], store.levels[0][0]
    with line_dedup._ordered_scans(spark):
        plan = store.merged(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort " not in plan
    assert {tuple(r) for r in store.frequent().collect()} == {k for k, n in seen.items() if n >= 4}


def test_line_dedup_of_null_and_repeated_ids(spark):
    rows = [(None, "Twice\nown")] * 2 + [(1, "twice\nlast"), (2, None), (2, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    got = line_dedup.dedup_lines(df, min_docs=5)
    assert sorted((r.doc_id or -1, r.text) for r in got.collect() if r.text is not None) == sorted((d or -1, t) for d, t in rows if t is not None)


def test_warc_null_ids_offsets_and_empty_table(spark):
    big = "é" * 200
    pages = spark.createDataFrame([(None, "http://a.org", big), (4, "http://a.org", big), (None, None, "z" * 150), (None, None, "z" * 150), (-1, "http://b.org", None)], "page_id long, url string, html string")
    path = common.shared_path(spark, "warc-nulls")
    warc.write_archives(warc.with_record_types(pages), path, per_file=2)
    captures = warc.read_captures(spark, path)
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.merge_runs(captures, 3).collect()]
    want = [(None, "revisit", 4, 400), (4, "response", None, 400), (None, "response", None, 150), (None, "response", None, 150), (-1, "response", None, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)
    files = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").collect()}
    for r in captures.collect():  # each record is read by its offset alone
        headers, block = warc.parse_record(next(warc.members(files[r.run][r.offset :]))[1])
        assert headers["WARC-Payload-Digest"] == f"sha256:{r.payload_digest}" and len(block) == (r.payload_bytes if r.record_type == "response" else 0)
    none = common.shared_path(spark, "warc-none")
    warc.write_archives(warc.with_record_types(pages.limit(0)), none)
    assert warc.merge_runs(warc.read_captures(spark, none)).count() == 0
    assert warc.records_per_file(pages.limit(0)) == 20_000


def test_templates_are_the_same_after_forgetting_words():
    """Words are looked up as arrays: what a text gives does not depend on which words were known before."""
    from codeloom.llm import decontaminate as dc

    texts = [b"", b"Anna ran 12 km. Bob ate 3,5 kg of m and Tom's (4) pies!", " ".join(f"Word{i} w{i} {i} cm" for i in range(700)).encode(), "Über \xff 7 %".encode("latin-1"), b"12"]
    fresh = [dc.Templates().of(x) for x in texts]
    few = dc.Templates(bound=5)
    for _ in range(2):
        for x, want in zip(texts, fresh):
            got = few.of(x)
            assert got[1] == want[1] and all(len(a) == len(b) and (a == b).all() for a, b in zip((got[0], *got[2:]), (want[0], *want[2:])))
    t = dc.Templates()
    h, slots, held, plain = t.of(texts[1])
    assert slots == [None, None, "12", "km", None, None, "3,5", "kg", None, None, None, "tom's", "4", None] and [s is not None for s in slots] == held.tolist() and h[2] == t.num and plain[2] != t.num
    assert all((a == b).all() for a, b in zip(t.read(texts[1])[:3], (h, held, plain)))
