"""Quality rules: text statistics and a learned decision list, as DataFrame expressions.

The list is learned on the driver by sequential covering from at most `max_rows` labelled rows of
numbers (no text): a rule is a conjunction of thresholds grown by FOIL gain on two thirds of the
rows and pruned on the rest; rules follow until none pays.  It is emitted as one ordered
when/when/otherwise expression, so scoring is a projection.

Defined results: a null or empty text has 0 of everything and fails the base rule; labels that are
null or absent teach nothing; several labels of one document count as the lowest; without both
classes the list is empty and keeps all; repeated rows are rows of their own; an empty table
gives an empty result; further columns pass through `with_statistics`, but those that bear a
statistic's or feature's name (in any case) are replaced, and the prefix `_q_` is reserved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
WINDOW = 8
FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "bangs_per_word", "distinct_share")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def with_statistics(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_q_text", text)
    d = d.withColumn("_q_h", F.transform(common.word_array(F.col("_q_text")), lambda w: F.xxhash64(w)))
    d = d.withColumn("_q_lines", F.filter(F.split("_q_text", "\n", -1), lambda x: common.strip_blanks(x) != ""))
    n = F.size("_q_h")
    d = d.withColumn("_q_win", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(F.col("_q_h"), i, WINDOW)))))
    twice = F.size(F.array_distinct("_q_win")) < F.size("_q_win")
    d = d.withColumn("_q_sorted", F.when(twice, F.sort_array(F.transform("_q_win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    at = lambda i: F.get(F.col("_q_sorted"), i)["x"]
    again = F.filter("_q_sorted", lambda p, i: F.coalesce(at(i - 1) == p["x"], F.lit(False)) | F.coalesce(at(i + 1) == p["x"], F.lit(False)))
    d = d.withColumn("_q_at", F.sort_array(F.transform(again, lambda p: p["i"])))
    steps = F.zip_with("_q_at", F.slice("_q_at", F.lit(2), F.size("_q_at")), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    repeat = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    d = d.withColumns({
        "n_words": n.cast("long"),
        "word_chars": _without(F.col("_q_text"), common.BLANKS).cast("long"),
        "n_symbols": (F.length("_q_text") - _without(F.col("_q_text"), SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": repeat,
        "_q_n_lines": F.size("_q_lines"),
        "_q_upper": F.length("_q_text") - _without(F.col("_q_text"), common.UPPER),
        "_q_bangs": F.length("_q_text") - _without(F.col("_q_text"), "!?"),
        "_q_distinct": F.size(F.array_distinct("_q_h")),
    })
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = {
        "chars_per_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_q_n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("_q_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "bangs_per_word": F.col("_q_bangs") / words,
        "distinct_share": F.col("_q_distinct") / words,
    }
    return d.withColumns(share).drop("_q_text", "_q_h", "_q_lines", "_q_win", "_q_sorted", "_q_at", "_q_n_lines", "_q_upper", "_q_bangs", "_q_distinct")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is_at_least, threshold); it rejects what it covers."""

    terms: tuple[tuple[str, bool, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, least, cut in self.terms:
            col = x[:, FEATURES.index(name)]
            out &= (col >= cut) if least else (col < cut)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, least, cut in self.terms:
            out = out & ((F.col(name) >= cut) if least else (F.col(name) < cut))
        return out


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], most_terms: int) -> Rule:
    rule, inside = Rule(()), np.ones(len(x), bool)
    while len(rule.terms) < most_terms and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None, None)
        for f, name in enumerate(FEATURES):
            order = np.sort(x[inside & bad, f]), np.sort(x[inside & ~bad, f])
            below = [np.searchsorted(o, cuts[f]) for o in order]
            for least, p, n in ((True, p0 - below[0], n0 - below[1]), (False, below[0], below[1])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (gain[k], (name, least, float(cuts[f][k])), None)
        if best[1] is None:
            break
        rule = Rule((*rule.terms, best[1]))
        inside = rule.covers(x)
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    c = rule.covers(x)
    p, n = int((c & bad).sum()), int((c & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, most_rules: int = 12, most_terms: int = 4, least_worth: float = 0.6, cuts_per_feature: int = 200) -> list[Rule]:
    """Sequential covering; rows are taken in their order, every third one prunes."""
    rules: list[Rule] = []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts_per_feature), method="nearest")) for f in range(x.shape[1])] if len(x) else []
    test = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (left & bad & ~test).sum() >= 3:
        g, v = left & ~test, left & test
        rule = _grow(x[g], bad[g], cuts, most_terms)
        while len(rule.terms) > 1:
            shorter = Rule(rule.terms[:-1])
            if _worth(shorter, x[v], bad[v]) < _worth(rule, x[v], bad[v]):
                break
            rule = shorter
        if not rule.terms or _worth(rule, x[v], bad[v]) < least_worth:
            break
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def decision_list(rules: list[Rule]) -> Column:
    """The verdict `kept`: false under the first rule that covers, true under none."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> list[Rule]:
    """Rules from the labelled documents of the `max_rows` least hashes of doc_id."""
    taught = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_q_doc")).agg(F.min("quality").alias("_q_quality"))
    part = min(1.0, max_rows / max(1, taught.count()))
    place = F.pmod(F.xxhash64("_q_doc"), F.lit(1_000_003))
    taught = taught.where(place <= int(part * 1_000_003)).orderBy(place, "_q_doc").limit(max_rows)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(taught), F.col("doc_id") == F.col("_q_doc")))
    # base_failed is a column, not a filter: a filter would be pushed below the statistics and repeat them
    got = sorted(tuple(r)[:-1] for r in rows.select("doc_id", *FEATURES, "_q_quality", base_failed().alias("failed")).collect() if not r.failed)
    data = np.array([r[1:] for r in got], float).reshape(len(got), len(FEATURES) + 1)
    return learn(data[:, :-1], data[:, -1] == 0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rules = fit(docs, common.table(spark, sf_dir, "labels"))
    out = with_statistics(docs.select("doc_id", "text"))
    kept = ~base_failed() & decision_list(rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"))
