"""Blanking against a plain reading of one character at a time, and against the pattern of the Rust form."""

import random
import re

from pyspark.sql import functions as F

from codeloom.functions import code_text as ct

ALPHABET = ["a", "b", " ", "\n", '"', "'", "\\", "/", "*", "#", "r", 'r"', 'r#"', '"#', "//", "/*", "*/", "f(", "\\n", "é", "\U0001f600"]
RUST = re.compile(r'''r#"(?:[^"]|"(?!#))*"#|r"[^"]*"|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])\'''')


def draws(n):
    rnd = random.Random(17)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def slow(text):
    """Blank by a state for each character."""
    state, out, i = "", "", 0
    while i < len(text):
        two, c = text[i : i + 2], text[i]
        if not state and two in ("//", "/*"):
            state, out, i = two, out + "  ", i + 2
        elif not state:
            state, out, i = (c, out + " ", i + 1) if c in "'\"" else ("", out + c, i + 1)
        elif state == "//":
            state, out, i = ("", out, i) if c == "\n" else (state, out + " ", i + 1)
        elif state == "/*" and two == "*/":
            state, out, i = "", out + "  ", i + 2
        elif state != "/*" and c == "\\" and len(two) == 2:
            out, i = out + "  ", i + 2
        else:
            out, i = out + (c if c == "\n" else " "), i + 1
            state = "" if c == state else state
    return out


def test_blanking_equals_the_slow_readings(spark):
    texts = draws(50_000)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    got = rows.select("id", ct.blanked_c(F.col("x")).alias("c"), ct.blanked_rust(F.col("x")).alias("r")).collect()
    assert len(got) == len(texts)
    for id, c, r in got:
        assert c == slow(texts[id]), repr(texts[id])
        assert r == RUST.sub(" ", texts[id]), repr(texts[id])


def test_long_and_adversarial_texts_are_read_once(spark):
    texts = ['r#"' * 80_000, '"' + "a\\\"" * 200_000, "/*" + "*" * 500_000, "'" * 300_001, "/" * 300_001, None, ""]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, x string")
    got = {r.id: r.c for r in rows.select("id", ct.blanked_c(F.col("x")).alias("c")).collect()}
    for i, x in enumerate(texts):
        assert got[i] == (None if x is None else " " * len(x) if i else slow(x))
    flood = spark.createDataFrame([('r#"' * 80_000,), (None,), ("",)], "x string")
    assert [r[0] for r in flood.select(ct.blanked_rust(F.col("x"))).collect()] == ["r# " * 40_000, None, ""]


def test_called_names(spark):
    rows = spark.createDataFrame([("if (a) f(1); // g(2)\nx = \"h(3)\"; f(2); /* k( */ m (n)",)], "x string")
    assert rows.select(ct.called_names(F.col("x"))).first()[0] == ["f", "m"]
    assert rows.select(ct.called_names(F.col("x"), "python")).first()[0] == ["if", "f", "g", "h", "k", "m"]
    assert spark.sql("SELECT 'save!(1) if (x)' AS x").select(ct.called_names(F.col("x"), "ruby")).first()[0] == ["save!"]
