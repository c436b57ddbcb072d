"""Replies of every shape that a model has sent, against the plain rules."""

import json

from codeloom.operators import results as rs

CASES = [
    ('{"verdict": "safe "}', ("SAFE", None, None, None, None, None)),
    ('{"verdict": "SAY WHAT", "finding": "Vulnerable"}', ("VULNERABLE", "Vulnerable", "SAY WHAT", None, "high", None)),
    ('{"verdict": "weird", "finding": ["x"], "confidence": 0.5}', ("ERROR", "error", "weird", '["x"]', None, 0.5)),
    ('{"verdict": "weird", "finding": "  "}', ("ERROR", "error", "weird", None, None, None)),
    ('{"verdict": null, "finding": "bypassable", "severity": "low"}', ("BYPASSABLE", "bypassable", None, None, "low", None)),
    ('{"finding": "insufficient_context"}', ("INSUFFICIENT_CONTEXT", "insufficient_context", None, None, None, None)),
    ('{"finding": "safe "}', ("ERROR", "error", None, "safe ", None, None)),
    ('{"finding": "ERROR"}', ("ERROR", "ERROR", None, None, None, None)),
    ('{"finding": null}', ("ERROR", "error", None, None, None, None)),
    ('{"finding": 3, "severity": "high"}', ("ERROR", "error", None, "3", None, None)),
    ('{"finding": ""}', ("ERROR", "error", None, "", None, None)),
    ('{"reasoning": "no"}', ("ERROR", "error", None, None, None, None)),
    ('[1]', ("ERROR", "error", None, None, None, None)),
    ('no json', ("ERROR", "error", None, None, None, None)),
    (None, ("ERROR", "error", None, None, None, None)),
    ("", ("ERROR", "error", None, None, None, None)),
]
CONFIDENCES = [("1.5", 1.0, None), ("-0.3", 0.0, None), ("1", 1.0, None), ("true", None, "true"), ('"high"', None, "high"), ("null", None, None), ("NaN", None, "NaN"), ("-Infinity", None, "-Infinity"), ('"a NaN b"', None, "a NaN b"), ("0.25", 0.25, None), ("[1]", None, "[1]")]


def test_normalized(spark):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "id int, json string")
    got = {r.id: (r.verdict, r.finding, r.raw_verdict, r.raw_finding, r.severity, r.confidence) for r in rs.normalized(rows).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    huge = "9" * 400
    texts = [f'{{"finding": "safe", "confidence": {c}}}' for c, *_ in CONFIDENCES] + [f'{{"finding": "safe", "confidence": {huge}}}', '{"finding": "safe"}']
    got = {r.id: r for r in rs.normalized(spark.createDataFrame(list(enumerate(texts)), "id int, json string")).collect()}
    for i, (_, number, raw) in enumerate(CONFIDENCES):
        assert (got[i].verdict, got[i].confidence, got[i].raw_confidence) == ("SAFE", number, raw)
    assert got[len(CONFIDENCES)].verdict == "SAFE" and got[len(CONFIDENCES)].confidence is None
    assert got[len(texts) - 1].raw_confidence is None
    assert rs.normalized(rows.limit(0)).count() == 0


def test_result_objects(spark):
    texts = ['{"results": [{"a": 1}, 3, null, "x", [{}], {"b": NaN}]}', '{"results": {"a": 1}}', '{"results": 0}', '{"results": ""}', '{"results": []}', '{"results": null}', "{}", "junk", None, '{"results": {}}']
    got = {r.id: ([json.loads(x) for x in r.kept], r.n_dropped) for r in rs.result_objects(spark.createDataFrame(list(enumerate(texts)), "id int, json string")).collect()}
    assert got[0] == ([{"a": 1}, {"b": "NaN"}], 4)
    assert [got[i][1] for i in range(1, len(texts))] == [1, 1, 0, 0, 0, 0, 0, 0, 0]
    assert all(got[i][0] == [] for i in range(1, len(texts)))
