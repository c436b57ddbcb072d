"""Stateful streams stopped and resumed, late ends, timers."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from codeloom.streaming import stateful as st

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return (T0 + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%f")


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    when = 1_700_000_000 + int(name.split(".")[0])  # files are taken in order of their time
    os.utime(folder / name, (when, when))


def run(spark, stream, out):
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def test_log_tail_is_replayable(spark, tmp_path):
    st.use_state_store(spark)
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "j1.log").write_bytes(b"one\ntwo\npart")
    (folder / "j2.log").write_bytes("é\r\n".encode() + b"x" * 50 + b"\n\n")
    (folder / "other.txt").write_bytes(b"no\n")
    lines = lambda: st.log_lines(spark, str(folder), split_bytes=20)
    first = {tuple(r) for r in run(spark, lines(), tmp_path / "out").collect()}
    assert first == {("j1", 0, "one"), ("j1", 4, "two"), ("j2", 0, "é"), ("j2", 4, "x" * 50), ("j2", 55, "")}
    with open(folder / "j1.log", "ab") as f:
        f.write(b"ial\nlast\n")
    (folder / "j3.log").write_bytes(b"new\n")
    resumed = [tuple(r) for r in run(spark, lines(), tmp_path / "out").collect()]
    assert sorted(resumed) == sorted(first | {("j1", 8, "partial"), ("j1", 16, "last"), ("j3", 0, "new")})
    assert sorted(tuple(r) for r in run(spark, lines(), tmp_path / "once").collect()) == sorted(resumed)


LOG = "job string, at timestamp, seq long, line string, status string"


def log_rows(spark, folder, **more):
    return st.indexed_log(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(folder)), **more)


def row(job, seconds, seq, line=None, status=None):
    return {"job": job, "at": at(seconds), "seq": seq, "line": line, "status": status}


def test_index_survives_a_stop(spark, tmp_path):
    st.use_state_store(spark)
    parts = [
        [row("a", 2, 2, "a1"), row("a", 1, 1, "a0"), row("b", 1, 1, "b0"), row("c", 5, 1, "c0")],
        [row("a", 10, 3, "a2"), row("b", 11, 2, status="success"), row("b", 12, 3, "late")],
        [row("a", 20, 4, "a3", "error"), row("b", 21, 4, "later")],
        [row("d", 5000, 1, "d0")],
        [row("c", 5001, 2, "after the end"), row("e", 5002, 1, None)],
    ]
    for i, rows in enumerate(parts):
        put(tmp_path / "in", f"{i}.json", rows)
        if i not in (1, 3):
            run(spark, log_rows(spark, tmp_path / "in", idle_seconds=60), tmp_path / "stopped")
    resumed = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/stopped/rows").collect()), key=repr)
    want = [("a", 0, "line", "a0"), ("a", 1, "line", "a1"), ("a", 2, "line", "a2"), ("a", 3, "line", "a3"), ("a", 4, "done", "error"), ("b", 0, "line", "b0"), ("b", 1, "done", "success"), ("c", 0, "line", "c0"), ("c", 1, "expired", None), ("d", 0, "line", "d0")]
    assert resumed == sorted(want, key=repr)
    assert sorted((tuple(r) for r in run(spark, log_rows(spark, tmp_path / "in", idle_seconds=60), tmp_path / "once").collect()), key=repr) == resumed


def test_caps_hold_over_batches(spark, tmp_path):
    st.use_state_store(spark)
    put(tmp_path / "in", "0.json", [row("a", i, i, f"l{i}") for i in range(3)] + [row("b", 0, 0, "x" * 9)])
    put(tmp_path / "in", "1.json", [row("a", 10 + i, 10 + i, f"m{i}") for i in range(3)] + [row("b", 11, 1, "yy"), row("b", 12, 2, "z", "done")])
    got = sorted(map(tuple, run(spark, log_rows(spark, tmp_path / "in", most_lines=4, most_bytes=10), tmp_path / "o").collect()), key=repr)
    assert got == sorted([("a", 0, "line", "l0"), ("a", 1, "line", "l1"), ("a", 2, "line", "l2"), ("a", 3, "line", "m0"), ("b", 0, "line", "x" * 9), ("b", 1, "done", "done")], key=repr)


def test_backoff_only_grows_and_ends_by_timer(spark, tmp_path):
    st.use_state_store(spark)
    stream = lambda: st.shared_backoff(spark.readStream.schema("provider string, at timestamp, seq long, retry_after double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), 30)
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 1000
    report = lambda p, s, seq, after: {"provider": p, "at": at(s), "seq": seq, "retry_after": after}
    for i, rows in enumerate([[report("p", 0, 0, 100.0), report("p", 5, 1, None)], [report("p", 90, 2, None), report("q", 90, 3, 0.5)], [report("q", 500, 4, None)], [report("r", 501, 5, None)]]):
        put(tmp_path / "in", f"{i}.json", rows)
        run(spark, stream(), tmp_path / "o")
    got = {(r.provider, r.event, r.at_ms - base, r.until_ms - base) for r in spark.read.parquet(f"{tmp_path}/o/rows").collect()}
    assert got == {("p", "extended", 0, 100_000), ("p", "extended", 90_000, 120_000), ("q", "extended", 90_000, 120_000), ("p", "ready", 120_000, 120_000), ("q", "extended", 500_000, 530_000), ("r", "extended", 501_000, 531_000)} | ({("q", "ready", 120_000, 120_000)} & got)
    wake = spark.range(50).select(st.wakes_at(F.lit(1000).cast("long"), F.col("id")).alias("w"))
    assert wake.where("w < 1000 OR w >= 3000").count() == 0 and wake.distinct().count() > 40


def test_progress_counts_over_batches(spark, tmp_path):
    st.use_state_store(spark)
    schema = "step string, at timestamp, seq long, label string, total int, base_cost double, total_cost double"
    stream = lambda: st.step_progress(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), every=2)
    for i in range(2):
        put(tmp_path / "in", f"{i}.json", [{"step": "s", "at": at(10 * i + k), "seq": 10 * i + k, "label": "u" * 60, "total": 4, "base_cost": 5.0, "total_cost": 6.0 + 2 * i + k} for k in range(2)])
        run(spark, stream(), tmp_path / "o")
    got = sorted((r.done, len(r.label), r.unit_cost, r.step_cost, r.is_summary) for r in spark.read.parquet(f"{tmp_path}/o/rows").collect())
    assert got == [(1, 50, 1.0, 1.0, False), (2, 50, 1.0, 2.0, True), (3, 50, 1.0, 3.0, False), (4, 50, 1.0, 4.0, False)]
