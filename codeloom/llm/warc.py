"""WARC archives of pages, and an external merge of their capture index.

Writing: one record per row, each a gzip member of its own, so that it can be read by its offset.
Spark's text writer puts the members into files, so that they go to any store Spark can write; its
line separator is an empty gzip member.  Files hold about `file_bytes` of payload.
Of records with equal payloads of `min_bytes` or more, the one with the smallest id is a
response and the others are revisits of it.

Reading: each archive is parsed member by member into captures.  Its captures form one run sorted
by URL key and time.  Runs are cut at common range bounds, as many ranges as archives or more, and the
cuts of one range are merged by a k-way loser tree, so the ranges in order give the capture history
of every URL in order; a range holds about as many captures as an archive, also of one URL.

Defined results: null html is an empty payload, null url is written as an empty URI and read back
as ''; a null page_id is kept, is never the response that others refer to unless all ids of its
payload are null (then all are responses), and has the capture time of id 0; repeated rows give
repeated records of the same type and record id; an empty table gives no archive and an empty index;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CRLF2 = "\r\n\r\n"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
CAPTURE = "run string, page_id long, url string, url_key string, ts string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, offset long"


def url_key(url: Column) -> Column:
    """Sort-friendly form: host labels reversed, without www and scheme, then path and query."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(bare, "^([^/?#]*)", 1), "^www\\d*\\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.regexp_replace(bare, "^[^/?#]*", ""))


def _uri(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x20\\x7F]", "%20")


def with_record_types(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, record_type and refers_to of every page."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    p = p.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    large = p.where(F.col("n_bytes") >= min_bytes)
    shared = large.groupBy(F.col("digest").alias("_w_digest")).agg(F.min("page_id").alias("_w_first"), F.count(F.lit(1)).alias("_w_n")).where("_w_n > 1")
    out = p.join(shared, F.col("digest") == F.col("_w_digest"), "left")
    revisit = F.col("_w_first").isNotNull() & ~F.col("_w_first").eqNullSafe(F.col("page_id"))
    return out.select(
        "page_id", "url", "payload", "digest", "n_bytes",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("_w_first")).alias("refers_to"),
    )


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(0):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(z.compress(x.as_buffer()) + z.flush())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def records_per_file(pages: DataFrame, file_bytes: int = 64 << 20, most: int = 20_000) -> int:
    """So many records hold about `file_bytes` of payload and heads."""
    n, size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length("html"))).first()
    return max(1, min(most, file_bytes // (500 + (size or 0) // max(1, n))))


def write_archives(records: DataFrame, path: str, per_file: int = 20_000, captured: str = "2024-01-01T00:00:00Z") -> None:
    """records: what `with_record_types` returns.  The capture time is `captured` plus page_id seconds."""
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(captured), "yyyy-MM-dd'T'HH:mm:ssX") + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("record_type") == "revisit"
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), _record_id(F.col("page_id")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), at),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url"))),
        F.concat(F.lit("WARC-URL-Key: "), url_key(_uri(F.col("url")))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("n_bytes").cast("string")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), _record_id(F.col("refers_to")), F.lit(">"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    members = records.select(F.concat(head, F.lit(CRLF2), body, F.lit(CRLF2)).cast("binary").alias("record")).mapInArrow(_members, "member binary")
    writer = members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    writer.option("maxRecordsPerFile", per_file).text(path)


def members(content: bytes, piece: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of each gzip member, one in memory; those without data are left out."""
    at = 0
    while at < len(content):
        start, z, data = at, zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(content):
                raise ValueError(f"member at {start} is cut short")
            data.append(z.decompress(content[at : at + piece]))
            at += len(content[at : at + piece])
        at -= len(z.unused_data)
        if out := b"".join(data):
            yield start, out


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a record head has no end")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in data[:end].decode("utf-8").split("\r\n")[1:])
    size = int(headers["Content-Length"])
    if len(data) != end + 8 + size:
        raise ValueError("a record is not as long as it says")
    return headers, data[end + 4 : end + 4 + size]


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in CAPTURE.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split(" ")[1]]) for n, x in zip(names, CAPTURE.split(", "))])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = []
            for offset, data in members(content.as_buffer()):
                h, block = parse_record(bytes(data))
                kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:")
                n = int(h["WARC-Payload-Length"])
                if kind == "response":
                    n, found = len(block), hashlib.sha256(block).hexdigest()
                else:
                    found = digest
                refers = h.get("WARC-Refers-To-Page-ID")
                page = h.get("WARC-Page-ID")
                rows.append((path, int(page) if page else None, h["WARC-Target-URI"], h["WARC-URL-Key"], h["WARC-Date"], kind, int(refers) if refers else None, n, found, found == digest, offset))
            rows.sort(key=lambda r: (r[3], r[4], r[1] is not None, r[1] or 0))
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 5000]), schema)], schema=schema)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive below `path`; each archive's are one sorted run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_captures, CAPTURE)


class LoserTree:
    """k-way merge: the inner nodes hold the losers of their matches, `winner` the least head."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (self.key(x), a) < (self.key(y), b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            held = self.tree[node]
            if held < 0:
                self.tree[node] = i
                return
            if self._less(held, i):
                self.tree[node], i = i, held
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k and self.heads[w := self.tree[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def merge_runs(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """The captures in global order of (url_key, ts, page_id), partitions being consecutive ranges."""
    keys = ["url_key", "ts", "page_id"]
    n = ranges or captures.sparkSession.sparkContext.defaultParallelism
    cut = captures.repartitionByRange(n, *keys).sortWithinPartitions("run", *keys, "offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        key_cols = [t.column(c).to_pylist() for c in keys]
        key_cols[2] = [(x is not None, x or 0) for x in key_cols[2]]
        runs: dict[str, list[int]] = {}
        for i, r in enumerate(t.column("run").to_pylist()):
            runs.setdefault(r, []).append(i)
        order = list(LoserTree([iter(x) for x in runs.values()], lambda i: (key_cols[0][i], key_cols[1][i], key_cols[2][i])))
        yield from t.take(pa.array(order, pa.int64())).to_batches(max_chunksize=5000)

    return cut.mapInArrow(merge, CAPTURE)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = common.shared_path(spark, "warc")
    write_archives(with_record_types(pages), path, records_per_file(pages))
    captures = read_captures(spark, path)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").count()
    return merge_runs(captures, max(spark.sparkContext.defaultParallelism, archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
