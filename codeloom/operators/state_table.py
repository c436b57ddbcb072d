"""A versioned table of what has been done for each unit: append-only snapshots under a manifest.

    path/data/<snapshot>/   rows as Parquet: unit, code_digest, state (JSON or any text), version, checksum
    path/log/<version>.json the manifest: which snapshots count, under which identity, what was archived

Nothing is rewritten or deleted.  A version is published by creating its manifest file, which fails if
another writer has created it, so two writers cannot both publish one version; a snapshot that no
manifest names does not count.  The latest row of a unit wins.

Identity says which backend the rows come from (see `prose.fingerprint`).  `sync` decides what
happens to the rows that are there:

| status | found | done |
|---|---|---|
| new | no manifest, no rows | stamped |
| legacy | rows, no manifest | adopted and stamped: what cannot be checked is not paid for again |
| match | the same identity | adopted |
| reset | another identity, or a manifest that cannot be read | its snapshots are archived (listed, not deleted) and no row counts |

So it fails closed: an unreadable manifest never lends its rows, and a row whose checksum does not
fit is left out, which makes its unit pending again; `corrupt` shows them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "unit string, code_digest string, state string, is_error boolean, version long, checksum string"


class Conflict(Exception):
    """Another writer has published this version."""


def checksum(*cells: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*(c.cast("string").alias(f"c{i}") for i, c in enumerate(cells))), {"ignoreNullFields": "false"}).cast("binary"), 256)


@dataclass(frozen=True)
class Version:
    number: int
    identity: str | None
    snapshots: tuple[str, ...]
    archived: tuple[str, ...]
    readable: bool = True


class StateTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def latest(self) -> Version | None:
        """The newest manifest; one that cannot be read counts, as unreadable."""
        numbers = [int(n.removesuffix(".json")) for n in self._names("log") if n.removesuffix(".json").isdigit()]
        if not numbers:
            return None
        number = max(numbers)
        try:
            lines = self.spark.read.text(f"{self.path}/log/{number:012d}.json", wholetext=True).collect()
            m = json.loads(lines[0].value)
            return Version(number, m["identity"], tuple(m["snapshots"]), tuple(m["archived"]))
        except (ValueError, KeyError, TypeError, IndexError):
            return Version(number, None, (), (), False)

    def _publish(self, number: int, identity: str | None, snapshots: tuple[str, ...], archived: tuple[str, ...]) -> Version:
        text = json.dumps({"identity": identity, "snapshots": snapshots, "archived": archived})
        try:
            out = self._fs.create(self._at(f"log/{number:012d}.json"), False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise Conflict(f"version {number}") from e
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return Version(number, identity, snapshots, archived)

    def sync(self, identity: str) -> str:
        """new, legacy, match or reset: decides about the rows that are there and stamps the table."""
        now, there = self.latest(), tuple(self._names("data"))
        if now is None:
            self._publish(1, identity, there, ())
            return "legacy" if there else "new"
        if now.readable and now.identity == identity:
            return "match"
        known = now.snapshots if now.readable else tuple(n for n in there if n not in now.archived)
        self._publish(now.number + 1, identity, (), tuple(sorted({*now.archived, *known})))
        return "reset"

    def append(self, rows: DataFrame) -> int:
        """Publishes rows (unit, code_digest, state, is_error) as a new version, and returns its number."""
        now = self.latest()
        if now is None or not now.readable:
            raise ValueError("sync the table before writing to it")
        number, name = now.number + 1, f"s-{uuid.uuid4().hex}"
        cells = [F.col("unit").cast("string"), F.col("code_digest").cast("string"), F.col("state").cast("string"), F.col("is_error").cast("boolean"), F.lit(number).cast("long")]
        out = rows.where("unit IS NOT NULL").select(*(c.alias(n.split(" ")[0]) for c, n in zip(cells, SCHEMA.split(", "))), checksum(*cells).alias("checksum"))
        out.write.parquet(f"{self.path}/data/{name}")
        self._publish(number, now.identity, (*now.snapshots, name), now.archived)
        return number

    def _rows(self) -> DataFrame:
        now = self.latest()
        names = now.snapshots if now is not None and now.readable else ()
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/data/{n}" for n in names))

    def _sound(self) -> Column:
        return F.coalesce(F.col("checksum") == checksum(*(F.col(n.split(" ")[0]) for n in SCHEMA.split(", ")[:-1])), F.lit(False)) & F.col("unit").isNotNull()

    def corrupt(self) -> DataFrame:
        return self._rows().where(~self._sound())

    def read(self) -> DataFrame:
        """unit, code_digest, state, is_error, version: the last sound row of each unit, of equal versions the greatest."""
        last = F.max(F.struct("version", "code_digest", "state", "is_error"))
        return self._rows().where(self._sound()).groupBy("unit").agg(last.alias("r")).select("unit", "r.code_digest", "r.state", "r.is_error", "r.version")

    def resume(self, units: DataFrame) -> DataFrame:
        """units (unit, code_digest, ...) with status: adopted, or why it is to be done: new, changed (its code is
        another), failed (its row is an error); and the adopted state."""
        held = self.read().select(F.col("unit").alias("h_unit"), F.col("code_digest").alias("h_digest"), F.col("state").alias("h_state"), F.col("is_error").alias("h_error"))
        why = F.when(F.col("h_unit").isNull(), "new").when(~F.col("code_digest").eqNullSafe(F.col("h_digest")), "changed").when(F.coalesce("h_error", F.lit(False)), "failed").otherwise("adopted")
        return units.join(held, F.col("unit") == F.col("h_unit"), "left").select(*units.columns, why.alias("status"), F.when(why == "adopted", F.col("h_state")).alias("state"))

    def gone(self, units: DataFrame) -> DataFrame:
        """Rows of units that are no more."""
        return self.read().join(units.select("unit"), "unit", "left_anti")
