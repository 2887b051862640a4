"""A levelled log of segments: the present rows of a table that changes batch by batch.

A batch is a segment on level 0. When a level has ``fanout`` segments they are merged
into one of the next level, where the newest row of a key stays; so a read opens at most
``fanout`` segments of each level, and there are about as many levels as the number of
batches has digits. A removed key leaves a tombstone until its segment is merged with
the oldest one. What belongs to the log says a manifest, which is written whole after the
segments it names: a batch that is run again changes nothing, and one that failed midway
leaves the log as it was.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

FANOUT = 4


class SegmentLog:
    """Rows of ``schema`` by unique ``key`` under a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, fanout: int = FANOUT):
        self.spark, self.path, self.key, self.fanout = spark, path.rstrip("/"), key, fanout
        self.schema = schema
        self.stored = StructType([*schema.fields, StructField("_removed", BooleanType()), StructField("_batch", LongType())])

    def _manifests(self) -> list[str]:
        """Whole manifests, oldest first."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [x.getPath() for x in fs.listStatus(folder)]
        return sorted(p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def segments(self) -> list[dict]:
        """Name, level, first and last batch of each segment, oldest first."""
        names = self._manifests()
        if not names:
            return []
        (row,) = self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).collect()
        return json.loads(row.value)

    def _commit(self, segments: list[dict], batch: int, step: int) -> None:
        text = self.spark.createDataFrame([(json.dumps(segments),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{self.path}/manifests/{batch:012d}-{step:03d}")

    def _rows(self, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.stored)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(self.stored).parquet(f"{self.path}/{s['name']}") for s in segments])

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The newest row of each key: a partial aggregation, no sort of a key's rows."""
        row = F.struct(*[F.col(f.name) for f in self.stored.fields])
        return rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(row, "_batch").alias("_row")).select("_row.*")

    def append(self, rows: DataFrame, batch: int, removed: DataFrame | None = None) -> bool:
        """Add a batch (its keys unique) and the keys it removes; False, and nothing done, if the log has it already."""
        segments = self.segments()
        if segments and segments[-1]["high"] >= batch:
            return False
        new = rows.select(*self.schema.fieldNames()).withColumn("_removed", F.lit(False))
        if removed is not None:
            gone = removed.select(self.key).distinct()
            blank = [F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
            new = new.join(gone, self.key, "left_anti").unionByName(gone.select(*blank, F.lit(True).alias("_removed")))
        self._write(new.withColumn("_batch", F.lit(batch).cast("long")), f"segment-{batch:012d}-0")
        segments.append({"name": f"segment-{batch:012d}-0", "level": 0, "low": batch, "high": batch})
        self._commit(segments, batch, 0)
        step = 0
        while (full := self._full(segments)) is not None:
            step += 1
            own = [s for s in segments if s["level"] == full]
            at = segments.index(own[0])
            rows = self._newest(self._rows(own))
            if at == 0:  # nothing older is left that a tombstone could hide
                rows = rows.where("not _removed")
            name = f"segment-{batch:012d}-{step}"
            self._write(rows, name)
            segments[at : at + len(own)] = [{"name": name, "level": full + 1, "low": own[0]["low"], "high": own[-1]["high"]}]
            self._commit(segments, batch, step)
        return True

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.select(*self.stored.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def _full(self, segments: list[dict]) -> int | None:
        counts: dict[int, int] = {}
        for s in segments:
            counts[s["level"]] = counts.get(s["level"], 0) + 1
        return min((level for level, n in counts.items() if n >= self.fanout), default=None)

    def read(self) -> DataFrame:
        """The present rows; columns that are not selected afterwards are neither read nor moved."""
        segments = self.segments()
        rows = self._rows(segments)
        if len(segments) > 1:
            newest = [F.max_by(f.name, "_batch").alias(f.name) for f in self.stored.fields if f.name != self.key]
            rows = rows.groupBy(self.key).agg(*newest)
        return rows.where("not _removed").select(*self.schema.fieldNames())

    def held(self, keys: DataFrame, segments: list[dict] | None = None) -> DataFrame:
        """Those of ``keys`` (a column named like the log's key) that the log, or some of its segments, has; for logs that remove nothing."""
        return keys.join(self._rows(self.segments() if segments is None else segments).select(self.key), self.key, "left_semi")

    def vacuum(self) -> int:
        """Delete segments and manifests that the newest manifest does not need; how many went. Not while somebody reads."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        needed = {s["name"] for s in self.segments()}
        newest = self._manifests()[-1:]
        gone = [x.getPath() for x in fs.listStatus(root) if x.getPath().getName() not in {*needed, "manifests"}]
        gone += [x.getPath() for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(root, "manifests")) if x.getPath().getName() not in newest]
        for p in gone:
            fs.delete(p, True)
        return len(gone)
