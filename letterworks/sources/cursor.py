"""Sources with cursors as a streaming data source, and their health.

A feed is a folder ``<root>/<source>/<epoch>/`` of Parquet files ``<first>-<last>.parquet``
with the columns cursor and payload; the greatest epoch of a source is its present
identity. The offset of the stream is, for each source, its epoch and last cursor, so
a restart goes on from the checkpoint, and a source of another identity starts anew. A
source that cannot be listed keeps its offset until it can.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source string, epoch long, cursor long, payload string"


def write_feed(rows: DataFrame, root: str) -> None:
    """Append rows (source, epoch, cursor, payload) to a feed: each task writes files named by the cursors they hold.

    Rows are dealt by ranges, so a large source is written by many tasks.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key in table.select(["source", "epoch"]).group_by(["source", "epoch"]).aggregate([]).to_pylist():
                own = table.filter(pc.and_(pc.equal(table["source"], key["source"]), pc.equal(table["epoch"], key["epoch"]))).sort_by("cursor")
                folder = f"{base}/{key['source']}/{key['epoch']}"
                fs.create_dir(folder)
                low, high = own["cursor"][0].as_py(), own["cursor"][-1].as_py()
                part = f"{folder}/_{low:020d}-{high:020d}"
                pq.write_table(own.select(["cursor", "payload"]), part, filesystem=fs)
                fs.move(part, f"{folder}/{low:020d}-{high:020d}.parquet")
        yield pa.RecordBatch.from_pydict({"done": pa.array([True])})

    sorted_ = rows.select("source", "epoch", "cursor", "payload").repartitionByRange("source", "epoch", "cursor").sortWithinPartitions("source", "epoch", "cursor")
    sorted_.mapInArrow(write, "done boolean").count()


@dataclass
class _Files(InputPartition):
    source: str
    epoch: int
    after: int
    last: int
    path: str


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def _list(self) -> dict[str, tuple[int, list[tuple[int, int, str]]]]:
        """For each source that can be listed its present epoch and that epoch's files (first, last, path)."""
        fs, base = pafs.FileSystem.from_uri(self.root)
        out = {}
        for folder in fs.get_file_info(pafs.FileSelector(base)):
            try:
                epochs = [int(x.base_name) for x in fs.get_file_info(pafs.FileSelector(folder.path)) if x.type == pafs.FileType.Directory]
                if not epochs:
                    continue
                files = fs.get_file_info(pafs.FileSelector(f"{folder.path}/{max(epochs)}"))
                spans = [(*map(int, x.base_name.removesuffix(".parquet").split("-")), x.path) for x in files if not x.base_name.startswith(("_", "."))]
            except (OSError, ValueError):  # this source has to wait, the others have not
                continue
            out[folder.base_name] = max(epochs), sorted(spans)
        return out

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: [epoch, max((last for _, last, _ in files), default=-1)] for name, (epoch, files) in self._list().items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        listed = self._list()
        out = []
        for name, (epoch, last) in end.items():
            before = start.get(name)
            after = before[1] if before and before[0] == epoch else -1
            fs_files = listed[name][1] if name in listed and listed[name][0] == epoch else self._of(name, epoch)
            out += [_Files(name, epoch, after, last, path) for low, high, path in fs_files if high > after and low <= last]
        return out

    def _of(self, name: str, epoch: int) -> list[tuple[int, int, str]]:
        """Files of an epoch that is no longer the present one; a batch that is run again reads what it read before."""
        fs, base = pafs.FileSystem.from_uri(self.root)
        found = fs.get_file_info(pafs.FileSelector(f"{base}/{name}/{epoch}", allow_not_found=True))
        return sorted((*map(int, x.base_name.removesuffix(".parquet").split("-")), x.path) for x in found if not x.base_name.startswith(("_", ".")))

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.root)
        with fs.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["cursor", "payload"]):
                own = batch.filter(pc.and_(pc.greater(batch["cursor"], partition.after), pc.less_equal(batch["cursor"], partition.last)))
                n = own.num_rows
                yield pa.RecordBatch.from_pydict({"source": pa.array([partition.source] * n, pa.string()), "epoch": pa.array([partition.epoch] * n, pa.int64()), "cursor": own["cursor"].cast(pa.int64()), "payload": own["payload"].cast(pa.string())})

    def commit(self, end: dict) -> None:
        pass


class CursorSource(DataSource):
    """``spark.readStream.format("cursor").load(root)``; the root is any folder that Arrow's file systems reach."""

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"])


def read_cursors(spark: SparkSession, root: str) -> DataFrame:
    """The stream of a feed's rows: source, epoch, cursor, payload."""
    spark.dataSource.register(CursorSource)
    return spark.readStream.format("cursor").load(root)


def last_cursors(rows: DataFrame) -> DataFrame:
    """source, epoch, cursor: the present epoch of each source in ``rows`` and its last cursor."""
    newest = rows.groupBy("source", "epoch").agg(F.max("cursor").alias("cursor"))
    return newest.groupBy("source").agg(F.max(F.struct("epoch", "cursor")).alias("x")).select("source", "x.epoch", "x.cursor")


def source_health(polls: DataFrame, sources: DataFrame) -> DataFrame:
    """Health of each source (source, enabled) from the log of polls (source, at, ok, error).

    ``disabled`` without being enabled, ``unknown`` before the first poll, ``healthy`` or ``degraded`` by the last one.
    Only the kind of the last failure is kept (the part before a colon), never its details.
    """
    last = polls.groupBy("source").agg(
        F.max("at").alias("last_checked_at"),
        F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success_at"),
        F.max(F.when(~F.col("ok"), F.col("at"))).alias("last_failure_at"),
        F.max_by("ok", F.struct("at", ~F.col("ok"))).alias("_ok"),
        F.max_by("error", F.struct(~F.col("ok"), "at")).alias("_error"),
        F.count(F.lit(1)).alias("polls"),
        F.count(F.when(~F.col("ok"), 1)).alias("failures"),
    )
    rows = sources.join(last, "source", "left")
    health = F.when(~F.col("enabled"), "disabled").when(F.col("last_checked_at").isNull(), "unknown").when(F.col("_ok"), "healthy").otherwise("degraded")
    error = F.when(~F.col("_ok"), F.substring_index("_error", ":", 1))
    counted = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("source", health.alias("health"), "last_checked_at", "last_success_at", "last_failure_at", error.alias("last_error"), counted("polls"), counted("failures"))


def void_retries(retries: DataFrame, cursors: DataFrame) -> DataFrame:
    """Retries (source, epoch, cursor, …) with ``outcome``: ``retry``, or ``identity_changed`` if their source has another epoch now."""
    now = cursors.select(F.col("source").alias("_s"), F.col("epoch").alias("_e"))
    rows = retries.join(now, F.col("source") == F.col("_s"), "left")
    return rows.withColumn("outcome", F.when(F.col("epoch") == F.coalesce("_e", "epoch"), "retry").otherwise("identity_changed")).drop("_s", "_e")
