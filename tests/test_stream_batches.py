"""Batches of streams over large parts."""

from letterworks.plans import stream_queries
from letterworks.streaming import incremental, segments

SF = "/root/testdata/sf0.001"
SMALL = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}


def test_parts_of_many_files_make_no_more_batches(spark, monkeypatch):
    """Two parts are a batch and its files occupy all cores, where two files were a batch and occupied two."""
    monkeypatch.setattr(incremental, "SPREAD_ROWS", 60, raising=False)
    seen = []
    append = segments.SegmentLog.append

    def counted(log, rows, batch, removed=None):
        seen.append((batch, rows.rdd.getNumPartitions()))
        return append(log, rows, batch, removed)

    monkeypatch.setattr(segments.SegmentLog, "append", counted)
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        got = stream_queries.o99_stream_projection(spark, SF)
        assert got.select("doc_id").distinct().count() == got.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    finally:
        for k in SMALL:
            spark.conf.unset(k)
    assert [batch for batch, _ in seen] == [0, 1, 2]
    assert min(n for _, n in seen) >= spark.sparkContext.defaultParallelism


def test_columns_that_are_not_asked_for_are_not_moved(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v string, wide string").schema
    log = segments.SegmentLog(spark, f"file://{tmp_path}/log", schema, "k")
    log.append(spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z")], schema), 0)
    log.append(spark.createDataFrame([(1, None, "y")], schema), 1, spark.createDataFrame([(3,)], "k int"))
    assert sorted(map(tuple, log.read().collect())) == [(1, None, "y"), (2, "b", None)]
    plan = log.read().select("k", "v")._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert len(read) == 2 and not any("wide" in line.split("ReadSchema")[1] for line in read)
