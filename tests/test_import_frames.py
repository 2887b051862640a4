"""Import reports on a library so large that moved ids are ids of the library too."""

from pathlib import Path

import duckdb
import pytest

import oracle
from letterworks import catalog

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["o87_reconcile_import", "o88_verify_import", "o88_import_verdict", "o88_import_coverage", "o82_readiness_checks"])
def test_moved_ids_that_the_library_has(spark, tmp_path, name):
    for t in oracle.TABLES:
        if t != "part":
            (tmp_path / f"{t}.parquet").symlink_to(SF / f"{t}.parquet")
    part = spark.read.parquet(str(SF / "part.parquet"))
    more = part.selectExpr("p_partkey + 1000000 AS p_partkey", "concat('other ', p_name) AS p_name", *[c for c in part.columns if c not in ("p_partkey", "p_name")])
    part.unionByName(more).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    (tmp_path / "part.parquet" / "_SUCCESS").unlink()
    con = _connect(tmp_path)
    assert oracle.compare(con, spark, catalog.queries()[name], catalog.oracles()[name], str(tmp_path)) > 0


def _connect(folder):
    con = duckdb.connect()
    for t in oracle.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if t == 'part' else ''}'")
    return con
