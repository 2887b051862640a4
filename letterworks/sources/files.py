"""Corpora, stored assets, manifests and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: First bytes of the accepted types, their names, and the largest file.
MAGIC = {"application/pdf": b"%PDF-", "image/jpeg": b"\xff\xd8\xff", "image/png": b"\x89PNG\r\n\x1a\n"}
MAX_BYTES = 100 * 1024 * 1024
ROLES = ("system", "user", "assistant", "tool")


def read_corpus(spark: SparkSession, sf_dir: str, name: str, schema: str, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """A table read with a schema, split into good rows and a quarantine with the first failed check."""
    df = spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")
    problem = F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(check)) for check, test in checks.items()])
    checked = df.withColumn("problem", problem)
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null")


def asset_inventory(spark: SparkSession, path: str) -> DataFrame:
    """storage_key, n_bytes, modified and sha256 of all files below a folder but unfinished ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = F.regexp_replace(F.col("path"), "^.*" + path.rstrip("/").replace(".", "[.]") + "/", "")
    rows = files.select(key.alias("storage_key"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    return rows.where(~F.col("storage_key").endswith(".part"))


def sniff_type(content: Column) -> Column:
    """The type that the first bytes tell, or null."""
    out = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        out = F.when(F.hex(F.substring(content, 1, len(magic))) == magic.hex().upper(), name).otherwise(out)
    return out


def safe_name(name: Column) -> Column:
    """The last part of a path with everything but letters, digits, dot, dash and underscore replaced."""
    last = F.element_at(F.split(name, r"[/\\]"), -1)
    clean = F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "_")
    return F.when(clean.isin("", ".", ".."), "document").otherwise(F.substring(clean, 1, 255))


def validate_upload(files: DataFrame) -> DataFrame:
    """name, declared, content -> found type, safe name and the reason of a refusal."""
    found = sniff_type(F.col("content"))
    reason = (
        F.when(F.length("content") == 0, "empty")
        .when(F.length("content") > MAX_BYTES, "too_large")
        .when(found.isNull(), "unsupported_type")
        .when(found != F.col("declared"), "type_mismatch")
    )
    return files.withColumns({"found": found, "safe_name": safe_name(F.col("name")), "reason": reason})


def read_library_export(spark: SparkSession, manifest: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """The documents of library manifests (JSON with a ``documents`` array), and the ids that repeat.

    Without ``multi_line`` each line is a manifest, and large exports are split.
    """
    raw = spark.read.option("multiLine", str(multi_line).lower()).json(manifest)
    docs = raw.select(F.explode("documents").alias("d")).select("d.*")
    repeats = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs, repeats


def write_export(tables: dict[str, DataFrame], dest: str) -> DataFrame:
    """Write each table as JSON lines; returns (name, rows) as the manifest, which is written too."""
    spark = next(iter(tables.values())).sparkSession
    counts = None
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{dest}/{name}")
        row = spark.read.text(f"{dest}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"))
        counts = row if counts is None else counts.unionByName(row)
    counts.write.mode("overwrite").json(f"{dest}/_manifest")
    return counts


def verify_export(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, outcome) by checksum: ok, mismatch, missing, unexpected, unsafe."""
    both = expected.select(F.col("name").alias("e"), F.col("sha256").alias("es")).join(actual.select(F.col("name").alias("a"), F.col("sha256").alias("as")), F.col("e") == F.col("a"), "full")
    unsafe = F.coalesce("e", "a").rlike(r"(^|/)\.\.(/|$)|^/")
    outcome = F.when(unsafe, "unsafe").when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("es") == F.col("as"), "ok").otherwise("mismatch")
    return both.select(F.coalesce("e", "a").alias("name"), outcome.alias("outcome"))


def retention_prune(records: DataFrame, keep: int, scope: str = "scope") -> DataFrame:
    """Records with ``keep``: the newest verified ones of each scope."""
    w = Window.partitionBy(scope, "verified").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return records.withColumn("keep", F.col("verified") & (F.row_number().over(w) <= keep))
