"""The corpus pipeline: five operators over ``documents``, each stage's rows written and read again by the next.

Order: language identification, line dedup, near-dedup, benchmark decontamination,
mixing to target weights. All stages but the last return the columns of documents.
Defined results: the rows of a stage are those that its predecessor kept; null and
empty texts are rejected by the first stage (no language), empty tables give empty
results, extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterworks.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from letterworks.llm.columns import text_key
from letterworks.session import prepare, stage, table

#: A document goes if its language is not known with at least this probability.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the model recognises."""
    prepare(spark)
    model = language_id.train(language_id.labelled_rows(docs))
    # The decision is made beside the text, so the text comes back unchanged and nothing is joined.
    doubled = docs.withColumn("_seen", F.col("text"))
    said = language_id.predict(doubled.select(F.struct(*docs.columns).alias("_row"), F.col("_seen").alias("text")), model)
    good = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return said.where(good).select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share; a document of nothing else goes."""
    prepare(spark)
    out = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.btrim("kept_text", F.lit(line_dedup.BLANK_CHARS)) == "")
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    changed = {"text": text, "n_chars": n_chars} if "n_chars" in docs.columns else {"text": text}
    return out.where(~emptied).withColumns(changed).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest id."""
    prepare(spark)
    rows = stage(near_dedup.near_classes(docs)[0], "pipeline-classes")
    stays = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first"))
    stays = stays.select(F.col("first.doc_id").alias("_id"), F.col("first.node").alias("_node"))
    alone = rows.where("root is null").select("doc_id", "node").distinct().select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    kept = stays.withColumn("_alone", F.lit(False)).unionByName(alone.withColumn("_alone", F.lit(True)))
    keyed = docs.withColumn("_key", text_key(F.col("text")))
    joined = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_node")))
    single = joined.where("not _alone").dropDuplicates(["_id", "_node"])
    return single.unionByName(joined.where("_alone")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark. Keys of texts stand for documents, so ids may be null or repeat."""
    prepare(spark)
    keyed = docs.select(text_key(F.col("text")).alias("doc_id"), "text")
    leaks = stage(decontamination.find_leaks(keyed, table(spark, sf_dir, "benchmark")), "pipeline-leaks")
    ids = leaks.select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(ids, text_key(docs["text"]) == F.col("_leak"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken so that the sources meet their targets."""
    prepare(spark)
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Models, sketches and approximate search are not SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
