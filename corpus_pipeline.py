"""A training corpus from the documents table: five stages, each written as Parquet and read again by the next one.

All stages but the last return the columns of documents, whatever they are called. Every stage decides by row, with or
without doc_id; null texts are empty ones; texts of any length are taken whole; an empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm import common, decontaminate, minhash, packing, repeats, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Repeated rows share their fate; without labels all stay."""
    model = toxicity.fitted(docs, _table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


#: Rows without a doc_id of their own go by numbers from here on, made of a hash: behind all doc_ids in the order.
_FROM = 1 << 62


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies (five-word shingles, similarity 0.8): that of the smallest doc_id.

    Rows without doc_id, and those of a doc_id with several texts, are documents of their own by their texts, behind
    those with a doc_id. Rows with equal doc_id and text are one document; of them the one with the smallest hash stays.
    Texts without words are nobody's copies, but equal rows of them are still one document.
    """
    text, doc_id = F.xxhash64(F.coalesce("text", F.lit(""))), F.col("doc_id").cast("long")
    several = docs.select(doc_id.alias("doc_id"), text.alias("h")).filter("doc_id is not null").groupBy("doc_id")
    several = several.agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("m"))
    several = common.written(several.filter("low <> high").select("doc_id", "m"), "several")
    row, number = "_bramble_row", "_bramble_number"
    own = F.lit(_FROM) + F.xxhash64("doc_id", text).bitwiseAND(F.lit(_FROM - 1))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = minhash.beside(rows, several.withColumn("shared", F.lit(True)), "doc_id", "left")
    rows = rows.withColumn(number, F.when(F.col("doc_id").isNull() | F.col("shared").isNotNull(), own).otherwise(F.col("doc_id")))
    told = common.written(minhash.near_copies(rows.select(F.col(number).alias("doc_id"), "text")), "near-copies")
    gone = common.written(told.filter("not kept").select(F.col("doc_id").alias(number)).distinct(), "gone")
    again = common.written(told.groupBy(F.col("doc_id").alias(number)).agg(F.count("*").alias("m")).filter("m > 1").select(number), "again")
    left = rows.select(row, number).join(gone, number, "left_anti")
    once = left.join(again, number, "left_semi").groupBy(number).agg(F.min_by(row, F.xxhash64(row)).alias(row))
    out = left.join(again, number, "left_anti").unionByName(once)
    return out.select(*(F.col(row).getField(c).alias(c) for c in docs.columns))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 20 words and more that an earlier one has; n_chars follows the text.

    What stays of a text keeps its own lines and spacing. Rows without doc_id come before all others.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = repeats.without_repeats(docs, repeats.Repeats(cut_out=True), carried=others)
    new = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept_text")}
    if "n_chars" in others:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new[c].alias(c) if c in new else F.col("rest").getField(c).alias(c) for c in docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item's question and answer. Without items all stay."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens; an empty text is a piece of one."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("near_copies", one_of_near_copies),
    ("repeated_passages", without_repeated_passages),
    ("benchmark", without_benchmark),
    ("packing", in_sequences),
]

#: Trained networks and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds run() against plain versions of all
#: stages but the network's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents: what the last one returns, read from the files that it was written to."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
