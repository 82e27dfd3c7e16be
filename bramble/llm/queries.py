"""The registered queries of this package, one for each operator, and the SQL that some must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ctw, decontaminate, divergence, fixity, keyed_ids, minhash, oracles, packing, repeats, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(_table(spark, sf_dir, "documents"))


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergent(_table(spark, sf_dir, "documents"))


def op3_keyed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = keyed_ids.stored(_table(spark, sf_dir, "documents"))
    found = store.look_up(store.keys)
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(_table(spark, sf_dir, "documents"), minhash.NearCopies(words=4))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a replica of all pages against one in which some records are hurt by a rule. Records that only the
    hurt one has are no page's: page -1, 0 octets, no hash."""
    folder, held = fixity.replica(_table(spark, sf_dir, "pages"))
    other, files = fixity.damaged(folder, held)
    told = fixity.audited(fixity.trees(folder, held), fixity.trees(other, files)).select("file", "record_id", "fate")
    fate = F.when(F.col("fate") == "moved", "intact").otherwise(F.col("fate"))  # where files end is not for SQL to know
    out = told.join(held, ["file", "record_id"], "left")
    known = (F.coalesce(c, F.lit(v)).alias(c) for c, v in (("page_id", -1), ("octets", 0), ("record_sha256", "")))
    return out.select("record_id", *known, fate.alias("fate"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.scored(docs, toxicity.fitted(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.formatted(turns.unionByName(more)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ctw": op1_ctw,
    "op2_divergence": op2_divergence,
    "op3_keyed_ids": op3_keyed_ids,
    "op4_minhash": op4_minhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_fixity": op6_fixity,
    "op7_packing": op7_packing,
    "op8_repeats": op8_repeats,
    "op9_toxicity": op9_toxicity,
    "op10_chat": op10_chat,
}

ORACLES: dict[str, str] = {
    "op2_divergence": oracles.DIVERGENCE,
    "op4_minhash": oracles.NEAR_COPIES,
    "op6_fixity": oracles.FIXITY,
    "op8_repeats": oracles.REPEATS,
}
