"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. language ID: documents without a letter, or of no language the model knows with any confidence, go
2. SimHash near-dedup: of each group of documents linked by near copies (five-word shingles with a Jaccard
   similarity of 0.8 or more), the one with the smallest id stays
3. benchmark decontamination: documents that hold a test item go
4. mixing: each source is taken to its target weight, in blocks
5. token output: what was taken is packed into rows of token ids

Rows that share doc_id and text count as one document for stage 2; other rows that share a doc_id are
documents of their own (one keeps the id, the others get surrogates there).  Nulls: a null text is rejected by stage 1;
a null lang is filled with the prediction; a null doc_id gets a surrogate above usual ids for stage 2 alone, so a
document with an id stays rather than one without (a tie is decided by the surrogate, a hash of the text); a null
source is a source of its own.  Texts of any length are taken whole.  An empty table gives empty tables and no packed
row.  Columns beyond those of ``documents``, whatever their names, pass through stages 1 to 4.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from helixframe.llm import common, decontaminate, language, mixing, packing, simhash

#: Least probability of the predicted language.
LEAST_SCORE = 0.3
#: Near copies: five-word shingles, fingerprints of five 64-bit words.  Documents are candidates if some word differs in at
#: most 8 bits and all together in at most 63 of 320 (of those with a similarity of 0.8, one in a hundred differs in more); they
#: are near copies if their sets of shingles have a Jaccard similarity of 0.8 or more.
NEAR = (SHINGLE, TAU, LANES, TOTAL, ID, TEXT, CLOSE, SIMILARITY) = 5, 8, 5, 63, "doc_id", "text", 36, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")]
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))).select(*cols))
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])  # no clash with the columns added
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = language.predict(plain, model, at["text"]).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return rows.select(*[(F.coalesce(at[c], "lang_pred") if c == "lang" else F.col(at[c])).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # columns by number, so that no name clashes
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*at.values()).withColumn("id", F.col(at["doc_id"]).cast("long")).withColumn("hash", F.xxhash64(at["text"]))
    # ids with several texts: the text of least hash keeps the id, the others get surrogates above usual ids
    several = rows.groupBy("id").agg(F.min("hash").alias("least"), F.max("hash").alias("most"))
    several = common.cut(several.where("id is not null and least <> most").select("id", "least"))
    other = F.shiftright(F.xxhash64("id", "hash"), 2).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    key = F.when(F.col("least") != F.col("hash"), other).otherwise(F.coalesce("id", F.shiftright("hash", 2).bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 61))))
    keyed = common.join_bounded(rows, several, ["id"], "left").withColumn("doc_key", key).drop("id", "hash", "least")
    groups = simhash.near_duplicates(keyed.select(F.col("doc_key").alias(ID), F.col(at["text"]).alias(TEXT)), *NEAR)
    stay = common.cut(groups.where("doc_id = component_id").select(F.col("doc_id").alias("doc_key")).distinct())
    first = F.row_number().over(Window.partitionBy("doc_key").orderBy(at["text"]))
    kept = keyed.join(stay, "doc_key", "left_semi").withColumn("first", first).where("first = 1")
    return kept.select(*at.values()).toDF(*docs.columns)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_test_items),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: SQL can express neither the models nor the tokenizer; stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of all stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = common.shared_path(spark, f"stage{k}")
            out.write.parquet(path)
            out = spark.read.parquet(path)
        docs = out
    return docs
