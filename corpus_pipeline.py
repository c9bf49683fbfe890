"""A corpus pipeline of five stages over `documents`, each on all rows that the one before kept.

quality: rows that the ranking model scores under 0.3 go. near_duplicates: of each group linked by five-word shingles at
a similarity of 0.8, the row with the smallest id stays (one row of a group without ids). secrets: secrets are replaced in
the texts. mixing: rows are taken 0 to 2 times so that each source comes near its target. tokens: SentencePiece ids of
what was taken. All stages but the last return the columns of their input, extra ones included, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard, mixing, pieces, quality, secrets
from plumbline.llm.common import Shelf, bit_words, flagged, fresh


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with a score of at least 0.3, by a model of the labelled rows of docs.

    Null and empty texts are scored like others; null ids and ids without a label take no part in learning. Repeated rows
    are scored one by one. Without labels of both kinds nothing can be learnt: every row stays. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, lambda i: ~quality.held_out(i))
    scored = quality.score(docs, model, keep=True)
    return scored.filter(F.col(f"`{scored.columns[-1]}`") >= 0.3).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates.

    Null and empty texts and those without words are no duplicates of others, but of rows that repeat their id and text.
    Of a group the row with the smallest id stays; of a group without any id, the rows of one text. All texts of an id
    that stays do, since they are one node of the groups. Of wholly repeated ids and texts one row stays, whatever its
    other columns. Only rows that may go, or are repeated, are shuffled with their texts.
    """
    shelf = Shelf(spark)
    groups = shelf.put(jaccard.grouped(docs, words=5, percent=80), "groups")
    stays = F.when(F.col("component_id").isNull(), F.col("doc_id").isNull() & ((F.col("k1") == F.col("label")) | (F.col("n_shingles") == 0))).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    row_key = F.xxhash64("doc_id", "k1", "k2")
    decided = groups.groupBy("doc_id", "k1", "k2").agg(F.max(stays).alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1")
    i, k1, k2, stay, n, key, at, perhaps, *mine = fresh(docs.columns, "_id", "_k1", "_k2", "_stays", "_n", "_key", "_at", "_perhaps", "_mine1", "_mine2")
    decided = shelf.put(decided.withColumn(key, row_key).toDF(i, k1, k2, stay, n, key), "decided")
    words = shelf.put(bit_words(decided, key), "bits")
    shelf.keep(decided, words)
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({mine[0]: F.xxhash64(text), mine[1]: F.xxhash64(F.lit(1), text)})
    rows = flagged(rows.withColumn(at, F.xxhash64(F.col("doc_id").cast("long"), *mine)), at, words, perhaps)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.filter(~F.col(perhaps)).select(*columns)
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(mine[0]) == F.col(k1)) & (F.col(mine[1]) == F.col(k2))
    told = rows.filter(perhaps).join(decided, same, "left").filter(F.coalesce(stay, F.lit(True)))
    first = told.dropDuplicates(["doc_id", *mine])
    return once.unionByName(first.select(*columns))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with the secrets of its text replaced and n_chars, if there is such a column, that of the new text.

    Null texts stay null, texts without secrets stay as they are.
    """
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row 0 to 2 times. Null sources are a source, null and empty texts have size 0, repeated rows are decided one
    by one. If all texts are empty nothing is taken."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row; null texts count as empty ones, which have no tokens."""
    out = pieces.encode(docs, pieces.load())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]
#: SQL can express neither the model nor the cube method; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf = Shelf(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir), name)
        shelf.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
