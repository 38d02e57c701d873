"""A training corpus from ``documents``: language ID, near-dedup, decontamination, mixing, token files.

Each stage takes what its predecessor kept, as ``(spark, docs, sf_dir)``; all but the last return
the columns of ``documents``.  A stage decides on rows, by a key of its own where ids are missing or
repeat, so that no document goes for its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, mixing, neardup, rans
from tidemark.llm.common import materialize, partitions

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language covers less of their letters than this are rejected.
LEAST_SCORE = 0.5
#: What a token worker may hold beside the other stages: bytes of remembered pieces, characters encoded at once.
MEMORY, SOME = 32 << 20, 2 << 20


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """With ``_key``, which no two rows share: the id where it is one, else the place in the order of ids (missing ones last)."""
    docs = _documents(docs)
    s = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if s["n"] == s["d"]:
        return docs.withColumn("_key", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text", "lang", "source")]
    placed = docs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(placed.withColumn("_key", F.monotonically_increasing_id()), "stage-keys")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (``und``) or without a main language go."""
    model = language.train(docs.select("doc_id", "text", "lang").where(~language.held_out(F.col("doc_id"))))
    rows = _keyed(docs)
    found = language.identify(rows, model, id_col="_key", spans=False)
    good = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(F.col("doc_id").alias("_good"))
    return _documents(rows.join(good, rows["_key"] == F.col("_good"), "left_semi"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the one with the smallest id stays."""
    rows = _keyed(docs)
    kept = neardup.near_duplicates(rows, id_col="_key", percent=80).where("kept").select(F.col("doc_id").alias("_kept"))
    return _documents(rows.join(kept, rows["_key"] == F.col("_kept"), "left_semi"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go."""
    return decontaminate.clean(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, as often as it takes them."""
    rows = _keyed(docs)
    taken = mixing.mix(rows.withColumn("doc_id", F.col("_key"))).where("passes > 0").select(F.col("doc_id").alias("_doc"), "passes")
    out = rows.join(taken, rows["_key"] == F.col("_doc"))
    return _documents(out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "passes"))))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as token ids in encoded blocks, read back: doc_id, start, n_tokens, ids_crc32."""
    return rans.token_files(docs, memory=MEMORY, some=SOME)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Token ids cannot be made in SQL.
ORACLE_SQL = None
