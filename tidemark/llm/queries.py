"""The ``opN_<name>`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_secret_scan(spark, sf_dir):
    from .secrets import digest, scan_secrets

    return digest(scan_secrets(_table(spark, sf_dir, "documents")))


def op3_syncmer_fingerprints(spark, sf_dir):
    from .syncmers import fingerprint_pairs

    return fingerprint_pairs(_table(spark, sf_dir, "documents"))


def op1_kd_shards(spark, sf_dir):
    from pyspark.sql import functions as F

    from .sharding import kd_shards

    placed = kd_shards(_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_url_trees(spark, sf_dir):
    from .urls import judge

    return judge(_table(spark, sf_dir, "pages"))


def op10_fair_mix(spark, sf_dir):
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_minhash_neardup(spark, sf_dir):
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op9_rans_tokens(spark, sf_dir):
    from .rans import token_files

    return token_files(_table(spark, sf_dir, "documents"))


def op5_language_spans(spark, sf_dir):
    from pyspark.sql import functions as F

    from .language import held_out, identify, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op6_decontaminate(spark, sf_dir):
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark, sf_dir):
    from .suffixes import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("removed")


QUERIES = {
    f.__name__: f
    for f in (
        op1_kd_shards,
        op2_secret_scan,
        op3_syncmer_fingerprints,
        op4_suffix_dedup,
        op5_language_spans,
        op6_decontaminate,
        op7_minhash_neardup,
        op8_url_trees,
        op9_rans_tokens,
        op10_fair_mix,
    )
}
ORACLE_SQL: dict[str, str] = {}
