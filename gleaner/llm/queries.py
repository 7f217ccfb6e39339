"""Registered queries opN_<name>: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (archive, decontaminate, embeddings, langid, linededup, mixing, negatives, packing, runs, simhash,
                         suffixes, toxicity, vantage)
from gleaner.llm.common import prepare, table
from gleaner.llm.oracles import ORACLES


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = archive.round_trip(table(spark, sf_dir, "pages"), least=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = linededup.drop_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=3)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    packed = packing.pack(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.score_texts(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = runs.collapse_runs(runs.periodic_tails(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), "embedding")
    return negatives.mine(rows, F.col("k") % 100 == 0, scale=256, positives=5, negatives=5, percent=80)


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return vantage.neighbours(table(spark, sf_dir, "embeddings"), F.col("k") % 20 == 0, k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_warc, op2_embedding_near_dedup, op3_line_dedup, op4_toxicity, op5_simhash, op6_best_fit_packing,
        op7_decontamination, op8_language_id, op9_suffix_array_dedup, op10_lm_scoring, op11_periodic_runs, op12_hard_negatives,
        op13_nearest_neighbours)
}

__all__ = ["ORACLES", "QUERIES"]
