"""The corpus pipeline: five stages over the documents table, each calling one operator.

Each stage takes (spark, docs, sf_dir) and returns a frame; the driver stores it as
Parquet and reads it again as the next stage's docs. All stages but the last return the
columns of the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, langid, linededup, packing, simhash
from gleaner.llm.common import named_back, number_of, numbered, prepare, table, with_row_key, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (null texts, texts without a letter)."""
    prepare(spark)
    rows, names = numbered(docs)
    found = langid.identify(rows, *(number_of(names, c) for c in ("doc_id", "text", "lang")))
    return found.filter(found["lang_pred"] != langid.UNDETERMINED).select(named_back(names))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the lines of recurring templates out of the texts; every document stays. Where
    lines went, n_chars is counted again."""
    prepare(spark)
    rows, names = numbered(docs)
    text = number_of(names, "text")
    cut = linededup.drop_lines(rows, text)
    if "n_chars" in [n.lower() for n in names]:
        count = number_of(names, "n_chars")
        changed = F.when(F.col("n_dropped") > 0, F.length(text)).otherwise(F.col(count))
        cut = cut.withColumn(count, changed.cast(rows.schema[count].dataType))
    return cut.select(named_back(names))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that of the smallest id."""
    prepare(spark)
    rows, names = numbered(docs)
    rows = with_row_key(rows)
    found = simhash.near_duplicates(rows, number_of(names, "doc_id"), number_of(names, "text"), width=3, distance=3)
    gone = written(found.filter(~found["kept"]).select(found[simhash.ROW].alias("gone")), "near-copies")
    return rows.join(gone, rows[simhash.ROW] == gone["gone"], "left_anti").select(named_back(names))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of the benchmark."""
    prepare(spark)
    rows, names = numbered(docs)
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), text=number_of(names, "text"), width=10)
    return found.filter(~found["contaminated"]).select(named_back(names))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 2048 tokens: one row per piece."""
    prepare(spark)
    packed = packing.pack(docs, capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn models and parse templates, which SQL does not express; the tests hold
#: the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each stored in the shared checkpoint folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
