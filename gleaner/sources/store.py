"""Reading and writing the item store.

The reference keeps one JSON array file rewritten in full. Here the store is a set of
snapshot folders: every save writes a new path (never the one being read), archives
are partitioned by day, and malformed input is quarantined instead of overwritten.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Landed item as written by a loader: the date stays text until B1 parses it.
LANDED_JSON_SCHEMA = ("ord bigint, source string, title string, link string, "
                      "creation_date string, input string")
CORRUPT = "_corrupt_record"


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of a folder (driver-side listing and renames)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_items_json(spark: SparkSession, path: str, schema: str = LANDED_JSON_SCHEMA,
                    multiline: bool = False) -> DataFrame:
    """A1: JSON items with a fixed schema (no inference). ``multiline=True`` reads files
    holding one JSON array (or one object) each; otherwise one object per line."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_items_safe(spark: SparkSession, path: str, schema: str = LANDED_JSON_SCHEMA,
                    multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """A2: (good rows, quarantined raw records). A missing path gives two empty frames;
    malformed records go to quarantine with their raw text and file, never silently
    dropped. Good rows carry ``source_file`` and ``file_pos``, which grows with the
    position in the file. A file holding one JSON array is parsed (and, if malformed,
    quarantined) as a whole; large inputs should be JSON lines, which are split."""
    full = f"{schema}, {CORRUPT} string"
    placed = f"{full}, source_file string, file_pos bigint"
    try:
        df = (spark.read.schema(full).option("multiLine", multiline)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path))
        # parse once and keep the parsed rows: a raw-file query whose pruned projection
        # is only the corrupt-record column (e.g. a count) is refused by Spark. The split's
        # start orders the parts of a file, the row number within the task the rest.
        meta = F.col("_metadata")
        df = (df.select(*df.columns, meta["file_path"].alias("source_file"),
                        (F.shiftleft(meta["file_block_start"].cast("bigint"), 20)
                         + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("file_pos"))
              .checkpoint(eager=True))
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "Path does not exist" not in str(exc):
            raise
        df = spark.createDataFrame([], placed)
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.where(F.col(CORRUPT).isNotNull()).select(
        CORRUPT, "source_file", *[c for c in df.columns if c not in (CORRUPT, "source_file", "file_pos")])
    return good, bad


# ------------------------------------------------------------------ versions of a table

def versions(spark: SparkSession, table_path: str) -> list[int]:
    """Finished versions: ``version=N`` folders with their commit marker."""
    fs, p = file_system(spark, table_path)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(int(n.split("=", 1)[1]) for n in names
                  if n.startswith("version=") and fs.exists(path(f"{table_path}/{n}/_SUCCESS")))


def latest_version(spark: SparkSession, table_path: str) -> int:
    """Highest finished version under a table path (0 when there is none)."""
    return max(versions(spark, table_path), default=0)


def read_latest(spark: SparkSession, table_path: str) -> DataFrame | None:
    v = latest_version(spark, table_path)
    return None if v == 0 else spark.read.parquet(f"{table_path}/version={v}")


def read_versions(spark: SparkSession, table_path: str, schema: str) -> DataFrame:
    """All finished versions of an append-only table together."""
    found = [f"{table_path}/version={v}" for v in versions(spark, table_path)]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def claim_version(spark: SparkSession, table_path: str) -> int:
    """The next version number, taken by creating its claim file, which only one of two
    concurrent runs can do."""
    fs, p = file_system(spark, table_path)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(f"{table_path}/_claims"))
    v = latest_version(spark, table_path) + 1
    while not fs.createNewFile(path(f"{table_path}/_claims/{v}")):
        v += 1
    return v


def write_version(df: DataFrame, table_path: str, version: int | None = None) -> str:
    v = claim_version(df.sparkSession, table_path) if version is None else version
    return save_snapshot(df, f"{table_path}/version={v}")


def save_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write the whole store to a new snapshot path (overwrite of that path only)."""
    # REBALANCE lets AQE size the output files (coalesce small, split large partitions)
    df.hint("rebalance").write.mode("overwrite").format(fmt).save(path)
    return path


def archive_by_day(df: DataFrame, path: str, date_col: str = "creation_date") -> str:
    """Archive partitioned by ``creation_day`` so later reads prune by date."""
    # rebalance by the partition column: few files per day, and AQE splits a day that
    # holds a large share of the rows instead of sending it to one task
    (df.withColumn("creation_day", F.date_format(F.col(date_col), "yyyy-MM-dd"))
       .hint("rebalance", "creation_day")
       .write.mode("overwrite").partitionBy("creation_day").parquet(path))
    return path


def read_archive(spark: SparkSession, path: str, since_day: str | None = None) -> DataFrame:
    """Read an archive; a ``since_day`` filter prunes partitions (PartitionFilters)."""
    df = spark.read.parquet(path)
    if since_day is not None:
        df = df.where(F.col("creation_day") >= since_day)
    return df


def export_bulletin(df: DataFrame, path: str) -> str:
    """Write the bulletin rows as JSON lines."""
    df.hint("rebalance").write.mode("overwrite").json(path)
    return path
