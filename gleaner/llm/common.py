"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import configure, ensure_checkpoint_dir, scratch_path

#: Name of the row key that operators add to rows they must find again.
ROW = "__row"
#: Arrow batches handed to Python hold at most this many text bytes (plus one text).
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on: those of the library, and Arrow batches bounded
    by bytes, so that long texts do not make batches large."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def worker_memory() -> dict:
    """State that a Python worker process keeps from task to task. Functions travel to the
    workers by value, so the globals of this package's modules do not last there."""
    return sys.modules.setdefault("_gleaner_worker", types.ModuleType("_gleaner_worker")).__dict__


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steady_splits(spark: SparkSession) -> None:
    """Let the splits of a scan follow the files alone. Unless a number is set, Spark sizes
    them by the cores that are registered at the moment, and a lost executor between two
    reads of one table would move rows to other splits."""
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def scans_files(df: DataFrame) -> bool:
    """Whether the frame is a scan of files with columns and filters only."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [re.match(r"[\s+:-]*(\w*)", line)[1] for line in plan.splitlines()]
    return all(n in ("Project", "Filter", "Relation") for n in nodes)


def with_row_key(df: DataFrame) -> DataFrame:
    """Add a unique row key that is the same at every reading of the frame, however many
    cores there are: the row's place in the scan's splits, which are held steady. A frame
    that is more than a scan of files is stored first and read from there, as its rows
    could come in another order the next time. Key once and pass the keyed frame on."""
    steady_splits(df.sparkSession)
    if not scans_files(df):
        df = written(df, "rows")
    return df.withColumn(ROW, F.monotonically_increasing_id())


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with its columns named c0, c1, ... by place, which no name that an operator
    adds can meet, and the names they had."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def number_of(names: list[str], name: str) -> str:
    """The numbered name of a column (the first of that name, in any case)."""
    return f"c{[n.lower() for n in names].index(name.lower())}"


def named_back(names: list[str], without: Iterable[str] = ()) -> list:
    """Columns of a numbered frame under their former names, but those in ``without``."""
    gone = {n.lower() for n in without}
    return [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in gone]


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back.

    Cuts lineage, survives lost executors, keeps columns prunable, and gives the
    optimiser a known size, so a join broadcasts it only below Spark's own bound."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; removed once nothing refers to it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def smallest_hashes(df: DataFrame, column: str, rows: int, total: int) -> DataFrame:
    """About the ``rows`` to twice as many rows of smallest hash, by a threshold instead of
    a sort: a sorted limit would send that many rows of every partition to one place. A
    sorted limit may follow, over a bounded number of rows."""
    share = min(1.0, 2 * rows / max(1, total))
    return df.filter(F.col(column) / F.lit(2.0 ** 64) + 0.5 <= share)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str,
           limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text column of each holds about ``limit`` bytes."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch[text]), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a link table: one row (node, label) per node that has a
    link to another node; label is the smallest node reachable.

    Each round hooks every node to its smallest neighbour (a map-side combined minimum,
    so a hub is no hot key), shortens the pointers by joins against the stored pointer
    table until they stop moving, and contracts the links. At least half of the linked
    nodes vanish per round. Nothing is collected but counts."""
    links = checkpointed(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
                         .filter("a <> b").distinct())
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = checkpointed(both.groupBy(F.col("a").alias("node"))
                            .agg(F.min("b").alias("low"))
                            .select("node", F.least("node", "low").alias("up")))
        while True:
            step = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            moved = checkpointed(hook.join(step, "up", "left")
                                 .select("node", F.coalesce("top", "up").alias("up"),
                                         (F.col("top") < F.col("up")).alias("moved")))
            hook = moved.select("node", "up")
            if moved.filter("moved").isEmpty():
                break
        if labels is None:
            labels = hook.select("node", F.col("up").alias("label"))
        else:
            step = hook.select(F.col("node").alias("label"), "up")
            labels = checkpointed(labels.join(step, "label", "left")
                                  .select("node", F.coalesce("up", "label").alias("label")))
        left = hook.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        links = checkpointed(links.join(left, "a").join(right, "b")
                             .filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
                             .distinct())
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
