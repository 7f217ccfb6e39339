"""Structured Streaming versions of the incremental steps.

The reference loops forever over collection and evaluation rounds and saves after
each evaluation. As streams: arriving items are keyed and deduplicated across
micro-batches (S1), arriving evals keep a running per-item state (S2), and new items
are scored per micro-batch with an idempotent sink (S3). All runs here use
``trigger(availableNow=True)`` so a bounded input drives the query to completion;
the same code runs continuously with a processing-time trigger.

Sinks write one ``batch_id=N`` folder per micro-batch in overwrite mode, so a replayed
batch replaces its earlier output, or are Spark's file sink. What was seen before is
keyed state in RocksDB (S1, S2); S3 in one round compares a batch with the folders of the
other batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.collect import dedup_first_wins
from gleaner.operators.evaluate import (finish_weighted, recent_items, valid_response,
                                       weighted_score_col)
from gleaner.sources.store import file_system


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB (off-heap, spills to local disk, checkpointed to
    the query's checkpoint location) instead of executor heap maps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def _run(writer, name: str) -> list[dict]:
    """Run a stream to completion (availableNow); the progress of its micro-batches."""
    q = writer.queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return [json.loads(p.json) for p in q.recentProgress]


def _written_keys(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Keys that earlier micro-batches wrote (None before the first one)."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    done = [s.getPath().toString() for s in fs.listStatus(p)
            if s.getPath().getName().startswith("batch_id=") and s.getPath().getName() != f"batch_id={batch_id}"]
    return spark.read.schema("dedup_key string").parquet(*done) if done else None


def stream_collect(items: DataFrame, out_path: str, checkpoint: str) -> None:
    """Keep the first-arriving row per ``dedup_key`` across micro-batches; of the rows
    of one micro-batch the one with the smallest ``ord``.

    The state is an aggregate per key in RocksDB: the first row, and the time of the batch
    it came in. Rows are combined map-side before the shuffle, so a key that holds much of
    a batch is no hot key, and a batch emits the keys whose first batch it is; nothing
    written before is read again. Nothing expires, so no new item is lost however late it
    comes. The columns of ``items`` are what is kept per key: give the narrow ones (whole
    texts stay in the landed table and are joined back by ``ord``)."""
    use_rocksdb_state(items.sparkSession)
    others = [c for c in items.columns if c not in ("dedup_key", "ord")]
    # the clock of a micro-batch is one value, kept in its offset log, so a replay agrees
    keyed = items.where(F.col("dedup_key").isNotNull()).withColumn("_now", F.current_timestamp())
    first = keyed.groupBy("dedup_key").agg(F.min(F.struct("ord", *others)).alias("_row"), F.min("_now").alias("_since"))
    new = first.where(F.col("_since") == F.current_timestamp())

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(*[F.col("dedup_key") if c == "dedup_key" else F.col(f"_row.{c}") for c in items.columns]) \
            .write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    _run(new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .outputMode("update"), "stream_collect")


@dataclass
class StreamReport:
    """What a bounded-state stream did: rows dropped as too late, and per micro-batch the
    watermark and the rows held as state."""

    late_rows: int
    watermarks: list[str]
    state_rows: list[int]


def stream_collect_within(items: DataFrame, out_path: str, checkpoint: str, delay: str = "30 days",
                          event_time: str = "creation_date", spread: int = 8) -> StreamReport:
    """S1 with bounded state: one row per ``dedup_key`` among rows whose event times lie
    within ``delay``, kept in event time by ``dropDuplicatesWithinWatermark``.

    A key is remembered until the watermark (the greatest event time seen, less ``delay``)
    passes its own event time by ``delay``; then its state goes. Copies that come within
    the delay are dropped. Rows behind the watermark are too late to be told from copies:
    they are not written, but counted in the report. Rows without an event time are
    neither dated nor bounded and are left out by the caller's choice of ``items``.

    A first pass over (key, one of ``spread`` parts) drops the copies of a hot key in
    several tasks; the second sees at most ``spread`` rows of a key from a batch. The sink
    is Spark's file sink with its own log, so the output is exactly once and never read
    back. Which of a key's copies in one micro-batch is kept is not fixed; columns that
    follow from the key are."""
    use_rocksdb_state(items.sparkSession)
    dated = (items.where(F.col("dedup_key").isNotNull())
             .withColumn("_time", F.col(event_time).cast("timestamp"))
             .withColumn("_part", F.pmod(F.xxhash64("ord"), F.lit(spread)))
             .withWatermark("_time", delay))
    once = dated.dropDuplicatesWithinWatermark(["dedup_key", "_part"]).dropDuplicatesWithinWatermark(["dedup_key"])
    progress = _run(once.drop("_time", "_part").writeStream.format("parquet").option("path", out_path)
                    .option("checkpointLocation", checkpoint).outputMode("append"), "stream_collect_within")
    # the operators of a batch are listed from the sink back: the last one sees the input
    return StreamReport(
        late_rows=sum(p["stateOperators"][-1]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"]),
        watermarks=[p["eventTime"]["watermark"] for p in progress if "eventTime" in p],
        state_rows=[sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress])


def stream_load(loaded: DataFrame, out_path: str, checkpoint: str) -> list[dict]:
    """A3 as a stream: what a source format gives, failed parts included, appended once."""
    return _run(loaded.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
                .outputMode("append"), "stream_load")


def stream_eval_state(evals: DataFrame, out_path: str, checkpoint: str) -> None:
    """Running evaluation state per item. Update mode: each micro-batch emits only
    the keys it changed, written as one changelog folder per ``batch_id`` (overwrite, so
    a replayed batch replaces itself). ``latest_state`` reads the newest row per key,
    ``compact_state`` folds the changelog. Evals joined to a static side should be given
    a stored one, as it is read again for every batch. The exact median keeps a
    value->count map per key in the state store, whose partitions are the session's
    shuffle partitions when the stream first starts."""
    use_rocksdb_state(evals.sparkSession)
    sw, w = weighted_score_col(F.col("importance_score"), F.col("confidence_score"))
    state = evals.groupBy("dedup_key").agg(
        F.count(F.lit(1)).alias("num_evals"), sw.alias("_sw"), w.alias("_w"),
        F.median("confidence_score").alias("_med"),
        F.max_by("eval_date", "seq").alias("last_eval"))

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.select("dedup_key", "num_evals",
                      finish_weighted(F.col("_sw"), F.col("_w")).alias("weighted_score"),
                      F.col("_med").cast("int").alias("median_confidence"), "last_eval")
              .write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}"))

    _run(state.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .outputMode("update"), "stream_eval_state")


def latest_state(spark: SparkSession, out_path: str) -> DataFrame:
    """Current state from the changelog: per key, the row of the newest batch. A light
    ``max(batch_id)`` hash aggregate, then a semi join on the unique (key, batch) pair."""
    log = spark.read.parquet(out_path)
    newest = log.groupBy("dedup_key").agg(F.max("batch_id").alias("batch_id"))
    return log.join(newest, ["dedup_key", "batch_id"], "left_semi").drop("batch_id")


def compact_state(spark: SparkSession, out_path: str) -> int:
    """Fold the changelog of a stopped stream into its newest batch folder and drop the
    older ones; returns that batch id (-1 if there is none). The folded folder carries
    the id in its name until it has taken the newest one's place; a run that died in
    between is finished first, so no change is lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs, p = file_system(spark, out_path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    for n in names:
        if n.startswith("_folded-") and fs.exists(path(f"{out_path}/{n}/_SUCCESS")):
            target = f"batch_id={n.split('-', 1)[1]}"
            if target not in names and fs.rename(path(f"{out_path}/{n}"), path(f"{out_path}/{target}")):
                names.append(target)
    ids = sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("batch_id="))
    if not ids:
        return -1
    last, folded = f"{out_path}/batch_id={ids[-1]}", f"{out_path}/_folded-{ids[-1]}"
    latest_state(spark, out_path).write.mode("overwrite").parquet(folded)
    fs.delete(path(last), True)
    fs.rename(path(folded), path(last))
    for i in ids[:-1]:
        fs.delete(path(f"{out_path}/batch_id={i}"), True)
    return ids[-1]


def stream_evaluate(items: DataFrame, scorer: Callable[[DataFrame], DataFrame], out_path: str,
                    checkpoint: str, cfg=None, as_of=None, evals: DataFrame | None = None) -> None:
    """S3: score each micro-batch of new items and append the evals, one per key. With
    ``cfg`` and ``as_of`` only recent items (E1, per-source lookback) are scored. Items
    that have an eval already, in ``evals`` or from an earlier batch, are not queued
    again (E2); rows without a response are dropped."""
    if cfg is not None:
        items = recent_items(items, cfg, as_of)

    def write(batch: DataFrame, batch_id: int) -> None:
        todo = dedup_first_wins(batch, "ord")
        for done in (evals, _written_keys(batch.sparkSession, out_path, batch_id)):
            if done is not None:
                todo = todo.join(done.select("dedup_key"), "dedup_key", "left_anti")
        scored = scorer(todo).where(valid_response()).select(
            "dedup_key", "ord",
            F.col("response.importance_score").alias("importance_score"),
            F.col("response.confidence_score").alias("confidence_score"),
            F.col("response.summary").alias("summary"))
        scored.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    _run(items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint),
         "stream_evaluate")


def read_stream_table(spark: SparkSession, sf_dir: str, name: str, schema: str, max_files: int = 1) -> DataFrame:
    """A streaming read of one landed table; a file path is given as a glob because a
    streaming file source needs a directory-like path."""
    glob = f"{sf_dir.rstrip('/')}/{name[:-1]}[{name[-1]}].parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(glob)
