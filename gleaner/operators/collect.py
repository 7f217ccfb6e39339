"""Collect stage: dedup key, first-wins dedup, upsert into the stored item set, counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.columns import dedup_key

# Data fields of an item; evaluation state lives in the evals table (see evaluate.py).
ITEM_FIELDS = ["source", "title", "link", "creation_date", "input"]


def with_dedup_key(items: DataFrame) -> DataFrame:
    """md5(source|link). Items without a link or source get a null key and are
    left for ``validate_items`` to quarantine."""
    return items.withColumn("dedup_key", dedup_key("source", "link"))


REQUIRED_TEXT = ["source", "title", "link"]


def validate_items(items: DataFrame) -> DataFrame:
    """A5: the loader contract. ``reject_reason`` is null for a good row, else the
    first missing or blank required field (``input`` may be any JSON and
    ``creation_date`` any text, but neither absent).
    Split with ``where(reject_reason IS NULL)`` / ``IS NOT NULL`` for quarantine."""
    reason = None
    for c in REQUIRED_TEXT:
        bad = F.col(c).isNull() | (F.trim(F.col(c)) == "")
        reason = F.when(bad, F.lit(f"missing_{c}")) if reason is None else reason.when(bad, F.lit(f"missing_{c}"))
    for c in ("creation_date", "input"):
        reason = reason.when(F.col(c).isNull(), F.lit(f"missing_{c}"))
    return items.withColumn("reject_reason", reason)


def dedup_first_wins(items: DataFrame, order_col: str = "ord") -> DataFrame:
    """Keep the first row per ``dedup_key`` by arrival order ``order_col``.

    Two light steps instead of carrying whole rows through an aggregate:
    ``min(order_col)`` per key is a codegen'd hash aggregate that combines map-side
    (a key holding a third of all rows sends one row per map task), and the winners
    are then picked by a left-semi join on ``(dedup_key, order_col)`` — a unique pair,
    so a hot key spreads over many reducers. Columns a caller does not use are pruned
    through the join, so heavy text is never shuffled for nothing.

    ``order_col`` is a position and so unique by contract; a row that was landed twice
    under one position stays twice. ``repeated_positions`` finds such rows, and
    ``dedup_landed_twice`` takes them along."""
    keyed = items.where(F.col("dedup_key").isNotNull())
    winners = keyed.groupBy("dedup_key").agg(F.min(order_col).alias(order_col))
    return keyed.join(winners, on=["dedup_key", order_col], how="left_semi")


def repeated_positions(items: DataFrame, order_col: str = "ord") -> DataFrame:
    """Positions that more than one row claims, with their number of rows: empty where the
    contract of ``dedup_first_wins`` holds."""
    return items.groupBy(order_col).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def dedup_landed_twice(items: DataFrame, order_col: str = "ord") -> DataFrame:
    """C2 where a delivery may be repeated: as ``dedup_first_wins``, and of the rows of one
    key and position exactly one is kept (the least by all fields, so always the same).
    The winners are combined map-side before they are shuffled."""
    won = dedup_first_wins(items, order_col)
    others = [c for c in won.columns if c not in ("dedup_key", order_col)]
    one = won.groupBy("dedup_key", order_col).agg(F.min(F.struct(*others)).alias("_row"))
    return one.select(*[F.col(c) if c in ("dedup_key", order_col) else F.col(f"_row.{c}") for c in won.columns])


def upsert_merge(existing: DataFrame, batch: DataFrame, collected_at: datetime,
                 data_fields: list[str] = ITEM_FIELDS) -> DataFrame:
    """Merge a deduplicated ``batch`` into the ``existing`` store by ``dedup_key``.

    Matched keys take every incoming data field (nulls too: presence decides, not
    ``coalesce``), keep ``first_collected`` and the evaluation state; new keys start
    with ``first_collected = last_collected = collected_at``; untouched keys are kept.
    Output order = batch order then untouched rows, carried as ``(merge_part, ord)``.
    The result is meant for a new snapshot, never over the one being read.

    Every batch row is in the result once, so it needs only the stored key and date (a
    narrow left join); stored rows outside the batch pass an anti join against the
    batch's keys, which AQE turns into a broadcast when their measured size is small -
    then no stored text is shuffled."""
    ts = F.lit(collected_at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    stored = existing.select(F.col("dedup_key").alias("_key"), F.col("first_collected").alias("_first"))
    known = F.col("_key").isNotNull()
    touched = batch.join(stored, F.col("dedup_key") == F.col("_key"), "left").select(
        "dedup_key", *data_fields, F.when(known, F.col("_first")).otherwise(ts).alias("first_collected"),
        ts.alias("last_collected"), F.when(known, F.lit("updated")).otherwise(F.lit("new")).alias("merge_status"),
        F.lit(0).alias("merge_part"), "ord")
    kept = existing.join(batch.select("dedup_key"), "dedup_key", "left_anti").select(
        "dedup_key", *data_fields, "first_collected", "last_collected", F.lit("kept").alias("merge_status"),
        F.lit(1).alias("merge_part"), "ord")
    return touched.unionByName(kept)


def collect_counts(landed: DataFrame, deduped: DataFrame, merged: DataFrame) -> DataFrame:
    """C4: duplicates removed, new, updated, total — one aggregate over the tagged union."""
    tagged = (landed.select(F.lit("landed").alias("_t"), F.lit(None).cast("string").alias("merge_status"))
              .unionByName(deduped.select(F.lit("unique").alias("_t"),
                                          F.lit(None).cast("string").alias("merge_status")))
              .unionByName(merged.select(F.lit("merged").alias("_t"), "merge_status")))
    t = F.col("_t")
    return tagged.agg(
        (F.count_if(t == "landed") - F.count_if(t == "unique")).alias("duplicates_removed"),
        F.count_if((t == "merged") & (F.col("merge_status") == "new")).alias("new_items"),
        F.count_if((t == "merged") & (F.col("merge_status") == "updated")).alias("updated_items"),
        F.count_if(t == "merged").alias("total_items"))
