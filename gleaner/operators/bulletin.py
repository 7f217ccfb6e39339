"""Bulletin selection (F1-F6): important and recent items, ranked, top 3, grouped by
source, summaries and the subject line."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.config import Config, with_settings
from gleaner.operators.evaluate import is_recent, recency_prefilter
from gleaner.operators.ranking import rank_rows

# Placeholders used by the bulletin.
NO_SUMMARY = "No summary available."
UNTITLED = "Untitled"
UNKNOWN_SOURCE = "Unknown"
NO_LINK = "#"
SUBJECT = "{n} items in your weekly bulletin"      # setting: the subject text

def rank_order() -> list:
    """Bulletin order: score desc (stable), ties by arrival."""
    return [F.col("weighted_score").desc_nulls_last(), F.col("ord").asc()]


def _threshold(value: str | None) -> float | None:
    """The value of a plainly written number; None for anything else, of which the exact
    test alone knows the meaning."""
    text = (value or "").strip()
    return float(text) if re.fullmatch(r"[+-]?[0-9]{1,15}([.][0-9]{0,15})?", text, re.ASCII) else None


def importance_prefilter(cfg: Config) -> Column | None:
    """``weighted_score >= the lowest configured threshold``: a superset of the
    important items on a raw column, so the scan can skip row groups. None when some
    threshold is not positive (then unscored items can qualify) or not a plain number."""
    if "min_email_score" in cfg.env:
        values = [cfg.env["min_email_score"]]
    else:
        values = [cfg.global_value("min_email_score")]
        values += [v["min_email_score"] for v in cfg.sources.values() if "min_email_score" in v]
    found = [_threshold(v) for v in values]
    if None in found or min(found) <= 0:
        return None
    return F.col("weighted_score") >= F.lit(min(found))


def important_items(state: DataFrame, cfg: Config, config_col: str = "source") -> DataFrame:
    """F1: ``coalesce(weighted_score, 0) >= min_email_score`` of the item's source
    (settings are looked up by ``config_col``, the source's configuration name)."""
    pre = importance_prefilter(cfg)
    if pre is not None:
        state = state.where(pre)
    s = with_settings(state, cfg, {"min_email_score": "double"}, config_col)
    return s.where(is_important()).drop("min_email_score")


def is_important() -> Column:
    """The exact threshold test over an attached ``min_email_score`` column."""
    return F.coalesce(F.col("weighted_score"), F.lit(0)).cast("double") >= F.col("min_email_score")


def bulletin_items(state: DataFrame, cfg: Config, as_of: datetime, config_col: str = "source") -> DataFrame:
    """Important and recent items (unranked): both pushable pre-filters, then one
    settings join for both thresholds and the exact tests."""
    for pre in (importance_prefilter(cfg), recency_prefilter(cfg, as_of, config_col=config_col)):
        if pre is not None:
            state = state.where(pre)
    s = with_settings(state, cfg, {"min_email_score": "double", "lookback_days": "int"}, config_col)
    return s.where(is_important() & is_recent(as_of)).drop("min_email_score", "lookback_days")


def bulletin_ranked(state: DataFrame, cfg: Config, as_of: datetime, config_col: str = "source") -> DataFrame:
    """F2: the bulletin in rank order (score desc, ties by arrival ``ord``), with a
    1-based ``rank`` computed by range partitioning, not a single-task window."""
    # the raw input (whole texts) is not part of the bulletin: keep it out of the ranking
    items = bulletin_items(state, cfg, as_of, config_col)
    return rank_rows(items.drop("input"), rank_order(), rank_col="rank")


def bulletin_top(state: DataFrame, cfg: Config, as_of: datetime, n: int = 3,
               config_col: str = "source") -> DataFrame:
    """the first ``n`` bulletin items (``orderBy.limit`` -> TakeOrderedAndProject),
    score/confidence null -> 0 and text defaults for display."""
    top = bulletin_items(state, cfg, as_of, config_col).orderBy(*rank_order()).limit(n)
    w = Window.orderBy(*rank_order())   # over at most n rows
    return top.select(
        F.row_number().over(w).cast("bigint").alias("rank"), "dedup_key",
        F.coalesce("title", F.lit(UNTITLED)).alias("title"),
        F.coalesce("link", F.lit(NO_LINK)).alias("link"),
        F.coalesce("source", F.lit(UNKNOWN_SOURCE)).alias("source"),
        F.coalesce("weighted_score", F.lit(0)).alias("score"),
        F.coalesce("median_confidence", F.lit(0)).alias("confidence"))


def bulletin_by_source(ranked: DataFrame) -> DataFrame:
    """every bulletin item under its source group (the top items are included, as in
    the reference). Groups appear in order of their best item; items keep rank order.
    Positions come from ``rank_rows`` so a source holding most items is still split
    across tasks; the per-source summary is a plain aggregate."""
    src = F.coalesce(F.col("source"), F.lit(UNKNOWN_SOURCE))
    items = ranked.withColumn("group_source", src)
    groups = items.groupBy("group_source").agg(F.count(F.lit(1)).alias("n_items"),
                                               F.min("rank").alias("first_rank"))
    # one row per source present in the bulletin: bounded by the configured sources
    groups = groups.withColumn("group_order", F.row_number().over(Window.orderBy("first_rank")).cast("bigint"))
    within = rank_rows(items, [F.col("rank").asc()], partition_by=["group_source"], rank_col="source_rank")
    return within.join(groups.select("group_source", "group_order", "n_items"), "group_source")


def first_summary(evals: DataFrame) -> DataFrame:
    """first non-empty summary by append order, per item. ``min(seq)`` is a hash
    aggregate that combines map-side; the summary text is then picked by a semi join
    on the unique (dedup_key, seq) pair instead of being carried through the aggregate."""
    non_empty = evals.where(F.col("summary").isNotNull() & (F.col("summary") != ""))
    first = non_empty.groupBy("dedup_key").agg(F.min("seq").alias("seq"))
    return non_empty.join(first, ["dedup_key", "seq"], "left_semi").select("dedup_key", "summary")


def with_summary(items: DataFrame, evals: DataFrame) -> DataFrame:
    """Items with their first summary. Only the evals of the given items are
    aggregated (semi join first; AQE broadcasts the key side when it is small)."""
    needed = evals.join(items.select("dedup_key"), "dedup_key", "left_semi")
    return (items.join(first_summary(needed), "dedup_key", "left")
            .withColumn("summary", F.coalesce(F.col("summary"), F.lit(NO_SUMMARY))))


def bulletin_subject(chosen: DataFrame, subject: str = SUBJECT) -> DataFrame:
    """the subject text with the number of items; null when there is none."""
    n = F.count(F.lit(1))
    return chosen.agg(n.alias("n_items"), F.when(n > 0, F.replace(F.lit(subject), F.lit("{n}"), n.cast("string")))
                      .alias("subject"))
