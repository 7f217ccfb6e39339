"""Analysis series (G1-G3): the data behind the two charts (drawing is not built)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Chart limits.
MAX_ITEMS_SHOWN = 50
MAX_TITLE_CHARS = 50
PALETTE_SIZE = 10


def analysis_items(store: DataFrame, evals: DataFrame) -> DataFrame:
    """G1: scored items with their evals flattened to (prompt_hash, model, score,
    confidence), ascending by weighted score (ties by arrival)."""
    scored = store.where(F.col("weighted_score").isNotNull()).select(
        "dedup_key", "ord", "source", "title", "weighted_score")
    ev = evals.select("dedup_key", "seq", "prompt_hash", "model",
                      F.col("importance_score").alias("score"),
                      F.col("confidence_score").alias("confidence"))
    return scored.join(ev, "dedup_key")


def short_label(source: str = "source", title: str = "title") -> F.Column:
    t = F.col(title)
    short = F.when(F.length(t) > MAX_TITLE_CHARS, F.concat(F.substring(t, 1, MAX_TITLE_CHARS), F.lit("...")))
    return F.concat(F.col(source), F.lit(": "), F.coalesce(short, t))


def score_distribution(store: DataFrame, evals: DataFrame, n: int = MAX_ITEMS_SHOWN) -> DataFrame:
    """The ``n`` highest-scored items (tail of the ascending order), each with a
    histogram of its eval scores. Top-n first (TakeOrderedAndProject), then the join;
    the histogram is a (key, score) count, so a heavily evaluated item stays one
    aggregate row per distinct score instead of one giant list."""
    top = (store.where(F.col("weighted_score").isNotNull())
           .orderBy(F.col("weighted_score").desc(), F.col("ord").desc()).limit(n)
           .select("dedup_key", "ord", "weighted_score", short_label().alias("label")))
    # position from the bottom of the chart, over at most n rows
    top = top.withColumn("position", F.row_number().over(
        Window.orderBy(F.col("weighted_score").asc(), F.col("ord").asc())).cast("bigint"))
    hist = (evals.join(F.broadcast(top.select("dedup_key")), "dedup_key", "left_semi")
            .groupBy("dedup_key", F.col("importance_score").alias("score"))
            .agg(F.count(F.lit(1)).alias("n_evals")))
    return top.join(hist, "dedup_key")


def score_confidence_points(store: DataFrame, evals: DataFrame) -> DataFrame:
    """One point per eval (source, score, confidence) with the colour index of the
    source: order of first appearance in the ascending-score item list, mod 10."""
    scored = store.where(F.col("weighted_score").isNotNull())
    # lexicographic min of (score, ord) per source in two steps: a hash aggregate per
    # (source, score) collapses the items, the struct min then runs on that small set
    per_score = scored.groupBy("source", "weighted_score").agg(F.min("ord").alias("ord"))
    first_seen = per_score.groupBy("source").agg(
        F.min(F.struct(F.col("weighted_score"), F.col("ord"))).alias("_first"))
    # one row per source: bounded by the configured sources
    colours = first_seen.select(
        "source", ((F.row_number().over(Window.orderBy("_first")) - 1) % PALETTE_SIZE).cast("int")
        .alias("colour_index"))
    points = scored.select("dedup_key", "source").join(
        evals.select("dedup_key", "seq", F.col("importance_score").alias("score"),
                     F.col("confidence_score").alias("confidence")), "dedup_key")
    return points.join(colours, "source")   # AQE broadcasts it from measured size
