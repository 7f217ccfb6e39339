"""Bindings from the driver's test tables to the pipeline's data model.

``documents`` become landed items (one per document; exact text copies collide on
the link and so on the dedup key), ``events`` become evaluations of those items
(``user_id`` plays the item's arrival ``ord``), and a fixed ``Config`` gives per-source
settings. The same bindings are written in SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.columns import add_days
from gleaner.operators.collect import dedup_first_wins, with_dedup_key
from gleaner.operators.config import Config
from gleaner.operators.evaluate import attach_state, eval_state

# Fixed clock for every query: never the wall clock.
AS_OF = datetime(2024, 1, 31, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
LINK_PREFIX = "https://example.org/"

BINDING_CONFIG = Config(
    base={"lookback_days": "7", "min_email_score": "40"},
    sources={
        "en": {"min_email_score": "50"},
        "fr": {"lookback_days": "14", "min_email_score": "45",
               "prompt_criteria": "Prefer French material with a clear argument."},
        "de": {"lookback_days": "0"},
        "es": {"lookback_days": "30"},
    },
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def landed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed item per document, keyed, with arrival ``ord`` = doc_id."""
    return landed_from_documents(table(spark, sf_dir, "documents"))


DOCUMENTS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                 "value double, props string")


def title_of_document() -> F.Column:
    """Whole fields only: the document's source and number."""
    return F.concat(F.col("source"), F.lit(" document "), F.col("doc_id").cast("string"))


def landed_from_documents(d: DataFrame) -> DataFrame:
    """Landed-item shape of a documents frame (batch or stream)."""
    items = d.select(
        F.col("doc_id").alias("ord"),
        F.col("lang").alias("source"),
        F.concat(F.lit(LINK_PREFIX), F.md5("text")).alias("link"),
        title_of_document().alias("title"),
        add_days(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("doc_id") % 30)
        .alias("creation_date"),
        F.to_json(F.struct(F.col("doc_id"), F.col("source").alias("src"), F.col("n_chars"),
                           F.col("text"))).alias("input"),
    )
    return with_dedup_key(items)


def landed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed items without their ``input``, hashed in one scan of the texts and kept
    in the shared checkpoint folder (a job while the query is built), so that items,
    evals, upserts and streams share it instead of hashing all texts again."""
    return landed_items(spark, sf_dir).drop("input").checkpoint(eager=True)


def key_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, dedup_key) of every landed item."""
    return landed_items(spark, sf_dir).select("ord", "dedup_key")


def items_narrow(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """The stored item set without ``input``: landed items deduplicated first-wins."""
    return dedup_first_wins(landed_keys(spark, sf_dir) if keys is None else keys, "ord")


def with_input(spark: SparkSession, sf_dir: str, narrow: DataFrame) -> DataFrame:
    """Items with their whole ``input``, read for the given rows by their unique ``ord``."""
    texts = landed_items(spark, sf_dir).select("ord", "input")
    return narrow.join(texts, "ord").select(*narrow.columns, "input")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored item set: landed items deduplicated first-wins by ``ord``."""
    return with_input(spark, sf_dir, items_narrow(spark, sf_dir))


def evals(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """Evaluations: each event is one appended eval of the item with ord = user_id."""
    return evals_from_events(table(spark, sf_dir, "events"), key_table(spark, sf_dir) if keys is None else keys)


def evals_from_events(e: DataFrame, landed: DataFrame) -> DataFrame:
    """Eval shape of an events frame (batch or stream) keyed through the landed items."""
    keys = landed.select(F.col("ord").alias("user_id"), "dedup_key")
    return e.join(keys, "user_id").select(
        "dedup_key",
        F.col("event_id").alias("seq"),
        F.dayofmonth("ts").alias("round"),
        F.col("event_type").alias("model"),
        F.sha2("event_type", 256).alias("prompt_hash"),
        F.col("ts").alias("eval_date"),
        F.floor(F.least(F.col("value"), F.lit(100.0))).cast("int").alias("importance_score"),
        F.get_json_object("props", "$.k").cast("int").alias("confidence_score"),
        F.when(F.col("event_type") == "error", F.lit(""))
         .when(F.col("event_type") == "signup", F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("event_type"), F.lit(" note "), F.col("props"))).alias("summary"),
    )


def store_and_evals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items with their evaluation state (E12 joined on the key), without ``input``, and
    the evals; both through one key table."""
    keys = landed_keys(spark, sf_dir)
    history = evals(spark, sf_dir, keys)
    return attach_state(items_narrow(spark, sf_dir, keys), eval_state(history)), history


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_evals(spark, sf_dir)[0]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model response texts synthesised from events, one shape per event type:
    view -> valid, click -> not JSON, purchase -> missing summary,
    signup -> importance as a quoted number, error -> confidence as a float."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    score = F.floor(F.least(F.col("value"), F.lit(100.0))).cast("bigint").cast("string")
    summary = F.concat(F.lit('{"summary": "s'), F.col("event_id").cast("string"), F.lit('", "evaluation": "e", '))
    text = (F.when(F.col("event_type") == "view",
                   F.concat(summary, F.lit('"importance_score": '), score, F.lit(', "confidence_score": '), k, F.lit("}")))
            .when(F.col("event_type") == "click", F.concat(F.lit("{bad json "), F.col("event_id").cast("string")))
            .when(F.col("event_type") == "purchase",
                  F.concat(F.lit('{"evaluation": "e", "importance_score": '), score,
                           F.lit(', "confidence_score": '), k, F.lit("}")))
            .when(F.col("event_type") == "signup",
                  F.concat(summary, F.lit('"importance_score": "'), score, F.lit('", "confidence_score": '), k, F.lit("}")))
            .otherwise(F.concat(summary, F.lit('"importance_score": '), score, F.lit(', "confidence_score": '),
                                k, F.lit(".5}"))))
    return e.select("event_id", "user_id", "ts", text.alias("response_text"))
