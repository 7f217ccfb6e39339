"""Shipped scorer (E6): a keyword-interest scorer in built-in expressions.

No model call is shipped. A user plugs in their own scorer through
``evaluate.pandas_scorer`` (Arrow batches per task) or any ``DataFrame -> DataFrame``
function that adds a ``response`` struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.columns import WORD_PATTERN

# The shipped keyword lists and scale.
INTEREST_TERMS = ["the", "le", "der", "el", "research", "data"]
OTHER_TERMS = ["and", "et", "und", "y"]
NEUTRAL_SCORE = 50
RATE_SCALE = 1000          # hits per 1000 words
WORDS_PER_CONFIDENCE = 10  # one confidence point per 10 words, capped at 100


_SHIFT = 32                # hits of both lists are counted in one number


def keyword_response(text: Column, summary_prefix: str = "matched") -> Column:
    """Response struct from the whole ``text``: importance moves from 50 by interest
    minus other hits per 1000 words, clamped to 0..100; confidence grows with length.
    The words are taken once and counted in one fold; they and the counts are bound as
    elements of one-element arrays, which the optimiser does not copy into their uses."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), 0)

    def count(words: Column) -> Column:
        hits = F.aggregate(words, F.lit(0).cast("bigint"), lambda n, t: n + F.when(
            t.isin(*INTEREST_TERMS), F.lit(1).cast("bigint")).when(t.isin(*OTHER_TERMS), F.lit(1 << _SHIFT)).otherwise(F.lit(0).cast("bigint")))
        return F.struct(F.size(words).cast("bigint").alias("n"), hits.alias("hits"))

    def respond(c: Column) -> Column:
        n, hin, hout = c["n"], c["hits"].bitwiseAND(F.lit((1 << _SHIFT) - 1)), F.shiftright(c["hits"], _SHIFT)
        rate_in, rate_out = (F.floor((h * RATE_SCALE) / (n + 1)).cast("bigint") for h in (hin, hout))
        importance = F.least(F.lit(100), F.greatest(F.lit(0), F.lit(NEUTRAL_SCORE) + rate_in - rate_out))
        confidence = F.least(F.lit(100), F.floor(n / WORDS_PER_CONFIDENCE).cast("bigint"))
        return F.struct(
            F.concat(F.lit(f"{summary_prefix} "), hin.cast("string"), F.lit(" of "), n.cast("string"),
                     F.lit(" words")).alias("summary"),
            F.concat(F.lit("interest "), hin.cast("string"), F.lit(", other "), hout.cast("string")).alias("evaluation"),
            importance.cast("bigint").alias("importance_score"),
            confidence.cast("bigint").alias("confidence_score"),
            F.lit(None).cast("string").alias("scratchpad"),
            F.lit(None).cast("string").alias("followup"))

    return F.transform(F.transform(F.array(tokens), count), respond)[0]


def keyword_scorer(text_col: str | Column = None):
    """Scorer over the item's JSON ``input.text`` (falls back to the title)."""
    def scorer(df: DataFrame) -> DataFrame:
        if text_col is None:
            text = F.coalesce(F.get_json_object("input", "$.text"), F.col("title"))
        else:
            text = F.col(text_col) if isinstance(text_col, str) else text_col
        return df.withColumn("response", keyword_response(text))
    return scorer
