"""Serving queries over the stored item set (F7-F11): stats, lookup, search, item
details and sorting — the data behind the web page, without a server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ranking import rank_rows

# Score bands of the stats panel.
HIGH_BAND = 70
MEDIUM_BAND = 30
EPOCH = "1970-01-01 00:00:00"


def score_bands(store: DataFrame) -> DataFrame:
    """total, sorted distinct sources, and high/medium/low counts (null -> 0).
    Counted per source first (a hash aggregate combined map-side), then the per-source
    rows - one per configured source - are folded into the single summary row."""
    sc = F.coalesce(F.col("weighted_score"), F.lit(0))
    per_source = store.groupBy(F.coalesce(F.col("source"), F.lit("Unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(sc >= HIGH_BAND).alias("h"),
        F.count_if((sc >= MEDIUM_BAND) & (sc < HIGH_BAND)).alias("m"),
        F.count_if(sc < MEDIUM_BAND).alias("l"))
    return per_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_items"),
        F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("high"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("medium"),
        F.coalesce(F.sum("l"), F.lit(0)).alias("low"))


def item_lookup(store: DataFrame, keys: DataFrame) -> DataFrame:
    """F8: the stored item for each requested key (semi join; absent keys give no row)."""
    return store.join(keys.select("dedup_key").distinct(), "dedup_key", "left_semi")


def search_items(store: DataFrame, term: str = "", source: str = "", min_score: int | None = None) -> DataFrame:
    """case-insensitive title substring (literal, no wildcards), exact source,
    score at least ``min_score``; an empty filter matches everything."""
    out = store
    if term:
        out = out.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lower(F.lit(term))))
    if source:
        out = out.where(F.col("source") == source)
    if min_score is not None:
        out = out.where(F.coalesce(F.col("weighted_score"), F.lit(0)) >= min_score)
    return out


def item_details(store: DataFrame, evals: DataFrame) -> DataFrame:
    """items with their evals, one row per eval with a 1-based ``eval_index`` in
    append order (``seq``, unique); items without evals keep one row with a null index.
    Only keys and positions are ranked; the evals' other fields are joined back."""
    places = rank_rows(evals.select("dedup_key", "seq"), [F.col("seq").asc()], partition_by=["dedup_key"], rank_col="eval_index")
    numbered = evals.join(places, ["dedup_key", "seq"])
    # inner join with the many-rows side on the left, so AQE can split a key holding a
    # large share of the evals; items without evals come from an anti join on the
    # distinct eval keys (a map-side combined set)
    with_evals = numbered.join(store, "dedup_key", "inner")
    without = store.join(numbered.select("dedup_key").distinct(), "dedup_key", "left_anti")
    return with_evals.unionByName(without, allowMissingColumns=True)


def sort_keys() -> dict[str, tuple[Column, bool]]:
    """Sort expression and default direction (True = descending) per sortable field.
    Choosing a field sorts it descending first, as on the results page; null counts as
    "" for text, 0 for numbers and the epoch for dates."""
    return {
    "score": (F.coalesce(F.col("weighted_score"), F.lit(0)), True),
    "source": (F.coalesce(F.lower(F.col("source")), F.lit("")), True),
    "title": (F.coalesce(F.lower(F.col("title")), F.lit("")), True),
    "num_evals": (F.coalesce(F.col("num_evals"), F.lit(0)), True),
    "confidence": (F.coalesce(F.col("median_confidence"), F.lit(0)), True),
    "last_eval": (F.coalesce(F.col("last_eval"), F.lit(EPOCH).cast("timestamp_ntz")), True),
    }


def sort_items(store: DataFrame, by: str = "score", descending: bool | None = None,
               with_items: bool = False) -> DataFrame:
    """the ``rank`` of every item when sorted by ``by`` (text case-folded, nulls as
    ""/0/epoch), ties by arrival. A full ordering of the store, so ``rank_rows`` rather
    than a single-task window. Only the key, ``ord`` and the sort value are ranked;
    ``with_items`` joins the item fields back on the key. The store may be filtered
    first (``search_items``): then the positions are those of the listing shown."""
    key, default_desc = sort_keys()[by]
    desc = default_desc if descending is None else descending
    narrow = store.select("dedup_key", "ord", key.alias("_sort"))
    order = [F.col("_sort").desc() if desc else F.col("_sort").asc(), F.col("ord").asc()]
    ranked = rank_rows(narrow, order, rank_col="rank").select("dedup_key", "rank")
    return store.join(ranked, "dedup_key") if with_items else ranked


def listing(store: DataFrame, term: str = "", source: str = "", min_score: int | None = None, by: str = "score",
            descending: bool | None = None) -> DataFrame:
    """F9 and F11 as the page shows them: the items that pass the filters, with their
    ``rank`` among these."""
    return sort_items(search_items(store, term, source, min_score), by, descending, with_items=True)


def sort_pages(store: DataFrame, fields: list[str]) -> DataFrame:
    """F11 for several fields at once, in their default directions (all descending):
    (sort_key, dedup_key, rank). One narrow ranking with the field as its group."""
    keys = sort_keys()
    texts = ("source", "title")

    def number(f: str) -> Column:
        if f in texts:
            return F.lit(None).cast("bigint")
        value = keys[f][0]
        return F.unix_micros(value.cast("timestamp")) if f == "last_eval" else value.cast("bigint")

    pages = [F.struct(F.lit(f).alias("sort_key"), number(f).alias("number"),
                      (keys[f][0] if f in texts else F.lit(None).cast("string")).alias("text")) for f in fields]
    rows = store.select("dedup_key", "ord", F.explode(F.array(*pages)).alias("page")).select(
        "dedup_key", "ord", "page.sort_key", "page.number", "page.text")
    order = [F.col("number").desc(), F.col("text").desc(), F.col("ord").asc()]
    return rank_rows(rows, order, partition_by=["sort_key"], rank_col="rank").select("sort_key", "dedup_key", "rank")
