"""Per-source shaping over landed raw tables.

The network fetching of the six source kinds is not built; their data work is, as
joins, filters, windows and aggregates over landed raw DataFrames that carry the raw
field names (see FIXTURES.md for the shapes). Each function is ``DataFrame ->
DataFrame``.
"""

from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.columns import (collapse_ws, from_epoch_millis_to_second,
                                       from_epoch_seconds, parse_iso, url_tail, word_count)
from gleaner.functions.html import extract_main_content, plain_text
from gleaner.operators.ranking import rank_rows

# Title and text defaults of the shapers.
UNKNOWN_AUTHOR = "Unknown"
UNKNOWN_TITLE = "Unknown Title"
NO_DESCRIPTION = "No description"
IMAGE_PLACEHOLDER = "[image]"


def _ts(value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


# ------------------------------------------------------------------ B1 dates

def parse_item_date(text: str | Column) -> Column:
    """Any of the landed date encodings to a UTC TIMESTAMP_NTZ: ISO with ``Z``, with an
    offset, with fractional seconds, naive (read as UTC); all-digit text of eight digits
    is an ISO basic date, otherwise epoch seconds, or epoch milliseconds (floored to the
    second) from 13 digits on. Unparsable text and instants beyond year 9999 give null."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    digits = t.rlike(r"^[0-9]+$")
    return (F.when(digits & (F.length(t) == 8), F.try_to_timestamp(t, F.lit("yyyyMMdd")).cast("timestamp_ntz"))
             .when(digits & (F.length(t) >= 13), from_epoch_millis_to_second(t))
             .when(digits, from_epoch_seconds(t))
             .otherwise(parse_iso(t)))


# ------------------------------------------------------------------ B2-B5 papers

def newest_per_category(papers: DataFrame, k: int, cutoff: datetime) -> DataFrame:
    """B2: per category the newest ``k`` papers published at or after ``cutoff``.
    ``row_number() <= k`` over a category window plans a WindowGroupLimit, which also
    limits each map partition to k rows per category before the shuffle."""
    w = Window.partitionBy("category").orderBy(F.col("published").desc(), F.col("id").asc())
    return (papers.where(F.col("published") >= _ts(cutoff))
            .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k))


def first_category(papers: DataFrame, categories: list[str]) -> DataFrame:
    """One row per paper id; ``primary_category`` is the first category (in the
    configured list order) the paper was listed under."""
    listed = F.array(*[F.lit(c) for c in categories])
    order = F.array_position(listed, F.col("category"))
    # min of an integer position is a codegen'd hash aggregate; the name is looked up after
    return (papers.where(order > 0).groupBy("id").agg(F.min(order).alias("_first"))
            .select("id", F.element_at(listed, F.col("_first").cast("int")).alias("primary_category")))


def normalize_papers(papers: DataFrame) -> DataFrame:
    """Whitespace-collapsed title/abstract with defaults, id = last ``/`` part,
    distinct sorted author set, main author else the joined set."""
    authors = F.array_sort(F.array_distinct(F.array_compact(F.concat(
        F.array(F.col("author")), F.coalesce(F.transform("authors", lambda a: a["name"]),
                                             F.array().cast("array<string>"))))))
    main = F.coalesce(F.col("author"), F.when(F.size(authors) > 0, F.array_join(authors, ",")),
                      F.lit(UNKNOWN_AUTHOR))
    return papers.select(
        F.coalesce(url_tail("id"), F.lit("")).alias("paper_id"),
        F.coalesce(collapse_ws("title"), F.lit(UNKNOWN_TITLE)).alias("title"),
        F.coalesce(collapse_ws("summary"), F.lit("")).alias("abstract"),
        authors.alias("all_authors"), main.alias("author"),
        F.coalesce(F.col("link"), F.col("id")).alias("url"), "published")


def newest_first(df: DataFrame, date_col: str, key_col: str) -> DataFrame:
    """Every row with its position newest first (real timestamps, not text;
    ties by key)."""
    return rank_rows(df, [F.col(date_col).desc(), F.col(key_col).asc()], rank_col="rank")


# ------------------------------------------------------------------ B6-B10 feeds

def unread_recent(rss: DataFrame, cutoff: datetime) -> DataFrame:
    """Unread items created strictly after ``cutoff`` (epoch seconds)."""
    return rss.where((from_epoch_seconds("created_on_time") > _ts(cutoff)) & (F.col("is_read") == 0))


def short_content_fallback(feed: DataFrame, pages: DataFrame, min_words: int = 50) -> DataFrame:
    """Feed text shorter than ``min_words`` words with a URL is replaced by the
    page's main content when that has more words. A blank URL counts as none. Word
    counts are computed first, so only short rows take part in the join with the landed
    pages; of pages landed several times under one URL the longest text counts."""
    f = feed.withColumn("text", plain_text("html")).withColumn("n_words", word_count("text"))
    is_short = (F.col("n_words") < min_words) & (F.coalesce(F.trim("url"), F.lit("")) != "")
    short = f.where(is_short)
    # extract main content only for pages some short item points to (the cheap word
    # count decides before the costly extraction, as the reference decides before fetching)
    wanted = pages.select("url", "html").join(short.select("url").distinct(), "url", "left_semi")
    full = (extract_main_content(wanted, "html", "_full")
            .select(F.col("url").alias("_url"), "_full")
            .groupBy("_url").agg(F.max(F.struct(word_count("_full").alias("_full_words"), "_full")).alias("_page"))
            .select("_url", "_page.*"))
    joined = short.join(full, short["url"] == full["_url"], "left")
    use_full = F.coalesce(F.col("_full_words") > F.col("n_words"), F.lit(False))
    replaced = joined.select(
        *[c for c in f.columns if c not in ("text", "n_words")],
        F.when(use_full, F.col("_full")).otherwise(F.col("text")).alias("text"),
        F.when(use_full, F.col("_full_words")).otherwise(F.col("n_words")).alias("n_words"),
        F.when(use_full, F.lit("full")).otherwise(F.lit("short")).alias("content_from"))
    kept = (f.where(~F.coalesce(is_short, F.lit(False)))
            .withColumn("content_from", F.lit("short")))
    return replaced.unionByName(kept)


# ------------------------------------------------------------------ B11-B14 comments

def liked_recent_comments(comments: DataFrame, min_likes: int, cutoff: datetime,
                          max_comments: int | None = None) -> DataFrame:
    """Likes >= min_likes and created at or after cutoff. ``max_comments`` (a remote
    query's budget; None = all) keeps that many, the lowest ids first."""
    kept = comments.where((F.col("likes") >= min_likes) & (F.col("created") >= _ts(cutoff)))
    return kept if max_comments is None else kept.orderBy("id").limit(max_comments)


def long_comments(comments: DataFrame, min_chars: int = 500) -> DataFrame:
    """Keep comments whose cleaned text is longer than ``min_chars`` characters."""
    return comments.where(F.length("content") > min_chars)


def comment_links(comments: DataFrame, markets: DataFrame) -> DataFrame:
    """``market url + '#' + comment id``; one equi-join on the market id (AQE
    broadcasts the market side when its measured size is small)."""
    return comments.join(markets, comments["contractId"] == markets["market_id"]).withColumn(
        "link", F.concat(F.col("market_url"), F.lit("#"), F.col("id").cast("string")))


# ------------------------------------------------------------------ B15-B17 projects, posts

def attach_comments(projects: DataFrame, comments: DataFrame) -> DataFrame:
    """Every project with its comments as ``"{name} says: {content}"``, oldest
    first, one row per (project, comment) with a 1-based ``comment_index``; projects
    without comments keep one row with a null index. Long form instead of one array
    per project, so a project with a huge thread is not one row in one task."""
    c = comments.select(F.col("slug").alias("_slug"), "created_at", "seq",
                        F.concat(F.col("full_name"), F.lit(" says: "), F.col("content")).alias("comment"))
    numbered = rank_rows(c, [F.col("created_at").asc(), F.col("seq").asc()], partition_by=["_slug"],
                         rank_col="comment_index")
    # many comments per project sit on the left of an inner join (AQE can split a hot
    # project); projects without comments come from an anti join on the distinct slugs
    with_comments = numbered.join(projects, numbered["_slug"] == projects["slug"], "inner").drop("_slug")
    without = projects.join(numbered.select(F.col("_slug").alias("slug")).distinct(), "slug", "left_anti")
    return with_comments.unionByName(without, allowMissingColumns=True)


def created_after(df: DataFrame, date_col: str, cutoff: datetime) -> DataFrame:
    """Strictly newer than the cutoff."""
    return df.where(F.col(date_col) > _ts(cutoff))


def shape_posts(posts: DataFrame, cutoff: datetime, min_votes: int) -> DataFrame:
    """Recent posts with enough votes, seven fields, text defaults."""
    votes = F.coalesce(F.col("votesCount"), F.lit(0))
    return (posts.where((F.col("createdAt") > _ts(cutoff)) & (votes >= min_votes))
            .select("id", "name", F.coalesce("tagline", F.lit("")).alias("tagline"),
                    F.coalesce("description", F.lit("")).alias("description"), "url",
                    votes.alias("votes_count"), F.col("createdAt").alias("created_at")))


# ------------------------------------------------------------------ B18-B22 repos

def drop_starred(repos: DataFrame, starred: DataFrame) -> DataFrame:
    """Repositories not starred yet (anti join on full_name)."""
    return repos.join(starred.select("full_name"), "full_name", "left_anti")


def trending(repos: DataFrame, cutoff: datetime, min_stars: int, n: int = 50) -> DataFrame:
    """Repositories created or pushed since the cutoff with enough stars, top ``n``
    by stars."""
    order = [F.col("stars").desc(), F.col("full_name").asc()]
    fresh = (F.col("created") > _ts(cutoff)) | (F.col("pushed") > _ts(cutoff))
    top = (repos.where(fresh & (F.col("stars") >= min_stars))
           .orderBy(*order).limit(n))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def following_activity(events: DataFrame, following: DataFrame, repos: DataFrame,
                       cutoff: datetime, n_users: int | None = None,
                       types: tuple[str, ...] = ("WatchEvent", "ForkEvent")) -> DataFrame:
    """star/fork events since ``cutoff`` of the followed users (``n_users``: of the
    first ones only; None = all), joined to repository details."""
    users = following if n_users is None else following.orderBy("follow_pos").limit(n_users)
    ev = (events.where(F.col("type").isin(*types) & (F.col("created_at") >= _ts(cutoff)))
          .join(users.select("login"), "login", "left_semi"))
    return ev.join(repos, ev["repo_name"] == repos["full_name"])


_POS_BITS = 40   # (list_ord, pos) packed as list_ord << 40 | pos; positions stay below 2^40


def combine_repos(lists: DataFrame, max_repos: int | None = None) -> DataFrame:
    """Union of ordered repo lists keyed by full_name; a later occurrence
    replaces the value but the key keeps its first position; the first ``max_repos``
    (None = all) with their rank. ``lists`` carries (list_ord, pos, full_name, value...).

    First and last positions are one packed BIGINT each, so a hash aggregate finds
    them; the keys are ranked on these alone, and the values joined back on the unique
    (key, last position) pair."""
    value_cols = [c for c in lists.columns if c not in ("list_ord", "pos", "full_name")]
    packed = F.shiftleft(F.col("list_ord").cast("bigint"), _POS_BITS) + F.col("pos").cast("bigint")
    keyed = lists.withColumn("_k", packed)
    spans = keyed.groupBy("full_name").agg(F.min("_k").alias("_first"), F.max("_k").alias("_last"))
    kept = spans if max_repos is None else spans.orderBy("_first").limit(max_repos)
    top = rank_rows(kept.select(F.col("full_name").alias("_fn"), "_first", F.col("_last").alias("_at")),
                    [F.col("_first").asc()], rank_col="rank")
    values = keyed.join(top, (F.col("full_name") == F.col("_fn")) & (F.col("_k") == F.col("_at")))
    return values.select(
        "full_name", F.shiftright("_first", _POS_BITS).cast("int").alias("first_list"),
        F.col("_first").bitwiseAND(F.lit((1 << _POS_BITS) - 1)).alias("first_pos"),
        *value_cols, "rank")


def attach_readme(repos: DataFrame, readmes: DataFrame) -> DataFrame:
    """Left join of base64 READMEs decoded as UTF-8; undecodable -> null.
    Characters outside the base64 alphabet (line breaks etc.) are discarded before
    decoding, as a lenient decoder does."""
    lenient = F.try_to_binary(F.regexp_replace("content", r"[^A-Za-z0-9+/=]", ""), F.lit("base64"))
    raw = F.coalesce(F.try_to_binary(F.col("content"), F.lit("base64")), lenient)  # clean only on failure
    decoded = readmes.select(
        F.col("full_name").alias("_fn"),
        F.try_validate_utf8(raw.cast("string")).alias("readme_content"))
    return repos.join(decoded, repos["full_name"] == decoded["_fn"], "left").drop("_fn")


# ------------------------------------------------------------------ B12 rich text

def _flatten_tree(tree) -> str:
    """Text of a rich-text tree: mentions give their label, images their alt text
    (or a placeholder), text nodes their text; children in document order. An explicit
    stack serves trees of any depth."""
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(reversed(node))
        if not isinstance(node, dict):
            continue
        kind, attrs = node.get("type"), node.get("attrs")
        attrs = attrs if isinstance(attrs, dict) else {}
        if kind in ("mention", "contract-mention") and "attrs" in node:
            out.append(str(attrs.get("label", "") or ""))
        elif kind == "image":
            out.append(str(attrs.get("alt", "") or "") or IMAGE_PLACEHOLDER)
        elif kind == "text":
            out.append(str(node.get("text", "") or ""))
        else:
            stack.append(node.get("content", []))
    return "".join(out)


def flatten_rich_text(col: str | Column) -> Column:
    """JSON rich-text tree to plain text. The recursive walk has no built-in
    expression, so it runs as an Arrow-batched pandas UDF (one Python call per batch)."""
    @F.pandas_udf("string")
    def _flatten(trees: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            try:
                return _flatten_tree(json.loads(s))
            except (ValueError, RecursionError):     # not JSON, or nested beyond the parser
                return None
        return trees.map(one)

    return _flatten(F.col(col) if isinstance(col, str) else col)


#: A node's scalar as the text it shows: nothing for what counts as empty.
_SHOWN = """coalesce(CASE WHEN schema_of_variant({v}) = 'STRING' THEN variant_get({v}, '$', 'string')
    WHEN try_variant_get({v}, '$', 'string') IN ('0', 'false') THEN ''
    WHEN try_variant_get({v}, '$', 'string') = 'true' THEN 'True'
    ELSE try_variant_get({v}, '$', 'string') END, '')"""

#: Nesting that a JSON text can have; the walk ends with the deepest tree, long before.
_DEEPEST = 1000


def flatten_rich_text_walk(df: DataFrame, key: str, col: str) -> DataFrame:
    """B12 in built-in expressions, for trees that are better spread than walked one by one:
    (key, flat) of every row; ``key`` is unique. A recursive query opens one level of
    all trees at a time (``variant_explode``); a node's path of child numbers is its place
    in the document, by which the shown texts of a tree are put together. The work of a
    level is spread over tasks, and no Python worker takes part. Text that is no JSON
    gives null, as does a null."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")          # trees of any number and size
    trees = df.select(F.col(key).alias("id"), F.try_parse_json(F.col(col)).alias("tree"))
    kind, attrs, content = "try_variant_get(node, '$.type', 'string')", "variant_get(node, '$.attrs', 'variant')", \
        "variant_get(node, '$.content', 'variant')"
    leaf = f"({kind} IN ('image', 'text') OR ({kind} IN ('mention', 'contract-mention') AND {attrs} IS NOT NULL))"
    walked = spark.sql(f"""
        WITH RECURSIVE walk(id, path, node) MAX RECURSION LEVEL {_DEEPEST} AS (
          SELECT id, CAST(array() AS array<int>), tree FROM {{trees}} WHERE tree IS NOT NULL
          UNION ALL
          SELECT id, concat(path, array(c.pos)), c.value
          FROM walk, LATERAL variant_explode(
            CASE WHEN schema_of_variant(node) LIKE 'ARRAY%' THEN node
                 WHEN schema_of_variant(node) NOT LIKE 'OBJECT%' OR {leaf} THEN NULL
                 WHEN schema_of_variant({content}) LIKE 'ARRAY%' THEN {content}
                 WHEN schema_of_variant({content}) LIKE 'OBJECT%' THEN try_parse_json('[' || to_json({content}) || ']')
            END) c)
        SELECT id, path,
               CASE WHEN {kind} = 'text' THEN {_SHOWN.format(v="variant_get(node, '$.text', 'variant')")}
                    WHEN {kind} = 'image' THEN coalesce(nullif({_SHOWN.format(v="try_variant_get(node, '$.attrs.alt', 'variant')")}, ''),
                                                        '{IMAGE_PLACEHOLDER}')
                    ELSE {_SHOWN.format(v="try_variant_get(node, '$.attrs.label', 'variant')")} END AS shown
        FROM walk WHERE schema_of_variant(node) LIKE 'OBJECT%' AND {leaf}""", trees=trees)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("path", "shown"))), lambda x: x["shown"])
    flat = walked.groupBy("id").agg(F.array_join(texts, "").alias("flat"))
    read = F.when(F.col("tree").isNotNull(), F.coalesce("flat", F.lit("")))
    return trees.join(flat, "id", "left").select(F.col("id").alias(key), read.alias("flat"))


# ------------------------------------------------------------------ B23 canonical items

def title_by(title: Column, author: Column) -> Column:
    """Papers, feed items, grant projects: ``"{title} by {author}"``."""
    return F.concat(title, F.lit(" by "), author)


def comment_title(user: Column, question: Column) -> Column:
    return F.concat(F.lit("Comment by "), user, F.lit(" on "), question)


def repo_title(name: Column, description: Column) -> Column:
    """A missing or null description uses the default text (not the word "None")."""
    return F.concat(name, F.lit(" - "), F.coalesce(description, F.lit(NO_DESCRIPTION)))


def canonical(df: DataFrame, source: str, title: Column, link: Column, creation_date: Column,
              input_cols: list[str]) -> DataFrame:
    """The loader contract — source, title, link, creation_date and the raw record
    as JSON text in ``input``."""
    return df.select(F.lit(source).alias("source"), title.alias("title"), link.alias("link"),
                     creation_date.alias("creation_date"),
                     F.to_json(F.struct(*[F.col(c) for c in input_cols])).alias("input"))
