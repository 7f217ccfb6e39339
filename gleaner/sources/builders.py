"""The six source kinds, each composed from its raw landed tables into items.

A builder takes the raw frames by name, the source's settings and the clock, and returns
the loader contract (source, title, link, creation_date as a timestamp, input as JSON).
Settings resolve as everywhere (environment, source, base, default). ``RAW`` gives the
fields that a kind's tables are read with.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.columns import from_epoch_millis_to_second, from_epoch_seconds
from gleaner.operators.config import Config, parse_int
from gleaner.sources import shaping

#: Raw tables of each kind with the fields that are used.
RAW: dict[str, dict[str, str]] = {
    "papers": {"papers": "id string, title string, summary string, author string, authors array<struct<name:string>>, "
                         "category string, link string, published string"},
    "feeds": {"feed_items": "id string, title string, author string, html string, url string, is_read int, "
                            "created_on_time bigint",
              "pages": "url string, html string"},
    "comments": {"comments": "id string, contractId string, contractQuestion string, userName string, content string, "
                             "likes bigint, created_time string, createdTime bigint",
                 "markets": "market_id string, market_url string"},
    "projects": {"projects": "title string, slug string, created_at string, full_name string",
                 "project_comments": "slug string, full_name string, content string, created_at string, seq bigint"},
    "posts": {"posts": "id string, name string, tagline string, description string, url string, votesCount bigint, "
                       "createdAt string"},
    "repos": {"repos": "full_name string, name string, description string, html_url string, stars double, "
                       "created string, pushed string",
              "user_events": "login string, type string, repo_name string, created_at string",
              "following": "login string, follow_pos bigint", "starred": "full_name string",
              "readmes": "full_name string, content string"},
}


@dataclass
class Settings:
    """Settings of one source."""

    config: Config
    source: str

    def text(self, key: str, default: str | None = None) -> str | None:
        return self.config.value(key, self.source, default)

    def number(self, key: str, default: int) -> int:
        return parse_int(self.text(key), default)

    def listed(self, key: str) -> list[str]:
        return [x.strip() for x in (self.text(key) or "").split(",") if x.strip()]

    def limit(self, key: str) -> int | None:
        """A budget that applies only where it is set."""
        return self.number(key, 0) if self.text(key) is not None else None

    def cutoff(self, as_of: datetime) -> datetime:
        return as_of - timedelta(days=self.number("lookback_days", 7))


Raw = dict[str, DataFrame]
Builder = Callable[[Raw, Settings, datetime], DataFrame]


def papers(raw: Raw, s: Settings, as_of: datetime) -> DataFrame:
    """Newest papers per configured category, each once under its first category."""
    found = raw["papers"].withColumn("published", shaping.parse_item_date("published"))
    categories = s.listed("categories")
    if categories:
        found = found.where(F.col("category").isin(*categories))
    newest = shaping.newest_per_category(found, s.number("max_results_per_category", 100), s.cutoff(as_of))
    if not categories:
        categories = sorted(r[0] for r in newest.select("category").distinct().collect())
    first = shaping.first_category(newest.select("id", "category"), categories)
    once = newest.join(first.withColumnRenamed("primary_category", "category"), ["id", "category"], "left_semi")
    shaped = shaping.normalize_papers(once)
    return shaping.canonical(shaped, s.source, shaping.title_by(F.col("title"), F.col("author")), F.col("url"),
                             F.col("published"), ["paper_id", "title", "author", "all_authors", "abstract", "url"])


def feeds(raw: Raw, s: Settings, as_of: datetime) -> DataFrame:
    """Unread recent feed items; short ones get the text of the page they link to."""
    fresh = shaping.unread_recent(raw["feed_items"], s.cutoff(as_of))
    full = shaping.short_content_fallback(fresh, raw["pages"], s.number("min_word_count", 50))
    full = full.drop("html").withColumnRenamed("text", "html")
    return shaping.canonical(full, s.source, shaping.title_by(F.col("title"), F.col("author")), F.col("url"),
                             from_epoch_seconds("created_on_time"), ["id", "title", "author", "url", "html"])


def comments(raw: Raw, s: Settings, as_of: datetime) -> DataFrame:
    """Liked, recent, long comments with a link into their market."""
    dated = raw["comments"].withColumn("created", F.coalesce(
        shaping.parse_item_date("created_time"), from_epoch_millis_to_second("createdTime")))
    liked = shaping.liked_recent_comments(dated, s.number("min_likes", 15), s.cutoff(as_of), s.limit("max_comments"))
    flat = liked.withColumn("content", shaping.flatten_rich_text("content"))
    linked = shaping.comment_links(shaping.long_comments(flat), raw["markets"])
    return shaping.canonical(linked, s.source, shaping.comment_title(F.col("userName"), F.col("contractQuestion")),
                             F.col("link"), F.col("created"), ["id", "userName", "contractQuestion", "content", "likes"])


def recent_threads(raw: Raw, s: Settings, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """Recent projects and recent comments."""
    cutoff = s.cutoff(as_of)
    recent = shaping.created_after(raw["projects"].withColumn("created", shaping.parse_item_date("created_at")),
                                   "created", cutoff)
    said = shaping.created_after(raw["project_comments"].withColumn("created", shaping.parse_item_date("created_at")),
                                 "created", cutoff)
    return recent, said


def projects(raw: Raw, s: Settings, as_of: datetime) -> DataFrame:
    """Recent grant projects. A thread can be of any length, so the item holds the number of
    its recent comments and a hash of them (which changes with any comment and not with
    their order of arrival); both combine map-side. ``project_comments`` gives the lines."""
    recent, said = recent_threads(raw, s, as_of)
    line = F.xxhash64("created", "seq", "full_name", "content")
    threads = said.groupBy("slug").agg(F.count(F.lit(1)).alias("n_comments"), F.bit_xor(line).alias("comments_hash"))
    joined = recent.join(threads, "slug", "left").withColumn("n_comments", F.coalesce("n_comments", F.lit(0).cast("bigint")))
    link = F.concat(F.lit(s.text("project_url", "https://grants.example/projects/")), F.col("slug"))
    return shaping.canonical(joined, s.source, shaping.title_by(F.col("title"), F.col("full_name")), link,
                             F.col("created"), ["title", "slug", "full_name", "n_comments", "comments_hash"])


def project_comments(raw: Raw, s: Settings, as_of: datetime) -> DataFrame:
    """The recent comments of recent projects in long form, oldest first: (slug,
    comment_index, comment); a thread of any length is spread over many rows and tasks."""
    recent, said = recent_threads(raw, s, as_of)
    lines = shaping.attach_comments(recent.select("slug"), said.withColumn("created_at", F.col("created")))
    return lines.where(F.col("comment_index").isNotNull()).select("slug", "comment_index", "comment")


def posts(raw: Raw, s: Settings, as_of: datetime) -> DataFrame:
    """Recent launches with enough votes."""
    dated = raw["posts"].withColumn("createdAt", shaping.parse_item_date("createdAt"))
    kept = shaping.shape_posts(dated, s.cutoff(as_of), s.number("min_votes", 200))
    return shaping.canonical(kept, s.source, F.col("name"), F.col("url"), F.col("created_at"),
                             ["id", "name", "tagline", "description", "url", "votes_count"])


def repos(raw: Raw, s: Settings, as_of: datetime) -> DataFrame:
    """Trending repositories and those that followed users starred or forked, without the
    starred ones, each once, with its README; dated by the clock."""
    cutoff = s.cutoff(as_of)
    known = raw["repos"].withColumns({c: shaping.parse_item_date(c) for c in ("created", "pushed")})
    fields = ["full_name", "name", "description", "html_url", "stars"]
    top = shaping.trending(known, cutoff, s.number("min_stars", 10)).withColumnRenamed("rank", "pos")
    events = raw["user_events"].withColumn("created_at", shaping.parse_item_date("created_at"))
    active = shaping.following_activity(events, raw["following"], known, cutoff, s.limit("max_users"))
    active = active.groupBy(*fields).agg(F.max(F.unix_seconds(F.col("created_at").cast("timestamp"))).alias("pos"))
    lists = top.select(F.lit(0).alias("list_ord"), "pos", *fields).unionByName(
        active.select(F.lit(1).alias("list_ord"), "pos", *fields))
    combined = shaping.combine_repos(shaping.drop_starred(lists, raw["starred"]), s.limit("max_repos"))
    full = shaping.attach_readme(combined, raw["readmes"])
    return shaping.canonical(full, s.source, shaping.repo_title(F.col("name"), F.col("description")), F.col("html_url"),
                             F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"),
                             [*fields, "readme_content"])


BUILDERS: dict[str, Builder] = {"papers": papers, "feeds": feeds, "comments": comments, "projects": projects,
                                "posts": posts, "repos": repos}


def build(kind: str, raw: Raw, config: Config, as_of: datetime, source: str | None = None) -> DataFrame:
    """Items of one source of the given kind; an unknown kind is an error."""
    if kind not in BUILDERS:
        raise ValueError(f"unknown source kind {kind!r}; known: {sorted(BUILDERS)}")
    return BUILDERS[kind](raw, Settings(config, source or kind), as_of)
