"""Store layouts: results equal the plain operators', and requests read little."""

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gleaner.operators import collect, serve
from gleaner.plans import bindings as b
from gleaner.session import scratch_path
from gleaner.sources import layout

FIELDS = ["source", "title", "link", "creation_date"]


@pytest.fixture(scope="module")
def store(spark):
    return b.store(spark, SF_SMALL).checkpoint(eager=True)


def scan_rows(df):
    """Rows that the file scans of a frame put out when it runs."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows, total


def stored_items(spark, n):
    return spark.range(n).select(
        F.md5(F.col("id").cast("string")).alias("dedup_key"), F.lit("s").alias("source"), F.concat(F.lit("title "), "id").alias("title"),
        F.lit("l").alias("link"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("creation_date"),
        F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz").alias("first_collected"),
        F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz").alias("last_collected"), F.col("id").alias("ord"))


def files(spark, path):
    m = layout.read_manifest(spark, path)
    return {p: v for p, v in m["held"].items()}, set(layout.read_parts(spark, path).inputFiles())


def test_upsert_rewrites_touched_parts_only(spark):
    path = scratch_path(spark, "parts")
    existing = stored_items(spark, 400)
    layout.write_parts(existing, path, parts=16)
    held, before = files(spark, path)
    batch = stored_items(spark, 400).where("ord in (3, 77)").withColumn("title", F.lit("new title")).unionByName(
        stored_items(spark, 401).where("ord = 400")).drop("first_collected", "last_collected")
    touched = layout.upsert_parts(spark, path, batch, datetime(2024, 2, 1), FIELDS)
    assert 1 <= len(touched) <= 3
    held_now, after = files(spark, path)
    assert {p for p, v in held_now.items() if v != held.get(p)} == {str(t) for t in touched}
    assert {f for f in before if int(re.search(r"part=(\d+)", f)[1]) not in touched} <= after
    want = collect.upsert_merge(existing, batch, datetime(2024, 2, 1), FIELDS).select(*existing.columns)
    assert sorted(layout.read_parts(spark, path).collect()) == sorted(want.collect())
    # the same batch again changes no row; the version before is still there
    layout.upsert_parts(spark, path, batch, datetime(2024, 2, 1), FIELDS)
    assert sorted(layout.read_parts(spark, path).collect()) == sorted(want.collect())
    assert sorted(layout.read_parts(spark, path, version=1).collect()) == sorted(existing.collect())
    assert layout.upsert_parts(spark, path, batch.limit(0), datetime(2024, 2, 1), FIELDS) == []


def test_a_save_shows_at_once_or_not_at_all(spark):
    path = scratch_path(spark, "race")
    layout.write_parts(stored_items(spark, 20), path, parts=4)
    late = layout.read_manifest(spark, path)
    layout.write_parts(stored_items(spark, 30), path, parts=4)
    with pytest.raises(RuntimeError):                     # a run that began before the other saved
        layout._save(spark, path, stored_items(spark, 5), None, late, 4)
    assert layout.read_parts(spark, path).count() == 30
    assert layout.manifest_versions(spark, path) == [1, 2]
    empty = scratch_path(spark, "none")
    assert layout.read_manifest(spark, empty)["held"] == {} and layout.read_parts(spark, empty).count() == 0


def test_lookup_skips_row_groups(spark):
    path = scratch_path(spark, "lookup")
    items = stored_items(spark, 60_000).repartition(6)
    layout.write_lookup(items, path, rows_per_file=2000, group_bytes=64 << 10)
    keys = [r[0] for r in items.where("ord in (5, 41234)").select("dedup_key").collect()]
    rows, read = scan_rows(layout.lookup(spark, path, keys))
    assert sorted(r["ord"] for r in rows) == [5, 41234]
    assert read <= 60_000 / 5
    none, read = scan_rows(layout.lookup(spark, path, ["no such key"]))
    assert none == [] and read <= 60_000 / 5


@pytest.mark.parametrize("term, source, min_score", [
    ("SRC1", "fr", 40), ("document 1", "", None), ("  document", "", None), ("zzz", "", None), ("do", "", None), ("", "fr", None),
    ("ument 19", "", 1), ("t", "de", 5), ("100%_", "", None)])
def test_search_equals_the_scan(spark, store, term, source, min_score):
    path = scratch_path(spark, "search")
    layout.write_search(store, path)
    got = layout.search(spark, path, term, source, min_score)
    want = serve.search_items(store, term, source, min_score)
    assert sorted(r["dedup_key"] for r in got.collect()) == sorted(r["dedup_key"] for r in want.collect())


def test_search_reads_ranges_with_candidates(spark):
    path = scratch_path(spark, "ranges")
    many = stored_items(spark, 200_000).select("dedup_key", "ord", "source", F.when(F.col("ord") == 150_123, F.lit("A Rare Ünïq title"))
                                               .when(F.col("ord") == 7, F.lit(None)).otherwise(F.lit("common words")).alias("title"),
                                               F.lit(1).alias("weighted_score"))
    layout.write_search(many, path)
    rows, read = scan_rows(layout.search(spark, path, "rare ünïq"))
    assert [r["ord"] for r in rows] == [150_123]
    assert read <= 2 * layout.BITMAP_BITS
    assert layout.search(spark, path, "common").count() == 199_998


def test_marked_bits_round_trip(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, 99_999, 1_000_003]
    df = spark.createDataFrame([(n,) for n in numbers], "ord long")
    lists = df.groupBy(F.bitmap_bucket_number("ord").alias("span")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("ord")).alias("bits"))
    assert sorted(r["ord"] for r in layout.marked(lists).collect()) == numbers


def test_page_reads_its_shelves(spark, store):
    pages = layout.write_pages(store, scratch_path(spark, "pages"), by="title", shelf_rows=20)
    everything = serve.sort_items(store, "title", with_items=True).orderBy("rank").collect()
    rows, read = scan_rows(layout.read_page(spark, pages, page=3, size=15))
    assert [r["dedup_key"] for r in rows] == [r["dedup_key"] for r in everything[30:45]]
    assert read <= 40
    assert layout.read_page(spark, pages, page=999, size=15).count() == 0


def test_manifest_is_json(spark):
    path = scratch_path(spark, "manifest")
    m = layout.write_parts(stored_items(spark, 3), path, parts=2)
    assert json.loads(json.dumps(m)) == layout.read_manifest(spark, path)
