"""Layouts of the stored item set that let a request read little of it.

* Parts (C3, A6): rows in parts by a hash of the key; an upsert rewrites the parts that the
  batch touches and leaves the files of the others alone. A manifest names the version
  of every part, so a save shows at once or not at all, and older versions stay readable.
* Lookup (F8, E12): Parquet row groups with a bloom filter on the key, so a request by key
  skips the groups that do not hold it.
* Search (F9): posting lists of title trigrams as bitmaps over the arrival numbers; the lists
  of a term's trigrams are intersected, and only the row ranges left are read and tested.
* Pages (F11): rows in shelves of the sorted order, so a page reads its shelf.
"""

from __future__ import annotations

import json
import math
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.collect import ITEM_FIELDS, upsert_merge
from gleaner.operators.serve import search_items, sort_items
from gleaner.sources.store import file_system

# ------------------------------------------------------------------ parts by key

#: Parts of a store; choose it so that a part is a few hundred megabytes.
PARTS = 64
STORED = ["dedup_key", *ITEM_FIELDS, "first_collected", "last_collected", "ord"]


def part_of(key: str | Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def manifest_versions(spark: SparkSession, path: str) -> list[int]:
    fs, folder = file_system(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The newest (or a given) manifest: parts, schema, and the save that holds each part."""
    found = manifest_versions(spark, path)
    if not found:
        return {"version": 0, "parts": 0, "schema": "", "held": {}}
    version = found[-1] if version is None else version
    fs, p = file_system(spark, f"{path}/manifests/{version}")
    stream = fs.open(p)
    try:
        text = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
    return json.loads(text)


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write a manifest aside and move it to its number; a number that is taken is an error
    (another run saved meanwhile), and nothing of this run shows."""
    fs, aside = file_system(spark, f"{path}/manifests/_{uuid.uuid4().hex}")
    _, target = file_system(spark, f"{path}/manifests/{manifest['version']}")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise RuntimeError(f"version {manifest['version']} of {path} was saved by another run")


def read_parts(spark: SparkSession, path: str, only: list[int] | None = None, version: int | None = None) -> DataFrame:
    """The store, or some of its parts, as of a version (default: the newest)."""
    m = read_manifest(spark, path, version)
    paths = [f"{path}/data/save={v}/part={p}" for p, v in sorted(m["held"].items(), key=lambda x: int(x[0]))
             if only is None or int(p) in only]
    if not paths:
        return spark.createDataFrame([], m["schema"] or "dedup_key string")
    return spark.read.schema(m["schema"]).parquet(*paths)


def _save(spark: SparkSession, path: str, rows: DataFrame, touched: list[int] | None, before: dict, parts: int) -> dict:
    """Write rows into a folder of their own, by part, and commit the manifest with these
    parts replaced (all of them if ``touched`` is None)."""
    version = before["version"] + 1
    save = f"{version}-{uuid.uuid4().hex}"                    # of two runs at once each has its own
    folder = f"{path}/data/save={save}"
    # parts are even (a hash of a unique key); each is written by one task
    rows.withColumn("part", part_of("dedup_key", parts)).repartition(parts, "part").write.mode("overwrite") \
        .partitionBy("part").parquet(folder)
    fs, p = file_system(spark, folder)
    written = [s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p) if s.getPath().getName().startswith("part=")]
    gone = set() if touched is None else {str(x) for x in touched}
    held = {} if touched is None else {k: v for k, v in before["held"].items() if k not in gone}
    manifest = {"version": version, "parts": parts, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema),
                "held": held | dict.fromkeys(written, save)}
    _commit(spark, path, manifest)
    return manifest


def write_parts(store: DataFrame, path: str, parts: int = PARTS) -> dict:
    """A whole store as a new version."""
    spark = store.sparkSession
    return _save(spark, path, store, None, read_manifest(spark, path), parts)


def upsert_parts(spark: SparkSession, path: str, batch: DataFrame, collected_at: datetime,
                 data_fields: list[str] = ITEM_FIELDS) -> list[int]:
    """C3 in place: merge a deduplicated batch into a store in parts; the parts rewritten.
    Only the parts that hold a key of the batch are read and written; ``upsert_merge``
    decides the rows. Running it again with the same batch and clock changes nothing."""
    before = read_manifest(spark, path)
    touched = sorted(r[0] for r in batch.select(part_of("dedup_key", before["parts"]).alias("p")).distinct().collect())
    if not touched:
        return []
    existing = read_parts(spark, path, touched)
    merged = upsert_merge(existing, batch, collected_at, data_fields).select(*existing.columns)
    _save(spark, path, merged, touched, before, before["parts"])
    return touched


# ------------------------------------------------------------------ lookup by key (F8)

#: Bytes of a row group before compression: the unit that a lookup reads or skips.
GROUP_BYTES = 8 << 20


def write_lookup(store: DataFrame, path: str, rows_per_file: int = 1_000_000, group_bytes: int = GROUP_BYTES) -> str:
    """A copy of the store whose row groups carry a bloom filter on ``dedup_key``."""
    (store.write.option("parquet.bloom.filter.enabled#dedup_key", "true")
     .option("parquet.bloom.filter.expected.ndv#dedup_key", str(rows_per_file))
     .option("parquet.bloom.filter.fpp#dedup_key", "0.001")
     .option("parquet.enable.dictionary#dedup_key", "false")          # a dictionary would stand in for the filter
     .option("parquet.block.size", str(group_bytes))
     .option("maxRecordsPerFile", str(rows_per_file)).mode("overwrite").parquet(path))
    return path


def lookup(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The items of a request's keys. The test reaches the scan, which reads only the row
    groups whose bloom filter may hold one of the keys. For a table of keys use
    ``serve.item_lookup``."""
    limit = "spark.sql.parquet.pushdown.inFilterThreshold"        # beyond it an IN becomes a range
    if int(spark.conf.get(limit)) < len(keys):
        spark.conf.set(limit, str(len(keys)))
    return spark.read.parquet(path).where(F.col("dedup_key").isin(*keys))


# ------------------------------------------------------------------ search by trigrams

#: Arrival numbers of a bitmap, as Spark's bitmap functions have it.
BITMAP_BITS = 32768


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.transform(F.array(low), lambda t: F.when(F.length(t) >= 3, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>")))[0]


def write_search(store: DataFrame, path: str) -> str:
    """A searchable copy: the rows, parted by ranges of ``ord`` (one range a bitmap), and the
    posting list of every trigram and range as a bitmap of 4 KB. Lists are built map-side
    and combined by OR, so a trigram that stands in most titles is no hot key."""
    span = F.bitmap_bucket_number(F.col("ord")).alias("span")
    store.withColumn("span", F.bitmap_bucket_number(F.col("ord"))).hint("rebalance", "span").write.mode("overwrite") \
        .partitionBy("span").parquet(f"{path}/rows")
    grams = store.select(F.explode(trigrams(F.col("title"))).alias("gram"), span, F.bitmap_bit_position(F.col("ord")).alias("bit"))
    grams.groupBy("gram", "span").agg(F.bitmap_construct_agg("bit").alias("bits")) \
        .repartitionByRange("gram", "span").sortWithinPartitions("gram", "span").write.mode("overwrite").parquet(f"{path}/grams")
    return path


def marked(lists: DataFrame) -> DataFrame:
    """(span, ord) of the bits that are set in (span, bits). A bucket b above 0 of the bitmap
    functions holds the numbers (b - 1) * 32768 + 1 + position, the others b * 32768 -
    position."""
    byte = lists.select("span", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(BITMAP_BITS // 8)), lambda i: F.conv(
        F.hex(F.substring("bits", i, F.lit(1))), 16, 10).cast("int"))).alias("at", "byte")).where("byte > 0")
    place = F.col("at") * 8 + F.col("bit")
    number = F.when(F.col("span") > 0, (F.col("span") - 1) * BITMAP_BITS + 1 + place).otherwise(F.col("span") * BITMAP_BITS - place)
    return byte.select("span", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where(
        F.col("byte").bitwiseAND(F.expr("shiftleft(1, bit)")) > 0).select("span", number.alias("ord"))


def search(spark: SparkSession, path: str, term: str = "", source: str = "", min_score: int | None = None) -> DataFrame:
    """F9 over a searchable copy: the rows that ``search_items`` gives. The bitmaps of the
    term's trigrams are intersected per range of rows; rows are read from the ranges that
    have a candidate and tested exactly. A term of fewer than three characters has no
    trigrams: all rows are read."""
    rows = spark.read.parquet(f"{path}/rows")
    low = term.lower()
    wanted = sorted({low[i:i + 3] for i in range(len(low) - 2)})
    if wanted:
        lists = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(*wanted))
        both = lists.groupBy("span").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
        found = marked(both.where(F.col("n") == len(wanted)).where(F.bitmap_count("bits") > 0))
        rows = rows.join(found, ["span", "ord"], "left_semi")
    return search_items(rows.drop("span"), term, source, min_score)


# ------------------------------------------------------------------ pages of a sorted listing

#: Rows of a shelf.
SHELF_ROWS = 10_000


def write_pages(store: DataFrame, path: str, by: str = "score", descending: bool | None = None, shelf_rows: int = SHELF_ROWS) -> str:
    """The listing sorted by one field, in shelves of the rank; a page is in one or two."""
    ranked = sort_items(store, by, descending, with_items=True)
    shelf = F.floor((F.col("rank") - 1) / shelf_rows).cast("bigint")
    ranked.withColumn("shelf", shelf).repartitionByRange("rank").sortWithinPartitions("rank").write.mode("overwrite") \
        .partitionBy("shelf").parquet(f"{path}/rows-{shelf_rows}")
    return f"{path}/rows-{shelf_rows}"


def read_page(spark: SparkSession, pages: str, page: int, size: int = 50) -> DataFrame:
    """Rows of a page (from 1), in order of ``rank``: only its shelves are listed and read. A
    page is few rows, which one task puts in order."""
    shelf_rows = int(pages.rsplit("-", 1)[1])
    first, last = (page - 1) * size + 1, page * size
    low, high = math.floor((first - 1) / shelf_rows), math.floor((last - 1) / shelf_rows)
    rows = spark.read.parquet(pages).where(F.col("shelf").between(low, high))
    return rows.where(F.col("rank").between(first, last)).drop("shelf").coalesce(1).sortWithinPartitions("rank")
