"""Deterministic sharded WARC writer and reader.

Records are range-sorted by a key of reversed host, path and page id; shard bounds are
quantiles by payload bytes of a sample chosen by hash, so they depend on the data alone, and
equal input gives equal files. Every shard is written by a task of its own. A shard is one or more files that roll at a compressed size. Every
record is a gzip member of its own with regenerated WARC and HTTP headers, block and
payload hashes. Of records with equal payloads one (largest page id) is a response;
the others are revisits without a payload that refer to it.

A task writes each file under a name of its attempt; the rows it returns (the manifest)
are stored by Spark's commit protocol, which keeps one attempt of each task. Only files
named there are then moved to their final names, each move being repeatable, and a
``_MANIFEST`` table with names, sizes and hashes ends the commit. A lost executor or a
failed run leaves nothing but temporary files. Files are written through Arrow's file
systems, so the target may be any folder that all executors reach.

Null html is an empty payload, null urls become the empty URL, null page ids are kept
and sort first; of repeated rows one is the response. An empty table gives a manifest
without files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import slices, smallest_hashes, written
from gleaner.session import scratch_path

#: Payload bytes that a shard is meant to hold; compressed bytes at which a file rolls.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 16 << 20
#: Bytes of a record besides its payload, about.
RECORD_BYTES = 700
#: Shards at most (beyond, a shard just rolls more files); sampled keys per shard.
MAX_SHARDS, SAMPLE = 20_000, 32
VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
CRLF = b"\r\n"

MANIFEST = ("shard int, roll int, temporary string, name string, records long, bytes long, sha1 string")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def block_of(payload: bytes) -> bytes:
    """HTTP response with regenerated headers."""
    return (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)) + payload


def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{copy}>"


def record(page_id: int | None, url: str, payload: bytes, refers: tuple[int | None, str] | None, copy: int,
           date: str = DATE) -> bytes:
    """One WARC record; ``refers`` (page id and URL of the response) makes it a revisit."""
    head, sha = block_of(payload), base32_sha1(payload)
    block = head if refers is None else head[:len(head) - len(payload)]
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page_id, copy)),
              ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
              ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
              ("Payload-Length", str(len(payload)))]
    if refers is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(refers[0], 0)), ("WARC-Refers-To-Target-URI", refers[1])]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields)]
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, compresslevel=6, mtime=0) as f:
        f.write(data)
    return out.getvalue()


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(CRLF * 2, at)
        version, *lines = data[at:end].split(CRLF)
        if version != VERSION:
            raise ValueError(f"not a WARC record at byte {at}")
        fields = dict(line.decode().split(": ", 1) if b": " in line else (line.decode().rstrip(":"), "") for line in lines)
        start = end + 4
        at = start + int(fields["Content-Length"])
        yield fields, data[start:at]
        if data[at:at + 4] != CRLF * 2:
            raise ValueError(f"record does not end at byte {at}")
        at += 4


def members(data: memoryview) -> Iterator[bytes]:
    """The content of every gzip member, one at a time."""
    at = 0
    while at < len(data):
        stream, parts, step = zlib.decompressobj(wbits=31), [], 1 << 14
        while not stream.eof:
            if at >= len(data):
                raise ValueError("the last gzip member is cut off")
            parts.append(stream.decompress(data[at:at + step]))
            at += min(step, len(data) - at)
        at -= len(stream.unused_data)
        yield b"".join(parts)


def sort_key(url, page_id):
    """Host labels reversed, path, then page id in an order that strings keep."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    rest = F.substring(url, F.length(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?", 0)) + 1, F.length(url))
    number = F.coalesce(page_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(-1).cast("decimal(20,0)"))
    return F.concat_ws(" ", F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), rest,
                       F.lpad((number + 1).cast("string"), 20, "0"))


def prepared(df: DataFrame, key: str, url: str, html: str, least: int) -> DataFrame:
    """Rows to write: id, url, html, sort key, and the response that a copy refers to."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                     F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("key", sort_key(F.col("url"), F.col("id")))
    whole = rows.filter(F.octet_length("html") >= least).select("sha", F.struct("id", "url").alias("page"))
    # only payloads met more than once need a response; the stored table tells its size
    shared = written(whole.groupBy("sha").agg(F.max("page").alias("response"), F.count("*").alias("n"))
                     .filter("n > 1").select("sha", "response"), "payloads")
    return rows.join(shared, "sha", "left").drop("sha")


def bounds(rows: DataFrame, shard_bytes: int) -> np.ndarray:
    """Upper keys of all shards but the last, from the keys of smallest hash. The keys' payload
    bytes are their weights, so shards hold about equal bytes, not equal numbers of pages."""
    total, count = rows.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)), F.count("*")).first()
    shards = max(1, min(MAX_SHARDS, -(-total // shard_bytes)))
    few = smallest_hashes(rows.select("key", F.octet_length("html").alias("n"), F.xxhash64("key").alias("h")), "h",
                          SAMPLE * shards, count)
    held = sorted((r["key"].encode(), r["n"]) for r in few.groupBy("key").agg(F.sum("n").alias("n")).collect())
    if not held:
        return np.array([], dtype=object)
    # a record's headers weigh something too
    upto = np.cumsum([n + RECORD_BYTES for _, n in held])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards)
    return np.array([held[i][0] for i in at], dtype=object)


def write_archives(df: DataFrame, target: str, key: str = "page_id", url: str = "url", html: str = "html",
                   least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the rows as archives into the folder ``target`` and return the manifest."""
    spark = df.sparkSession
    edges = bounds(df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                             F.coalesce(F.col(html), F.lit("")).alias("html"))
                   .select("html", sort_key(F.col("url"), F.col("id")).alias("key")), shard_bytes).tolist()

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        import bisect
        return keys.map(lambda k: bisect.bisect_right(edges, k.encode()))

    def write(batches):
        from pyarrow import fs
        system, folder = fs.FileSystem.from_uri(target)
        system.create_dir(f"{folder}/_temporary", recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        shard, roll, out, size, number, sha, before, copy = None, 0, None, 0, 0, None, None, 0

        def close():
            out.close()
            name = f"pages-{shard:06d}-{roll:04d}.warc.gz"
            return (shard, roll, f"_temporary/{attempt}-{name}", name, number, size, sha.hexdigest())

        for batch in slices(batches, "html"):
            done = []
            for r in batch.to_pylist():
                if out is not None and (r["shard"] != shard or size >= roll_bytes):
                    done.append(close())
                    roll, out = (roll + 1 if r["shard"] == shard else 0), None
                if out is None:
                    shard, size, number, sha = r["shard"], 0, 0, hashlib.sha1()
                    out = system.open_output_stream(
                        f"{folder}/_temporary/{attempt}-pages-{shard:06d}-{roll:04d}.warc.gz", compression=None)
                payload, response = r["html"].encode(), r["response"]
                same = (r["id"], r["url"], base32_sha1(payload))
                copy = copy + 1 if same == before else 0
                before = same
                first = response is None or ((response["id"], response["url"]) == same[:2] and copy == 0)
                data = member(record(r["id"], r["url"], payload, None if first else (response["id"], response["url"]), copy))
                out.write(data)
                sha.update(data)
                size += len(data)
                number += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(close(), kinds)], names=names)

    names = ["shard", "roll", "temporary", "name", "records", "bytes", "sha1"]
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    rows = prepared(df, key, url, html, least).withColumn("shard", shard_of("key"))
    # a shard is a task: its number is the partition's
    dealt = rows.repartitionById(max(1, len(edges) + 1), F.col("shard")).sortWithinPartitions("shard", "key", "url", "id", "html")
    manifest = written(dealt.select("id", "url", "html", "response", "shard").mapInArrow(write, MANIFEST), "manifest")
    return commit(spark, manifest, target)


def commit(spark: SparkSession, manifest: DataFrame, target: str) -> DataFrame:
    """Move the manifest's files to their final names and store it as the last step."""

    def move(batches):
        from pyarrow import fs
        system, folder = fs.FileSystem.from_uri(target)
        for batch in batches:
            for r in batch.to_pylist():
                there = system.get_file_info(f"{folder}/{r['name']}")
                if there.type == fs.FileType.NotFound or there.size != r["bytes"]:
                    system.move(f"{folder}/{r['temporary']}", f"{folder}/{r['name']}")
            yield batch

    moved = manifest.mapInArrow(move, manifest.schema)
    moved.write.mode("overwrite").parquet(f"{target}/_MANIFEST")
    return spark.read.schema(manifest.schema).parquet(f"{target}/_MANIFEST")


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """One row per record of the committed files: page_id, url, record_type,
    payload_bytes, payload_digest, refers_to, refers_to_url, payload (null for revisits).
    Hashes and lengths are verified."""
    names = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, " \
            "refers_to long, refers_to_url string, payload binary"

    def number(uri: str | None) -> int | None:
        found = uri and re.fullmatch(r"<urn:page:(-?\d+):\d+>", uri)
        return int(found[1]) if found else None

    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                out, held = [], 0
                every = (r for m in members(memoryview(content.as_buffer())) for r in records(m))
                for fields, block in every:
                    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"block hash of {fields['WARC-Record-ID']} differs")
                    payload = block.split(CRLF * 2, 1)[1] if fields["WARC-Type"] == "response" else None
                    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None and base32_sha1(payload) != sha:
                        raise ValueError(f"payload hash of {fields['WARC-Record-ID']} differs")
                    size = len(payload) if payload is not None else int(fields["Payload-Length"])
                    out.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], size,
                                sha, number(fields.get("WARC-Refers-To")), fields.get("WARC-Refers-To-Target-URI"), payload))
                    held += len(payload or b"")
                    if held > 4 << 20:
                        yield made(out)
                        out, held = [], 0
                if out:
                    yield made(out)

    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                          names=[n.split()[0] for n in names.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(target).select("content")
    return files.mapInArrow(parse, names)


def round_trip(df: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages into a fresh shared folder and read the archives back."""
    spark = df.sparkSession
    target = scratch_path(spark, "warc")
    if "://" not in target:                       # a plain path, or file:/ as Hadoop writes it
        target = f"file://{target.removeprefix('file:')}"
    write_archives(df, target, least=least)
    return read_archives(spark, target)
