"""WARC files: round trip, determinism, revisits, rolling, commit."""

import base64
import gzip
import hashlib
import os

import pytest

from gleaner.llm import archive, queries


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, 1) for k, u, h in rows], "page_id long, url string, html string, sha int")


ROWS = [(1, "http://a.example/x", "<p>one</p>"), (2, "http://b.example/", "<p>two é</p>"), (5, "http://c.example/", "<p>one</p>"),
        (3, None, None), (4, "not a url\r\n x", ""), (None, "http://d.example/", "null id"), (7, "http://a.example/x", "same"),
        (7, "http://a.example/x", "same"), (8, "http://z.example/", "line\r\n\r\nWARC/1.1\r\n" * 40), (-9, "http://z.example/", "neg")]


def expected(rows, least=0):
    best = {}
    for k, u, h in rows:
        h = h or ""
        if len(h.encode()) >= least:
            best[h] = max(best.get(h, (-1 << 70, "")), (-1 << 69 if k is None else k, u or ""))
    out, used = [], set()
    for k, u, h in rows:
        h, raw = h or "", (h or "").encode()
        me = (-1 << 69 if k is None else k, u or "")
        first = len(raw) < least or (best[h] == me and (h, me) not in used)
        used.add((h, me))
        out.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit",
                    None if first else best[h][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    got = archive.round_trip(pages(spark, ROWS), least=least)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted([tuple(r) for r in got.select(cols).collect()], key=str) == expected(ROWS, least)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = queries.op1_warc(spark, sf)
    assert sorted([tuple(r) for r in got.select(cols).collect()], key=str) == expected(rows)


def test_files_are_deterministic_and_roll(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example/{i}", os.urandom(300).hex()) for i in range(200)]
    found = []
    for n, parts in enumerate((1, 5)):
        df = pages(spark, rows).repartition(parts)
        target = f"file://{tmp_path}/{n}"
        archive.write_archives(df, target, shard_bytes=30_000, roll_bytes=5_000)
        names = sorted(x for x in os.listdir(f"{tmp_path}/{n}") if x.endswith(".gz"))
        found.append({x: hashlib.sha1(open(f"{tmp_path}/{n}/{x}", "rb").read()).hexdigest() for x in names})
        assert not [x for _, _, f in os.walk(f"{tmp_path}/{n}/_temporary") for x in f if x.endswith(".gz")]
    assert found[0] == found[1] and len(found[0]) > 8
    assert any("-0001.warc.gz" in x for x in found[0])
    manifest = spark.read.parquet(f"{tmp_path}/0/_MANIFEST").toPandas()
    assert dict(zip(manifest.name, manifest.sha1)) == found[0] and manifest.records.sum() == 200


def test_commit_can_be_repeated(spark, tmp_path):
    target = f"file://{tmp_path}/x"
    manifest = archive.write_archives(pages(spark, ROWS), target)
    before = sorted(os.listdir(f"{tmp_path}/x"))
    archive.commit(spark, spark.createDataFrame(manifest.collect(), manifest.schema), target)
    assert sorted(os.listdir(f"{tmp_path}/x")) == before
    assert archive.read_archives(spark, target).count() == len(ROWS)


def test_records_are_members_with_right_lengths(spark, tmp_path):
    archive.write_archives(pages(spark, ROWS), f"file://{tmp_path}/y")
    name = next(x for x in os.listdir(f"{tmp_path}/y") if x.endswith(".gz"))
    data = open(f"{tmp_path}/y/{name}", "rb").read()
    assert data.count(b"\x1f\x8b\x08\x00") >= len(ROWS)
    assert len(list(archive.records(gzip.decompress(data)))) == len(ROWS)


def test_empty_table(spark):
    assert archive.round_trip(pages(spark, [])).count() == 0


def test_shards_hold_equal_bytes_not_equal_pages(spark, tmp_path):
    """One host has few huge pages, another many small ones; a shard is a task of its own."""
    rows = [(i, f"http://small.example/{i:05d}", f"page {i}") for i in range(3000)]
    rows += [(10_000 + i, f"http://huge.example/{i:03d}", f"{i} " + "long text " * 4000) for i in range(60)]
    manifest = archive.write_archives(pages(spark, rows), f"file://{tmp_path}/warc", shard_bytes=400_000, roll_bytes=1 << 30).toPandas()
    assert manifest.shard.is_unique and len(manifest) >= 5
    assert manifest.records.sum() == 3060
    back = archive.read_archives(spark, f"file://{tmp_path}/warc").toPandas()
    assert sorted(back.page_id) == sorted(k for k, _, _ in rows)
    held = {}                                                  # payload bytes of each shard, from the sorted keys
    ordered = sorted(rows, key=lambda r: (r[1].split("/")[2].split(".")[::-1], r[1]))
    at = 0
    for shard, records in sorted(zip(manifest.shard, manifest.records)):
        held[shard] = sum(len(h) + archive.RECORD_BYTES for _, _, h in ordered[at:at + records])
        at += records
    assert max(held.values()) <= 2.5 * sum(held.values()) / len(held)
