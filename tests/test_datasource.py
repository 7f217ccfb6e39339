"""Loaders behind a Spark format: batch and stream, pushed filters, failing parts."""

import json

from pyspark.sql import functions as F

from gleaner.session import scratch_path
from gleaner.sources import datasource as ds
from gleaner.streaming import jobs


class Numbered(ds.Loader):
    """Three parts of two records; ``broken`` parts fail after their first record."""

    def __init__(self, name, broken=(), down=False):
        self.name, self.broken, self.down = name, broken, down

    def parts(self):
        if self.down:
            raise ConnectionError(f"{self.name} does not answer")
        return ["p0", "p1", "p2"]

    def read(self, part):
        yield {"source": self.name, "title": f"{part} a", "link": "l", "input": {"n": 1}, "ord": 1, "extra": "x"}
        if part in self.broken:
            raise ValueError(f"{part} is damaged")
        yield {"source": self.name, "title": f"{part} b", "link": None, "creation_date": "2024-01-01"}


def read(spark, name, loaders):
    return spark.read.format(ds.items_format(spark, name, loaders)).load()


def test_failing_parts_are_reported_and_the_rest_is_kept(spark):
    loaded = read(spark, "t_some", {"good": Numbered("good"), "half": Numbered("half", broken=["p1"]), "down": Numbered("down", down=True)})
    items, failures = ds.split_failures(loaded)
    assert sorted((r["loader"], r["part"], r["error"]) for r in failures.collect()) == [
        ("down", None, "ConnectionError: down does not answer"), ("half", "p1", "ValueError: p1 is damaged")]
    got = sorted((r["loader"], r["title"]) for r in items.collect())
    assert got == [("good", f"p{i} {x}") for i in range(3) for x in "ab"] + [("half", f"p{i} {x}") for i in (0, 2) for x in "ab"]
    first = items.where("title = 'p0 a' and loader = 'good'").first()
    assert (first["input"], first["ord"], first["creation_date"]) == ('{"n": 1}', 1, None)


def test_filter_on_loader_is_pushed(spark):
    loaders = {"a": Numbered("a"), "b": Numbered("b"), "down": Numbered("down", down=True)}
    one = read(spark, "t_push", loaders).where("loader = 'a'")
    assert one.rdd.getNumPartitions() == 3 and one.where("error is not null").count() == 0 and one.count() == 6
    assert read(spark, "t_push2", loaders).where(F.col("loader").isin("a", "b")).count() == 12
    assert read(spark, "t_push3", loaders).where("loader = 'nobody'").count() == 0
    assert read(spark, "t_none", {}).count() == 0


def test_json_lines_batch_and_stream(spark):
    path = scratch_path(spark, "jsonl")
    rows = [(i, f"title {i}", "é\n\"quoted\"") for i in range(5000)]
    spark.createDataFrame(rows, "ord long, title string, input string").repartition(3).write.json(f"{path}/batch=1")
    loaders = {"files": ds.JsonLines(path)}
    got = read(spark, "t_files", loaders)
    assert sorted((r["ord"], r["title"], r["input"]) for r in got.collect()) == rows
    name = ds.items_format(spark, "t_stream", {**loaders, "down": Numbered("down", down=True)})
    out, ckpt = scratch_path(spark, "fmt-out"), scratch_path(spark, "fmt-ckpt")
    jobs.stream_load(spark.readStream.format(name).load(), out, ckpt)
    assert spark.read.parquet(out).count() == 5000
    # files that come later are read once, those before not again
    spark.createDataFrame([(9999, "late", None)], "ord long, title string, input string").coalesce(1).write.json(f"{path}/batch=2")
    jobs.stream_load(spark.readStream.format(name).load(), out, ckpt)
    jobs.stream_load(spark.readStream.format(name).load(), out, ckpt)
    assert spark.read.parquet(out).count() == 5001
    assert spark.read.parquet(out).where("error is not null").count() == 0


def test_damaged_file_is_one_failed_part(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(json.dumps({"ord": i}) + "\n" for i in range(10)))
    (tmp_path / "b.json").write_text('{"ord": 10}\n{"ord": 11\n')
    (tmp_path / "_hidden.json").write_text("no")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "d.json").write_text("")
    items, failures = ds.split_failures(read(spark, "t_damaged", {"x": ds.JsonLines(str(tmp_path))}))
    assert sorted(r["ord"] for r in items.collect()) == list(range(10))
    assert [(r["part"], r["error"].split(":")[0]) for r in failures.collect()] == [("b.json", "JSONDecodeError")]
