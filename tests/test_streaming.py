"""Streaming jobs over several micro-batches equal their batch counterparts."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from gleaner.operators import collect, evaluate, scorers
from gleaner.plans import bindings as b
from gleaner.plans import catalog
from gleaner.session import scratch_path
from gleaner.streaming import jobs, rounds


def _split(spark, name, parts=3):
    """Land one driver table as several files so a stream sees several batches."""
    path = scratch_path(spark, f"{name}-split")
    df = b.table(spark, SF_SMALL, name)
    key = "event_id" if name == "events" else "doc_id"
    for i in range(parts):
        df.where(F.col(key) % parts == i).coalesce(1).write.parquet(f"{path}/part={i}")
    return path


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def test_stream_state_equals_batch_state(spark):
    path = _split(spark, "events")
    out, ckpt = scratch_path(spark, "s2-out"), scratch_path(spark, "s2-ckpt")
    landed = b.key_table(spark, SF_SMALL).checkpoint()
    jobs.stream_eval_state(b.evals_from_events(_stream(spark, path, b.EVENTS_SCHEMA), landed), out, ckpt)
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 3
    got = sorted(jobs.latest_state(spark, out).collect())
    want = sorted(evaluate.eval_state(b.evals(spark, SF_SMALL)).collect())
    assert got == want
    last = jobs.compact_state(spark, out)
    assert [r["batch_id"] for r in spark.read.parquet(out).select("batch_id").distinct().collect()] == [last]
    assert sorted(jobs.latest_state(spark, out).collect()) == want
    assert jobs.compact_state(spark, scratch_path(spark, "none")) == -1


def test_stream_dedup_across_batches(spark):
    path = _split(spark, "documents")
    out, ckpt = scratch_path(spark, "s1-out"), scratch_path(spark, "s1-ckpt")
    jobs.stream_collect(b.landed_from_documents(_stream(spark, path, b.DOCUMENTS_SCHEMA)), out, ckpt)
    keys = [r[0] for r in spark.read.parquet(out).select("dedup_key").collect()]
    assert len(keys) == len(set(keys))
    assert set(keys) == {r[0] for r in collect.dedup_first_wins(b.landed_items(spark, SF_SMALL)).select("dedup_key").collect()}


def test_stream_evaluate_replay_is_idempotent(spark):
    path = _split(spark, "documents")
    out, ckpt = scratch_path(spark, "s3-out"), scratch_path(spark, "s3-ckpt")
    items = lambda: b.landed_from_documents(_stream(spark, path, b.DOCUMENTS_SCHEMA))
    jobs.stream_evaluate(items(), scorers.keyword_scorer(), out, ckpt)
    first = sorted(spark.read.parquet(out).drop("batch_id").collect())
    jobs.stream_evaluate(items(), scorers.keyword_scorer(), out, ckpt)   # restart from the checkpoint
    assert sorted(spark.read.parquet(out).drop("batch_id").collect()) == first
    assert len(first) == b.items_narrow(spark, SF_SMALL).count() == len({r["dedup_key"] for r in first})


def test_late_new_items_are_kept_and_late_copies_dropped(spark):
    """Files arrive newest first; nothing is too late to be new."""
    path = scratch_path(spark, "late")
    docs = b.table(spark, SF_SMALL, "documents").where("doc_id < 60")
    for i in range(3):
        docs.where(F.floor(F.col("doc_id") / 20) == 2 - i).coalesce(1).write.parquet(f"{path}/part={i}")
        docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 1000 * i).coalesce(1).write.mode("append").parquet(
            f"{path}/part={i}")
    out, ckpt = scratch_path(spark, "late-out"), scratch_path(spark, "late-ckpt")
    jobs.stream_collect(b.landed_from_documents(_stream(spark, path, b.DOCUMENTS_SCHEMA)), out, ckpt)
    keys = [r[0] for r in spark.read.parquet(out).select("dedup_key").collect()]
    want = {r[0] for r in b.landed_from_documents(docs).select("dedup_key").collect()}
    assert len(keys) == len(set(keys)) and set(keys) == want


def test_stream_evaluate_skips_evaluated_items(spark):
    path = _split(spark, "documents")
    out, ckpt = scratch_path(spark, "s4-out"), scratch_path(spark, "s4-ckpt")
    known = b.items_narrow(spark, SF_SMALL).where("ord % 2 = 0").select("dedup_key").checkpoint()
    jobs.stream_evaluate(b.landed_from_documents(_stream(spark, path, b.DOCUMENTS_SCHEMA)), scorers.keyword_scorer(),
                         out, ckpt, evals=known)
    got = {r[0] for r in spark.read.parquet(out).select("dedup_key").collect()}
    every = {r[0] for r in b.items_narrow(spark, SF_SMALL).select("dedup_key").collect()}
    assert got == every - {r[0] for r in known.collect()}


def _dated(spark, path, batches):
    """One file per batch of (ord, key, day) rows; day counts from 2024-01-01."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "ord bigint, dedup_key string, day int")
        df.coalesce(1).write.parquet(f"{path}/part={i}")
    stream = (spark.readStream.schema("ord bigint, dedup_key string, day int").option("maxFilesPerTrigger", 1)
              .option("latestFirst", False).parquet(f"{path}/part=*"))
    return stream.withColumn("creation_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).cast("timestamp_ntz"))


def test_stream_within_delay_bounds_state_and_counts_late_rows(spark):
    path = scratch_path(spark, "within")
    batches = [[(1, "a", 0), (2, "b", 1), (3, "a", 1)],
               [(4, "a", 6), (5, "c", 8), (6, None, 8)],          # a copy within the delay, and a row without a key
               [(7, "d", 40), (8, "b", 9)],                       # out of order, yet not behind the watermark
               [(10, "f", 45)],
               [(11, "a", 50), (12, "g", 90)],                    # a was forgotten: new again
               [(13, "h", 91), (9, "e", 2)]]                      # e is behind the watermark
    out, ckpt = scratch_path(spark, "within-out"), scratch_path(spark, "within-ckpt")
    report = jobs.stream_collect_within(_dated(spark, path, batches), out, ckpt, delay="10 days", spread=3)
    got = sorted((r["dedup_key"], r["day"]) for r in spark.read.parquet(out).collect())
    assert [k for k, _ in got] == ["a", "a", "b", "c", "d", "f", "g", "h"]
    assert ("a", 50) in got and ("e", 2) not in got
    assert report.late_rows == 1
    assert max(report.state_rows) <= 2 * 6 and report.state_rows[-1] <= 2 * 4   # both passes; old keys are gone
    assert report.watermarks == sorted(report.watermarks)
    # a restart reads nothing again
    again = jobs.stream_collect_within(_dated_again(spark, path), out, ckpt, delay="10 days", spread=3)
    assert sorted((r["dedup_key"], r["day"]) for r in spark.read.parquet(out).collect()) == got and again.late_rows == 0


def _dated_again(spark, path):
    stream = spark.readStream.schema("ord bigint, dedup_key string, day int").option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    return stream.withColumn("creation_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).cast("timestamp_ntz"))


def test_stream_within_delay_equals_batch_dedup(spark):
    path = _split(spark, "documents", 4)
    out, ckpt = scratch_path(spark, "within2-out"), scratch_path(spark, "within2-ckpt")
    items = b.landed_from_documents(_stream(spark, path, b.DOCUMENTS_SCHEMA)).drop("input")
    report = jobs.stream_collect_within(items, out, ckpt, delay="30 days")
    got = sorted(r[0] for r in spark.read.parquet(out).select("dedup_key").collect())
    want = sorted(r[0] for r in b.items_narrow(spark, SF_SMALL).select("dedup_key").collect())
    assert got == want and report.late_rows == 0 and len(report.state_rows) >= 4


def test_stream_collect_keeps_first_batch_and_smallest_ord(spark):
    path = scratch_path(spark, "first")
    batches = [[(5, "a", 0), (3, "a", 0), (9, "b", 0)], [(1, "a", 0), (2, "c", 0)], [(0, "c", 0), (4, "d", 0), (6, None, 0)]]
    out, ckpt = scratch_path(spark, "first-out"), scratch_path(spark, "first-ckpt")
    jobs.stream_collect(_dated(spark, path, batches), out, ckpt)
    assert sorted((r["dedup_key"], r["ord"]) for r in spark.read.parquet(out).collect()) == [("a", 3), ("b", 9), ("c", 2), ("d", 4)]
    assert spark.read.parquet(out).columns[:3] == ["ord", "dedup_key", "day"]


def _rounds(spark, items, out, ckpt, providers, evals=None, n=3, **more):
    inputs = b.landed_items(spark, SF_SMALL).select("dedup_key", "ord", "title", "source", "input")
    return rounds.stream_rounds(items, inputs, b.BINDING_CONFIG, providers, n, out, ckpt, b.AS_OF, evals=evals, **more)


ROUND_FIELDS = ["dedup_key", "round", "model", "prompt_hash", "importance_score", "confidence_score", "summary"]


def test_stream_rounds_over_late_items_equal_batch_rounds(spark):
    """Items arrive in three files, in order; some have evals already, some never answer at first."""
    path = scratch_path(spark, "in-order")
    for i in range(3):
        b.table(spark, SF_SMALL, "documents").where(F.floor(F.col("doc_id") / 70) == i).coalesce(1).write.parquet(f"{path}/part={i}")
    providers = {"keyword": catalog._flaky(evaluate.scorer_provider(scorers.keyword_scorer()))}
    past = b.evals(spark, SF_SMALL).where("seq % 2 = 0").checkpoint()
    out, ckpt = scratch_path(spark, "rounds-out"), scratch_path(spark, "rounds-ckpt")
    items = lambda: b.landed_from_documents(_stream(spark, path, b.DOCUMENTS_SCHEMA)).drop("input")
    assert _rounds(spark, items(), out, ckpt, providers, past) >= 5
    got = sorted(map(tuple, rounds.read_answers(spark, out).select(*ROUND_FIELDS).collect()))
    recent = evaluate.recent_items(b.items_narrow(spark, SF_SMALL), b.BINDING_CONFIG, b.AS_OF).select(
        "dedup_key", "ord", "title", "source")
    want = evaluate.new_evals(recent, past, b.BINDING_CONFIG, providers, rounds=3, as_of=b.AS_OF,
                              inputs=b.landed_items(spark, SF_SMALL).select("ord", "input"))
    assert got == sorted(map(tuple, want.select(*ROUND_FIELDS).collect())) and len(got) > 100
    # started again from its checkpoint there is nothing left to ask
    _rounds(spark, items(), out, ckpt, providers, past)
    assert sorted(map(tuple, rounds.read_answers(spark, out).select(*ROUND_FIELDS).collect())) == got


def test_stream_rounds_stop_at_settled_items_and_time_out_lost_requests(spark):
    """Seven evals make a sure item settled; requests that get no answer are given up by the timer."""
    path = scratch_path(spark, "few")
    b.table(spark, SF_SMALL, "documents").where("doc_id < 12").coalesce(1).write.parquet(f"{path}/part=0")
    keyed = {r["ord"]: r["dedup_key"] for r in b.key_table(spark, SF_SMALL).where("ord < 12").collect()}

    def sure(df, model, attempts):
        text = '{"summary": "s", "evaluation": "e", "importance_score": 95, "confidence_score": 90}'
        return df.withColumn("responses", F.array(F.lit(text)))

    def losing(requests, *rest):                       # round 1 of even items gets lost on the way
        return rounds.answered(requests, *rest).where("not (round = 1 and ord % 2 = 0)")

    out, ckpt = scratch_path(spark, "few-out"), scratch_path(spark, "few-ckpt")
    items = b.landed_from_documents(_stream(spark, path, b.DOCUMENTS_SCHEMA)).drop("input").withColumn(
        "creation_date", F.lit(None).cast("timestamp_ntz"))
    _rounds(spark, items, out, ckpt, {"keyword": sure}, n=9, answer=losing, retry_after=2.0, idle_batches=20, pause="300 milliseconds")
    done = {}
    for r in rounds.read_answers(spark, out).collect():
        done.setdefault(r["ord"], []).append(r["round"])
    assert len(done) == len(set(keyed.values()))
    for ord_, seen in done.items():
        assert sorted(seen) == (list(range(2, 8)) if ord_ % 2 == 0 else list(range(1, 7)))


def test_item_state_agrees_with_the_batch_state(spark):
    past = b.evals(spark, SF_SMALL)
    want = {r["dedup_key"]: r for r in evaluate.eval_state(past).collect()}
    for r in rounds.history(past).collect():
        item = rounds.Item()
        for c, n, s in zip(r["levels"], r["times"], r["scores"]):
            item.add(s, c, n)
        w = want[r["dedup_key"]]
        assert (item.num_evals, item.score(), item.median_confidence()) == (w["num_evals"], w["weighted_score"], w["median_confidence"])
        again = rounds.Item(item.values())
        assert again.values() == item.values()
