"""Evaluation rounds that go on by themselves (S3 with E2 and E9 as keyed state).

One stream reads arriving items and the answers to its own requests. The state of an item
(RocksDB, one value per key) is what the evaluation state needs: number of evals, weighted
sums, evals per confidence, the last finished round and the round that is waited for. An
item that is not settled requests its next round; the micro-batch's sink asks the
providers for all requests and writes the answers as files, which are the stream's other
source; an answer updates the state, and the item requests again, until it is settled
or has been through ``rounds`` rounds. An answer that never comes (a provider that gave
nothing back) is given up by a timer after ``retry_after`` seconds, and the item goes on
with its next round.

Every step may run again after a failure: a request that is repeated is answered under the
same round, and an answer that is not the one waited for (a second copy of it) is ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gleaner.operators.config import Config, with_settings
from gleaner.operators.evaluate import (SETTLED_BAD_SCORE, SETTLED_GOOD_SCORE, SETTLED_MIN_CONFIDENCE, SETTLED_MIN_EVALS,
                                        Provider, ask, is_recent, response_scores, tally)
from gleaner.sources.store import file_system
from gleaner.streaming.jobs import use_rocksdb_state

ANSWER_SCHEMA = ("dedup_key string, ord bigint, round int, model string, prompt_hash string, importance_score int, "
                 "confidence_score int, summary string, answered boolean")
STATE_SCHEMA = ("ord bigint, done int, waiting int, due bigint, num_evals bigint, scores bigint, weights bigint, "
                "levels array<int>, counts array<bigint>")
#: A stream without a new micro-batch and without data for so long is done.
QUIET_SECONDS = 15.0
REQUEST_SCHEMA = "dedup_key string, ord bigint, round int"


class Item:
    """State of one item as plain values: what is known of its evals, and where its rounds are."""

    def __init__(self, row=None) -> None:
        self.ord, self.done, self.waiting, self.due, self.num_evals, self.scores, self.weights, levels, counts = \
            row or (None, 0, 0, 0, 0, 0, 0, [], [])
        self.confidences = dict(zip(levels, counts))

    def values(self) -> tuple:
        levels = sorted(self.confidences)
        return (self.ord, self.done, self.waiting, self.due, self.num_evals, self.scores, self.weights, levels,
                [self.confidences[c] for c in levels])

    def add(self, importance: int, confidence: int, times: int = 1) -> None:
        """``times`` evals of one confidence; importance is their sum."""
        self.num_evals += times
        self.scores += importance * (confidence + 100)
        self.weights += times * (confidence + 100)
        self.confidences[confidence] = self.confidences.get(confidence, 0) + times

    def score(self) -> int:
        return int(self.scores / self.weights) if self.weights > 0 else 0

    def median_confidence(self) -> int:
        """The middle eval's confidence (of an even number the mean of both), truncated."""
        half, seen, middle = self.num_evals / 2, 0, []
        for level in sorted(self.confidences):
            before, seen = seen, seen + self.confidences[level]
            middle += [level] * ((before <= half - 0.5 < seen) + (before < half + 0.5 <= seen))
        return int(sum(middle[:2]) / 2)

    def settled(self) -> bool:
        """E2's rule."""
        if self.num_evals <= SETTLED_MIN_EVALS or self.median_confidence() <= SETTLED_MIN_CONFIDENCE:
            return False
        score = self.score()
        return score > SETTLED_GOOD_SCORE or (score != 0 and score < SETTLED_BAD_SCORE)

    def next_round(self, rounds: int) -> int | None:
        """The first round after those done that still asks for this item."""
        following = max(self.done + 1, self.num_evals + 1)
        return following if following <= rounds and not self.settled() else None


class Rounds(StatefulProcessor):
    """Emits (dedup_key, ord, round) requests."""

    def __init__(self, rounds: int, retry_after: float) -> None:
        self.rounds, self.retry_after = rounds, int(retry_after * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", STATE_SCHEMA)

    def close(self) -> None:
        pass

    def _known(self) -> Item:
        return Item(tuple(self.state.get())) if self.state.exists() else Item()

    def _request(self, key, item: Item, now: int) -> Iterator[Row]:
        following = item.next_round(self.rounds) if item.ord is not None else None
        item.waiting = following or 0
        if following:
            item.due = now + self.retry_after
            self.handle.registerTimer(item.due)
            yield Row(dedup_key=key[0], ord=item.ord, round=following)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        item = Item()
        for confidence, times, scores in zip(initialState["levels"], initialState["times"], initialState["scores"]):
            item.add(scores, confidence, times)
        self.state.update(item.values())

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        item, now = self._known(), timerValues.getCurrentProcessingTimeInMs()
        arrived, answers = None, {}
        for r in rows:                                          # a hot key's copies pass one by one
            if r["answered"] is None:
                arrived = min(arrived or (r["ord"], r["recent"]), (r["ord"], r["recent"]))
            else:
                answers[r["round"]] = r
        out: list[Row] = []
        answer = answers.get(item.waiting) if item.waiting else None
        if answer is not None:
            item.done = item.waiting
            if item.due:
                self.handle.deleteTimer(item.due)
            if answer["answered"]:
                item.add(answer["importance_score"], answer["confidence_score"])
            out = list(self._request(key, item, now))
        elif item.ord is None and arrived is not None:
            item.ord, recent = arrived
            if not recent:
                item.done = self.rounds                         # known, and never asked for
            out = list(self._request(key, item, now))
        self.state.update(item.values())
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        item = self._known()
        if not item.waiting or item.due > expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        item.done = item.waiting                                # given up for this round only
        out = list(self._request(key, item, timerValues.getCurrentProcessingTimeInMs()))
        self.state.update(item.values())
        return iter(out)


def history(evals: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """What the state starts from: one row per item with its evals per confidence, combined
    before the shuffle, so an item that holds most evals is one small row."""
    tallies = tally(evals)
    if keys is not None:
        tallies = tallies.join(keys.select("dedup_key"), "dedup_key", "left_semi")
    one = F.sort_array(F.collect_list(F.struct("confidence_score", "n", "scores")))
    return tallies.groupBy("dedup_key").agg(one.alias("one")).select(
        "dedup_key", F.col("one.confidence_score").alias("levels"), F.col("one.n").alias("times"), F.col("one.scores").alias("scores"))


def answered(requests: DataFrame, inputs: DataFrame, cfg: Config, providers: dict[str, Provider],
             config_col: str = "source") -> DataFrame:
    """E4-E8 for a batch of requests: one answer row each, also where no attempt was valid."""
    todo = inputs.join(requests.select("ord", "round"), "ord")
    asked = ask(todo, cfg, providers, config_col).withColumn("got", response_scores("response_text"))
    return asked.select("dedup_key", "ord", "round", "model", "prompt_hash", "got.importance_score", "got.confidence_score",
                        "got.summary", F.col("response_text").isNotNull().alias("answered"))


def stream_rounds(items: DataFrame, inputs: DataFrame, cfg: Config, providers: dict[str, Provider], rounds: int,
                  out_path: str, checkpoint: str, as_of: datetime, evals: DataFrame | None = None,
                  retry_after: float = 3600.0, idle_batches: int | None = 2, pause: str = "0 seconds",
                  answer: Callable[..., DataFrame] = answered) -> int:
    """Run rounds over a stream of ``items`` (dedup_key, ord, source, creation_date). Of an
    item's copies the first to arrive counts (the smallest ``ord`` of its micro-batch); it
    is asked for if it is recent (E1). ``inputs``
    (dedup_key, ord, title, source, input) is the landed table that requested texts are
    read from, ``evals`` the evals that exist before (E12). Answers are written to
    ``out_path``; see ``read_answers``. Runs until ``idle_batches`` micro-batches in a row
    had no requests, or there was nothing to run for QUIET_SECONDS (None: until it is
    stopped); returns the number of micro-batches."""
    spark = items.sparkSession
    use_rocksdb_state(spark)
    fs, path = file_system(spark, out_path)
    fs.mkdirs(path)
    answers = (spark.readStream.schema(ANSWER_SCHEMA).parquet(f"{out_path}/batch_id=*")
               .select("dedup_key", "ord", F.lit(True).alias("recent"), "round", "importance_score", "confidence_score", "answered"))
    none = {"round": "int", "importance_score": "int", "confidence_score": "int", "answered": "boolean"}
    dated = with_settings(items.where(F.col("dedup_key").isNotNull()), cfg, {"lookback_days": "int"})
    arriving = dated.select("dedup_key", "ord", is_recent(as_of).alias("recent"),
                            *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    start = None if evals is None else history(evals).groupBy("dedup_key")
    requests = arriving.unionByName(answers).groupBy("dedup_key").transformWithState(
        Rounds(rounds, retry_after), REQUEST_SCHEMA, "Append", "ProcessingTime", initialState=start)
    idle = {"batches": 0, "empty": 0, "running": False}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        idle["running"] = True
        try:
            idle["batches"] += 1
            idle["empty"] = idle["empty"] + 1 if batch.isEmpty() else 0
            if not idle["empty"]:
                answer(batch, inputs, cfg, providers).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        finally:
            idle["running"] = False
            batch.unpersist()

    query = (requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
             .queryName("stream_rounds").trigger(processingTime=pause).start())
    seen, quiet = -1, time.monotonic()
    try:
        while query.isActive:
            # a stream that was started again with nothing new runs no micro-batch at all
            if idle["running"] or idle["batches"] != seen or query.status["isDataAvailable"]:
                seen, quiet = idle["batches"], time.monotonic()
            if idle_batches is not None and (idle["empty"] >= idle_batches or time.monotonic() - quiet > QUIET_SECONDS):
                break
            time.sleep(0.1)
    finally:
        query.stop()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return idle["batches"]


def read_answers(spark, out_path: str) -> DataFrame:
    """The evals of a rounds stream: valid answers, one per item and round."""
    rows = spark.read.schema(ANSWER_SCHEMA).parquet(f"{out_path}/batch_id=*")
    return rows.where("answered").drop("answered").dropDuplicates(["dedup_key", "round"])
