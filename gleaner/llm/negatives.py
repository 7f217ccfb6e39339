"""Hard negatives from Hilbert-ordered blocks with zone maps.

Components become integers (floor of ``scale`` times the component), so scores, the inner
products with an anchor, are exact. For every anchor its first ``positives`` other rows of
the same label are found, and for each of these the first ``negatives`` rows of other
labels whose score lies in the positive's window, from ``percent`` per cent of the
positive's score up to that score. Higher scores come first, ties by the smaller key.

Layout: rows are range-sorted by label, then by their place on a Hilbert curve through a
coarse grid of the components, and stored in Parquet as blocks of one label, each with the
least and greatest value of every component (its zone map). Interval arithmetic on a zone
map bounds the score of every row of a block from both sides.

Search, the same for positives (one window without limits an anchor) and negatives (one
window a positive): the zone maps are read, and each window names the blocks to read. First
the most promising by upper bound, about the square root of the number of blocks; the last
score of a full list found there becomes the window's floor. Then every block of a fitting
label whose bounds meet the window above the floor. A block that no window of a chunk of
anchors names is not read for that chunk, and rows below the floor leave no trace, so what
is shuffled is small beside the scores computed.

Rows with a null key, null label, null or empty vector, or a null or non-finite component
take no part, nor do rows with a component so large that scores might not fit in 63 bits
(over 2^31, or over 2^31 divided by the root of the vector's length). Vectors of different
lengths never meet. A row repeated in full counts once; rows that share a key but differ in
label or vector are rows of their own, never partners of each other. A label or a group of
copies that holds most rows is many blocks. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import written
from gleaner.llm.vantage import doubles, same

#: Rows of a block, blocks of a stored part (about), parts whose zone maps are one row,
#: anchors of a chunk.
BLOCK_ROWS, PART_BLOCKS, ZONE_PARTS, CHUNK_ROWS = 512, 16, 64, 512
#: Bits a component has on the Hilbert grid, which spans SPAN root mean squares to both sides.
BITS, SPAN = 3, 2.0
OPEN = 1 << 62


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of points of a grid of 2^bits cells a dimension, as byte
    strings in curve order (axes are turned and flipped level by level, then Gray-coded)."""
    x = cells.T.astype(np.int64).copy()
    top = 1 << bits - 1
    level = top
    while level > 1:
        low = level - 1
        for axis in range(len(x)):
            flip = (x[axis] & level) > 0
            swap = np.where(flip, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[axis] ^= swap
        level >>= 1
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], np.int64)
    level = top
    while level > 1:
        turn ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= turn
    planes = [(x >> bit & 1).T for bit in reversed(range(bits))]
    packed = np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer product of a and the transpose of b."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each anchor in each block."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(plus, low) + product(minus, high), product(plus, high) + product(minus, low)


def whole_numbers(df: DataFrame, key: str, label: str, vector: str, scale: float) -> DataFrame:
    """Rows that take part, each once: k, l (label as text), c (integers), d and a hash."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda e: e * F.lit(float(scale)))
    rows = df.select(F.col(key).alias("k"), F.col(label).cast("string").alias("l"), x.alias("x"), F.size(vector).alias("d"))
    most = F.least(F.lit(2.0 ** 31 - 1), F.lit(2.0 ** 31) / F.sqrt(F.greatest("d", F.lit(1))))
    fits = F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < most), F.lit(False)))
    rows = rows.filter(F.col("k").isNotNull() & F.col("l").isNotNull() & F.col("x").isNotNull() & (F.col("d") > 0)).filter(fits)
    rows = rows.select("k", "l", "d", F.transform("x", lambda e: F.floor(e).cast("int")).alias("c"))
    return rows.groupBy("k", "l", F.xxhash64("c").alias("mark")).agg(F.first("c").alias("c"), F.first("d").alias("d"))


def store_blocks(rows: DataFrame, parts: int, block_rows: int) -> DataFrame:
    """The block files: part, block, label, length, keys (ascending) and rows of each block,
    and its zone map."""
    kind = rows.schema["k"].dataType.simpleString()
    square = F.aggregate("c", F.lit(0.0), lambda s, e: s + e.cast("double") * e)
    spread = max(1e-9, math.sqrt(rows.agg(F.avg(square / F.col("d"))).first()[0] or 0.0))

    def place(batches):
        for batch in batches:
            sizes = np.asarray(batch["d"])
            out: list = [b""] * len(sizes)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                c = doubles(batch["c"].take(pa.array(at)))
                cells = np.clip(np.floor((c / spread / SPAN + 1) * (1 << BITS - 1)), 0, (1 << BITS) - 1)
                for i, where in zip(at, hilbert_keys(cells, BITS)):
                    out[i] = where
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "place"])

    order = ["l", "d", "place", "k", "mark"]
    placed = rows.select("l", "d", "k", "mark", "c").mapInArrow(
        place, f"l string, d int, k {kind}, mark long, c array<int>, place binary")
    dealt = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("l", "d", "k", "c")

    def block(part: int, number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        keys, c = rows["k"].combine_chunks(), doubles(rows["c"].combine_chunks()).astype(np.int32)
        by = pa.compute.sort_indices(keys)
        c = c[np.asarray(by)]
        keys = keys.take(by)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([part << 32 | number], pa.int64()), rows["l"].combine_chunks()[:1],
             rows["d"].combine_chunks()[:1], pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
             *(pa.array([x.tobytes()], pa.binary()) for x in (c, c.min(axis=0), c.max(axis=0)))],
            names=["part", "block", "l", "d", "keys", "rows", "low", "high"])

    def cut(batches):
        part, number, held, name, count = TaskContext.get().partitionId(), 0, [], None, 0
        for batch in batches:
            labels, sizes = batch["l"].to_pylist(), batch["d"].to_pylist()
            start = 0
            for i, now in enumerate([*zip(labels, sizes), None]):
                full = count + i - start == block_rows
                if now is not None and now == name and not full:
                    continue
                if i > start:
                    held.append(batch.slice(start, i - start))
                    count += i - start
                if now is None:
                    break
                if held:
                    yield block(part, number, held)
                    number += 1
                start, name, held, count = i, now, [], 0
        if held:
            yield block(part, number, held)

    return dealt.mapInArrow(cut, f"part int, block long, l string, d int, keys array<{kind}>, rows binary, low binary, high binary")


def fitting(one: dict, labels: list, own_label: bool) -> np.ndarray:
    """Which windows may look into blocks of these labels."""
    asked = np.array(one["ls"].values.to_pylist(), dtype=object)[numbers(one["wins"], "slot")]
    return (asked[:, None] == np.array(labels, dtype=object)[None, :]) == own_label


def numbers(structs: pa.Scalar, field: str) -> np.ndarray:
    return np.asarray(structs.values.field(field))


def blocks_to_read(asked: DataFrame, zones: DataFrame, packs: int, total: int, own_label: bool, first: bool) -> DataFrame:
    """(chunk, d, part, blocks, masks): blocks that some window of a chunk names, each with
    the bits of the windows. first: the most promising only, else all others that fit."""
    pairs = asked.withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).join(zones, ["zone", "d"]).select(
        "chunk", "d", "ls", "c", "wins", "blocks", "parts", "labels", "low", "high")
    share = 1 / math.sqrt(max(1, total))

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                one = {c: batch[c][n] for c in batch.schema.names}
                d = one["d"].as_py()
                c = doubles(one["c"].values).astype(np.int64)
                low, high = (np.frombuffer(b"".join(one[x].as_py()), dtype=np.int32).reshape(-1, d) for x in ("low", "high"))
                least, most = (x[numbers(one["wins"], "slot")] for x in score_bounds(c, low, high))
                open_to = fitting(one, one["labels"].as_py(), own_label)
                open_to &= (most >= numbers(one["wins"], "low")[:, None]) & (least <= numbers(one["wins"], "high")[:, None])
                # of the blocks open to a window at first, its share by upper bound
                many = np.ceil(open_to.sum(axis=1) * share)
                rank = np.argsort(np.argsort(-np.where(open_to, most, -OPEN - 1), axis=1, kind="stable"), axis=1)
                early = open_to & (rank < many[:, None])
                named = early if first else open_to & ~early & (most >= numbers(one["wins"], "floor")[:, None])
                blocks, parts = (np.asarray(one[x].values) for x in ("blocks", "parts"))
                used = named.any(axis=0)
                for part in np.unique(parts[used]):
                    at = np.flatnonzero(used & (parts == part))
                    masks = [np.packbits(named[:, i]).tobytes() for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([one["chunk"].as_py()], pa.int64()), pa.array([d], pa.int32()), pa.array([part], pa.int32()),
                         pa.array([blocks[at].tolist()], pa.list_(pa.int64())), pa.array([masks], pa.list_(pa.binary()))],
                        names=["chunk", "d", "part", "named", "masks"])

    return pairs.mapInArrow(run, "chunk long, d int, part int, named array<bigint>, masks array<binary>")


def read_blocks(asked: DataFrame, named: DataFrame, blocks: DataFrame, kind: str, most: int) -> DataFrame:
    """(chunk, slot, w, k, score): the first rows of each window in each block it names."""
    stored = blocks.select("part", "block", "keys", "rows")
    pairs = named.join(asked, ["chunk", "d"]).join(stored, "part").filter(F.array_contains("named", F.col("block"))).select(
        "chunk", "d", "q", "c", "wins", "keys", "rows",
        F.element_at("masks", F.array_position("named", F.col("block")).cast("int")).alias("mask"))

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                one = {c: batch[c][n] for c in batch.schema.names}
                d, wins, keys = one["d"].as_py(), one["wins"], one["keys"].values
                names = np.flatnonzero(np.unpackbits(np.frombuffer(one["mask"].as_py(), np.uint8), count=len(wins.values)))
                slots = numbers(wins, "slot")[names]
                asking, which = np.unique(slots, return_inverse=True)
                c = doubles(one["c"].values).astype(np.int64)[asking]
                score = product(c, np.frombuffer(one["rows"].as_py(), dtype=np.int32).reshape(-1, d))
                fits = np.ones(score.shape, bool)
                i, j = same(one["q"].values.take(pa.array(asking)), keys)
                fits[i, j] = False
                every = score[which]
                good = fits[which] & (every >= numbers(wins, "floor")[names][:, None]) & (every <= numbers(wins, "high")[names][:, None])
                w, j = np.nonzero(good)
                order = np.lexsort((j, -every[w, j], w))            # the keys of a block ascend
                w, j = w[order], j[order]
                head = np.arange(len(w)) - np.searchsorted(w, w) < most
                w, j = w[head], j[head]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(w), one["chunk"].as_py()), pa.int64()), pa.array(slots[w], pa.int32()),
                     pa.array(numbers(wins, "w")[names][w], pa.int32()), keys.take(pa.array(j)), pa.array(every[w, j], pa.int64())],
                    names=["chunk", "slot", "w", "k", "score"])

    return pairs.mapInArrow(run, f"chunk long, slot int, w int, k {kind}, score long")


def first_rows(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("chunk", "slot", "w").orderBy(F.desc("score"), "k")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def search(anchors: DataFrame, windows: DataFrame, layout: tuple, own_label: bool, most: int, name: str) -> DataFrame:
    """The first rows of every window (chunk, slot, w, low, high): chunk, slot, w, k, score, rank."""
    blocks, zones, packs, total, kind = layout

    def asked(wins: DataFrame) -> DataFrame:
        packed = wins.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("slot", "w", "low", "high", "floor"))).alias("wins"))
        return written(anchors.join(packed, "chunk"), f"{name}-windows")

    def read(chunks: DataFrame, first: bool) -> DataFrame:
        return read_blocks(chunks, blocks_to_read(chunks, zones, packs, total, own_label, first), blocks, kind, most)

    start = asked(windows.withColumn("floor", F.col("low")))
    early = written(first_rows(read(start, True), most), f"{name}-first")
    floors = early.filter(F.col("rank") == most).select("chunk", "slot", "w", F.col("score").alias("floor"))
    rest = asked(windows.join(floors, ["chunk", "slot", "w"], "left").withColumn("floor", F.coalesce("floor", "low")))
    return first_rows(early.drop("rank").unionByName(read(rest, False)), most)


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
         scale: float = 256, positives: int = 5, negatives: int = 5, percent: int = 80, block_rows: int = BLOCK_ROWS,
         chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score. is_anchor is a condition on the column k, the
    key. A positive with a negative score has an empty window."""
    kind = df.schema[key].dataType.simpleString()
    rows = written(whole_numbers(df, key, label, vector, scale), "whole-numbers")
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("m")).first()
    parts = max(1, -(-sizes["n"] // (block_rows * PART_BLOCKS)))
    blocks = written(store_blocks(rows, parts, block_rows), "blocks")
    there = blocks.agg(F.max("part").alias("last"), F.count("*").alias("blocks")).first()
    one = F.sort_array(F.collect_list(F.struct("block", "part", "l", "low", "high")))
    zone = F.floor(F.col("part") / ZONE_PARTS).cast("int").alias("zone")
    zones = written(blocks.groupBy(zone, "d").agg(one.alias("one")).select(
        "zone", "d", F.col("one.block").alias("blocks"), F.col("one.part").alias("parts"), F.col("one.l").alias("labels"),
        F.col("one.low").alias("low"), F.col("one.high").alias("high")), "zone-maps")
    layout = (blocks, zones, (there["last"] or 0) // ZONE_PARTS + 1, there["blocks"], kind)
    # a chunk holds anchors of one vector length, which is part of its number
    deal = F.pmod(F.xxhash64("k", "mark"), F.lit(max(1, -(-sizes["m"] // chunk_rows))))
    packed = rows.filter(is_anchor).groupBy((deal * F.lit(1 << 31) + F.col("d")).alias("chunk"), "d").agg(
        F.sort_array(F.collect_list(F.struct("k", "mark", "l", "c"))).alias("one"))
    anchors = written(packed.select("chunk", "d", F.col("one.k").alias("q"), F.col("one.l").alias("ls"), F.col("one.c").alias("c")), "anchors")
    each = anchors.select("chunk", F.posexplode("q").alias("slot", "anchor"))
    whole = each.select("chunk", "slot", F.lit(0).alias("w"), F.lit(-OPEN).alias("low"), F.lit(OPEN).alias("high"))
    good = written(search(anchors, whole, layout, True, positives, "positives").select(
        "chunk", "slot", F.col("rank").alias("w"), F.col("k").alias("positive"), F.col("score").alias("reached")), "positives")
    hundreds, rest = F.floor(F.col("reached") / 100), F.pmod("reached", F.lit(100))
    least = (hundreds * percent + F.ceil(rest * percent / F.lit(100.0))).cast("long")
    windows = good.filter("reached >= 0").select("chunk", "slot", "w", least.alias("low"), F.col("reached").alias("high"))
    found = search(anchors, windows, layout, False, negatives, "negatives")
    return found.join(good, ["chunk", "slot", "w"]).join(each, ["chunk", "slot"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("k").alias("negative_id"), F.col("reached").alias("positive_score"), F.col("score").alias("negative_score"))
