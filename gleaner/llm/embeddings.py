"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are scaled to unit length, where the cosine threshold is a distance. Each of
``tables`` tables hashes a vector to the floors of ``projections`` Gaussian projections,
shifted and divided by ``width``; vectors with equal hash values meet in a bucket and
are compared by exact cosine in double precision. With the defaults a pair just at a
cosine of 0.95 meets in some table with a probability of 0.96 (a closer pair with more),
an unrelated pair with 3e-4.

Equal vectors are collapsed first and count as often as they occur. A pair is counted in
the first table in which it meets, which both vectors' hash values tell, so no pair is
ever emitted: a bucket yields partial link counts and a spanning star per linked group.
Buckets of more than ``BLOCK`` vectors are dealt out as pairs of blocks, so one hot
bucket is many small tasks.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and keep their row, as do vectors whose length differs from all others. Null
ids and repeated rows keep their rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import checkpointed, components, written

TABLES, PROJECTIONS, WIDTH = 28, 16, 2.0
#: Vectors of one bucket compared with each other in one go.
BLOCK = 1024
SEED = 11


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def bucket_keys(vectors: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """One 64-bit bucket per vector and table."""
    rng = np.random.default_rng([SEED, vectors.shape[1]])
    a = rng.standard_normal((vectors.shape[1], tables * projections))
    b = rng.uniform(0, width, tables * projections)
    mix = rng.integers(1, 1 << 62, tables * projections, dtype=np.uint64) | np.uint64(1)
    cells = np.floor((vectors @ a + b) / width).astype(np.int64).view(np.uint64)
    keys = (cells * mix).reshape(len(vectors), tables, projections).sum(axis=2, dtype=np.uint64)
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    return (keys ^ keys >> np.uint64(32)).view(np.int64)


def hashed(reps: DataFrame, tables: int, projections: int, width: float) -> DataFrame:
    """Distinct vectors (columns v, vector, and others) with the vector as unit doubles in
    binary form and its bucket keys, as an array and in binary form."""
    keep = [c for c in reps.columns if c != "vector"]

    def run(batches):
        for batch in batches:
            values = batch["vector"].to_pylist()
            out: list = [None] * len(values)
            sizes = np.array([len(x) for x in values])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                scaled = unit(np.array([values[i] for i in at], dtype=np.float64))
                for i, x, k in zip(at, scaled, bucket_keys(scaled, tables, projections, width)):
                    out[i] = (x.tobytes(), k.tobytes(), k, size)
            if out:
                x, code, keys, d = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(keep).columns, pa.array(x, pa.binary()), pa.array(code, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(d, pa.int32())],
                    names=[*keep, "unit", "code", "keys", "d"])

    new = T._parse_datatype_string("unit binary, code binary, keys array<bigint>, d int")
    return reps.mapInArrow(run, T.StructType([*(reps.schema[c] for c in keep), *new.fields]))


def linked(left: dict, right: dict | None, table: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Exact links between two blocks (or within one), counted in their first table:
    (row, weight) of the counts and (a, b) of the spanning star."""
    both = left if right is None else {k: np.concatenate([left[k], right[k]]) for k in left}
    x, y = both["vector"], (both if right is None else right)["vector"]
    shift = len(x) - len(y)                        # y is the tail of both
    counts = np.zeros(len(x), dtype=np.int64)
    label = np.arange(len(x))
    rows = len(x) if right is None else shift
    near = (x[:rows] @ y.T) >= threshold
    if table:
        kx, ky = both["keys"][:rows], both["keys"][shift:]
        for t in range(table):
            near &= kx[:, t][:, None] != ky[:, t][None, :]
    if right is None:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    j = j + shift
    np.add.at(counts, i, both["n"][j])
    np.add.at(counts, j, both["n"][i])
    while len(i):                                  # labels sink to the smallest row of the group
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    first = np.flatnonzero(label != np.arange(len(x)))
    at = np.flatnonzero(counts)
    return both["v"][at], counts[at], both["v"][label[first]], both["v"][first]


def compare(reps: DataFrame, tables: int, threshold: float) -> DataFrame:
    """Per distinct vector and bucket with a link: (a, b, n); n counts a's links there,
    b is a vector that a is connected with, or null."""
    buckets = reps.select("v", "d", F.posexplode("keys").alias("t", "key"))
    sizes = checkpointed(buckets.groupBy("t", "key", "d").agg(F.count("*").alias("size")).filter("size > 1")
                         .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")))
    own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    met = buckets.join(sizes, ["t", "key", "d"]).withColumn("own", own)
    tasks = met.select("v", "t", "key", "d", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("v", "t", "key", "d", "own", F.least("own", "other").alias("lo"),
                         F.greatest("own", "other").alias("hi"))
    full = tasks.join(reps.select("v", "unit", "code", "n"), "v")
    group = ["t", "key", "d", "lo", "hi"]
    dealt = full.repartition(*group).sortWithinPartitions(*group, "own").select(*group, "own", "v", "unit", "code", "n")

    def block(rows: list[tuple]) -> dict:
        return {"v": np.array([r[0] for r in rows], dtype=np.int64), "n": np.array([r[3] for r in rows], dtype=np.int64),
                "vector": np.frombuffer(b"".join(r[1] for r in rows)).reshape(len(rows), -1),
                "keys": np.frombuffer(b"".join(r[2] for r in rows), dtype=np.int64).reshape(len(rows), -1)}

    def solve(key: tuple, rows: list[tuple[int, tuple]]):
        sides = [block([r for own, r in rows if own == side]) for side in dict.fromkeys((key[3], key[4]))
                 if any(own == side for own, _ in rows)]
        if len(sides) < len({key[3], key[4]}) or len(rows) < 2:
            return None
        return linked(sides[0], sides[1] if len(sides) > 1 else None, key[0], threshold)

    def run(batches):
        key, rows = None, []
        for batch in itertools.chain(batches, [None]):
            out = []
            if batch is None:
                out.append(solve(key, rows) if rows else None)
            else:
                columns = [batch[c].to_pylist() for c in (*group, "own", "v", "unit", "code", "n")]
                for r in zip(*columns):
                    if r[:5] != key:
                        if rows:
                            out.append(solve(key, rows))
                        key, rows = r[:5], []
                    rows.append((r[5], r[6:]))
            out = [x for x in out if x is not None and len(x[0])]
            if out:
                v, n, a, b = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([v, b])), pa.array([None] * len(v) + a.tolist(), pa.int64()),
                     pa.array(np.concatenate([n, np.zeros(len(b), np.int64)]))], names=["a", "b", "n"])

    return dealt.mapInArrow(run, "a long, b long, n long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95,
                    tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> DataFrame:
    """One row per input row: key, n_links (other rows linked directly), component_id
    (smallest key reachable) and kept (key = component_id)."""
    x = F.col("x")
    valid = (F.size("x") > 0) & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    valid = F.coalesce(valid & F.exists("x", lambda e: e != 0), F.lit(False))
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x"))
    # -0.0 and 0.0 are one value; equal vectors share a mark of 128 bits
    plain = F.transform("x", lambda e: e + F.lit(0.0))
    rows = rows.withColumn("x", F.when(valid, plain))
    mark = F.md5(F.concat_ws(",", F.transform(x, lambda e: e.cast("string"))))
    rows = rows.withColumn("mark", F.when(x.isNotNull(), mark))
    reps = (rows.filter(x.isNotNull()).groupBy("mark")
            .agg(F.min("k").alias("low"), F.first("x").alias("vector"), F.count("*").alias("n"))
            .select("mark", "low", "vector", "n", F.xxhash64("mark").alias("v")))
    reps = checkpointed(hashed(reps, tables, projections, width))
    found = checkpointed(compare(reps, tables, threshold))
    counts = found.groupBy("a").agg(F.sum("n").alias("links"))
    labels = components(found.filter("b is not null"))
    named = checkpointed(reps.select("mark", "low", "n", "v")
                         .join(counts.withColumnRenamed("a", "v"), "v", "left")
                         .join(labels.withColumnRenamed("node", "v"), "v", "left")
                         .select("mark", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                                 F.coalesce("label", "v").alias("label")))
    lowest = written(named.groupBy("label").agg(F.min("low").alias("lowest"), F.count("*").alias("of"))
                     .filter("of > 1").select("label", "lowest"), "lowest")
    named = named.join(lowest, "label", "left").select("mark", "links", F.coalesce("lowest", "low").alias("lowest"))
    named = written(named, "vectors")
    return rows.select("k", "mark").join(named, "mark", "left").select(
        F.col("k").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("lowest", "k").alias("component_id"),
        F.coalesce(F.col("k") == F.coalesce("lowest", "k"), F.lit(True)).alias("kept"))
