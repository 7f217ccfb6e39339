"""Nearest neighbours by inner product over vantage-point trees, one tree per shard.

With M the greatest norm of a shard, a row x becomes (x, sqrt(M^2 - |x|^2)) / M and a
query q becomes (q, 0) / |q|: points of the unit sphere whose angle falls as the inner
product rises, and angles obey the triangle inequality. A tree node has a vantage row and
halves its rows by their angle to it; each half keeps the least and greatest such angle.
A query at angle d from the vantage row is at least gap = max(least - d, d - greatest)
from every row of the half, which is skipped if ``factor * gap`` is over the angle of the
query's current k-th best. Factor 1 skips nothing that could be nearer (exact search);
larger factors skip more and may miss some.

Rows are dealt to shards by a hash, so shards are even whatever the vectors are, and each
shard's tree is built in one task and stored as one row. Queries travel in chunks to the
shards. About the square root of the number of shards is searched first; the k-th best
found there is the bound that every other shard starts from, so the others prune from the
first node on and return few rows.

Final scores are summed in double precision in the order of the components, so they do not
depend on the layout, and ties go to the smaller key. Vectors that are null, empty, zero or
hold null or non-finite components, and rows without a key, take no part. Vectors of
different lengths never meet. A row repeated in full counts once; rows that share a key but
not the vector are rows of their own, never neighbours of each other, and each of them
that is a query gets its own result. Columns other than key and vector are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import written

#: Rows of a shard, queries of a chunk, rows of a tree's leaf.
SHARD_ROWS, CHUNK_ROWS, LEAF_ROWS = 4096, 2048, 64
#: Relaxation of the triangle inequality. On 64 unrelated dimensions larger factors lose more
#: neighbours than they save work (figures in the README), so the default is exact.
FACTOR = 1.0
#: Angles (radians) within this are taken as equal, against rounding.
SLACK = 1e-6
SEED = 13


class Tree:
    """rows: vectors in leaf order; nodes: (vantage row, begin, middle, end, inner child,
    outer child), children -1 at a leaf; spans: least and greatest angle of both halves."""

    def __init__(self, rows: np.ndarray, nodes: np.ndarray, spans: np.ndarray) -> None:
        self.rows, self.nodes, self.spans = rows, nodes, spans
        self.norm = math.sqrt((rows * rows).sum(axis=1).max())

    @staticmethod
    def build(vectors: np.ndarray, leaf: int = LEAF_ROWS) -> tuple["Tree", np.ndarray]:
        """The tree, and the place of each of its rows in vectors."""
        squares = (vectors * vectors).sum(axis=1)
        top = math.sqrt(squares.max())
        points = np.column_stack([vectors, np.sqrt(np.maximum(top * top - squares, 0))]) / top
        rng, order = np.random.default_rng(SEED), np.arange(len(vectors))
        nodes, spans, todo = [], [], [(0, len(vectors), -1, 0)]
        while todo:
            begin, end, parent, side = todo.pop()
            if parent >= 0:
                nodes[parent][4 + side] = len(nodes)
            own = order[begin:end]
            if end - begin <= leaf:
                nodes.append([-1, begin, end, end, -1, -1])
                spans.append([0.0] * 4)
                continue
            # of a few rows, the one whose angles to a few others differ most
            some, others = (rng.choice(own, min(n, len(own)), replace=False) for n in (8, 64))
            vantage = int(some[np.argmax(np.arccos(np.clip(points[some] @ points[others].T, -1, 1)).std(axis=1))])
            angle = np.arccos(np.clip(points[own] @ points[vantage], -1, 1))
            half = (end - begin) // 2
            cut = np.argpartition(angle, half)
            order[begin:end], angle = own[cut], angle[cut]
            todo += [(begin + half, end, len(nodes), 1), (begin, begin + half, len(nodes), 0)]
            nodes.append([vantage, begin, begin + half, end, -1, -1])
            spans.append([angle[:half].min(), angle[:half].max(), angle[half:].min(), angle[half:].max()])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        made = np.array(nodes, np.int32)
        inner = made[:, 0] >= 0
        made[inner, 0] = place[made[inner, 0]]
        return Tree(vectors[order], made, np.array(spans)), order

    def search(self, queries: np.ndarray, bound: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int,
               factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(query, row) of the rows found that reach a query's bound and its k-th best score
        here, ties included, and the number of scores computed. own: (query, row) that do
        not count, ordered by row."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        top = np.full((len(queries), k), -np.inf)
        least, angle = bound.copy(), np.full(len(queries), np.pi)
        margin = 1e-12 * norms * self.norm * queries.shape[1]
        seen, found, scored = np.zeros((len(queries), len(self.nodes)), bool), [], 0

        def narrow(q: np.ndarray) -> None:
            angle[q] = np.arccos(np.clip(least[q] / (norms[q] * self.norm), -1, 1))

        def visit(node: int, q: np.ndarray) -> None:
            nonlocal scored
            _, begin, _, end, _, _ = self.nodes[node]
            q = q[~seen[q, node]]
            seen[q, node] = True
            scored += len(q) * (end - begin)
            score = queries[q] @ self.rows[begin:end].T
            lo, hi = np.searchsorted(own[1], (begin, end))
            slot = np.full(len(queries), -1)
            slot[q] = np.arange(len(q))
            at = slot[own[0][lo:hi]]
            score[at[at >= 0], own[1][lo:hi][at >= 0] - begin] = -np.inf
            good = (score >= (least[q] - margin[q])[:, None]) & (score > -np.inf)
            i, j = np.nonzero(good)
            found.append((q[i], j + begin, score[i, j]))
            better = np.flatnonzero((score > least[q][:, None]).any(axis=1))
            if len(better):
                mine = q[better]
                top[mine] = -np.partition(-np.concatenate([top[mine], score[better]], axis=1), k - 1, axis=1)[:, :k]
                least[mine] = np.maximum(least[mine], top[mine, k - 1])
                narrow(mine)

        def angles(node: int, q: np.ndarray) -> np.ndarray:
            return np.arccos(np.clip(queries[q] @ self.rows[self.nodes[node][0]] / (norms[q] * self.norm), -1, 1))

        everyone = np.arange(len(queries))
        known = np.isfinite(bound)
        narrow(np.flatnonzero(known))
        # the leaf on the nearer side at each node, for a first bound
        todo = [(0, everyone)]
        while todo:
            node, q = todo.pop()
            if self.nodes[node][4] < 0:
                visit(node, q)
                continue
            d, (_, a, b, _) = angles(node, q), self.spans[node]
            inner = d < (a + b) / 2
            todo += [(child, part) for child, part in ((self.nodes[node][4], q[inner]), (self.nodes[node][5], q[~inner])) if len(part)]
        todo = [(0, everyone, np.zeros(len(queries)))]
        while todo:
            node, q, gap = todo.pop()
            q = q[factor * gap <= angle[q] + SLACK]
            if not len(q):
                continue
            if self.nodes[node][4] < 0:
                visit(node, q)
                continue
            d, (a, b, c, e) = angles(node, q), self.spans[node]
            todo += [(self.nodes[node][5], q, np.maximum(c - d, d - e)), (self.nodes[node][4], q, np.maximum(a - d, d - b))]
        q, row, score = (np.concatenate(x) for x in zip(*found))
        good = score >= least[q] - margin[q]
        return q[good], row[good], scored


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed component by component from the first on."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part, each once: key k, vector x (doubles), its length d and a hash."""
    x = F.col("x")
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x"))
    fine = ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = rows.filter(F.col("k").isNotNull() & x.isNotNull()).filter(F.coalesce(fine & F.exists("x", lambda e: e != 0), F.lit(False)))
    rows = rows.select("k", F.transform("x", lambda e: e + F.lit(0.0)).alias("x"))
    return (rows.groupBy("k", F.xxhash64("x").alias("mark")).agg(F.first("x").alias("x"))
            .select("k", "mark", "x", F.size("x").alias("d")))


def doubles(column: pa.Array) -> np.ndarray:
    """A list column of lists of one length as a matrix."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def build_index(rows: DataFrame, shards: int, leaf: int) -> DataFrame:
    """One row per shard and vector length: its keys in leaf order and its tree."""
    kind = rows.schema["k"].dataType.simpleString()
    dealt = rows.select("k", "x", "d", F.pmod(F.xxhash64("k", "mark", F.lit(SEED)), F.lit(shards)).cast("int").alias("shard"))

    def run(key, table):
        # the order of arrival is not fixed
        table = table.combine_chunks()
        keys = table["k"].combine_chunks()
        vectors = doubles(table["x"].combine_chunks())
        order = np.lexsort((*vectors.T[::-1], np.asarray(pa.compute.rank(keys, tiebreaker="dense"))))
        tree, place = Tree.build(vectors[order], leaf)
        keys = keys.take(pa.array(order[place]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "d": pa.array([key[1].as_py()], pa.int32()),
                         "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                         **{n: pa.array([x.tobytes()], pa.binary()) for n, x in
                            (("rows", tree.rows), ("nodes", tree.nodes), ("spans", tree.spans))}})

    return dealt.groupBy("shard", "d").applyInArrow(
        run, f"shard int, d int, keys array<{kind}>, rows binary, nodes binary, spans binary")


def search_shards(chunks: DataFrame, index: DataFrame, shards: Column, kind: str, k: int, factor: float) -> DataFrame:
    """Rows (q, mark, k, score) found for the queries of the chunks in the given shards."""
    pairs = chunks.withColumn("shard", F.explode(shards)).join(index, ["shard", "d"]).select(
        "q", "marks", "x", "bound", "keys", "rows", "nodes", "spans")

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                one = {c: batch[c][n] for c in batch.schema.names}
                d = len(one["x"].values[0])
                q, keys = one["q"].values, one["keys"].values
                queries, bound = doubles(one["x"].values), np.asarray(one["bound"].values, dtype=np.float64)
                tree = Tree(np.frombuffer(one["rows"].as_py()).reshape(-1, d),
                            np.frombuffer(one["nodes"].as_py(), dtype=np.int32).reshape(-1, 6),
                            np.frombuffer(one["spans"].as_py()).reshape(-1, 4))
                i, r, _ = tree.search(queries, bound, same(q, keys), k, factor)
                score = exact_scores(queries[i], tree.rows[r])
                rank = np.asarray(pa.compute.rank(keys, tiebreaker="dense"))
                order = np.lexsort((rank[r], -score, i))
                i, r, score = i[order], r[order], score[order]
                head = np.searchsorted(i, i)
                best = np.arange(len(i)) - head < k
                i, r, score = i[best], r[best], score[best]
                yield pa.RecordBatch.from_arrays([q.take(pa.array(i)), one["marks"].values.take(pa.array(i)),
                                                  keys.take(pa.array(r)), pa.array(score)], names=["q", "mark", "k", "score"])

    return pairs.mapInArrow(run, f"q {kind}, mark long, k {kind}, score double")


def same(q: pa.Array, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place in q, place in keys) of equal keys, ordered by the place in keys."""
    codes = pa.concat_arrays([q, keys]).dictionary_encode().indices.to_numpy()
    a, b = codes[:len(q)], codes[len(q):]
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, side="left"), np.searchsorted(b[order], a, side="right")
    left = np.repeat(np.arange(len(a)), hi - lo)
    right = order[np.arange(len(left)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    by = np.argsort(right, kind="stable")
    return left[by], right[by]


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q", "mark").orderBy(F.desc("score"), "k")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def neighbours(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
               factor: float = FACTOR, shard_rows: int = SHARD_ROWS, chunk_rows: int = CHUNK_ROWS,
               leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The k rows of greatest inner product found for each row that is_query (a condition on the
    column k, the key) marks: query_id, rank from 1, key (as vec_id), score; all other rows
    if there are fewer."""
    if factor < 1:
        raise ValueError("factor must be at least 1")
    kind = df.schema[key].dataType.simpleString()
    rows = written(usable(df, key, vector), "vectors")
    asked = rows.filter(is_query)
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("m")).first()
    shards, parts = max(1, -(-sizes["n"] // shard_rows)), max(1, -(-sizes["m"] // chunk_rows))
    index = written(build_index(rows, shards, leaf_rows), "trees", "uncompressed")
    chunk = F.pmod(F.xxhash64("k", "mark"), F.lit(parts)).cast("int").alias("chunk")

    def packed(queries: DataFrame) -> DataFrame:
        one = F.sort_array(F.collect_list(F.struct("k", "mark", "x", "bound")))
        return queries.groupBy(chunk, "d").agg(one.alias("one")).select(
            "d", F.col("one.k").alias("q"), F.col("one.mark").alias("marks"), F.col("one.x").alias("x"), F.col("one.bound").alias("bound"))

    first = math.isqrt(shards - 1) + 1
    open_ended = asked.withColumn("bound", F.lit(float("-inf")))
    start = written(best(search_shards(packed(open_ended), index, F.sequence(F.lit(0), F.lit(first - 1)), kind, k, factor), k), "first-shards")
    if first == shards:
        found = start
    else:
        reached = start.filter(F.col("rank") == k).select(F.col("q").alias("k"), "mark", F.col("score").alias("bound"))
        bounded = asked.join(reached, ["k", "mark"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        rest = search_shards(packed(bounded), index, F.sequence(F.lit(first), F.lit(shards - 1)), kind, k, factor)
        found = best(start.drop("rank").unionByName(rest), k)
    return found.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("k").alias(key), "score")
