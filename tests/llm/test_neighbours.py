"""Nearest neighbours and hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import negatives, vantage

SCHEMA = "vec_id long, embedding array<float>, label int, k string, x int, mark int, shard int, part int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if e is None else float(e) for e in v], lab, "k", 1, 2, 3, 4, 5)
                                  for k, v, lab in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for i in range(700):
        v = rng.normal(size=12)
        out.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(0, 4))))
    centre = rng.normal(size=12)
    for i in range(700, 1000):                                            # a hot group of near copies
        v = centre + 0.02 * rng.normal(size=12)
        out.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), 1 if i % 3 else 2))
    out += [(1000 + i, out[5][1], i % 3) for i in range(40)]              # exact copies: ties
    out += [(1100 + i, [float(e) for e in rng.integers(-2, 3, 12)], i % 4) for i in range(60)]   # long ones, many ties
    out += [(1200, None, 1), (1240, [0.0] * 12, 1), (1260, [1.0, None] * 6, 1), (1280, [float("nan")] * 12, 2),
            (1300, [float("inf")] + [0.0] * 11, 0), (None, out[3][1], 1), (1320, [], 0), (1340, [1.0, 2.0, 3.0], 1),
            (1341, [3.0, 2.0, 1.0], 1), (1360, [1.0] * 12, None), (20, out[20][1], out[20][2]), (40, out[41][1], 3)]
    return out


def sound(v, zero=False):
    return v is not None and len(v) > 0 and all(e is not None and math.isfinite(e) for e in v) and (zero or any(v))


def inner(a, b):
    total = 0.0                                                  # sum() would compensate for rounding
    for x, y in zip(a, b):
        total += x * y
    return total


def nearest(rows, step, k):
    ok = sorted({(i, tuple(np.float32(v).tolist())) for i, v, _ in rows if i is not None and sound(v)})
    out = []
    for q, a in ok:
        if q % step:
            continue
        scored = sorted((-inner(a, b), i) for i, b in ok if i != q and len(b) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, chunk_rows, leaf_rows", [(5000, 5000, 16), (150, 9, 8), (40, 30, 64)])
def test_factor_one_is_exact(spark, rows, shard_rows, chunk_rows, leaf_rows):
    found = vantage.neighbours(table(spark, rows), F.col("k") % 20 == 0, k=7, factor=1, shard_rows=shard_rows,
                               chunk_rows=chunk_rows, leaf_rows=leaf_rows)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == nearest(rows, 20, 7)


def test_fewer_candidates_than_asked(spark, rows):
    found = vantage.neighbours(table(spark, rows[:6]), F.col("k") % 5 == 0, k=20)
    assert sorted(tuple(r) for r in found.collect()) == nearest(rows[:6], 5, 20)


def test_relaxed_recall_and_work():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(4000, 6))
    asked = rng.normal(size=(200, 6))
    tree, place = vantage.Tree.build(vectors, 32)
    assert sorted(place.tolist()) == list(range(4000)) and np.array_equal(tree.rows, vectors[place])
    want = np.argsort(-(asked @ tree.rows.T), axis=1)[:, :10]
    none = (np.zeros(0, int), np.zeros(0, int))
    recall, work = {}, {}
    for factor in (1, 1.2, 2):
        i, r, work[factor] = tree.search(asked, np.full(200, -np.inf), none, 10, factor)
        recall[factor] = np.mean([len(set(r[i == n]) & set(want[n])) / 10 for n in range(200)])
    assert recall[1] == 1 and recall[1.2] >= 0.9 and recall[2] < recall[1.2]
    assert work[2] < work[1.2] < work[1] < 0.9 * 200 * 4000              # pruning saves work already when exact


def test_equal_rows_make_a_tree():
    tree, _ = vantage.Tree.build(np.ones((500, 3)), 16)
    i, r, _ = tree.search(np.ones((2, 3)), np.full(2, -np.inf), (np.array([1]), np.array([4])), 3, 1)
    assert (i == 0).sum() == 500 and 4 not in r[i == 1]


def test_factor_below_one_is_refused(spark, rows):
    with pytest.raises(ValueError):
        vantage.neighbours(table(spark, rows), F.col("k") == 1, factor=0.5)


def mined(rows, step, most=5):
    ok = sorted({(i, lab, tuple(math.floor(256 * e) for e in np.float32(v).astype(float))) for i, v, lab in rows
                 if i is not None and lab is not None and sound(v, zero=True)})
    out = []
    for a, lab, c in ok:
        if a % step:
            continue
        others = [(-sum(x * y for x, y in zip(c, d)), i, m) for i, m, d in ok if i != a and len(d) == len(c)]
        good = sorted(o[:2] for o in others if o[2] == lab)[:5]
        for s, p in good:
            bad = sorted(o[:2] for o in others if o[2] != lab and 80 * -s <= 100 * -o[0] <= 100 * -s)[:most]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(bad)]
    return sorted(out)


@pytest.mark.parametrize("block_rows, chunk_rows", [(512, 512), (16, 5), (7, 100)])
def test_negatives_match_brute_force(spark, rows, block_rows, chunk_rows):
    found = negatives.mine(table(spark, rows), F.col("k") % 20 == 0, block_rows=block_rows, chunk_rows=chunk_rows)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == mined(rows, 20)


def test_large_components_are_exact(spark):
    rows = [(i, [float(1 << 27), float(i), -float(1 << 20)], i % 2) for i in range(30)] + [(50, [1e30, 1.0, 1.0], 0)]
    found = negatives.mine(table(spark, rows), F.col("k") == 0, scale=8)
    same = [(a, p, n, i) for a, p, n, i, _, _ in [tuple(r) for r in found.collect()]]
    full = sorted(((1 << 30) ** 2 + 0 * 64 * i + (1 << 46), i) for i in range(1, 30))
    assert {s for _, _, _, _, s, _ in map(tuple, found.collect())} == {full[0][0]}
    assert sorted(same) == sorted((0, p, n + 1, i) for p in (2, 4, 6, 8, 10) for n, i in enumerate((1, 3, 5, 7, 9)))


def test_hilbert_curve_steps_by_one_cell():
    for dims, bits in ((2, 3), (3, 2), (5, 1), (4, 2)):
        n = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(n)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = negatives.hilbert_keys(cells, bits)
        path = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
        assert len(set(keys)) == len(cells)
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_bound_scores_and_skip_blocks(spark):
    rng = np.random.default_rng(3)
    for _ in range(50):
        block, anchors = rng.integers(-300, 300, (9, 7)), rng.integers(-300, 300, (4, 7))
        least, most = negatives.score_bounds(anchors, block.min(axis=0)[None], block.max(axis=0)[None])
        score = anchors @ block.T
        assert (least[:, 0] <= score.min(axis=1)).all() and (score.max(axis=1) <= most[:, 0]).all()
    # far-apart groups: the windows of an anchor name the blocks of its own surroundings only
    rows = [(g * 100 + i, [10.0 * (d == g) + 0.01 * rng.random() for d in range(8)], i % 2) for g in range(8) for i in range(100)]
    found = negatives.mine(table(spark, rows), F.col("k") % 100 == 0, block_rows=10)
    assert sorted(tuple(r) for r in found.collect()) == mined(rows, 100)
    whole = negatives.whole_numbers(table(spark, rows), "vec_id", "label", "embedding", 256).cache()
    blocks = negatives.store_blocks(whole, 2, 10).toPandas()
    low, high = (np.array([np.frombuffer(b, np.int32) for b in blocks[c]]) for c in ("low", "high"))
    anchor = np.floor(256 * np.array([rows[0][1]]))
    _, most = negatives.score_bounds(anchor.astype(np.int64), low, high)
    assert (most[0] >= 0.8 * (anchor @ anchor.T)).sum() <= len(blocks) / 4
    whole.unpersist()


def test_empty_tables(spark):
    empty = table(spark, [])
    assert vantage.neighbours(empty, F.col("k") % 20 == 0).collect() == []
    assert negatives.mine(empty, F.col("k") % 20 == 0).collect() == []
    alone = table(spark, [(0, [1.0, 2.0], 1)])
    assert vantage.neighbours(alone, F.col("k") % 20 == 0).collect() == []
    assert negatives.mine(alone, F.col("k") % 20 == 0).collect() == []
