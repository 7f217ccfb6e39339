"""Properties: idempotence, bounds, and order-insensitivity to partitioning."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.operators import collect, evaluate
from gleaner.operators.ranking import rank_rows

SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ITEM = "ord bigint, source string, link string"


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["x", "y", "z"])), min_size=1, max_size=30))
def test_dedup_is_idempotent_and_first_wins(spark, pairs):
    df = collect.with_dedup_key(spark.createDataFrame([(i, s, l) for i, (s, l) in enumerate(pairs)], ITEM))
    once = collect.dedup_first_wins(df)
    twice = collect.dedup_first_wins(once)
    assert sorted(once.collect()) == sorted(twice.collect())
    first = {}
    for i, (s, l) in enumerate(pairs):
        first.setdefault((s, l), i)
    assert sorted(r["ord"] for r in once.collect()) == sorted(first.values())


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 100)), min_size=1, max_size=20))
def test_weighted_score_between_min_and_max(spark, evals):
    data = [("k", i, s, c) for i, (s, c) in enumerate(evals)]
    df = spark.createDataFrame(data, "dedup_key string, seq bigint, importance_score int, confidence_score int") \
        .withColumn("eval_date", F.lit(None).cast("timestamp_ntz"))
    ws = evaluate.eval_state(df).first()["weighted_score"]
    scores = [s for s, _ in evals]
    assert min(scores) <= ws <= max(scores)


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.sampled_from(["g1", "g2", "g3"]), st.integers(0, 5)), min_size=1, max_size=60),
       st.integers(1, 7))
def test_rank_rows_matches_sorted_positions(spark, rows, n_parts):
    data = [(g, v, i) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, v int, id bigint").repartition(3)
    ranked = rank_rows(df, [F.col("v").desc(), F.col("id").asc()], partition_by=["g"], num_partitions=n_parts)
    got = {r["id"]: r["rank"] for r in ranked.collect()}
    want = {}
    for g in {g for g, _, _ in data}:
        members = sorted([d for d in data if d[0] == g], key=lambda d: (-d[1], d[2]))
        want.update({d[2]: pos + 1 for pos, d in enumerate(members)})
    assert got == want


@settings(**SETTINGS)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 5))
def test_global_rank_range_path(spark, values, n_parts):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, id bigint")
    ranked = rank_rows(df, [F.col("v").asc(), F.col("id").asc()], num_partitions=n_parts)
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    assert {r["id"]: r["rank"] for r in ranked.collect()} == {i: p + 1 for p, i in enumerate(order)}


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d"]), st.text(max_size=3)), min_size=1, max_size=12))
def test_upsert_is_idempotent_and_keeps_first_collected(spark, batch_rows):
    from datetime import datetime
    schema = "ord bigint, source string, title string, link string, creation_date timestamp_ntz, input string"
    existing = collect.with_dedup_key(spark.createDataFrame(
        [(0, "s", "old", "a", None, "{}"), (1, "s", "keep", "z", None, "{}")], schema)) \
        .withColumn("first_collected", F.lit(datetime(2024, 1, 1))) \
        .withColumn("last_collected", F.lit(datetime(2024, 1, 1)))
    batch = collect.dedup_first_wins(collect.with_dedup_key(spark.createDataFrame(
        [(i + 10, "s", t, link, None, "{}") for i, (link, t) in enumerate(batch_rows)], schema)))
    t1, t2 = datetime(2024, 1, 5), datetime(2024, 1, 6)
    once = collect.upsert_merge(existing, batch, t1).drop("merge_status", "merge_part")
    twice = collect.upsert_merge(once, batch, t2).drop("merge_status", "merge_part")
    strip = lambda df: sorted(tuple(r[c] for c in df.columns if c != "last_collected") for r in df.collect())
    assert strip(once) == strip(twice)
    firsts = {r["link"]: r["first_collected"] for r in twice.collect()}
    assert firsts["z"] == datetime(2024, 1, 1)
    if "a" in {link for link, _ in batch_rows}:
        assert firsts["a"] == datetime(2024, 1, 1)


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.sampled_from(["k1", "k2", "k3"]), st.integers(0, 100), st.integers(0, 100)),
                min_size=1, max_size=40), st.integers(1, 6))
def test_eval_state_ignores_partitioning(spark, evals, n_parts):
    data = [(k, i, s, c) for i, (k, s, c) in enumerate(evals)]
    df = spark.createDataFrame(data, "dedup_key string, seq bigint, importance_score int, confidence_score int") \
        .withColumn("eval_date", F.lit(None).cast("timestamp_ntz"))
    a = sorted(evaluate.eval_state(df.coalesce(1)).collect())
    b = sorted(evaluate.eval_state(df.repartition(n_parts, "seq")).collect())
    assert a == b


LOOKBACK = st.sampled_from(["7", "0", "-1", "3", "30", "x", " 14 ", "1_000", "++7", "99999999999", "+5", "７", "2000000000"])


@settings(**SETTINGS)
@given(base=LOOKBACK, per_source=st.dictionaries(st.sampled_from(["a", "b", "c"]), LOOKBACK, max_size=3),
       env=st.one_of(st.none(), LOOKBACK), threshold=st.sampled_from(["0", "40", "-5", "x", "1_0", "4e1", "40d", " 40 ", "NaN", "Infinity", "1" * 40]),
       rows=st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d"]), st.one_of(st.none(), st.integers(0, 60)),
                               st.one_of(st.none(), st.integers(-10, 100))), min_size=1, max_size=25))
def test_prefilters_never_drop_qualifying_rows(spark, base, per_source, env, threshold, rows):
    from datetime import datetime, timedelta

    from gleaner.operators import bulletin
    from gleaner.operators.config import Config, with_settings
    as_of = datetime(2024, 1, 31)
    cfg = Config(base={"lookback_days": base, "min_email_score": threshold},
                 sources={s: {"lookback_days": v} for s, v in per_source.items()},
                 env={} if env is None else {"lookback_days": env})
    data = [(i, s, None if d is None else as_of - timedelta(days=d), w) for i, (s, d, w) in enumerate(rows)]
    df = spark.createDataFrame(data, "ord bigint, source string, creation_date timestamp_ntz, weighted_score int")
    got = sorted(r["ord"] for r in bulletin.bulletin_items(df, cfg, as_of).collect())
    exact = with_settings(df, cfg, {"min_email_score": "double", "lookback_days": "int"})
    want = sorted(r["ord"] for r in exact.where(bulletin.is_important() & evaluate.is_recent(as_of)).collect())
    assert got == want


@settings(**SETTINGS)
@given(st.lists(st.sampled_from(["a", "b", "c", "d", "e"]), max_size=5, unique=True),
       st.lists(st.sampled_from(["a", "b", "c", "d", "e", "f"]), min_size=1, max_size=6, unique=True))
def test_upsert_of_random_sets(spark, old_links, new_links):
    from datetime import datetime
    schema = "ord bigint, source string, title string, link string, creation_date timestamp_ntz, input string"
    existing = collect.with_dedup_key(spark.createDataFrame(
        [(i, "s", f"old-{l}", l, None, "{}") for i, l in enumerate(old_links)], schema)) \
        .withColumn("first_collected", F.lit(datetime(2024, 1, 1))) \
        .withColumn("last_collected", F.lit(datetime(2024, 1, 1)))
    batch = collect.with_dedup_key(spark.createDataFrame(
        [(i + 10, "s", f"new-{l}", l, None, "{}") for i, l in enumerate(new_links)], schema))
    t = datetime(2024, 1, 9)
    got = {r["link"]: (r["title"], r["merge_status"], r["merge_part"]) for r in
           collect.upsert_merge(existing, batch, t).collect()}
    want = {l: (f"old-{l}", "kept", 1) for l in old_links}
    want |= {l: (f"new-{l}", "updated" if l in old_links else "new", 0) for l in new_links}
    assert got == want


@settings(**SETTINGS)
@given(st.lists(st.one_of(st.none(), st.integers(0, 3)), min_size=1, max_size=40))
def test_rank_rows_with_null_sort_keys(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, id bigint")
    ranked = rank_rows(df, [F.col("v").desc_nulls_last(), F.col("id").asc()], num_partitions=3)
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    assert {r["id"]: r["rank"] for r in ranked.collect()} == {i: p + 1 for p, i in enumerate(order)}
