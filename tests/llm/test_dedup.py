"""SimHash, embedding, suffix-array and line deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from gleaner.llm import common, embeddings, linededup, packing, queries, simhash, suffixes

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", rng.choice(WORDS)]) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, fp string, a string")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (3, 40, 120, 300, 80, 60)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10 + i, base[i % 3]) for i in range(12)]                      # exact copies
    for i in range(20):                                                    # near copies
        words = base[3].split()
        words[rng.randrange(len(words))] = "edited"
        rows.append((30 + i, " ".join(words)))
    rows += [(60, None), (61, ""), (62, " \n\t"), (63, "one"), (64, "one two"), (65, "ONE  two"), (66, "é" * 400),
             (None, base[1]), (None, "lonely words here"), (3, base[3]), (70, "aaaa" * 300), (71, prose(rng, 9000)),
             (72, base[4][:250] + base[5] + base[4][:250])]
    return rows


def test_fingerprint_is_the_engine_hash(spark):
    text = "Some WORDS to hash here, Á fin"
    shingles = ["some words to", "words to hash", "to hash here,", "hash here, Á", "here, Á fin"]
    df = spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h"))
    hashes = [r["h"] % (1 << 64) for r in df.collect()]
    want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode(), 3) == want == brute.fingerprint(text)


def test_simhash_matches_brute_force(spark, texts):
    got = simhash.near_duplicates(documents(spark, texts), width=3, distance=3).toPandas()
    fps = [brute.fingerprint(t) for _, t in texts]
    root = brute.groups(len(texts), brute.near_fingerprints(fps))
    low = {}
    for (key, _), r in zip(texts, root):
        low[r] = key if low.get(r) is None else low[r] if key is None else min(low[r], key)
    want = sorted((str(k), f"{fp:016x}", str(low[r])) for (k, _), fp, r in zip(texts, fps, root))
    name = lambda x: "None" if x != x or x is None else str(int(x))
    assert sorted((name(k), f"{fp % (1 << 64):016x}", name(c))
                  for k, fp, c in got[["doc_id", "fp", "component_id"]].itertuples(index=False)) == want
    assert got.kept.sum() == len(set(root))


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_ball_links_connect_all_pairs(spark, distance):
    rng = np.random.default_rng(distance)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (0, 1, 2, 3, 4, 5) for _ in range(4)]
    fps = sorted({int(s) ^ f for s in seeds for f in flips})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = simhash.links(df, distance).collect()
    place = {simhash.signed(f): i for i, f in enumerate(fps)}
    got = brute.groups(len(fps), [(place[r["a"]], place[r["b"]]) for r in found])
    assert got == brute.groups(len(fps), brute.near_fingerprints(fps, distance))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(x, 300) for x in range(200, 240)]
    edges += [(7, 7), (150, 250)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in common.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in [*range(100, 160), 250]},
                   **{i: 200 for i in [*range(200, 240), 300]}}
    assert common.components(df.limit(0)).count() == 0


def test_repeats_match_brute_force(spark, texts):
    rows = [(k if k is not None else -i, t) for i, (k, t) in enumerate(texts)]
    got = suffixes.remove_repeats(documents(spark, rows), length=200).toPandas()
    want = [(k, *r) for (k, _), r in zip(rows, brute.repeats([t for _, t in rows]))]
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(got[cols].itertuples(index=False, name=None)) == sorted(want)
    kept = got.set_index("doc_id").kept[71]
    assert hashlib.sha256(kept).hexdigest() == got.set_index("doc_id").kept_sha256[71]


def test_repeats_of_owners_with_many_runs(spark, monkeypatch):
    """The window-by-window way gives the same as the shards."""
    rng = random.Random(8)
    core = prose(rng, 60)
    rows = [(i, prose(rng, 30) + " " + core[:180 + i % 60] + " " + prose(rng, 30)) for i in range(40)]
    monkeypatch.setattr(suffixes, "MANY_RUNS", 2)
    got = suffixes.remove_repeats(documents(spark, rows), length=100).toPandas()
    want = [(k, *r) for (k, _), r in zip(rows, brute.repeats([t for _, t in rows], 100))]
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(got[cols].itertuples(index=False, name=None)) == sorted(want)


@pytest.mark.parametrize("kind", range(5))
def test_suffix_array_and_common_prefixes(kind):
    rng = np.random.default_rng(kind)
    data = [rng.integers(0, 2, 900), rng.integers(0, 256, 700), np.zeros(300, int), np.tile([1, 2, 3, 1], 200),
            np.frombuffer(b"mississippi", dtype=np.uint8)][kind].astype(np.uint8)
    sa, plcp = suffixes.suffix_array(data)
    text = [int(x) + 1 for x in data] + [0]
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert sa.tolist() == want
    for a, b in zip(want, want[1:]):
        n = 0
        while text[a + n:a + n + 1] == text[b + n:b + n + 1] != []:
            n += 1
        assert plcp[b] == n


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 16))
    rows = [(i, centres[i % 6] + rng.standard_normal(16) * [0.02, 0.1, 0.3][i % 3]) for i in range(150)]
    rows += [(200 + i, centres[0]) for i in range(30)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [1.0] * 15 + [None]),
             (305, [float("inf")] + [1.0] * 15), (306, [1.0, 2.0]), (None, [1.0] * 16), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id long, embedding array<float>, keys int, v string")
    got = embeddings.near_duplicates(df, threshold=0.95).toPandas()
    links = brute.cosine_links([v for _, v in rows])
    root = brute.groups(len(rows), links)
    low = {}
    for (k, _), r in zip(rows, root):
        low[r] = k if low.get(r) is None else low[r] if k is None else min(low[r], k)
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    name = lambda x: "None" if x != x or x is None else str(int(x))
    want = sorted((name(k), c, name(low[r]), k is None or k == low[r]) for (k, _), c, r in zip(rows, n, root))
    cols = ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((name(a), b, name(c), bool(d)) for a, b, c, d in got[cols].itertuples(index=False)) == want


def test_embeddings_in_hot_buckets(spark, monkeypatch):
    """Buckets dealt out as pairs of blocks count every link once."""
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(12)
    rows = [(i, [float(np.float32(x)) for x in centre + rng.standard_normal(12) * 0.02]) for i in range(120)]
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert set(got.n_links) == {119} and set(got.component_id) == {0} and got.kept.sum() == 1


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a = embeddings.unit(rng.standard_normal((2000, 64)))
    side = rng.standard_normal((2000, 64))
    side = embeddings.unit(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.951 * a + np.sqrt(1 - 0.951 ** 2) * side
    ka, kb = (embeddings.bucket_keys(x, embeddings.TABLES, embeddings.PROJECTIONS, embeddings.WIDTH) for x in (a, b))
    assert (ka == kb).any(axis=1).mean() > 0.93


def line_rows():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lines = [prose(rng, 12) for _ in range(5)]
        if i % 2 == 0:
            lines.insert(2, f"Posted by user{i} on 2024-01-{i % 28 + 1:02d} at the front page")
        if i % 3 == 0:
            lines.append("All rights reserved by the owner of this site")
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[1][1]) for i in range(40)]                      # whole copies are not boilerplate
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, "All rights reserved by the owner of this site"), (0, rows[0][1])]
    return rows


def test_recurring_lines_are_dropped(spark):
    rows = line_rows()
    got = linededup.drop_lines(spark.createDataFrame([(k, t, "q", 5) for k, t in rows],
                                                     "doc_id long, text string, leaf string, n_lines int")).toPandas()
    assert list(got.columns) == ["doc_id", "text", "leaf", "n_lines", "n_dropped", "templates"]
    gone = lambda line: line.startswith(("Posted by user", "All rights"))
    want = [None if t is None else "\n".join(x for x in t.split("\n") if not gone(x)) for _, t in rows]
    assert sorted(map(str, got.text)) == sorted(map(str, want))
    dropped = {t for ts in got.templates for t in ts}
    assert dropped == {"Posted by <*> on <*> at the front page", "All rights reserved by the owner of this site"}


def test_templates_generalise_variable_words(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 20) + f"\nwelcome to the pages of {rng.choice('abcdefgh')}{'xyz'[i % 3]}club and all its friends")
            for i in range(30)]
    got = linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {t for ts in got.templates for t in ts} == {"welcome to the pages of <*> and all its friends"}
    assert (got.n_dropped == 1).all()


def test_copies_of_one_document_do_not_save_a_line(spark):
    rng = random.Random(7)
    licence = "Licensed to all readers under the common terms"
    rows = [(i, prose(rng, 30) + "\n" + licence + "\n" + prose(rng, 30)) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(200)]
    got = linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (got.n_dropped == 1).all()
    assert {t for ts in got.templates for t in ts} == {licence}


def test_unlike_documents_with_a_pair_in_common_are_different_contents(spark):
    rng = random.Random(8)
    low = min((f"w{i} x" for i in range(50_000)), key=lambda p: xxhash.xxh3_64_intdigest(p.encode()))
    rows = [(i, f"{prose(rng, 40)}\n{prose(rng, 9)} {low} {prose(rng, 9)}\nAll rights reserved by the owner of this site")
            for i in range(30)]
    got = linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (got.n_dropped == 1).all()


def test_near_copies_are_one_content(spark):
    rng = random.Random(9)
    words = [prose(rng, 30).split() for _ in range(5)]
    rows = []
    for i in range(300):
        own = [list(w) for w in words]
        for _ in range(4):
            rng.choice(own)[rng.randrange(30)] = f"changed{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}"
        rows.append((i, "\n".join(" ".join(w) for w in own)))
    got = linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (got.n_dropped == 0).all()


def test_short_and_long_recurring_lines_are_dropped(spark):
    rng = random.Random(10)
    passage, script = prose(rng, 55), "网" * 50
    rows = [(i, prose(rng, 40) + ("\nLes." if i < 20 else "") + (f"\n{passage}" if 20 <= i < 24 else "")
             + (f"\n{script}" if 24 <= i < 28 else "") + ("\nRare." if 28 <= i < 32 else "")
             + (f"\n{100 + i}" if 32 <= i < 60 else "")) for i in range(60)]
    got = linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(got.doc_id[got.n_dropped == 1]) == set(range(28)) and got.n_dropped.max() == 1
    assert {t for ts in got.templates for t in ts} == {"Les.", passage, script}


@pytest.mark.parametrize("name", ["op2_embedding_near_dedup", "op3_line_dedup", "op5_simhash", "op9_suffix_array_dedup"])
def test_empty_tables(spark, tmp_path, name):
    for t, schema in {"documents": "doc_id long, text string, lang string, source string, n_chars long",
                      "embeddings": "vec_id long, embedding array<float>, label int"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


CLASHING = ["drop", "templates", "n_lines", "row", "r", "windows", "kept", "kept_sha256", "t", "l", "base", "task", "nth",
            "piece", "offset", "lang_pred", "score", "held_out", "hits", "items", "n_words", "contaminated", "__row", "gone",
            "a", "b", "doc_ID2", "_metadata"]


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """A stored documents table with a column of every internal or added name, with values."""
    path = str(tmp_path_factory.mktemp("clash") / "documents.parquet")
    line = "the very same line of twenty words " * 4
    rows = [(i, f"{prose(random.Random(i), 40)}\n{line}\n{prose(random.Random(i + 999), 30)}", "en", "s", None) for i in range(30)]
    rows += [(100, rows[0][1], "en", "s", None), (101, None, "en", "s", None), (102, "", "en", "s", None)]
    df = spark.createDataFrame([(*r[:4], len(r[1]) if r[1] is not None else None) for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    for n, c in enumerate(CLASHING):
        df = df.withColumn(c, F.col("doc_id") * 100 + n)
    df.repartition(3).write.parquet(path)
    return path


def values(df, columns):
    return sorted(str(tuple(r)) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect())


def test_columns_of_any_name_pass_through(spark, clashing):
    df = spark.read.parquet(clashing)
    for found, added in ((linededup.drop_lines(df), ["n_lines", "n_dropped", "templates"]),
                         (suffixes.remove_repeats(df), ["n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"]),
                         (packing.pack(df), ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"])):
        others = [c for c in CLASHING if c not in added]
        assert [c for c in found.columns if c in others] == others
        assert values(found.select("doc_id", *others).distinct(), ["doc_id", *others]) == values(df, ["doc_id", *others])
        assert set(added) <= set(found.columns) and len(set(found.columns)) == len(found.columns)


def test_stages_keep_all_columns_and_count_characters(spark, clashing, tmp_path):
    spark.createDataFrame([("i1", "nothing of these documents stands in here at all")], "item_id string, text string") \
        .write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(clashing)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == spark.read.parquet(clashing).columns, name
        assert 0 < docs.count() <= before
        assert docs.filter("n_chars <> length(text)").count() == 0, name
        kept = docs.select("doc_id", *CLASHING)
        assert values(kept, kept.columns) == values(spark.read.parquet(clashing).join(kept.select("doc_id"), "doc_id", "left_semi"), kept.columns)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count() > 20


@pytest.mark.parametrize("nulls", [False, True])
def test_stages_on_empty_and_null_tables(spark, tmp_path, nulls):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None,) * 5] * 3 + [(1, None, None, None, None), (None, "words in a text", None, None, 15)] if nulls else []
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = common.written(spark.createDataFrame(rows, schema), "few")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        assert found.count() <= len(rows)
    corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert pieces.count() == len(rows)


def test_row_keys_hold_when_cores_join_or_leave(spark, tmp_path):
    rng = random.Random(8)
    line = "one line that stands in every one of these documents as it is, word for word, twenty words in all, no fewer"
    rows = [(i, f"{prose(rng, rng.randrange(5, 60))}\n{line}\n{prose(rng, 20)}") for i in range(400)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(40).write.parquet(path)
    setting = "spark.sql.leafNodeDefaultParallelism"
    docs = spark.read.parquet(path)

    def key_map(df):
        return {r["doc_id"]: r[common.ROW] for r in df.select("doc_id", common.ROW).collect()}

    def results(change):
        """The operators with the parallelism changed after their first reading."""
        out = []
        for made in (linededup.drop_lines, suffixes.remove_repeats):
            spark.conf.set(setting, "8")
            found = made(docs)
            spark.conf.set(setting, change)
            out.append(sorted(map(str, found.collect())))
        spark.conf.set(setting, "8")
        found = corpus_pipeline.simhash_dedup(spark, docs, "")
        spark.conf.set(setting, change)
        return [*out, sorted(map(str, found.collect()))]

    try:
        spark.conf.set(setting, "8")
        keyed = common.with_row_key(docs)
        first = key_map(keyed)
        spark.conf.set(setting, "3")
        assert key_map(keyed) == first and len(set(first.values())) == 400
        assert results("3") == results("8")
        shuffled = common.with_row_key(docs.repartition(5))               # not a plain scan: stored first
        assert common.scans_files(docs.filter("doc_id > 3")) and not common.scans_files(docs.repartition(5))
        first = key_map(shuffled)
        spark.conf.set(setting, "6")
        assert key_map(shuffled) == first
    finally:
        spark.conf.unset(setting)


def forms(rng, i):
    """Lines of some templates, whose variable words carry no digit."""
    name, place = ("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2))
    return [f"posted by user {name} in the front page section today", f"the five {name} words here", f"a b c {name}",
            f"Updated on {2000 + i}-01-02 at {i}:30", f"welcome {name} to our {place} pages and to all the others that we keep here",
            f"far {name} apart are these two {place} fields of it {name} three", "exactly the same line",
            "two words", f"{i}", " ".join(f"w{chr(97 + j)}" if j not in (5, 17) else name for j in range(24))]


def template_rows(seed, documents, each):
    rng = random.Random(seed)
    rows = []
    for i in range(documents):
        # words of their own, so that documents are plainly unlike
        word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))  # noqa: E731, B023
        lines = [" ".join(word() for _ in range(rng.randrange(15, 40))) for _ in range(rng.randrange(14, 18))]
        for k, line in enumerate(forms(rng, i)):
            if (i * 7 + k) % (k + each) == 0:
                lines.insert(rng.randrange(len(lines) + 1), line)
        rows.append((i, "\n".join(lines)))
    return rows + [(None, None), (900, ""), (901, "\n \n"), (902, rows[3][1]), (903, rows[3][1])]


@pytest.mark.parametrize("seed, documents, each, parts", [(1, 120, 2, 1), (2, 60, 3, 7), (3, 200, 5, 3)])
def test_line_templates_match_brute_force(spark, seed, documents, each, parts):
    rows = template_rows(seed, documents, each)
    want = brute.line_templates([t for _, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = linededup.drop_lines(df).select("doc_id", "text", "n_dropped").collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str((k, t)) for (k, _), t in zip(rows, want))
    assert sum(r["n_dropped"] for r in got) > documents / 3


def test_templates_meet_in_a_crowded_leaf(spark):
    """One leaf holds thousands of unlike lines with six equal tokens; the few lines of one
    template among them still meet."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows = [(i, f"{prose(rng, 12)}\nall of these lines begin alike {word()} {word()} {word()} {word()}") for i in range(4000)]
    rows += [(5000 + i, f"{prose(rng, 12)}\nall of these lines begin alike and {word()} ends alike") for i in range(12)]
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, n in got.items() if n} == {5000 + i for i in range(12)}


def test_very_long_lines_and_repeats_inside_a_text(spark):
    rng = random.Random(13)
    long = prose(rng, 60_000)
    rows = [(i, f"{prose(rng, 30)}\n{long}") for i in range(4)] + [(10, "\n".join(["again and again the same"] * 500 + [prose(rng, 30)]))]
    rows += [(20 + i, f"{prose(rng, 30)}\nagain and again the same\nagain and again the same") for i in range(9)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10] == (501, 500) and got[25] == (3, 2) and all(got[i] == (2, 1) for i in range(4))


def test_lines_are_joined_by_a_shuffle_at_every_size(spark, monkeypatch):
    """Joins whose both sides grow with the input take one plan, so disk use measured on small
    tables tells that of large ones."""
    plans = {}

    def noted(df, name, *rest):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return common.written(df, name, *rest)

    monkeypatch.setattr(linededup, "written", noted)
    rng = random.Random(14)
    rows = [(i, prose(rng, 20) + "\nwelcome to the pages of this club and all its friends") for i in range(12)]
    got = linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (got.n_dropped == 1).all()
    assert all("SortMergeJoin" in plans[name] for name in ("kept", "flagged"))
