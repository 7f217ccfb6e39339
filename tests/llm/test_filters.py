"""Decontamination and packing against brute force, and the pipeline."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import brute
from conftest import SF_SMALL
from gleaner.llm import decontaminate, linededup, packing, queries, simhash

ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs away from it"), (2, "short one"), (3, None), (4, "..."),
         (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "nameless item words"), (1, "another text of item one")]
TEXTS = [(1, "He said: the QUICK brown fox, jumps over the lazy dog and runs!"), (2, None), (3, ""), (4, "a short-one, yes"),
         (5, "x " * 3000 + "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 2), (6, "quick brown fox"),
         (None, "short one short one"), (7, "nameless item words and another text of item one"), (7, "short one")]


@pytest.mark.parametrize("most", [20_000, 2])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MAX_PATTERNS", most)          # several passes give the same
    docs = spark.createDataFrame([(k, t, 1, "h") for k, t in TEXTS], "doc_id long, text string, items int, hits string")
    bench = spark.createDataFrame([(k, t, 0) for k, t in ITEMS], "item_id long, text string, n_hit int")
    got = decontaminate.decontaminate(docs, bench).selectExpr(
        "doc_id", "n_words", "n_hit", "size(items) n", "sha2(array_join(items, ','), 256) s", "contaminated").collect()
    items = [("" if k is None else k, t) for k, t in ITEMS]
    want = sorted(str((k, *brute.decontaminate(t, items))) for k, t in TEXTS)
    assert sorted(str(tuple(r)[:5]) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


def test_decontamination_of_the_whole_table(spark):
    got = {r["doc_id"]: tuple(r)[1:5] for r in queries.op7_decontamination(spark, SF_SMALL).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {}
    for k, t in items:
        own = brute.benchmark_words(t)
        for i in range(max(1, len(own) - 9)):
            windows.setdefault(tuple(own[i:i + 10]), set()).add(k)
    for k, t in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect():
        words, near = brute.benchmark_words(t), set()
        for w, ks in windows.items():
            if any(words[i:i + len(w)] == list(w) for i in range(len(words)) if words[i] == w[0]):
                near |= ks
        assert got[k] == brute.decontaminate(t, [x for x in items if x[0] in near])


@given(st.lists(st.binary(min_size=1, max_size=9), min_size=1, max_size=12, unique=True), st.binary(max_size=300))
@settings(max_examples=200, deadline=None)
def test_scanner_finds_every_occurrence(patterns, text):
    patterns = [bytes(b % 3 + 97 for b in p) for p in patterns]
    patterns = list(dict.fromkeys(patterns))
    text = bytes(b % 3 + 97 for b in text)
    want = sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))
    for block in (1, 2, 3):
        assert sorted(decontaminate.Tables(patterns, block).scan(text)) == want


@given(st.lists(st.text(max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_remembered_words_give_the_tokenizer_ids(texts):
    texts = [*texts, "Don't <|endoftext|> It's%%% A.B, 'S ΑΣ é é x y İstanbul's 3rd ok a.'s", " ".join(texts)]
    mine, whole = tokenizers()
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert mine.encode([t.encode("utf-8", "replace") for t in texts]) == want


def tokenizers(made=[]):  # noqa: B006 - loaded once
    if not made:
        path = public_tokenizers.path("word_bpe_49k.json")
        made += [packing.WordTokenizer(path), Tokenizer.from_file(path)]
    return made


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["red", "Blue!", "greenish", "x9"]) for _ in range(rng.choice([0, 3, 30, 200]))))
            for i in range(120)]
    rows += [(200, None), (201, ""), (None, "no id"), (5, rows[5][1]), (202, "word " * 700)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, length int, task int").repartition(3)
    got = packing.pack(df, capacity=256).toPandas()
    whole = tokenizers()[1]
    want = []
    for k, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(str(k), n // 256, n, len(ids[n:n + 256]), zlib.crc32(ids[n:n + 256].tobytes())) for n in range(0, len(ids), 256)]
    own = [("None" if r[0] != r[0] else str(int(r[0])), *r[1:]) for r in
           got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)]
    assert sorted(own) == sorted(want)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset == seq.length.cumsum() - seq.length).all() and seq.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 1
    assert packing.pack(df.limit(0)).count() == 0


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), min_size=1))
@settings(max_examples=150, deadline=None)
def test_plans_hold_every_piece_and_are_no_worse_than_best_fit(histogram):
    chosen = packing.plan(histogram, 30, nodes=300)
    held = {}
    for items, times in chosen:
        assert 0 < sum(items) <= 30 and times > 0
        for i in items:
            held[i] = held.get(i, 0) + times
    assert held == histogram
    counts = np.zeros(31, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    assert sum(n for _, n in chosen) <= sum(n for _, n in packing.best_fit(counts, 30))
    at = packing.places(chosen)
    assert len({(r[0], r[1]) for r in at.tolist()}) == len(at)


def test_bin_completion_beats_best_fit():
    # best-fit decreasing needs three bins for 5 5 / 4 3 3 / ... ; exact fillings need two
    assert sum(n for _, n in packing.plan({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10)) == 2
    assert sum(n for _, n in packing.plan({4: 1, 3: 4, 2: 2}, 10)) == 2


def test_pipeline_matches_its_stages(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(9)
    words = "the of and to in a is that for it as was with be by".split()
    say = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    bench = [(1, say(14)), (2, say(20))]
    rows = [(i, say(60) + "\nAll rights reserved by the site", "en") for i in range(30)]
    rows += [(40 + i, rows[2][1], "en") for i in range(5)] + [(50, say(30) + " " + bench[0][1] + " " + say(30), "en")]
    rows += [(60, None, "en"), (61, "12 34", None), (62, "!", "en"), (63, say(40), "en")]
    spark.createDataFrame([(k, t, g, "s", len(t or "")) for k, t, g in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = [(k, t) for k, t, _ in rows if t and any(map(str.isalpha, t))]
    kept = [(k, "\n".join(x for x in t.split("\n") if not x.startswith("All rights"))) for k, t in kept]
    fps = [brute.fingerprint(t) for _, t in kept]
    root = brute.groups(len(kept), brute.near_fingerprints(fps))
    kept = [x for i, x in enumerate(kept) if root[i] == i]
    kept = [(k, t) for k, t in kept if not brute.decontaminate(t, bench)[1]]
    whole = tokenizers()[1]
    want = sorted((k, len(whole.encode(t, add_special_tokens=False).ids) + 1) for k, t in kept)
    assert sorted(got.groupby("doc_id").length.sum().items()) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "simhash_dedup", "decontamination", "best_fit_packing"]


def test_stages_keep_the_columns(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_SMALL).schema.names == docs.columns


def test_operators_do_not_hide_import_errors():
    for module in (decontaminate, linededup, packing, simhash):
        assert "except ImportError" not in open(module.__file__).read()
