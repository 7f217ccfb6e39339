"""Language ID, toxicity and language-model scores: contracts, held-out quality, edge cases."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import brute
from conftest import SF_SMALL
from gleaner.llm import langid, mixing, queries, toxicity

SF = "/root/testdata/sf0.01"
EDGE = [(5000, None), (5001, ""), (5002, "123 !!"), (5003, "word"), (None, "no id here"), (5004, "x" * 20000), (1, "again"),
        (1, "again")]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    edge = spark.createDataFrame([(k, t, None) for k, t in EDGE], "doc_id long, text string, lang string")
    return real.unionByName(edge).selectExpr("*", "'c' as score", "1 as held_out", "2 as pair").coalesce(2)


def test_language_id(spark, docs):
    got = langid.identify(docs).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [brute.remainder(None if k != k else int(k), 4) == 2 for k in got.doc_id]).all()
    odd = got[got.text.isna() | ~got.text.fillna("").map(lambda t: any(map(str.isalpha, t)))]
    assert set(odd.lang_pred) == {"und"} and len(odd) == 3
    assert set(got.lang_pred) - {"und"} <= {"en", "de", "fr", "es"}


def test_language_id_is_right_on_held_out_rows(spark):
    got = queries.op8_language_id(spark, SF).toPandas()
    lang = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    held = got[got.held_out]
    assert (held.lang_pred == held.doc_id.map(lang)).mean() > 0.98


def test_language_id_without_or_with_one_label(spark):
    rows = [(i, "some plain words", "en") for i in range(12)] + [(99, None, "en")]
    schema = "doc_id long, text string, lang string"
    one = langid.identify(spark.createDataFrame(rows, schema)).toPandas()
    assert set(one.lang_pred) == {"en", "und"} and set(one[one.lang_pred == "en"].score) == {1.0}
    none = langid.identify(spark.createDataFrame([(k, t, None) for k, t, _ in rows], schema)).toPandas()
    assert set(none.lang_pred) == {"und"}
    assert langid.identify(spark.createDataFrame([], schema)).count() == 0


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(150)] + [(1, 1, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and got.score.notna().all()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    assert (got.held_out == [brute.remainder(None if k != k else int(k), 5) == 0 for k in got.doc_id]).all()


def test_toxicity_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op4_toxicity(spark, sf).toPandas()
    toxic = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    held = got[got.held_out & got.doc_id.isin(toxic)]
    y = held.doc_id.map(toxic).to_numpy()
    bad, good = held.score[y == 1].to_numpy(), held.score[y == 0].to_numpy()
    assert np.mean([(b > good).mean() for b in bad]) > 0.9


def test_toxicity_reads_no_held_out_label(spark, docs):
    rows = [(k, 1, int(k % 2)) for k in range(190)]
    flipped = [(k, q, 1 - t if brute.remainder(k, 5) == 0 else t) for k, q, t in rows]
    a, b = (toxicity.score(docs, spark.createDataFrame(r, "doc_id long, quality int, toxic int")).toPandas()
            .sort_values(["doc_id", "text"]).score.to_numpy() for r in (rows, flipped))
    assert (a == b).all()


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert set(toxicity.score(docs, none).toPandas().score) == {0.5}
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_ftrl_weights_are_sparse():
    rng = np.random.default_rng(0)
    model = toxicity.Ftrl(10)
    for _ in range(3000):
        y = int(rng.integers(2))
        at = np.unique(np.r_[rng.integers(10, 1 << 10, 20), [3] if y else [4], 1 << 10])
        model.learn(at, y, 1.0)
    w = model.weights(np.arange(1 << 10))
    assert w[3] > 0 > w[4] and (w != 0).sum() < 40


def test_lm_base_scores(spark, docs):
    got = mixing.score_texts(docs).toPandas()
    rows = [(None if k != k else int(k), t) for k, t in docs.select("doc_id", "text").toPandas().itertuples(index=False)]
    want = sorted((str(k), *r) for (k, _), r in zip(rows, brute.base_scores(rows)))
    cols = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score"]
    own = sorted(("None" if r[0] != r[0] else str(int(r[0])), *r[1:]) for r in got[cols].itertuples(index=False, name=None))
    assert [r[:4] for r in own] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in own], [r[4] for r in want], atol=1e-6)
    assert (got.score < 0).all() and np.isfinite(got.score).all()


def test_lm_is_a_probability_and_beats_the_base(spark):
    got = queries.op10_lm_scoring(spark, "/root/testdata/sf0.1").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.7


def test_lm_without_training_rows(spark):
    rows = [(k, "some words here") for k in range(60) if brute.remainder(k, 7) == 2]
    got = mixing.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(got.train_tokens) == {0} and (got.score < 0).all() and np.isfinite(got.score).all()
    assert mixing.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contexts_reach_two_tokens_and_six_bytes_back():
    model = mixing.Model(np.arange(3000), np.arange(3000, 0, -1), 10 ** 7, np.ones(257, dtype=np.int64))
    key = lambda one, two: np.array([((2500 * (mixing.TOPICS + 1) + 3) * mixing.WIDE + one) * mixing.WIDE + two])

    def changed(a, b, at):
        return [bool((x[at] != y[at]).all()) for x, y in zip(a.slots, b.slots)]

    base = model.token_decisions(key(2000, 7))
    assert changed(base, model.token_decisions(key(2001, 7)), slice(None)) == [False, False, True, True]
    assert changed(base, model.token_decisions(key(20, 7)), slice(None)) == [False, True, True, True]
    assert changed(base, model.token_decisions(key(2000, 8)), slice(None)) == [False, False, False, True]
    assert len({x.tobytes() for x in base.slots}) == mixing.ORDERS
    for back, want in {2: [True] * 4, 3: [False, True, True, True], 4: [False, False, True, True],
                       6: [False, False, False, True], 7: [False] * 4}.items():
        word = bytearray(b"abcdefghij")
        word[-back] = ord("z")
        a, b = (model.byte_decisions([bytes(w)], np.array([3])) for w in (b"abcdefghij", word))
        assert changed(a, b, slice(-8, None)) == want         # those of the stop


def test_code_is_prefix_free_and_complete():
    rng = random.Random(1)
    code = mixing.Code([rng.randrange(1, 500) for _ in range(70)])
    paths = ["".join(map(str, code.bits[a:b])) for a, b in zip(code.start, code.start[1:])]
    assert sum(2.0 ** -len(p) for p in paths) == 1 and len(set(paths)) == 70


def test_toxicity_with_an_id_that_holds_most_rows(spark):
    """An id's rows count once in the fit, whatever their number."""
    rng = random.Random(4)
    good, bad = "kind warm nice gentle calm".split(), "vile nasty horrid awful rotten".split()
    rows = [(i, " ".join(rng.choice(bad if i % 2 else good) for _ in range(12))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    once = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).distinct()
    crowd = toxicity.score(spark.createDataFrame(rows + [rows[2]] * 400 + [rows[7]] * 300, "doc_id long, text string"), labels)
    assert crowd.count() == 900
    assert sorted(map(tuple, crowd.distinct().collect())) == sorted(map(tuple, once.collect()))


def test_tables_of_counts_hold_every_decision():
    """Counting a table's own distinct contexts equals counting every decision."""
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    texts = pa.array([" ".join(rng.choices(words, weights=range(400, 0, -1), k=rng.randrange(0, 300))) for _ in range(30)] + [None, "", "ünlisted"])
    names, ids, size = mixing.token_ids(texts)
    assert [names[i] for i in ids[:size[0]]] == [*texts[0].as_py().encode().split(), b""] and size[-3:].tolist() == [1, 1, 2]
    counts = np.bincount(ids, minlength=len(names))
    listed = np.argsort(-counts, kind="stable")[:250]
    model = mixing.Model(mixing.token_hashes([names[i] for i in listed]), counts[listed], int(counts.sum()), np.full(257, 5))
    model.topics = np.arange(mixing.FREQUENT) % mixing.TOPICS
    got = np.zeros((mixing.PARTS_OF_TABLE, 2 << mixing.SLOT_BITS), dtype=np.int32)
    mixing.tally(model, texts, got)
    want = np.zeros_like(got)
    _, _, symbol, ids, size = model.text_parts(texts)
    stream = model.stream(ids, size, symbol)
    for made in (model.token_decisions(stream.keys()), model.byte_decisions(names, stream.spelled(model.escape)[1])):
        for k in range(mixing.PARTS_OF_TABLE):
            np.add.at(want[k], 2 * (made.slots[k] if k < mixing.ORDERS else made.node).astype(np.int64) + made.bit, 1)
    assert (got == want).all() and got.sum() > 10_000


def test_topics_and_weights_are_learned_from_all_training_texts(spark):
    """The sums reach every training text, and the uses of the gates are all decisions."""
    rng = random.Random(15)
    texts = [" ".join(rng.choice("abcdefghij") + rng.choice(("", "k", "zz")) for _ in range(rng.randrange(12))) for _ in range(1300)]
    train = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(3)
    names, ids, size = mixing.token_ids(pa.array(texts))
    counts = np.bincount(ids, minlength=len(names))
    listed = np.argsort(-counts, kind="stable")[:20]
    model = mixing.Model(mixing.token_hashes([names[i] for i in listed]), counts[listed], int(counts.sum()), np.full(257, 5))
    state = spark.sparkContext.broadcast(model.state())
    place = {names[i]: k for k, i in enumerate(listed)}
    want = np.zeros(mixing.FREQUENT ** 2, dtype=np.int64)
    for text in [*texts, ""]:
        s = [place[w] for w in [*text.encode().split(), b""] if w in place]
        for gap in (1, 2, 3):
            for a, b in zip(s, s[gap:]):
                want[b * mixing.FREQUENT + a] += 1
    got = {r["cell"]: r["n"] for r in mixing.pair_counts(train, "t", state).collect()}
    assert got == {int(i): int(want[i]) for i in np.flatnonzero(want)}

    tables = [np.zeros(2 << mixing.SLOT_BITS, dtype=np.int16)] * mixing.PARTS_OF_TABLE
    taught = []
    average = mixing.Mixer.average
    try:
        mixing.Mixer.average = lambda self, place, n, total: (taught.append((place, n)), average(self, place, n, total))[1]
        mixer = mixing.learned(train, "t", state, spark.sparkContext.broadcast(tables))
    finally:
        mixing.Mixer.average = average
    place, n = taught[0]
    bias = place % mixer.weights.shape[1] == 0
    symbol = model.text_parts(pa.array([*texts, None]))[2][mixing.token_ids(pa.array([*texts, None]))[1]]
    held = {names[i] for i in listed}
    spelled = [w for t in texts for w in t.encode().split() if w not in held]
    bits = int(model.code.size[symbol].sum()) + sum(int(model.bytes.size[list(w)].sum()) + int(model.bytes.size[256]) for w in spelled)
    assert n[bias & (place < mixer.weights.size)].sum() == bits
    assert np.isfinite(mixer.weights).all() and np.isfinite(mixer.map).all()


def test_spelled_bytes_are_counted_once_per_context(monkeypatch):
    """Words that share their bytes share the work of a table whose contexts do not tell them apart."""
    rng = random.Random(6)
    texts = pa.array([" ".join("".join(rng.choice("ab") for _ in range(14)) for _ in range(400)) for _ in range(3)])
    names, ids, size = mixing.token_ids(texts)
    model = mixing.Model(mixing.token_hashes([b""]), np.array([3]), len(ids), np.bincount([97, 98, 256], minlength=257))
    _, _, symbol, ids, size = model.text_parts(texts)
    stream = model.stream(ids, size, symbol)
    all_of = sum(len(made.bit) for made in (model.token_decisions(stream.keys()), model.byte_decisions(names, stream.spelled(model.escape)[1])))
    made, entries = [], mixing.Code.entries
    monkeypatch.setattr(mixing.Code, "entries", lambda self, s: (made.append(int(self.size.take(s).sum())), entries(self, s))[1])
    counts = np.zeros((mixing.PARTS_OF_TABLE, 2 << mixing.SLOT_BITS), dtype=np.int32)
    mixing.tally(model, texts, counts)
    assert counts.sum(axis=1).tolist() == [all_of] * mixing.PARTS_OF_TABLE and sum(made) < all_of / 4


def test_online_steps_equal_plain_ones():
    """Weights, map and uses are those of one step after the other over all gates and cells."""
    rng, plain, mixer = np.random.default_rng(7), mixing.Mixer(), mixing.Mixer()
    for first, n in ((0, 3 * mixing.STEP + 500), (256, mixing.STEP), (0, 700)):
        found = rng.integers(-8000, 8000, (mixing.PARTS_OF_TABLE, n)).astype(np.int16)
        gate, bit = (first + rng.integers(0, 256, n)).astype(np.int16), rng.integers(0, 2, n).astype(np.uint8)
        uses = rng.integers(1, 9, n).astype(np.float32)
        mixer.learn(found, gate, bit, uses)
        for at in range(0, n, mixing.STEP):
            now = slice(at, at + mixing.STEP)
            x, g, b, u = found[:, now] / (4.0 * mixing.SCALE), gate[now].astype(np.int64), bit[now], uses[now]
            mixed = np.clip(plain.weights[g, -1] + (plain.weights[g, :-1].T * x).sum(axis=0), -7.99, 7.99)
            place = (mixed + 8) * (mixing.CELLS - 1) / 16
            low = place.astype(int)
            part = place - low
            refined = plain.map[g, low] * (1 - part) + plain.map[g, low + 1] * part
            seen = np.bincount(g, u, len(plain.weights))
            rate = np.maximum(mixing.RATES[1], mixing.RATES[0] / (1 + plain.seen / mixing.FALL))
            step = rate / np.maximum(np.sqrt(np.maximum(seen, 1)), seen / np.sqrt(mixing.MOST))
            error, off = (u * (b - 1 / (1 + np.exp(-p))) for p in (mixed, refined))
            for k in range(mixing.PARTS_OF_TABLE):
                np.add.at(plain.weights[:, k], g, step[g] * error * x[k])
            np.add.at(plain.weights[:, -1], g, 0.3 * step[g] * error)
            for side, share in ((0, 1 - part), (1, part)):
                np.add.at(plain.map, (g, low + side), 3 * step[g] * off * share)
                np.add.at(plain.met, g * mixing.CELLS + low + side, u)
            plain.seen += seen
    assert np.array_equal(mixer.seen, plain.seen) and np.abs(mixer.met - plain.met).max() <= 9
    assert np.allclose(mixer.weights, plain.weights, atol=1e-4) and np.allclose(mixer.map, plain.map, atol=1e-3)
