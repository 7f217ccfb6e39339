"""Periodic runs: the grammar's runs against trying every period of every text."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import queries, runs

SCHEMA = "doc_id long, text string, k string, t int, runs string, n_runs int, start int"


def brute(words, least=6, exponent=4):
    """(start, length, period) of every run, by its definition."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            if j > i and len(part) >= max(least, exponent * q):
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((i, len(part), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(key, text):
    words = words_of(text)
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    return (key, len(found), *best, 1000 * best[1] // best[2] if found else None,
            [tuple(r) for r in found], " ".join(w for i, w in enumerate(words) if i not in gone))


def batch_runs(docs):
    ids = np.array([x for d in docs for x in d], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    a, e, q = runs.find_runs(ids, bounds)
    out = []
    for lo, hi in zip(bounds, bounds[1:]):
        own = (a >= lo) & (a < hi)
        out.append(list(zip((a - lo)[own].tolist(), (e - a)[own].tolist(), q[own].tolist())))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 12), st.integers(1, 9)), max_size=8), min_size=1, max_size=4))
def test_runs_of_stitched_repeats(parts):
    rng = random.Random(repr(parts))
    docs = []
    for pieces in parts:
        doc = []
        for letters, width, times in pieces:
            unit = [rng.randrange(letters + 1) for _ in range(width)]
            doc += unit * times + unit[:rng.randrange(width)]
        docs.append(doc)
    assert batch_runs(docs) == [brute(d) for d in docs]


@pytest.mark.parametrize("seed", range(8))
def test_runs_with_periodic_tails(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(40):
        n, letters = rng.randrange(0, 400), rng.choice([1, 2, 5, 40])
        doc = [rng.randrange(letters) for _ in range(n)]
        if n:
            a, p = rng.randrange(n), rng.randrange(1, n // 3 + 2)
            doc = [doc[a + (i - a) % p] if i >= a and a + (i - a) % p < n else doc[i] for i in range(n)]
        docs.append(doc)
    assert batch_runs(docs) == [brute(d) for d in docs]


def test_runs_of_fibonacci_and_thue_morse_words():
    fib, morse = ["a", "ab"], [0]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    while len(morse) < 512:
        morse += [1 - x for x in morse]
    docs = [[ord(x) for x in fib[-1]], morse, morse * 5, [7] * 1000, [1, 2] * 500, []]
    assert batch_runs(docs) == [brute(d) for d in docs]


def test_grammar_derives_the_text():
    rng = random.Random(5)
    words = [rng.randrange(4) for _ in range(800)] * 2
    symbols = np.array(words, dtype=np.int64)
    made = runs.Grammar(symbols)
    for rule in range(len(made.first)):
        at = made.where[made.derived == rule]
        size = made.size[rule]
        assert len(at) >= 2 and 0 < made.left[rule] < size
        assert all(words[p:p + size] == words[made.first[rule]:made.first[rule] + size] for p in at.tolist())
    pairs = list(zip(made.starts.tolist(), [*made.starts[1:].tolist(), len(words)]))
    left = [tuple(words[a:b]) for a, b in pairs]
    assert sum(len(x) for x in left) == len(words)
    assert len(left) < len(words) // 2


ROWS = [(1, "a b c d e f"), (2, "x " * 30), (3, None), (4, ""), (5, " \t\r\n\x0b\x0c "), (6, "one"), (7, "no no no no no"),
        (8, "no no no no no no"), (9, "\x0bé è\x1fé è é è\té è é è end"), (None, "a b " * 9), (None, None),
        (10, "lead " + "p q r " * 4 + "p q tail tail tail tail tail tail"), (1, "a b c d e f"), (11, "A a " * 8),
        (12, "a a a a a a b b b b b b"), (13, ("u v w " * 5 + "z ") * 5), (14, "long " * 50000 + "end")]


def test_operator_matches_brute_force(spark):
    df = spark.createDataFrame([(k, t, "k", 1, "r", 2, 3) for k, t in ROWS], SCHEMA).repartition(3)
    got = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, [tuple(x) for x in r.runs], r.text)
           for r in runs.collapse_runs(df).collect()]
    want = [expected(k, t) for k, t in ROWS if k != 14]
    want.append((14, 1, 0, 50000, 1, 50_000_000, [(0, 50000, 1)], "long end"))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty_table_and_columns(spark):
    found = runs.collapse_runs(spark.createDataFrame([], SCHEMA))
    assert found.collect() == []
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "text"]
    with pytest.raises(ValueError):
        runs.collapse_runs(found, exponent=3)


def test_query_matches_brute_force_on_planted_tails(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh", "é"]) for _ in range(rng.randrange(0, 90)))) for i in range(150)]
    rows += [(None, "a " * 10), (900, None), (901, ""), (902, "  w  " * 7)]
    spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    got = {repr(tuple(r)) for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    want, planted = set(), 0
    for key, text in rows:
        words = words_of(text)
        h = None if key is None else zlib.crc32(str(key).encode())
        if h is not None and h % 10 == 0 and words:
            planted += 1
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        _, n_runs, *best, listed, kept = expected(key, " ".join(words))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in listed)
        want.add(repr((key, n_runs, *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())))
    assert planted > 5 and got == want
