"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are reduced to words, ASCII lower case, one space apart; a benchmark item's test
strings are its windows of ``width`` consecutive words (an item with fewer words, but
not none, is one window), set between spaces so that they match whole words only. The
scanner looks at the block of bytes that ends each alignment: the shift table says how
far no test string can end there, a shift of zero leads to the bucket of the test
strings with that suffix block, and direct comparison confirms each of them. Short and
long test strings get tables of their own, so that short ones do not shorten the shifts
of the others.

The benchmark is read a bounded number of test strings at a time (``MAX_PATTERNS``),
each with its own pass over the documents; only that bounded part is ever broadcast.
Null texts have no words. Null item ids count as the empty id, repeated ids as one item;
an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import slices, text_bytes, written

#: Test strings broadcast and scanned for in one pass.
MAX_PATTERNS = 20_000
#: Block lengths for test strings of at least / less than LONG bytes.
LONG, LONG_BLOCK, SHORT_BLOCK = 24, 8, 3

#: Bytes to word bytes: A-Z to lower case, digits, a-z and non-ASCII as they are, others to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
             for b in range(256))

HIT = T.StructType([T.StructField("item", T.StringType()), T.StructField("start", T.LongType()),
                    T.StructField("end", T.LongType())])


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def windows(tokens: list[bytes], width: int) -> set[bytes]:
    """Test strings of an item."""
    if not tokens:
        return set()
    return {b" " + b" ".join(tokens[i:i + width]) + b" " for i in range(max(1, len(tokens) - width + 1))}


class Tables:
    """Shift table and suffix buckets of one set of test strings."""

    def __init__(self, patterns: list[bytes], block: int):
        self.least = min(map(len, patterns))
        self.block = min(block, self.least)
        self.default = self.least - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.least + 1):
                piece = p[end - self.block:end]
                self.shift[piece] = min(self.shift.get(piece, self.default), self.least - end)
            self.buckets[p[self.least - self.block:self.least]].append(p)

    def scan(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(offset, test string) of every occurrence."""
        shift, block, default, buckets, end, size = (
            self.shift.get, self.block, self.default, self.buckets, self.least, len(text))
        while end <= size:
            piece = text[end - block:end]
            step = shift(piece, default)
            if step:
                end += step
                continue
            start = end - self.least
            for p in buckets[piece]:
                if text.startswith(p, start):
                    yield start, p
            end += 1


def compile_patterns(patterns: dict[bytes, list[str]]) -> list[Tables]:
    long = [p for p in patterns if len(p) >= LONG]
    short = [p for p in patterns if len(p) < LONG]
    return [Tables(group, block) for group, block in ((long, LONG_BLOCK), (short, SHORT_BLOCK)) if group]


def occurrences(tokens: list[bytes], tables: list[Tables], patterns: dict[bytes, list[str]]) -> list[tuple]:
    """(item, first word, word after the last) of every test string found."""
    text = b" " + b" ".join(tokens) + b" "
    found = [hit for t in tables for hit in t.scan(text)] if tokens else []
    if not found:
        return []
    spaces = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    at = np.searchsorted(spaces, [start for start, _ in found]).tolist()
    return [(item, i, i + p.count(b" ") - 1) for i, (_, p) in zip(at, found) for item in patterns[p]]


def pattern_sets(benchmark: DataFrame, key: str, text: str, width: int) -> Iterator[dict[bytes, list[str]]]:
    held: dict[bytes, list[str]] = defaultdict(list)
    rows = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"))
    for row in rows.filter("t is not null").distinct().toLocalIterator():
        for p in windows(words(row["t"].encode()), width):
            held[p].append(row["k"])
        if len(held) >= MAX_PATTERNS:
            yield dict(held)
            held = defaultdict(list)
    if held:
        yield dict(held)


def scan(df: DataFrame, patterns: dict[bytes, list[str]], text: str, hits: str, last: bool) -> DataFrame:
    """Append the occurrences of the given test strings to the column ``hits``; the last
    pass also adds n_words, n_hit and items."""
    shared = df.sparkSession.sparkContext.broadcast(patterns)

    def run(batches):
        patterns = shared.value
        tables = compile_patterns(patterns)
        at = df_names.index(hits)
        for batch in slices(batches, text):
            found, totals = [], []
            for t, before in zip(text_bytes(batch[text]), batch[hits].to_pylist()):
                tokens = words(t)
                own = before + [dict(zip(("item", "start", "end"), h)) for h in occurrences(tokens, tables, patterns)]
                found.append(own)
                if last:
                    edge = np.zeros(len(tokens) + 1 if own else 0, dtype=np.int64)
                    for h in own:
                        edge[h["start"]] += 1
                        edge[h["end"]] -= 1
                    totals.append((len(tokens), int((np.cumsum(edge) > 0).sum()), sorted({h["item"] for h in own})))
            columns = list(batch.columns)
            columns[at] = pa.array(found, type=batch.schema.field(hits).type)
            if last:
                columns += [pa.array(c, k) for c, k in zip(zip(*totals), (pa.int64(), pa.int64(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    df_names = df.columns
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
           T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*df.schema.fields, *(new if last else [])])
    names = schema.names
    return df.mapInArrow(run, schema)


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", width: int = 10) -> DataFrame:
    """Every input row with n_words, n_hit, items (ids as strings, sorted), contaminated
    and hits (item, first word, word after the last); columns of these names in the
    input are replaced."""
    made = ("n_words", "n_hit", "items", "contaminated", "hits")
    df = df.drop(*[c for c in df.columns if c.lower() in made])
    out = df.withColumn("hits", F.array().cast(T.ArrayType(HIT)))
    sets = pattern_sets(benchmark, item_key, item_text, width)
    patterns = next(sets, {})
    while (following := next(sets, None)) is not None:
        out, patterns = written(scan(out, patterns, text, "hits", False), "hits"), following
    return scan(out, patterns, text, "hits", True).withColumn("contaminated", F.col("n_hit") > 0)
