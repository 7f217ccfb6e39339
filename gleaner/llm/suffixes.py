"""Removal of repeated byte strings with suffix arrays built by induced sorting.

Every byte covered by a string of ``length`` bytes that starts anywhere else too, in any
document, is removed. Equal strings must meet in one suffix array, without a text being
compared with all others: each window of ``length`` bytes is owned by the smallest hash
among its ``GRAM``-byte strings (the leftmost on ties), which depends on the window
alone. Consecutive windows with one owner are a run; runs are dealt by their owner's
hash, so equal windows meet.

Runs whose owner occurs once hold no repeat, and if all runs of an owner are equal (a
64-bit hash beside the 64-bit owner) all their windows are repeats. The distinct runs
of the other owners are concatenated into bounded shards. A shard's suffix array is
built by induced sorting: suffixes are classified, leftmost smaller substrings are
sorted by induction and named, the string of names is sorted in turn, and the order is
induced to all suffixes, bucket by bucket. Permuted longest common prefixes then tell
which windows are equal. Owners with very many distinct runs are dealt again, window by
window, by the window's hash.

Null texts are empty; texts below ``length`` bytes lose nothing. Repeated rows are
documents of their own, and null ids keep their rows.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import ROW, named_back, number_of, numbered, slices, text_bytes, with_row_key, written

GRAM = 32
#: Windows of a long text handled at a time; positions must fit in POSITION_BITS.
SEGMENT = 1 << 22
POSITION_BITS = 24
#: Bytes of one shard; distinct runs of one owner above which its windows are dealt again.
SHARD = 1 << 20
MANY_RUNS = 4_000

_TABLE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(6).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from every position."""
    h, size, step = _TABLE[data], 1, 0
    while size < GRAM:
        h = h[:-size] * _STEPS[step] + h[size:]
        size, step = 2 * size, step + 1
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def runs_of(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of the given texts (together below 2**POSITION_BITS bytes): text number,
    owner hash, first window, number of windows."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    if len(data) < length:
        return (np.empty(0, np.int64),) * 4
    h = gram_hashes(data)
    low = np.uint64((1 << POSITION_BITS) - 1)
    owner = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & low
    windows = np.maximum(sizes - length + 1, 0)
    at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    if not len(at):
        return (np.empty(0, np.int64),) * 4
    text = np.repeat(np.arange(len(parts)), windows)
    own = owner[at].astype(np.int64)
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (text[1:] != text[:-1])])
    return text[first], h[own[first]].view(np.int64), at[first] - begin[text[first]], np.diff(np.r_[first, len(at)])


def runs(df: DataFrame, text: str, length: int) -> DataFrame:
    """One row per run: owner, hash of its bytes, row key, first window, windows per
    run and how many equal runs follow each other (in periodic texts)."""

    def segments(batches):
        group, held = [], 0
        for batch in slices(batches, text):
            for row, t in zip(batch[ROW].to_pylist(), text_bytes(batch[text])):
                for at in range(0, max(0, len(t or b"") - length + 1), SEGMENT):
                    part = t[at:at + SEGMENT + length - 1]
                    if group and held + len(part) > SEGMENT:
                        yield group
                        group, held = [], 0
                    group.append((row, at, part))
                    held += len(part)
        if group:
            yield group

    def run(batches):
        for group in segments(batches):
            parts = [p for _, _, p in group]
            which, owner, first, n = runs_of(parts, length)
            if not len(which):
                continue
            hash_of = xxhash.xxh3_64_intdigest
            same = np.fromiter((hash_of(memoryview(parts[w])[s:s + k + length - 1]) for w, s, k in
                                zip(which.tolist(), first.tolist(), n.tolist())), dtype=np.uint64).view(np.int64)
            row = np.array([r for r, _, _ in group])[which]
            start = np.array([a for _, a, _ in group])[which] + first
            new = np.r_[True, (owner[1:] != owner[:-1]) | (same[1:] != same[:-1]) | (row[1:] != row[:-1])
                        | (n[1:] != n[:-1])]
            new = np.flatnonzero(new)
            times = np.diff(np.r_[new, len(row)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (owner[new], same[new], row[new], start[new], n[new].astype(np.int32), times)],
                names=names)

    schema = T._parse_datatype_string("owner long, same long, row long, start long, n int, times long")
    names = schema.names
    return df.select(ROW, text).mapInArrow(run, schema)


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is the sentinel."""
    n = len(t)
    differs = np.r_[t[1:] != t[:-1], True]
    nxt = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    return np.r_[t[:-1] < t[1:], True][nxt]


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix order from the order of the leftmost smaller suffixes ``lms``: larger-type
    suffixes from the left, then smaller-type ones from the right, a bucket at a time."""
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    end = np.cumsum(count)
    begin = end - count
    sa = np.full(n, -1, dtype=np.int32)

    def deal(found: np.ndarray, pointer: np.ndarray, step: int) -> None:
        c = t[found]
        order = np.argsort(c, kind="stable")
        found, c = found[order], c[order]
        per = np.bincount(c, minlength=sigma)
        rank = np.arange(len(c)) - np.repeat(np.cumsum(per) - per, per)
        sa[pointer[c] + step * rank] = found
        pointer += step * per

    seeds = np.bincount(t[lms], minlength=sigma)
    seed_at = end - seeds
    c = t[lms]
    order = np.argsort(c, kind="stable")
    sa[seed_at[c[order]] + np.arange(len(lms)) - np.repeat(np.cumsum(seeds) - seeds, seeds)] = lms[order]
    head = begin.copy()
    for b in np.flatnonzero(count):
        at = begin[b]
        while at < head[b]:
            chunk, at = sa[at:head[b]] - 1, head[b]
            chunk = chunk[chunk >= 0]
            deal(chunk[~small[chunk]], head, 1)
        chunk = sa[seed_at[b]:end[b]] - 1
        chunk = chunk[chunk >= 0]
        deal(chunk[~small[chunk]], head, 1)
    tail = end - 1
    sa[0] = n - 1                                      # the sentinel's suffix
    tail[t[n - 1]] -= 1
    if n > 1 and small[n - 2]:
        raise AssertionError("the sentinel must be smallest")
    for b in np.flatnonzero(count)[::-1]:
        at = end[b] - 1
        while at > tail[b]:
            chunk, at = sa[tail[b] + 1:at + 1][::-1] - 1, tail[b]
            chunk = chunk[chunk >= 0]
            deal(chunk[small[chunk]], tail, -1)
        chunk = sa[begin[b]:head[b]][::-1] - 1
        chunk = chunk[chunk >= 0]
        deal(chunk[small[chunk]], tail, -1)
    return sa


def _words(t: np.ndarray) -> np.ndarray:
    """Seven symbols of at most nine bits from every position, as one integer."""
    w = np.zeros(len(t) + 8, dtype=np.uint64)
    w[:len(t)] = t
    out = np.zeros(len(t), dtype=np.uint64)
    for i in range(7):
        out = out << np.uint64(9) | w[i:i + len(t)]
    return out


def _common(words: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes a[i] and b[i]."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    n = len(t)
    while len(live):                                   # seven symbols at a time
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (x < n) & (y < n)
        same = inside.copy()
        same[inside] = words[x[inside]] == words[y[inside]]
        live, rest = live[same], live[~same & inside]
        out[live] += 7
        while len(rest):                               # the last few one by one
            x, y = a[rest] + out[rest], b[rest] + out[rest]
            ok = (x < n) & (y < n)
            rest, x, y = rest[ok], x[ok], y[ok]
            rest = rest[t[x] == t[y]]
            out[rest] += 1
    return out


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Suffix order of the string of names, by ranks of doubled prefixes."""
    n, rank, width = len(names), names.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[:n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        if fresh[order[-1]] == n - 1 or width >= n:
            return order
        rank, width = fresh, 2 * width


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the bytes with an end sentinel, and the permuted longest common
    prefix of every suffix with its predecessor in the order."""
    t = np.r_[data.astype(np.int64) + 1, 0]
    n, sigma = len(t), 257
    words = _words(t)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        first = _induce(t, small, lms, sigma)
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        by = first[is_lms[first]].astype(np.int64)     # leftmost smaller substrings in order
        where = np.searchsorted(lms, by)
        stop = np.r_[lms[1:], n - 1]
        size = stop[where] - by + 1
        equal = size[1:] == size[:-1]
        pairs = np.flatnonzero(equal)
        equal[pairs] = _common(words, t, by[pairs], by[pairs + 1]) >= size[pairs]
        names = np.empty(len(lms), dtype=np.int64)
        names[where] = np.cumsum(np.r_[0, ~equal])
        if names.max() < len(lms) - 1:
            by = lms[_sort_names(names)]
        lms = by
    sa = _induce(t, small, lms, sigma).astype(np.int64)
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    plcp = np.zeros(n, dtype=np.int64)
    i = np.arange(n)
    free = (before < 0) | (i == 0) | (before == 0)     # not given by the suffix before
    free |= t[i - 1] != t[before - 1]
    at = np.flatnonzero(free & (before >= 0))
    plcp[at] = _common(words, t, at, before[at])
    last = np.maximum.accumulate(np.where(free, i, 0))
    return sa, np.maximum(plcp[last] - (i - last), 0)


def repeats(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Per text: the windows that start a string found at another place of any text."""
    data = np.frombuffer(b"\0".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    sa, plcp = suffix_array(data)
    valid = np.zeros(len(data) + 1, dtype=bool)
    for b, s in zip(begin.tolist(), sizes.tolist()):
        valid[b:b + max(0, s - length + 1)] = True
    group = np.cumsum(plcp[sa] < length)
    size = np.bincount(group, weights=valid[sa])
    hit = np.zeros(len(valid), dtype=bool)
    hit[sa] = size[group] > 1
    hit &= valid
    return [np.flatnonzero(hit[b:b + max(0, s - length + 1)]) for b, s in zip(begin.tolist(), sizes.tolist())]


def _spans(at: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of consecutive integers."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + 1).tolist()))


def shards(texts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the runs (owner, row, start, bytes): row and window range."""
    dealt = texts.repartition("owner").sortWithinPartitions("owner", "row", "start")

    def run(batches):
        held, size, last = [], 0, None
        for batch in itertools.chain(batches, [None]):
            rows = zip(*(batch[c].to_pylist() for c in ("owner", "row", "start", "bytes"))) if batch else [(None,) * 4]
            for owner, row, start, data in rows:
                if held and (owner is None or (owner != last and size > SHARD)):
                    out = [(r, s + a, s + b) for (r, s, _), at in zip(held, repeats([d for _, _, d in held], length))
                           for a, b in _spans(at)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                         names=["row", "a", "b"])
                    held, size = [], 0
                if owner is not None:
                    held.append((row, start, data))
                    size += len(data)
                    last = owner

    return dealt.mapInArrow(run, "row long, a long, b long")


def repeated_windows(rows: DataFrame, text: str, length: int) -> DataFrame:
    """(row, a, b): windows a to b of the row are found elsewhere too."""
    found = runs(rows, text, length)
    owners = written(found.groupBy("owner").agg(F.sum("times").alias("total"), F.min("same").alias("lo"),
                                                F.max("same").alias("hi"))
                     .filter("total > 1").select("owner", (F.col("lo") != F.col("hi")).alias("mixed")), "owners")
    met = written(found.join(owners, "owner"), "runs")
    span = ("row", F.col("start").alias("a"), (F.col("start") + F.col("n") * F.col("times")).alias("b"))
    whole = met.filter("not mixed").select(*span)
    mixed = met.filter("mixed")
    kinds = written(mixed.groupBy("owner", "same").agg(
        F.sum("times").alias("total"), F.min(F.struct("row", "start", "n")).alias("at")), "kinds")
    many = written(kinds.groupBy("owner").count().filter(F.col("count") > MANY_RUNS).select("owner"), "many")
    copied = mixed.join(kinds.filter("total > 1").select("owner", "same"), ["owner", "same"]).select(*span)
    wanted = kinds.join(many.withColumn("many", F.lit(True)), "owner", "left").select(
        F.col("at.row").alias("row"), F.struct("owner", "at.start", "at.n", F.coalesce("many", F.lit(False)).alias("many"))
        .alias("run"))
    wanted = written(wanted.groupBy("row").agg(F.collect_list("run").alias("runs")), "wanted")
    texts = fetch(rows.join(wanted, rows[ROW] == wanted["row"]).select("row", "runs", F.col(text).alias("t")), length)
    texts = written(texts, "bytes")
    shared = shards(texts.filter("window is null").drop("window"), length)
    dealt = texts.filter("window is not null")
    again = dealt.groupBy("owner", "window").count().filter(F.col("count") > 1).select("owner", "window")
    rest = dealt.join(written(again, "windows"), ["owner", "window"]).select(
        "row", F.col("start").alias("a"), (F.col("start") + 1).alias("b"))
    return whole.unionByName(copied).unionByName(shared).unionByName(rest)


def fetch(joined: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted runs; of owners with many runs the windows' hash."""

    def run(batches):
        for batch in slices(batches, "t", 1 << 20):
            for row, wanted, t in zip(batch["row"].to_pylist(), batch["runs"].to_pylist(), text_bytes(batch["t"])):
                out = []
                for r in wanted:
                    start, n = r["start"], r["n"]
                    if r["many"]:
                        out += [(xxhash.xxh3_64_intdigest(t[s:s + length], 1) - (1 << 63), row, s, None,
                                 xxhash.xxh3_64_intdigest(t[s:s + length]) - (1 << 63)) for s in range(start, start + n)]
                    else:
                        out.append((r["owner"], row, start, t[start:start + n + length - 1], None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))],
                    names=["owner", "row", "start", "bytes", "window"])

    return joined.mapInArrow(run, "owner long, row long, start long, bytes binary, window long")


def remove_repeats(df: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """All input columns but the text, with n_bytes, n_removed, n_spans, spans (byte
    ranges), kept (the remaining bytes) and kept_sha256. Input columns of these names are
    left out; others may have any name."""
    made = ["n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"]
    df, columns = numbered(df)
    left_out, text = [*made, text], number_of(columns, text)
    rows = with_row_key(df)
    windows = repeated_windows(rows, text, length)
    found = written(windows.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("windows")), "found")
    joined = rows.join(found, rows[ROW] == found["row"], "left").drop("row", ROW)
    names = [c for c in joined.columns if c not in (text, "windows")]

    def run(batches):
        for batch in slices(batches, text):
            out = []
            for t, found in zip(text_bytes(batch[text]), batch["windows"].to_pylist()):
                t, spans = t or b"", []
                for a, b in sorted((w["a"], w["b"] + length - 1) for w in found or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                edges = [0, *itertools.chain.from_iterable(spans), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(t), len(t) - len(kept), len(spans), [dict(zip(("start", "end"), s)) for s in spans], kept,
                            hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(names).columns, *(pa.array(c, k) for c, k in zip(zip(*out), kinds))],
                    names=[*names, *new.names])

    new = T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, "
                                   "kept binary, kept_sha256 string")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
             pa.binary(), pa.string())
    removed = joined.mapInArrow(run, T.StructType([*(joined.schema[c] for c in names), *new.fields]))
    return removed.select(*named_back(columns, left_out), *made)
