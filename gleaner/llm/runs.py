"""Periodic runs of words, found on a Re-Pair grammar of each document.

A run is a stretch of words with smallest period q and at least ``max(least, exponent * q)``
words that no neighbouring word extends with that period kept. The work is per document,
for all documents of a batch at once:

1. Word ids of a document become symbols. Re-Pair: pairs of neighbouring symbols that
   occur twice without overlap become nonterminals, the most frequent first; in a round
   every pair that outranks the pairs it overlaps is replaced, so one round does the work
   of many replacements (the most frequent pair of a document always wins). It ends when
   no pair of a document occurs twice.
2. Names of the 2^k-word windows that occur again in their document (the names of two
   halves name a window; windows without a second occurrence are dropped level by level).
   They give exact longest common extensions, and the distance to a window's next place.
3. Boundaries: the one inside each nonterminal, at its first derivation only and within
   its words, and those between the symbols left over. A run of period q with
   2^(k-1) < q <= 2^k that crosses a boundary holds a window of 2^k words on a grid of
   2^(k-1) words left of the boundary whose next place is q words on; the windows of the
   grid are looked up and what they find is extended both ways.
4. The runs of a nonterminal are translated to all places where it was derived, and
   intervals of one period that share a period's length are merged to maximal ones. A run
   crosses the boundary of the smallest nonterminal (or of the leftover sequence) that
   holds it whole, so none is missed.

Words are ``[^\\x20\\x09-\\x0D]+``. A null, empty or blank text has no words and no runs; its
collapsed text is empty. Null and repeated keys keep a row each; other columns of the
input are not read. There is no shuffle: hot keys and hot sources do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import slices

LEAST, EXPONENT = 6, 4
#: Text bytes whose documents are parsed in one go (a longer text is one go of its own).
TOGETHER = 4 << 20


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and where each text's words begin (and the end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0
    upto = np.concatenate([[0], np.cumsum(real)])
    ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    return flat.filter(pa.array(real)), upto[ends]


def by_key(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sorted by key, then at. Packed into one integer where that fits, which sorts
    several times faster."""
    span = int(at[-1]) + 1 if len(at) else 1              # at is ascending
    if len(key) and (int(key.max()) + 1) * span < 1 << 63:
        both = np.sort(key * span + at)
        key = both // span
        return key, both - key * span
    order = np.argsort(key, kind="stable")
    return key[order], at[order]


class Windows:
    """Names of the windows of 2^k words that occur again in their document, per level:
    places (ascending), names, and the distance to the next place of that name (0: none)."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = len(ids)
        key, at, dense = doc * (int(ids.max(initial=0)) + 1) + ids, np.arange(n), np.full(n, -1, np.int64)
        while len(at):
            key, at = by_key(key, at)
            again = key[1:] == key[:-1]
            keep = np.zeros(len(at), bool)
            keep[1:] = again
            keep[:-1] |= again
            name = np.concatenate([[0], np.cumsum(~again)])
            gap = np.zeros(len(at), np.int64)
            gap[:-1] = np.where(again, at[1:] - at[:-1], 0)
            at, name, gap = at[keep], name[keep], gap[keep]
            if not len(at):
                break
            name = np.concatenate([[0], np.cumsum(name[1:] != name[:-1])])
            order = np.argsort(at)
            at, name, gap = at[order], name[order], gap[order]
            half = 1 << len(self.levels)
            self.levels.append((at, name, gap))
            dense[at] = name
            more = at[at + half < n]
            other = dense[more + half]
            both = other >= 0
            key = dense[more[both]] * (int(name.max()) + 1) + other[both]
            dense[at] = -1
            at = more[both]

    def names(self, level: int, at: np.ndarray) -> np.ndarray:
        places, names, _ = self.levels[level]
        i = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return np.where(places[i] == at, names[i], -1)

    def extent(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that agree before places i and j, and from them on."""
        before, after = np.zeros_like(i), np.zeros_like(i)
        for level in reversed(range(len(self.levels))):
            width = 1 << level
            x, y = (self.names(level, p - before - width) for p in (i, j))
            before += np.where((x >= 0) & (x == y), width, 0)
            x, y = (self.names(level, p + after) for p in (i, j))
            after += np.where((x >= 0) & (x == y), width, 0)
        return before, after


class Grammar:
    """Re-Pair over the words of a batch of documents. symbols holds -1 for words that occur
    once in their document, which no repeated pair can hold.

    first, left, size: a nonterminal's first derivation, the length of its left half and
    its whole length; derived, where: every derivation, ordered by nonterminal; starts: the
    places where the symbols of the leftover sequence begin."""

    def __init__(self, symbols: np.ndarray) -> None:
        s, at, end = symbols.copy(), np.arange(len(symbols)), len(symbols)
        used = int(s.max(initial=-1)) + 1
        terminals, shuffle = used, np.random.default_rng(7)
        first, left, size, derived, where = [], [], [], [], []
        alive = np.zeros(len(s), bool)
        alive[:-1] = (s[:-1] >= 0) & (s[1:] >= 0)
        while True:
            cand = np.flatnonzero(alive)
            if not len(cand):
                break
            key = s[cand] * used + s[cand + 1]
            # of pairs that overlap their like (aaa), every second one counts
            chain = np.zeros(len(cand), bool)
            chain[1:] = (key[1:] == key[:-1]) & (cand[1:] == cand[:-1] + 1)
            head = np.flatnonzero(~chain)
            usable = (np.arange(len(cand)) - np.repeat(head, np.diff(np.append(head, len(cand))))) % 2 == 0
            sorted_key, order = by_key(key, np.arange(len(cand)))
            group = np.empty(len(cand), np.int64)
            group[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            groups = int(group.max()) + 1
            count = np.bincount(group[usable], minlength=groups)
            live = count[group] >= 2
            alive[cand[~live]] = False
            pick = live & usable
            if not pick.any():
                break
            rank = np.full(len(s) + 2, -1, np.int64)
            rank[cand[pick] + 1] = (count * groups + shuffle.permutation(groups))[group[pick]]
            place, own = cand[pick], group[pick]
            won = (rank[place + 1] > rank[place]) & (rank[place + 1] > rank[place + 2])
            place, own = place[won], own[won]
            enough = np.bincount(own, minlength=groups) >= 2
            place, own = place[enough[own]], own[enough[own]]
            fresh = np.cumsum(enough) - 1                       # new symbol of a pair
            new = used + fresh[own]
            begin, middle = at[place], at[place + 1]
            after = np.append(at, end)[place + 2]
            order = np.argsort(new, kind="stable")
            lead = order[np.searchsorted(new[order], np.arange(used, used + int(enough.sum())))]
            first.append(begin[lead])
            left.append((middle - begin)[lead])
            size.append((after - begin)[lead])
            derived.append(new[order] - terminals)
            where.append(begin[order])
            used += int(enough.sum())
            s[place] = new
            keep = np.ones(len(s), bool)
            keep[place + 1] = False
            touched = np.zeros(len(s) + 1, bool)
            touched[place] = True                               # pairs that begin with a new symbol
            alive &= keep
            s, at, alive, touched = s[keep], at[keep], alive[keep], touched[:-1][keep]
            touched[:-1] |= touched[1:]                         # and those that end with one
            alive |= touched
            alive[-1] = False
            alive[:-1] &= (s[:-1] >= 0) & (s[1:] >= 0)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.first, self.left, self.size = join(first), join(left), join(size)
        self.derived, self.where, self.starts = join(derived), join(where), at


def find_runs(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST, exponent: int = EXPONENT):
    """Maximal runs of all documents of a batch: (start, end, period), places counted over the
    batch, ordered by start, then period. bounds: where each document begins, and the end."""
    none = np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    windows = Windows(ids.astype(np.int64), doc)
    if not windows.levels:
        return none, none, none
    symbols = np.full(len(ids), -1, np.int64)
    symbols[windows.levels[0][0]] = windows.levels[0][1]
    grammar = Grammar(symbols)
    rules = len(grammar.first)
    begins = np.zeros(len(ids) + 1, bool)
    begins[bounds] = True
    inner = grammar.starts[~begins[grammar.starts]]
    cut = np.concatenate([grammar.first + grammar.left, inner])
    low = np.concatenate([grammar.first, bounds[doc[inner]]])
    high = np.concatenate([grammar.first + grammar.size, bounds[doc[inner] + 1]])
    rule = np.concatenate([np.arange(rules), np.full(len(inner), -1)])
    found, dense = [], np.full(len(ids) + 1, -1, np.int64)   # the last place is never set
    for level, (at, _, gap) in enumerate(windows.levels):
        width, step = 1 << level, max(1, 1 << level >> 1)
        near = at[(gap > (width >> 1 if level else 0)) & (gap <= width)]
        if not len(near):
            continue
        period = gap[np.searchsorted(at, near)]
        before, after = windows.extent(near, near + period)
        dense[near] = np.arange(len(near))
        for j in range(5):
            i = dense[np.maximum(cut - j * step, -1)]
            hit = np.flatnonzero(i >= 0)
            i, q = i[hit], period[i[hit]]
            a = np.maximum(near[i] - before[i], low[hit])
            e = np.minimum(near[i] + q + after[i], high[hit])
            good = (a < cut[hit]) & (cut[hit] < e) & (e - a >= np.maximum(least, exponent * q))
            hit = hit[good]
            found.append((rule[hit], a[good], e[good], q[good]))
        dense[near] = -1
    if not found:
        return none, none, none
    rule, a, e, q = (np.concatenate(x) for x in zip(*found))
    own = rule >= 0
    count = np.bincount(grammar.derived, minlength=rules)
    place = np.concatenate([[0], np.cumsum(count)])
    times = count[rule[own]]
    offset = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    shift = grammar.where[np.repeat(place[rule[own]], times) + offset] - np.repeat(grammar.first[rule[own]], times)
    a, e, q = (np.concatenate([x[~own], y]) for x, y in (
        (a, np.repeat(a[own], times) + shift), (e, np.repeat(e[own], times) + shift), (q, np.repeat(q[own], times))))
    return merged(a, e, q)


def merged(a: np.ndarray, e: np.ndarray, q: np.ndarray):
    """Maximal intervals: those of one period that share at least its length are one."""
    if not len(a):
        return a, e, q
    order = np.lexsort((a, q))
    a, e, q = a[order], e[order], q[order]
    span = int(e.max()) + 1
    rank = np.concatenate([[0], np.cumsum(q[1:] != q[:-1])])
    reach = np.maximum.accumulate(rank * span + e) - rank * span
    head = np.ones(len(a), bool)
    head[1:] = (q[1:] != q[:-1]) | (a[1:] > reach[:-1] - q[1:])
    at = np.flatnonzero(head)
    e = reach[np.append(at[1:], len(a)) - 1]
    a, q = a[at], q[at]
    order = np.lexsort((q, a))
    return a[order], e[order], q[order]


def longest(start: list[int], length: list[int], period: list[int]) -> int:
    """Which run has the greatest length / period, exactly; the first of equals."""
    best = 0
    for i in range(1, len(start)):
        if length[i] * period[best] > length[best] * period[i]:
            best = i
    return best


def parse(texts: pa.Array, least: int, exponent: int) -> list[pa.Array]:
    words, bounds = word_lists(texts)
    n = len(bounds) - 1
    coded = words.dictionary_encode() if len(words) else None
    ids = np.asarray(coded.indices) if coded is not None else np.zeros(0, np.int64)
    a, e, q = find_runs(ids, bounds, least, exponent)
    # words after the first period of any run go
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, a + q, 1)
    np.add.at(covered, e, -1)
    kept = np.cumsum(covered[:-1]) == 0
    upto = np.concatenate([[0], np.cumsum(kept)])
    lists = pa.ListArray.from_arrays(pa.array(upto[bounds], pa.int32()), words.filter(pa.array(kept)).cast(pa.string()))
    collapsed = pc.binary_join(lists, " ")
    of = np.searchsorted(bounds, a, side="right") - 1
    cuts = np.searchsorted(of, np.arange(n + 1))
    best: list = [None] * n
    start, length = a - bounds[of], e - a
    for i in np.unique(of):
        part = slice(cuts[i], cuts[i + 1])
        s, m, p = start[part].tolist(), length[part].tolist(), q[part].tolist()
        top = longest(s, m, p)
        best[i] = (s[top], m[top], p[top], 1000 * m[top] // p[top])
    columns = [pa.array([None if b is None else b[k] for b in best], pa.int64()) for k in range(4)]
    each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, q)], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), each)
    return [pa.array(np.diff(cuts), pa.int64()), *columns, runs, collapsed]


def collapse_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST,
                  exponent: int = EXPONENT) -> DataFrame:
    """One row per input row: key, n_runs, the run of greatest length / period (start, length,
    period, exponent_milli; ties to the smallest start, then period; nulls without a run),
    runs (all of them, by start, then period) and text (the words that no run holds after
    its first period, joined by one space). exponent is at least 4: the grid of step 3
    needs so many periods."""
    if exponent < 4:
        raise ValueError("exponent must be at least 4")
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    names = ["k", "n_runs", "start", "length", "period", "exponent_milli", "runs", "t"]

    def run(batches):
        for batch in slices(batches, "t", TOGETHER):
            yield pa.RecordBatch.from_arrays([batch["k"], *parse(batch["t"], least, exponent)], names=names)

    found = rows.mapInArrow(run, f"k {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
                                 "runs array<struct<start: long, length: long, period: long>>, t string")
    return found.select(F.col("k").alias(key), *names[1:-1], F.col("t").alias("text"))


def periodic_tails(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text, where each tenth text (by the CRC-32 of its key) has a tail that repeats:
    with h the CRC-32, g = h div 10, n words, a = g mod n, p = 1 + (n - a) div (3 + g mod 8),
    word i >= a becomes word a + (i - a) mod p."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        # arrays of one element bind a and p once per row
        return F.flatten(F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i >= x["a"], x["a"] + (i - x["a"]) % x["p"]).otherwise(i)))))

    words = F.filter(F.split(F.col(text), r"[ \t-\r]+"), lambda w: w != "")
    made = F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(w)))
    changed = F.coalesce(h % 10 == 0, F.lit(False)) & F.col(text).isNotNull()
    return df.select(F.col(key), F.when(changed, F.array_join(made, " ")).otherwise(F.col(text)).alias(text))
