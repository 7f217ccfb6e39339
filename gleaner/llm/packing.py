"""Best-fit packing of token sequences by bin completion with branch and bound.

Documents are tokenised whole, end with an end id, and are cut into pieces of at most
``capacity`` tokens. Only the histogram of piece lengths (at most ``capacity`` counts,
whatever the input) reaches the planner, which works on lengths with multiplicities:
best-fit decreasing gives the first incumbent; bin completion then takes the longest
length left, enumerates the undominated fillings of the room beside it, applies each as
often as the counts allow, and prunes by the waste that a better plan could still
afford. The search stops at the lower bound or after ``NODES`` nodes, with the best plan
found. The plan is a bounded list of (length, ranks, sequence, offset) intervals; pieces
find their place by their rank among the pieces of equal length, which is a per-task
count plus the sum over earlier tasks.

Null texts are empty documents of one token, the end id. An empty table gives no rows.
Repeated rows and null ids are packed like any other row.
"""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import named_back, number_of, numbered, slices, text_bytes, worker_memory, written

TOKENIZER = "word_bpe_49k.json"
#: Distinct words and parts of words whose ids a worker remembers.
MEMORY = 1_200_000
#: Nodes that branch and bound may visit; fillings looked at around one length.
NODES, FILLINGS = 4_000, 48


#: ASCII punctuation that may end a word; a token never spans a letter and one of these.
TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


class WordTokenizer:
    """Token ids of texts. This vocabulary drops white space and case, and no token spans
    white space, or a letter and punctuation after it; so the ids of words, and of their
    parts before the punctuation that ends them, are remembered."""

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def learn(self, parts: list[bytes]) -> None:
        """Remember the ids of parts. Parts of letters only are one pre-token each, whose
        end its last id tells, so many of them are encoded as one text."""
        plain = [p for p in parts if p.isalpha() or p.decode("utf-8", "replace").isalpha()]
        for n in range(0, len(plain), 4096):
            some = plain[n:n + 4096]
            text = b" ".join(some).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(some) and stop[-1] == len(ids):
                data, at = ids.tobytes(), [0, *(4 * stop).tolist()]
                self.known.update(zip(some, [data[i:j] for i, j in itertools.pairwise(at)]))
        rest = [p for p in parts if p not in self.known]
        for n in range(0, len(rest), 2048):
            some = rest[n:n + 2048]
            found = self.tokenizer.encode_batch([p.decode("utf-8", "replace") for p in some], add_special_tokens=False)
            self.known.update((p, np.array(e.ids, dtype="<u4").tobytes()) for p, e in zip(some, found))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # a text that may hold a special token keeps its case, which tells it from others
        split = [(t if b"<|" in t else t.lower()).split() for t in (t or b"" for t in texts)]
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        new = set().union(*split).difference(known)
        # words with punctuation at the end are cut before it; only an ASCII letter there
        # surely is a letter
        heads = [(w, h) for w, h in zip(new, [w.rstrip(TAIL) for w in new])
                 if h is not w and h and 97 <= h[-1] <= 122 and b"<|" not in w]
        new.difference_update([w for w, _ in heads])
        new.update([h for _, h in heads], [w[len(h):] for w, h in heads])
        self.learn(list(new.difference(known)))
        known.update([(w, known[h] + known[w[len(h):]]) for w, h in heads])
        get = known.__getitem__
        return [b"".join(map(get, w)) for w in split]


def word_tokenizer(path: str | None) -> WordTokenizer:
    """One tokenizer per worker process, with the words that it remembers."""
    kept = worker_memory().setdefault("tokenizers", {})
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


def pieces(df: DataFrame, text: str, capacity: int, end_id: int, tokenizer: str | None) -> DataFrame:
    """One row per piece: the kept columns, piece, start, length, ids_crc32, and the
    task and the rank in it among pieces of equal length."""
    keep = [c for c in df.columns if c != text]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder, task, seen = word_tokenizer(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, text, 4 << 20):
            rows, out = [], []
            for i, ids in enumerate(encoder.encode(text_bytes(batch[text]))):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    size = len(part) // 4
                    rows.append(i)
                    out.append((n, at // 4, size, zlib.crc32(part), task, int(seen[size])))
                    seen[size] += 1
            kept = batch.select(keep).take(pa.array(rows, pa.int64()))
            made = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()))]
            if out:
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*keep, *new.names])

    new = T._parse_datatype_string("piece int, start long, length long, ids_crc32 long, task int, nth long")
    return df.select(*keep, text).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *new.fields]))


Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing over lengths with multiplicities."""
    room: dict[int, list[list]] = {}
    done: Plan = []

    def put(items: tuple[int, ...], times: int) -> None:
        room.setdefault(capacity - sum(items), []).append([items, times])

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        for gap in sorted(g for g in room if g >= size) if left else ():
            if not left:
                break
            todo, room[gap] = room[gap], []
            for items, times in todo:
                fit = gap // size
                full = min(times, left // fit)
                if full:
                    put(items + (size,) * fit, full)
                    left -= full * fit
                    times -= full
                if times and left:
                    put(items + (size,) * left, 1)
                    times, left = times - 1, 0
                if times:
                    put(items, times)
        per = capacity // size
        if left >= per:
            put((size,) * per, left // per)
        if left % per:
            put((size,) * (left % per), 1)
    for group in room.values():
        done += [(items, times) for items, times in group if times]
    return done


def fillings(room: int, counts: np.ndarray, limit: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of the room, least waste first: maximal ones in which no
    item, and no two items together, can give way to one longer piece that still fits."""
    sizes = np.arange(len(counts))
    below = np.maximum.accumulate(np.where(counts > 0, sizes, 0))
    if room == 0 or not below[room]:
        return [()]
    if below[room] == room:
        return [(room,)]                               # an exact fit dominates all others
    found: list[tuple[int, tuple[int, ...]]] = []
    used = np.zeros(len(counts), np.int64)
    looked = 0

    def longer(least: int, most: int) -> bool:
        x = int(below[min(most, len(counts) - 1)])
        return x >= least and counts[x] > used[x]

    def grow(items: tuple[int, ...], left: int, most: int) -> bool:
        """Add every number of copies of every length up to ``most``; True to stop."""
        nonlocal looked
        size = int(below[min(left, most)])
        while size:
            free = min(int(counts[size] - used[size]), left // size)
            for copies in range(free, 0, -1):
                used[size] += copies
                stop = grow(items + (size,) * copies, left - copies * size, size - 1)
                used[size] -= copies
                if stop:
                    return True
            size = int(below[size - 1])
        least = int(below[left])
        while least and counts[least] <= used[least]:
            least = int(below[least - 1])
        if not items or least:
            return False                               # something else still fits: not maximal
        looked += 1
        pair = items[-1] + items[-2] if len(items) > 1 else 0
        if not any(longer(i + 1, i + left) for i in set(items)) and not (pair and longer(pair, pair + left)):
            found.append((left, items))
        return left == 0 or looked >= limit

    grow((), room, room)
    if not found:                                      # the limit met only dominated ones
        items, left, size = (), room, int(below[room])
        while size:
            items += (size,) * (copies := min(int(counts[size]), left // size))
            left -= copies * size
            size = int(below[min(left, size - 1)])
        found = [(left, items)]
    return [items for _, items in sorted(found, key=lambda f: (f[0], len(f[1])))]


def plan(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> Plan:
    """Fillings with multiplicities that hold every piece, in as few sequences as found."""
    start = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        start[size] = n
    total = int((start * np.arange(capacity + 1)).sum())
    bound = max(-(-total // capacity), int(start[capacity // 2 + 1:].sum()))
    best = best_fit(start, capacity)
    best_bins = sum(n for _, n in best)
    stack: list[tuple[np.ndarray, Plan, int, int]] = [(start, [], 0, 0)]
    while stack and nodes > 0 and best_bins > bound:
        counts, chosen, bins, waste = stack.pop()
        nodes -= 1
        if waste > (best_bins - 1) * capacity - total:
            continue                                   # no better plan can waste so much
        left = np.flatnonzero(counts)
        if not len(left):
            best, best_bins = chosen, bins
            continue
        longest = int(left[-1])
        rest = counts.copy()
        rest[longest] -= 1
        branches = []
        for filling in fillings(capacity - longest, rest):
            items = (longest, *filling)
            need = np.bincount(items, minlength=capacity + 1)
            times = int((counts[need > 0] // need[need > 0]).min())
            branches.append((counts - times * need, [*chosen, (items, times)], bins + times,
                             waste + times * (capacity - sum(items))))
        stack += reversed(branches)                    # least waste is looked at first
    return best


def places(chosen: Plan) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for items, times in chosen:
        offset = 0
        for size in items:
            rows.append((size, ranks.get(size, 0), sequence, offset))
            ranks[size] = ranks.get(size, 0) + times
            offset += size
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(df: DataFrame, text: str = "text", capacity: int = 2048, end_id: int = 0,
         tokenizer: str | None = None) -> DataFrame:
    """One row per piece: the columns but the text, piece, start, length, ids_crc32,
    sequence_id and offset. ``tokenizer`` is the path of a tokenizer file in which white
    space separates tokens (default: the public word vocabulary). Input columns of the
    added names are left out; others may have any name."""
    made = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    df, columns = numbered(df)
    left_out, text = [*made, text], number_of(columns, text)
    cut = written(pieces(df, text, capacity, end_id, tokenizer), "pieces")
    tally = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    at = places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = tally.select(F.col("task").alias("t"), F.col("length").alias("l"),
                        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l"))).withColumn(
        "nth", F.col("nth") + F.col("base")).drop("t", "l", "base", "task")
    names = [c for c in ranked.columns if c != "nth"]
    shared = df.sparkSession.sparkContext.broadcast(at)   # at most one row per item of a filling

    def run(batches):
        size, rank, sequence, offset = shared.value.T
        key = size << 44 | rank
        for batch in batches:
            length, nth = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "nth"))
            i = np.searchsorted(key, length << 44 | nth, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.select(names).columns, pa.array(sequence[i] + nth - rank[i]), pa.array(offset[i])],
                names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*(ranked.schema[c] for c in names), T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(run, schema).select(*named_back(columns, left_out), *made)
