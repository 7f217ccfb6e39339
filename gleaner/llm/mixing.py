"""Language-model scores by online logistic context mixing.

A text is coded as binary decisions. A token (a word, or the end) in the dictionary, the
``DICTIONARY`` most frequent tokens of the training texts, takes the decisions of its
Huffman code; another one takes the code of an escape symbol and then those of its bytes
and a stop. For every decision predictors look up the counts of zeros and ones that the
training texts gave: one for the node of the code tree alone, and ``ORDERS`` for hashed
contexts: the node with the topic, with the topic and the class of the token before, with
the token before, and with the two tokens before; for bytes the node with the topic and
two, three or four bytes before, and with six bytes before. The topic is the cluster of
the last frequent tokens, which tells languages and styles apart. The predictions are mixed in the logistic domain by weights that the kind
and depth of the decision and the confidence of the longest contexts select, and an
adaptive map then refines the mixed probability. Topics, weights and map are learned from
all training texts: topics from the summed counts of neighbours among the frequent tokens;
weights and map online, block by block, in every task over its own texts, each occurrence
taken out of the counts that predict it, and averaged over the tasks by how often each
weight or cell was used. The sum over all decisions gives the bits, so bits per byte.

Token counts and context counts are gathered from all training texts: tasks sum their
own, Spark adds them up. Only the dictionary, the head of the token counts (``HEAD``)
and the count tables (``ORDERS`` times ``2**SLOT_BITS`` pairs) are broadcast, all of
them bounded, as are the sums of neighbours, weights and cells that reach the driver; the counts of other tokens meet their uses in a join.

Null texts are empty: one end token. With no training text all counts are zero and each
decision costs one bit. Repeated rows and null ids keep their rows.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import ROW, slices, with_row_key, written

DICTIONARY, HEAD = 1 << 16, 1 << 18
SLOT_BITS, ORDERS, BLOCK_BITS = 21, 4, 15
#: Tokens that the class of the token before tells apart; numbers of symbols and a start.
NEAR, WIDE = 1024, DICTIONARY + 2
#: Tokens that tell the topic, and topics.
FREQUENT, TOPICS = 256, 12
#: Distinct decisions of one online step; its first and last rate, the uses of a gate over which
#: it falls, and the uses in one step above which the step grows no more.
STEP, RATES, FALL, MOST = 4096, (0.02, 0.002), 20000, 1024
#: Fixed point of the weights that tasks sum up, so that the order of the sums does not matter.
FIXED = 1 << 20
#: Text bytes prepared at a time; tokens coded at a time.
PART, TOKENS = 3 << 20, 1 << 15
#: Of these, a share whose decisions are made at a time, so that they stay near the processor.
PIECES = 8
#: Sums of this many partial tables are added up in a task before the last sum.
FAN_IN = 64
GATES, CELLS = 32, 33
_M = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]
_MASK = np.uint32((1 << SLOT_BITS) - 1)
#: The table of counts has ORDERS hashed parts and one that is indexed by the node.
PARTS_OF_TABLE = ORDERS + 1


def mixed32(h: np.ndarray) -> np.ndarray:
    """Finalised 32-bit hash."""
    h = h.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * _M[1]
    h = (h ^ h >> np.uint32(13)) * _M[2]
    return h ^ h >> np.uint32(16)


def doubled(context: np.ndarray) -> np.ndarray:
    """Twice the slot of a context's hash."""
    return (context & _MASK).astype(np.int64) << 1


def token_hash(token: bytes) -> int:
    """Signed 64-bit name of a token; the end is the empty token."""
    return xxhash.xxh3_64_intdigest(token) - (1 << 63)


def token_hashes(names) -> np.ndarray:
    """token_hash of all names."""
    found = np.fromiter(map(xxhash.xxh3_64_intdigest, names), dtype=np.uint64, count=len(names))
    return (found ^ np.uint64(1 << 63)).view(np.int64)


def token_ids(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens of all texts, the texts' tokens one after the other as numbers of
    these, and the number of each text's tokens. The end, the empty token, is the last."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    found, offsets = coded.indices.to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    if b"" in names:                                   # those at the ends of a text are no tokens
        none = names.index(b"")
        del names[none]
        real = found != none
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        found = found[real]
        found = found - (found > none)
    size = np.diff(offsets) + 1
    ids = np.full(len(found) + len(texts), len(names))
    ids[np.arange(len(found)) + np.repeat(np.arange(len(texts)), size - 1)] = found
    return [*names, b""], ids, size


# ---------------------------------------------------------------- code trees

class Code:
    """Huffman code of symbols 0..n-1: their decisions as (tree node, bit), in one row."""

    def __init__(self, weights: list[int]):
        n = len(weights)
        heap = [(max(w, 1), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        up = [(-1, 0)] * (2 * n)
        node = n
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i], up[j] = (node, 0), (node, 1)
            heapq.heappush(heap, (a + b, node))
            node += 1
        nodes, bits, start = [], [], [0]
        for i in range(n):
            path = []
            while up[i][0] >= 0:
                path.append((up[i][0] - n, up[i][1]))
                i = up[i][0]
            nodes += [p for p, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
            start.append(len(nodes))
        self.nodes, self.bits = np.array(nodes, dtype=np.int32), np.array(bits, dtype=np.uint8)
        self.start = np.array(start, dtype=np.int64)

    def prepare(self, first_node: int) -> None:
        """Per entry: node number in the common table, twice the slot of its hash plus its bit,
        and the gate by depth."""
        depth = np.arange(len(self.nodes)) - np.repeat(self.start[:-1], np.diff(self.start))
        self.own = (self.nodes.astype(np.int64) + first_node) << 1 | self.bits
        hashed = mixed32((self.nodes.astype(np.uint32) + np.uint32(first_node + 1)) * _M[0])
        self.hash = (hashed & _MASK).astype(np.int64) << 1 | self.bits
        self.gate = np.minimum(depth, 15).astype(np.int16)
        self.size = np.diff(self.start)

    def entries(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the decisions of a symbol sequence, and the number per symbol."""
        size = self.size.take(symbols)
        shift = self.start.take(symbols) - (np.cumsum(size) - size)
        return np.repeat(shift, size) + np.arange(size.sum()), size


class Decisions(NamedTuple):
    """Places that the decisions have in the tables (twice the row plus the bit; the last
    table's row is the node), their gates, and how many decisions each symbol (or word) has."""

    places: list[np.ndarray]
    gate: np.ndarray
    size: np.ndarray

    @property
    def bit(self) -> np.ndarray:
        return (self.places[-1] & 1).astype(np.uint8)

    @property
    def node(self) -> np.ndarray:
        return self.places[-1] >> 1

    @property
    def slots(self) -> list[np.ndarray]:
        return [at >> 1 for at in self.places[:-1]]


class Stream(NamedTuple):
    """Symbols of texts in order: distinct token, text, symbol, the two before, topic."""

    token: np.ndarray
    text: np.ndarray
    symbol: np.ndarray
    one: np.ndarray
    two: np.ndarray
    topic: np.ndarray

    def keys(self) -> np.ndarray:
        """All that a symbol's decisions depend on, as one number."""
        return ((self.symbol * (TOPICS + 1) + self.topic) * WIDE + self.one) * WIDE + self.two

    def spelled(self, escape: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the spelled tokens, and what their spelling depends on."""
        at = np.flatnonzero(self.symbol == escape)
        return at, self.token[at] * (TOPICS + 1) + self.topic[at]


def key_parts(keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbol, topic and the two symbols before, of keys of a stream."""
    rest, two = np.divmod(keys, WIDE)
    rest, one = np.divmod(rest, WIDE)
    return *np.divmod(rest, TOPICS + 1), one, two


class Model:
    """Dictionary and codes; turns texts into decisions with hashed context slots."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, byte_counts: np.ndarray):
        self.counts = counts
        order = np.argsort(hashes)
        self.sorted, self.order = hashes[order], order
        size = min(DICTIONARY, len(hashes))
        self.escape = size
        listed = self.counts[:size].tolist()
        # the last symbol is never used; with it the escape has a decision even alone
        self.code = Code([*listed, max(1, total - sum(listed)), 1])
        self.bytes = Code([int(c) for c in byte_counts])        # 256 bytes, then the stop
        self.topics = np.zeros(FREQUENT, dtype=np.int64)
        self.prepare()

    def prepare(self) -> None:
        """Nodes of both code trees share one numbering."""
        self.code.prepare(0)
        self.bytes.prepare(DICTIONARY + 2)

    @classmethod
    def restored(cls, state: tuple) -> Model:
        """From state(), which holds plain arrays only and so can be broadcast."""
        model = cls.__new__(cls)
        model.counts, model.sorted, model.order, model.escape, model.topics, *codes = state
        model.code, model.bytes = Code.__new__(Code), Code.__new__(Code)
        for code, (nodes, bits, start) in zip((model.code, model.bytes), codes):
            code.nodes, code.bits, code.start = nodes, bits, start
        model.prepare()
        return model

    def state(self) -> tuple:
        return (self.counts, self.sorted, self.order, self.escape, self.topics,
                *((c.nodes, c.bits, c.start) for c in (self.code, self.bytes)))

    def lookup(self, names: list[bytes]) -> np.ndarray:
        """Place of each token in the head, or -1."""
        if not len(self.sorted) or not names:
            return np.full(len(names), -1)
        h = token_hashes(names)
        i = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[i] == h, self.order[i], -1)

    def stream(self, own: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> Stream:
        """The texts' symbols one after the other, each with its text, the two before it
        in the text and its topic: that of two of the last three frequent tokens, else of
        the last one; TOPICS at a text's start."""
        start = self.escape + 1
        whole = np.full(size.sum() + 3 * len(size), start)
        text = np.repeat(np.arange(len(size)), size)
        at = np.arange(size.sum()) + 3 * (text + 1)
        whole[at] = symbol[own]
        where = np.flatnonzero((whole < min(FREQUENT, self.escape)) | (whole == start))
        topic = np.where(whole[where] == start, TOPICS, self.topics[np.minimum(whole[where], FREQUENT - 1)])
        second, third = np.r_[topic[:1], topic[:-1]], np.r_[topic[:1], topic[:1], topic[:-2]]
        chosen = np.where(second == third, second, topic)
        last = np.zeros(len(whole), dtype=np.int64)
        last[where] = np.arange(len(where))
        last = np.maximum.accumulate(last)[at - 1]
        return Stream(own, text, whole[at], whole[at - 1], whole[at - 2], chosen[last])

    @staticmethod
    def token_context(k: int, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        """Hash of the context of table k: the topic; the topic and the token before, of which
        only the first NEAR are told apart; the token before; the two before."""
        if k < 2:
            state = (first.astype(np.uint32) + np.uint32(5)) * _M[3]
            return mixed32(state if k == 0 else state + (np.minimum(second, NEAR).astype(np.uint32) + np.uint32(50)) * _M[4])
        last = (first.astype(np.uint32) + np.uint32(7)) * _M[2]
        if k == 2:
            return mixed32(last + np.uint32(9))
        return mixed32(mixed32(last) + (second.astype(np.uint32) + np.uint32(3)) * _M[3])

    def token_decisions(self, keys: np.ndarray) -> Decisions:
        """Decisions of symbols, given as keys of a stream."""
        symbol, topic, one, two = key_parts(keys)
        entry, size = self.code.entries(symbol)
        depends = ((topic,), (topic, one), (one,), (one, two))
        contexts = tuple(self.token_context(k, *fields) for k, fields in enumerate(depends))
        return self.decisions(self.code, entry, size, contexts, self.code.gate.take(entry), size)

    @staticmethod
    def spelling(names: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, tuple, np.ndarray, np.ndarray]:
        """Bytes and stops of spelled tokens, given as keys of Stream.spelled(): their contexts'
        hashes by table, their places in the token, and how many each token has."""
        token, topic = np.divmod(keys, TOPICS + 1)
        words = [names[i] for i in token.tolist()]
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        stop = np.cumsum(length) - 1
        symbols = np.full(length.sum(), 256)
        symbols[np.delete(np.arange(len(symbols)), stop)] = data
        word = np.repeat(np.arange(len(words)), length)
        inner = np.arange(len(symbols)) - (stop - length + 1)[word]
        padded = np.r_[np.zeros(6, np.uint32), symbols.astype(np.uint32) + np.uint32(1)]
        past = [np.where(inner >= k, padded[6 - k:len(padded) - k], np.uint32(0)).astype(np.uint32) for k in range(1, 7)]
        state = (topic[word].astype(np.uint32) + np.uint32(5)) * _M[3]
        c2 = past[0] * _M[0] + past[1] * _M[4] + np.uint32(77)
        c3 = mixed32(c2) + past[2] * _M[2]
        c4 = mixed32(c3) + past[3] * _M[1]
        c6 = mixed32(mixed32(c4) + past[4] * _M[2]) + past[5] * _M[3]
        return symbols, (mixed32(c2 + state), mixed32(c3 + state), mixed32(c4 + state), mixed32(c6 + np.uint32(5))), inner, length

    def byte_decisions(self, names: list[bytes], keys: np.ndarray) -> Decisions:
        """Decisions of spelled tokens, given as keys of Stream.spelled()."""
        symbols, contexts, inner, length = self.spelling(names, keys)
        entry, size = self.bytes.entries(symbols)
        gate = np.repeat((16 + np.minimum(inner, 15)).astype(np.int16), size)
        return self.decisions(self.bytes, entry, size, contexts, gate, np.add.reduceat(size, np.cumsum(length) - length))

    @staticmethod
    def decisions(code: Code, entry: np.ndarray, size: np.ndarray, contexts: tuple, gate: np.ndarray,
                  per: np.ndarray) -> Decisions:
        h = code.hash.take(entry)
        places = [np.repeat(doubled(c), size) for c in contexts]
        for at in places:
            at ^= h
        return Decisions([*places, code.own.take(entry)], gate, per)

    def text_parts(self, texts: pa.Array):
        """The distinct tokens of all texts, their places in the head and their symbols; the
        texts' tokens as numbers of these, and how many each text has."""
        names, ids, size = token_ids(texts)
        place = self.lookup(names)
        symbol = np.where((place >= 0) & (place < self.escape), place, self.escape)
        return names, place, symbol, ids, size


def topics(pairs: np.ndarray) -> np.ndarray:
    """Clusters of the frequent tokens by what stands next to them (pair counts): k-means
    on the leading directions of the centred log counts, from far-apart starts."""
    size = pairs.sum(axis=1)
    expected = np.outer(size, pairs.sum(axis=0)) / max(1, pairs.sum())
    lift = np.maximum(np.log((pairs + 0.1) / (expected + 0.1)), 0)
    u, d, _ = np.linalg.svd(lift)
    point = u[:, :8] * d[:8]
    point /= np.maximum(np.linalg.norm(point, axis=1, keepdims=True), 1e-9)
    centre = [int(size.argmax())]
    for _ in range(TOPICS - 1):
        near = np.max(point @ point[centre].T, axis=1)
        centre.append(int(np.argmin(np.where(size > 0, near, 2))))
    centres = point[centre]
    for _ in range(20):
        own = np.argmax(point @ centres.T, axis=1)
        for k in range(TOPICS):
            if (own == k).any():
                centres[k] = (point[own == k] * (size[own == k, None] + 1)).sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return own


def neighbours(model: Model, texts: pa.Array) -> np.ndarray:
    """Of all pairs of frequent tokens, how often the one follows the other in a text as its
    next, second or third frequent token."""
    _, _, symbol, ids, size = model.text_parts(texts)
    s, text = symbol[ids], np.repeat(np.arange(len(size)), size)
    frequent = np.flatnonzero(s < min(FREQUENT, model.escape))
    s, text = s[frequent], text[frequent]
    pairs = np.zeros(FREQUENT * FREQUENT, dtype=np.int64)
    for gap in (1, 2, 3):
        at = np.flatnonzero(text[gap:] == text[:-gap])
        pairs += np.bincount(s[at + gap] * FREQUENT + s[at], minlength=len(pairs))
    return pairs


# ---------------------------------------------------------------- gathering

def batches_of(keys: np.ndarray, size: int):
    for i in range(0, len(keys), size):
        yield slice(i, i + size)


def token_counts(train: DataFrame, text: str) -> DataFrame:
    """(kind, h, n): kind 0 counts tokens by hash, kind 1 bytes of distinct tokens."""

    def run(batches):
        for batch in slices(batches, text):
            names, ids, _ = token_ids(batch[text])
            spelled = np.bincount(np.frombuffer(b"".join(names), dtype=np.uint8), minlength=257)
            spelled[256] = len(names)
            h = np.r_[token_hashes(names), np.arange(257)]
            n = np.r_[np.bincount(ids, minlength=len(names)), spelled]
            kind = np.r_[np.zeros(len(names), np.int8), np.ones(257, np.int8)]
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(h), pa.array(n)], names=["kind", "h", "n"])

    made = train.select(text).mapInArrow(run, "kind byte, h long, n long")
    return made.groupBy("kind", "h").agg(F.sum("n").alias("n"))


def pair_counts(train: DataFrame, text: str, model) -> DataFrame:
    """(cell, n): neighbours() summed over all training texts, at most FREQUENT**2 rows."""

    def run(batches):
        own, pairs = Model.restored(model.value), np.zeros(FREQUENT * FREQUENT, dtype=np.int64)
        for batch in slices(batches, text, PART):
            pairs += neighbours(own, batch[text])
        cell = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(pairs[cell])], names=["cell", "n"])

    return train.select(text).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The tokens above the smallest count (in steps of a 64th of a doubling) that at most
    ``most`` tokens reach, found from a histogram instead of a sort."""
    step = F.floor(F.log2(F.col("n")) * 64).cast("int")
    steps = counts.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()   # at most 64 * 64 rows
    least, held = 64 * 64, 0
    for s, c in sorted(((r["s"], r["c"]) for r in steps), reverse=True):
        held += c
        if held > most:
            break
        least = s
    return counts.filter(step >= least).select("h", "n")


def sums_of(keys: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed uses; keys that come in order need no sort."""
    if len(keys) and (keys[1:] < keys[:-1]).any():
        width = len(keys).bit_length()
        if int(keys.max()) < 1 << 63 - width:          # a plain sort of keys and places is quicker
            both = np.sort(keys << width | np.arange(len(keys)))
            keys, order = both >> width, both & (1 << width) - 1
        else:
            order = np.argsort(keys)
            keys = keys[order]
        uses = uses[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(uses, head) if len(head) else uses


def tally(model: Model, texts: pa.Array, counts: np.ndarray) -> None:
    """Add the decisions of the texts to counts[order, 2 * slot + bit]. A table's context
    tells fewer keys apart than the others', so each adds its own distinct ones."""
    names, _, symbol, ids, size = model.text_parts(texts)
    stream = model.stream(ids, size, symbol)
    keys, uses = np.unique(stream.keys(), return_counts=True)
    symbol, topic, one, two = key_parts(keys)
    code, near = model.code, np.minimum(one, NEAR)

    def add(k: int, code: Code, symbols: np.ndarray, contexts: np.ndarray | None, uses: np.ndarray) -> None:
        entry, size = code.entries(symbols)
        if contexts is None:
            at = code.own.take(entry)
        else:
            at = np.repeat(doubled(contexts), size)
            at ^= code.hash.take(entry)
        np.add.at(counts[k], at, np.repeat(uses.astype(counts.dtype), size))

    for part in batches_of(keys, TOKENS // PIECES):    # the two before tell almost all keys apart
        add(ORDERS - 1, code, symbol[part], model.token_context(ORDERS - 1, one[part], two[part]), uses[part])
    for k, fields in {0: (topic,), 1: (topic, near), 2: (one,), ORDERS: ()}.items():
        joined = symbol
        for field in fields:
            joined = joined * WIDE + field
        distinct, times = sums_of(joined, uses)
        for part in batches_of(distinct, TOKENS // PIECES):
            own, rest = [], distinct[part]
            for _ in fields:
                rest, field = np.divmod(rest, WIDE)
                own.insert(0, field)
            add(k, code, rest, model.token_context(k, *own) if fields else None, times[part])
    once, uses = np.unique(stream.spelled(model.escape)[1], return_counts=True)
    for words in batches_of(once, TOKENS):
        symbols, contexts, _, length = model.spelling(names, once[words])
        own = np.repeat(uses[words], length)
        for k, context in enumerate(contexts):
            distinct, times = sums_of(context.astype(np.int64) << 9 | symbols, own)
            for part in batches_of(distinct, TOKENS // PIECES):
                add(k, model.bytes, distinct[part] & 511, distinct[part] >> 9, times[part])
        add(ORDERS, model.bytes, np.arange(257), None, np.bincount(symbols, own, 257))


def unpacked(data: bytes, width: int) -> np.ndarray:
    """A compressed block of counts."""
    return np.frombuffer(pa.decompress(data, decompressed_size=8 * width, codec="zstd", asbytes=True), dtype="<i8")


def context_counts(train: DataFrame, text: str, model) -> DataFrame:
    """(k, block, data): sums of the counts of all training texts, in compressed blocks."""
    width = 2 << BLOCK_BITS

    def emit(k, block, part, array):
        return pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(block, pa.int32()), pa.array(part, pa.int32()),
             pa.array([pa.compress(a.astype("<i8").tobytes(), codec="zstd", asbytes=True) for a in array], pa.binary())],
            names=["k", "block", "part", "data"])

    def run(batches):
        counts, own = None, Model.restored(model.value)
        for batch in slices(batches, text, PART):
            counts = np.zeros((PARTS_OF_TABLE, 2 << SLOT_BITS), dtype=np.int32) if counts is None else counts
            tally(own, batch[text], counts)
        if counts is not None:
            blocks = counts.reshape(-1, width)
            per = blocks.shape[0] // PARTS_OF_TABLE
            for i in np.flatnonzero(blocks.any(axis=1)).tolist():
                yield emit([i // per], [i % per], [TaskContext.get().partitionId() % FAN_IN], blocks[i:i + 1])

    def add(batches):
        key, total = None, None
        for batch in batches:
            for k, block, part, data in zip(*(batch[c].to_pylist() for c in ("k", "block", "part", "data"))):
                if (k, block, part) != key:
                    if key is not None:
                        yield emit(*([x] for x in key), [total])
                    key, total = (k, block, part), np.zeros(width, dtype=np.int64)
                total += unpacked(data, width)
        if key is not None:
            yield emit(*([x] for x in key), [total])

    schema = "k int, block int, part int, data binary"
    found = train.select(text).mapInArrow(run, schema)
    for part in (F.col("part"), F.lit(0)):
        key = ("k", "block", "part")
        found = found.withColumn("part", part).repartition(*key).sortWithinPartitions(*key).mapInArrow(add, schema)
    return found


# ---------------------------------------------------------------- prediction

def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.06) / (n0 + 0.06)).astype(np.float32)


class Mixer:
    """Gated logistic mixing and the adaptive map, with their online updates."""

    def __init__(self):
        self.weights = np.full((GATES * 16, PARTS_OF_TABLE + 1), 1.0 / PARTS_OF_TABLE, dtype=np.float32)
        self.weights[:, -1] = 0
        self.map = np.tile(np.linspace(-8, 8, CELLS), (GATES * 16, 1)).astype(np.float32)
        # how often each gate and each cell was learned from
        self.seen, self.met = np.zeros(len(self.weights)), np.zeros(self.map.size)

    @staticmethod
    def confidence(n: np.ndarray) -> np.ndarray:
        """How often a context was seen, in four steps."""
        return (n > 0).astype(np.int8) + (n > 2) + (n > 15)

    def learn(self, found: np.ndarray, gate: np.ndarray, bit: np.ndarray, uses: np.ndarray) -> None:
        """Online steps of STEP decisions that occur ``uses`` times each, given the entries they
        find and gates of one code tree, whose half of the weights and cells is all they touch."""
        half = len(self.weights) // 2
        first = half * int(gate[0] >= half)
        own, weights, cells = gate.astype(np.int64) - first, self.weights[first:first + half], self.map[first:first + half]
        steps = -(-len(gate) // STEP)
        place = np.repeat(np.arange(steps) * half, STEP)[:len(own)] + own
        seen = np.bincount(place, uses, steps * half).reshape(steps, half)
        before = self.seen[first:first + half] + np.cumsum(seen, axis=0) - seen
        rate = np.maximum(RATES[1], RATES[0] / (1 + before / FALL))
        rates = rate / np.maximum(np.sqrt(np.maximum(seen, 1)), seen / np.sqrt(MOST))
        met, flat = np.empty(len(gate), dtype=np.int64), cells.reshape(-1)
        for step, now in zip(rates, batches_of(gate, STEP)):
            g, b, u = own[now], bit[now], uses[now]
            x = found[:, now] * np.float32(1 / (4 * SCALE))
            columns = weights.T.copy()
            mixed = columns[-1].take(g)
            for column, v in zip(columns, x):
                term = column.take(g)
                term *= v
                mixed += term
            np.minimum(np.maximum(mixed, np.float32(-7.99), out=mixed), np.float32(7.99), out=mixed)
            cell = (mixed + np.float32(8)) * np.float32((CELLS - 1) / 16)
            low = cell.astype(np.int32)
            part = cell - low
            rest = 1 - part
            at = np.add(g * CELLS, low, out=met[now])
            after = at + 1
            refined = flat.take(at) * rest
            refined += flat.take(after) * part
            error, off = (u * (b - 1 / (1 + np.exp(-p))) for p in (mixed, refined))
            for k, v in enumerate(x * error):
                weights[:, k] += step * np.bincount(g, v, half)
            weights[:, -1] += 0.3 * step * np.bincount(g, error, half)
            moved = np.bincount(at, off * rest, flat.size) + np.bincount(after, off * part, flat.size)
            cells += 3 * step[:, None] * moved.reshape(cells.shape)
        self.seen[first:first + half] += seen.sum(axis=0)
        times = np.bincount(met + first * CELLS, uses, self.map.size)
        self.met += times + np.roll(times, 1)

    def share(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all weights and cells learned from: place, uses, value times uses (fixed point)."""
        n = np.rint(np.r_[np.repeat(self.seen, self.weights.shape[1]), self.met]).astype(np.int64)
        value = np.rint(np.r_[self.weights.ravel(), self.map.ravel()] * np.float64(FIXED)).astype(np.int64)
        place = np.flatnonzero(n)
        return place, n[place], value[place] * n[place]

    def average(self, place: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
        """Take on the means of all tasks' shares; the others stay as they were at the start."""
        values = np.r_[self.weights.ravel(), self.map.ravel()]
        values[place] = total / (n * np.float64(FIXED))
        self.weights = values[:self.weights.size].reshape(self.weights.shape)
        self.map = values[self.weights.size:].reshape(self.map.shape)


def looked_up(tables: list[np.ndarray], made: Decisions, uses: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per decision the entries it finds, its gate, its bit and its uses."""
    found = np.stack([table.take(at) for table, at in zip(tables, made.places)])
    gate = made.gate * np.int16(16) + ((found[ORDERS - 2] & 3) << 2 | found[ORDERS - 1] & 3)
    return found, gate, made.bit, np.repeat(uses, made.size)


def stepwise(model: Model, tables: list[np.ndarray], mixer: Mixer, texts: pa.Array) -> None:
    """Learn from all decisions of the texts; equal ones are learned from together, the
    distinct ones in an order that is mixed."""
    names, _, symbol, ids, size = model.text_parts(texts)
    stream = model.stream(ids, size, symbol)
    for keys, most, decide in ((stream.keys(), TOKENS, model.token_decisions),
                               (stream.spelled(model.escape)[1], TOKENS // 4, lambda k: model.byte_decisions(names, k))):
        once, uses = np.unique(keys, return_counts=True)
        order = np.random.RandomState(len(once)).permutation(len(once))
        once, uses = once[order], uses[order]
        for part in batches_of(once, most):
            keys, times = once[part], uses[part].astype(np.float32)
            pieces = [looked_up(tables, decide(keys[few]), times[few]) for few in batches_of(keys, most // PIECES)]
            mixer.learn(*(np.concatenate(column, axis=-1) for column in zip(*pieces)))


def learned(train: DataFrame, text: str, model, tables) -> Mixer:
    """Mixer of all training texts: every task learns online from its own, the means over the
    tasks are weighted by uses."""

    def run(batches):
        own, mixer = Model.restored(model.value), Mixer()
        for batch in slices(batches, text, PART):
            stepwise(own, tables.value, mixer, batch[text])
        place, n, total = mixer.share()
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(n), pa.array(total)], names=["place", "n", "total"])

    found = train.select(text).mapInArrow(run, "place int, n long, total long")
    # at most one row per weight and cell
    sums = found.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
    mixer = Mixer()
    mixer.average(*(sums[c].to_numpy() for c in ("place", "n", "total")))
    return mixer


SCALE = 1000
#: Steps of a mixed prediction's logit, between -8 and 8, for which costs are kept.
COST_STEPS = 1024


def entries_of(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The stretched prediction and the confidence in 16 bits, so that tables stay near the
    processor. The confidence is the last two bits, which are below the prediction's
    precision and stay in it when it is read as a number."""
    x = np.clip(np.rint(stretch(n0, n1) * SCALE), -8 * SCALE, 8 * SCALE).astype(np.int16)
    return x << 2 | Mixer.confidence(n0 + n1).astype(np.int16)


def packed(table: np.ndarray) -> list[np.ndarray]:
    """Per part of the table the entries of its slots."""
    return [entries_of(row[::2], row[1::2]) for row in table]


def packed_without_own(table: np.ndarray) -> list[np.ndarray]:
    """Per part of the table the entries of its slots for a decision that is itself counted
    there: at 2 * slot + bit one occurrence of the bit is taken out."""
    out = []
    for row in table:
        n0, n1 = row[::2], row[1::2]
        less = np.empty(len(row), dtype=np.int16)
        less[::2] = entries_of(np.maximum(n0 - 1, 0), n1)
        less[1::2] = entries_of(n0, np.maximum(n1 - 1, 0))
        out.append(less)
    return out


class Scorer:
    """Total bits of texts under the fitted model."""

    def __init__(self, model: Model, tables: list[np.ndarray], mixer: Mixer):
        self.model, self.packed = model, tables
        columns = mixer.weights.T.copy()
        self.bias, self.columns = columns[-1], columns[:-1] / np.float32(4 * SCALE)
        self.costs = self.cost_table(mixer.map).ravel()

    @staticmethod
    def cost_table(cells: np.ndarray) -> np.ndarray:
        """Bits of a zero and of a one for every gate and step of the mixed prediction, after
        the adaptive map: the mean of the mixed and the refined prediction."""
        mixed = ((np.arange(COST_STEPS) + 0.5) * 16 / COST_STEPS - 8).astype(np.float32)
        place = (mixed + 8) * (CELLS - 1) / 16
        low = place.astype(np.int32)
        final = (mixed + cells[:, low] * (1 - (place - low)) + cells[:, low + 1] * (place - low)) / 2
        final = np.clip(final, -8, 8)
        return np.stack([np.log2(1 + np.exp(final)), np.log2(1 + np.exp(-final))], axis=-1).astype(np.float32)

    def cost(self, made: Decisions) -> np.ndarray:
        """Bits of each symbol (or word)."""
        found = [table.take(at >> 1) for table, at in zip(self.packed, made.places)]
        gate = made.gate.astype(np.int32) * 16 + ((found[ORDERS - 2] & 3) << 2 | found[ORDERS - 1] & 3)
        mixed = self.bias.take(gate)
        for k in range(PARTS_OF_TABLE):
            mixed += self.columns[k].take(gate) * found[k]
        mixed += np.float32(8)
        mixed *= np.float32(COST_STEPS / 16)
        np.clip(mixed, 0, COST_STEPS - 1, out=mixed)
        bits = self.costs.take((gate * COST_STEPS + mixed.astype(np.int32)) * 2 + made.bit)
        return np.add.reduceat(bits, np.cumsum(made.size) - made.size) if len(made.size) else bits

    def score(self, texts: pa.Array):
        """The texts' distinct tokens, their places in the head, the texts as a stream of
        these tokens, and the bits of each text."""
        model = self.model
        names, place, symbol, ids, size = model.text_parts(texts)
        stream = model.stream(ids, size, symbol)
        at, key = stream.spelled(model.escape)
        bits = np.zeros(len(size))
        for text, keys, size, decide in ((stream.text, stream.keys(), TOKENS // PIECES, model.token_decisions),
                                         (stream.text[at], key, TOKENS // 4 // PIECES, lambda k: model.byte_decisions(names, k))):
            once, back = np.unique(keys, return_inverse=True)
            if len(once):                              # equal keys cost the same wherever they stand
                cost = np.concatenate([self.cost(decide(once[part])) for part in batches_of(once, size)])
                bits += np.bincount(text, weights=cost[back], minlength=len(bits))
        return names, place, stream, bits


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """Key, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte
    per row. Rows whose crc32(key as text) mod ``folds`` is ``held`` are not learned from."""
    held_out = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held, F.lit(False))
    rows = with_row_key(df.select(F.col(key).alias("k"), F.col(text).alias("t"), held_out.alias("held_out")))
    train = rows.filter(~F.col("held_out"))
    counts = written(token_counts(train, "t"), "tokens")
    own = counts.filter("kind = 0")
    total, distinct = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = most_frequent(own, HEAD).toArrow().sort_by([("n", "descending"), ("h", "ascending")])
    spelled = np.zeros(257, dtype=np.int64)
    for r in counts.filter("kind = 1").collect():
        spelled[r["h"]] = r["n"]
    context = df.sparkSession.sparkContext
    fresh = Model(head["h"].to_numpy(), head["n"].to_numpy(), total, spelled)
    untold = context.broadcast(fresh.state())
    pairs = np.zeros(FREQUENT * FREQUENT)
    for r in pair_counts(train, "t", untold).collect():
        pairs[r["cell"]] = r["n"]
    pairs = pairs.reshape(FREQUENT, FREQUENT)
    fresh.topics = topics(pairs + pairs.T)
    untold.unpersist()
    model = context.broadcast(fresh.state())

    table = np.zeros((PARTS_OF_TABLE, 2 << SLOT_BITS), dtype=np.float32)
    width = 2 << BLOCK_BITS
    for r in context_counts(train, "t", model).toLocalIterator():
        table[r["k"], r["block"] * width:(r["block"] + 1) * width] = unpacked(r["data"], width)
    without_own = context.broadcast(packed_without_own(table))
    table = packed(table)
    mixer = learned(train, "t", model, without_own)
    without_own.unpersist()
    fitted = context.broadcast((table, mixer.weights, mixer.map))
    del table

    per = float(np.log10(total + distinct + 1))

    def run(batches):
        mixer = Mixer()
        tables, mixer.weights, mixer.map = fitted.value
        scorer = Scorer(Model.restored(model.value), tables, mixer)
        log_count = np.log10(scorer.model.counts + 1) - per
        for batch in slices(batches, "t", PART):
            names, place, stream, bits = scorer.score(batch["t"])
            at = place[stream.token]
            known = at >= 0
            n = batch.num_rows
            base = np.bincount(stream.text, weights=np.where(known, log_count[at] if len(log_count) else 0.0, 0.0), minlength=n)
            # tokens outside the head go on as (hash, uses) per text
            keys, times = np.unique(stream.text[~known] * len(names) + stream.token[~known], return_counts=True)
            text, token = np.divmod(keys, max(1, len(names)))
            h = token_hashes([names[i] for i in token.tolist()])
            cut = np.searchsorted(text, np.arange(1, n))
            size = np.maximum(np.asarray(pc.fill_null(pc.binary_length(batch["t"]), 0)), 1)
            columns = (np.bincount(stream.text, minlength=n), np.bincount(stream.text, weights=known, minlength=n).astype(np.int64),
                       base, -bits * np.log10(2), bits / size, np.split(h, cut), np.split(times, cut))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch["k"], batch["held_out"], batch[ROW], *(pa.array(c, kind) for c, kind in zip(columns, kinds))],
                names=schema.names)

    new = T._parse_datatype_string(f"{ROW} long, n_tokens long, head_known long, head_base double, score double, "
                                   "bits_per_byte double, other array<long>, times array<long>")
    schema = T.StructType([rows.schema["k"], rows.schema["held_out"], *new.fields])
    scored = written(rows.mapInArrow(run, schema), "scores")
    # the tokens outside the head are rare by construction, so no key of this join is hot
    uses = scored.select(ROW, F.explode(F.arrays_zip("other", "times")).alias("u")).select(
        ROW, F.col("u.other").alias("h"), F.col("u.times").alias("times"))
    met = uses.join(own.select("h", "n"), "h", "left")
    rest = met.groupBy(ROW).agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - per)).alias("base"))
    return scored.drop("other", "times").join(rest, ROW, "left").select(
        F.col("k").alias(key), "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte")
