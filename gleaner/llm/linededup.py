"""Line deduplication with a log-template tree.

Every line is split into tokens and its variable fields (tokens with a digit) become a
wildcard. The tree has fixed depth: the first level is the token count, the next ones
the leading tokens; its leaves hold templates. Within a leaf lines that differ in at most
two fields are of one template: a field is a run of neighbouring tokens, and the fields
together are at most ``1 - similarity`` of the line's tokens (a line with room for one
token has one field; a shorter one none). A line therefore stands under as many candidate
templates as it has choices of fields; each is a key, and the lines that meet under a key
are its lines. Keys that hold the same lines are one template, which keeps the tokens in
which its lines agree. Nothing depends on the order of the lines or on how they are dealt
to tasks, and no line is compared with another.

A template recurs if its lines stand in documents of at least ``min_documents``
different contents, however often each was copied; a line is dropped if a template of it
recurs. Contents are compared without the line in question, by ``HASHES`` independent
minimum hashes over the word pairs of a document's other lines: documents that agree in
``LIKE`` of them are (near) copies and count once, so lines that recur only because whole
documents were copied are left to document deduplication. Lines of ``LONG`` tokens or
more, and lines of one token with ``LONG_BYTES`` or more, hardly repeat by chance and recur
from ``long_documents`` contents on. A line of one token is not masked: nothing would be left.
Of a template's documents tasks pick mutually unlike ones, as many as a template needs at
most, and these are picked from again.

Null texts stay null and have no lines; lines of fewer than ``min_tokens`` tokens are
kept. Repeated rows and null ids keep their rows; an empty table stays empty.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import ROW, named_back, number_of, numbered, slices, text_bytes, with_row_key, written

WILD = "<*>"
#: Leading tokens on the path to a leaf.
LEADING = 3
#: Minimum hashes of a mark, one byte each, and how many of them copies share at least.
HASHES, LIKE = 32, 11
#: Tokens of a long line; bytes of a long line of one token.
LONG, LONG_BYTES = 20, 100
#: Text bytes parsed in one go.
TOGETHER = 4 << 20
_ODD = np.random.RandomState(1).randint(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalised 64-bit hash."""
    h = h.astype(np.uint64)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def placed(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of tokens at their places; those of a line add up to its hash."""
    return mixed(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def marks(pairs: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bytes (one row per line group) of each group's mark: the minimum hashes over the word
    pairs of its document's other groups, or of its own where there are no others. pairs:
    32-bit hashes, a group's from ``start`` on; doc: the groups' documents, ascending."""
    head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    group = np.cumsum(np.r_[True, doc[1:] != doc[:-1]]) - 1
    alone = (np.diff(np.append(head, len(doc))) == 1)[group]
    out = np.empty((len(doc), HASHES), np.uint8)
    for i, odd in enumerate(_ODD):
        least = np.minimum.reduceat(pairs * odd, start)
        low = np.minimum.reduceat(least, head)
        lowest = least == low[group]
        several = np.add.reduceat(lowest.astype(np.int64), head) > 1
        second = np.minimum.reduceat(np.where(lowest, np.uint32(0xFFFFFFFF), least), head)
        second = np.where(several, low, second)
        mark = np.where(lowest & ~alone, second[group], np.where(alone, least, low[group]))
        out[:, i] = mark * np.uint32(0x9E3779B1) >> np.uint32(24)
    return out


def parse_batch(texts: pa.Array, min_tokens: int) -> tuple | None:
    """Of every (text, distinct masked line): number of the text, mark, leaf, hash, masked
    text, positions of the line, and whether it is long."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    lines = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    number = np.arange(len(lines)) - offsets[:-1][doc]
    split = pc.ascii_split_whitespace(lines)
    flat = split.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0
    bounds = np.concatenate([[0], np.cumsum(real)])[np.asarray(split.offsets) - split.offsets[0].as_py()]
    size = np.diff(bounds)
    wanted = size > 0
    if not wanted.any():
        return None
    coded = flat.filter(pa.array(real)).dictionary_encode()
    names, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc, number, size, begin = doc[wanted], number[wanted], size[wanted], bounds[:-1][wanted]
    line = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(ids)) - begin[line]
    plain = token_hashes(names.cast(pa.binary()).to_pylist())
    variable = np.asarray(pc.match_substring_regex(names, "[0-9]"))[ids] & (size > 1)[line]
    shown = placed(np.where(variable, token_hashes([WILD.encode()])[0], plain[ids]), place)
    whole = mixed(np.add.reduceat(shown, begin) + size.astype(np.uint64)).view(np.int64)
    leaf = mixed(np.add.reduceat(np.where(place < LEADING, shown, np.uint64(0)), begin) ^ mixed(size)).view(np.int64)
    # equal masked lines of a text are one group
    order = np.lexsort((number, whole, doc))
    head = np.flatnonzero(np.r_[True, (doc[order][1:] != doc[order][:-1]) | (whole[order][1:] != whole[order][:-1])])
    # word pairs of the lines in this order; a line of one token has the token itself
    many = np.maximum(size - 1, 1)[order]
    at = np.repeat(begin[order] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    following = np.where((size > 1)[line[at]], plain[ids[np.minimum(at + 1, len(ids) - 1)]], np.uint64(0))
    pairs = mixed(plain[ids[at]] + following * np.uint64(0xD6E8FEB86659FD93)).astype(np.uint32)
    start = (np.cumsum(many) - many)[head]
    first = order[head]
    mark = marks(pairs, start, doc[first])
    # masked texts of one line of each group
    width = size[first]
    token = np.repeat(begin[first] - (np.cumsum(width) - width), width) + np.arange(width.sum())
    wild = len(names)
    taken = pa.concat_arrays([names, pa.array([WILD], names.type)]).take(pa.array(np.where(variable, wild, ids)[token]))
    masked = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), taken), " ")
    long = (width >= LONG) | ((width == 1) & (np.asarray(pc.binary_length(masked)) >= LONG_BYTES))
    places = pa.ListArray.from_arrays(pa.array(np.append(head, len(order)), pa.int32()), pa.array(number[order], pa.int32()))
    keep = np.flatnonzero(width >= min_tokens)
    mark = pa.FixedSizeBinaryArray.from_buffers(pa.binary(HASHES), len(mark), [None, pa.py_buffer(mark.tobytes())]).cast(pa.binary())
    columns = (mark, pa.array(leaf[first]), pa.array(whole[first]), masked, places, pa.array(long))
    return (doc[first][keep], *(c.take(pa.array(keep)) for c in columns)) if len(keep) else None


def parse(df: DataFrame, text: str, min_tokens: int) -> DataFrame:
    """One row per (document, distinct masked line): row key, mark of the other lines, leaf,
    line, masked text and the positions of the line."""
    names = ["row", "mark", "leaf", "line", "masked", "at", "long"]

    def run(batches):
        for batch in slices(batches, text, TOGETHER):
            found = parse_batch(batch[text], min_tokens)
            if found is not None:
                doc, *columns = found
                yield pa.RecordBatch.from_arrays([batch[ROW].take(pa.array(doc)), *columns], names=names)

    return df.select(ROW, text).mapInArrow(
        run, "row long, mark binary, leaf long, line long, masked string, at array<int>, long boolean")


def fields(n: int, similarity: float) -> np.ndarray:
    """The choices of variable fields of a line of n tokens: per choice and field the tokens
    (from, to) that a template leaves open. The leading tokens are fixed by the leaf."""
    room = int((1 - similarity) * n + 1e-9)
    width = max(1, room // 2)
    bands = [(i, min(i + width, n)) for i in range(LEADING, n, width)] if room else []
    size = 2 if room > 1 and len(bands) > 1 else 1
    return np.array(list(itertools.combinations(bands, size)), dtype=np.int32).reshape(-1, size, 2)


def candidates(distinct: DataFrame, similarity: float) -> DataFrame:
    """(leaf, t, line, uses, long, own): the candidate templates of each distinct line, its own text
    as it stands among them (t = line)."""

    def run(batches):
        chosen: dict[int, np.ndarray] = {}
        for batch in batches:
            rows, keys = [], []
            for i, (line, masked) in enumerate(zip(batch["line"].to_pylist(), batch["masked"].to_pylist())):
                tokens = masked.split(" ")
                n = len(tokens)
                if n not in chosen:
                    if len(chosen) == 4096:                     # of the lengths met
                        chosen.clear()
                    chosen[n] = fields(n, similarity)
                ends = chosen[n]
                keys.append(np.array([line], np.int64))
                if len(ends):
                    sums = np.zeros(n + 1, np.uint64)
                    np.cumsum(placed(token_hashes([t.encode() for t in tokens]), np.arange(n)), out=sums[1:])
                    rest = sums[-1] - (sums[ends[:, :, 1]] - sums[ends[:, :, 0]]).sum(axis=1, dtype=np.uint64)
                    keys.append(mixed(rest + np.arange(1, len(ends) + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64))
                rows.append(np.full(1 + len(ends), i))
            if rows:
                at, key = np.concatenate(rows), np.concatenate(keys)
                own = np.r_[True, at[1:] != at[:-1]]
                for part in range(0, len(at), 1 << 16):
                    now = slice(part, part + (1 << 16))
                    taken = batch.select(["leaf", "line", "uses", "long"]).take(pa.array(at[now]))
                    yield pa.RecordBatch.from_arrays(
                        [taken["leaf"], pa.array(key[now]), *taken.columns[1:], pa.array(own[now])],
                        names=["leaf", "t", "line", "uses", "long", "own"])

    return distinct.select("leaf", "line", "masked", "uses", "long").mapInArrow(
        run, "leaf long, t long, line long, uses long, long boolean, own boolean")


def agreed(members: DataFrame) -> DataFrame:
    """(leaf, t, template): the tokens in which the lines (leaf, t, masked) of each template
    agree, the others as wildcards: first within each partition, then over all."""

    def run(batches):
        key, held = None, []
        for batch in itertools.chain(batches, [None]):
            rows = zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else [(None,) * 3]
            out = []
            for leaf, t, masked in rows:
                if (leaf, t) != key:
                    if held:
                        out.append((*key, " ".join(held)))
                    key, held = (leaf, t), masked.split(" ") if masked is not None else []
                elif held:
                    held = [a if a == b else WILD for a, b in zip(held, masked.split(" "))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["leaf", "t", "masked"])

    kinds = (pa.int64(), pa.int64(), pa.string())
    found = members.select("leaf", "t", "masked")
    for whole in (False, True):
        dealt = found.repartition("leaf", "t") if whole else found
        found = dealt.sortWithinPartitions("leaf", "t").mapInArrow(run, found.schema)
    return found.withColumnRenamed("masked", "template")


def unlike(uses: DataFrame, most: int) -> DataFrame:
    """Of each group (leaf, t) mutually unlike documents (row, mark), at most ``most``: first
    within each partition, then of those picked there."""

    def run(batches):
        key, rows, held, kept = None, [], np.zeros((most, HASHES), np.uint8), []
        for batch in batches:
            for leaf, t, row, mark in zip(*(c.to_pylist() for c in batch.columns)):
                if (leaf, t) != key:
                    key, rows = (leaf, t), []
                n = len(rows)
                if n == most or row in rows:
                    continue
                own = np.frombuffer(mark, dtype=np.uint8)
                if n == 0 or (held[:n] == own).sum(axis=1).max() < LIKE:
                    held[n] = own
                    rows.append(row)
                    kept.append((leaf, t, row, mark))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*kept)], names=names)
                kept = []

    names = ["leaf", "t", "row", "mark"]
    found = uses.select(*names)
    for dealt in (found, None):
        dealt = found.repartition("leaf", "t") if dealt is None else dealt
        found = dealt.sortWithinPartitions("leaf", "t", "row").mapInArrow(run, found.schema)
    return found


def recurring(lines: DataFrame, similarity: float, min_documents: int, long_documents: int) -> DataFrame:
    """(leaf, line, template) of the lines of which a template recurs; of several the one
    with most contents counted."""
    # a template's documents stand in one leaf, and unlike ones have different marks
    leaves = written(lines.select("leaf", "long", F.xxhash64("mark").alias("content")).distinct()
                     .groupBy("leaf", F.when(F.col("long"), long_documents).otherwise(min_documents).alias("least"))
                     .count().filter(F.col("count") >= F.col("least")).select("leaf", "least"), "leaves")
    held = lines.select("leaf", "line", "masked", "long").join(leaves, "leaf", "left_semi")
    distinct = written(held.groupBy("leaf", "line").agg(F.min("masked").alias("masked"), F.count("*").alias("uses"),
                                                        F.max("long").alias("long")), "lines")
    keys = candidates(distinct, similarity)
    # keys under which several lines meet, or one line as it stands; the same lines are one template
    met = keys.groupBy("leaf", "t").agg(F.sum("uses").alias("n"), F.count("*").alias("m"), F.bit_xor("line").alias("of"),
                                        F.max("own").alias("own"), F.max("long").alias("long")).filter("m > 1 or own")
    enough = met.withColumn("least", F.when(F.col("long"), long_documents).otherwise(min_documents)).filter("n >= least")
    one = written(enough.groupBy("leaf", "of", "m", "n", "least").agg(F.min("t").alias("t")).select("leaf", "t", "least"), "candidates")
    members = written(keys.select("leaf", "t", "line").join(one, ["leaf", "t"]), "members")
    # candidates' lines grow with the input: joined by a shuffle at every size
    uses = lines.select("row", "mark", "leaf", "line").join(members.select("leaf", "t", "line").hint("merge"), ["leaf", "line"])
    counted = unlike(uses, max(min_documents, long_documents)).groupBy("leaf", "t").count()
    kept = written(counted.join(one, ["leaf", "t"]).filter(F.col("count") >= F.col("least")).select("leaf", "t", "count"), "kept")
    dropped = members.select("leaf", "t", "line").join(kept, ["leaf", "t"]).join(distinct.select("leaf", "line", "masked"), ["leaf", "line"])
    named = dropped.join(agreed(dropped), ["leaf", "t"])
    return written(named.groupBy("leaf", "line").agg(F.max(F.struct("count", "template")).alias("best"))
                   .select("leaf", "line", F.col("best.template").alias("template")), "recurring")


def drop_lines(df: DataFrame, text: str = "text", similarity: float = 0.8, min_documents: int = 10,
               min_tokens: int = 1, long_documents: int = 3) -> DataFrame:
    """All input columns with the recurring lines taken out of the text, plus n_lines,
    n_dropped and templates (those whose lines were dropped). Input columns of these three
    names are left out; others may have any name."""
    made = ["n_lines", "n_dropped", "templates"]
    df, names = numbered(df)
    text = number_of(names, text)
    rows = with_row_key(df)
    lines = written(parse(rows, text, min_tokens), "parsed", "zstd")
    found = recurring(lines, similarity, min_documents, long_documents)
    # so do recurring lines
    at = lines.select(F.col("row").alias("r"), "leaf", "line", "at").join(found.hint("merge"), ["leaf", "line"])
    flagged = written(at.groupBy("r").agg(F.flatten(F.collect_list("at")).alias("drop"),
                                          F.array_sort(F.collect_set("template")).alias("templates")), "flagged")
    # documents with dropped lines grow with the input: joined by a shuffle at every size
    cut = rows.join(flagged.hint("merge"), rows[ROW] == flagged["r"], "left").drop(ROW, "r")
    none = F.expr("cast(array() as array<string>)")
    built = rebuild(cut.withColumn("templates", F.coalesce("templates", none)), text)
    return built.select(*named_back(names, made), *made)


def rebuild(cut: DataFrame, text: str) -> DataFrame:
    """Take the line numbers in ``drop`` out of the text."""
    names = [c for c in cut.columns if c not in ("drop", "templates")]

    def run(batches):
        for batch in slices(batches, text):
            texts, n_lines, n_dropped = [], [], []
            for t, drop in zip(text_bytes(batch[text]), batch["drop"].to_pylist()):
                lines = t.split(b"\n") if t else []
                if drop:
                    gone = set(drop)
                    t = b"\n".join([x for i, x in enumerate(lines) if i not in gone])
                texts.append(t)
                n_lines.append(len(lines))
                n_dropped.append(len(drop or ()))
            columns = [pa.array(texts, pa.binary()).cast(batch.schema.field(text).type) if c == text else batch[c]
                       for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), batch["templates"]],
                names=schema.names)

    schema = T.StructType([*(cut.schema[c] for c in names), T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()), cut.schema["templates"]])
    return cut.mapInArrow(run, schema)
