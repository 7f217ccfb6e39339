"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has bit i set if more than half of the document's word shingles (repeats
included) have it set in their 64-bit XXH64. Two fingerprints within an even distance r
have a common variant within r/2 of both, so every fingerprint emits all its variants
within r/2 and equal variants meet in a shuffle. For an odd r the bits are cut into
blocks that cover all but r-1 bits: of any r differing bits one lies in some block, so
in one of the projections that leave out a block the pair is within r-1, and the ball
of radius (r-1)/2 is emitted there. Colliding pairs are verified on all 64 bits.

Equal fingerprints are collapsed before anything is emitted, and the colliding
fingerprints of a variant yield one link per fingerprint (a spanning star of the
verified links), never all pairs.

A null or blank text has fingerprint zero and is linked like any other. Repeated rows
and null ids keep their rows; a component is named by its smallest non-null id.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import ROW, checkpointed, components, slices, text_bytes, with_row_key, written

BITS = 64
SEED = 42
#: Blocks left out in turn when the distance is odd.
BLOCKS = 3
#: Shingle hashes unpacked to bits at a time.
CHUNK = 1 << 14


def fingerprint(text: bytes | None, width: int) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or b"").lower().split()          # ASCII lower case, ASCII white space
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    hash_of = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(width))))
    total, ones = len(words) - width + 1, np.zeros(BITS, dtype=np.int64)
    while True:
        part = np.fromiter((hash_of(s, SEED) for s in itertools.islice(shingles, CHUNK)), dtype="<u8")
        if not len(part):
            break
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", width: int = 3, out: str = "fp") -> DataFrame:
    """All columns but the text, plus the fingerprint as a signed long."""
    keep = [c for c in df.columns if c not in (text, out)]

    def run(batches):
        for batch in slices(batches, text):
            fps = np.array([fingerprint(t, width) for t in text_bytes(batch[text])], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(fps)], names=[*keep, out])

    schema = T.StructType([df.schema[c] for c in keep]).add(out, "long")
    return df.select(*keep, text).mapInArrow(run, schema)


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def ball(distance: int) -> list[tuple[int, int, list[int]]]:
    """Per projection: its number, the mask of the bits kept, and the flip masks within
    half of the even distance that remains."""
    full = (1 << BITS) - 1
    if distance % 2 == 0:
        masks = [full]
    else:
        covered = BITS - (distance - 1)
        edges = [covered * i // BLOCKS for i in range(BLOCKS + 1)]
        masks = [full & ~sum(1 << i for i in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    out = []
    for n, mask in enumerate(masks):
        kept = [i for i in range(BITS) if mask >> i & 1]
        flips = [sum(1 << i for i in c) for r in range(distance // 2 + 1) for c in itertools.combinations(kept, r)]
        out.append((n, signed(mask), [signed(f) for f in flips]))
    return out


def spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (smallest, other) of the components of one colliding group; O(n) memory."""
    links, rest = [], np.sort(fps)
    while len(rest) > 1:
        root, frontier, rest = rest[0], [rest[0]], rest[1:]
        while frontier and len(rest):
            near = np.bitwise_count((rest ^ frontier.pop()).view(np.uint64)) <= distance
            if near.any():
                found = rest[near]
                links += [(int(root), int(x)) for x in found]
                frontier.extend(found)
                rest = rest[~near]
    return links


def links(distinct: DataFrame, distance: int, fp: str = "fp") -> DataFrame:
    """Verified links (a, b) between distinct fingerprints that connect all pairs within
    the distance."""
    variants = None
    for n, mask, flips in ball(distance):
        part = distinct.select(
            F.lit(n).cast("byte").alias("p"), F.col(fp).alias("fp"),
            F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip"))
        part = part.select(F.col("p"), F.col("fp").bitwiseAND(F.lit(mask).cast("long"))
                           .bitwiseXOR(F.col("flip")).alias("variant"), "fp")
        variants = part if variants is None else variants.unionByName(part)
    dealt = variants.repartition("variant", "p").sortWithinPartitions("variant", "p")

    def run(batches):
        carry = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                own = tuple(batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("variant", "p", "fp"))
                variant, p, fps = (np.concatenate(x) for x in zip(carry, own))
            else:
                variant, p, fps = carry
            if not len(fps):
                continue
            start = np.flatnonzero(np.r_[True, (variant[1:] != variant[:-1]) | (p[1:] != p[:-1])])
            end = np.r_[start[1:], len(fps)]
            if batch is not None:                      # the last group may go on
                carry = (variant[start[-1]:], p[start[-1]:], fps[start[-1]:])
                start, end = start[:-1], end[:-1]
            found = [x for i in np.flatnonzero(end - start > 1) for x in spanning(fps[start[i]:end[i]], distance)]
            if found:
                pairs = np.unique(np.array(found, dtype=np.int64), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3,
                    distance: int = 3) -> DataFrame:
    """One row per input row: key, fp (signed), component_id (smallest key reachable),
    kept (true for one row of each component) and the row key of with_row_key(), that of
    the frame where it has one already."""
    df = df if ROW in df.columns else with_row_key(df)
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), ROW)
    fps = checkpointed(fingerprints(rows, "t", width))
    first = F.struct(F.col("k").isNull().alias("n"), F.col("k").alias("k"), F.col(ROW).alias("r"))
    reps = checkpointed(fps.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")))
    labels = components(links(reps.select("fp"), distance))
    named = reps.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select(
        "fp", "first", "n", F.coalesce("label", "fp").alias("label"))
    groups = named.groupBy("label").agg(F.min("first").alias("top"), F.sum("n").alias("n"))
    # only fingerprints of several rows need a name other than their row's own
    many = written(named.select("fp", "label").join(groups.filter("n > 1"), "label").select("fp", "top"), "simhash")
    own = F.struct(F.col("k").isNull().alias("n"), F.col("k").alias("k"), F.col(ROW).alias("r"))
    top = F.coalesce("top", own)
    return fps.join(many, "fp", "left").select(
        F.col("k").alias(key), "fp", top["k"].alias("component_id"), (top["r"] == F.col(ROW)).alias("kept"), ROW)


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
