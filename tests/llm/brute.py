"""Plain Python versions of the operators' contracts, for small tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import xxhash

WHITE = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())


def remainder(key, n):
    return None if key is None else zlib.crc32(str(key).encode()) % n


def groups(n, linked):
    """Smallest member of each item's component; linked gives the pairs."""
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in linked:
        a, b = top(i), top(j)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def fingerprint(text, width=3):
    words = WHITE.findall(lower(text))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def near_fingerprints(fps, distance=3):
    return [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance]


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text).decode())


def decontaminate(text, items, width=10):
    """(n_words, n_hit, n_items, items_sha256)."""
    words, hit, found = benchmark_words(text), set(), set()
    for key, item in items:
        own = benchmark_words(item)
        for k in range(max(1, len(own) - width + 1) if own else 0):
            window = own[k:k + width]
            for i in range(len(words) - len(window) + 1):
                if words[i:i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(key))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def tokens(text):
    return [*WHITE.findall(lower(text)), None]


def base_scores(rows, folds=7, held=2):
    """Per (key, text): (n_tokens, n_known, train_tokens, base_score)."""
    counts = collections.Counter()
    for key, text in rows:
        if remainder(key, folds) != held:
            counts.update(tokens(text))
    total = sum(counts.values())
    return [(len(t), sum(counts[w] > 0 for w in t), total,
             sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t)) for t in (tokens(t) for _, t in rows)]


def cosine_links(vectors, threshold=0.95):
    x = [None if v is None or any(e is None or not math.isfinite(e) for e in v) or not any(v) else np.array(v, float)
         for v in vectors]
    x = [None if v is None else v / np.sqrt(v @ v) for v in x]
    return [(i, j) for i in range(len(x)) for j in range(i)
            if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold]


def line_templates(texts, min_documents=10, long_documents=3, similarity=0.8):
    """Texts without their recurring lines, by trying every choice of variable fields. Documents
    are copies only if they are equal but for the line in question."""
    masked_lines = []
    for t in texts:
        found = {}
        for i, line in enumerate((t or "").split("\n")):
            words = [w.decode() for w in WHITE.findall(line.encode())]
            shown = ["<*>" if any(c in "0123456789" for c in w) else w for w in words] if len(words) > 1 else words
            if shown:
                found.setdefault(tuple(shown), []).append(i)
        masked_lines.append(found)
    groups = collections.defaultdict(set)
    for doc, found in enumerate(masked_lines):
        for shown in found:
            n = len(shown)
            room = int((1 - similarity) * n + 1e-9)
            width = max(1, room // 2)
            bands = [range(i, min(i + width, n)) for i in range(3, n, width)]
            size = 2 if room > 1 and len(bands) > 1 else min(room, 1)
            choices = [()] + (list(itertools.combinations(bands, size)) if size else [])
            for choice in choices:
                hidden = {i for band in choice for i in band}
                pattern = tuple(None if i in hidden else w for i, w in enumerate(shown))
                groups[(choice, pattern)].add((doc, shown))
    dropped = set()
    for members in groups.values():
        lines = {shown for _, shown in members}
        one = next(iter(lines))
        long = len(one) >= 20 or (len(one) == 1 and len(one[0].encode()) >= 100)
        rest = {tuple(sorted(s for s in masked_lines[doc] if s != shown)) or (doc,) for doc, shown in members}
        if len(rest) >= (long_documents if long else min_documents):
            dropped |= lines
    out = []
    for t, found in zip(texts, masked_lines):
        gone = {i for shown, at in found.items() if shown in dropped for i in at}
        out.append(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    return out
