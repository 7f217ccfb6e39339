"""Language identification by hierarchical discrimination.

Level 1 predicts the language family; level 2 lets one-versus-one linear support vector
machines vote between the languages of that family. Features are hashed character
n-grams (one to three bytes of the lower-cased text, words as separated in the text),
counted over the whole text and scaled to unit length. Every pair of classes, of
families as of languages, has one linear SVM fitted by averaged stochastic subgradient
descent on a bounded sample of labelled rows (``SAMPLE_PER_CLASS`` per language, those
of smallest hash); predictions cover every row.

Null texts and texts without a letter are ``und`` with score 0. With no labelled row,
everything is ``und``; with one language, all texts with letters get it, score 1.
Repeated rows each get their own row, null ids included.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import checkpointed, slices, text_bytes

#: Language codes by family; a code that is not listed is its own family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "ur", "pa", "mr", "ne"],
    "semitic": ["ar", "he", "mt", "am"],
}
UNDETERMINED = "und"
#: Bound of the fitting sample: labelled rows per language.
SAMPLE_PER_CLASS = 800
BUCKETS = 1 << 15
EPOCHS = 6
REGULARISATION = 1e-4


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), f"only-{lang}")


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length weights of one whole text."""
    low = text.decode("utf-8", "replace").lower().encode()
    b = np.frombuffer(b" " + b" ".join(low.split()) + b" ", dtype=np.uint8).astype(np.uint32)
    grams = np.concatenate([b, (b[:-1] << 8 | b[1:]) + 256, (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) + 65792])
    hashed = (grams * np.uint32(2654435761)) >> np.uint32(32 - 15)
    counts = np.bincount(hashed, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    w = np.sqrt(counts[at].astype(np.float64))
    return at.astype(np.int32), (w / np.sqrt((w * w).sum())).astype(np.float32)


def fit_pair(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray) -> tuple[np.ndarray, float]:
    """One linear SVM: averaged subgradient steps on the hinge loss, fixed order."""
    w, total, steps = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), 0
    scale, order = 1.0, np.random.default_rng(7)
    balance = {s: len(sign) / (2 * max(1, int((sign == s).sum()))) for s in (-1, 1)}
    for epoch in range(EPOCHS):
        for i in order.permutation(len(rows)):
            steps += 1
            rate = 1 / (REGULARISATION * (steps + 1 / REGULARISATION))
            at, x = rows[i]
            margin = sign[i] * scale * (w[at] @ x + w[-1])
            scale *= 1 - rate * REGULARISATION
            if margin < 1:
                push = balance[sign[i]] * rate * sign[i] / scale
                w[at] += push * x
                w[-1] += push
        total += scale * w
    return total[:-1] / EPOCHS, float(total[-1] / EPOCHS)


def fit(sample: DataFrame, text: str, lang: str) -> list[dict]:
    """Fit all pairs, one Spark task per pair; the sample and so every task is bounded."""
    langs = sorted(r[0] for r in sample.select(lang).distinct().collect())
    families: dict[str, list[str]] = {}
    for code in langs:
        families.setdefault(family(code), []).append(code)
    pairs = [("family", a, b) for a, b in itertools.combinations(sorted(families), 2)]
    pairs += [("language", a, b) for codes in families.values() for a, b in itertools.combinations(codes, 2)]
    if not pairs:
        return [{"kind": "only", "a": code, "b": code, "w": None, "c": 0.0} for code in langs]
    members = {name: families.get(name, [name]) for _, a, b in pairs for name in (a, b)}
    side = {(kind, name): members[name] if kind == "family" else [name]
            for kind, a, b in pairs for name in (a, b)}
    rows = [(i, code, s) for i, (kind, a, b) in enumerate(pairs)
            for s, name in ((1, a), (-1, b)) for code in side[kind, name]]
    use = sample.sparkSession.createDataFrame(rows, "pair int, code string, sign int")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([text, "sign"])
        w, c = fit_pair([features(t.encode()) for t in frame[text]], frame["sign"].to_numpy())
        return pd.DataFrame({"pair": frame["pair"].iloc[:1], "w": [w.astype(np.float32).tobytes()], "c": [c]})

    fitted = (sample.join(F.broadcast(use), F.col(lang) == F.col("code")).select("pair", "sign", text)
              .groupBy("pair").applyInPandas(one, "pair int, w binary, c double").collect())
    models = {r["pair"]: r for r in fitted}
    return [{"kind": kind, "a": a, "b": b, "w": models[i]["w"], "c": models[i]["c"]}
            for i, (kind, a, b) in enumerate(pairs)] + [
            {"kind": "family_of", "a": code, "b": family(code), "w": None, "c": 0.0} for code in langs]


def vote(names: list[str], pairs: dict, at: np.ndarray, x: np.ndarray) -> tuple[str, float]:
    """Winner of the pairwise machines (ties: larger margin sum) and a score in 0..1."""
    if len(names) == 1:
        return names[0], 1.0
    votes = dict.fromkeys(names, 0)
    margins = dict.fromkeys(names, 0.0)
    for a, b in itertools.combinations(names, 2):
        w, c = pairs[a, b]
        m = float(w[at] @ x) + c
        votes[a if m >= 0 else b] += 1
        margins[a] += m
        margins[b] -= m
    best = max(names, key=lambda n: (votes[n], margins[n], n))
    return best, float(1 / (1 + np.exp(-np.clip(2 * margins[best] / (len(names) - 1), -30, 30))))


def predict(df: DataFrame, models: list[dict], text: str = "text", out: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """Add the predicted language and its score to every row."""
    shared = df.sparkSession.sparkContext.broadcast(models)   # classes squared times 128 KB

    def run(batches):
        models = shared.value
        langs = {m["a"]: m["b"] for m in models if m["kind"] == "family_of"}
        langs |= {m["a"]: family(m["a"]) for m in models if m["kind"] == "only"}
        pairs = {(m["kind"], m["a"], m["b"]): (np.frombuffer(m["w"], dtype=np.float32).astype(np.float64), m["c"])
                 for m in models if m["w"] is not None}
        level = {kind: {(a, b): p for (k, a, b), p in pairs.items() if k == kind} for kind in ("family", "language")}
        families: dict[str, list[str]] = {}
        for code in sorted(langs):
            families.setdefault(langs[code], []).append(code)
        for batch in slices(batches, text):
            names, scores = [], []
            for t in text_bytes(batch[text]):
                if t is None or not langs or not any(map(str.isalpha, t.decode("utf-8", "replace"))):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                at, x = features(t)
                fam, p = vote(sorted(families), level["family"], at, x)
                code, q = vote(families[fam], level["language"], at, x)
                names.append(code)
                scores.append(p * q)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()),
                                              pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, out, score])

    clash = [c for c in df.columns if c.lower() in (out.lower(), score.lower())]
    df = df.drop(*clash)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())])
    return df.mapInArrow(run, schema)


def training_rows(df: DataFrame, key: str, text: str, lang: str, held_out) -> DataFrame:
    """The bounded sample: per language the rows of smallest hash, whole texts."""
    rows = df.filter(~held_out & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"),
                       F.xxhash64(F.col(key).cast("string")).alias("h"))
    share = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return rows.select("text", "lang").limit(0)
    # keep twice the bound by hash range first, so the ranking below sees bounded groups
    span = F.create_map(*[v for k, n in share.items()
                          for v in (F.lit(k), F.lit(min(1.0, 2 * SAMPLE_PER_CLASS / n)))])
    place = (F.col("h") / F.lit(2.0 ** 64)) + 0.5
    few = rows.filter(place <= span[F.col("lang")])
    ranked = few.withColumn("rank", F.expr("row_number() over (partition by lang order by h, text)"))
    return ranked.filter(F.col("rank") <= SAMPLE_PER_CLASS).select("text", "lang")


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             folds: int = 4, held: int = 2) -> DataFrame:
    """All input columns plus held_out, lang_pred and score. Only rows whose
    crc32(key as text) mod ``folds`` is not ``held`` are learned from."""
    held_out = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held, F.lit(False))
    models = fit(checkpointed(training_rows(df, key, text, lang, held_out)), "text", "lang")
    clash = [c for c in df.columns if c.lower() == "held_out"]
    return predict(df.drop(*clash).withColumn("held_out", held_out), models, text)

